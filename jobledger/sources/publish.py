"""Replacing partitions of a stored table so that a failed write leaves what was there.

A write has two steps. Rows first go to a folder below ``_staging``, which readers do not see; once all of them are there, the
folder gets the name that makes it count. Then each partition folder in it takes the place of its namesake in the table by
renaming. A run that dies in the first step leaves the table as it was. If it dies in the second, the next write (or
:func:`finish`) moves what is left before it does anything else. Renames are cheap on file systems; they are as many as there
are partitions in the write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

STAGING = "_staging"
READY = ".ready"
WRITING = ".writing"
REPLACED = ".replaced"


class Folders:
    """The file system that holds a path, by paths as text."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What lies in a folder, the oldest first; nothing if there is no such folder."""
        if not self.exists(path):
            return []
        found = self._system.listStatus(self._path(path))
        return [name for _, name in sorted((s.getModificationTime(), s.getPath().getName()) for s in found)]

    def is_folder(self, path: str) -> bool:
        return self._system.getFileStatus(self._path(path)).isDirectory()

    def move(self, source: str, target: str) -> None:
        """Fails unless the source is at the target afterwards, by this call or another writer's."""
        self._system.mkdirs(self._path(target).getParent())
        if not self._system.rename(self._path(source), self._path(target)) and (self.exists(source) or not self.exists(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)


def _partitions(folders: Folders, top: str, depth: int) -> list[str]:
    """Relative paths of the partition folders ``depth`` levels below ``top``."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}" for f in found for n in folders.names(top + f) if "=" in n and folders.is_folder(f"{top}{f}/{n}")]
    return found


def stage(spark: SparkSession, root: str, depth: int, write: Callable[[str], None]) -> str:
    """Step one: ``write`` puts partitions of ``depth`` levels into the folder it is given. Gives the name of what is ready."""
    place = f"{root.rstrip('/')}/{STAGING}/{uuid.uuid4().hex}-{depth}"
    write(place + WRITING)
    Folders(spark, root).move(place + WRITING, place + READY)
    return place + READY


def finish(spark: SparkSession, root: str) -> list[str]:
    """Step two, for all that is ready, in the order in which it became so. Gives the replaced partitions' relative paths."""
    root, moved = root.rstrip("/"), []
    folders = Folders(spark, root)
    for name in folders.names(f"{root}/{STAGING}"):
        if not name.endswith(READY):
            continue
        ready = f"{root}/{STAGING}/{name}"
        for partition in _partitions(folders, ready, int(name.removesuffix(READY).rpartition("-")[2])):
            if folders.exists(root + partition):
                folders.move(root + partition, ready.removesuffix(READY) + REPLACED + partition)
            folders.move(ready + partition, root + partition)
            moved.append(partition.strip("/"))
        folders.delete(ready)
        folders.delete(ready.removesuffix(READY) + REPLACED)
    return moved


def replace(spark: SparkSession, root: str, depth: int, write: Callable[[str], None]) -> list[str]:
    """Replaces the partitions that ``write`` makes; all others stay. Gives their relative paths."""
    finish(spark, root)
    stage(spark, root, depth, write)
    return finish(spark, root)
