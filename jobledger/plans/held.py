"""Frames that a report reads several times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Held:
    """Keeps frames in memory and on disk until ``close``; they are recomputed if an executor is lost."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[-1]

    def close(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_) -> None:
        self.close()
