"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Reports run on job-level data that is often skewed by service class or rule, so skew handling stays on
# and partitions are sized by AQE from the observed shuffle volume.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "jobledger", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings above.

    ``shuffle_partitions`` is the upper bound AQE coalesces from: on a cluster give a few times the number of
    executor cores (10 000 and more for tens of terabytes), locally the number of cores.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder the cluster shares through ``spark.checkpoint.dir``.

    Only a session in one process (local tests) may do without that setting and gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder()
    return os.path.join(shared, f"{label}-{uuid.uuid4().hex}")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="jobledger-")
