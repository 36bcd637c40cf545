"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE converts joins to broadcast and splits hot shuffle partitions from measured
# sizes, so no join in this library carries a broadcast hint on data that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Fifty metrics in one aggregate keep more than 100 buffer columns.
    "spark.sql.codegen.maxFields": "1000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts: a batch for the chunk cutter is bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(app: str = "balancier", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_base: str | None = None


def work_folder(spark: SparkSession) -> str:
    """A new folder that every executor can read and write.

    It lies under ``spark.checkpoint.dir``. Only a local session, whose executors
    share the driver's disk, may go without that setting.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base = _local_base or tempfile.mkdtemp(prefix="balancier-")
    return f"{base.rstrip('/')}/balancier-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage and gives the planner real sizes."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a long job stores and reads once or twice is compressed harder than tables that stay.
PASSING = {"compression": "zstd"}
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a write removes its shuffle files as it ends.

    Otherwise they stay until the driver collects garbage, and those of all steps of a job lie on disk
    together.
    """
    old = spark.conf.get(_REMOVED, "false")
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVED, old)
