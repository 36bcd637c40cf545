"""What the operators share: the shape of a document table, and work kept in the shared folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.session import work_folder, written

#: A null id counts as the smallest one inside the operators and comes out as null again.
NULL_ID = -(2**63)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` (and ``more``) alone: null texts are empty, null ids the smallest id.

    Other columns are left behind here, so their names cannot clash with an operator's own.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def null_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in names})


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: by rows alone, 10,000 long texts may come at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * 1024 * 1024))


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: survives lost executors."""
    return written(df, work_folder(spark))


def once_per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for later tasks of this Python process.

    The package travels to the workers by value, so its own module variables last for one task.
    """
    held = sys.__dict__.setdefault("_balancier_llm", {})
    if name not in held:
        held[name] = make()
    return held[name]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut so that each holds about ``limit`` bytes of ``column``; a longer row stays alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for i, row in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if size and size + row > limit:
                held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, size, start = [], 0, i
            size += row
        held.append(batch.slice(start))
    if any(b.num_rows for b in held):
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches(max_chunksize=max(1, table.num_rows))[0]
