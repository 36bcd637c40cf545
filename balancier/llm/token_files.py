"""Token ids in ORC: integer run lengths, row indexes and Bloom filters on the document id.

Files are written in ascending id order, one range of ids per file, so a reader can skip
files, stripes and row groups by their statistics and read stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancier.llm.common import blocks, documents, null_ids
from balancier.llm.encode import encoder

#: Rows between two entries of the row index and of the Bloom filters; smaller than ORC's own
#: default because a row is a whole document.
STRIDE = 1000
BLOCK = 4 * 1024 * 1024


def encode(docs: DataFrame, path: str, end: int) -> DataFrame:
    """One row per document: ``doc_id, part, start_in_part, n_tokens, token_ids``, in id order.

    ``part`` numbers the ranges of ids. Rows that repeat an id stay, ordered by their text's hash.
    """
    schema = "doc_id long, part int, start_in_part long, n_tokens long, token_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", BLOCK):
            ids, offsets = enc(batch.column("text"), end)
            n, ends = np.diff(offsets), offsets[1:]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(ids.view("i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, "i4")), pa.array(at + ends - n), pa.array(n), lists],
                ["doc_id", "part", "start_in_part", "n_tokens", "token_ids"],
            )
            at += int(ends[-1])

    rows = documents(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.drop("tie").mapInArrow(run, schema)


def write(tokens: DataFrame, folder: str) -> None:
    writer = tokens.write.mode("overwrite").format("orc").option("compression", "zstd")
    writer.option("orc.row.index.stride", STRIDE).option("orc.bloom.filter.columns", "doc_id").option(
        "orc.bloom.filter.fpp", "0.01"
    ).save(folder)


def read(spark: SparkSession, folder: str, *ids: int) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; with ``ids``, only theirs.

    The filter reaches the scan, where row indexes and Bloom filters prune.
    """
    rows = spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long, token_ids array<int>").orc(folder)
    # One row per written file: a table small enough for any executor, ordered in one task.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    wanted = rows.where(F.col("doc_id").isin(*ids)) if ids else rows
    placed = wanted.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part"))
    return null_ids(placed.select("doc_id", "start", "n_tokens", "token_ids"), "doc_id")


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, counted and summed from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            values, ends = np.asarray(lists.values).astype("<i4", copy=False), np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype("i8")), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "token_ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
