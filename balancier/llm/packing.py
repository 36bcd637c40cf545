"""Best-fit packing of token pieces, after a dominance reduction (Martello and Toth).

A piece is known by its length alone, and there are at most ``capacity`` lengths. So the plan
is made on the histogram of lengths, whose size does not grow with the corpus, and says how
many sequences take which lengths; Spark then numbers the pieces of each length and looks up
their places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancier.llm.common import blocks, documents, kept, null_ids
from balancier.llm.encode import encoder

CAPACITY = 2048
BLOCK = 4 * 1024 * 1024


class Pattern(NamedTuple):
    """``count`` sequences that each hold ``items``: pairs of a length and how many of it."""

    items: tuple[tuple[int, int], ...]
    count: int


def reduce(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix pairs (and lone pieces) that dominate every other way to fill their sequence.

    For a piece, let ``k`` be the longest other piece that still fits beside it. If the two fill
    the sequence, or no two pieces fit beside it, then whatever else could stand beside it could
    take ``k``'s place elsewhere, so some best packing has this pair. Takes them out of ``left``.
    """
    out, again = [], True
    while again:
        again, sizes = False, sorted(left)
        for size in reversed(list(sizes)):
            while left.get(size, 0):
                room = capacity - size
                at = bisect_left(sizes, room + 1) - 1
                if at >= 0 and sizes[at] == size and left[size] == 1:
                    at -= 1  # itself is no partner
                mate = sizes[at] if at >= 0 else None
                if mate is not None and mate != room and _two_smallest(left, sizes, size) <= room:
                    break
                if mate is None:
                    count = left[size]
                    out.append(Pattern(((size, 1),), count))
                    _take(left, sizes, size, count)
                elif mate == size:
                    count = left[size] // 2
                    out.append(Pattern(((size, 2),), count))
                    _take(left, sizes, size, 2 * count)
                else:
                    count = min(left[size], left[mate])
                    out.append(Pattern(((size, 1), (mate, 1)), count))
                    _take(left, sizes, size, count)
                    _take(left, sizes, mate, count)
                again = True
    return out


def _two_smallest(left: dict[int, int], sizes: list[int], but: int) -> float:
    """Total of the two shortest pieces besides one of length ``but``."""
    found: list[int] = []
    for size in sizes[:3]:
        found += [size] * min(2, left[size] - (size == but))
    return sum(found[:2]) if len(found) > 1 else float("inf")


def _take(left: dict[int, int], sizes: list[int], size: int, count: int) -> None:
    left[size] -= count
    if not left[size]:
        del left[size]
        sizes.remove(size)


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing by whole groups of equal sequences."""
    rooms: list[int] = []  # rooms left in some open sequence, ascending
    opened: dict[int, list[Pattern]] = {}

    def put(pattern: Pattern, room: int) -> None:
        if pattern.count:
            if room not in opened:
                insort(rooms, room)
            opened.setdefault(room, []).append(pattern)

    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                base = opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                room, base = capacity, Pattern((), count)
            each = room // size
            full = min(base.count, count // each)
            put(Pattern((*base.items, (size, each)), full), room - each * size)
            count -= full * each
            rest = base.count - full if base.items else 0
            if count and count < each and (rest or not base.items):
                put(Pattern((*base.items, (size, count)), 1), room - count * size)
                rest, count = max(0, rest - 1), 0
            put(Pattern(base.items, rest), room)
    return [p for room in rooms for p in opened[room]]


def plan(lengths: dict[int, int], capacity: int) -> list[Pattern]:
    left = {s: n for s, n in lengths.items() if n}
    return reduce(left, capacity) + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows ``length, first rank, copies in a sequence, first sequence, offset``, by length and rank."""
    rows, taken, sequence = [], {}, 0
    for items, count in patterns:
        offset = 0
        for size, each in items:
            rank = taken.get(size, 0)
            rows.append((size, rank, each, sequence, offset))
            taken[size] = rank + each * count
            offset += size * each
        sequence += count
    return np.array(sorted(rows), "i8").reshape(-1, 5)


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: whole documents, longer ones cut from their end.

    All pieces of a cut document but its first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in blocks(batches, "text", BLOCK):
            rows = []
            ids, offsets = enc(batch.column("text"), end)
            data = ids.tobytes()
            for doc, at, n in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), np.diff(offsets).tolist()):
                first = (n - 1) % capacity + 1
                starts = [0, *range(first, n, capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc, i, a, b - a, zlib.crc32(data[4 * (at + a) : 4 * (at + b)])))
            columns = zip(*rows)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``.

    Ranks within a length are counted in slices of the documents, so that a length which a third
    of all pieces share is numbered by many tasks. Slices go by the ids' checksum too: documents
    without an id, or with one id, spread unless their texts are equal. Pieces that are equal in every column may
    change places, which changes no result.
    """
    cut = kept(spark, cut)
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)))
    per_slice = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, capacity))  # its size is bounded by the number of lengths

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_slice.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "slice"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return null_ids(ranked.mapInArrow(run, schema), "doc_id")
