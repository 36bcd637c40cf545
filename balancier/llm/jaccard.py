"""Jaccard join of documents on five-word shingles by parity sketches.

A document's shingles are dealt over numbered parts, and each part is the XOR of its shingles'
hashes. Two documents that differ in ``d`` shingles differ in ``d`` parts at most, so they
agree in one of the first ``d + 1`` filled parts: documents meet on equal parts, per band of
sizes. Met documents are compared by bit sketches (the parity of hashed shingles), whose
Hamming distance never exceeds the number of shingles by which the two differ, and those that
this cannot rule out by their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import blocks, documents, kept, null_ids
from balancier.llm.components import followed, merged

SHINGLE = 5
#: Linked when ``100 * both >= PERCENT * either``; the bound ``d`` below is for this number.
PERCENT = 75
#: Parts that a document meets others on, in each band. Sets of under 140 shingles use all that the
#: bound asks for. Of larger ones that differ as much as a link allows, each part is equal with a
#: chance over 0.44, independently: none of 48 is with a chance under 1e-12, like a hash collision.
KEYS = 48
BLOCK = 4 * 1024 * 1024
#: Documents of one key that are compared with each other in one step.
SIDE = 1000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles, of A-Z made small.

    A text of fewer words is one shingle; one without words has none.
    """
    words = W.split(texts, lower=True)
    hashes = W.rolling(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(hashes[a : b - SHINGLE + 1]))
        else:
            out.append(W.rolling(words.hash[a:b], b - a) if b > a else np.zeros(0, "u8"))
    return out


def _digest(shingles: np.ndarray) -> bytes:
    mixed = W.mix(shingles + np.uint64(0x632BE59BD9B4E019))
    return np.array([len(shingles), np.add.reduce(mixed), np.bitwise_xor.reduce(shingles * mixed)], "u8").tobytes()


def keys(shingles: np.ndarray) -> np.ndarray:
    """What a document meets others on.

    Bands double in size; a document looks for partners of its own band and, if it may be the
    smaller one of a link, of the next.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, "i8")
    out, home = [], n.bit_length()
    reach = 100 * n // PERCENT  # size of the largest partner
    for band in (home, home + 1):
        low, top = 1 << (band - 1), (1 << band) - 1
        if reach < low:
            continue
        differ = (n + min(top, reach)) // 7  # at 75 percent, sets of s shingles together differ in s / 7
        count = 35 * top // 100 + 6
        mixed = W.mix(shingles + np.uint64(band * 0x9E3779B97F4A7C15 % 2**64))
        part = ((mixed >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype("i8")
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        value = np.bitwise_xor.reduceat(mixed[order], first)
        take = min(differ + 1, KEYS)
        if len(filled) <= differ and len(filled) < take:  # all of them, and the empty ones
            empty = np.setdiff1d(np.arange(count), filled)
            filled, value = np.append(filled, empty), np.append(value, np.zeros(len(empty), "u8"))
            take = len(filled)
        salt = (filled[:take].astype("u8") << np.uint64(8)) + np.uint64(band)
        out.append(W.mix(value[:take] ^ W.mix(salt)))
    return np.concatenate(out).view("i8")


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles on each of 4 to 8 bits a shingle."""
    bits = max(64, 1 << (len(shingles).bit_length() + 2))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(parity.astype("u1"), bitorder="little").tobytes()


def _read(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, twin, keys, sketch``; ``twin`` is the first document of the task with the same set.

    Only that one has keys and a sketch, so a group of copies sends one set of keys per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for batch in blocks(batches, "text", BLOCK):
            ids = batch.column("doc_id").to_pylist()
            sizes, twins, found, sketches = [], [], [], []
            for doc, shingles in zip(ids, shingle_sets(batch.column("text"))):
                sizes.append(len(shingles))
                twins.append(first.setdefault(_digest(shingles), doc) if len(shingles) else doc)
                own = twins[-1] == doc and len(shingles) > 0
                found.append(keys(shingles) if own else np.zeros(0, "i8"))
                sketches.append(sketch(shingles) if own else None)
            offsets = np.append(0, np.cumsum([len(k) for k in found])).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(twins, pa.int64()), lists, pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "twin", "keys", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, twin long, keys array<long>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted documents. Texts are shuffled compressed."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, "text", BLOCK):
            small = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(small, pa.binary())], ["node", "small"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in blocks(batches, "small", BLOCK // 4):
            texts = pa.array([press.decompress(t) for t in batch.column("small").to_pylist()], pa.binary()).cast(pa.string())
            sets = shingle_sets(texts)
            offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view("i8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), lists], ["node", "shingles"]
            )

    small = docs.mapInArrow(shrink, "node long, small binary")
    # What is wanted grows with the corpus: the same plan at every size, no broadcast.
    return small.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _folded(sketch: bytes, width: int) -> np.ndarray:
    """A sketch of fewer bits, in words of 64: folding keeps the parity of what falls together."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, "u8").reshape(-1, width // 8), axis=0)


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that their sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*[batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")]):
                width = min(len(sa), len(sb))
                apart = _hamming(_folded(sa, width), _folded(sb, width))
                keep.append(100 * min(na, nb) >= PERCENT * max(na, nb) and apart <= (na + nb) // 7)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are links, by the sets of their documents."""
    pairs = kept(spark, pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = kept(spark, _sets(docs, nodes))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return met.where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("a", "b")


def near(members: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs ``a, b`` of different components within a key group whose sketches do not rule out a link.

    ``members`` has ``group, side, node, component, n, sketch``: a group is a key and two blocks of
    its documents, of which ``side`` is the first or the second; if the blocks are the same there
    is one side. With ``nearest`` only so many partners of a document in each other component.
    """

    def compare(rows: list[dict]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r["side"], r["component"], r["node"]))
        width = min(len(r["sketch"]) for r in rows)
        bits = np.zeros((len(rows), width // 8), "u8")
        for i, r in enumerate(rows):
            bits[i] = _folded(r["sketch"], width)
        n, part, side, node = (np.array([r[k] for r in rows], "i8") for k in ("n", "component", "side", "node"))
        out = []
        for i in range(len(rows)):
            rest = slice(i + 1, len(rows))
            may = (part[rest] != part[i]) & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i]))
            if side[-1]:
                may &= side[rest] != side[i]
            at = np.flatnonzero(may) + i + 1
            apart = _hamming(bits[at], bits[i])
            ok = apart <= (n[at] + n[i]) // 7
            at, apart = at[ok], apart[ok]
            if nearest and len(at) > nearest:
                order = np.lexsort((apart, part[at]))
                _, first = np.unique(part[at[order]], return_index=True)
                nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                at = at[order[nth < nearest]]
            out += [(min(int(node[i]), int(x)), max(int(node[i]), int(x))) for x in node[at]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, seen = None, [], set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    seen.update(compare(held) if len(held) > 1 else ())
                    group, held = row["group"], []
                    if len(seen) > 100_000:
                        yield _pairs(seen)
                        seen = set()
                held.append(row)
        seen.update(compare(held) if len(held) > 1 else ())
        if seen:
            yield _pairs(seen)

    return members.mapInArrow(run, "a long, b long").distinct()


def _pairs(seen: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*seen)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _apart(groups: DataFrame, parts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of the key groups that hold more than one component, in blocks of ``SIDE`` documents.

    A group of more blocks is compared block by block in as many steps as it has pairs of blocks.
    """
    own = groups.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("low <> high").select("key", F.ceil(F.col("size") / SIDE).cast("int").alias("blocks"))
    rows = own.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "node", "component", "block", other)
    pair = F.concat_ws("/", F.col("key"), F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    rows = rows.select(pair.alias("group"), side.alias("side"), "node", "component")
    return rows.join(sketches, "node").repartition("group").sortWithinPartitions("group")


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked by near-equal sets of shingles.

    Documents without words link with nothing. Rows that share an id are one document, which links
    where any of them does, and keep their own row. A null id counts as the smallest.

    First every document is verified with the one that leads most of its key groups. What that
    leaves unconnected within a group is compared by sketches: in a quarter of the groups a
    document with the nearest of every other component, then in all groups whatever is left.
    """
    docs = documents(docs)
    read = kept(spark, _read(docs))
    met = read.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = kept(spark, met.join(sizes, "key"))
    # The member that meets most others leads: of near copies of one text that text or a close one.
    weights = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = sized.select("key", "node").join(weights, "node")
    leads = weighed.groupBy("key").agg(F.bitwise_not(F.max(F.struct("weight", F.bitwise_not("node").alias("n")))["n"]).alias("lead"))
    groups = kept(spark, sized.select("key", "node").join(leads, "key"))
    sketches = read.where("sketch IS NOT NULL").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")

    led = groups.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("shared"))
    best = led.groupBy("node").agg(F.max(F.struct("shared", "lead")).alias("best"))
    pairs = best.select(F.col("best.lead").alias("a"), F.col("node").alias("b"))
    links = kept(spark, _verified(spark, _possible(pairs, sketches), docs).distinct())  # rows of one id link alike
    # A lead weighs more than the documents that it leads, or is smaller; each of these has one.
    parts = followed(spark, links.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    for nearest, share in ((1, 4), (None, 1)):
        some = groups.select("key", "node").where(F.pmod("key", F.lit(share)) == 0)
        pairs = near(_apart(some, parts, sketches), nearest)
        parts = merged(spark, parts, _verified(spark, pairs, docs))

    nodes = read.select("doc_id", "n_shingles", "twin").join(parts.withColumnRenamed("node", "twin"), "twin", "left")
    nodes = nodes.select("doc_id", "n_shingles", F.coalesce("component", "twin").alias("component"))
    # Rows of one id may be in several components of their own texts; the id is one document.
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return null_ids(nodes.join(least, "component").select("doc_id", "n_shingles", "component_id"), "doc_id", "component_id")
