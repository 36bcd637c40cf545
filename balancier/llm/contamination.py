"""Benchmark passages in documents: one Aho-Corasick automaton over normalised test items.

An item gives the windows of ten words it consists of, or itself if it is shorter. The automaton
reads words as numbers of the benchmark's vocabulary (others are 0 and lead back to its root), so a
text is scanned once for all windows, and the words' places in the text say where a hit stands.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import blocks, documents, kept, null_ids

WINDOW = 10
#: Words of windows in one automaton (about 100 bytes each in a worker), and items named beside them.
#: A larger benchmark is dealt over several automata by its windows' hashes, each with a scan of its own.
AUTOMATON = 1_000_000
BLOCK = 4 * 1024 * 1024
#: Words that the automaton reads at a time; it keeps its state between.
AT_ONCE = 1 << 18

#: What parts words, as spaces: all of ASCII but letters and digits. A-Z become small.
NORMAL = W.LOWER.copy()
for _code in range(128):
    if not chr(_code).isalnum():
        NORMAL[_code] = 0x20


def normal_words(texts: pa.Array) -> W.Words:
    """Words of the normalised texts; places are those of the texts themselves, as normalising keeps lengths."""
    data, offsets = W.raw(texts)
    return W.split_bytes(NORMAL[data], offsets)


def windows(items: DataFrame) -> DataFrame:
    """``words, item``: the windows of every item, once, as words joined by spaces.

    Rows that share an item id are one item of several texts; a null id is the item of the empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK // 4):
            found = normal_words(batch.column("text"))
            own = [found.data[a:b].tobytes().decode() for a, b in zip(found.start.tolist(), found.end.tolist())]
            out, names = [], []
            for name, a, b in zip(batch.column("item").to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist()):
                for i in range(a, max(b - WINDOW + 1, a + (b > a))):
                    out.append(" ".join(own[i : min(i + WINDOW, b)]))
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(names, pa.string())], ["words", "item"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "words string, item string").distinct()


def patterns(spark: SparkSession, items: DataFrame) -> tuple[DataFrame, int]:
    """``words, items, automaton``: every window with its items, and how many automata they are dealt over."""
    grouped = windows(items).groupBy("words").agg(F.collect_list("item").alias("items"))
    table = kept(spark, grouped)
    weight = F.size(F.split("words", " ")) + F.size("items")
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    count = -(-total // AUTOMATON)
    return table.withColumn("automaton", F.pmod(F.xxhash64("words"), F.lit(max(1, count)))), count


class Scanner:
    """An automaton over windows, with the vocabulary that numbers words by their hashes."""

    def __init__(self, found: list[tuple[str, list[str]]]):
        self.items = [items for _, items in found]
        self.words = [words.split(" ") for words, _ in found]
        vocabulary = pa.array(sorted({w for words in self.words for w in words}), pa.string())
        hashes = W.split(vocabulary).hash
        order = np.argsort(hashes)
        self.hash = hashes[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two words of the benchmark share a hash")
        number = dict(zip(vocabulary.take(pa.array(order)).to_pylist(), range(1, len(order) + 1)))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, words in enumerate(self.words):
            self.automaton.add_word(tuple(number[w] for w in words), i)
        self.automaton.make_automaton()

    def scan(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of each window found in texts, in order of their last words."""
        nothing = np.zeros(0, "i8"), np.zeros(0, "i8")
        if not self.words:
            return nothing
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        known = self.hash[at] == words.hash
        # A zero after every text keeps windows inside texts.
        places = np.arange(len(words.hash)) + np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        numbers = np.zeros(len(words.hash) + len(words.first), "i8")
        numbers[places] = np.where(known, at + 1, 0)
        ends, window = [], []
        reader: Any = None
        for base in range(0, len(numbers), AT_ONCE):
            stretch = tuple(numbers[base : base + AT_ONCE].tolist())
            if reader is None:
                reader = self.automaton.iter(stretch)
            else:
                reader.set(stretch, False)
            for end, i in reader:
                ends.append(end)
                window.append(i)
        if not ends:
            return nothing
        window = np.array(window, "i8")
        size = np.array([len(w) for w in self.words], "i8")[window]
        first = np.searchsorted(places, np.array(ends, "i8")) - size + 1
        # Words were numbered by hash: the few that hit are compared themselves.
        same = [
            all(words.data[words.start[f + k] : words.end[f + k]].tobytes().decode() == w for k, w in enumerate(self.words[i]))
            for f, i in zip(first.tolist(), window.tolist())
        ]
        return first[same], window[same]


def _scanner(name: str, payload: Any) -> Scanner:
    """The scanner of a broadcast, made once in a Python worker; that of another query is forgotten."""
    held = sys.__dict__.setdefault("_balancier_scanner", {})
    if name not in held:
        held.clear()
        held[name] = Scanner(pickle.loads(payload.value))
    return held[name]


#: Spans are code points of the text, from the first hit word to the end of the last of each run.
FOUND = "n_words long, spans array<struct<first:long, last:long, start:long, stop:long>>, items array<string>"


def _found(rows: DataFrame, column: str, name: str, payload: Any) -> DataFrame:
    """What the windows of one automaton hit in the texts of rows; ``column`` is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(name, payload)
        for batch in blocks(batches, "text", BLOCK):
            words = normal_words(batch.column("text"))
            first, window = scanner.scan(words)
            size = np.array([len(scanner.words[i]) for i in window.tolist()], "i8")
            hit = np.zeros(len(words.start) + 1, "i8")
            np.add.at(hit, first, 1)
            np.add.at(hit, first + size, -1)
            hit = np.cumsum(hit)[:-1] > 0
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1]
            closes[:-1] &= ~hit[1:]
            heads = words.first[:-1][np.diff(words.first) > 0]  # a run ends with its text
            opens[heads] = hit[heads]
            closes[heads[1:] - 1] = hit[heads[1:] - 1]
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            row = np.searchsorted(words.first, a, "right") - 1
            # Code points before a place: bytes that do not continue one.
            points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80)) if len(a) else np.zeros(1, "i8")
            base = words.offsets[row]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(a - words.first[row]), pa.array(b + 1 - words.first[row]),
                    pa.array(points[words.start[a]] - points[base]) if len(a) else pa.array([], pa.int64()),
                    pa.array(points[words.end[b]] - points[base]) if len(a) else pa.array([], pa.int64()),
                ],
                ["first", "last", "start", "stop"],
            )
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype("i4")
            names: list[list[str]] = [[] for _ in range(batch.num_rows)]
            owner = np.searchsorted(words.first, first, "right") - 1
            for r, i in sorted(set(zip(owner.tolist(), window.tolist()))):
                names[r] += scanner.items[i]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(column), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(edges), spans),
                    pa.array([sorted(set(n)) for n in names], pa.list_(pa.string())),
                ],
                [column, "n_words", "spans", "items"],
            )

    return rows.select(column, "text").mapInArrow(run, f"{column} long, {FOUND}")


def find(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, spans, items``: runs of hit words and the items that hit.

    A span has its ``first`` word and the one after its ``last``, and the code points ``start`` and
    ``stop`` of the document's text; items are names in the order of strings. Null texts are empty
    and have no words; rows that share an id are documents of their own. The benchmark is
    read by the driver in parts of ``AUTOMATON`` words at most.
    """
    table, count = patterns(spark, items)
    rows = documents(docs)
    if count > 1:  # every scan must find the same rows
        rows = kept(spark, rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
    column, out = ("row", None) if count > 1 else ("doc_id", None)
    for i in range(max(1, count)):
        own = [(r["words"], r["items"]) for r in table.where(F.col("automaton") == i).select("words", "items").collect()]
        payload = spark.sparkContext.broadcast(pickle.dumps(own))
        one = _found(rows, column, uuid.uuid4().hex, payload)
        out = one if out is None else out.unionByName(kept(spark, one))
    if count > 1:
        # One row of each scan. Runs of two automata may overlap or touch: cut into words and joined again.
        merged = out.groupBy("row").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        merged = merged.withColumn("spans", _joined_spans())
        out = rows.select("row", "doc_id").join(merged, "row").drop("row")
    return null_ids(out, "doc_id")


def _joined_spans() -> Any:
    """Spans in order, those that overlap or touch made one."""

    def add(done: Any, span: Any) -> Any:
        last = F.element_at(done, -1)
        wider = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"),
        )
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"]), joined).otherwise(F.concat(done, F.array(span)))

    empty = F.slice("spans", 1, 0)
    return F.aggregate(F.array_sort("spans"), empty, add)


def digests(found: DataFrame) -> DataFrame:
    """Counts of a document's words, hit words and items, and the hash of its items' names."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
