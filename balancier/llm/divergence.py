"""How far the sources of a language are apart in their words, by rows of a sparse product.

A group (language and source) and its peers meet in the terms they share. Postings are dealt by
term into cells, each with the term-major index of its terms: every group scatters its own terms
through the index into one dense accumulator over its peers (Gustavson's row accumulation), so
pairs of postings are never written out. Terms that a group lacks still have a small share in it;
sums over them follow from the few different shares of the terms it has, and are added per peer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import blocks, kept
from balancier.llm.known import gather

LEAST_DOCS = 3
UNIT = 1_000_000_000
RANKS = 200
BLOCK = 8 * 1024 * 1024
#: Postings of a cell, if its language has few sources. With G sources it has 4 G * G, so that the
#: partial sums, G * G a cell, stay fewer than the postings.
CELL = 16_384
#: Sums in the accumulators of a cell; more pairs of sources are dealt over several cells by their rows.
SUMS = 1 << 22
#: Postings of whole terms taken through the index at a time.
AT_ONCE = 1 << 18

#: What parts terms, as spaces: all of ASCII but letters. A-Z become small.
TERMS = W.LOWER.copy()
for _code in range(128):
    if not chr(_code).isalpha():
        TERMS[_code] = 0x20


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term of a group.

    Every group has a row of the empty term, so that groups without terms are known. Counts are
    added up over a block of texts, then in the task, then over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            data, offsets = W.raw(batch.column("text"))
            words = W.split_bytes(TERMS[data], offsets)
            pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            names = pc.dictionary_encode(pc.binary_join_element_wise(*[pc.cast(c, pa.binary()) for c in pairs.flatten()], b"\x00"))
            group = names.indices.to_numpy().astype("i8")
            sample = np.unique(group, return_index=True)[1]  # a row of each group
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            order = np.lexsort((words.hash, row))
            a, b = words.hash[order], row[order]
            opens = np.ones(len(a), bool)
            opens[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            heads = np.flatnonzero(opens)  # a term of a document
            n = np.diff(np.append(heads, len(a)))
            term, owner, first = a[heads], group[b[heads]], order[heads]
            order = np.lexsort((term, owner))
            term, owner = term[order], owner[order]
            opens = np.ones(len(term), bool)
            opens[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(opens)  # a term of a group
            total = np.add.reduceat(n[order], heads) if len(heads) else np.zeros(0, "i8")
            some = np.diff(np.append(heads, len(term)))
            word = first[order][heads]
            text, ends = gather(words.data, words.start[word], words.end[word] - words.start[word])
            offsets = np.append(0, ends).astype("i4")
            terms = pa.StringArray.from_buffers(len(word), pa.py_buffer(offsets), pa.py_buffer(text))
            place = pa.array(np.append(sample[owner[heads]], sample))
            none = np.zeros(len(sample), "i8")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(place), batch.column("source").take(place),
                    pa.concat_arrays([terms, pa.array([""] * len(sample), pa.string())]),
                    pa.array(np.append(total, none)), pa.array(np.append(some, none)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / (total + terms))`` exactly: a long division by three digits of a thousand."""
    rest, over = count + 1, total + terms
    out = rest // over
    rest = rest % over
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // over
        rest = rest % over
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) * (p - q) / q)``; shares are at most ``UNIT + 1``, so squares fit 64 bits."""
    return (p - q) * (p - q) // q


class Cell:
    """Sums of the rows of one cell with all peers of their language."""

    def __init__(self, sources: pa.Array, total: np.ndarray, terms: np.ndarray, own: np.ndarray):
        self.sources, self.total, self.terms, self.own = sources, total, terms, np.flatnonzero(own)
        has_terms = np.maximum(total + terms, 1)
        self.zero = share(np.zeros(len(total), "i8"), total, has_terms - total)
        self.sums = np.zeros((len(self.own), len(total)), "i8")

    def add(self, source: np.ndarray, count: np.ndarray, starts: np.ndarray) -> None:
        """Postings of whole terms, in order of terms; ``starts`` has the first of each and their number.

        The true sums are never negative and fit 64 bits; what is added on the way may wrap around.
        """
        p = share(count, self.total[source], self.terms[source])
        term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        zero, size = self.zero, np.diff(starts)
        by_source = np.argsort(source, kind="stable")
        edge = np.searchsorted(source[by_source], np.arange(len(zero) + 1))
        base = apart(zero[self.own][:, None], zero[None, :])
        self.sums += (len(starts) - 1) * base
        for g in np.flatnonzero(np.diff(edge)).tolist():
            value, times = np.unique(p[by_source[edge[g] : edge[g + 1]]], return_counts=True)
            for at in range(0, len(value), 1024):
                v, n = value[at : at + 1024, None], times[at : at + 1024, None]
                # Terms of g as if each row lacked them ...
                self.sums[:, g] += (n * (apart(zero[self.own], v) - apart(zero[self.own], zero[g]))).sum(0)
                # ... and, if g is a row, as if each peer lacked them.
                if (i := int(np.searchsorted(self.own, g))) < len(self.own) and self.own[i] == g:
                    self.sums[i] += (n * (apart(v, zero) - apart(zero[g], zero))).sum(0)
        for i, g in enumerate(self.own.tolist()):
            mine = by_source[edge[g] : edge[g + 1]]
            many = size[term[mine]]
            for at, stop in _stretches(many):
                met, _ = gather(np.arange(len(p)), starts[term[mine[at:stop]]], many[at:stop])
                here = np.repeat(p[mine[at:stop]], many[at:stop])
                peer, q = source[met], p[met]
                both = apart(here, q) - apart(here, zero[peer]) - apart(zero[g], q) + apart(zero[g], zero[peer])
                np.add.at(self.sums[i], peer, both)

    def rows(self, lang: str) -> pa.RecordBatch:
        n = len(self.total)
        row, peer = np.repeat(self.own, n), np.tile(np.arange(n), len(self.own))
        pairs = row != peer
        row, peer, sums = row[pairs], peer[pairs], self.sums.ravel()[pairs]
        out = [pa.array([lang] * len(row), pa.string()), self.sources.take(pa.array(row)), self.sources.take(pa.array(peer)), pa.array(sums)]
        return pa.RecordBatch.from_arrays(out, ["lang", "source", "item", "value"])


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a list so that each stretch holds about ``AT_ONCE`` in all."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, stop
        at = stop


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells, one after the other: first their language's sources, then postings by term."""
    name, cell, heads, held, size = None, None, [], [], 0

    def take(final: bool) -> Iterator[pa.RecordBatch]:
        """Postings of whole terms go through the cell; the last term waits for more."""
        nonlocal cell, held, size, heads
        if cell is None and heads:
            head = pa.Table.from_batches(heads).combine_chunks()
            total, terms, own = (head.column(c).to_numpy() for c in ("n", "terms", "own"))
            cell, heads = Cell(head.column("source").combine_chunks(), total, terms, own > 0), []
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            code = pc.dictionary_encode(rows.column("term").combine_chunks()).indices.to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
            if not final:
                starts = starts[:-1]
            if len(starts) > 1:
                part = rows.slice(0, int(starts[-1]))
                source = pc.index_in(part.column("source").combine_chunks(), cell.sources).to_numpy().astype("i8")
                cell.add(source, part.column("n").to_numpy(), starts)
            held = rows.slice(int(starts[-1])).to_batches()
            size = sum(b.num_rows for b in held)
        if final and cell is not None:
            yield cell.rows(name[0])
            cell = None

    for batch in batches:
        keys = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high")])
        lang = pc.dictionary_encode(batch.column("lang")).indices.to_numpy()
        new = np.append(True, (np.diff(keys, axis=1) != 0).any(0) | (np.diff(lang) != 0)) if batch.num_rows else np.zeros(0, bool)
        edges = np.append(np.flatnonzero(new), batch.num_rows)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = tuple(batch.column(c)[a].as_py() for c in ("lang", "low", "high"))
            if own != name:
                yield from take(True)
                name, held, size = own, [], 0
            rows = batch.slice(a, b - a)
            at = int(np.searchsorted(rows.column("kind").to_numpy(), 1))
            if at:
                heads.append(rows.slice(0, at))
            if at < rows.num_rows:
                held.append(rows.slice(at))
                size += rows.num_rows - at
                if size >= AT_ONCE:
                    yield from take(False)
    yield from take(True)


def pair_sums(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every source with every other of its language.

    ``groups`` has ``lang, source, n, terms``: a group's occurrences of kept terms and the number of
    these in its language; ``postings`` has ``lang, source, term, n``.
    """
    peers = F.col("sources").cast("double")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("postings").alias("postings"))
    langs = langs.select(
        "lang", F.greatest(F.lit(1), F.ceil(F.col("postings") / F.greatest(F.lit(CELL), 4 * peers * peers))).cast("int").alias("lows"),
        F.greatest(F.lit(1), F.ceil(peers * peers / SUMS)).cast("int").alias("highs"),
    )
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    heads = groups.join(langs, "lang").withColumn("low", spread("lows")).withColumn("high", spread("highs"))
    mine = F.when(F.pmod(F.xxhash64("source"), F.col("highs")) == F.col("high"), 1).otherwise(0)
    heads = heads.select("lang", "low", "high", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", "n", "terms", mine.alias("own"))
    rows = postings.join(langs, "lang").withColumn("low", F.pmod(F.xxhash64("term"), F.col("lows")).cast("int")).withColumn("high", spread("highs"))
    rows = rows.select("lang", "low", "high", F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("long").alias("terms"), F.lit(0).alias("own"))
    dealt = heads.unionByName(rows).repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "kind", "term", "source")
    parts = dealt.mapInArrow(_accumulate, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: str, total: str, terms: str) -> Column:
    """``share`` in decimals of 38 digits."""
    unit = F.lit(UNIT).cast("decimal(10,0)") * (F.col(count) + 1).cast("decimal(19,0)")
    over = (F.col(total) + F.col(terms)).cast("decimal(20,0)")
    return F.call_function("div", unit, over) + 1


def term_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a group has more of than its language."""
    whole = groups.groupBy("lang").agg(F.sum("n").alias("all"))
    each = postings.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole, "lang")
    own = groups.select("lang", "source", F.col("n").alias("total"), "terms")
    rows = postings.join(each, ["lang", "term"]).join(own, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "terms").alias("p"), _share("lang_n", "all", "terms").alias("q"))
    return rows.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources and the leading terms of each source.

    Null texts, languages and sources are empty. Every row is a document, also of a repeated or null
    id. A group without terms has the same share of every kept term; a language without kept terms
    has distances of zero and no terms. Without documents there are no rows.
    """
    counts = kept(spark, counted(docs))
    terms = counts.where("term <> ''")
    keep = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term")
    postings = kept(spark, terms.join(keep, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("postings"))
    kinds = postings.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = kept(spark, groups.fillna(0, ["n", "postings", "terms"]))
    pairs = ranked(pair_sums(groups, postings), "pair")
    leading = ranked(term_values(groups, postings), "term").where(F.col("rank") <= RANKS)
    return pairs.unionByName(leading)
