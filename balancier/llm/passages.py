"""Repeated passages of a fixed width: which windows of all texts meet, and what they share.

A window is ``width`` units (words or bytes) that follow each other in one text. Each has an
anchor, its ``k`` units of least hash, and windows with one anchor in a row form a run; the
units that a run's windows cover are its context. Equal windows have equal anchors at equal
places, so only runs of one anchor can hold equal windows. Of these, equal contexts are settled
at once; different ones go to the operator's own method, which sees all of an anchor together.

Rows between the steps are ``kind, key, ctx, doc_id, tag, span``. ``tag`` is the 64-bit hash of the
text, so that rows which share an id but not a text stay apart. ``span`` packs the first window's
place and the run's number of windows less one. Rows equal in id and text are one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import blocks, documents, kept

#: What a row says: a context to be met by others (ALONE, or already met twice within its task),
#: a run that is settled, a context of a hot anchor, a note that an anchor is hot, and what is
#: left for the operator's method.
ALONE, TWICE, SPAN, HOT, MARK, OPEN = range(6)
ROW = "kind int, key long, ctx long, doc_id long, tag long, span long"
#: Different contexts of one anchor from which on it is hot, in all texts: its windows then meet one by
#: one. An anchor with as many in one task's block is known to be hot before it is sent.
MANY = 200
BLOCK = 4 * 1024 * 1024
#: Bytes of texts whose contexts are met within the task before they are sent.
FLUSH = 32 * 1024 * 1024
#: Bytes of contexts that the operator's method is given at once, or one anchor's.
CHUNK = 256 * 1024
_FACTOR = 0xD6E8FEB86659FD93


class Kind(NamedTuple):
    """What a passage is: ``units`` gives the units and row offsets of texts, ``hashed`` their hashes.

    With ``keep_first`` the first window of equal ones stays (by id, then place), else none does.
    """

    width: int
    k: int
    keep_first: bool
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    hashed: Callable[[np.ndarray], np.ndarray]


def pack(start: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (start << 7) | more


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span >> 7, span & 127


def runs(units: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """``row, first window, more windows, anchor hash, context hash`` of every run in rows of units."""
    none = np.zeros(0, "i8")
    n = len(units)
    if n < width:
        return none, none, none, none.astype("u8"), none.astype("u8")
    grams = W.rolling(units, k)
    low = np.uint64(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype="u8")
    reach, size = width - k + 1, 1
    while 2 * size <= reach:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = reach - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & low).astype("i8")
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    ok = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    if not len(ok):
        return none, none, none, none.astype("u8"), none.astype("u8")
    at = at[ok]
    head = np.append(True, (at[1:] != at[:-1]) | (row[ok[1:]] != row[ok[:-1]]))
    heads = np.flatnonzero(head)
    first, anchor = ok[heads], at[heads]
    more = np.diff(np.append(heads, len(ok))) - 1
    power = np.empty(n + 1, "u8")
    power[0] = 1
    power[1:] = _FACTOR
    np.cumprod(power, out=power)
    sums = np.append(np.uint64(0), np.cumsum(units * power[:-1]))
    end = first + more + width
    # Brought to the power n, whose inverse takes it off: the place in the block plays no part.
    ctx = (sums[end] - sums[first]) * power[n - first] * np.uint64(pow(pow(_FACTOR, n, 2**64), -1, 2**64))
    ctx = W.mix(ctx + (anchor - first).astype("u8") * np.uint64(0xA0761D6478BD642F) + W.mix((end - first).astype("u8")))
    return row[first], first - offsets[row[first]], more, grams[anchor], ctx


def same_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each entry equals the one before it in all columns."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _rows(kind: np.ndarray, key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, tag: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    columns = [kind.astype("i4"), key.astype("u8").view("i8"), ctx.astype("u8").view("i8"), doc, tag, span]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "ctx", "doc_id", "tag", "span"])


def _meet(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, tag: np.ndarray, span: np.ndarray, twice: np.ndarray, keep_first: bool):
    """Rows in order of all five: which are each context's first, which of these are met again, which are settled."""
    again = same_before(key, ctx)
    equal = same_before(key, ctx, doc, tag, span)  # a repeated row of the table, not another place
    heads = np.flatnonzero(~again)
    others = np.add.reduceat((again & ~equal) | twice, heads) > 0 if len(heads) else np.zeros(0, bool)
    group = np.cumsum(~again) - 1
    settled = again & ~equal if keep_first else others[group] & ~equal & ~twice
    return heads, others, settled


def meet_locally(key, ctx, doc, tag, span, keep_first: bool) -> pa.RecordBatch:
    """One task's contexts: what is settled by them alone, and one row for the rest of each."""
    order = np.lexsort((span, tag, doc, ctx, key))
    key, ctx, doc, tag, span = key[order], ctx[order], doc[order], tag[order], span[order]
    heads, others, settled = _meet(key, ctx, doc, tag, span, np.zeros(len(key), bool), keep_first)
    anchor_heads = np.flatnonzero(~same_before(key[heads]))
    counts = np.diff(np.append(anchor_heads, len(heads)))
    hot = np.repeat(counts >= MANY, counts)
    kind = np.where(hot, HOT, np.where(others & (not keep_first), TWICE, ALONE))
    spread = W.mix(doc.astype("u8") * np.uint64(_FACTOR) + tag.astype("u8") + span.astype("u8"))
    mark = heads[anchor_heads[counts >= MANY]]
    none = np.zeros(len(mark), "i8")
    out_spans = np.flatnonzero(settled)
    return _rows(
        np.concatenate([kind, np.full(len(out_spans), SPAN), np.full(len(mark), MARK)]),
        np.concatenate([np.where(hot, spread[heads], key[heads]), spread[out_spans], key[mark]]),
        np.concatenate([np.where(hot, key[heads], ctx[heads]), ctx[out_spans], none.astype("u8")]),
        np.concatenate([doc[heads], doc[out_spans], none]),
        np.concatenate([tag[heads], tag[out_spans], none]),
        np.concatenate([span[heads], span[out_spans], none]),
    )


def contexts(docs: DataFrame, kind: Kind) -> DataFrame:
    """Rows of all runs of ``doc_id, text, tag``, those of a task met with each other."""

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Unit hashes and row offsets, and of each row its document, tag and place; long rows in parts."""
        units, offsets = kind.units(batch.column("text"))
        units = kind.hashed(units)
        doc, tag = (np.asarray(batch.column(c)) for c in ("doc_id", "tag"))
        lengths = np.diff(offsets)
        if not len(lengths) or lengths.max() <= BLOCK:
            yield units, offsets, doc, tag, np.zeros(len(doc), "i8")
            return
        for i in range(len(lengths)):
            own = units[offsets[i] : offsets[i + 1]]
            for at in range(0, max(1, len(own) - kind.width + 1), BLOCK):
                part = own[at : at + BLOCK + kind.width - 1]
                yield part, np.array([0, len(part)]), doc[i : i + 1], tag[i : i + 1], np.array([at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in blocks(batches, "text", BLOCK):
            for units, offsets, doc, tag, place in pieces(batch):
                row, first, more, key, ctx = runs(units, offsets, kind.width, kind.k)
                held.append((key, ctx, doc[row], tag[row], pack(first + place[row], more)))
            size += batch.nbytes
            if size >= FLUSH:
                yield meet_locally(*map(np.concatenate, zip(*held)), kind.keep_first)
                held, size = [], 0
        if held:
            yield meet_locally(*map(np.concatenate, zip(*held)), kind.keep_first)

    return docs.select("doc_id", "text", "tag").mapInArrow(run, ROW)


def _decide(part: list[np.ndarray], keep_first: bool) -> pa.RecordBatch | None:
    """Of whole anchors: SPAN rows of what is settled, OPEN rows of the different contexts of one anchor.

    Contexts of an anchor with ``MANY`` in all, or that is hot in some task, become HOT.
    """
    kind, key, ctx, doc, tag, span = part
    if not len(kind):
        return None
    mark = kind == MARK
    heads, others, settled = _meet(key, ctx, doc, tag, span, kind == TWICE, keep_first)
    first = np.flatnonzero(~same_before(key[heads]))
    several = np.diff(np.append(first, len(heads)))
    hot = np.repeat((np.add.reduceat(mark[heads], first) > 0) | (several >= MANY), several)
    left = np.repeat(several > 1, several) & ~mark[heads]
    at = heads[left]
    settled = np.flatnonzero(settled & ~mark)
    out = np.concatenate([settled, at])
    kinds = np.concatenate([np.full(len(settled), SPAN), np.where(hot[left], HOT, OPEN)])
    named = np.concatenate([ctx[settled], np.where(hot[left], key[at], ctx[at])])
    return _rows(kinds, key[out], named, doc[out], tag[out], span[out]) if len(out) else None


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut so that none ends within a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column("key"))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if held and (cut or held[-1].column("key")[0].as_py() != keys[0]):
            yield from _together([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield from _together(held)


def _together(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches(max_chunksize=max(1, table.num_rows))


def columns(batch: pa.RecordBatch, keep: np.ndarray | None = None) -> list[np.ndarray]:
    out = [np.asarray(batch.column(c)) for c in ("kind", "key", "ctx", "doc_id", "tag", "span")]
    return out if keep is None else [c[keep] for c in out]


def settle(rows: DataFrame, keep_first: bool) -> DataFrame:
    """Meets the contexts of all tasks: SPAN rows of what is settled, OPEN and HOT rows of what is not.

    Anchors pass by in order; no more than one anchor's rows are held, under ``MANY`` of a task's
    contexts each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            kind = np.asarray(batch.column("kind"))
            past = (kind == SPAN) | (kind == HOT)
            if past.any():
                yield _rows(*columns(batch, past))
            out = _decide(columns(batch, ~past), keep_first)
            if out is not None:
                yield out

    return rows.repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "tag", "span").mapInArrow(run, ROW)


def tagged(docs: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, text, tag, carried``: no nulls in id and text, the text's hash, other columns to keep."""
    carried = docs.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), "doc_id", "text") if carry else docs
    rows = documents(docs) if not carry else documents(carried, "carried")
    return rows.withColumn("tag", F.xxhash64("text"))


def _small(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""
    extra = [c for c in docs.columns if c == "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, "text", BLOCK):
            small = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            names = ["doc_id", "tag", *extra]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(small, pa.binary())], [*names, "small"])

    carried = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return docs.mapInArrow(run, f"doc_id long, tag long, {carried}small binary")


def beside(docs: DataFrame, rows: DataFrame, how: str, *fields: Column) -> DataFrame:
    """``doc_id, tag, small, found``: compressed texts with the rows found in them, each as a struct."""
    found = rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return _small(docs).join(found, ["doc_id", "tag"], how)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(t) for t in batch.column("small").to_pylist()], pa.binary()).cast(pa.string())


class Contexts(NamedTuple):
    """Contexts of whole anchors, in anchor order: ``units[offsets[i] : offsets[i + 1]]`` is one's."""

    key: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    span: np.ndarray
    twice: np.ndarray
    units: np.ndarray
    offsets: np.ndarray


def opened(docs: DataFrame, rows: DataFrame, kind: Kind) -> DataFrame:
    """OPEN rows with the units of their contexts; of HOT ones a row for each window, met within the task."""
    named = rows.where(F.col("kind").isin(OPEN, HOT)).withColumn("key", F.when(F.col("kind") == HOT, F.col("ctx")).otherwise(F.col("key")))
    found = beside(docs.select("doc_id", "text", "tag"), named, "inner", F.col("kind"), F.col("key"), F.col("span"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "small", BLOCK // 4):
            units, offsets = kind.units(texts_of(batch))
            lists = batch.column("found")
            values, ends = lists.values, np.asarray(lists.offsets)
            kinds, key, span = (np.asarray(values.field(n))[ends[0] : ends[-1]] for n in ("kind", "key", "span"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            doc, tag = (np.asarray(batch.column(c))[owner] for c in ("doc_id", "tag"))
            start, more = unpack(span)
            a = offsets[owner] + start
            b = a + more + kind.width
            is_open = np.flatnonzero(kinds == OPEN)
            contents = [units[x:y].tobytes() for x, y in zip(a[is_open].tolist(), b[is_open].tolist())]
            met = _rows(np.full(len(is_open), OPEN), key[is_open], np.zeros(len(is_open), "u8"), doc[is_open], tag[is_open], span[is_open])
            yield _with_units(met, contents)
            hot = np.flatnonzero(kinds == HOT)
            if len(hot):
                hashes = kind.hashed(units)
                count = more[hot] + 1
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(a[hot], count) + nth
                keys, ctx = (W.rolling(hashes, kind.width, f)[at] for f in (_FACTOR, 0xE7037ED1A0B428DB))
                places = pack(np.repeat(start[hot], count) + nth, np.zeros(len(at), "i8"))
                met = meet_locally(keys, ctx, np.repeat(doc[hot], count), np.repeat(tag[hot], count), places, kind.keep_first)
                yield _with_units(met, [None] * met.num_rows)

    return found.mapInArrow(run, ROW + ", units binary")


def _with_units(rows: pa.RecordBatch, units: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(units, pa.binary())], [*rows.schema.names, "units"])


def resolved(rows: DataFrame, kind: Kind, method: Callable[[Contexts], tuple[np.ndarray, ...]]) -> DataFrame:
    """SPAN rows of what ``method`` finds in the contexts of ``opened``, and of the single windows that meet.

    ``method`` returns ``doc, tag, span`` of settled runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches):
            kinds = np.asarray(batch.column("kind"))
            past, is_open = kinds == SPAN, kinds == OPEN
            if past.any():
                yield _rows(*columns(batch, past))
            out = _decide(columns(batch, ~past & ~is_open), kind.keep_first)
            if out is not None:
                yield out
            _, key, ctx, doc, tag, span = columns(batch, is_open)
            raw, offsets = W.raw(batch.column("units").filter(pa.array(is_open)))
            heads = np.flatnonzero(~same_before(key))
            at = 0
            while at < len(heads):  # as many whole anchors as make a chunk
                stop = max(at + 1, int(np.searchsorted(offsets[heads], offsets[heads[at]] + CHUNK)))
                i, j = heads[at], heads[stop] if stop < len(heads) else len(key)
                own = Contexts(key[i:j], doc[i:j], tag[i:j], span[i:j], ctx[i:j], raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs, tags, spans = method(own)
                if len(docs):
                    none = np.zeros(len(docs), "i8")
                    yield _rows(np.full(len(docs), SPAN), none.astype("u8"), none.astype("u8"), docs, tags, spans)
                at = stop

    return rows.repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "tag", "span").mapInArrow(run, ROW)


def spans(spark: SparkSession, docs: DataFrame, kind: Kind, method: Callable) -> DataFrame:
    """``doc_id, tag, span`` of every run of windows to be taken out of the rows of ``tagged``."""
    met = kept(spark, settle(contexts(docs, kind), kind.keep_first))
    more = resolved(opened(docs, met, kind), kind, method)
    both = met.where(F.col("kind") == SPAN).unionByName(more.where(F.col("kind") == SPAN))
    return both.select("doc_id", "tag", "span")


def covered(batch: pa.RecordBatch, offsets: np.ndarray, width: int) -> np.ndarray:
    """Which units the spans in ``found`` cover, for a batch of ``beside``."""
    lists = batch.column("found")
    owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    span = np.asarray(pc.list_flatten(lists).field("span")) if len(owner) else np.zeros(0, "i8")
    start, more = unpack(span)
    edges = np.zeros(offsets[-1] + 1, "i8")
    np.add.at(edges, offsets[owner] + start, 1)
    np.add.at(edges, offsets[owner] + start + more + width, -1)
    return np.cumsum(edges[:-1]) > 0
