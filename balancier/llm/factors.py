"""Duplicate passages of words by relative Lempel-Ziv parsing.

Contexts that share an anchor (see ``passages``) make the reference blocks, each with an index
of its suffixes. A context is factored greedily against its block: the longest stretch that also
stands elsewhere in it is looked up at the factor's start, then at its end, and so on. Factors of
``WIDTH`` words or more are duplicates; at factor boundaries the windows that end within the next
factor are looked up too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import passages as P
from balancier.llm import words as W
from balancier.llm.common import blocks, null_ids

WIDTH = 35
#: Words of an anchor.
GRAM = 5


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = W.split(texts)
    return words.hash, words.first


def _same(units: np.ndarray) -> np.ndarray:
    return units


def words_kind(width: int = WIDTH, k: int = GRAM) -> P.Kind:
    return P.Kind(width, k, False, _words, _same)


class Index(NamedTuple):
    """A block's suffixes in order, and the ranks of its pieces of 1, 2, 4 ... symbols."""

    ranks: list[np.ndarray]
    order: np.ndarray
    place: np.ndarray


def indexed(symbols: np.ndarray, most: int) -> Index:
    """Index of a block in which every stretch that stands twice is shorter than ``most``."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype("i8")
    ranks, length = [rank], 1
    while length < most and rank.max(initial=0) < n - 1:
        after = np.append(rank[length:], np.full(min(length, n), -1))
        rank = np.unique((rank + 1) * (n + 2) + after + 1, return_inverse=True)[1].astype("i8")
        ranks.append(rank)
        length *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, "i8")
    place[order] = np.arange(n)
    return Index(ranks, order, place)


def lookup(index: Index, at: np.ndarray) -> np.ndarray:
    """How long the longest stretch from each of these places is that also starts at another place.

    It stands beside the place in suffix order.
    """
    n = len(index.order)
    longest = np.zeros(len(at), "i8")
    for step in (-1, 1):
        beside = index.place[at] + step
        there = (beside >= 0) & (beside < n)
        left, right = at.copy(), index.order[np.clip(beside, 0, n - 1)]
        shared = np.zeros(len(at), "i8")
        for level in range(len(index.ranks) - 1, -1, -1):
            rank = index.ranks[level]
            ok = there & (left < n) & (right < n)
            same = ok & (rank[np.minimum(left, n - 1)] == rank[np.minimum(right, n - 1)])
            gain = same * (1 << level)
            shared, left, right = shared + gain, left + gain, right + gain
        longest = np.maximum(longest, shared)
    return longest


def parse(index: Index, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``piece, start, size, found`` of the greedy factors of all pieces, in order.

    A factor is the longest stretch from its start that also stands elsewhere in the block, or one
    symbol that does not (``found`` is false). All pieces go on by one factor a round.
    """
    at, piece = heads.astype("i8"), np.arange(len(heads))
    rounds = []
    while True:
        going = at < ends[piece]
        at, piece = at[going], piece[going]
        if not len(at):
            break
        longest = lookup(index, at)
        size = np.maximum(longest, 1)
        rounds.append((piece, at, size, longest > 0))
        at = at + size
    if not rounds:
        none = np.zeros(0, "i8")
        return none, none, none, none.astype(bool)
    piece, start, size, found = map(np.concatenate, zip(*rounds))
    order = np.argsort(start, kind="stable")
    return piece[order], start[order], size[order], found[order]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` ..., ``count`` numbers of each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def repeated(index: Index, heads: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that also stand elsewhere in the block, ascending, from the factors.

    Windows inside a factor do. A window that begins after a factor's start and ends past its end
    can only if it ends within the next factor: what follows the boundary in it stands elsewhere
    too, so the factor that starts there is at least as long. Such windows are looked up.
    """
    piece, start, size, found = parse(index, heads, ends)
    long = found & (size >= width)
    inside = _ranges(start[long], size[long] - width + 1)
    end = start + size
    next_end = np.where(np.append(piece[1:] == piece[:-1], False), np.append(end[1:], 0), 0)[: len(end)]
    first = np.maximum(start + 1, end - width + 1)
    last = np.minimum(end - 1, next_end - width)
    across = _ranges(first, np.maximum(last - first + 1, 0))
    return np.unique(np.concatenate([inside, across[lookup(index, across) >= width]]))


def duplicates(own: P.Contexts, kind: P.Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, tag, span`` of the runs of windows that also stand elsewhere in these contexts."""
    units = own.units.view("u8")
    offsets = own.offsets // 8
    lengths = np.diff(offsets)
    # Each piece ends with a symbol of its own, so no match goes past a piece.
    kinds = np.unique(units, return_inverse=True)[1].astype("i8")
    heads = offsets[:-1] + np.arange(len(lengths))
    symbols = np.empty(len(units) + len(lengths), "i8")
    piece_end = np.zeros(len(symbols), bool)
    piece_end[heads + lengths] = True
    symbols[~piece_end] = kinds
    symbols[piece_end] = len(units) + np.arange(len(lengths))
    gone = repeated(indexed(symbols, int(lengths.max(initial=0)) + 1), heads, heads + lengths, kind.width)
    new = np.flatnonzero(np.append(True, np.diff(gone) != 1)) if len(gone) else np.zeros(0, "i8")
    more = np.diff(np.append(new, len(gone))) - 1
    at = np.searchsorted(heads, gone[new], side="right") - 1
    start, _ = P.unpack(own.span[at])
    return own.doc[at], own.tag[at], P.pack(start + gone[new] - heads[at], more)


def dedup(spark: SparkSession, docs: DataFrame, *carry: str, width: int = WIDTH, k: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` and the columns ``carry``: texts without the passages that stand anywhere else.

    Every word goes that a window of ``width`` words covers whose words also start somewhere
    else, in the same document or another; the rest is joined by single spaces. Rows equal in id
    and text are one document, whose row is repeated. Null and empty texts keep nothing.
    """
    kind = words_kind(width, k)
    docs = P.tagged(docs, *carry)
    extra = ["carried"] if carry else []
    gone = P.spans(spark, docs, kind, lambda own: duplicates(own, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "small", P.BLOCK // 4):
            words = W.split(P.texts_of(batch))
            out = P.covered(batch, words.first, width)
            counts = np.diff(np.append(0, np.cumsum(~out))[words.first])
            start, size = words.start[~out], (words.end - words.start)[~out]
            ends = np.cumsum(size + 1)
            heads = ends - size - 1
            joined = np.full(ends[-1] if len(ends) else 0, ord(" "), "u1")
            inside = np.ones(len(joined), bool)
            inside[ends - 1] = False
            joined[inside] = words.data[np.arange(len(joined))[inside] + np.repeat(start - heads, size)]
            last = np.cumsum(counts)
            first = last - counts
            text = joined.tobytes()
            left = [text[heads[a] : ends[b - 1] - 1] if b > a else b"" for a, b in zip(first, last)]
            total = np.diff(words.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in extra], pa.array(total.astype("i8")), pa.array((total - counts).astype("i8")),
                 pa.array(left, pa.binary()).cast(pa.string())],
                ["doc_id", *extra, "n_words", "n_removed", "kept"],
            )

    found = P.beside(docs, gone, "left", F.col("span"))
    carried = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in extra)
    out = found.mapInArrow(run, f"doc_id long, {carried}n_words long, n_removed long, kept string")
    return null_ids(out, "doc_id").select("doc_id", *[f"carried.{c}" for c in carry], "n_words", "n_removed", "kept")
