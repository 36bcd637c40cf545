"""Exact duplicate substrings of bytes, found by suffix order.

Contexts that share an anchor (see ``passages``) are clipped to what they can share with any
other, equal ones are settled, and the rest are put in suffix order by Lyndon groups: equal
windows then stand beside each other, and all but the first of them are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import passages as P
from balancier.llm import words as W
from balancier.llm.common import blocks, null_ids
from balancier.llm.suffixes import suffix_order

WIDTH = 100
#: Bytes of an anchor.
GRAM = 24


def _hashed(data: np.ndarray) -> np.ndarray:
    return W.BYTE[data]


def bytes_kind(width: int = WIDTH, k: int = GRAM) -> P.Kind:
    return P.Kind(width, k, True, W.raw, _hashed)


def _common(parts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row of ``parts`` the longest start that it shares with another row of its group; 0 ends a row."""
    width = parts.shape[1]
    order = np.lexsort((np.ascontiguousarray(parts).view(f"S{width}").ravel(), group))
    rows, groups = parts[order], group[order]
    equal = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
    shared = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
    shared[groups[1:] != groups[:-1]] = 0
    out = np.zeros(len(parts), "i8")
    out[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
    return out


def duplicates(own: P.Contexts, kind: P.Kind) -> tuple[np.ndarray, np.ndarray]:
    """``doc, tag, span`` of the windows that also start earlier in these contexts."""
    width, units = kind.width, own.units
    start, more = P.unpack(own.span)
    tag = own.tag
    a, b = own.offsets[:-1], own.offsets[1:]
    group = np.cumsum(~P.same_before(own.key)) - 1
    # The anchor is where its hash first stands.
    grams = W.rolling(kind.hashed(units), kind.k)
    owner = np.repeat(np.arange(len(a)), b - a)[: len(grams)]
    hits = np.flatnonzero(grams == own.key.view("u8")[owner])
    anchor = hits[np.searchsorted(hits, a)]
    # Zero bytes end the rows below; those of the texts are compared as the value after them.
    marks = np.minimum(units, 254) + np.uint8(1)
    to_right, to_left = (np.zeros((len(a), width), "u1") for _ in range(2))
    for j in range(width):
        at = anchor + j
        to_right[:, j] = np.where(at < b, marks[np.minimum(at, len(units) - 1)], 0)
        at = anchor - 1 - j
        to_left[:, j] = np.where(at >= a, marks[np.maximum(at, 0)], 0)
    right, left = _common(to_right, group), _common(to_left, group)
    # Windows by how far before the anchor they start.
    far, near = np.minimum(left, anchor - a), np.maximum(width - right, anchor - a - more)
    first, count = anchor - far, far - near + 1
    live = np.flatnonzero(count > 0)
    place = start + first - a  # of the first window left, in its text
    # Equal contents of one anchor: the earliest stands for all.
    order = live[np.lexsort((place[live], tag[live], own.doc[live]))]
    stands: dict[tuple[int, int, bytes], int] = {}
    settled, by_group = [], {}
    for i in order.tolist():
        content = (int(group[i]), int(far[i]), units[first[i] : first[i] + count[i] + width - 1].tobytes())
        if stands.setdefault(content, i) != i:
            settled.append(i)
        else:
            by_group.setdefault(content[0], []).append(i)
    settled = np.array(settled, "i8")
    out_doc, out_tag, out_span = [own.doc[settled]], [tag[settled]], [P.pack(place[settled], count[settled] - 1)]
    rest = [i for g in by_group.values() if len(g) > 1 for i in g]
    if rest:
        rest = np.array(rest)
        pieces = [units[first[i] : first[i] + count[i] + width - 1] for i in rest]
        lengths = np.array([len(p) for p in pieces]) + 1
        heads = np.cumsum(lengths) - lengths
        symbols = np.ones(lengths.sum() + 1, "i8")  # 1 ends a piece, 0 ends all, bytes are above
        symbols[-1] = 0
        for h, p in zip(heads, pieces):
            symbols[h : h + len(p)] = p.astype("i8") + 2
        piece = np.repeat(np.arange(len(rest)), lengths)
        nth = np.arange(len(piece)) - heads[piece]
        window = np.append(nth < count[rest][piece], False)
        order = np.array(suffix_order(symbols.tolist()))
        order = order[window[order]]
        same = np.ones(len(order) - 1, bool)
        for j in range(width):
            same &= symbols[order[1:] + j] == symbols[order[:-1] + j]
        cls = np.append(0, np.cumsum(~same))
        at = piece[order]
        doc, where, tags = own.doc[rest[at]], place[rest[at]] + nth[order], tag[rest[at]]
        by = np.lexsort((where, tags, doc, cls))
        late = by[P.same_before(cls[by]) & ~P.same_before(cls[by], doc[by], tags[by], where[by])]
        # Windows that follow each other in a piece become one run.
        gone = np.sort(order[late])
        head = np.flatnonzero(np.append(True, (np.diff(gone) != 1) | (np.diff(piece[gone]) != 0))) if len(gone) else gone
        size = np.diff(np.append(head, len(gone)))
        i = rest[piece[gone[head]]]
        out_doc.append(own.doc[i])
        out_tag.append(tag[i])
        out_span.append(P.pack(place[i] + nth[gone[head]], size - 1))
    return np.concatenate(out_doc), np.concatenate(out_tag), np.concatenate(out_span)


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, k: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: texts (as bytes) without repeated substrings.

    Every byte goes that a string of ``width`` bytes covers which also starts earlier: in a
    document of smaller id, or before it in the same. Rows equal in id and text are one document,
    whose row is repeated; rows of one id with other texts are ordered by their hash.
    Null texts are empty. Cut characters are left as they are cut.
    """
    kind = bytes_kind(width, k)
    docs = P.tagged(docs)
    gone = P.spans(spark, docs, kind, lambda own: duplicates(own, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "small", P.BLOCK // 4):
            data, offsets = W.raw(P.texts_of(batch))
            out = P.covered(batch, offsets, width)
            opens = out.copy()
            opens[1:] &= ~out[:-1]
            heads = np.minimum(offsets[:-1], len(out))
            inner = offsets[:-1][offsets[:-1] < len(out)]
            opens[inner] = out[inner]
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
            left = [data[a:b][~out[a:b]].tobytes() for a, b in zip(heads, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x.astype("i8")) for x in (np.diff(offsets), total(out), total(opens))], pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    found = P.beside(docs, gone, "left", F.col("span"))
    return null_ids(found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"), "doc_id")
