"""What a worker knows of the parts of texts: their ids, by hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from balancier.llm import words as W

#: A sign that is put, with a space, before marks that follow a word.
SIGN = "\x01"
STOP = "([a-zà-öø-ÿ])([,.;:!?])"
#: Parts that are remembered; beyond that a worker starts anew.
REMEMBERED = 1_500_000


def parted(texts: pa.Array, stop: str | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at spaces, before newlines, and by ``stop`` (a letter, then a mark).

    Returns the different parts, the number of each part of the texts, and the texts' offsets in
    these. A newline stays at the start of its part, and a mark gets ``SIGN`` before it: no space
    stood there. All other parts but a text's first follow a space.
    """
    out = pc.replace_substring(texts, "\n", " \n")
    if stop:
        out = pc.replace_substring_regex(out, stop, rf"\1 {SIGN}\2")
    lists = pc.split_pattern(out, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets).astype("i8")
    return coded.dictionary, np.asarray(coded.indices).astype("i8"), offsets - offsets[0]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``data`` put together, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(start - ends + size, size)], ends


class Known:
    """Ids of parts, found by the parts' hashes; -1 of them for parts that cannot stand alone."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        """``learn`` gives the ids of parts, put together, and how many each has."""
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, "u8"), np.zeros(0, "i4"), np.zeros(0, "i4")
        self.data = np.zeros(0, "i4")

    def find(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``data`` and number of the ids of parts that are all different."""
        if len(self.hash) > REMEMBERED:
            self.forget()
        wanted = W.strings(parts)
        at = np.minimum(np.searchsorted(self.hash, wanted), max(0, len(self.hash) - 1))
        missing = np.flatnonzero(self.hash[at] != wanted) if len(self.hash) else np.arange(len(wanted))
        if len(missing):
            ids, count = self.learn(parts.take(pa.array(missing)).to_pylist())
            stored = np.maximum(count, 0)
            start = len(self.data) + np.cumsum(stored) - stored
            self.data = np.concatenate([self.data, ids.astype("i4", copy=False)])
            hashes = np.concatenate([self.hash, wanted[missing]])
            order = np.argsort(hashes, kind="stable")
            self.hash = hashes[order]
            self.start = np.concatenate([self.start, start.astype("i4")])[order]
            self.size = np.concatenate([self.size, count.astype("i4")])[order]
            at = np.searchsorted(self.hash, wanted)
        return self.start[at].astype("i8"), self.size[at].astype("i8")
