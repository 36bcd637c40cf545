"""Byte-level BPE ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from balancier.llm.common import once_per_worker
from balancier.llm.known import SIGN, STOP, Known, gather, parted

#: Characters given to the library at once.
AT_ONCE = 65_536
#: The byte-level pattern never carries a token from a letter or digit across a space.
CUT = re.compile(r"(?<=[a-zA-Z0-9À-ÖØ-öø-ÿ])(?= )")


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes a part of a text once for as long as it is remembered: texts repeat most of their words.

    A space or newline with other characters on both sides always starts a token, and that token
    alone of its part starts with it. So parts can be encoded together, as one text, and told
    apart again; and the ids of the parts, put together, are the ids of the whole. Texts where
    white space meets white space, or ends them, are encoded as they are.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.opens = {mark: np.array([n.startswith(name) for n in names]) for mark, name in ((" ", "Ġ"), ("\n", "Ċ"))}
        self.known = Known(self.learn)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "i4")

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by itself, in pieces if it is long."""
        out, held, size = [], [], 0
        for piece in CUT.split(text) if len(text) > AT_ONCE else [text]:
            if size and size + len(piece) > AT_ONCE:
                out.append(self.ids("".join(held)))
                held, size = [], 0
            held.append(piece)
            size += len(piece)
        return np.concatenate([*out, self.ids("".join(held))])

    def together(self, parts: list[str], mark: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of parts that each start with ``mark``, and their numbers, encoded many at a time."""
        at, all_ids, all_sizes = 0, [], []
        while at < len(parts):
            stop, length = at, 0
            while stop < len(parts) and (stop == at or length + len(parts[stop]) <= AT_ONCE):
                length += len(parts[stop]) + 1
                stop += 1
            ids = self.ids(mark + mark.join(parts[at:stop]))
            sizes = np.diff(np.append(np.flatnonzero(self.opens[mark][ids]), len(ids)))
            if len(sizes) != stop - at:
                raise ValueError("a part has not one token that starts with its mark")
            all_ids.append(ids)
            all_sizes.append(sizes)
            at = stop
        return all_ids, all_sizes

    def learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts after a space, of a line's first part with its newline, or of marks after a word.

        Parts that other white space begins or ends cannot stand alone.
        """
        kinds: dict[str, tuple[list[int], list[str]]] = {k: ([], []) for k in (" ", "\n", SIGN, "odd")}
        for i, p in enumerate(parts):
            kind = p[0] if p[:1] in ("\n", SIGN) else " "
            bare = p if kind == " " else p[1:]
            if not bare or bare[0].isspace() or bare[-1].isspace():
                kind = "odd"
            kinds[kind][0].append(i)
            kinds[kind][1].append(bare)
        ids, sizes = [], []
        for mark in (" ", "\n"):
            more = self.together(kinds[mark][1], mark)
            ids += more[0]
            sizes += more[1]
        marks = [self.ids(p) for p in kinds[SIGN][1]]
        data = np.concatenate([np.zeros(0, "i4"), *ids, *marks])
        sizes = np.concatenate([np.zeros(0, "i8"), *sizes, np.array([len(x) for x in marks], "i8"), np.full(len(kinds["odd"][0]), -1)])
        # Back in the order that was asked for.
        order = np.argsort(np.array([i for k in (" ", "\n", SIGN, "odd") for i in kinds[k][0]]))
        stored = np.maximum(sizes, 0)
        start = np.cumsum(stored) - stored
        return gather(data, start[order], stored[order])[0], sizes[order]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, as unsigned 32-bit numbers; and the texts' offsets in them."""
        parts, which, offsets = parted(texts, STOP)
        start, size = self.known.find(parts)
        odd = size < 0
        odd_rows = np.asarray(pc.match_substring(texts, SIGN))
        if odd.any():
            inner = odd[which]
            inner[offsets[:-1]] = False  # a text's first part follows no space
            odd_rows = odd_rows | np.logical_or.reduceat(inner, offsets[:-1])
        heads = parts.take(pa.array(which[offsets[:-1]])).to_pylist()
        first = {h: self.whole(h) if h else np.zeros(0, "i4") for h in set(heads)}
        alone = [first[h] for h in heads]
        data = np.concatenate([self.known.data, *alone, np.array([end], "i4")])
        own = np.array([len(x) for x in alone])
        start = np.concatenate([start, len(self.known.data) + np.cumsum(own) - own, [len(data) - 1]])
        size = np.concatenate([np.maximum(size, 0), own, [1]])
        which[offsets[:-1]] = len(parts) + np.arange(len(heads))
        order = np.insert(which, offsets[1:], len(start) - 1)
        ids, ends = gather(data, start[order], size[order])
        out = np.append(0, ends[offsets[1:] + np.arange(len(heads))])
        if odd_rows.any():
            rows = [ids[a:b] for a, b in zip(out[:-1], out[1:])]
            for i in np.flatnonzero(odd_rows).tolist():
                rows[i] = np.append(self.whole(texts[i].as_py()), np.int32(end))
            ids, out = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
        return ids.view("<u4"), out


def encoder(path: str) -> Encoder:
    """One for each worker process, so that its tasks share what it remembers."""
    return once_per_worker(f"encoder {path}", lambda: Encoder(path))
