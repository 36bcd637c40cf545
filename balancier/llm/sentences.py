"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A piece of the vocabulary holds a blank only at its start (blanks may repeat there), so a
normalised text falls into words at its runs of blanks, and no merge crosses a word. All words
of a block that were not met before are merged together: one flat array of symbols, the least
pair rank of every word by a segmented minimum, the leftmost pairs of that rank merged at once,
the array compacted, until no pair is left.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancier.llm.common import blocks, documents, null_ids, once_per_worker
from balancier.llm.known import SIGN, STOP, Known, gather, parted

#: Bytes of text taken at once.
BLOCK = 2 * 1024 * 1024
#: Ids decoded at once, and words merged at once.
AT_ONCE, TOGETHER = 1_000_000, 20_000
#: Words of more characters take their merges from a heap.
LONG = 2000
BLANK = "▁"
SHIFT = 21  # a symbol is a piece's id, or the vocabulary's size and a code point: under 2 ** 21
NONE = np.int64(1 << 40)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("balancier-each-byte", _each_byte)


class Merges:
    """The vocabulary of a BPE model with byte fallback, as tables of pairs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.unknown = model.unk_id()
        odd = {i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece of this model joins two words")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("this model has no byte fallback")
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k]), self.symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = (rank[model.get_score(i)], i)
        self.keys = np.array(sorted(pairs), "i8")
        self.rank, self.merged = (np.array([pairs[k][j] for k in self.keys], "i8") for j in (0, 1))
        # Pieces of equal rank may be merged at once in a word if what arises can only enter worse pairs.
        best = np.full(self.size, NONE)
        for side in (self.keys >> SHIFT, self.keys & (1 << SHIFT) - 1):
            own = side < self.size
            np.minimum.at(best, side[own], self.rank[own])
        self.alone = best[self.merged] > self.rank
        self.controls = {i for i in range(self.size) if model.is_control(i)}
        texts = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for value, i in self.bytes.items():
            texts[i] = bytes([value])
        texts[self.unknown] = model.decode([self.unknown]).encode()
        self.texts = texts

    def symbol(self, text: str) -> int | None:
        known = self.ids.get(text)
        return known if known is not None or len(text) > 1 else self.size + ord(text)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of every word after its last merge."""
        done: list = [self.merge_long(w) if len(w) > LONG else None for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for at in range(0, len(short), TOGETHER):
            own = short[at : at + TOGETHER]
            for i, symbols in zip(own, self.merge_rounds([words[i] for i in own])):
                done[i] = symbols
        return done

    def merge_long(self, word: str) -> np.ndarray:
        """The same merges one by one from a heap: rounds over one very long word would each read all of it."""
        symbols = [self.symbol(c) for c in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                key = symbols[i] << SHIFT | symbols[j]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(heap, (int(self.rank[at]), i, j, key, int(self.merged[at])))

        for i in range(len(word) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, key, merged = heapq.heappop(heap)
            if symbols[i] is None or after[i] != j or symbols[i] << SHIFT | symbols[j] != key:
                continue
            symbols[i], symbols[j] = merged, None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([s for s in symbols if s is not None], "i8")

    def merge_rounds(self, words: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words], "i8")
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("i8")
        kinds, which = np.unique(chars, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in kinds], "i8")[which]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list = [None] * len(words)
        while len(symbols):
            key = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, self.rank[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < NONE, counts)
            for i in np.flatnonzero(least == NONE):
                done[owner[starts[i]]] = symbols[starts[i] : starts[i] + counts[i]]
            found = np.flatnonzero((rank == np.repeat(least, counts)) & live)
            if not len(found):
                break
            # Of pairs that overlap every second one; of a pair that may not go with others the first.
            first = np.append(True, owner[found[1:]] != owner[found[:-1]])
            runs = np.append(True, (np.diff(found) != 1) | first[1:])
            nth = np.arange(len(found)) - np.maximum.accumulate(np.where(runs, np.arange(len(found)), 0))
            heads = np.flatnonzero(first)
            together = np.logical_and.reduceat(self.alone[at[found]], heads)
            sizes = np.diff(np.append(heads, len(found)))
            take = found[np.where(np.repeat(together, sizes), nth % 2 == 0, first)]
            symbols[take] = self.merged[at[take]]
            keep = live
            keep[take + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def ids_of(self, symbols: np.ndarray) -> list[int]:
        """Ids of merged symbols; a character without a piece becomes its bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            if s < self.size:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(s - self.size).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: blanks become spaces, the blank put before the first word goes."""
        runs: list[list[bytes]] = [[]]
        for i in ids:
            if i in self.controls:  # writes nothing, but parts the bytes beside it
                runs.append([])
            else:
                runs[-1].append(self.texts[i])
        text = "".join([b"".join(r).decode("utf-8", "balancier-each-byte") for r in runs])
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if first is not None and self.pieces[first].startswith(BLANK) else text


class Coder:
    """Encodes and decodes blocks of texts; a word is merged once for as long as it is remembered."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        if any("\n" in p for p in self.merges.ids):
            raise ValueError("a piece of this model joins two lines")
        # Words are parted from the marks after them if no piece holds a letter and then a mark.
        self.stop = None if any(re.search(STOP, p) for p in self.merges.ids) else STOP
        self.known = Known(self.learn)
        texts = [np.frombuffer(t, "u1") for t in self.merges.texts]
        self.size = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.concatenate(texts)
        self.control = np.isin(np.arange(len(texts)), list(self.merges.controls))
        self.blank = np.array([p.startswith(BLANK) for p in self.merges.pieces])

    def learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts: after a blank, of a line's first part with its newline, or of marks after a word."""
        words = [p if p.startswith("\n") else p[1:] if p.startswith(SIGN) else BLANK + p for p in parts]
        ids = [self.merges.ids_of(s) for s in self.merges.merge(words)]
        return np.array([i for own in ids for i in own], "i4"), np.array([len(own) for own in ids], "i8")

    def whole(self, text: str) -> list[int]:
        words = WORDS.findall((BLANK + text).replace(" ", BLANK))
        return [i for symbols in self.merges.merge(words) for i in self.merges.ids_of(symbols)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the texts' offsets in them."""
        parts, which, offsets = parted(texts, self.stop)
        start, size = self.known.find(parts)
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        # An empty part is a blank by itself before a newline or at the end, else the start of a run of blanks.
        plain = ~np.asarray(pc.starts_with(parts, "\n"))
        bare = np.asarray(pc.equal(parts, ""))[which]
        followed = np.append(plain[which[1:]], False)
        followed[offsets[1:] - 1] = False
        odd_rows = np.asarray(pc.match_substring_regex(texts, f"{BLANK}|{SIGN}")) | np.logical_or.reduceat(bare & followed, offsets[:-1])
        sizes = size[which]
        sizes[offsets[:-1][empty]] = 0
        ids, ends = gather(self.known.data, start[which], sizes)
        out = np.append(0, ends[offsets[1:] - 1])
        if odd_rows.any():
            rows = [ids[a:b] for a, b in zip(out[:-1], out[1:])]
            for i in np.flatnonzero(odd_rows).tolist():
                rows[i] = np.array(self.whole(texts[i].as_py()), "i4")
            ids, out = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
        return ids, out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids."""
        text, ends = gather(self.data, self.start[ids], self.size[ids])
        data, ends = text.tobytes(), np.append(0, ends)
        has_control = np.append(0, np.cumsum(self.control[ids]))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            try:
                if has_control[a] != has_control[b]:
                    raise UnicodeError
                own = data[ends[a] : ends[b]].decode()
                out.append(own[1:] if b > a and self.blank[ids[a]] else own)
            except UnicodeError:
                out.append(self.merges.decode(ids[a:b].tolist()))
        return out


WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def coder(path: str) -> Coder:
    return once_per_worker(f"coder {path}", lambda: Coder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: without begin and end ids. Null and empty texts have no ids; rows that repeat stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in blocks(batches, "text", BLOCK):
            ids, offsets = code.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return null_ids(documents(docs).mapInArrow(run, "doc_id long, ids array<int>"), "doc_id")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` from the ids alone; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column("ids")), 0)).astype("i8")
            ends, at = np.cumsum(counts), 0
            while at < len(counts):  # so many rows as hold AT_ONCE ids
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + AT_ONCE)))
                part = batch.slice(at, stop - at)
                offsets = np.append(0, np.cumsum(counts[at:stop]))
                texts = code.decode(np.asarray(part.column("ids").flatten()).astype("i4"), offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                at = stop

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``decode``."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
