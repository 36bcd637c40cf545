"""Token files, packing, SentencePiece and archives against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from balancier.llm import packing, sentences, token_files, warc

from .cases import ODD, documents, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = ODD + prose(1, 40) + [(10**6, "long " * 30_000)]


def plain_ids(text):
    return np.array(Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_token_files_give_back_every_id(spark, tmp_path):
    token_files.write(token_files.encode(documents(spark, ROWS), BPE, 0), f"{tmp_path}/t")
    rows = token_files.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(d or 0 for d, _ in ROWS)
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(d for d, _ in ROWS if d is not None)
    want = {}
    for d, t in ROWS:
        want.setdefault(d, []).append(plain_ids(t).tolist())
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.token_ids)
        want[r.doc_id].remove(r.token_ids)
        at += r.n_tokens
    found = token_files.digests(token_files.read(spark, f"{tmp_path}/t")).where("doc_id = 4").collect()
    assert found[0].ids_crc32 == zlib.crc32(plain_ids(ODD[3][1]).tobytes())


def test_token_files_prune_by_id(spark, tmp_path):
    token_files.write(token_files.encode(documents(spark, ROWS), BPE, 0), f"{tmp_path}/t")
    some = token_files.read(spark, f"{tmp_path}/t", 3, 8)
    assert re.search(r"PushedFilters: \[[^\]]*doc_id", some._jdf.queryExecution().toString())
    everything = {r.doc_id: r.start for r in token_files.read(spark, f"{tmp_path}/t").collect()}
    assert {r.doc_id: r.start for r in some.collect()} == {k: everything[k] for k in (3, 8)}
    from pyarrow import orc

    stripe = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".orc")
    assert orc.ORCFile(str(stripe)).row_index_stride == token_files.STRIDE


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(token_files.encode(documents(spark, []), BPE, 0), f"{tmp_path}/t")
    assert token_files.digests(token_files.read(spark, f"{tmp_path}/t")).collect() == []


def check_sequences(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_places_every_id(spark, capacity):
    rows = packing.pack(spark, packing.pieces(documents(spark, ROWS), BPE, 0, capacity), capacity).collect()
    check_sequences(rows, capacity)
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for d, t in ROWS:
        ids = plain_ids(t)
        starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((d or 0, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert got == sorted(want)


def test_packing_nothing(spark):
    assert packing.pack(spark, packing.pieces(documents(spark, []), BPE, 0)).collect() == []


def least_sequences(sizes, capacity):
    """By trying everything."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    rng = random.Random(5)
    for _ in range(300):
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        left = dict(counts)
        fixed = packing.reduce(left, 12)
        rest = [s for s, n in sorted(left.items(), reverse=True) for _ in range(n)]
        assert sum(p.count for p in fixed) + least_sequences(rest, 12) == least_sequences(sizes, 12)
        plan = packing.plan(counts, 12)
        held = {}
        for items, n in plan:
            assert n > 0 and sum(s * k for s, k in items) <= 12
            for s, k in items:
                held[s] = held.get(s, 0) + k * n
        assert held == counts


def test_reduction_of_all_small_histograms():
    for sizes in combinations_with_replacement(range(1, 6), 6):
        left = {s: sizes.count(s) for s in sizes}
        fixed = packing.reduce(left, 6)
        rest = [s for s, n in sorted(left.items(), reverse=True) for _ in range(n)]
        assert sum(p.count for p in fixed) + least_sequences(rest, 6) == least_sequences(sorted(sizes)[::-1], 6)


def test_sentencepiece_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    kinds = ["a b  c\n", "the tion ing ed ", "àéèü漢字🎉́‍﻿\x07 ", "aaab  ", "▁ x▁", "!?.,--==__ 0123"]
    rows = ROWS + [(10**7 + i, "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 80)))) for i in range(500)]
    rows += [(10**8, "ab" * 3000), (10**8 + 1, "".join(rng.choice("abcdetn") for _ in range(6000)) + " x")]
    got = sentences.decode(sentences.encode(documents(spark, rows), PIECES), PIECES)
    want = [(d or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows]
    assert sorted((r.doc_id or 0, r.ids, r.text) for r in got.collect()) == sorted(want)
    digest = sentences.digests(got).where("doc_id = 4").collect()[0]
    ids = library.encode(ODD[3][1])
    assert digest.n_tokens == len(ids)
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentences.encode(documents(spark, []), PIECES).collect() == []


def test_decoding_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    merges, rng = sentences.coder(PIECES).merges, random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 259, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert merges.decode(ids) == library.decode(ids)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' AS payload_digest", "'clash' AS n", "'clash' AS kept")


def test_archives_give_back_every_page(spark, tmp_path):
    rng = random.Random(4)
    odd = ["\r\n\r\n", "WARC/1.1\r\n", "\r", "\n", "\r\r\n\r\n", "é漢", "x" * 40, "Content-Length: 5\r\n\r\n"]
    body = "<p>" + "same " * 300
    rows = [(i, f"http://h/{i}", "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, f"http://copy/{i % 3}", body) for i in range(20)]
    rows += [(1019, "http://copy/1", body), (2000, None, None), (2001, "http://a\r\nb", ""), (None, None, body), (None, "u", None)]
    rows += [(3000, "s", "short"), (3001, "s", "short"), (4000, "r", "again"), (4000, "r", "again")]
    rows += [(5000, "big", "z" * 3_000_000)]
    warc.write(warc.records(pages(spark, rows)), f"{tmp_path}/w")
    got = warc.captures(warc.read(spark, f"{tmp_path}/w"))
    found = sorted(
        (r.page_id or 0, r.response.payload_bytes, r.response.payload_digest, r.response.type, r.revisit_of or 0, r.response.payload or "")
        for r in got.collect()
    )
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max((p or 0) for p, _, h in rows if h == html) if len(data) >= 1000 else page
        again = (page or 0) < (last or 0)
        want.append((page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                     last if again else 0, "" if again else html or ""))
    assert found == sorted(want)
    ids = {r.response.record_id for r in got.collect()}
    assert {r.response.refers_to for r in got.collect() if r.response.type == "revisit"} <= ids
    assert {r.url for r in got.where("page_id = 2001").collect()} == {"http://a%0D%0Ab"}


def test_archives_of_nothing(spark, tmp_path):
    warc.write(warc.records(pages(spark, [])), f"{tmp_path}/w")
    assert warc.captures(warc.read(spark, f"{tmp_path}/w")).collect() == []
