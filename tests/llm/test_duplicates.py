"""Fingerprints, joins, substrings, passages and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from balancier.llm import components, factors, fingerprints, jaccard, passages, substrings, suffixes, vectors

from .cases import ODD, documents, prose

ROWS = ODD + prose(1, 150) + [(10**6, "long text " * 4000), (10**6 + 1, "long text " * 4000 + "end")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    words = word_list(lowered(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def linked(rows):
    """Smallest reachable id of every id."""
    sets = [(d, shingles(t)) for d, t in rows]
    union = Union({d for d, _ in rows})
    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                union.join(a, b)
    return {d: union.find(d) for d, _ in rows}


def with_ids(rows):
    return [(-(2**63) if d is None else d, t or "") for d, t in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join(spark, seed):
    rows = ROWS + prose(seed + 10, 120, words=12)
    rows = list({d: (d, t) for d, t in rows}.values()) + [(7, "same text twice over here")]
    want = linked(with_ids(rows))
    got = jaccard.join(spark, documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {(d, len(shingles(t))) for d, t in with_ids(rows)}
    for r in got:
        own, part = (-(2**63) if x is None else x for x in (r.doc_id, r.component_id))
        assert want[own] == part and (own, r.n_shingles) in sizes


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    """A group compared in several blocks."""
    monkeypatch.setattr(jaccard, "SIDE", 7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in range(i % 4):
            own[(13 * i + 29 * k) % 80] = f"x{i}_{k}"
        rows.append((i * 3, " ".join(own)))
    want = linked(rows)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark, documents(spark, rows)).collect()}
    assert got == want


def test_pairs_at_the_threshold_meet():
    """Every pair of small sets that links shares a key."""
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        both = rng.integers(0, 2**64, n, "u8")
        more = n // 3
        cut = int(rng.integers(0, more + 1))
        extra = rng.integers(0, 2**64, more, "u8")
        a, b = np.union1d(both, extra[:cut]), np.union1d(both, extra[cut:])
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard.keys(a), jaccard.keys(b)))
            width = min(len(jaccard.sketch(a)), len(jaccard.sketch(b)))
            apart = jaccard._hamming(jaccard._folded(jaccard.sketch(a), width), jaccard._folded(jaccard.sketch(b), width))
            assert apart <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) // 7


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (3, 3)] + [(100, i) for i in range(101, 160)]
    got = dict(components.components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, **dict.fromkeys((5, 6, 7, 8, 9), 5), 20: 20, 21: 20, **dict.fromkeys(range(100, 160), 100)}
    assert got == want
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints(spark):
    rows = list({d: (d, t) for d, t in ROWS}.values())
    got = {r.doc_id: r for r in fingerprints.compare(spark, documents(spark, rows)).collect()}
    ordered = sorted(with_ids(rows), reverse=True)
    off = []
    for i, (d, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[None if d == -(2**63) else d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            off.append(abs(near - (len(a & b) / len(a | b) if a | b else 1)))
    assert max(off) < 0.45 and sum(off) / len(off) < 0.03
    by_text = {}
    for d, text in with_ids(rows):
        assert by_text.setdefault(text, got[None if d == -(2**63) else d].fingerprint) == got[None if d == -(2**63) else d].fingerprint


def test_fingerprints_of_repeats_and_nothing(spark):
    assert fingerprints.compare(spark, documents(spark, [])).collect() == []
    got = fingerprints.compare(spark, documents(spark, [(1, "a b c d e f g")] * 2)).collect()
    assert [r.near_next for r in got] == [1.0] * 2
    plan = fingerprints.compare(spark, documents(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def without_repeats(rows, width):
    first, out = {}, {}
    for d, text in sorted(set(with_ids(rows))):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if first.setdefault(data[i : i + width], (d, i)) != (d, i):
                gone[i : i + width] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(data), int(gone.sum()), runs, np.frombuffer(data, "u1")[~gone].tobytes())
    return out


def test_fingerprints_of_hot_ids(spark):
    """A third of all rows without an id, a sixth with one id: no range holds many of them, and each meets its next."""
    rng = random.Random(8)
    texts = [f"t{i} " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))) for i in range(2400)]
    rows = [(None if i % 3 == 0 else 50 if i % 6 == 1 else i, t) for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    keyed = fingerprints.documents(docs).withColumn("tie", F.xxhash64("text"))
    ranged = keyed.select("doc_id", "tie", "text", fingerprints.id_range(keyed, 64).alias("bucket"))
    assert ranged.groupBy("bucket").count().agg(F.max("count")).first()[0] < 2400 / 10
    order = ranged.orderBy(F.desc("doc_id"), F.desc("tie")).collect()
    assert [r.bucket for r in order] == sorted((r.bucket for r in order), reverse=True)
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after.text[:half]
        own = None if r.doc_id == -(2**63) else r.doc_id
        want.append((own is None, own, len(r.text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare(spark, docs).collect()]
    key = lambda x: (x[0], x[1] or 0, *x[2:])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("width,k,many", [(100, 24, 200), (40, 8, 200), (100, 24, 2), (30, 6, 3)])
def test_substrings(spark, monkeypatch, width, k, many):
    monkeypatch.setattr(passages, "MANY", many)
    rows = list({d: (d, t) for d, t in ROWS}.values()) + [(7, "same text twice over here"), (55_555, "ab" * 700), (55_556, "é" * 300)]
    want = without_repeats(rows, width)
    got = substrings.dedup(spark, documents(spark, rows), width, k).collect()
    assert len(got) == len(rows)
    for r in got:
        own = -(2**63) if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[own]
    assert substrings.dedup(spark, documents(spark, [])).collect() == []


def many_of_no_id():
    """A thousand and more different texts without an id, whose repeats stand at places of their own."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(40))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    return [f"{t} {passage} {i}" if i % 2 else f"{t} {i}" for i, t in enumerate(texts)]


def test_passages_of_many_rows_without_id(spark):
    texts = many_of_no_id()
    counts = Counter(tuple(w[i : i + 35]) for w in map(word_list, texts) for i in range(len(w) - 34))
    want = []
    for own in map(word_list, texts):
        gone = {j for i in range(len(own) - 34) if counts[tuple(own[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    got = factors.dedup(spark, documents(spark, [(None, t) for t in texts])).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)


def test_substrings_of_many_rows_without_id(spark):
    texts = many_of_no_id()
    docs = documents(spark, [(None, t) for t in texts])
    ordered = [r.text for r in docs.select("text", F.xxhash64("text").alias("hash")).orderBy("hash").collect()]
    want = without_repeats(enumerate(ordered), 100)
    got = substrings.dedup(spark, docs).collect()
    assert sum(removed > 0 for _, removed, _, _ in want.values()) > 700
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want.values())


def test_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        symbols = rng.integers(1, 1 + rng.integers(1, 6), rng.integers(0, 30)).tolist() + [0]
        assert suffixes.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("width,k,many", [(35, 5, 200), (12, 3, 200), (35, 5, 2), (8, 2, 3)])
def test_passages(spark, monkeypatch, width, k, many):
    monkeypatch.setattr(passages, "MANY", many)
    rows = list({d: (d, t) for d, t in ROWS}.values()) + [(55_555, "a b " * 90), (55_556, "z " * 77)]
    words = {d: word_list(t) for d, t in with_ids(rows)}
    counts = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    for r in factors.dedup(spark, documents(spark, rows + [(7, "same text twice over here")]), "lang", "n_chars", width=width, k=k).collect():
        own = words[-(2**63) if r.doc_id is None else r.doc_id]
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if counts[tuple(own[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = " ".join(w for w, g in zip(own, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept, r.lang) == (len(own), sum(gone), left, "en")
    assert factors.dedup(spark, documents(spark, [])).collect() == []


def test_greedy_factors():
    symbols = np.array([5, 1, 2, 3, 9, 1, 2, 3, 4, 8])
    index = factors.indexed(symbols, 50)
    assert factors.lookup(index, np.arange(10)).tolist() == [0, 3, 2, 1, 0, 3, 2, 1, 0, 0]
    piece, start, size, found = factors.parse(index, np.array([0]), np.array([10]))
    assert piece.tolist() == [0] * 6
    assert found.tolist() == [False, True, False, True, False, False]
    assert list(zip(start.tolist(), size.tolist())) == [(0, 1), (1, 3), (4, 1), (5, 3), (8, 1), (9, 1)]


def test_windows_from_factors():
    """Pieces of a small alphabet: windows come from factors and boundaries alone, and none is lost."""
    rng = random.Random(11)
    asked = places = 0
    for _ in range(400):
        letters, width = rng.choice([1, 2, 3, 8]), rng.choice([1, 2, 4, 7])
        pieces = [[rng.randrange(letters) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 8))]
        symbols, heads, ends = [], [], []
        for i, p in enumerate(pieces):
            heads.append(len(symbols))
            symbols += p
            ends.append(len(symbols))
            symbols.append(100 + i)
        counts = Counter(tuple(p[q : q + width]) for p in pieces for q in range(len(p) - width + 1))
        want = [h + q for h, p in zip(heads, pieces) for q in range(len(p) - width + 1) if counts[tuple(p[q : q + width])] > 1]
        index = factors.indexed(np.array(symbols), max(map(len, pieces)) + 1)
        assert factors.repeated(index, np.array(heads), np.array(ends), width).tolist() == want
        asked += len(factors.parse(index, np.array(heads), np.array(ends))[1])
        places += sum(map(len, pieces))
    assert asked < places / 2


@pytest.mark.parametrize("tasks", [1, 7])
def test_hot_anchor_by_all_texts(spark, monkeypatch, tasks):
    """An anchor is hot by its contexts in all tasks, so no call of the method sees more of them."""
    monkeypatch.setattr(passages, "MANY", 40)
    rng = random.Random(5)
    anchor = " ".join(f"a{i}" for i in range(30))
    texts = [(i, f"x{i} y{rng.randrange(10**6)} {anchor} z{rng.randrange(3)} z{rng.randrange(3)} z{rng.randrange(3)} t{i} u{i}") for i in range(140)]
    docs = documents(spark, texts).repartition(tasks)
    kind = factors.words_kind()
    met = passages.settle(passages.contexts(passages.tagged(docs), kind), kind.keep_first)
    most = met.where(F.col("kind") == passages.OPEN).groupBy("key").count().agg(F.max("count")).first()[0]
    assert (most or 0) < 40
    assert met.where(F.col("kind") == passages.HOT).count() > 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 16)
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(24) for _ in range(300)]
    for i in range(60):
        rows.append(rows[i % 3] + 0.15 * rng.standard_normal(24))
    rows += [rows[0]] * 5 + [rng.standard_normal(5)] * 2
    ids = rng.permutation(5000)[: len(rows)].tolist()
    table = [(i, [float(x) for x in r]) for i, r in zip(ids, rows)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [None] * 24), (9006, [float("inf")] + [1.0] * 23), (None, table[0][1])]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark, df).collect()}
    sound = [(i, np.array(v) / np.linalg.norm(v)) for i, v in table] + [(-(2**63), np.array(table[0][1]) / np.linalg.norm(table[0][1]))]
    union, count = Union([i for i, _ in sound]), Counter()
    for k, (a, va) in enumerate(sound):
        for b, vb in sound[:k]:
            if len(va) == len(vb) and va @ vb >= 0.9:
                union.join(a, b)
                count[a] += 1
                count[b] += 1
    back = lambda i: None if i == -(2**63) else i
    want = {back(i): (count[i], back(union.find(i)), union.find(i) == i) for i, _ in sound}
    want |= {i: (0, i, True) for i, _ in odd[:-1]}
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.near_duplicates(spark, empty).collect() == []


@pytest.mark.parametrize("side,crowd", [(1024, 32), (16, 500)])
def test_vectors_of_chains_and_big_groups(spark, monkeypatch, side, crowd):
    """Links that no leader takes part in: border vectors of a big group, chains, and crowded keys in many ranges."""
    monkeypatch.setattr(vectors, "SIDE", side)
    monkeypatch.setattr(vectors, "CROWD", crowd)
    rng = np.random.default_rng(8)
    dim = 24

    def beside(x, cosine):
        y = rng.standard_normal(dim)
        y -= (x @ y) * x
        return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)

    rows = []
    for _ in range(3):
        first = beside(np.eye(dim)[0], 0.0)
        group = [beside(first, 0.93) for _ in range(100)]
        rows += [first, *group, *[beside(x, 0.96) for x in group[:40]]]
    for _ in range(20):
        x = beside(np.eye(dim)[1], 0.0)
        way = beside(x, 0.0)
        rows += [np.cos(a) * x + np.sin(a) * way for a in np.arange(8) * 0.25]
    rows += [beside(np.eye(dim)[2], 0.0) for _ in range(300)]
    units = np.array(rows)
    units /= np.linalg.norm(units, axis=1)[:, None]
    linked = units @ units.T >= 0.9
    union = Union(range(len(rows)))
    for a, b in np.argwhere(linked):
        union.join(int(a), int(b))
    want = {i: (int(linked[i].sum()) - 1, union.find(i), union.find(i) == i) for i in range(len(rows))}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark, df).collect()}
    assert got == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    turns = vectors.rotations(64, 256)
    off, beyond = [], 0
    for _ in range(400):
        x, y = rng.standard_normal((2, 64))
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        y = 0.8 * x + 0.6 * (y - (x @ y) * x) / np.linalg.norm(y - (x @ y) * x)
        leaders = vectors._Leaders(turns)
        turned = turns @ x
        leaders.add(1, np.where(turned >= 0, 1, -1), np.abs(turned).sum(axis=1) / 8)
        found, bound = leaders.estimates(y)
        off.append(found[0] - 0.8)
        beyond += abs(found[0] - 0.8) > bound[0]
    assert abs(np.mean(off)) < 0.01 and beyond == 0


def test_followed_parents_and_merged_parts(spark):
    """Chains of any depth are followed to their ends, and nodes of no part are their own."""
    from balancier.llm.components import components, followed, merged

    chain = [(i, i - 1) for i in range(1, 30)] + [(100, 3), (101, 3), (202, 201)]
    parents = spark.createDataFrame(chain, "node long, parent long")
    parts = followed(spark, parents)
    assert {r.node: r.component for r in parts.collect()} == {n: 201 if n == 202 else 0 for n, _ in chain}
    links = parents.selectExpr("parent AS a", "node AS b").unionByName(spark.createDataFrame([(300, 202), (400, 401)], "a long, b long"))
    got = {r.node: r.component for r in merged(spark, parts, links).collect()}
    want = {r.node: r.component for r in components(spark, links).collect()}
    assert {n: got.get(n, n) for n in want} == want and got[300] == 201 and got[401] == 400
    none = links.limit(0)
    assert components(spark, none).collect() == []
    assert sorted(merged(spark, parts, none).collect()) == sorted(parts.collect())


def test_jobs_of_the_near_duplicates_stage(spark):
    """Planning is what fills the driver: the stage stays under a bound of jobs."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.sparkContext.setJobGroup("near_duplicates", "")
    corpus_pipeline.kept(spark, corpus_pipeline.distinct(spark, docs, ""))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("near_duplicates")
    spark.sparkContext.setJobGroup("default", "")
    assert 0 < len(jobs) < 80
