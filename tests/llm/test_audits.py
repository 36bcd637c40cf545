"""Filter orders, benchmark passages and source distances against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from balancier.llm import contamination, divergence, filters

from .cases import ODD, documents, prose

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spread(spark, rows, langs=("en", None, "", "fr"), sources=("s1", "s2", None, "", "é", "s3")):
    """Rows of the odd columns with languages and sources dealt over them."""
    rows = [(d, t, langs[i % len(langs)], sources[i % len(sources)]) for i, (d, t) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = documents(spark, [(0, "x")]).drop("doc_id", "text", "lang", "source").limit(1)
    return table.join(clash), rows


# --- filter orders ---------------------------------------------------------------------


def plain_steps(rows, labels):
    least = {}
    for d, t, *_ in rows:
        key, own = t or "", (d is not None, d or 0)
        least[key] = min(least.get(key, own), own)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, lang, *_ in rows:
        text = t or ""
        words = re.findall(WORD, text)
        failed = set()
        failed |= {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        failed |= {"D"} if re.search("[#$%&*|]", text) else set()
        failed |= {"E"} if (d is not None, d or 0) > least[text] else set()
        parts[lang or ""].append((failed, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        sums = Counter()
        steps = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in docs if f in x[0] and not x[0] & before]
                sums[f] += len(here)
                steps.append((
                    part, "".join(order), step, sum(not x[0] & (before | {f}) for x in docs), len(here),
                    sum(f in x[0] and bool(x[0] & before) for x in docs), sum(x[0] == {f} for x in docs),
                    sum(x[1] for x in here), sum(x[2] for x in here),
                ))
        out += [(*s, sums[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_orders_against_all_steps(spark):
    rng = random.Random(1)
    rows = ODD + prose(3, 60, words=120) + [(900 + i, "A LOUD TEXT") for i in range(9)] + [(50, "pay # now"), (51, "pay # now"), (51, "pay # now")]
    rows += [(None, "A LOUD TEXT")] * 5 + [(10**7, "word " * 40_000)]
    docs, rows = spread(spark, rows)
    ids = [d for d, *_ in rows]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in rng.sample(ids, 60)] + [(51, 0, 0), (51, 1, 1), (None, 1, 1), (424242, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS part", "1 AS n")
    got = filters.audit(docs, table).collect()
    assert sorted(map(tuple, got)) == plain_steps(rows, labels)


def test_filter_orders_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(documents(spark, []), none).collect() == []
    got = filters.audit(documents(spark, [(1, None)]), none).collect()
    assert len(got) == 600 and {r.part for r in got} == {"en"}
    assert all(r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=32, max_size=32))
def test_shares_are_shapleys(values):
    """The solution of the least squares problem is the mean over all orders, for any game."""
    values[0] = 0
    sums = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            sums[i] += values[before | 1 << i] - values[before]
            before |= 1 << i
    assert filters.shares(values) == [Fraction(s, 120) for s in sums]


def test_copies_never_meet_in_a_window_row_by_row(spark):
    """A group of copies is one row for each part and labels before its window."""
    rows = [(i, "same text") for i in range(5000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r.failed: r.n for r in filters.histogram(documents(spark, rows), none).collect()}
    assert {k: n for k, n in counts.items() if n} == {1: 1, 17: 4999}


# --- benchmark passages ----------------------------------------------------------------


def plain_hits(rows, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for name, text in items:
        words = re.findall(word, lower(text))
        size = min(10, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows[tuple(words[i : i + size])].add("" if name is None else str(name))
    out = []
    for d, text in rows:
        words, hit, names = re.findall(word, lower(text)), set(), set()
        for i in range(len(words)):
            for size in range(1, 11):
                own = windows.get(tuple(words[i : i + size])) if i + size <= len(words) else None
                if own:
                    names |= own
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def leaky(seed):
    """Items and rows with whole and cut passages of them, in other marks and letters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(100 + i, " ".join(say(rng.randint(10, 40)))) for i in range(30)]
    items += [(1, "Ab-ba  caB!"), (2, "zebra"), (3, ""), (4, None), (5, " ..."), (None, "no name has this item"), (7, items[0][1]), (7, items[1][1])]
    items += [(8, " ".join(["la"] * 25)), (9, "la la"), (11, "one two three four five six seven eight nine ten ELEVEN")]
    rows = list(ODD)
    for i in range(150):
        words = say(rng.randint(0, 60))
        if i % 3 == 0:
            source = rng.choice(items)[1] or ""
            own = source.split(" ")
            a = rng.randint(0, len(own))
            words[5:5] = own[a : a + rng.randint(5, 30)]
        text = rng.choice([" ", " - ", "\n"]).join(words)
        rows.append((1000 + i, text.upper() if i % 7 == 0 else text))
    rows += [(1, "ab BA\x00cab"), (1, "ab ba cab zebra"), (2, "la " * 60), (3, "zebra" * 3), (4, "Zebra"), (5, "no name, HAS this item"), (6, "ab ba"), (6, None)]
    return items, rows


@pytest.mark.parametrize("most", [contamination.AUTOMATON, 700])
def test_contamination_against_all_windows(spark, monkeypatch, most):
    """Also where the windows need several automata."""
    monkeypatch.setattr(contamination, "AUTOMATON", most)
    items, rows = leaky(2)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS words", "1 AS items")
    assert (contamination.patterns(spark, table)[1] > 3) == (most == 700)
    found = contamination.find(spark, documents(spark, rows), table)
    got = sorted((tuple(r) for r in contamination.digests(found).collect()), key=repr)
    assert got == plain_hits(rows, items)


def test_spans_are_places_of_the_original(spark):
    items, rows = leaky(3)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts, seen = dict(rows), 0
    for r in contamination.find(spark, documents(spark, rows), table).collect():
        text = texts[r.doc_id] or ""
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        assert [(s.start, s.stop) for s in r.spans] == [(places[s.first][0], places[s.last - 1][1]) for s in r.spans]
        seen += len(r.spans)
    assert seen > 20


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination.digests(contamination.find(spark, documents(spark, ODD), none)).collect()
    assert len(got) == len(ODD) and not any(r.contaminated or r.n_items for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.find(spark, documents(spark, []), some).collect() == []


def test_a_long_text_is_scanned_in_stretches():
    """The automaton keeps its state from stretch to stretch."""
    words = [f"w{i % 977}x{i % 13}" for i in range(3 * contamination.AT_ONCE)]
    at = [contamination.AT_ONCE - 5, 2 * contamination.AT_ONCE - 9, 100]
    scanner = contamination.Scanner([(" ".join(words[a : a + 10]), ["i"]) for a in at])
    first, _ = scanner.scan(contamination.normal_words(pa.array(["", " ".join(words), "w1"])))
    want = {i for i in range(len(words) - 9) for a in at if (i - a) % (977 * 13) == 0}
    assert set(first.tolist()) == want


# --- source distances ------------------------------------------------------------------


def plain_distances(rows):
    counts, seen, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        groups.add((lang, source))
        for t, n in terms.items():
            counts[lang, source, t] += n
            seen[lang, t] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted((t for (g, t), n in seen.items() if g == lang and n >= 3), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)
        v = len(kept)
        own = {s: [counts[lang, s, t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + v) for n in c]
        shares = {s: share(c) for s, c in own.items()}
        whole = share([sum(c) for c in zip(*own.values())])
        far = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(map(far, shares[s], shares[o])), o.encode()) for o in sources if o != s]
            terms = [(-far(p, q), t.encode()) for t, n, p, q in zip(kept, own[s], shares[s], whole) if n and p > q]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def wordy(seed, n):
    """Rows of a vocabulary of which sources use different shares."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcçdeÉé") for _ in range(rng.randint(1, 5))) for _ in range(900)]
    return [(i, " ".join(rng.choice(vocabulary[(i % 7) * 40 : (i % 7) * 40 + rng.randint(20, 600)]) for _ in range(rng.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("cell, sums", [(divergence.CELL, divergence.SUMS), (40, 9)])
def test_distances_against_all_terms(spark, monkeypatch, cell, sums):
    """Also where rows and terms are dealt over many cells."""
    monkeypatch.setattr(divergence, "CELL", cell)
    monkeypatch.setattr(divergence, "SUMS", sums)
    many = [f"source {i}" for i in range(11)]
    docs, rows = spread(spark, ODD + wordy(5, 300) + [(None, "x y z")] * 4 + [(1, "long " * 30_000)], ("en", None, "en", "", "fr", "en", "de"), [*many, None, ""])
    rows += [(1, None, "only", "one"), (2, "no term thrice", "two", "a"), (3, "", "two", "b"), (4, None, "two", "c")]
    more = spark.createDataFrame(rows[-4:], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = [tuple(r) for r in divergence.audit(spark, docs).collect()]
    assert sorted(got) == plain_distances(rows)


def test_only_200_terms_are_named(spark):
    rows = [(i, " ".join(f"t{'abcdefghij'[j // 100]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j % 10]}" for j in range(300)), "en", "a") for i in range(3)]
    rows += [(9 + i, "plain words here", "en", "b") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in divergence.audit(spark, docs).collect()]
    assert sorted(got) == plain_distances(rows) and sum(r[1:3] == ("a", "term") for r in got) == 200


def test_distances_of_nothing(spark):
    assert divergence.audit(spark, documents(spark, [])).collect() == []
    assert divergence.audit(spark, documents(spark, [(1, None), (2, "")])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(0, 10**15), st.integers(1, 10**12)), min_size=1))
def test_shares_are_exact(cases):
    count, more, terms = (np.array(c, "i8") for c in zip(*cases))
    total = np.minimum(count + more, 9 * 10**15 - terms)
    count = np.minimum(count, total)
    want = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in zip(count.tolist(), total.tolist(), terms.tolist())]
    assert divergence.share(count, total, terms).tolist() == want


def test_postings_come_in_pieces(monkeypatch):
    """Whole terms go through the index as they come, in batches of any size."""
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    rng = random.Random(4)
    counts = {f"s{s}": {f"t{t:02}": rng.randint(1, 9) for t in rng.sample(range(40), 25)} for s in range(6)}
    names = ["lang", "low", "high", "kind", "term", "source", "n", "terms", "own"]
    heads = [("en", 0, 0, 0, "", s, sum(c.values()), 40, 1) for s, c in counts.items()]
    posts = sorted(("en", 0, 0, 1, t, s, n, 0, 0) for s, c in counts.items() for t, n in c.items())
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in heads + posts])
    share = lambda s, t: 1 + 10**9 * (counts[s].get(t, 0) + 1) // (sum(counts[s].values()) + 40)
    used = {t for c in counts.values() for t in c}
    want = {(a, b): sum((share(a, t) - share(b, t)) ** 2 // share(b, t) for t in used) for a in counts for b in counts if a != b}
    for size in (1, 5, 1000):
        out = [r for b in divergence._accumulate(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["source"], r["item"]): r["value"] for r in out} == want
