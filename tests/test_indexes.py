"""Stored search indexes: the same hits as a full scan, from a share of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from balancier.operators import indexes as I
from balancier.operators import retrieval as V
from balancier.session import work_folder
from tests.plans import text

CORPUS = "id long, content string, title string"


def hits(df):
    return sorted((r["query"], r["rank"], r["id"] is None, r["id"], r["score"]) for r in df.collect())


def corpus(spark, seed, n):
    """Words of uneven frequency in documents of one to some hundred words; an id twice, none, and no text."""
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{int(40 * rng.random() ** 3)}" for _ in range(int(2 ** rng.uniform(0, 8)))), f"w{i % 7} t") for i in range(n)]
    return spark.createDataFrame(rows + [(1, "w0 w1 " * 9, None), (None, "w2 w0", "w0"), (None, "w2", None), (n + 1, None, None)], CORPUS)


QUERIES = [
    V.Query("one", terms=["w0"]), V.Query("rare", terms=["w39", "w38"]), V.Query("many", terms=["w1", "w5", "w30", "w1"]),
    V.Query("absent", terms=["nowhere"]), V.Query("none"),
]


@pytest.mark.parametrize("seed,n,block,k", [(1, 300, 8, 5), (2, 300, 1, 16), (3, 40, 1000, 8), (4, 0, 8, 3)])
def test_terms_as_by_a_scan(spark, seed, n, block, k):
    docs = corpus(spark, seed, n)
    path = work_folder(spark)
    I.write_terms(docs, path, block_docs=block)
    assert hits(I.by_terms(spark, path, QUERIES, k).hits) == hits(V.by_terms(docs, QUERIES, k))


def test_terms_leave_blocks_unread(spark):
    docs = corpus(spark, 5, 2000)
    path = work_folder(spark)
    I.write_terms(docs, path, block_docs=8)
    shares = {}
    for k in (4, 64):
        report = {r["query"]: (r["rows_scored"], r["rows_all"]) for r in I.by_terms(spark, path, QUERIES, k).report.collect()}
        assert report["one"][1] == docs.filter(F.concat_ws(" ", "content", "title").rlike(r"\bw0\b")).select("id").distinct().count()
        shares[k] = {q: a / b for q, (a, b) in report.items()}
    assert shares[4]["one"] < 0.2 and shares[4]["many"] < 0.35
    assert all(shares[4][q] <= shares[64][q] for q in shares[4])


def test_terms_without_documents(spark):
    path = work_folder(spark)
    I.write_terms(spark.createDataFrame([], CORPUS), path)
    found = I.by_terms(spark, path, QUERIES)
    assert found.hits.collect() == [] and found.report.collect() == []
    assert I.by_terms(spark, path, [V.Query("none")]).hits.collect() == []


def clusters(spark, groups, each, spread, size=16):
    """Vectors around centres, each twice, and some that never rank."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, size))
    rows = [(centres[i % groups] + spread * rng.normal(size=size)).astype("float32").tolist() for i in range(groups * each)]
    odd = [[0.0] * size, [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), None]
    data = [(i, v, (None, "x", "y")[i % 3]) for i, v in enumerate(rows + rows + odd)]
    return spark.createDataFrame(data, "id long, embedding array<float>, domain string").repartition(6), centres


@pytest.mark.parametrize("spread,pivots", [(0.1, 24), (3.0, 24), (0.1, 1)])
def test_dense_as_by_a_scan(spark, spread, pivots):
    docs, centres = clusters(spark, 12, 30, spread)
    rng = np.random.default_rng(4)
    queries = [V.Query(f"q{i}", (centres[i] + 0.05 * rng.normal(size=16)).tolist(), domain="x" if i % 2 else None) for i in range(5)]
    queries += [V.Query("zero", [0.0] * 16), V.Query("words", terms=["a"]), V.Query("far", (-centres[0]).tolist())]
    usable = docs.filter(F.col("id") < 720)
    path = work_folder(spark)
    I.write_vectors(docs, path, domain="domain", pivots=pivots)
    for k in (3, 70, 2000):
        assert hits(I.dense(spark, path, queries, k).hits) == hits(V.dense(usable, queries, k, domain="domain"))


def test_dense_leaves_groups_unread(spark):
    docs, centres = clusters(spark, 12, 30, 0.05)
    path = work_folder(spark)
    I.write_vectors(docs, path, pivots=48)
    found = I.dense(spark, path, [V.Query("a", centres[2].tolist()), V.Query("b", centres[7].tolist())], 10)
    counted = found.report.first()
    assert counted["rows_all"] == 720 and counted["rows_scored"] < 240
    plan = text(found.hits)
    assert "PushedFilters: [Or(" in plan.replace("\n", "")


def test_dense_without_vectors(spark):
    path = work_folder(spark)
    I.write_vectors(spark.createDataFrame([], "id long, embedding array<float>"), path)
    assert I.dense(spark, path, [V.Query("q", [1.0, 2.0])]).hits.collect() == []


def test_words_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame([(1, "b a, B! b-c", "a"), (1, "a", None), (2, " ,", None), (3, None, None), (None, "é É e", "")], CORPUS)
    counted = I.counted_words(docs, "id", ("content", "title"))
    got = [(r["id"], r["words"], [tuple(p) for p in r["posts"]]) for r in counted.collect()]
    assert got == [(1, 5, [("a", 2), ("b", 2), ("b-c", 1)]), (1, 1, [("a", 1)]), (2, 0, []), (3, 0, []), (None, 3, [("e", 1), ("é", 2)])]
    # no table of words is kept in a task, and no postings are sent to be counted or to learn their block
    plan = text(counted)
    assert "Aggregate" not in plan and "Exchange" not in plan and "Generate" not in plan


def test_postings_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_POSTINGS", 100)
    docs, path = corpus(spark, 6, 300), work_folder(spark)
    I.write_terms(docs, path, block_docs=8)
    postings = spark.read.parquet(f"{path}/postings")
    files = postings.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    most, number = files.agg(F.max("n"), F.count(F.lit(1))).first()
    assert number > 8 and most < postings.count() / 8
    assert hits(I.by_terms(spark, path, QUERIES, 5).hits) == hits(V.by_terms(docs, QUERIES, 5))
