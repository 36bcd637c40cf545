"""Hybrid retrieval for a batch of queries: vectors, words, codes, and their fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balancier.functions import text as X

TOP_K = 8
RRF_K = 60
#: Queries that a batch of rows is scored against at once.
AT_ONCE = 256
RESULT = "query string, id bigint, score double"


class Query(NamedTuple):
    name: str
    vector: Sequence[float] | None = None
    terms: Sequence[str] = ()
    ratio_codes: Sequence[str] = ()
    parameter_codes: Sequence[str] = ()
    domain: str | None = None


def query_of(name: str, text: str, vector: Sequence[float] | None = None) -> Query:
    """Read a question the way documents are read. Meant for single questions."""
    import re

    upper_words = set(re.split(r"[\W_]+", text.upper()))
    low = text.lower()
    words = re.sub(r"[^\w\s-]|_", " ", low).split()
    terms = list(dict.fromkeys(w for w in words if len(w) > 1 and w not in X.STOP_WORDS))
    return Query(
        name, vector, terms, [c for c in X.RATIO_CODES if c in upper_words], [c for c in X.PARAMETER_CODES if c in upper_words],
        next((d for p, d in X.DOMAIN_PHRASES.items() if p in low), None),
    )


def best(hits: DataFrame, k: int) -> DataFrame:
    """Rank hits in their query and keep the first k; ties go to the lower id.

    Spark trims every task's rows to k per query before the shuffle.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_of_batch(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; ties go to the lower id. NaN never ranks."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    pick = np.flatnonzero(scores > -np.inf)
    if len(pick) > k:
        bar = np.partition(scores[pick], len(pick) - k)[len(pick) - k]
        pick = pick[scores[pick] >= bar]
    return pick[np.lexsort((ids[pick], -scores[pick]))][:k]


def _scorer(queries: Sequence[Query], k: int):
    blocks = [_block(queries[i : i + AT_ONCE], k) for i in range(0, len(queries), AT_ONCE)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for block in blocks:
                    yield block(batch)

    return score


def _block(queries: Sequence[Query], k: int):
    matrix = np.array([q.vector for q in queries], dtype=np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    names = [q.name for q in queries]
    domains = [q.domain for q in queries]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
        # Domains as numbers, once a batch: -1 is none.
        coded = batch.column("domain").dictionary_encode()
        number = {d: i for i, d in enumerate(coded.dictionary.to_pylist())}
        fields = np.asarray(coded.indices.fill_null(-1))
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ matrix.T
        sims = np.round(sims, 12)  # equal vectors must tie wherever they stand in a batch
        out_q, out_id, out_s = [], [], []
        for j, name in enumerate(names):
            col = sims[:, j]
            if domains[j] is not None:
                col = np.where((fields == -1) | (fields == number.get(domains[j], -1)), col, np.nan)
            best_rows = top_of_batch(ids, col, k)
            out_q += [name] * len(best_rows)
            out_id.append(ids[best_rows])
            out_s.append(col[best_rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(out_q, pa.string()), pa.array(np.concatenate(out_id), pa.int64()), pa.array(np.concatenate(out_s), pa.float64())],
            names=["query", "id", "score"],
        )

    return score


def dense(documents: DataFrame, queries: Sequence[Query], k: int = 2 * TOP_K, id_col: str = "id", vector: str = "embedding", domain: str | None = None) -> DataFrame:
    """Exact cosine top k per query over all documents: (query, id, score, rank).

    One scan scores a batch of rows against all queries at once and passes on only the
    batch's best k per query. A query with a domain also takes documents without one.
    """
    asked = [q for q in queries if q.vector is not None]
    field = F.col(domain).cast("string") if domain else F.lit(None).cast("string")
    rows = documents.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector"), field.alias("domain")
    )
    if not asked:
        return best(documents.sparkSession.createDataFrame([], RESULT), k)
    hits = rows.mapInArrow(_scorer(asked, k), RESULT)
    return best(hits, k)


def by_terms(documents: DataFrame, queries: Sequence[Query], k: int = 2 * TOP_K, id_col: str = "id", texts: Sequence[str] = ("content", "title")) -> DataFrame:
    """Documents with any term of the query, ranked by the sum of tf * ln(1 + N / df).

    Only words that some query names leave the scan. Their counts are shuffled once and read
    both for the document frequencies and for the scores.
    """
    spark = documents.sparkSession
    wanted = sorted({t for q in queries for t in q.terms})
    if not wanted:
        return best(spark.createDataFrame([], RESULT), k)
    whole = F.concat_ws(" ", *[F.col(t) for t in texts])
    words = documents.select(F.col(id_col).cast("bigint").alias("id"), F.explode(X.words(whole)).alias("term"))
    pairs = words.filter(F.col("term").isin(*wanted)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = documents.agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("_one", F.lit(1))
    frequency = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_one", F.lit(1))
    weights = frequency.join(total, "_one").select("term", F.log1p(F.col("n") / F.col("df")).alias("weight"))
    asked = spark.createDataFrame([(q.name, t) for q in queries for t in dict.fromkeys(q.terms)], "query string, term string")
    scored = (
        pairs.join(weights, "term").join(asked, "term")
        .groupBy("query", "id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 9).alias("score"))
    )
    return best(scored, k)


def by_code(documents: DataFrame, queries: Sequence[Query], k: int = TOP_K, id_col: str = "id") -> DataFrame:
    """Documents whose ratio or parameter code the query names; every hit scores 1."""
    spark = documents.sparkSession
    asked = [("ratio_code", c, q.name) for q in queries for c in dict.fromkeys(q.ratio_codes)]
    asked += [("parameter_code", c, q.name) for q in queries for c in dict.fromkeys(q.parameter_codes)]
    codes = spark.createDataFrame(asked, "kind string, code string, query string")
    both = F.array(
        F.struct(F.lit("ratio_code").alias("kind"), F.col("ratio_code").alias("code")),
        F.struct(F.lit("parameter_code").alias("kind"), F.col("parameter_code").alias("code")),
    )
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.inline(both)).filter(F.col("code").isNotNull())
    hits = rows.join(codes, ["kind", "code"]).select("query", "id").distinct()
    return best(hits.withColumn("score", F.lit(1.0)), k)


def fuse(lists: Iterable[DataFrame], k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (rrf_k + rank) over the lists, best k per query."""
    frames = [f.select("query", "id", "rank") for f in lists]
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    share = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    return best(stacked.groupBy("query", "id").agg(F.round(F.sum(share), 12).alias("score")), k)


def retrieve(documents: DataFrame, queries: Sequence[Query], k: int = TOP_K, **columns) -> DataFrame:
    """All three searches and their fusion."""
    id_col = columns.get("id_col", "id")
    return fuse(
        [
            dense(documents, queries, 2 * k, id_col, columns.get("vector", "embedding"), columns.get("domain", "domain")),
            by_terms(documents, queries, 2 * k, id_col, columns.get("texts", ("content", "title"))),
            by_code(documents, queries, k, id_col),
        ],
        k,
    )
