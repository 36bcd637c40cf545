"""Stored indexes for retrieval: exact top k that reads only what can still reach it.

Words: postings in blocks of documents of like length, with each block's largest count of every
term. Vectors: groups around pivots, in order of their angle to the pivot. Both searches score a
few likely rows first; the k-th best score found there rules out the rest by its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancier.functions import text as X
from balancier.operators import retrieval as V
from balancier.session import work_folder, written

#: Documents of a block, about.
BLOCK_DOCS = 1024
#: Length levels of a doubling.
LEVELS = 4
#: Postings that one task sorts, about.
TASK_POSTINGS = 2_000_000
PIVOTS = 64
#: More than rounding can move a score, relative to it, or an angle.
SCORE_SLACK, ANGLE_SLACK = 1e-8, 1e-6


class Found(NamedTuple):
    """``query, id, score, rank`` and how much was scored for it: ``rows_scored`` of ``rows_all``, by query for words."""

    hits: DataFrame
    report: DataFrame


def counted_words(documents: DataFrame, id_col: str, texts: Sequence[str]) -> DataFrame:
    """``id, words, posts`` of every row: how many words it has, and ``term, tf`` of each different one.

    The words of a row are sorted and their runs measured inside the row, so no task keeps the
    words of more than one text at a time.
    """
    whole = F.concat_ws(" ", *[F.col(t) for t in texts])
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.sort_array(F.filter(X.words(whole), lambda w: w != "")).alias("w"))
    new = lambda w, i: F.when(~w.eqNullSafe(F.get("w", i - 1)), i)
    rows = rows.select("id", "w", F.filter(F.transform("w", new), lambda i: i.isNotNull()).alias("starts"))
    end = lambda j: F.coalesce(F.get("starts", j + 1), F.size("w"))
    run = lambda i, j: F.struct(F.get("w", i).alias("term"), (end(j) - i).cast("bigint").alias("tf"))
    return rows.select("id", F.size("w").cast("bigint").alias("words"), F.transform("starts", run).alias("posts"))


def write_terms(documents: DataFrame, path: str, id_col: str = "id", texts: Sequence[str] = ("content", "title"), block_docs: int = BLOCK_DOCS) -> None:
    """Index of every word of the documents: ``postings``, ``blocks``, ``terms`` and ``total`` under ``path``.

    Rows of one id are one document, as in ``retrieval.by_terms``. Postings lie in ranges of term
    and block, so a term that most documents hold is spread over files.
    """
    spark = documents.sparkSession
    rows = written(counted_words(documents, id_col, texts), work_folder(spark)).filter("words > 0")
    sizes = F.sum("words").alias("all_words"), F.count(F.lit(1)).alias("parts"), F.sum(F.size("posts")).alias("pairs")
    lengths = written(rows.groupBy(F.col("id").alias("_id")).agg(*sizes), work_folder(spark))
    level = lambda words: F.floor(F.log2(words) * LEVELS).cast("int")
    # One number for each level of length: as many as lengths double, times LEVELS.
    found = lengths.groupBy(level("all_words").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs")).collect()
    parts, start, after = {}, {}, 0
    for r in sorted(found):
        parts[r["level"]], start[r["level"]] = -(-r["n"] // block_docs), after
        after += parts[r["level"]]

    def block(words: str) -> Column:
        by_level = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])[level(words)]
        number = by_level(start) + F.pmod(F.xxhash64("id"), by_level(parts)) if found else F.lit(0)
        return number.cast("long").alias("block")

    # A document of one row has its postings and its length there; only those of several rows are added up.
    several, same = lengths.filter("parts > 1").select("_id", "all_words"), F.col("id").eqNullSafe(F.col("_id"))
    alone = rows.join(several, same, "left_anti").select("id", block("words"), F.inline("posts"))
    added = rows.join(several, same).select("id", "all_words", F.inline("posts")).groupBy("id", "all_words", "term").agg(F.sum("tf").alias("tf"))
    posts = alone.select("term", "block", "id", "tf").unionByName(added.select("term", block("all_words"), "id", "tf"))
    tasks = -(-sum(r["pairs"] for r in found) // TASK_POSTINGS)
    ranges = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    posts.repartitionByRange(*ranges, "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    blocks = postings.groupBy("term", "block").agg(F.max("tf").alias("most"), F.count(F.lit(1)).alias("docs"))
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("docs").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    documents.agg(F.count(F.lit(1)).cast("double").alias("n")).write.mode("overwrite").parquet(f"{path}/total")


def by_terms(spark: SparkSession, path: str, queries: Sequence[V.Query], k: int = 2 * V.TOP_K) -> Found:
    """The hits of ``retrieval.by_terms`` from the index under ``path``.

    A block scores at most the sum of its terms' largest counts times their weights. The k
    blocks of largest bound hold k documents; what they leave to be scored are blocks whose bound
    reaches the k-th best of these.
    """
    asked = sorted({(q.name, t) for q in queries for t in q.terms})
    if not asked:
        none = spark.createDataFrame([], "query string, rows_all long, rows_scored long")
        return Found(V.best(spark.createDataFrame([], V.RESULT), k), none)
    of_asked = F.col("term").isin(*sorted({t for _, t in asked}))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    total = read("total").withColumn("_one", F.lit(1))
    weights = (
        read("terms").filter(of_asked).withColumn("_one", F.lit(1)).join(total, "_one")
        .select("term", F.log1p(F.col("n") / F.col("df")).alias("weight"))
        .join(spark.createDataFrame(asked, "query string, term string"), "term")
    )
    weights = written(weights.select("query", "term", "weight"), work_folder(spark))  # a row for each term asked
    each = read("blocks").filter(of_asked).join(weights, "term")
    bounds = each.groupBy("query", "block").agg(F.sum(F.col("most") * F.col("weight")).alias("bound"), F.sum("docs").alias("rows"))
    bounds = written(bounds, work_folder(spark))

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = chosen.join(weights, "query")
        return (
            read("postings").filter(of_asked).join(wanted, ["term", "block"])
            .groupBy("query", "id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 9).alias("score"))
        )

    likely = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("nth", F.row_number().over(likely)).filter(F.col("nth") <= k)
    first = written(first.select("query", "block", "rows"), work_folder(spark))
    head = written(V.best(scored(first.select("query", "block")), k).drop("rank"), work_folder(spark))
    bar = head.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    can = F.col("bar").isNull() | (F.col("bound") * (1 + SCORE_SLACK) + SCORE_SLACK >= F.col("bar"))
    rest = bounds.join(first, ["query", "block"], "left_anti").join(bar, "query", "left").filter(can)
    rest = written(rest.select("query", "block", "rows"), work_folder(spark))
    hits = V.best(head.unionByName(scored(rest.select("query", "block"))), k)
    read_rows = first.unionByName(rest).groupBy("query").agg(F.sum("rows").alias("rows_scored"))
    report = bounds.groupBy("query").agg(F.sum("rows").alias("rows_all")).join(read_rows, "query")
    return Found(hits, report)


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def write_vectors(documents: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", domain: str | None = None, pivots: int = PIVOTS) -> None:
    """Every vector in the group of its nearest pivot, in order of its angle to it: ``rows`` and ``pivots`` under ``path``.

    Pivots are the ``pivots`` vectors whose ids have the least hashes. Vectors that are null,
    zero or not finite never rank and are left out. A group of any size lies in many files, each
    a range of angles.
    """
    spark = documents.sparkSession
    field = F.col(domain).cast("string") if domain else F.lit(None).cast("string")
    rows = documents.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), field.alias("domain")
    )
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    usable = rows.filter((norm > 0) & (norm < float("inf")))  # NaN counts as the greatest, null is left out
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector")
    chosen = written(chosen, f"{path}/pivots")
    found = [r["vector"] for r in chosen.collect()]
    centres = _unit(np.array(found, dtype=np.float64)) if found else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_unit(_matrix(batch.column("vector"), batch.num_rows)), centres)
                near = angles.argmin(axis=1)
                angle = angles[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype("i4")), pa.array(angle)], [*batch.schema.names, "pivot", "angle"])

    placed = usable.mapInArrow(assign, "id bigint, vector array<double>, domain string, pivot int, angle double")
    placed = placed.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle")
    placed.write.mode("overwrite").parquet(f"{path}/rows")


def dense(spark: SparkSession, path: str, queries: Sequence[V.Query], k: int = 2 * V.TOP_K) -> Found:
    """The hits of ``retrieval.dense`` from the index under ``path``.

    Angles obey the triangle inequality: a vector whose angle to its pivot differs from the
    query's by more than the k-th best angle is no nearer than that. The k-th best comes from the
    groups of the queries' nearest pivots; then one scan reads, for each pivot, the angles that
    some query leaves open, as a range that Parquet's statistics prune by.
    """
    rows = spark.read.parquet(f"{path}/rows")
    asked = [q for q in queries if q.vector is not None and np.linalg.norm(q.vector) > 0 and np.isfinite(np.linalg.norm(q.vector))]
    stored = [r["vector"] for r in spark.read.parquet(f"{path}/pivots").collect()]
    if not asked or not stored:
        return Found(V.best(spark.createDataFrame([], V.RESULT), k), rows.agg(F.count(F.lit(1)).alias("rows_all"), F.lit(0).cast("long").alias("rows_scored")))
    away = _angles(_unit(np.array([q.vector for q in asked], dtype=np.float64)), _unit(np.array(stored, dtype=np.float64)))
    near = sorted(set(away.argmin(axis=1).tolist()))

    def scored(some: DataFrame) -> DataFrame:
        return V.best(some.select("id", "vector", "domain").mapInArrow(V._scorer(asked, k), V.RESULT), k)

    first = scored(rows.filter(F.col("pivot").isin(near))).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar"))
    bars = {r["query"]: r["bar"] for r in first.collect() if r["n"] >= k}  # a number for each query
    reach = np.array([np.arccos(np.clip(bars.get(q.name, -1.0), -1.0, 1.0)) for q in asked]) + ANGLE_SLACK
    low, high = (away - reach[:, None]).min(axis=0), (away + reach[:, None]).max(axis=0)
    open_ = F.lit(False)
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        open_ = open_ | ((F.col("pivot") == i) & F.col("angle").between(a, b))
    kept = rows.filter(open_)
    counted = rows.agg(F.count(F.lit(1)).alias("rows_all"), F.count_if(open_).alias("rows_scored"))
    return Found(scored(kept), counted)
