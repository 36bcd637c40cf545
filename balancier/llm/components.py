"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from balancier.llm.common import kept


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the links ``a, b``.

    Large stars and small stars in turn: every node sends its neighbours to the least node it
    knows. Each round is written to the shared folder, and the driver gets two numbers of the
    write itself. The neighbours of a hot node are never gathered, only joined to its least one.
    """
    up = F.greatest("a", "b")
    edges, seen = _round(spark, links.where("a <> b").select(up.alias("u"), F.least("a", "b").alias("v")).distinct())
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before = seen
        edges, seen = _round(spark, small.where("u <> v").distinct())
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _round(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, their number and the sum of their hashes."""
    told = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    out = kept(spark, edges.observe(told, F.count(F.lit(1)).alias("n"), total.alias("hash")))
    return out, (told.get["n"], told.get["hash"])


def followed(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """``node, component`` of ``node, parent``: where the steps from parent to parent end.

    Every node has one parent at most and none is its own ancestor. Each join doubles the steps
    that are followed; the table is written after two of them, until the second finds nothing more.
    """
    out = parents.select("node", F.col("parent").alias("component"))
    while True:
        for _ in range(2):
            above = out.select(F.col("node").alias("component"), F.col("component").alias("above"))
            joined = out.select("node", "component").join(above, "component", "left")
            out = joined.select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved"))
        told = Observation()
        out = kept(spark, out.observe(told, F.count_if("moved").alias("moved")).select("node", "component"))
        if not told.get["moved"]:
            return out


def merged(spark: SparkSession, parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (``node, component``) joined by links ``a, b`` between their nodes; a node in no part is its own.

    Only links between different parts are followed, as links of these.
    """
    ends = links
    for end in ("a", "b"):
        own = parts.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        ends = ends.join(own, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    found = components(spark, ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    found = found.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    own = parts.join(found, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    # Parts of one node that was in none before: roots of ``parts`` are rows of theirs only as components.
    single = found.join(parts.select(F.col("node").alias("component")), "component", "left_anti")
    return kept(spark, own.unionByName(single.select(F.col("component").alias("node"), F.col("joined").alias("component"))))
