"""What five filters remove, in every order and by Shapley's shares, from one table of coalitions.

A document fails some of the filters; what a set of filters (a coalition) removes are the
documents that fail any of its members. The 32 numbers of a part say all: a step removes what its
prefix with the filter removes beyond the prefix alone, and Shapley's shares are the solution of
the least squares problem with Shapley's kernel as weights under the condition that the shares add
up to what all five remove. Its normal equations are solved in rationals.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancier.llm.common import NULL_ID, documents

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Bit of the copies; the other filters look at one text alone.
COPY = 1 << FILTERS.index("E")
#: Rows without id, which cannot have a label, are dealt over so many keys.
SALTS = 1024


def text_failures(text: str = "text") -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x09-\x0D\x20]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    large = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (n < 100, 100 * different < 80 * n, 100 * large.cast("long") > 10 * F.char_length(text), F.col(text).rlike("[#$%&*|]"))
    return sum((F.when(failed, F.lit(1 << i)).otherwise(0) for i, failed in enumerate(tests)), F.lit(0))


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic`` once per labelled id: of several rows of an id any may say so."""
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags)


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents of each set of failed filters, at most 32 rows a part.

    Texts leave their task as a SHA-256 and the bits of their failures. Of a text the rows of the
    smallest id pass E, which is found from counts by text, part and labels: a group of copies is
    added up in every task and never gathered.
    """
    rows = documents(docs, F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_failures().alias("failed"))
    salt = F.when(F.col("doc_id") == NULL_ID, 1 + F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0)
    flags = label_flags(labels).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.withColumn("salt", salt).join(flags, ["doc_id", "salt"], "left")
    rows = rows.fillna(0, ["good", "toxic"])

    same = ["key", "part", "failed", "good", "toxic"]
    each = rows.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*same).agg(F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"), F.sum("n").alias("n"))
    # One row for each part and labels of a text.
    least = F.min("first").over(Window.partitionBy("key"))
    passed = F.when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("passed", passed)
    both = F.array(
        F.struct("failed", F.col("passed").alias("n")),
        F.struct((F.col("failed") + COPY).alias("failed"), (F.col("n") - F.col("passed")).alias("n")),
    )
    counted = groups.select("part", "good", "toxic", F.explode(both).alias("r")).select("part", "good", "toxic", "r.*")
    return counted.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalitions(counts: DataFrame) -> DataFrame:
    """``part, coalition, documents, removed, good, toxic``: 32 rows a part, of what a coalition removes."""
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    removed = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(o) for c, o in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))]
    every = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return every.groupBy("part", "coalition").agg(F.sum("n").alias("documents"), *removed)


def shares(removed: Sequence[int]) -> list[Fraction]:
    """Shapley's share of each filter in what all remove; ``removed`` is indexed by coalition.

    The shares minimise the squared errors of the sums over all coalitions but none and all,
    weighted by Shapley's kernel, and add up to ``removed[ALL]``.
    """
    n = len(FILTERS)
    weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, ALL)}
    members = [[s for s in weight if s >> i & 1] for i in range(n)]
    # Normal equations, bordered by the condition and its multiplier.
    rows = [
        [sum((weight[s] for s in members[i] if s >> j & 1), Fraction(0)) for j in range(n)]
        + [Fraction(1), sum((weight[s] * int(removed[s]) for s in members[i]), Fraction(0))]
        for i in range(n)
    ]
    rows.append([Fraction(1)] * n + [Fraction(0), Fraction(int(removed[ALL]))])
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [rows[i][-1] for i in range(n)]


SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _steps(rows: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part, from its 32 coalitions."""
    rows = rows.sort_values("coalition")
    part, total = rows["part"].iloc[0], int(rows["documents"].iloc[0])
    removed, good, toxic = (rows[c].tolist() for c in ("removed", "good", "toxic"))
    orders = factorial(len(FILTERS))
    sums = [orders * x for x in shares(removed)]
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            own = 1 << i
            after = before | own
            here = removed[after] - removed[before]
            out.append((
                part, name, step, total - removed[after], here, removed[own] - here, removed[ALL] - removed[ALL ^ own],
                good[after] - good[before], toxic[after] - toxic[before], int(sums[i]),
            ))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with counts of the step.

    Null texts and parts are empty, and an empty text fails A alone. A null id counts as the
    smallest and has no label; rows that share id and text are no copies of each other, as neither
    id is smaller. Without documents there are no parts and no rows.
    """
    return coalitions(histogram(docs, labels)).groupBy("part").applyInPandas(_steps, SCHEMA)
