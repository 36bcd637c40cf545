"""Distinct counts by bitmaps and the nearest key of a table, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from balancier.functions import recode as R
from balancier.operators import metrics as M
from tests.plans import nodes, text


def test_distinct_counts_by_bitmaps(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0, 7, 32767, 32768, rng.randrange(200_000)]), rng.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(rows + [("empty", None, 1)], "g string, id long, x int")
    wanted = {"all": None, "some": F.col("x") < 2, "never": F.col("x") > 9, "null": F.lit(None).cast("boolean")}
    tests = {"all": lambda x: True, "some": lambda x: x < 2, "never": lambda x: False, "null": lambda x: False}
    got = {r["g"]: r.asDict() for r in M.distinct_counts(df, "id", wanted, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "empty"}
    for g, one in got.items():
        for name, test in tests.items():
            assert one[name] == len({i for k, i, x in rows if k == g and i is not None and test(x)})
    total = M.distinct_counts(df, "id", wanted)
    assert total.first()["some"] == len({i for _, i, x in rows if i is not None and x < 2})
    assert "Expand" not in text(total) and nodes(total, "Scan") == 1
    assert M.distinct_counts(df.limit(0), "id", wanted).first().asDict() == {n: 0 for n in wanted}


@pytest.mark.parametrize("bins", [1, 3, 10_000])
def test_nearest_key_of_a_table(spark, bins):
    rng = random.Random(4)
    keys = [(rng.choice([rng.randrange(-500, 500), rng.randrange(10**6)]), f"c{i}") for i in range(400)] + [(None, "none"), (5, "b"), (5, "a")]
    values = [None, -10**12, 10**12, *[k for k, _ in keys[:50]], *[rng.randrange(-1000, 10**6 + 1000) for _ in range(800)], *range(-520, 520, 7)]
    best = {}
    for k, c in keys:
        if k is not None:
            best[k] = min(c, best.get(k, c))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    out = R.nearest_from(df, "v", spark.createDataFrame(keys, "key long, code string"), "code", bins)
    assert nodes(out, "NestedLoop") == 0
    got = {r.i: r.code for r in out.collect()}
    assert got == {i: None if v is None else best[min(best, key=lambda k: (abs(k - v), k))] for i, v in enumerate(values)}


def test_nearest_without_keys(spark):
    df = spark.createDataFrame([(1, 2)], "i long, v long")
    assert R.nearest_from(df, "v", spark.createDataFrame([], "key long, code string"), "code").first().code is None
