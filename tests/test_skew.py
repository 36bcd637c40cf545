"""One key holds most rows: results stay whole and no task gets the group."""

import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from balancier.operators import datamart as D
from balancier.operators import metrics as M
from balancier.operators import scenario as X
from balancier.operators import quality as Q
from balancier.plans.catalog import star
from checks.star import agg, cond
from tests.plans import text

N = 200_000
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture
def tight(spark):
    """Sizes so small that a test table looks large."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_fact(spark):
    """Half the facts have no contract, a third one contract."""
    i = F.col("id")
    contract = F.when(i % 2 == 0, F.lit(None)).when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), i % 997))
    return spark.range(0, N, 1, 8).select(
        "id", contract.alias("id_contrat"), F.pmod(F.xxhash64(i), F.lit(1_000_000)).alias("amount"), F.concat(F.lit("pad"), F.sha2(i.cast("string"), 256)).alias("pad")
    )


def contracts(spark):
    ids = spark.range(997).select(F.concat(F.lit("C"), "id").alias("id")).unionByName(spark.createDataFrame([("HOT",)], "id string"))
    return ids.withColumns({"actif": F.lit(1), "tauxcontrat": F.length("id")})


def test_hot_join_key_is_split(tight):
    tables = {"fact_balance": hot_fact(tight), "dim_contrat": contracts(tight)}
    flat = star(tables, ["id", "amount", "contratActif"])
    out = flat.groupBy("dc_actif").agg(F.sum("f_amount").alias("s"), F.count(F.lit(1)).alias("n"))
    got = {r["dc_actif"]: (r["n"], r["s"]) for r in out.collect()}
    assert "skew=true" in text(out)
    rows = hot_fact(tight).groupBy(F.col("id_contrat").isNotNull().alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s")).collect()
    assert {(1 if r["k"] else None): (r["n"], r["s"]) for r in rows} == got


def test_hot_key_in_duplicates(tight):
    rules = Q.Rules(required=("pad",), key=("id_contrat",), whole_row=False, integer=("amount",))
    df = hot_fact(tight).withColumn("amount", F.col("amount").cast("string"))
    n = Q.counters(df, rules).first()
    keyed = df.filter("id_contrat IS NOT NULL")
    assert n["duplicates"] == keyed.count() - keyed.select("id_contrat").distinct().count() == Q.duplicates(df, rules).count()
    assert Q.drop_duplicates(df, rules).count() == N - n["duplicates"]


def test_orphans_of_a_hot_key(tight):
    known = contracts(tight).filter("id <> 'HOT'")
    assert Q.orphan_count(hot_fact(tight), "id_contrat", known, "id").first()[0] == hot_fact(tight).filter("id_contrat = 'HOT'").count()


def test_copies_of_one_row(tight):
    df = hot_fact(tight).select("id", (F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("amount"))
    missing = [c for c in (*D.FACT_KEYS, *D.MEASURES) if c != "amount"]
    full = df.select("*", *[F.lit(None).cast("bigint").alias(c) for c in missing])
    kept = D.dedup_fact(full)
    # ids 3, 6, ... keep their own amount; 0 and all others share amount 0
    assert kept.count() == len(range(3, N, 3)) + 1
    assert kept.filter("amount = 0").first()["id"] == 0


def test_totals_beyond_64_bits(spark):
    big = spark.range(4).select("id", F.lit(2**62).alias("amount"), F.lit(1).alias("actif"))
    tables = {"fact_balance": big}
    out = M.metrics_at(tables, {"S": agg("SUM", "amount"), "M": agg("AVG", "amount"), "F": agg("SUM", "amount", cond("actif", "=", 0))}).first()
    assert out["S"] == float(2**64) and out["M"] == float(2**62) and out["F"] is None


def test_expressions_beyond_64_bits(spark):
    big = spark.range(4).select("id", F.lit(2**62).alias("amount"), F.lit(2**40).alias("soldeorigine"))
    of = lambda kind, left, right: {"type": kind, "left": left, "right": right}
    amount, origin = ({"type": "FIELD", "field": f} for f in ("amount", "soldeorigine"))
    plus = of("ADD", amount, {"type": "VALUE", "value": 0})
    specs = {
        "S": {"type": "AGGREGATION", "function": "SUM", "expression": plus},
        "M": {"type": "AGGREGATION", "function": "AVG", "expression": plus},
        "P": {"type": "AGGREGATION", "function": "SUM", "expression": of("MULTIPLY", origin, origin)},
    }
    out = M.metrics_at({"fact_balance": big}, specs).first()
    assert (out["S"], out["M"], out["P"]) == (float(2**64), float(2**62), float(2**82))


def test_shock_totals_beyond_20_digits(spark):
    rows = spark.range(3).select(F.lit(Decimal("9e19")).cast("decimal(38,10)").alias("_d0"), F.lit(True).alias("_hit"), F.lit(True).alias("_m0"))
    out = rows.agg(*X.total_columns([None])).first()
    assert out["positive_delta"] == Decimal("2.7e20") and out["negative_delta"] == 0
