import math
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from balancier.operators import dashboard as B
from balancier.operators import metrics as M
from balancier.operators import ratios as R
from balancier.operators import scenario as X
from balancier.plans.catalog import SpecError
from checks.reports import METRICS, RATIOS, const, param
from checks.star import agg, cond, op


@pytest.fixture(scope="module")
def mart(spark):
    """Two dates, a NULL balance, and a fact without a chapter."""
    fact = spark.createDataFrame(
        [
            (1, 1, 10, Decimal("100.25"), 5, 1), (2, 1, 11, Decimal("-40.5"), 7, 1), (3, 1, None, None, None, 0),
            (4, 2, 10, Decimal("1"), 2, 1),
        ],
        "id long, id_date long, id_chapitre long, soldeconvertie decimal(38,10), amount long, actif int",
    )
    for c in ("id_agence", "id_devise", "id_devisebnq", "id_compte", "soldeorigine", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois"):
        fact = fact.withColumn(c, F.lit(3).cast("long"))
    fact = fact.withColumns({"id_client": F.lit(None).cast("string"), "id_contrat": F.lit(None).cast("string")})
    days = spark.createDataFrame([(1, date(2024, 1, 31)), (2, date(2024, 2, 29))], "id long, date_value date")
    chapters = spark.createDataFrame([(10, 2110), (11, 2010)], "id long, chapitre long")
    return {"fact_balance": fact, "sub_dim_date": days, "sub_dim_chapitre": chapters}


def starts(p):
    return cond("subDimChapitre.chapitre", "STARTS_WITH", p)


def test_shocks_apply_in_sequence(mart):
    shocks = [X.read_shock(s) for s in (
        {"operation": "SET", "field": "amount", "value": 0},
        {"operation": "ADD", "field": "amount", "value": 2.5, "filters": cond("amount", "=", 0)},
        {"operation": "SUBTRACT", "field": "amount", "value": 1, "filters": cond("amount", ">", 100)},
    )]
    rows, swap = X.apply_shocks(X._rows(mart, ["id"], shocks, None), shocks)
    got = {r["f_id"]: r[swap["f_amount"]] for r in rows.collect()}
    assert set(got.values()) == {Decimal("2.5")}
    t = rows.agg(*X.total_columns(shocks)).first()
    assert (t["matched_0"], t["matched_1"], t["matched_2"], t["rows_touched"]) == (4, 4, 0, 4)
    assert t["positive_delta"] == Decimal("10") and t["negative_delta"] == Decimal("14")


def test_null_balance_counts_as_zero_only_where_it_matches(mart):
    shocks = [X.read_shock({"operation": "ADD", "field": "soldeconvertie", "value": 5, "filters": cond("actif", "=", 0)})]
    rows, swap = X.apply_shocks(X._rows(mart, ["id"], shocks, "2024-01-31"), shocks)
    assert {r["f_id"]: r[swap["f_soldeconvertie"]] for r in rows.collect()} == {1: Decimal("100.25"), 2: Decimal("-40.5"), 3: Decimal("5")}


def test_unbalanced_is_refused_and_long_fractions_survive(mart):
    up = {"operation": "ADD", "field": "soldeconvertie", "value": "0.0009751911374629428", "filters": starts("21")}
    down = {**up, "operation": "SUBTRACT", "filters": starts("20")}
    metrics = {"S": agg("SUM", "soldeconvertie", starts_number(2110)), "N": agg("COUNT")}
    out = X.balance_scenario(mart, metrics, {}, [up, down], "2024-01-31", changed_only=False)
    assert out.totals["balanced"] and out.totals["rows_touched"] == 2
    rows = {r["code"]: r for r in out.metrics.collect()}
    assert rows["S"]["delta"] == pytest.approx(0.0009751911374629428) and rows["S"]["impacted"]
    assert not rows["N"]["impacted"] and not rows["N"]["changed"]
    with pytest.raises(SpecError, match="UNBALANCED_SIMULATION"):
        X.balance_scenario(mart, metrics, {}, [{**up, "value": 1}, down], "2024-01-31")
    near = {**down, "value": "0.0009761"}  # differs by less than the tolerance of 1e-6
    X.balance_scenario(mart, metrics, {}, [up, near], "2024-01-31")


def starts_number(n):
    return cond("chapitre", "=", n)


def test_no_rows_at_date(mart):
    with pytest.raises(SpecError, match="NO_DATA_FOR_DATE.*2024-02-29.*2024-01-31"):
        X.balance_scenario(mart, {"N": agg("COUNT")}, {}, [{"operation": "SET", "field": "amount", "value": 1}], "2030-01-01")


@pytest.mark.parametrize(
    "shock, message",
    [
        ({"operation": "MULTIPLY", "field": "amount", "value": 1}, "INVALID_OPERATION"),
        ({"operation": "ADD", "field": "actif", "value": 1}, "not adjustable"),
        ({"operation": "ADD", "field": "nope", "value": 1}, "Unknown field"),
        ({"operation": "ADD", "field": "amount"}, "value is required"),
        ({"operation": "ADD", "field": "amount", "value": 1, "filters": cond("nope", "=", 1)}, "Unknown field"),
    ],
)
def test_bad_shocks(shock, message):
    with pytest.raises(SpecError, match=message):
        X.read_shock(shock)


def test_metric_shocks_start_from_the_baseline(mart):
    metrics = {"A": agg("SUM", "amount"), "E": agg("SUM", "amount", cond("amount", ">", 1000))}
    ratios = {"Q": op("DIVIDE", param("A"), param("E")), "U": {"type": "PARAM"}, "P": op("ADD", param("A"), param("MISSING"))}
    adj = [{"operation": "ADD", "code": "A", "value": 100}, {"operation": "MULTIPLY", "code": " A ", "value": 2}]
    out = X.metric_scenario(mart, metrics, ratios, adj, changed_only=False)
    got = {r["code"]: r for r in out.metrics.collect()}
    assert (got["A"]["original"], got["A"]["simulated"], got["A"]["impact_percent"]) == (14.0, 28.0, 100.0)
    assert got["E"]["original"] == 0.0 and got["E"]["impact_percent"] is None
    r = {r["code"]: r for r in out.ratios.collect()}
    assert r["Q"]["original"] == 0.0 and r["P"]["simulated"] == 28.0
    assert math.isnan(r["U"]["original"]) and not r["U"]["changed"]
    with pytest.raises(SpecError, match="UNKNOWN_PARAMETER"):
        X.metric_scenario(mart, metrics, {}, [{"operation": "ADD", "code": "ZZ", "value": 1}])
    with pytest.raises(SpecError, match="needs a value"):
        X.metric_scenario(mart, metrics, {}, [{"operation": "ADD", "code": "A"}])


def test_stored_value_is_shown(mart, spark):
    stored = spark.createDataFrame([(9, 5.5, date(2024, 1, 31)), (9, 6.5, date(2024, 2, 29))], "id_ratios long, ratios_value double, reference_date date")
    out = X.metric_scenario(mart, {"A": agg("SUM", "amount")}, {"Q": param("A")}, [{"operation": "ADD", "code": "A", "value": 1}],
                            "2024-01-31", dashboard=stored, ratio_ids={"Q": 9})
    row = out.ratios.first()
    assert (row["original"], row["simulated"], row["dashboard_value"]) == (12.0, 13.0, 5.5)


def test_edges_agree_with_reached(spark):
    fields = X.field_edges(spark, METRICS)
    joined = fields.filter("field = 'amount'").join(X.ratio_edges(spark, RATIOS), "metric")
    metrics, ratios = X.reached(["amount"], METRICS, RATIOS)
    assert {r[0] for r in fields.filter("field = 'amount'").select("metric").collect()} == metrics == {"TOEXP", "NIL"}
    assert {r["ratio"] for r in joined.collect()} == ratios == {"RLCT", "BAD"}


def test_division_by_zero_can_fail_the_query(mart):
    wide = M.metrics_at(mart, {"A": agg("SUM", "amount"), "Z": agg("SUM", "amount", cond("amount", ">", 99))})
    tree = {"Q": op("DIVIDE", param("A"), op("MULTIPLY", param("Z"), const(3)))}
    assert R.ratios_wide(wide, tree).first()["Q"] is None
    assert R.ratios_wide(wide, tree, on_zero="zero").first()["Q"] == 0.0
    with pytest.raises(Exception, match="Division by zero is not allowed"):
        R.ratios_wide(wide, tree, on_zero="error").collect()


def test_fill_is_incremental(mart, spark):
    metrics = {"A": agg("SUM", "amount"), "Z": agg("SUM", "amount", cond("amount", ">", 99))}
    ratios = {"X": (1, param("A")), "BAD": (2, op("DIVIDE", param("A"), param("Z"))), "LOST": (3, param("NONE"))}
    first = B.fill(mart, ratios, metrics)
    assert first.report.first().asDict() == {"dates_found": 2, "ratios_processed": 3, "inserted": 2, "skipped": 0, "errors": 4}
    stored = B.to_store(first.rows)
    assert sorted((r["id_ratios"], r["ratios_value"]) for r in stored.collect()) == [(1, 2.0), (1, 12.0)]
    again = B.fill(mart, ratios, metrics, stored)
    assert again.report.first().asDict() == {"dates_found": 2, "ratios_processed": 3, "inserted": 0, "skipped": 2, "errors": 4}
    with pytest.raises(ValueError, match="has a value for"):
        B.manual_value(stored, 1, date(2024, 1, 31), 3.0)
    assert B.manual_value(stored, 1, date(2025, 1, 31), 3.0).first()["id"] == 3


def test_fill_equals_single_metrics(mart):
    wide = {r["reference_date"]: r["A"] for r in M.metrics_by_date(mart, {"A": agg("SUM", "amount")}).collect()}
    for day, value in wide.items():
        assert M.metric(mart, {"expression": agg("SUM", "amount")}, at=day).first()["value"] == value


def test_empty_aggregates(mart):
    nothing = {"expression": agg("SUM", "amount"), "where": cond("amount", ">", 99)}
    assert M.metric(mart, nothing).first()["value"] is None
    ratio = op("DIVIDE", agg("SUM", "amount"), agg("COUNT", filters=cond("amount", ">", 99)))
    assert M.metric(mart, ratio).first()["value"] is None


def test_severity_passes_over_unset_thresholds(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None, 3.0), (2.5, 2.0, None, 3.0), (2.5, None, 2.6, 3.0), (9.0, None, None, None), (None, 1.0, 1.0, 1.0)],
                                 "v double, p double, a double, t double")
    got = [r[0] for r in rows.select(B.severity(*[F.col(c) for c in "vpat"])).collect()]
    assert got == ["CRITICAL", "WARNING", "ALERT", "HEALTHY", None]
