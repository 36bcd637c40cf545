"""Dates first: what is asked of some dates reads and shuffles no others, and nothing is computed twice."""

import pytest
from pyspark.sql import functions as F

from balancier.operators import dashboard as B
from balancier.operators import metrics as M
from balancier.operators import scenario as X
from balancier.operators import states as S
from balancier.plans.catalog import star
from balancier.session import work_folder, written
from checks import reports
from checks.star import agg
from checks.tables import datamart
from tests.plans import nodes, text

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_calendar_needs_no_shuffle_of_facts(no_small_tables):
    df = star(datamart(no_small_tables, SF), ["soldeconvertie", "datevalue"])
    assert nodes(df, "SortMergeJoin") == 1  # lineitem and orders


@pytest.mark.parametrize("ask", [
    lambda t: M.metrics_at(t, {"m": agg("SUM", "amount")}, "1997-05-01"),
    lambda t: M.metric(t, {"expression": agg("SUM", "amount")}, "1997-05-01"),
    lambda t: M.metrics_by_date(t, {"m": agg("SUM", "amount")}, M.reference_dates(t, 1)),
    lambda t: X.shock_totals(t, reports.BALANCED, "1997-05-01"),
])
def test_other_dates_go_where_facts_are_read(spark, ask):
    tables = datamart(spark, SF)
    tables["fact_balance"] = written(tables["fact_balance"], work_folder(spark))
    assert "(id_date," in text(ask(tables)).split("PushedFilters: ", 1)[1]


def test_no_facts_at_an_unknown_date(spark):
    tables = datamart(spark, SF)
    assert M.metrics_at(tables, {"n": agg("COUNT")}, "2050-01-01").first()["n"] == 0


def test_a_fill_is_computed_once(spark):
    ratios = {c: (reports.IDS[c], tree) for c, tree in reports.RATIOS.items()}
    stored = reports._stored(spark, SF)
    out = B.fill(datamart(spark, SF), ratios, reports.METRICS, stored)
    assert "lineitem" not in text(stored) + text(out.rows) + text(out.report)


def test_dates_that_are_full_still_count(spark):
    tables = datamart(spark, SF)
    ratios = {"RL": (2, reports.RATIOS["RL"])}
    dates = M.reference_dates(tables).collect()
    full = spark.createDataFrame([(2, r[0]) for r in dates[1:]], "id_ratios bigint, reference_date date")
    report = B.fill(tables, ratios, reports.METRICS, full).report.first()
    assert report["dates_found"] == len(dates) and report["skipped"] == len(dates) - 1


def test_a_refresh_reads_its_facts_once(spark):
    """The pass that makes the states also says which fact is the newest."""
    tables, root = datamart(spark, SF), work_folder(spark)
    facts = written(tables["fact_balance"], work_folder(spark))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tables["fact_balance"] = facts.mapInArrow(counted, facts.schema)
    assert S.refresh(tables, {"a": agg("SUM", "amount")}, root) == 1
    assert read.value == facts.count()
    assert S.read_log(spark, root)[0]["upto"] == facts.agg(F.max("id")).first()[0]
