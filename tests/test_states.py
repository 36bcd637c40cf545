"""Metric states kept by date: merged, not read again, whole or not there."""

import pytest
from pyspark.sql import functions as F

from balancier.operators import datamart as D
from balancier.operators import metrics as M
from balancier.operators import states as S
from balancier.plans.catalog import SpecError
from balancier.session import work_folder
from checks.star import agg, cond, op
from checks.tables import datamart
from tests.plans import text

SF = "/root/testdata/sf0.001"
METRICS = {
    "total": agg("SUM", "soldeconvertie", cond("actif", "=", 1)),
    "mean": agg("AVG", "soldeorigine"),
    "accounts": agg("COUNT", "numcompte", distinct=True),
    "share": op("DIVIDE", agg("SUM", "cumulmvtcr"), agg("SUM", "soldeorigine")),
}


@pytest.fixture()
def stored(spark):
    """A datamart whose facts lie in a folder per date; the last month comes with a second load."""
    tables = datamart(spark, SF)
    keys = [c for c in tables["fact_balance"].columns if c != "id"]
    facts = tables["fact_balance"].drop("id").distinct()
    last = facts.agg(F.max("id_date")).first()[0]
    path = work_folder(spark)

    def load(rows, after):
        ids = D.number_rows(rows, keys, after)
        ids.repartition("id_date").write.mode("append").partitionBy("id_date").parquet(path)
        tables["fact_balance"] = spark.read.parquet(path).withColumn("id_date", F.col("id_date").cast("bigint"))
        return ids.count()

    first = load(facts.filter(F.col("id_date") < last), 0)
    return tables, lambda: load(facts.filter(F.col("id_date") == last), first)


def rows_of(df):
    return sorted(map(tuple, df.select(df.columns[0], *[F.round(c, 9) for c in df.columns[1:]]).collect()))


def rows_scanned(df):
    """Rows that the scans of fact files gave out."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet") and "id_compte" in str(node.output()):
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_after_a_load_only_its_facts_are_read(spark, stored, monkeypatch):
    tables, second = stored
    root = work_folder(spark)
    assert S.refresh(tables, METRICS, root) == 1
    assert S.refresh(tables, METRICS, root) == 0
    new = second()
    seen, sums = [], S._sums

    def watched(rows, states):
        out = sums(rows, states)
        if states and "Filter" in text(rows):
            seen.append(rows)
        return out

    monkeypatch.setattr(S, "_sums", watched)
    assert S.refresh(tables, METRICS, root) == 1
    assert len(seen) == 1 and rows_scanned(seen[0]) == new
    monkeypatch.undo()
    kept = S.metrics_by_date(tables, METRICS, root)
    assert rows_of(kept) == rows_of(M.metrics_by_date(tables, METRICS))
    assert "id_compte" not in text(kept)  # no fact is read


def test_a_broken_refresh_stays_unread(spark, stored, monkeypatch):
    tables, second = stored
    root = work_folder(spark)
    S.refresh(tables, METRICS, root)
    before = rows_of(S.metrics_by_date(tables, METRICS, root))
    second()

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(S, "_values", broken)
    with pytest.raises(OSError):
        S.refresh(tables, METRICS, root)
    monkeypatch.undo()
    assert rows_of(S.metrics_by_date(tables, METRICS, root)) == before
    S.refresh(tables, METRICS, root)
    assert rows_of(S.metrics_by_date(tables, METRICS, root)) == rows_of(M.metrics_by_date(tables, METRICS))


def test_changed_metrics_are_new_states(spark, stored):
    tables, second = stored
    root = work_folder(spark)
    S.refresh(tables, METRICS, root)
    changed = {**METRICS, "total": agg("SUM", "soldeconvertie", cond("actif", "=", 0))}
    with pytest.raises(SpecError):
        S.metrics_by_date(tables, changed, root)
    second()
    assert S.refresh(tables, changed, root) == 2  # one pass for the new state, one over the new facts
    assert rows_of(S.metrics_by_date(tables, changed, root)) == rows_of(M.metrics_by_date(tables, changed))
    with pytest.raises(SpecError):  # left behind
        S.metrics_by_date(tables, METRICS, root)
    S.refresh(tables, METRICS, root)
    assert rows_of(S.metrics_by_date(tables, METRICS, root)) == rows_of(M.metrics_by_date(tables, METRICS))


def test_two_writers_are_noticed(spark, stored):
    tables, _ = stored
    root = work_folder(spark)
    S.refresh(tables, METRICS, root)
    spark.read.parquet(f"{root}/log").coalesce(1).write.mode("append").parquet(f"{root}/log")
    with pytest.raises(ValueError):
        S.refresh(tables, METRICS, root)


def test_no_facts_give_no_dates(spark):
    tables = datamart(spark, SF)
    tables["fact_balance"] = tables["fact_balance"].filter("false")
    root = work_folder(spark)
    assert S.refresh(tables, METRICS, root) == 1  # an empty part: the states are known, up to no fact
    assert S.refresh(tables, METRICS, root) == 0
    assert S.metrics_by_date(tables, METRICS, root).count() == 0
