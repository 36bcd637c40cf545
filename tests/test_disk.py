"""Long jobs go by steps, and the shuffles of a step leave the disk as it ends."""

import time

import pytest
from pyspark.sql import functions as F

from balancier.operators import datamart as D
from balancier.plans.catalog import Narrowed, star
from balancier.session import shuffles_removed, work_folder, written
from checks.staging import staging
from checks.tables import datamart
from tests.plans import text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cleaned(spark):
    raw = [staging(spark, SF, n) for n in ("stg_tiers", "stg_contrat", "stg_compta")]
    return D.clean_staging(*[written(df, work_folder(spark)) for df in raw], work_folder(spark))


def shuffles(spark) -> set[str]:
    """The shuffle files on disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def left(spark, before: set[str]) -> set[str]:
    """Shuffle files that came since ``before`` and stay; executors are told to remove them, which takes a moment."""
    until = time.time() + 5
    while (new := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return new


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_write_removes_its_shuffles(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, old = shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    with shuffles_removed(spark):
        out = written(rows, work_folder(spark))
    assert not left(spark, before) and rows_of(out) == rows_of(rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == old


@pytest.mark.parametrize("buckets", [None, 8])
def test_no_step_of_a_load_finds_the_shuffles_of_another(spark, cleaned, monkeypatch, buckets):
    customers, contracts, ledger = cleaned
    before, steps = shuffles(spark), []

    def watched(df, path, **options):
        steps.append(left(spark, before))
        return written(df, path, **options)

    monkeypatch.setattr(D, "written", watched)
    root = f"{work_folder(spark)}/mart"
    D.load_datamart(spark, customers, contracts, ledger.where("id % 2 = 0"), root, buckets)
    first = len(steps)
    tables = D.load_datamart(spark, customers, contracts, ledger, root)
    assert first >= 2 and len(steps) - first >= 3  # lost clients and facts; those again, and the facts that are new
    assert not any(steps) and not left(spark, before)
    assert rows_of(tables["fact_balance"].drop("id", "row_hash")) == rows_of(D.fact_rows(ledger, tables))


def test_lost_clients_tell_the_same_as_all_clients(spark, cleaned):
    """Ids without a client, blank ones and rows that come twice included."""
    customers, contracts, ledger = cleaned
    odd = F.when(F.col("id") % 3 == 0, F.concat(F.lit("lost "), "idtiers")).when(F.col("id") % 5 == 0, F.lit(" "))
    odd = ledger.limit(300).withColumn("idtiers", F.coalesce(odd, F.concat(F.lit(" "), "idtiers")))
    ledger = written(ledger.unionByName(odd).unionByName(odd), work_folder(spark))
    tables = D.load_datamart(spark, customers, contracts, ledger, f"{work_folder(spark)}/mart")
    used = ledger.select(D.C.blank_to_null("idtiers").alias("idtiers")).where("idtiers IS NOT NULL").distinct()
    lost = used.join(tables["dim_client"], "idtiers", "left_anti")
    assert lost.where("idtiers LIKE 'lost%'").count() and used.count() > lost.count()
    fewer, plain = D.resolved_rows(ledger, tables, lost_clients=lost), D.resolved_rows(ledger, tables)
    assert fewer.columns == plain.columns and rows_of(fewer) == rows_of(plain)
    assert rows_of(tables["fact_balance"].drop("id", "row_hash")) == rows_of(plain.distinct())


def test_a_view_by_steps_has_one_shuffle_of_the_facts_at_a_time(spark):
    """The rows of the view in one go, with null keys, keys without a row and facts that come twice."""
    tables = datamart(spark, SF)
    facts = tables["fact_balance"]
    odd = facts.limit(90).withColumns({
        "id_compte": F.when(F.col("id") % 3 > 0, F.col("id_compte")), "id_contrat": F.when(F.col("id") % 2 > 0, F.lit("none")),
        "id_client": F.when(F.col("id") % 5 > 0, F.col("id_client"))})
    tables = Narrowed(tables, written(facts.unionByName(odd).unionByName(odd), work_folder(spark)))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    old, before = spark.conf.get(threshold), shuffles(spark)
    whole = star(tables)
    spark.conf.set(threshold, "-1")
    try:
        steps = star(tables, by_steps=True)
        assert not left(spark, before)
        joined = [key for key in ("f_id_compte", "f_id_contrat", "f_id_client") if f"Left keys [1]: [{key}#" in text(steps)]
        assert joined == ["f_id_client"]  # the others are stored
    finally:
        spark.conf.set(threshold, old)
    assert steps.columns == whole.columns and rows_of(steps) == rows_of(whole)
    assert steps.count() == facts.count() + 180
