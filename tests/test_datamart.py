"""Loading: idempotence, key numbering, conservation."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from balancier.operators import datamart as D
from balancier.operators import listing as P
from balancier.operators import metrics as M
from balancier.operators import quality as Q
from balancier.session import work_folder, written
from checks.staging import staging
from tests.plans import text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cleaned(spark):
    raw = [staging(spark, SF, n) for n in ("stg_tiers", "stg_contrat", "stg_compta")]
    return D.clean_staging(*raw, work_folder(spark))


@pytest.fixture(scope="module")
def loaded(spark, cleaned, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("mart"))
    return root, D.load_datamart(spark, *cleaned, root)


def test_tables_are_filled(loaded):
    _, t = loaded
    assert set(t) == set(D.TABLES)
    counts = {r["table"]: r["rows"] for r in D.table_counts(t, D.TABLES).collect()}
    assert all(counts.values())
    assert counts["sub_dim_agenteco"] == 25 and counts["sub_dim_sectionactivite"] == 89 and counts["sub_dim_objetfinance"] == 7


def test_ids_are_unique_and_dense(loaded):
    _, t = loaded
    for name in ("sub_dim_residence", "sub_dim_devise", "sub_dim_date", "sub_dim_compte", "fact_balance"):
        r = t[name].agg(F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        assert r[0] == r[1] and (r[2], r[3]) == (1, r[0]), name


def test_keys_point_at_rows(loaded):
    _, t = loaded
    fact = t["fact_balance"]
    for key, dim in (("id_agence", "sub_dim_agence"), ("id_compte", "sub_dim_compte"), ("id_date", "sub_dim_date")):
        ids = t[dim].select(F.col("id").alias(key))
        assert fact.filter(F.col(key).isNotNull()).join(ids, key, "left_anti").count() == 0
    clients = t["dim_client"].select(F.col("idtiers").alias("id_client"))
    assert fact.filter(F.col("id_client").isNotNull()).join(clients, "id_client", "left_anti").count() == 0


def test_second_load_adds_nothing(spark, cleaned, loaded):
    root, t = loaded
    before = {n: t[n].count() for n in D.TABLES}
    again = D.load_datamart(spark, *cleaned, root)
    assert {n: again[n].count() for n in D.TABLES} == before


def test_labels_change_without_rewriting(spark, tmp_path):
    path = str(tmp_path / "accounts")
    first = spark.createDataFrame([(10, "old"), (11, None), (12, "kept")], "numcompte long, libellecompte string")
    one = D.append_accounts(None, first, path)
    second = spark.createDataFrame([(10, "new"), (12, None), (13, "x")], "numcompte long, libellecompte string")
    two = D.append_accounts(one, second, path)
    got = {r["numcompte"]: r["libellecompte"] for r in two.collect()}
    assert got == {10: "new", 11: None, 12: "kept", 13: "x"}
    assert {r["numcompte"]: r["id"] for r in one.collect()}.items() <= {r["numcompte"]: r["id"] for r in two.collect()}.items()
    stored = spark.read.parquet(path).count()
    D.append_accounts(two, second, path)
    assert spark.read.parquet(path).count() == stored == 5


def test_loaded_star_answers_metrics(loaded):
    _, t = loaded
    spec = {"expression": {"type": "AGGREGATION", "function": "COUNT"}, "groupBy": ["geo"]}
    assert M.metric(t, spec).agg(F.sum("value")).first()[0] == t["fact_balance"].count()
    assert M.reference_dates(t).count() > 1


def test_reference_date_prunes_fact_partitions(loaded):
    _, t = loaded
    day = M.reference_dates(t, latest=1).first()[0]
    df = M.metric(t, {"expression": {"type": "AGGREGATION", "function": "SUM", "field": "amount"}}, at=day)
    assert "dynamicpruning" in text(df)
    assert "amount:bigint>" in text(df) and "soldeorigine" not in text(df)


def test_pages_and_pages_after_a_key(loaded):
    _, t = loaded
    page = P.balance_page(t, 7, 13)
    rows = [r["id"] for r in page.items.collect()]
    assert len(rows) == 13 and page.total_pages == -(-page.total_elements // 13)
    assert P.balance_page(t, 10**6, 13).items.count() == 0
    facts, seen, last = t["fact_balance"], [], None
    for _ in range(8):
        seen += [r["id"] for r in P.page_after(facts, "id", last, 13).collect()]
        last = seen[-1]
    assert seen[7 * 13 :] == rows
    assert P.page_after(facts, "id", 2**62).count() == 0


def test_quality_counts_agree_with_clean(spark):
    for name, rules in (("stg_tiers", Q.CUSTOMERS), ("stg_contrat", Q.CONTRACTS)):
        raw = staging(spark, SF, name)
        gone = Q.deletion_counts(raw, rules).first()
        assert raw.count() == Q.clean(raw, rules).count() + gone["total"]


def test_numbering_is_stable_whatever_the_order(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    a = D.number_rows(df, ["k"], 10).orderBy("k").collect()
    b = D.number_rows(df.orderBy(F.desc("k")).repartition(7), ["k"], 10).orderBy("k").collect()
    assert a == b
    assert sorted(r["id"] for r in a) == list(range(11, 5011))


def test_null_keys_are_inserted_once(spark):
    old = spark.createDataFrame([(1, "a", None)], "id bigint, x string, y string")
    new = spark.createDataFrame([("a", None), (None, None), ("b", "c")], "x string, y string")
    fresh = D.insert_ignore(old, new, ["x", "y"])
    assert sorted((r["id"], r["x"] or "") for r in fresh.collect()) in ([(2, ""), (3, "b")], [(2, "b"), (3, "")])


def test_first_arrival_wins_and_group_names_are_steady(spark):
    rows = spark.createDataFrame([(2, "k", "late"), (1, "k", "early"), (3, "m", "x")], "n int, k string, v string")
    assert sorted((r["k"], r["v"]) for r in D.first_per_key(rows, "k", "n").collect()) == [("k", "early"), ("m", "x")]
    groups = spark.createDataFrame([(7, "B "), (7, " A"), (None, "C")], "grpaffaires int, nomgrpaffaires string")
    assert [tuple(r) for r in D.groups(groups).collect()] == [(7, "A")]


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_ledger_is_scanned_twice_and_a_reload_writes_no_table(spark, cleaned, tmp_path):
    customers, contracts, ledger = cleaned
    ledger = written(ledger, work_folder(spark))
    rows, read = ledger.count(), spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = ledger.mapInArrow(passed, ledger.schema)
    root = str(tmp_path)
    D.load_datamart(spark, customers, contracts, watched, root)
    assert rows < read.value <= 2 * rows
    before, read.value = files(root), 0
    D.load_datamart(spark, customers, contracts, watched, root)
    assert files(root) == before and rows < read.value <= 2 * rows


def test_rows_of_one_hash_are_told_apart(spark):
    """The hash finds candidates, the values decide, and NULL equals NULL."""
    rows = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, 1, "b"), (2, None, None)], "x int, y int, z string")
    stored = spark.createDataFrame([(1, None, "a"), (2, None, None), (1, 1, "c")], "x int, y int, z string")
    keys = ["x", "y", "z"]
    want = {(None, 1, "a"), (1, 1, "b")}
    for hashed in (D.row_hash(keys), F.lit(7).cast("bigint")):
        a, b = (df.withColumn("row_hash", hashed) for df in (rows, stored))
        new = D.not_stored(a, b, keys)
        assert {(r.x, r.y, r.z) for r in new.collect()} == want
    left, right = (spark.createDataFrame([v], "x int, y int").select(D.row_hash(["x", "y"]).alias("h")).first().h for v in ((None, 5), (5, None)))
    assert left != right


def test_stored_facts_are_joined_on_their_hash_alone(spark, loaded):
    _, t = loaded
    keys = [*D.FACT_KEYS, *D.MEASURES]
    plan = text(D.not_stored(t["fact_balance"], t["fact_balance"], keys))
    joins = re.findall(r"Left keys \[(\d+)\]", plan)
    assert joins == ["1"] and "BroadcastNestedLoopJoin" not in plan


def test_only_new_facts_and_members_come(spark, cleaned, tmp_path):
    customers, contracts, ledger = cleaned
    root = str(tmp_path)
    some = ledger.where("id % 3 = 0 AND agence <> '4'")
    first = D.load_datamart(spark, customers, contracts, some, root)
    facts, agencies = first["fact_balance"].count(), first["sub_dim_agence"].collect()
    second = D.load_datamart(spark, customers, contracts, ledger, root)
    assert second["fact_balance"].count() == D.fact_rows(ledger, second).count() > facts
    assert second["fact_balance"].agg(F.count_distinct("id")).first()[0] == second["fact_balance"].count()
    assert set(agencies) <= set(second["sub_dim_agence"].collect())


def test_empty_staging_gives_empty_tables(spark, cleaned, tmp_path):
    none = [df.limit(0) for df in cleaned]
    for _ in range(2):
        t = D.load_datamart(spark, *none, str(tmp_path))
        counts = {r["table"]: r["rows"] for r in D.table_counts(t, D.TABLES).collect()}
        assert {n for n, c in counts.items() if c} == set(D.LABELS)
    t = D.load_datamart(spark, *cleaned, str(tmp_path))
    assert t["fact_balance"].count() and t["sub_dim_grpaffaire"].count()


def test_labels_are_seeded_once(spark, tmp_path):
    root = str(tmp_path)
    one = {n: df.count() for n, df in D.seed_labels(spark, root).items()}
    before = files(root)
    assert {n: df.count() for n, df in D.seed_labels(spark, root).items()} == one and files(root) == before
    assert one == {"sub_dim_agenteco": 25, "sub_dim_sectionactivite": 89, "sub_dim_objetfinance": 7}


def test_stored_rows_are_numbered_without_a_shuffle(spark):
    rows = written(spark.range(0, 5000, 1, 7).withColumnRenamed("id", "k"), work_folder(spark))
    out = D.number_stored(rows, 10)
    assert sorted(r["id"] for r in out.collect()) == list(range(11, 5011))
    assert sorted(r["k"] for r in out.collect()) == list(range(5000)) and out.columns == ["id", "k"]
    assert "rangepartitioning" not in text(out) and "hashpartitioning(k" not in text(out)


def test_copies_need_no_shuffle_after_the_accounts(spark, cleaned, loaded):
    """Contracts, clients and accounts are a shuffle of the ledger each, the copies none; also with rows repeated and null."""
    (_, _, ledger), (_, tables) = cleaned, loaded
    odd = ledger.limit(40).select([F.when(F.col("id") % 2 == 0, F.col(c)).alias(c) if c in ("compte", "idcontrat") else c for c in ledger.columns])
    ledger = ledger.unionByName(odd).unionByName(odd)
    shuffles = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(shuffles)
    spark.conf.set(shuffles, "-1")
    try:
        plain, fewer = D.fact_rows(ledger, tables), D.fact_rows(ledger, tables, accounts_known=True)
        count = lambda df: text(df).split("\n\n")[0].count("Exchange (")
        assert count(fewer) == count(plain) - 1
    finally:
        spark.conf.set(shuffles, old)
    assert fewer.columns == plain.columns and fewer.count() == plain.count() == plain.distinct().count()
    assert fewer.exceptAll(plain).count() == 0


def test_ledger_members_are_the_dimensions_of_several_passes(spark, cleaned):
    ledger = cleaned[2]
    pool = D.ledger_members(ledger).distinct()
    one = lambda n: {tuple(r) for r in D.pooled(pool, n, D.POOLED[n]).collect()}
    for name, rows in (("sub_dim_agence", D.agencies(ledger)), ("sub_dim_devise", D.currencies(ledger, "devise", "devisebbnq")),
                       ("sub_dim_chapitre", D.chapters(ledger)), ("sub_dim_date", D.dates(ledger, "date_bal"))):
        assert one(name) == {tuple(r) for r in rows.collect()}, name
    assert {tuple(r) for r in D.pooled_accounts(pool).collect()} == {tuple(r) for r in D.accounts(ledger).collect()}

