"""Plans: joins only as needed, one fact scan, narrow reads, no Python in metric paths."""

from balancier.operators import datamart as D
from balancier.operators import metrics as M
from balancier.operators import quality as Q
from balancier.plans.catalog import star
from checks.staging import staging
from checks.star import SIX, agg, cond
from checks.tables import datamart, table
from tests.plans import nodes, text

SF = "/root/testdata/sf0.001"


def test_no_join_without_dimension_fields(spark):
    # The test fact itself is lineitem joined to orders.
    assert nodes(star(datamart(spark, SF), ["soldeconvertie"]), "Join") == 1


def test_join_chain_is_minimal(spark):
    t = datamart(spark, SF)
    assert nodes(star(t, ["soldeconvertie", "contratActif"]), "Join") == 2
    assert nodes(star(t, ["soldeconvertie", "contratActif", "devisecontrat"]), "Join") == 3


def test_many_metrics_scan_the_fact_once(spark):
    df = M.metrics_at(datamart(spark, SF), {f"m{i}": agg("SUM", "amount", cond("actif", "=", i % 2)) for i in range(50)})
    assert nodes(df, "Scan parquet") == 2  # lineitem and orders
    assert "Python" not in text(df)


def test_all_dates_in_one_pass(spark):
    df = M.metrics_by_date(datamart(spark, SF), SIX)
    assert text(df).count("lineitem.parquet") == 2  # the fact, and the calendar made from it


def test_columns_are_pruned(spark):
    df = M.metric(datamart(spark, SF), {"expression": agg("SUM", "amount")})
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text(df)


def test_row_filter_reaches_the_scan(spark):
    rows = table(spark, SF, "lineitem").filter("l_linenumber > 3").select("l_linenumber")
    assert "GreaterThan(l_linenumber,3)" in text(rows)


def test_duplicates_never_gather_a_key(spark):
    """No window over the business key: a hot key would land in one task."""
    df = Q.duplicates(staging(spark, SF, "stg_contrat"), Q.CONTRACTS)
    assert nodes(df, "Window") == 0
    assert nodes(Q.drop_duplicates(staging(spark, SF, "stg_contrat"), Q.CONTRACTS), "Window") == 0


def test_numbering_reads_its_input_once(spark):
    keys = D.chapters(staging(spark, SF, "stg_compta"))
    df = D.number_rows(keys, ["chapitre"])
    df.collect()
    assert "ReusedExchange" in text(df)


def test_last_messages_trim_before_the_shuffle(spark):
    from balancier.operators import chatlog as G
    from checks.corpus import MESSAGES
    from checks.tables import view

    assert nodes(G.last_messages(view(spark, SF, MESSAGES), 3), "WindowGroupLimit") == 2
