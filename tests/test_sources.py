import pytest
from pyspark.sql import functions as F

from balancier.operators import ratios as R
from balancier.sources import load as L
from balancier.sources import readers, tabular

MAPPING = [
    {"table_source": s, "table_target": f"staging.{t}", "column_source": "a", "column_target": "id"}
    for s, t in (("x", "stg_tiers_raw"), ("y", "stg_contrat_raw"), ("z", "stg_compta_raw"))
]


def test_plans_check_the_mapping():
    plans = L.plans(MAPPING)
    assert plans["stg_contrat_raw"] == ("y", {"a": "id"})
    with pytest.raises(ValueError, match="nothing feeds"):
        L.plans(MAPPING[:2])
    with pytest.raises(ValueError, match="is read from"):
        L.plans([*MAPPING, {**MAPPING[0], "table_source": "other"}])
    with pytest.raises(ValueError, match="goes to"):
        L.plans([*MAPPING, {**MAPPING[0], "column_target": "other"}])


def test_projection(spark):
    src = spark.createDataFrame([(" 7 ", " x "), ("", " ")], "a string, b string")
    types = {"id": "bigint", "name": "string", "date_bal": "string"}
    rows = L.project(src, {"a": "id", "b": "name"}, types, "31/03/2024").collect()
    assert [tuple(r) for r in rows] == [(7, " x ", "2024-03-31"), (None, None, "2024-03-31")]
    with pytest.raises(ValueError, match="neither side has"):
        L.project(src, {"zz": "id"}, types)
    with pytest.raises(ValueError, match="neither side has"):
        L.project(src, {"a": "zz"}, types)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        L.project(spark.createDataFrame([("x",)], "a string"), {"a": "id"}, types).collect()


def test_only_reconciled_loads_are_read(spark, tmp_path):
    target, log = str(tmp_path / "t"), str(tmp_path / "log")
    rows = spark.range(100).select(F.col("id").cast("string").alias("v"))
    assert L.load_table(rows, target, "L1", 100, log) == 100
    with pytest.raises(ValueError, match="rows were due"):
        L.load_table(rows, target, "L2", 101, log)
    assert L.read_loads(spark, target, log).count() == 100
    L.load_table(rows, target, "L2", 100, log)
    assert L.read_loads(spark, target, log).count() == 200


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    counts = spark.createDataFrame([(1, 2)], "nulls int, duplicates int")
    L.log_run(counts, path)
    L.log_run(counts, path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and got.filter("status = 'COMPLETED' AND executed_at IS NOT NULL").count() == 2


def test_discovery_skips_system_schemas(spark):
    cols = spark.createDataFrame(
        [("public", "B", "y", "int", "YES", 2), ("public", "B", "x", "text", "NO", 1), ("pg_catalog", "p", "c", "int", "NO", 1),
         ("sys", "s", "c", "int", "NO", 1), ("app", "a", "k", "int", "NO", 1)],
        "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int",
    )
    got = readers.discover(cols).collect()
    assert [r["qualified_table"] for r in got] == ["app.a", "public.B"]
    assert [(c["name"], c["nullable"]) for c in got[1]["columns"]] == [("x", False), ("y", True)]
    assert [r["table_name"] for r in readers.discover(cols, "sys").collect()] == ["s"]


def test_spark_catalog_listing(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS default.listed (a INT, b STRING) USING parquet")
    got = readers.discover(readers.spark_columns(spark, "default")).filter("table_name = 'listed'").first()
    assert [c["name"] for c in got["columns"]] == ["a", "b"]


def test_jdbc_options():
    o = readers.jdbc_options("postgresql", "h", 5432, "d", "u", "p")
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["fetchsize"] == "500"
    with pytest.raises(ValueError, match="Unsupported database type"):
        readers.jdbc_options("db2", "h", 1, "d", "u", "p")


def test_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(' Title ,CONTENT,,source\n a , b ,c,\n,,,\n"x","line\ntwo",,s\n')
    got = tabular.read_sheet(spark, str(path), "S1")
    assert got.columns == ["title", "content", "col_2", "source", "row_id", "sheet"]
    rows = [tuple(r)[:4] for r in got.orderBy("row_id").collect()]
    assert rows == [("a", "b", "c", ""), ("x", "line\ntwo", "", "s")]


def test_active_config(spark):
    config = spark.createDataFrame(
        [(1, "A", '{"type":"CONSTANT","value":1}', True), (2, "B", "{}", False)], "id int, code string, formula_json string, is_active boolean"
    )
    assert R.read_config(config) == {"A": (1, {"type": "CONSTANT", "value": 1})}
