"""Readers for source tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# JDBC address and driver class of each supported database.
DIALECTS = {
    "POSTGRESQL": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "MYSQL": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "SQLSERVER": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "ORACLE": ("jdbc:oracle:thin:@{host}:{port}:{database}", "oracle.jdbc.OracleDriver"),
}
# Schemas that hold no user tables, beside any starting with pg_.
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys", "system", "xdb", "sysaux")
FETCH_SIZE = 500


def jdbc_options(db_type: str, host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    try:
        url, driver = DIALECTS[db_type.strip().upper().replace("_", "")]
    except KeyError:
        raise ValueError(f"Unsupported database type: {db_type}") from None
    return {
        "url": url.format(host=host, port=port, database=database), "driver": driver,
        "user": user, "password": password, "fetchsize": str(FETCH_SIZE),
    }


def read_jdbc(
    spark: SparkSession, options: Mapping[str, str], table: str, split_on: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 32,
) -> DataFrame:
    """A database table. With a numeric ``split_on`` column, many tasks read it in ranges.

    Without ``bounds`` the column's lowest and highest value are asked first.
    """
    reader = spark.read.format("jdbc").options(**options)
    if split_on is None:
        return reader.option("dbtable", table).load()
    if bounds is None:
        ends = reader.option("query", f"SELECT MIN({split_on}) AS lo, MAX({split_on}) AS hi FROM {table}").load().first()
        if ends[0] is None:
            return spark.read.format("jdbc").options(**options).option("dbtable", table).load()
        bounds = int(ends[0]), int(ends[1])
    return (
        spark.read.format("jdbc").options(**options).option("dbtable", table)
        .option("partitionColumn", split_on).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
        .option("numPartitions", partitions).load()
    )


def read_files(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def discover(columns: DataFrame, schema: str | None = None) -> DataFrame:
    """information_schema.columns rows -> one row per table with its columns.

    Needs table_schema, table_name, column_name, data_type, is_nullable and
    ordinal_position. System schemas are skipped unless one schema is asked for.
    """
    name = F.lower(F.coalesce("table_schema", F.lit("")))
    if schema and schema.strip():
        kept = columns.filter(F.col("table_schema") == schema.strip())
    else:
        kept = columns.filter(~(name.startswith("pg_") | name.isin(*SYSTEM_SCHEMAS)))
    qualified = F.concat_ws(".", F.nullif("table_schema", F.lit("")), "table_name")
    one = F.struct(
        F.col("ordinal_position").alias("position"), F.col("column_name").alias("name"),
        F.col("data_type").alias("type"), (F.upper("is_nullable") == "YES").alias("nullable"),
    )
    return (
        kept.groupBy(qualified.alias("qualified_table"), "table_schema", "table_name")
        .agg(F.sort_array(F.collect_list(one)).alias("columns"))  # bounded by a table's width
        .orderBy(F.lower("qualified_table"))
    )


def spark_columns(spark: SparkSession, database: str) -> DataFrame:
    """The same listing input for tables of the Spark catalog."""
    rows = [
        (database, t.name, c.name, c.dataType, "YES" if c.nullable else "NO", i)
        for t in spark.catalog.listTables(database) if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)
    ]
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"
    )
