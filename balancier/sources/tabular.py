"""Sheets and delimited files whose first row names the columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(rows: DataFrame) -> DataFrame:
    """Trimmed text cells, lower-case names, blank names as col_N, no all-blank rows."""
    names = [c.strip().lower() if c.strip() and not c.startswith("_c") else f"col_{i}" for i, c in enumerate(rows.columns)]
    cells = rows.toDF(*[f"_{i}" for i in range(len(names))])
    clean = cells.select(*[F.coalesce(F.trim(F.col(f"_{i}").cast("string")), F.lit("")).alias(n) for i, n in enumerate(names)])
    return clean.filter(reduce(operator.or_, [F.col(f"`{n}`") != "" for n in names if n != "row_id"]))


def read_sheet(spark: SparkSession, path: str, sheet: str, **options: str) -> DataFrame:
    """A CSV file as a sheet: its rows with the sheet's name and, as an id, file order."""
    raw = spark.read.options(header="true", multiLine="true", escape='"', **options).csv(path)
    data = tidy(raw.withColumn("row_id", F.monotonically_increasing_id()))
    return data.withColumns({"sheet": F.lit(sheet), "row_id": F.col("row_id").cast("bigint")})
