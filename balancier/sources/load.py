"""Mapped loads into staging, reconciled before they count."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Typed columns of the staging tables; every other column is text.
STAGING_TARGETS = ("stg_tiers_raw", "stg_contrat_raw", "stg_compta_raw")
STAGING_TYPES = {"id": "bigint", "grpaffaires": "int", "residencenum": "int"}


def coerce(c: Column, dtype: str) -> Column:
    """Blank -> NULL; text keeps its spaces; typed values are trimmed and cast.

    A value that does not fit its type stops the load, as the cast raises.
    """
    text = c.cast("string")
    filled = F.when(F.trim(text) != "", text)
    return filled if dtype == "string" else F.trim(filled).cast(dtype)


def plans(mapping: Iterable[Mapping[str, Any]]) -> dict[str, tuple[str, dict[str, str]]]:
    """Mapping rows -> target table: (source table, {source column: target column}).

    A target reads one table, a column goes to one place, and every staging table is fed.
    """
    tables: dict[str, dict[str, str]] = defaultdict(dict)
    columns: dict[str, dict[str, dict[str, str]]] = defaultdict(lambda: defaultdict(dict))
    for row in mapping:
        target, source, src, tgt = (row[k].strip() for k in ("table_target", "table_source", "column_source", "column_target"))
        target = target.lower().rpartition(".")[2]
        tables[target].setdefault(source.lower(), source)
        columns[target][src].setdefault(tgt.lower(), tgt)
    faults = [f"{t} is read from {sorted(s.values())}" for t, s in tables.items() if len(s) > 1]
    faults += [f"{t}: {c} goes to {sorted(g.values())}" for t, own in columns.items() for c, g in own.items() if len(g) > 1]
    faults += [f"nothing feeds {t}" for t in STAGING_TARGETS if t not in tables]
    if faults:
        raise ValueError("; ".join(faults))
    only = lambda d: next(iter(d.values()))
    return {t: (only(s), {c: only(g) for c, g in columns[t].items()}) for t, s in tables.items()}


def project(source: DataFrame, mapping: Mapping[str, str], types: Mapping[str, str], date_bal: str | None = None) -> DataFrame:
    """Source columns under their target names and types.

    ``date_bal`` (dd/MM/yyyy) fills that column when the mapping lacks it.
    """
    here = {c.lower() for c in source.columns}
    lost = [c for c in mapping if c.lower() not in here] + [c for c in mapping.values() if c not in types]
    if lost:
        raise ValueError(f"mapped columns that neither side has: {lost}")
    cols = [coerce(F.col(src), types[tgt]).alias(tgt) for src, tgt in mapping.items()]
    if date_bal is not None and "date_bal" not in {t.lower() for t in mapping.values()}:
        day = datetime.strptime(date_bal, "%d/%m/%Y").date()
        cols.append(F.lit(day).cast(types.get("date_bal", "date")).alias("date_bal"))
    return source.select(*cols)


def load_table(rows: DataFrame, target: str, load_id: str, source_rows: int, log: str) -> int:
    """Write one load and publish it only if every source row arrived.

    Rows land in the target's folder of this load. A load counts once its line is in
    the log, so a short or failed one is never read; repeating a load id replaces it.
    """
    spark = rows.sparkSession
    seen = Observation("load")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").parquet(f"{target}/load_id={load_id}")
    read = seen.get["rows"]
    stored = spark.read.parquet(f"{target}/load_id={load_id}").count()
    if not (read == stored == source_rows):
        raise ValueError(f"{target}: {source_rows} rows were due, {read} came, {stored} are stored")
    line = spark.createDataFrame([(target, load_id, read, "COMPLETED")], "target string, load_id string, rows long, status string")
    line.withColumn("executed_at", F.current_timestamp()).write.mode("append").parquet(log)
    return read


def read_loads(spark: SparkSession, target: str, log: str) -> DataFrame:
    """Rows of the published loads."""
    ids = spark.read.parquet(log).filter((F.col("target") == target) & (F.col("status") == "COMPLETED"))
    return spark.read.parquet(target).join(ids.select(F.col("load_id").cast("string").alias("load_id")).distinct(), "load_id", "left_semi")


def log_run(counts: DataFrame, path: str) -> None:
    """Append one line of quality counters with status and time."""
    counts.withColumns({"status": F.lit("COMPLETED"), "executed_at": F.current_timestamp()}).write.mode("append").parquet(path)
