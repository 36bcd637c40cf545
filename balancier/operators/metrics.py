"""Evaluate metrics over the star: one, many at a date, many for every date."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.functions import predicates as P
from balancier.plans.catalog import CALENDAR, column_of, on_dates, resolve, star
from balancier.plans.specs import Spec, fields_of, has_aggregate, metric_column, read_spec, reading_of, row_value, scalar_column

DATE_FIELD = "subDimDate.dateValue"


def _as_date(value: str | date) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def rows_at(tables: Mapping[str, DataFrame], fields: Iterable[str], at: str | date | None = None) -> DataFrame:
    """The star's rows, or those of one date."""
    if at is None:
        return star(tables, fields)
    day = F.lit(_as_date(at))
    dated = on_dates(tables, tables[CALENDAR].filter(F.col("date_value") == day))
    return star(dated, [*fields, DATE_FIELD]).filter(column_of(DATE_FIELD) == day)


def order_keys(order_by: Iterable[tuple[str, bool]]) -> list[Column]:
    keys = []
    for name, ascending in order_by:
        col = F.col("value") if name.lower() == "value" else F.col(resolve(name).flat)
        keys.append(col.asc_nulls_last() if ascending else col.desc_nulls_last())
    return keys


def metric(tables: Mapping[str, DataFrame], raw: Mapping, at: str | date | None = None) -> DataFrame:
    """One metric: a ``value`` column, with its group columns, order and limit if any."""
    spec = read_spec(raw)
    rows = rows_at(tables, fields_of(spec, with_order=True), at or None)
    if spec.where is not None:
        rows = rows.filter(P.predicate(spec.where))
    groups = [column_of(g).alias(resolve(g).flat) for g in spec.group_by]
    if has_aggregate(spec.expression):
        value = metric_column(spec.expression, reading=reading_of(rows)).alias("value")
        out = rows.groupBy(*groups).agg(value) if groups else rows.agg(value)
    else:
        keep = [c for name, _ in spec.order_by if name.lower() != "value" for c in [resolve(name).flat]]
        out = rows.select(*dict.fromkeys(keep), row_value(spec.expression).cast("double").alias("value"))
    if spec.order_by:
        out = out.orderBy(*order_keys(spec.order_by))
    return out.limit(spec.limit) if spec.limit else out


def metric_columns(specs: Mapping[str, Spec], rows: DataFrame) -> list[Column]:
    """Scalar metrics as aggregate Columns named by code, each with its own row filter."""
    reading = reading_of(rows)
    return [scalar_column(s, reading).alias(code) for code, s in specs.items()]


def read_scalars(raw: Mapping[str, Mapping]) -> dict[str, Spec]:
    return {code: read_spec(r) for code, r in raw.items()}


def metrics_at(tables: Mapping[str, DataFrame], raw: Mapping[str, Mapping], at: str | date | None = None) -> DataFrame:
    """All scalar metrics in one row, from a single scan of the star."""
    specs = read_scalars(raw)
    rows = rows_at(tables, [f for s in specs.values() for f in fields_of(s)], at or None)
    return rows.agg(*metric_columns(specs, rows))


def metrics_by_date(
    tables: Mapping[str, DataFrame], raw: Mapping[str, Mapping], only: DataFrame | None = None
) -> DataFrame:
    """All scalar metrics for every reference date, or those in ``only``: one grouped pass."""
    specs = read_scalars(raw)
    fields = [*(f for s in specs.values() for f in fields_of(s)), DATE_FIELD]
    day = column_of(DATE_FIELD)
    if only is None:
        rows = star(tables, fields).filter(day.isNotNull())
    else:
        wanted = F.broadcast(only.select(F.col("reference_date").alias("_wanted")).distinct())  # dates
        days = tables[CALENDAR].join(wanted, F.col("date_value") == F.col("_wanted"), "left_semi")
        rows = star(on_dates(tables, days), fields).join(wanted, day == F.col("_wanted"), "left_semi")
    return rows.groupBy(day.alias("reference_date")).agg(*metric_columns(specs, rows))


def distinct_counts(rows: DataFrame, ids: str, wanted: Mapping[str, Column | None], groups: Iterable[str] = ()) -> DataFrame:
    """Exact counts of distinct ``ids``, one for each filter in ``wanted``, in one pass.

    ``ids`` are dense numbers from 0 on, as surrogate keys are; NULL counts for nothing. A count is
    the number of bits in bitmaps of 32,768 ids each, so rows are not multiplied by the number of
    filters, as several COUNT(DISTINCT) would do, and a hot id is one bit in every task.
    """
    groups, one = list(groups), F.bitmap_bit_position(F.col(ids))
    hits = {name: F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)) for name, cond in wanted.items()}
    hits = {name: F.col(ids).isNotNull() & hit for name, hit in hits.items()}
    flagged = rows.select(
        *groups, F.bitmap_bucket_number(F.col(ids)).alias("_bucket"), *[F.when(hit, one).alias(f"_{n}") for n, hit in hits.items()]
    )
    maps = [F.expr(f"bitmap_construct_agg(`_{n}`) FILTER (WHERE `_{n}` IS NOT NULL)").alias(n) for n in hits]
    counted = flagged.groupBy(*groups, "_bucket").agg(*maps).select(*groups, *[F.bitmap_count(n).alias(n) for n in hits])
    return counted.groupBy(*groups).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in hits])


def to_long(wide: DataFrame, codes: Iterable[str], keys: Iterable[str] = (), code: str = "code", value: str = "value") -> DataFrame:
    """Metric columns -> (keys, code, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(code), F.col(f"`{c}`").alias(value)) for c in codes])
    return wide.select(*keys, F.inline(pairs))


def reference_dates(tables: Mapping[str, DataFrame], latest: int | None = None) -> DataFrame:
    """Distinct dates that have facts, oldest first; or the latest few, newest first."""
    ids = tables["fact_balance"].select(F.col("id_date").alias("k")).distinct()
    days = (
        ids.join(tables["sub_dim_date"], F.col("k") == F.col("id"), "inner")
        .filter(F.col("date_value").isNotNull())
        .select(F.col("date_value").alias("reference_date"))
        .distinct()
    )
    if latest is None:
        return days.orderBy("reference_date")
    return days.orderBy(F.desc("reference_date")).limit(latest if latest > 0 else 5)


def scope(requested: Iterable[str], catalog: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(catalog rows asked for, requested codes that do not exist)."""
    wanted = list(dict.fromkeys(c.strip() for c in requested if c and c.strip()))
    asked = catalog.sparkSession.createDataFrame([(c,) for c in wanted], f"{code} string")
    found = catalog.join(asked, code, "left_semi")
    missing = asked.join(found.select(code).distinct(), code, "left_anti")
    return found, missing
