"""The stored series of ratio values: filling, listing, thresholds, trends."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.operators import metrics as M
from balancier.operators import ratios as R
from balancier.operators import states as S
from balancier.operators.datamart import not_yet_in, number_rows
from balancier.plans.catalog import CALENDAR, SpecError, on_dates
from balancier.session import work_folder, written

PAIR = ["id_ratios", "reference_date"]


def missing_pairs(ratio_ids: Iterable[int], dates: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Every (ratio, date) the dashboard lacks."""
    ids = F.array(*[F.lit(int(i)).cast("bigint") for i in ratio_ids])
    pairs = dates.select(F.explode(ids).alias("id_ratios"), "reference_date")
    return pairs if existing is None else not_yet_in(pairs, existing.select(*PAIR), PAIR)


class Fill(NamedTuple):
    rows: DataFrame  # id_ratios, code, reference_date, value, error for each missing pair
    report: DataFrame  # dates_found, ratios_processed, inserted, skipped, errors


def fill(
    tables: Mapping[str, DataFrame], ratios: Mapping[str, tuple[int, Mapping]], catalog: Mapping[str, Mapping],
    existing: DataFrame | None = None, states: str | None = None,
) -> Fill:
    """Evaluate every missing (ratio, date) pair in one grouped pass over the facts.

    Only dates that lack some ratio are read. With ``states``, the folder where metric states
    are kept, these are refreshed from facts they do not know yet, and dates and values come
    from them. A value that cannot be computed has an error instead; such rows are for
    reporting and are not stored.
    """
    spark = tables["fact_balance"].sparkSession
    broken, good = {}, {}
    for code, (ident, tree) in ratios.items():
        try:
            R.needed_metrics({code: tree}, catalog)
            good[code] = (ident, tree)
        except SpecError as error:
            broken[code] = (ident, str(error))
    needed = R.needed_metrics({code: tree for code, (_, tree) in good.items()}, catalog)
    kept = None
    if states is not None and needed:
        S.refresh(tables, needed, states)
        kept = S.metrics_by_date(tables, needed, states)
    # A row for each date, or ratio and date; what is read more than once is written.
    if kept is not None:
        wide = written(kept, work_folder(spark))
        dates = wide.select("reference_date")
        todo = written(missing_pairs([i for i, _ in ratios.values()], dates, existing), work_folder(spark))
    else:
        calendar = written(tables[CALENDAR].filter(F.col("date_value").isNotNull()), work_folder(spark))
        days = calendar.select(F.col("date_value").alias("reference_date")).distinct()
        todo = written(missing_pairs([i for i, _ in ratios.values()], days, existing), work_folder(spark))
        dates, rest = M.reference_dates(tables), calendar.join(todo, F.col("date_value") == F.col("reference_date"), "left_anti")
        if good:  # the pass finds which of its dates have facts; only the other dates are looked for
            wide = written(M.metrics_by_date(tables, needed, todo), work_folder(spark))
            dates = wide.select("reference_date").unionByName(M.reference_dates(on_dates(tables, rest))).distinct()
        dates = written(dates, work_folder(spark))
    schema = "id_ratios bigint, code string, value double, error string"
    parts = []
    if good:
        cells = []
        for code, (ident, tree) in good.items():
            value = R.ratio_column(tree)
            error = F.when(value.isNull(), F.lit(R.ZERO_MESSAGE))
            cells.append(F.struct(F.lit(ident).cast("bigint").alias("id_ratios"), F.lit(code).alias("code"),
                                  value.alias("value"), error.alias("error")))
        parts.append(wide.select("reference_date", F.inline(F.array(*cells))))
    for code, (ident, reason) in broken.items():
        parts.append(dates.select("reference_date", F.lit(ident).cast("bigint").alias("id_ratios"), F.lit(code).alias("code"),
                                  F.lit(None).cast("double").alias("value"), F.lit(reason).alias("error")))
    if parts:
        cells = parts[0]
        for p in parts[1:]:
            cells = cells.unionByName(p)
    else:
        cells = spark.createDataFrame([], "reference_date date, " + schema)
    rows = cells.join(todo, PAIR, "left_semi").select("id_ratios", "code", "reference_date", "value", "error")
    one = F.lit(1)  # both sides are a single row
    days = dates.agg(F.count(one).alias("dates_found")).withColumn("_one", one)
    report = rows.agg(F.count_if(F.col("error").isNull()).alias("inserted"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    report = report.withColumn("_one", one).join(days, "_one").select(
        "dates_found", F.lit(len(ratios)).cast("bigint").alias("ratios_processed"), "inserted",
        (F.col("dates_found") * len(ratios) - F.col("inserted") - F.col("errors")).cast("bigint").alias("skipped"), "errors",
    )
    return Fill(rows, report)


def to_store(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Fill rows as numbered dashboard rows, ready to append."""
    good = rows.filter(F.col("error").isNull()).select("id_ratios", F.col("value").alias("ratios_value"), "reference_date")
    top = 0 if existing is None else existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return number_rows(good, PAIR, top).withColumn("created_at", F.current_timestamp())


def manual_value(existing: DataFrame, ratio_id: int, day: date, value: float) -> DataFrame:
    """The row to append for a value entered by hand; refuses a pair that exists."""
    taken = existing.filter((F.col("id_ratios") == ratio_id) & (F.col("reference_date") == F.lit(day)))
    if taken.take(1):
        raise ValueError(f"ratio {ratio_id} has a value for {day}")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = existing.sparkSession.createDataFrame([(top + 1, ratio_id, value, day)], "id bigint, id_ratios bigint, ratios_value double, reference_date date")
    return row.withColumn("created_at", F.current_timestamp())


def enriched(rows: DataFrame, config: DataFrame, families: DataFrame, categories: DataFrame, day: date | None = None) -> DataFrame:
    """Dashboard rows with the ratio's labels, thresholds, family and category."""
    if day is not None:
        rows = rows.filter(F.col("reference_date") == F.lit(day))
    ratio = config.select(F.col("id").alias("id_ratios"), "code", "label", "description", "famille_id", "categorie_id",
                          "seuil_tolerance", "seuil_alerte", "seuil_appetence")
    family = families.select(F.col("id").alias("famille_id"), F.col("name").alias("famille_code"))
    category = categories.select(F.col("id").alias("categorie_id"), F.col("name").alias("categorie_code"))
    out = rows.join(ratio, "id_ratios", "left").join(family, "famille_id", "left").join(category, "categorie_id", "left")
    order = ["id"] if day is not None else ["reference_date", "id_ratios", "id"]
    return out.select(
        "id", "id_ratios", "code", "label", "description", "famille_id", "categorie_id", "famille_code", "categorie_code",
        "seuil_tolerance", "seuil_alerte", "seuil_appetence", F.col("ratios_value").alias("value"), "reference_date",
    ).orderBy(*order)


def _coded(rows: DataFrame, config: DataFrame) -> DataFrame:
    """One value per (code, date); ratios without a code go by their id."""
    names = config.select(F.col("id").alias("id_ratios"), F.nullif(F.trim("code"), F.lit("")).alias("code"))
    named = rows.join(names, "id_ratios", "left").withColumn("code", F.coalesce("code", F.concat(F.lit("id_"), "id_ratios")))
    return named.groupBy("code", "reference_date").agg(F.max_by("ratios_value", F.struct("id_ratios", "id")).alias("value"))


def by_ratio(rows: DataFrame, config: DataFrame) -> DataFrame:
    """(code, values): a map date -> value in date order. A group has one entry per date."""
    entry = F.struct(F.col("reference_date").cast("string").alias("d"), F.col("value"))
    series = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return _coded(rows, config).groupBy("code").agg(series.alias("values")).orderBy("code")


def wide_by_ratio(rows: DataFrame, config: DataFrame, dates: Iterable[date]) -> DataFrame:
    """A row per ratio, a column per date."""
    coded = _coded(rows, config).withColumn("d", F.col("reference_date").cast("string"))
    return coded.groupBy("code").pivot("d", [str(d) for d in dates]).agg(F.first("value")).orderBy("code")


def severity(value: Column, appetite: Column, alert: Column, tolerance: Column) -> Column:
    """The first threshold the value falls under; thresholds that are not set are passed over."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value < appetite, "CRITICAL")
        .when(value < alert, "ALERT")
        .when(value < tolerance, "WARNING")
        .otherwise("HEALTHY")
    )


def threshold_status(listing: DataFrame) -> DataFrame:
    """Rows of ``enriched`` that have a value, with their severity."""
    status = severity(F.col("value"), F.col("seuil_appetence"), F.col("seuil_alerte"), F.col("seuil_tolerance"))
    return listing.withColumn("severity", status).filter(F.col("severity").isNotNull())


def severity_counts(listing: DataFrame) -> DataFrame:
    """Per date how many ratios have a value, and how many of each severity."""
    status = threshold_status(listing)
    counts = [F.count_if(F.col("severity") == level.upper()).alias(level) for level in ("critical", "alert", "warning", "healthy")]
    return status.groupBy("reference_date").agg(F.count(F.lit(1)).alias("ratios"), *counts)


def trend_points(rows: DataFrame, config: DataFrame, codes: Iterable[str], dates: Iterable[date]) -> DataFrame:
    """(code, date, value) for every asked code and date; NULL where nothing is stored."""
    spark = rows.sparkSession
    asked = [(c.strip(), d) for c in dict.fromkeys(codes) for d in dict.fromkeys(dates)]
    grid = spark.createDataFrame(asked, "code string, reference_date date")
    have = _coded(rows, config).select(F.upper("code").alias("_c"), F.col("reference_date").alias("_d"), "value")
    return grid.join(have, (F.upper("code") == F.col("_c")) & (F.col("reference_date") == F.col("_d")), "left").drop("_c", "_d")


def trend(points: DataFrame) -> DataFrame:
    """First and last stored value of each code, the change, its percentage and direction."""
    day = F.when(F.col("value").isNotNull(), F.col("reference_date"))
    ends = points.groupBy("code").agg(F.min_by("value", day).alias("first"), F.max_by("value", day).alias("last"))
    delta = F.coalesce(F.col("last") - F.col("first"), F.lit(0.0))
    percent = F.coalesce(delta / F.nullif("first", F.lit(0.0)) * 100, F.lit(0.0))
    way = F.when(delta > 0.001, "IMPROVING").when(delta < -0.001, "DETERIORATING").otherwise("STABLE")
    return ends.select("code", "first", "last", delta.alias("delta"), percent.alias("percent_change"), way.alias("direction"))
