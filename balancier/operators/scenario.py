"""What-if scenarios: shocks on balances or metrics, compared with the baseline."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from balancier.functions import predicates as P
from balancier.operators import metrics as M
from balancier.operators import ratios as R
from balancier.plans.catalog import SpecError, resolve
from balancier.plans.specs import NEAR_ZERO, fields_of, read_spec, reading_of, scalar_column

# Columns a balance shock may change, its operations, tolerances.
SHOCK_FIELDS = ("soldeorigine", "soldeconvertie", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois", "amount")
SHOCK_OPERATIONS = ("SET", "ADD", "SUBTRACT")
METRIC_OPERATIONS = ("MULTIPLY", "ADD", "REPLACE", "MODIFY_FORMULA")
BALANCE_TOLERANCE = Decimal("0.000001")
CHANGE = 1e-9
# Codes that messages of refused scenarios begin with.
INVALID = "INVALID_OPERATION"
UNKNOWN = "UNKNOWN_PARAMETER"
NO_DATA = "NO_DATA_FOR_DATE"
UNBALANCED = "UNBALANCED_SIMULATION"


class Shock(NamedTuple):
    operation: str
    flat: str
    field: str
    value: Decimal
    filters: object


def read_shock(raw: Mapping) -> Shock:
    operation = str(raw.get("operation") or "").strip().upper()
    if operation not in SHOCK_OPERATIONS:
        raise SpecError(f"{INVALID}: {operation or 'operation is required'}")
    if raw.get("value") is None:
        raise SpecError(f"{INVALID}: value is required")
    field = resolve(raw.get("field") or "")
    if field.name not in SHOCK_FIELDS:
        raise SpecError(f"{INVALID}: field {raw['field']} is not adjustable (allowed: {SHOCK_FIELDS})")
    for name in P.fields_in(raw.get("filters") or None):
        resolve(name)  # an unknown one is an error
    return Shock(operation, field.flat, field.name, Decimal(str(raw["value"])), raw.get("filters") or None)


def _exact(dtype: T.DataType, values: Sequence[Decimal]) -> T.DecimalType:
    """A decimal that holds the column and the shock values without loss of digits."""
    precision, scale = (dtype.precision, dtype.scale) if isinstance(dtype, T.DecimalType) else (19, 0)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        precision, scale = 30, 10
    tuples = [v.as_tuple() for v in values]
    wide = max([scale, *(-t.exponent for t in tuples)])
    whole = max([precision - scale, *(len(t.digits) + t.exponent for t in tuples)])
    return T.DecimalType(min(38, whole + 1 + wide), min(wide, 37))


def apply_shocks(rows: DataFrame, shocks: Sequence[Shock]) -> tuple[DataFrame, dict[str, str]]:
    """Add shocked copies of the touched columns; later shocks see what earlier ones did.

    Also adds each shock's change (``_d0``, ``_d1``, …; NULL where it does not match) and
    ``_hit``. Returns the rows and the map original column -> shocked column.
    """
    swap: dict[str, str] = {}
    for flat in dict.fromkeys(s.flat for s in shocks):
        dtype = _exact(rows.schema[flat].dataType, [s.value for s in shocks if s.flat == flat])
        swap[flat] = f"sim_{flat}"
        rows = rows.withColumn(swap[flat], F.col(flat).cast(dtype))
    rows = rows.withColumn("_hit", F.lit(False))
    for i, shock in enumerate(shocks):
        match = F.coalesce(P.predicate(shock.filters, True, swap), F.lit(False)) if shock.filters else F.lit(True)
        sim = swap[shock.flat]
        dtype = rows.schema[sim].dataType
        rows = rows.withColumn(f"_m{i}", match)
        current, by = F.coalesce(F.col(sim), F.lit(0).cast(dtype)), F.lit(shock.value).cast(dtype)
        after = {"SET": by, "ADD": current + by, "SUBTRACT": current - by}[shock.operation].cast(dtype)
        rows = rows.withColumns(
            {
                f"_d{i}": F.when(F.col(f"_m{i}"), (after - current).cast(dtype)),
                sim: F.when(F.col(f"_m{i}"), after).otherwise(F.col(sim)),
                "_hit": F.col("_hit") | F.col(f"_m{i}"),
            }
        )
    return rows, swap


def total_columns(shocks: Sequence[Shock]) -> list[Column]:
    """Aggregates: increases, decreases, rows touched at least once, rows each shock matched."""
    up = [F.coalesce(F.sum(F.when(F.col(f"_d{i}") > 0, F.col(f"_d{i}"))), F.lit(0)) for i in range(len(shocks))]
    down = [F.coalesce(F.sum(F.when(F.col(f"_d{i}") < 0, -F.col(f"_d{i}"))), F.lit(0)) for i in range(len(shocks))]
    exact = "decimal(38,10)"  # the fact's own scale: 28 digits before the point
    return [
        sum((c.cast(exact) for c in up[1:]), up[0].cast(exact)).alias("positive_delta"),
        sum((c.cast(exact) for c in down[1:]), down[0].cast(exact)).alias("negative_delta"),
        F.count_if("_hit").alias("rows_touched"),
        F.count(F.lit(1)).alias("rows_read"),
        *[F.count_if(f"_m{i}").alias(f"matched_{i}") for i in range(len(shocks))],
    ]


def with_verdict(totals: DataFrame) -> DataFrame:
    """Both sums to six places, their difference, and whether they balance."""
    six = [F.round(c, 6).cast("decimal(38,6)") for c in ("positive_delta", "negative_delta")]
    gap = F.abs(six[0] - six[1])
    return totals.withColumns({"difference": gap, "balanced": gap <= F.lit(BALANCE_TOLERANCE)})


def shock_totals(tables: Mapping[str, DataFrame], raw: Sequence[Mapping], at: str | date | None = None) -> DataFrame:
    shocks = [read_shock(s) for s in raw]
    rows, _ = apply_shocks(_rows(tables, [], shocks, at), shocks)
    return with_verdict(rows.agg(*total_columns(shocks)))


def _rows(tables: Mapping[str, DataFrame], fields: Iterable[str], shocks: Sequence[Shock], at: str | date | None) -> DataFrame:
    names = [*fields, *(s.field for s in shocks), *(f for s in shocks for f in P.fields_in(s.filters))]
    return M.rows_at(tables, names, at)


# --- which metrics and ratios a change reaches ------------------------------------


def field_edges(spark: SparkSession, metrics: Mapping[str, Mapping]) -> DataFrame:
    """(field, metric) for every canonical field a metric reads; ordering does not count."""
    pairs = [(f.lower(), code) for code, raw in metrics.items() for f in _safe_fields(raw)]
    return spark.createDataFrame(pairs, "field string, metric string").distinct()


def ratio_edges(spark: SparkSession, ratios: Mapping[str, Mapping]) -> DataFrame:
    """(metric, ratio)."""
    pairs = [(c, code) for code, tree in ratios.items() for c in _safe_codes(tree)]
    return spark.createDataFrame(pairs, "metric string, ratio string").distinct()


def _safe_fields(raw: Mapping) -> list[str]:
    try:
        return fields_of(read_spec(raw))
    except SpecError:
        return []


def _safe_codes(tree: Mapping) -> list[str]:
    try:
        return R.codes_of(tree)
    except (SpecError, KeyError, TypeError):
        return []


def reached(fields: Iterable[str], metrics: Mapping[str, Mapping], ratios: Mapping[str, Mapping]) -> tuple[set[str], set[str]]:
    """Metrics and ratios that depend on the fields."""
    touched = {resolve(f).name for f in fields}
    hit = {code for code, raw in metrics.items() if touched & set(_safe_fields(raw))}
    return hit, {code for code, tree in ratios.items() if hit & set(_safe_codes(tree))}


# --- impacts ------------------------------------------------------------------------


def impacts(pairs: DataFrame, reached_codes: Iterable[str], changed_only: bool = True) -> DataFrame:
    """(code, original, simulated) -> difference, percentage and flags."""
    delta = F.col("simulated") - F.col("original")
    unevaluable = F.isnan("original") | F.isnan("simulated")
    small = F.abs("original") < NEAR_ZERO
    percent = F.when(unevaluable, F.lit(float("nan"))).when(~small, delta / F.when(~small, F.col("original")) * 100)
    out = pairs.withColumns(
        {
            "delta": delta,
            "impact_percent": percent,
            "impacted": F.col("code").isin(*reached_codes) if reached_codes else F.lit(False),
            "changed": ~unevaluable & (F.abs(delta) > CHANGE),
        }
    )
    return out.filter("changed") if changed_only else out


class Outcome(NamedTuple):
    totals: dict  # sums of changes, rows read and touched; empty for metric shocks
    metrics: DataFrame
    ratios: DataFrame


def _compare(
    spark: SparkSession, before: Mapping[str, float], after: Mapping[str, float], ratios: Mapping[str, Mapping],
    hit: tuple[set[str], set[str]], changed_only: bool, stored: DataFrame | None, ids: Mapping[str, int],
) -> tuple[DataFrame, DataFrame]:
    """Impact tables from the one value each metric has before and after."""
    schema = "code string, original double, simulated double"
    metric_pairs = spark.createDataFrame([(c, before[c], after[c]) for c in before], schema)
    names = list(before)
    wide = spark.createDataFrame(
        [Row(*[before[c] for c in names], *[after[c] for c in names])],
        T.StructType([T.StructField(p + c, T.DoubleType()) for p in ("b_", "s_") for c in names]),
    )
    cells = []
    for code, tree in ratios.items():
        known = set(_safe_codes(tree))
        try:
            tree_in = _with_zero(tree, known - set(names))
            pair = R.ratio_column(tree_in, "zero", "b_"), R.ratio_column(tree_in, "zero", "s_")
        except (SpecError, KeyError, TypeError):
            pair = F.lit(float("nan")), F.lit(float("nan"))
        cells.append(F.struct(F.lit(code).alias("code"), pair[0].alias("original"), pair[1].alias("simulated")))
    ratio_pairs = wide.select(F.inline(F.array(*cells))) if cells else spark.createDataFrame([], schema)
    ratio_impacts = impacts(ratio_pairs, hit[1], changed_only)
    if stored is not None:
        by_code = spark.createDataFrame([(c, i) for c, i in ids.items()], "code string, id_ratios bigint")
        shown = stored.select("id_ratios", F.col("ratios_value").alias("dashboard_value"))
        ratio_impacts = ratio_impacts.join(by_code, "code", "left").join(shown, "id_ratios", "left").drop("id_ratios")
    return impacts(metric_pairs, hit[0], changed_only), ratio_impacts


def _with_zero(tree: Mapping, unknown: set[str]) -> Mapping:
    """The tree with metrics that have no value as the constant 0."""
    if str(tree.get("type", "")).strip().upper() == "PARAM":
        return {"type": "CONSTANT", "value": 0} if tree["code"].strip() in unknown else tree
    if "left" in tree:
        return {**tree, "left": _with_zero(tree["left"], unknown), "right": _with_zero(tree["right"], unknown)}
    return tree


def _stored_at(dashboard: DataFrame | None, at) -> DataFrame | None:
    if dashboard is None or at is None:
        return None
    return dashboard.filter(F.col("reference_date") == F.lit(M._as_date(at)))


def _specs(metrics: Mapping[str, Mapping]) -> tuple[dict, list[str]]:
    good, broken = {}, []
    for code, raw in metrics.items():
        try:
            good[code] = read_spec(raw)
        except SpecError:
            broken.append(code)
    return good, broken


def balance_scenario(
    tables: Mapping[str, DataFrame], metrics: Mapping[str, Mapping], ratios: Mapping[str, Mapping],
    raw: Sequence[Mapping], at: str | date | None = None, changed_only: bool = True,
    dashboard: DataFrame | None = None, ratio_ids: Mapping[str, int] | None = None,
) -> Outcome:
    """Shock balances and compare all metrics and ratios, in one pass over the facts.

    Totals, baseline and shocked metrics are aggregates of the same scan; only metrics
    that read a shocked column have a second aggregate. Raises when there are no rows at
    the date or the changes do not balance.
    """
    shocks = [read_shock(s) for s in raw]
    specs, broken = _specs(metrics)
    hit = reached([s.field for s in shocks], metrics, ratios)
    rows = _rows(tables, [f for s in specs.values() for f in fields_of(s)], shocks, at)
    rows, swap = apply_shocks(rows, shocks)
    base, shocked = reading_of(rows, None, True), reading_of(rows, swap, True)
    columns = [scalar_column(s, base).alias(f"b_{c}") for c, s in specs.items()]
    columns += [scalar_column(s, shocked).alias(f"s_{c}") for c, s in specs.items() if c in hit[0]]
    one = with_verdict(rows.agg(*total_columns(shocks), *columns)).first().asDict()
    totals = {k: v for k, v in one.items() if not k.startswith(("b_", "s_"))}
    if one["rows_read"] == 0:
        latest = [r[0].isoformat() for r in M.reference_dates(tables, 5).collect()]
        raise SpecError(f"{NO_DATA}: {at}; available dates: {latest}")
    if not one["balanced"]:
        raise SpecError(
            f"{UNBALANCED}: positive={one['positive_delta']}, negative={one['negative_delta']}, difference={one['difference']}"
        )
    nan = float("nan")
    before = {c: one[f"b_{c}"] if c in specs else nan for c in metrics}
    after = {c: one.get(f"s_{c}", before[c]) for c in metrics}
    spark = tables["fact_balance"].sparkSession
    frames = _compare(spark, before, after, ratios, hit, changed_only, _stored_at(dashboard, at), ratio_ids or {})
    return Outcome(totals, *frames)


def metric_scenario(
    tables: Mapping[str, DataFrame], metrics: Mapping[str, Mapping], ratios: Mapping[str, Mapping],
    adjustments: Sequence[Mapping], at: str | date | None = None, changed_only: bool = True,
    catalog: Mapping[str, Mapping] | None = None, dashboard: DataFrame | None = None,
    ratio_ids: Mapping[str, int] | None = None,
) -> Outcome:
    """Shock metric values. Each shock starts from the baseline; the last on a code wins."""
    everything = {**(catalog or {}), **metrics}
    last: dict[str, Mapping] = {}
    for adj in adjustments:
        code, operation = str(adj.get("code") or "").strip(), str(adj.get("operation") or "").strip().upper()
        if operation not in METRIC_OPERATIONS:
            raise SpecError(f"{INVALID}: {operation or 'operation is required'}")
        if code not in everything:
            raise SpecError(f"{UNKNOWN}: {code}")
        if adj.get("formula" if operation == "MODIFY_FORMULA" else "value") is None:
            raise SpecError(f"{INVALID}: {operation} needs a {'formula' if operation == 'MODIFY_FORMULA' else 'value'}")
        last[code] = {**adj, "operation": operation}
    scoped = {**metrics, **{c: everything[c] for c in last}}
    specs, _ = _specs(scoped)
    formulas = {c: read_spec(a["formula"]) for c, a in last.items() if a["operation"] == "MODIFY_FORMULA"}
    rows = _rows(tables, [f for s in (*specs.values(), *formulas.values()) for f in fields_of(s)], [], at)
    reading = reading_of(rows, None, True)
    columns = [scalar_column(s, reading).alias(f"b_{c}") for c, s in specs.items()]
    columns += [scalar_column(s, reading).alias(f"n_{c}") for c, s in formulas.items()]
    one = rows.agg(F.count(F.lit(1)).alias("rows_read"), *columns).first().asDict()
    if one["rows_read"] == 0:
        raise SpecError(f"{NO_DATA}: {at}")
    nan = float("nan")
    before = {c: one.get(f"b_{c}", nan) for c in scoped}
    after = dict(before)
    for code, adj in last.items():
        value = None if adj["operation"] == "MODIFY_FORMULA" else float(adj["value"])
        after[code] = {
            "MULTIPLY": lambda: before[code] * value, "ADD": lambda: before[code] + value,
            "REPLACE": lambda: value, "MODIFY_FORMULA": lambda: one[f"n_{code}"],
        }[adj["operation"]]()
    hit = set(last), {code for code, tree in ratios.items() if set(last) & set(_safe_codes(tree))}
    spark = tables["fact_balance"].sparkSession
    frames = _compare(spark, before, after, ratios, hit, changed_only, _stored_at(dashboard, at), ratio_ids or {})
    return Outcome({"rows_read": one["rows_read"]}, *frames)


def diagnostics(tables: Mapping[str, DataFrame], at: str | date | None = None) -> DataFrame:
    """One row: facts at the date, facts in all, the ten latest dates."""
    per_id = tables["fact_balance"].groupBy("id_date").agg(F.count(F.lit(1)).alias("n"))
    days = tables["sub_dim_date"].select(F.col("id").alias("_d"), "date_value")
    dated = per_id.join(days, F.col("id_date") == F.col("_d"), "left")
    day = F.lit(M._as_date(at)).cast("date") if at is not None else F.lit(None).cast("date")
    ten = dated.select("date_value").where("date_value IS NOT NULL").distinct().orderBy(F.col("date_value").desc()).limit(10)
    latest = ten.agg(F.sort_array(F.collect_list("date_value"), asc=False).alias("available_dates"))
    totals = dated.agg(
        F.coalesce(F.sum(F.when(F.col("date_value") == day, F.col("n"))), F.lit(0)).alias("rows_for_date"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )
    one = F.lit(1)  # both sides are a single row
    return totals.withColumn("_one", one).join(latest.withColumn("_one", one), "_one").select(day.alias("reference_date"), "rows_for_date", "total_rows", "available_dates")
