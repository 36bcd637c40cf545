"""Ratios, dashboard series and scenarios."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from balancier.operators import dashboard as B
from balancier.operators import metrics as M
from balancier.operators import ratios as R
from balancier.operators import scenario as X
from balancier.operators import states as S
from balancier.plans.catalog import star
from balancier.session import work_folder, written
from checks.registry import ORACLE, check
from checks.star import agg, cond, field, op, value
from checks.tables import DATAMART_VIEWS, datamart, star_sql, with_views

METRICS = {
    "FPE": agg("SUM", "soldeconvertie", cond("grpaffaire", "=", "BUILDING")),
    "RCR": agg("SUM", expression=op("MULTIPLY", field("soldeconvertie"), value(0.15))),
    "RM": agg("SUM", "cumulmvtdb"),
    "RO": agg("SUM", "cumulmvtcr"),
    "TOEXP": {"expression": agg("SUM", "amount"), "where": cond("actif", "=", 1)},
    "ENC": agg("COUNT"),
    "SNT": agg("SUM", "soldeorigine", cond("chapitre", ">=", 2000)),
    "NIL": agg("SUM", "soldeinitdebmois", cond("amount", ">", 1000)),
}
METRICS_SQL = """
    coalesce(CAST(sum(CASE WHEN gaf.nomgrpaffaires = 'BUILDING' THEN {v} END) AS DOUBLE), 0) AS FPE,
    coalesce(CAST(sum({v} * 0.15) AS DOUBLE), 0) AS RCR,
    coalesce(CAST(sum(f.cumulmvtdb) AS DOUBLE), 0) AS RM,
    coalesce(CAST(sum(f.cumulmvtcr) AS DOUBLE), 0) AS RO,
    coalesce(CAST(sum(CASE WHEN f.actif = 1 THEN {a} END) AS DOUBLE), 0) AS TOEXP,
    CAST(count(*) AS DOUBLE) AS ENC,
    coalesce(CAST(sum(CASE WHEN ch.chapitre >= 2000 THEN f.soldeorigine END) AS DOUBLE), 0) AS SNT,
    coalesce(CAST(sum(CASE WHEN {a} > 1000 THEN f.soldeinitdebmois END) AS DOUBLE), 0) AS NIL"""
PLAIN_SQL = METRICS_SQL.replace("{v}", "f.soldeconvertie").replace("{a}", "f.amount")


def param(code):
    return {"type": "PARAM", "code": code}


def const(v):
    return {"type": "CONSTANT", "value": v}


RATIOS = {
    "RS": op("MULTIPLY", op("DIVIDE", param("FPE"), op("ADD", param("RCR"), param("RM"))), const(100)),
    "RL": op("DIVIDE", param("FPE"), param("SNT")),
    "COEL": op("DIVIDE", op("SUBTRACT", param("SNT"), param("RO")), const(2.0)),
    "RLCT": op("DIVIDE", param("TOEXP"), param("ENC")),
    "BAD": op("DIVIDE", param("FPE"), param("NIL")),
}
IDS = {code: i for i, code in enumerate(RATIOS, 1)}


def _div(left: str, right: str, on_zero: str = "NULL") -> str:
    return f"CASE WHEN abs({right}) < 1e-12 THEN {on_zero} ELSE ({left}) / ({right}) END"


def ratios_sql(on_zero: str = "NULL", p: str = "") -> dict[str, str]:
    return {
        "RS": f"({_div(p + 'FPE', f'({p}RCR + {p}RM)', on_zero)}) * 100",
        "RL": _div(p + "FPE", p + "SNT", on_zero),
        "COEL": f"({p}SNT - {p}RO) / 2.0",
        "RLCT": _div(p + "TOEXP", p + "ENC", on_zero),
        "BAD": _div(p + "FPE", p + "NIL", on_zero),
    }


_HEAD, _TAIL = star_sql(f"dtf.date_value AS reference_date, {PLAIN_SQL}", "WHERE dtf.date_value IS NOT NULL GROUP BY 1").rsplit("\nSELECT dtf.date_value", 1)
BY_DATE = f"{_HEAD},\nm AS (SELECT dtf.date_value{_TAIL})"
LONG = BY_DATE + ",\ncells AS (" + " UNION ALL ".join(
    f"SELECT {IDS[c]} AS id_ratios, '{c}' AS code, reference_date, {e} AS value FROM m" for c, e in ratios_sql().items()
) + ")"
# Stored already: ratios 1 to 3 in odd months. A dashboard id is ratio, then month.
STORED = LONG + """,
stored AS (SELECT id_ratios * 1000000 + year(reference_date) * 100 + month(reference_date) AS id, id_ratios, value AS ratios_value, reference_date
    FROM cells WHERE id_ratios <= 3 AND month(reference_date) % 2 = 1),
config AS (SELECT id, code, label, description, famille_id, categorie_id, CAST(t AS DOUBLE) AS seuil_tolerance,
    CAST(a AS DOUBLE) AS seuil_alerte, CAST(p AS DOUBLE) AS seuil_appetence FROM (VALUES
    (1, 'RS', 'Solvabilite', 'a', 1, 1, 120.0, 119.0, 118.0), (2, 'RL', 'Levier', 'b', 2, 1, 0.31, 0.3, 0.28),
    (3, 'COEL', 'Liquidite', NULL, NULL, 9, 9e6, NULL, 100.0)) v(id, code, label, description, famille_id, categorie_id, t, a, p))"""
CONFIG = [
    (1, "RS", "Solvabilite", "a", 1, 1, 120.0, 119.0, 118.0),
    (2, "RL", "Levier", "b", 2, 1, 0.31, 0.3, 0.28),
    (3, "COEL", "Liquidite", None, None, 9, 9e6, None, 100.0),
]


def _config(spark):
    return spark.createDataFrame(
        CONFIG,
        "id bigint, code string, label string, description string, famille_id bigint, categorie_id bigint, "
        "seuil_tolerance double, seuil_alerte double, seuil_appetence double",
    )


def _wide(spark, sf_dir):
    return M.metrics_by_date(datamart(spark, sf_dir), METRICS)


def _stored(spark, sf_dir):
    """A dashboard that holds ratios 1 to 3 for odd months, stored as one is."""
    trees = {c: RATIOS[c] for c in ("RS", "RL", "COEL")}
    tables, day = datamart(spark, sf_dir), F.col("reference_date")
    odd = tables["sub_dim_date"].select(F.col("date_value").alias("reference_date")).filter(F.month(day) % 2 == 1)
    wide = M.metrics_by_date(tables, R.needed_metrics(trees, METRICS), odd)
    long = R.ratios_long(wide, trees, ["reference_date"])
    ids = F.create_map(*[F.lit(x) for c in trees for x in (c, IDS[c])])
    rows = long.withColumn("id_ratios", ids[F.col("code")].cast("bigint"))
    ident = F.col("id_ratios") * 1000000 + F.year(day) * 100 + F.month(day)
    rows = rows.select(ident.alias("id"), "id_ratios", F.col("value").alias("ratios_value"), "reference_date")
    return written(rows, work_folder(spark))


@check("ratio_values", BY_DATE + " SELECT reference_date, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in ratios_sql().items()) + " FROM m")
def ratio_values(spark, sf_dir):
    wide = R.ratios_wide(_wide(spark, sf_dir), RATIOS, ["reference_date"])
    return wide.select("reference_date", *[F.round(c, 6).alias(c) for c in RATIOS])


@check("ratio_values_configured", BY_DATE + " SELECT reference_date, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in ratios_sql().items() if c != "RL") + " FROM m")
def ratio_values_configured(spark, sf_dir):
    """Ratios as the active rows of a configuration table define them; RL is switched off there."""
    rows = [(i, c, json.dumps(RATIOS[c]), c != "RL") for c, i in IDS.items()]
    config = spark.createDataFrame(rows, "id bigint, code string, formula_json string, is_active boolean")
    trees = {c: tree for c, (_, tree) in R.read_config(config).items()}
    wide = R.ratios_wide(_wide(spark, sf_dir), trees, ["reference_date"])
    return wide.select("reference_date", *[F.round(c, 6).alias(c) for c in trees])


@check("ratio_values_zero", BY_DATE + " SELECT reference_date, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in ratios_sql("0").items()) + " FROM m")
def ratio_values_zero(spark, sf_dir):
    wide = R.ratios_wide(_wide(spark, sf_dir), RATIOS, ["reference_date"], on_zero="zero")
    return wide.select("reference_date", *[F.round(c, 6).alias(c) for c in RATIOS])


@check(
    "ratio_long",
    LONG + """ SELECT c.reference_date, c.code, round(c.value, 6) AS value,
    CASE c.code WHEN 'RS' THEN 3 ELSE 2 END AS inputs,
    round(CASE c.code WHEN 'RLCT' THEN m.TOEXP WHEN 'COEL' THEN m.SNT ELSE m.FPE END, 2) AS first_input,
    round(CASE c.code WHEN 'RS' THEN m.RCR WHEN 'RL' THEN m.SNT WHEN 'COEL' THEN m.RO WHEN 'RLCT' THEN m.ENC ELSE m.NIL END, 2) AS second_input
    FROM cells c JOIN m USING (reference_date)""",
)
def ratio_long(spark, sf_dir):
    long = R.ratios_long(_wide(spark, sf_dir), RATIOS, ["reference_date"])
    named = {"RS": ("FPE", "RCR"), "RL": ("FPE", "SNT"), "COEL": ("SNT", "RO"), "RLCT": ("TOEXP", "ENC"), "BAD": ("FPE", "NIL")}
    pair = [F.create_map(*[F.lit(x) for code, own in named.items() for x in (code, own[i])])[F.col("code")] for i in (0, 1)]
    return long.select(
        "reference_date", "code", F.round("value", 6).alias("value"), F.size("inputs").alias("inputs"),
        F.round(F.col("inputs")[pair[0]], 2).alias("first_input"), F.round(F.col("inputs")[pair[1]], 2).alias("second_input"),
    )


@check(
    "dashboard_missing",
    STORED + """ SELECT r.id_ratios, m.reference_date FROM m, (SELECT DISTINCT id_ratios FROM cells) r
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.id_ratios = r.id_ratios AND s.reference_date = m.reference_date)""",
)
def dashboard_missing(spark, sf_dir):
    dates = M.reference_dates(datamart(spark, sf_dir))
    return B.missing_pairs(IDS.values(), dates, _stored(spark, sf_dir))


_FILLED = """(SELECT * FROM cells c WHERE NOT EXISTS
    (SELECT 1 FROM stored s WHERE s.id_ratios = c.id_ratios AND s.reference_date = c.reference_date))"""


@check(
    "dashboard_fill",
    STORED + f""" SELECT id_ratios, code, reference_date, round(value, 6) AS value,
    CASE WHEN value IS NULL THEN 'Division by zero is not allowed' END AS error FROM {_FILLED}""",
)
def dashboard_fill(spark, sf_dir):
    ratios = {c: (IDS[c], tree) for c, tree in RATIOS.items()}
    rows = B.fill(datamart(spark, sf_dir), ratios, METRICS, _stored(spark, sf_dir)).rows
    return rows.withColumn("value", F.round("value", 6))


@check(
    "dashboard_fill_report",
    STORED + f""" SELECT (SELECT count(*) FROM m) AS dates_found, CAST(5 AS BIGINT) AS ratios_processed, count(value) AS inserted,
    (SELECT count(*) FROM stored) AS skipped, count(*) - count(value) AS errors FROM {_FILLED}""",
)
def dashboard_fill_report(spark, sf_dir):
    ratios = {c: (IDS[c], tree) for c, tree in RATIOS.items()}
    return B.fill(datamart(spark, sf_dir), ratios, METRICS, _stored(spark, sf_dir)).report


KEPT = {
    **METRICS,
    "MEAN": agg("AVG", "soldeorigine", cond("amount", ">", 10)),
    "LEAST": agg("MIN", "soldeconvertie"),
    "MOST": agg("MAX", "cumulmvtdb", cond("pays", "<>", "NATION_3")),
    "ACCOUNTS": {"expression": agg("COUNT", "numcompte", distinct=True), "where": cond("actif", "=", 1)},
    "STEPS": agg("SUM", "amount", cond("grpaffaire", "=", "BUILDING"), distinct=True),
}
KEPT_SQL = METRICS_SQL + """,
    CAST(sum(CASE WHEN {a} > 10 THEN f.soldeorigine END) AS DOUBLE) / nullif(count(CASE WHEN {a} > 10 THEN f.soldeorigine END), 0) AS MEAN,
    CAST(min({v}) AS DOUBLE) AS LEAST, CAST(max(CASE WHEN res.pays <> 'NATION_3' THEN f.cumulmvtdb END) AS DOUBLE) AS MOST,
    CAST(count(DISTINCT CASE WHEN f.actif = 1 THEN c.numcompte END) AS DOUBLE) AS ACCOUNTS,
    CAST(sum(DISTINCT CASE WHEN gaf.nomgrpaffaires = 'BUILDING' THEN {a} END) AS DOUBLE) AS STEPS"""


def _first_load(spark, sf_dir):
    """The datamart with the lower half of the fact ids, as an earlier load would leave it."""
    tables = datamart(spark, sf_dir)
    half = tables["fact_balance"].agg(F.max("id")).first()[0] or 0
    tables["fact_balance"] = tables["fact_balance"].filter(F.col("id") <= half // 2)
    return tables


@check("metrics_kept", star_sql(
    "dtf.date_value AS reference_date, " + KEPT_SQL.replace("{v}", "f.soldeconvertie").replace("{a}", "f.amount"),
    "WHERE dtf.date_value IS NOT NULL GROUP BY 1",
))
def metrics_kept(spark, sf_dir):
    """States of some metrics at a first load; all of them, with late facts of every date, at a second."""
    root = work_folder(spark)
    S.refresh(_first_load(spark, sf_dir), {c: KEPT[c] for c in list(KEPT)[::2]}, root)
    tables = datamart(spark, sf_dir)
    S.refresh(tables, KEPT, root)
    out = S.metrics_by_date(tables, KEPT, root)
    return out.select("reference_date", *[F.coalesce(c, F.lit(0.0)).alias(c) if c in METRICS else c for c in KEPT])


@check("dashboard_fill_kept", ORACLE["dashboard_fill"])
def dashboard_fill_kept(spark, sf_dir):
    """The fill from kept states, refreshed after a second load."""
    ratios, root = {c: (IDS[c], tree) for c, tree in RATIOS.items()}, work_folder(spark)
    S.refresh(_first_load(spark, sf_dir), METRICS, root)
    rows = B.fill(datamart(spark, sf_dir), ratios, METRICS, _stored(spark, sf_dir), states=root).rows
    return rows.withColumn("value", F.round("value", 6))


@check("dashboard_new_ratio", LONG + " SELECT 7 AS id_ratios, 'RL' AS code, reference_date, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS error FROM cells WHERE code = 'RL'")
def dashboard_new_ratio(spark, sf_dir):
    rows = B.fill(datamart(spark, sf_dir), {"RL": (7, RATIOS["RL"])}, METRICS).rows
    return rows.withColumn("value", F.round("value", 6))


@check(
    "dashboard_manual",
    STORED + " SELECT max(id) + 1 AS id, 9 AS id_ratios, CAST(1.5 AS DOUBLE) AS ratios_value, DATE '1997-05-01' AS reference_date FROM stored",
)
def dashboard_manual(spark, sf_dir):
    """A value entered by hand; a second one for the same ratio and date is refused."""
    existing = _stored(spark, sf_dir)
    row = B.manual_value(existing, 9, date(1997, 5, 1), 1.5).drop("created_at")
    try:
        B.manual_value(row, 9, date(1997, 5, 1), 2.5)
    except ValueError:
        return row
    raise AssertionError("a pair was stored twice")


_LISTING = """SELECT s.id, s.id_ratios, c.code, c.label, c.description, c.famille_id, c.categorie_id, f.name AS famille_code, k.name AS categorie_code,
    c.seuil_tolerance, c.seuil_alerte, c.seuil_appetence, round(s.ratios_value, 6) AS value, s.reference_date FROM stored s
    LEFT JOIN config c ON c.id = s.id_ratios LEFT JOIN (VALUES (1, 'Solidite'), (2, 'Structure')) f(id, name) ON f.id = c.famille_id
    LEFT JOIN (VALUES (1, 'Prudentiel')) k(id, name) ON k.id = c.categorie_id"""


def _listing(spark, sf_dir, day=None):
    families = spark.createDataFrame([(1, "Solidite"), (2, "Structure")], "id bigint, name string")
    categories = spark.createDataFrame([(1, "Prudentiel")], "id bigint, name string")
    return B.enriched(_stored(spark, sf_dir), _config(spark), families, categories, day)


@check("dashboard_enriched", STORED + " " + _LISTING)
def dashboard_enriched(spark, sf_dir):
    return _listing(spark, sf_dir).withColumn("value", F.round("value", 6))


@check("dashboard_at_date", STORED + " " + _LISTING + " WHERE s.reference_date = DATE '1997-05-01'")
def dashboard_at_date(spark, sf_dir):
    return _listing(spark, sf_dir, date(1997, 5, 1)).withColumn("value", F.round("value", 6))


@check(
    "dashboard_by_ratio",
    STORED + """ SELECT coalesce(c.code, concat('id_', s.id_ratios)) AS code, reference_date::VARCHAR AS reference_date, round(ratios_value, 6) AS value,
    row_number() OVER (PARTITION BY s.id_ratios ORDER BY reference_date) AS place FROM stored s LEFT JOIN config c ON c.id = s.id_ratios AND c.id < 3""",
)
def dashboard_by_ratio(spark, sf_dir):
    """Every entry of every series, with its place."""
    series = B.by_ratio(_stored(spark, sf_dir), _config(spark).filter("id < 3"))
    entries = series.select("code", F.posexplode(F.map_entries("values")).alias("place", "entry"))
    return entries.select("code", F.col("entry.key").alias("reference_date"), F.round("entry.value", 6).alias("value"), (F.col("place") + 1).cast("bigint").alias("place"))


@check(
    "dashboard_wide",
    STORED + """ SELECT c.code, round(max(CASE WHEN reference_date = DATE '1996-01-01' THEN ratios_value END), 6) AS "1996-01-01",
    round(max(CASE WHEN reference_date = DATE '1996-03-01' THEN ratios_value END), 6) AS "1996-03-01"
    FROM stored s JOIN config c ON c.id = s.id_ratios GROUP BY 1""",
)
def dashboard_wide(spark, sf_dir):
    days = [date(1996, 1, 1), date(1996, 3, 1)]
    wide = B.wide_by_ratio(_stored(spark, sf_dir), _config(spark), days)
    return wide.select("code", *[F.round(f"`{d}`", 6).alias(str(d)) for d in days])


@check(
    "threshold_status",
    STORED + f""" SELECT code, reference_date, CASE WHEN value < seuil_appetence THEN 'CRITICAL' WHEN value < seuil_alerte THEN 'ALERT'
    WHEN value < seuil_tolerance THEN 'WARNING' ELSE 'HEALTHY' END AS severity FROM ({_LISTING}) WHERE value IS NOT NULL""",
)
def threshold_status(spark, sf_dir):
    return B.threshold_status(_listing(spark, sf_dir)).select("code", "reference_date", "severity")


@check(
    "severity_counts",
    STORED + f""" SELECT reference_date, count(*) AS ratios, count(*) FILTER (value < seuil_appetence) AS critical,
    count(*) FILTER (NOT coalesce(value < seuil_appetence, false) AND value < seuil_alerte) AS alert,
    count(*) FILTER (NOT coalesce(value < seuil_appetence, false) AND NOT coalesce(value < seuil_alerte, false) AND value < seuil_tolerance) AS warning,
    count(*) FILTER (NOT coalesce(value < seuil_appetence, false) AND NOT coalesce(value < seuil_alerte, false) AND NOT coalesce(value < seuil_tolerance, false)) AS healthy
    FROM ({_LISTING}) WHERE value IS NOT NULL GROUP BY 1""",
)
def severity_counts(spark, sf_dir):
    return B.severity_counts(_listing(spark, sf_dir))


_DAYS = [date(1996, 1, 1), date(1996, 2, 1), date(1997, 3, 1), date(2001, 9, 1), date(2030, 1, 1)]
_TREND = STORED + """, asked AS (SELECT w.code, d.d FROM (VALUES ('RS'), ('RL'), ('coel'), ('NONE')) w(code),
    (VALUES (DATE '1996-01-01'), (DATE '1996-02-01'), (DATE '1997-03-01'), (DATE '2001-09-01'), (DATE '2030-01-01')) d(d)),
    points AS (SELECT a.code, a.d AS reference_date, s.ratios_value AS value FROM asked a LEFT JOIN
    (SELECT c.code, s.reference_date, s.ratios_value FROM stored s JOIN config c ON c.id = s.id_ratios) s
    ON s.code = upper(a.code) AND s.reference_date = a.d)"""


def _points(spark, sf_dir):
    return B.trend_points(_stored(spark, sf_dir), _config(spark), ["RS", "RL", "coel", "NONE"], _DAYS)


@check("ratio_trend_points", _TREND + " SELECT code, reference_date, round(value, 6) AS value FROM points")
def ratio_trend_points(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("value", F.round("value", 6))


@check(
    "ratio_trend",
    _TREND + """, ends AS (SELECT code, arg_min(value, reference_date) FILTER (value IS NOT NULL) AS first, arg_max(value, reference_date) FILTER (value IS NOT NULL) AS last
    FROM points GROUP BY code) SELECT code, round(first, 6) AS first, round(last, 6) AS last, round(coalesce(last - first, 0), 6) AS delta,
    round(coalesce((last - first) / nullif(first, 0) * 100, 0), 6) AS percent_change,
    CASE WHEN last - first > 0.001 THEN 'IMPROVING' WHEN last - first < -0.001 THEN 'DETERIORATING' ELSE 'STABLE' END AS direction FROM ends""",
)
def ratio_trend(spark, sf_dir):
    out = B.trend(_points(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("first", "last", "delta", "percent_change")})


SHOCKS = [
    {"operation": "ADD", "field": "soldeconvertie", "value": 5, "filters": cond("subDimChapitre.chapitre", "STARTS_WITH", "21")},
    {"operation": "SUBTRACT", "field": "soldeconvertie", "value": 0.0009751911, "filters": {"logic": "AND", "conditions": [cond("chapitre", "STARTS_WITH", "20"), cond("raisonsoc", "LIKE", "build%")]}},
    {"operation": "SET", "field": "amount", "value": 12, "filters": cond("soldeconvertie", ">", 30000)},
]
_SHOCKED = star_sql("f.id, f.soldeconvertie AS v0, f.amount AS a0, ch.chapitre, cl.raisonsoc").rsplit("\nSELECT f.id, f.soldeconvertie", 1)
SHOCKED = f"""{_SHOCKED[0]},
s0 AS (SELECT f.id, f.soldeconvertie{_SHOCKED[1]}),
s1 AS (SELECT *, chapitre::VARCHAR LIKE '21%' AS m0, CASE WHEN chapitre::VARCHAR LIKE '21%' THEN v0 + 5 ELSE v0 END::DECIMAL(30,10) AS v1 FROM s0),
s2 AS (SELECT *, chapitre::VARCHAR LIKE '20%' AND lower(raisonsoc) LIKE 'build%' AS m1, CASE WHEN chapitre::VARCHAR LIKE '20%' AND lower(raisonsoc) LIKE 'build%' THEN v1 - 0.0009751911 ELSE v1 END::DECIMAL(30,10) AS v2 FROM s1),
s3 AS (SELECT *, v2 > 30000 AS m2, CASE WHEN v2 > 30000 THEN 12 ELSE a0 END AS a1 FROM s2)"""


@check("shock_apply", SHOCKED + " SELECT id, CAST(v2 AS DOUBLE) AS soldeconvertie, CAST(a1 AS DOUBLE) AS amount, m0 OR m1 OR m2 AS touched FROM s3")
def shock_apply(spark, sf_dir):
    shocks = [X.read_shock(s) for s in SHOCKS]
    rows, swap = X.apply_shocks(star(datamart(spark, sf_dir), ["id", "soldeconvertie", "amount", "chapitre", "raisonsoc"]), shocks)
    return rows.select(
        F.col("f_id").alias("id"), F.col(swap["f_soldeconvertie"]).cast("double").alias("soldeconvertie"),
        F.col(swap["f_amount"]).cast("double").alias("amount"), F.col("_hit").alias("touched"),
    )


@check(
    "shock_balance",
    SHOCKED + """, t AS (SELECT sum(CASE WHEN m0 THEN 5 ELSE 0 END) + sum(CASE WHEN m2 AND a1 > a0 THEN a1 - a0 ELSE 0 END) AS p,
    sum(CASE WHEN m1 THEN 0.0009751911 ELSE 0 END) + sum(CASE WHEN m2 AND a1 < a0 THEN a0 - a1 ELSE 0 END) AS n,
    count(CASE WHEN m0 OR m1 OR m2 THEN 1 END) AS rows_touched, count(*) AS rows_read, count(CASE WHEN m0 THEN 1 END) AS matched_0,
    count(CASE WHEN m1 THEN 1 END) AS matched_1, count(CASE WHEN m2 THEN 1 END) AS matched_2 FROM s3)
    SELECT round(CAST(p AS DOUBLE), 6) AS positive_delta, round(CAST(n AS DOUBLE), 6) AS negative_delta, rows_touched, rows_read, matched_0, matched_1, matched_2,
    round(CAST(abs(p - n) AS DOUBLE), 6) AS difference, abs(p - n) <= 0.000001 AS balanced FROM t""",
)
def shock_balance(spark, sf_dir):
    out = X.shock_totals(datamart(spark, sf_dir), SHOCKS)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("positive_delta", "negative_delta", "difference")})


# Whatever the data, what one shock adds the other takes away.
BALANCED = [
    {"operation": "ADD", "field": "soldeconvertie", "value": 250.75, "filters": cond("grpaffaire", "=", "BUILDING")},
    {"operation": "SUBTRACT", "field": "amount", "value": 250.75, "filters": cond("grpaffaire", "=", "BUILDING")},
]
_SIM = {
    "{v}": "(CASE WHEN gaf.nomgrpaffaires = 'BUILDING' THEN f.soldeconvertie + 250.75 ELSE f.soldeconvertie END)",
    "{a}": "(CASE WHEN gaf.nomgrpaffaires = 'BUILDING' THEN f.amount - 250.75 ELSE f.amount END)",
}
_SIM_SQL = METRICS_SQL
for _k, _v in _SIM.items():
    _SIM_SQL = _SIM_SQL.replace(_k, _v)
for _c in METRICS:
    _SIM_SQL = _SIM_SQL.replace(f" AS {_c}", f" AS s_{_c}")
_B_SQL = PLAIN_SQL
for _c in METRICS:
    _B_SQL = _B_SQL.replace(f" AS {_c}", f" AS b_{_c}")
_AT = "1998-03-01"


def _both(where: str) -> str:
    head, tail = star_sql(f"dtf.date_value, {_B_SQL}, {_SIM_SQL}", where).rsplit("\nSELECT dtf.date_value,", 1)
    return f"{head},\nx AS (SELECT {tail})"


def _impact_sql(pairs: str, impacted: str) -> str:
    return f"""SELECT code, round(original, 4) AS original, round(simulated, 4) AS simulated, round(simulated - original, 4) AS delta,
    round(CASE WHEN abs(original) >= 1e-12 THEN (simulated - original) / original * 100 END, 4) AS impact_percent,
    code IN ({impacted}) AS impacted, abs(simulated - original) > 1e-9 AS changed FROM ({pairs})"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("original", "simulated", "delta", "impact_percent")})


_METRIC_PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS code, b_{c} AS original, s_{c} AS simulated FROM x" for c in METRICS)


@check(
    "scenario_impacts",
    _both(f"WHERE dtf.date_value = DATE '{_AT}' GROUP BY dtf.date_value") + " " + _impact_sql(_METRIC_PAIRS, "'FPE', 'RCR', 'TOEXP', 'NIL'"),
)
def scenario_impacts(spark, sf_dir):
    return _rounded(X.balance_scenario(datamart(spark, sf_dir), METRICS, RATIOS, BALANCED, _AT, changed_only=False).metrics)


_RATIO_PAIRS = " UNION ALL ".join(
    f"SELECT '{c}' AS code, {b} AS original, {s} AS simulated FROM x"
    for (c, b), s in zip(ratios_sql("0", "b_").items(), ratios_sql("0", "s_").values())
)


@check(
    "scenario_ratio_impacts",
    _both("")[:-1]
    + ") " + _impact_sql(_RATIO_PAIRS, "'RS', 'RL', 'RLCT', 'BAD'") + " WHERE abs(simulated - original) > 1e-9",
)
def scenario_ratio_impacts(spark, sf_dir):
    """All dates at once, changed ratios only."""
    return _rounded(X.balance_scenario(datamart(spark, sf_dir), METRICS, RATIOS, BALANCED).ratios)


@check(
    "scenario_ratio_stored",
    STORED + ", x AS" + _both(f"WHERE dtf.date_value = DATE '{_AT}' GROUP BY dtf.date_value").rpartition(",\nx AS")[2]
    + " SELECT i.*, s.ratios_value AS dashboard_value FROM (" + _impact_sql(_RATIO_PAIRS, "'RS', 'RL', 'RLCT', 'BAD'") + ") i "
    + "LEFT JOIN (VALUES " + ", ".join(f"('{c}', {i})" for c, i in IDS.items()) + ") k(code, id) ON k.code = i.code "
    + f"LEFT JOIN stored s ON s.id_ratios = k.id AND s.reference_date = DATE '{_AT}'",
)
def scenario_ratio_stored(spark, sf_dir):
    """One date, every ratio beside the value its dashboard holds."""
    out = X.balance_scenario(
        datamart(spark, sf_dir), METRICS, RATIOS, BALANCED, _AT, changed_only=False, dashboard=_stored(spark, sf_dir), ratio_ids=IDS
    )
    return _rounded(out.ratios)


ADJUSTMENTS = [
    {"operation": "ADD", "code": "RO", "value": 7},
    {"operation": "MULTIPLY", "code": "FPE", "value": 0.85},
    {"operation": "REPLACE", "code": "RM", "value": 1000},
    {"operation": "MULTIPLY", "code": "RO", "value": 2},
    {"operation": "MODIFY_FORMULA", "code": "SNT", "formula": agg("SUM", "amount", cond("pays", "IN", ["NATION_1", "NATION_4"]))},
]


@check(
    "metric_shock",
    _both("")
    + ", y AS ("
    + "SELECT coalesce(CAST(sum(CASE WHEN n_name IN ('NATION_1', 'NATION_4') THEN f.amount END) AS DOUBLE), 0) AS n FROM fact_balance f JOIN customer ON f.id_client = CAST(c_custkey AS VARCHAR) JOIN nation ON c_nationkey = n_nationkey) "
    + _impact_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS code, b_{c} AS original, "
            + {"FPE": "b_FPE * 0.85", "RM": "CAST(1000 AS DOUBLE)", "RO": "b_RO * 2", "SNT": "(SELECT n FROM y)"}.get(c, f"b_{c}")
            + " AS simulated FROM x"
            for c in METRICS
        ),
        "'FPE', 'RM', 'RO', 'SNT'",
    ) + " WHERE abs(simulated - original) > 1e-9",
)
def metric_shock(spark, sf_dir):
    return _rounded(X.metric_scenario(datamart(spark, sf_dir), METRICS, RATIOS, ADJUSTMENTS).metrics)


@check(
    "dependency_values",
    LONG + """ SELECT code, reference_date, round(value, 6) AS value FROM cells WHERE code IN ('RS', 'RL', 'COEL', 'BAD')
    UNION ALL SELECT 'SNT', reference_date, round(SNT, 6) FROM m""",
)
def dependency_values(spark, sf_dir):
    """Values of the metrics reached from two columns, and of the ratios those reach."""
    wide = written(_wide(spark, sf_dir), work_folder(spark))  # read for both
    metrics, _ = X.reached(["soldeorigine"], METRICS, RATIOS)
    _, ratios = X.reached(["f.soldeorigine", "cumulmvtcr", "grpaffaire"], METRICS, RATIOS)
    long = R.ratios_long(wide, {c: RATIOS[c] for c in RATIOS if c in ratios}, ["reference_date"]).drop("inputs")
    both = long.unionByName(M.to_long(wide, sorted(metrics), ["reference_date"]))
    return both.withColumn("value", F.round("value", 6))


@check(
    "scenario_diagnostics",
    with_views(DATAMART_VIEWS, f"""SELECT DATE '{_AT}' AS reference_date, count(CASE WHEN date_value = DATE '{_AT}' THEN 1 END) AS rows_for_date, count(*) AS total_rows,
        (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d DESC) FROM (SELECT DISTINCT date_value AS d FROM fact_balance JOIN sub_dim_date s ON id_date = s.id ORDER BY 1 DESC LIMIT 10)) AS available_dates
        FROM fact_balance f LEFT JOIN sub_dim_date d ON f.id_date = d.id"""),
)
def scenario_diagnostics(spark, sf_dir):
    out = X.diagnostics(datamart(spark, sf_dir), _AT)
    return out.withColumn("available_dates", F.array_join(F.transform("available_dates", lambda d: d.cast("string")), ","))
