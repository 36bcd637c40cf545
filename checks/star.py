"""Metrics, filters and listings over the star."""

from __future__ import annotations

from pyspark.sql import functions as F

from balancier.operators import metrics as M
from balancier.plans.catalog import FIELDS, column_of, star
from checks.registry import check
from checks.tables import DATAMART_VIEWS, datamart, star_sql, table, with_views


def agg(function, field=None, filters=None, distinct=False, expression=None):
    node = {"type": "AGGREGATION", "function": function}
    for key, value in (("field", field), ("filters", filters), ("expression", expression)):
        if value is not None:
            node[key] = value
    if distinct:
        node["distinct"] = True
    return node


def op(kind, left, right):
    return {"type": kind, "left": left, "right": right}


def cond(field, operator, value=None):
    out = {"field": field, "operator": operator}
    if value is not None:
        out["value"] = value
    return out


def field(name):
    return {"type": "FIELD", "field": name}


def value(v):
    return {"type": "VALUE", "value": v}


FLAGSHIP = {
    "expression": op(
        "SUBTRACT",
        agg("SUM", "soldeconvertie", cond("grpaffaire", "=", "BUILDING")),
        agg("SUM", "soldeconvertie", cond("grpaffaire", "=", "MACHINERY")),
    ),
    "groupBy": ["pays"],
    "orderBy": [{"field": "value", "direction": "DESC"}, {"field": "pays"}],
    "limit": 10,
}


@check(
    "metric_filtered_diff_topn",
    star_sql(
        """res.pays AS res_pays, round(CAST(sum(CASE WHEN gaf.nomgrpaffaires = 'BUILDING' THEN f.soldeconvertie END) AS DOUBLE)
        - CAST(sum(CASE WHEN gaf.nomgrpaffaires = 'MACHINERY' THEN f.soldeconvertie END) AS DOUBLE), 2) AS value""",
        "GROUP BY res.pays ORDER BY value DESC NULLS LAST, res_pays NULLS LAST LIMIT 10",
    ),
)
def metric_filtered_diff_topn(spark, sf_dir):
    return M.metric(datamart(spark, sf_dir), FLAGSHIP).withColumn("value", F.round("value", 2))


ALL_AGGS = {
    "total": agg("SUM", "soldeconvertie"),
    "mean": agg("AVG", "amount"),
    "n": agg("COUNT"),
    "low": agg("MIN", "soldeorigine"),
    "high": agg("MAX", "soldeorigine"),
    "n_open": agg("COUNT", filters=cond("actif", "=", 1)),
}


@check(
    "metric_scalar_all_aggs",
    star_sql(
        """round(CAST(sum(f.soldeconvertie) AS DOUBLE), 2) AS total, round(CAST(sum(f.amount) AS DOUBLE) / count(f.amount), 6) AS mean,
        CAST(count(*) AS DOUBLE) AS n, CAST(min(f.soldeorigine) AS DOUBLE) AS low,
        CAST(max(f.soldeorigine) AS DOUBLE) AS high, CAST(sum(f.actif) AS DOUBLE) AS n_open"""
    ),
)
def metric_scalar_all_aggs(spark, sf_dir):
    out = M.metrics_at(datamart(spark, sf_dir), ALL_AGGS)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


DISTINCTS = {
    "clients": agg("COUNT", "idClient", distinct=True),
    "amounts": agg("SUM", "amount", distinct=True),
    "open_amounts": agg("AVG", "amount", cond("actif", "=", 1), distinct=True),
}


@check(
    "metric_distinct",
    star_sql(
        """CAST(count(DISTINCT f.id_client) AS DOUBLE) AS clients, CAST(sum(DISTINCT f.amount) AS DOUBLE) AS amounts,
        round(avg(DISTINCT CASE WHEN f.actif = 1 THEN f.amount END), 6) AS open_amounts"""
    ),
)
def metric_distinct(spark, sf_dir):
    return M.metrics_at(datamart(spark, sf_dir), DISTINCTS).withColumn("open_amounts", F.round("open_amounts", 6))


@check(
    "metric_expr_agg",
    star_sql(
        """ch.chapitre AS ch_chapitre, round(CAST(sum(f.soldeorigine * f.amount) AS DOUBLE)
        / nullif(CAST(sum(CASE WHEN f.actif = 1 THEN f.amount END) AS DOUBLE), 0), 4) AS value""",
        "GROUP BY ch.chapitre",
    ),
)
def metric_expr_agg(spark, sf_dir):
    spec = {
        "expression": op(
            "DIVIDE",
            agg("SUM", expression=op("MULTIPLY", field("soldeorigine"), field("amount"))),
            agg("SUM", "amount", cond("actif", "EQ", 1)),
        ),
        "groupBy": ["chapitre"],
    }
    return M.metric(datamart(spark, sf_dir), spec).withColumn("value", F.round("value", 4))


@check(
    "metric_at_date",
    star_sql(
        "tyc.typcontrat AS tyc_typcontrat, round(CAST(sum(f.soldeconvertie) AS DOUBLE), 2) AS value",
        "WHERE dtf.date_value = DATE '1998-03-01' AND f.soldeorigine > 1000 GROUP BY tyc.typcontrat",
    ),
)
def metric_at_date(spark, sf_dir):
    spec = {
        "expression": agg("SUM", "soldeconvertie"),
        "where": cond("soldeorigine", ">", 1000),
        "groupBy": ["typcontrat"],
    }
    return M.metric(datamart(spark, sf_dir), spec, at="1998-03-01").withColumn("value", F.round("value", 2))


@check(
    "metric_rows_topn",
    star_sql(
        "f.id AS f_id, CAST(f.soldeconvertie * 0.15 AS DOUBLE) AS value",
        "WHERE f.actif = 1 ORDER BY f.soldeconvertie DESC, f.id LIMIT 25",
    ),
)
def metric_rows_topn(spark, sf_dir):
    spec = {
        "expression": op("MULTIPLY", field("soldeconvertie"), value(0.15)),
        "where": cond("actif", "=", 1),
        "orderBy": [{"field": "value", "direction": "DESC"}, "id"],
        "top": 25,
    }
    return M.metric(datamart(spark, sf_dir), spec)


SIX = {
    "total": agg("SUM", "soldeconvertie"),
    "open_total": agg("SUM", "soldeconvertie", cond("contratActif", "=", 1)),
    "mean_amount": agg("AVG", "amount"),
    "n_doubtful": agg("COUNT", filters=cond("douteux", "=", 1)),
    "debit": {"expression": agg("SUM", "cumulmvtdb"), "where": cond("soldeorigine", "BETWEEN", [1000, 50000])},
    "share": op("DIVIDE", agg("SUM", "cumulmvtcr"), agg("SUM", "soldeorigine")),
}
SIX_SQL = """
    round(CAST(sum(f.soldeconvertie) AS DOUBLE), 2) AS total,
    round(CAST(sum(CASE WHEN dc.actif = 1 THEN f.soldeconvertie END) AS DOUBLE), 2) AS open_total,
    round(CAST(sum(f.amount) AS DOUBLE) / count(f.amount), 6) AS mean_amount,
    CAST(count(CASE WHEN dout.douteux = 1 THEN 1 END) AS DOUBLE) AS n_doubtful,
    CAST(sum(CASE WHEN f.soldeorigine BETWEEN 1000 AND 50000 THEN f.cumulmvtdb END) AS DOUBLE) AS debit,
    round(CAST(sum(f.cumulmvtcr) AS DOUBLE) / nullif(CAST(sum(f.soldeorigine) AS DOUBLE), 0), 8) AS share"""


@check("metrics_all_dates", star_sql(f"dtf.date_value AS reference_date, {SIX_SQL}", "WHERE dtf.date_value IS NOT NULL GROUP BY dtf.date_value"))
def metrics_all_dates(spark, sf_dir):
    out = M.metrics_by_date(datamart(spark, sf_dir), SIX)
    return out.withColumns(
        {"total": F.round("total", 2), "open_total": F.round("open_total", 2),
         "mean_amount": F.round("mean_amount", 6), "share": F.round("share", 8)}
    )


MATRIX = {
    "eq": (cond("pays", "=", "NATION_3"), "res.pays = 'NATION_3'"),
    "ne": (cond("typcontrat", "<>", "5-LOW"), "tyc.typcontrat <> '5-LOW'"),
    "gt": (cond("amount", ">", 25), "f.amount > 25"),
    "gte": (cond("soldeconvertie", "GTE", 30000.5), "f.soldeconvertie >= 30000.5"),
    "lt": (cond("tauxcontrat", "LT", 5), "dc.tauxcontrat < 5"),
    "lte": (cond("datevalue", "<=", "1997-06-01"), "dtf.date_value <= DATE '1997-06-01'"),
    "like_": (cond("raisonsoc", "LIKE", "%ING Customer#%7"), "cl.raisonsoc LIKE '%ING Customer#%7'"),
    "starts_with": (cond("raisonsoc", "begins with", "AUTO"), "starts_with(cl.raisonsoc, 'AUTO')"),
    "ends_with": (cond("numcompte", "ENDSWITH", "7"), "suffix(CAST(c.numcompte AS VARCHAR), '7')"),
    "contains_": (cond("libellecompte", "CONTAINS", "ed"), "contains(c.libellecompte, 'ed')"),
    "in_": (cond("numagence", "IN", [101, 103, 107]), "agf.numagence IN (101, 103, 107)"),
    "not_in": (cond("devise", "NOT IN", ["NATION_1", "NATION_2"]), "dvf.devise NOT IN ('NATION_1', 'NATION_2')"),
    "between_": (cond("dateouverture", "BETWEEN", ["1996-01-01", "1996-12-31"]), "dto.date_value BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "is_null": (cond("datdouteux", "IS NULL"), "dout.datdouteux IS NULL"),
    "is_not_null": (cond("datdouteux", "IS_NOT_NULL"), "dout.datdouteux IS NOT NULL"),
}


@check("filter_ops_matrix", star_sql(", ".join(f"CAST(count(CASE WHEN {sql} THEN 1 END) AS DOUBLE) AS {k}" for k, (_, sql) in MATRIX.items())))
def filter_ops_matrix(spark, sf_dir):
    return M.metrics_at(datamart(spark, sf_dir), {k: agg("COUNT", filters=c) for k, (c, _) in MATRIX.items()})


NESTED = {
    "logic": "OR",
    "conditions": [cond("geo", "=", "ASIA"), cond("amount", "<", 3)],
    "groups": [
        {
            "logic": "AND",
            "conditions": [cond("contratActif", "=", 1)],
            "groups": [{"logic": "OR", "conditions": [cond("grpaffaire", "=", "BUILDING"), cond("tauxcontrat", ">", 15)]}],
        }
    ],
}


@check(
    "filter_nested_groups",
    star_sql(
        "aec.libelle AS aec_libelle, CAST(count(*) AS DOUBLE) AS value",
        """WHERE res.geo = 'ASIA' OR f.amount < 3 OR (dc.actif = 1 AND (gaf.nomgrpaffaires = 'BUILDING' OR dc.tauxcontrat > 15))
        GROUP BY aec.libelle""",
    ),
)
def filter_nested_groups(spark, sf_dir):
    return M.metric(datamart(spark, sf_dir), {"expression": agg("COUNT"), "filters": NESTED, "groupBy": ["sub_dim_agenteco.libelle"]})


def _flat_sql() -> str:
    cols = []
    for f in FIELDS:
        c = f"{f.alias}.{f.column}"
        cols.append(f"{'CAST(' + c + ' AS VARCHAR)' if f.column == 'numcompte' else c} AS {f.flat}")
    return ", ".join(cols).replace("f.soldeconvertie AS", "CAST(f.soldeconvertie AS DOUBLE) AS")


@check("star_wide", star_sql(_flat_sql()))
def star_wide(spark, sf_dir):
    wide = star(datamart(spark, sf_dir), by_steps=True)
    return wide.select(
        *[(column_of(f.name).cast("double") if f.column == "soldeconvertie" else column_of(f.name)).alias(f.flat) for f in FIELDS]
    )


@check(
    "star_role_playing",
    star_sql(
        """dvf.devise AS dvf_devise, dvb.devise AS dvb_devise, agc.numagence AS agc_numagence,
        CAST(count(DISTINCT dvc.devise) AS DOUBLE) AS value""",
        "WHERE agf.numagence <> 105 GROUP BY 1, 2, 3",
    ),
)
def star_role_playing(spark, sf_dir):
    spec = {
        "expression": agg("COUNT", "devisecontrat", distinct=True),
        "where": cond("numagence", "!=", 105),
        "groupBy": ["devise", "devisebnq", "numagencecontrat"],
    }
    return M.metric(datamart(spark, sf_dir), spec)


@check(
    "order_nulls",
    star_sql(
        """dout.datdouteux AS dout_datdouteux, sac.libelle AS sac_libelle, round(CAST(sum(f.soldeconvertie) AS DOUBLE), 2) AS value""",
        "GROUP BY 1, 2 ORDER BY dout_datdouteux DESC NULLS LAST, value DESC NULLS LAST, sac_libelle NULLS LAST LIMIT 7",
    ),
)
def order_nulls(spark, sf_dir):
    spec = {
        "expression": agg("SUM", "soldeconvertie"),
        "groupBy": ["datdouteux", "sectionactivite"],
        "orderBy": [
            {"field": "datdouteux", "direction": "DESC"},
            {"field": "value", "direction": "DESC"},
            {"field": "sectionactivite", "direction": "ASC"},
        ],
        "limit": 7,
    }
    return M.metric(datamart(spark, sf_dir), spec).withColumn("value", F.round("value", 2))


@check("dates_all", with_views(DATAMART_VIEWS, "SELECT DISTINCT date_value AS reference_date FROM fact_balance f JOIN sub_dim_date d ON f.id_date = d.id"))
def dates_all(spark, sf_dir):
    return M.reference_dates(datamart(spark, sf_dir))


@check(
    "dates_latest",
    with_views(DATAMART_VIEWS, """SELECT DISTINCT date_value AS reference_date FROM fact_balance f
        JOIN sub_dim_date d ON f.id_date = d.id ORDER BY 1 DESC LIMIT 5"""),
)
def dates_latest(spark, sf_dir):
    return M.reference_dates(datamart(spark, sf_dir), latest=5)


@check(
    "code_scope_missing",
    """SELECT w.code FROM (VALUES ('Brand#1'), ('Brand#7'), ('Brand#99'), ('Nope')) w(code)
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = w.code)""",
)
def code_scope_missing(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"))
    return M.scope(["Brand#1", " Brand#7", "Brand#99", "Nope", "Nope", ""], brands)[1]


@check("code_scope_found", "SELECT p_brand AS code, p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#99', 'Nope')")
def code_scope_found(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), "p_partkey")
    return M.scope(["Brand#1", " Brand#7", "Brand#99", "Nope", "Nope", ""], brands)[0]


def _long_sql() -> str:
    return """SELECT reference_date, code, value FROM (
        UNPIVOT wide ON total, open_total, mean_amount, n_doubtful, debit, share INTO NAME code VALUE value)"""


@check(
    "metrics_long",
    star_sql(f"dtf.date_value AS reference_date, {SIX_SQL}", "GROUP BY dtf.date_value").replace(
        "\nSELECT dtf.date_value", ", wide AS (SELECT dtf.date_value", 1
    )
    + ") "
    + _long_sql(),
)
def metrics_long(spark, sf_dir):
    return M.to_long(metrics_all_dates(spark, sf_dir), list(SIX), ["reference_date"])


_COUNTED = {
    "parts": None, "small": "l_quantity <= 10", "large": "l_quantity > 40", "taxed": "l_tax > 0.04", "free": "l_tax = 0",
    "first": "l_linenumber = 1", "open": "l_linestatus = 'O'", "reduced": "l_discount > 0.05", "dear": "l_extendedprice > 50000", "none": "l_quantity < 0",
}


@check(
    "metric_distinct_bitmaps",
    "SELECT l_returnflag, " + ", ".join("count(DISTINCT l_partkey)" + (f" FILTER ({c})" if c else "") + f' AS "{n}"' for n, c in _COUNTED.items())
    + " FROM lineitem GROUP BY 1",
)
def metric_distinct_bitmaps(spark, sf_dir):
    """Ten filtered distinct counts from one scan."""
    wanted = {n: None if c is None else F.expr(c) for n, c in _COUNTED.items()}
    return M.distinct_counts(table(spark, sf_dir, "lineitem"), "l_partkey", wanted, ["l_returnflag"])
