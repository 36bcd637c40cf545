"""The test tables, and the datamart views the star queries run on.

The views are one SQL text for both engines, so Spark and DuckDB start from the same
rows. ``{table}`` stands for a test table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from balancier.session import work_folder, written

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FACT_COLUMNS = """
    l_orderkey * 10 + l_linenumber AS id,
    l_suppkey AS id_agence,
    l_partkey % 25 AS id_devise,
    l_suppkey % 25 AS id_devisebnq,
    l_partkey AS id_compte,
    l_partkey % 50 + 1 AS id_chapitre,
    CAST(o_custkey AS STRING) AS id_client,
    CAST(l_orderkey AS STRING) AS id_contrat,
    CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS id_date,
    CAST(floor(l_extendedprice) AS BIGINT) AS soldeorigine,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS soldeconvertie,
    CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS cumulmvtdb,
    CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS cumulmvtcr,
    CAST(l_linenumber AS BIGINT) AS soldeinitdebmois,
    CAST(l_quantity AS BIGINT) AS amount,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS actif
"""

DATAMART_SQL = {
    "fact_balance": "SELECT" + _FACT_COLUMNS + "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "dim_client": """
        SELECT CAST(c_custkey AS STRING) AS idtiers, CAST(c_nationkey AS BIGINT) AS id_residence,
               c_custkey % 25 AS id_agenteco,
               CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS id_douteux,
               CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                    WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS BIGINT) AS id_grpaffaire,
               c_custkey % 5 AS id_sectionactivite, c_name AS nomprenom,
               concat(c_mktsegment, ' ', c_name) AS raisonsoc,
               CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) AS chiffreaffaires
        FROM {customer}""",
    "dim_contrat": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS id_client,
               o_custkey % 10 AS id_agence, o_orderkey % 25 AS id_devise,
               CAST(CASE o_orderkey % 7 WHEN 0 THEN 1311 WHEN 1 THEN 1312 WHEN 2 THEN 1320 WHEN 3 THEN 1330
                    WHEN 4 THEN 1340 WHEN 5 THEN 1350 ELSE 1360 END AS BIGINT) AS id_objetfinance,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_typcontrat,
               CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS id_dateouverture,
               CAST(2001 * 100 + month(o_orderdate) AS BIGINT) AS id_dateecheance,
               CAST(o_orderkey % 180 AS INT) AS ancienneteimpaye, CAST(o_custkey % 20 AS INT) AS tauxcontrat,
               CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS actif
        FROM {orders}""",
    "sub_dim_agence": "SELECT s_suppkey AS id, CAST(s_suppkey + 100 AS INT) AS numagence FROM {supplier}",
    "sub_dim_devise": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS devise FROM {nation}",
    "sub_dim_compte": "SELECT p_partkey AS id, 100000 + p_partkey * 7 AS numcompte, p_name AS libellecompte FROM {part}",
    "sub_dim_chapitre": "SELECT DISTINCT CAST(p_size AS BIGINT) AS id, CAST(p_size * 100 AS BIGINT) AS chapitre FROM {part}",
    "sub_dim_residence": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS pays, substr(n_name, 8) AS residence, r_name AS geo
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "sub_dim_agenteco": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS libelle FROM {nation}",
    "sub_dim_sectionactivite": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS libelle FROM {region}",
    "sub_dim_douteux": """
        SELECT CAST(0 AS BIGINT) AS id, 0 AS douteux, CAST(NULL AS DATE) AS datdouteux
        UNION ALL SELECT CAST(1 AS BIGINT), 1, DATE '2000-01-01'""",
    "sub_dim_grpaffaire": """
        SELECT CAST(1 AS BIGINT) AS id, 'AUTOMOBILE' AS nomgrpaffaires UNION ALL SELECT 2, 'BUILDING'
        UNION ALL SELECT 3, 'FURNITURE' UNION ALL SELECT 4, 'HOUSEHOLD' UNION ALL SELECT 5, 'MACHINERY'""",
    "sub_dim_objetfinance": """
        SELECT CAST(1311 AS BIGINT) AS id, 'Credits immobiliers residentiel' AS libelle
        UNION ALL SELECT 1312, 'Credits immobiliers commercial' UNION ALL SELECT 1320, 'Credits d''exploitation'
        UNION ALL SELECT 1330, 'Credits d''equipement' UNION ALL SELECT 1340, 'Credits a la consommation'
        UNION ALL SELECT 1350, 'Credits de tresorerie' UNION ALL SELECT 1360, 'Autres Credits'""",
    "sub_dim_typcontrat": """
        SELECT CAST(1 AS BIGINT) AS id, '1-URGENT' AS typcontrat UNION ALL SELECT 2, '2-HIGH'
        UNION ALL SELECT 3, '3-MEDIUM' UNION ALL SELECT 4, '4-NOT SPECIFIED' UNION ALL SELECT 5, '5-LOW'""",
}

# The months in which something was shipped.
DATAMART_SQL["sub_dim_date"] = """
    SELECT CAST(year(d) * 100 + month(d) AS BIGINT) AS id, d AS date_value
    FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS d FROM {lineitem})"""


def view(spark: SparkSession, sf_dir: str, sql: str, opened: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run shared SQL on the test tables. ``opened`` keeps tables for the next view."""
    opened = {} if opened is None else opened
    used = [t for t in TEST_TABLES if "{" + t + "}" in sql]
    for t in used:
        if t not in opened:
            opened[t] = table(spark, sf_dir, t)
    return spark.sql(sql, **{t: opened[t] for t in used})


class Datamart(dict):
    """The 16 datamart tables, each opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._at = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def __missing__(self, name: str) -> DataFrame:
        self[name] = view(*self._at, DATAMART_SQL[name], self._opened)
        if name == "sub_dim_chapitre":  # stored, so that its size is known: distinct values of a large table
            self[name] = written(self[name], work_folder(self._at[0]))
        return self[name]


def datamart(spark: SparkSession, sf_dir: str) -> Datamart:
    return Datamart(spark, sf_dir)


def duck(sql: str) -> str:
    """Shared SQL as DuckDB reads it: the placeholders are plain view names."""
    for t in TEST_TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_views(views: dict[str, str], sql: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({duck(text)})" for name, text in views.items()) + "\n" + sql


_STAR_JOINS = """
FROM fact_balance f
LEFT JOIN dim_client cl ON f.id_client = cl.idtiers
LEFT JOIN dim_contrat dc ON f.id_contrat = dc.id
LEFT JOIN sub_dim_agence agf ON f.id_agence = agf.id
LEFT JOIN sub_dim_compte c ON f.id_compte = c.id
LEFT JOIN sub_dim_chapitre ch ON f.id_chapitre = ch.id
LEFT JOIN sub_dim_date dtf ON f.id_date = dtf.id
LEFT JOIN sub_dim_devise dvf ON f.id_devise = dvf.id
LEFT JOIN sub_dim_devise dvb ON f.id_devisebnq = dvb.id
LEFT JOIN sub_dim_residence res ON cl.id_residence = res.id
LEFT JOIN sub_dim_agenteco aec ON cl.id_agenteco = aec.id
LEFT JOIN sub_dim_douteux dout ON cl.id_douteux = dout.id
LEFT JOIN sub_dim_grpaffaire gaf ON cl.id_grpaffaire = gaf.id
LEFT JOIN sub_dim_sectionactivite sac ON cl.id_sectionactivite = sac.id
LEFT JOIN sub_dim_agence agc ON dc.id_agence = agc.id
LEFT JOIN sub_dim_devise dvc ON dc.id_devise = dvc.id
LEFT JOIN sub_dim_objetfinance ofc ON dc.id_objetfinance = ofc.id
LEFT JOIN sub_dim_typcontrat tyc ON dc.id_typcontrat = tyc.id
LEFT JOIN sub_dim_date dto ON dc.id_dateouverture = dto.id
LEFT JOIN sub_dim_date dte ON dc.id_dateecheance = dte.id
"""

DATAMART_VIEWS = DATAMART_SQL


def star_sql(select: str, rest: str = "", before: str = "") -> str:
    """DuckDB query over the 19-join star, aliases as in the catalog."""
    head = with_views(DATAMART_VIEWS, "")
    return f"{head.rstrip()}{',' + before if before else ''}\nSELECT {select} {_STAR_JOINS} {rest}"
