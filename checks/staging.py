"""Staging tables with faults, derived from the test tables by one SQL text for both engines."""

from __future__ import annotations

from checks.tables import duck, view

_DAY = "lpad(CAST(day({d}) AS STRING), 2, '0')"
_MONTH = "lpad(CAST(month({d}) AS STRING), 2, '0')"
_YEAR = "CAST(year({d}) AS STRING)"


def _date_text(column: str, layout: str) -> str:
    """SQL that renders a date: D, M and Y stand for its parts."""
    parts = {"D": _DAY, "M": _MONTH, "Y": _YEAR}
    return "concat(" + ", ".join(parts[c].replace("{d}", column) if c in parts else f"'{c}'" for c in layout) + ")"


_LAYOUTS = ["D/M/Y", "Y-M-D", "D-M-Y", "M/D/Y", "Y/M/D", "D.M.Y", "Y-M-DT10:30"]


def _layout_case(key: str, column: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_date_text(column, layout)}" for i, layout in enumerate(_LAYOUTS))
    return f"CASE {key} % {len(_LAYOUTS) + 2} {whens} WHEN {len(_LAYOUTS)} THEN '31/02/1999' ELSE 'soon' END"


_TIERS = """
    CASE WHEN c_custkey % 31 = 5 THEN concat('T', CAST(c_custkey AS STRING)) WHEN c_custkey % 37 = 9 THEN NULL
         ELSE CAST(c_custkey AS STRING) END AS idtiers,
    CASE WHEN c_custkey % 41 = 3 THEN '12345' ELSE c_name END AS nomprenom,
    concat(c_mktsegment, ' SA') AS raisonsoc,
    CASE c_custkey % 12 WHEN 0 THEN 'SN' WHEN 1 THEN 'ci ' WHEN 2 THEN 'FR' WHEN 3 THEN 'CM' WHEN 4 THEN 'GM'
         WHEN 5 THEN 'US' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN '99' ELSE 'BJ' END AS residence,
    CASE c_custkey % 8 WHEN 0 THEN '100' WHEN 1 THEN '230' WHEN 2 THEN ' 320 ' WHEN 3 THEN '999' WHEN 4 THEN 'ABC'
         WHEN 5 THEN '400' WHEN 6 THEN '266' ELSE CASE WHEN c_custkey % 16 = 7 THEN NULL ELSE '203' END END AS agenteco,
    CASE WHEN c_custkey % 19 = 4 THEN 'n.a.' ELSE CAST(c_custkey * 67 % 99999 AS STRING) END AS sectionactivite,
    CASE c_custkey % 5 WHEN 0 THEN '1000' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE '-25' END AS chiffreaffaires,
    CASE c_custkey % 6 WHEN 0 THEN 'SN' WHEN 1 THEN '' WHEN 2 THEN '12.5' WHEN 3 THEN NULL WHEN 4 THEN 'FR' ELSE 'CI' END AS nationalite,
    CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'x' ELSE NULL END AS douteux,
    CASE c_custkey % 5 WHEN 0 THEN '05/03/1999' WHEN 1 THEN '1999-03-05' WHEN 2 THEN '31/02/1999' WHEN 3 THEN NULL ELSE 'n/a' END AS datdouteux,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 17 AS INT) END AS grpaffaires,
    concat('GROUPE ', c_mktsegment) AS nomgrpaffaires
"""

STG_TIERS = (
    f"SELECT c_custkey + 1 AS id, {_TIERS} FROM {{customer}} UNION ALL "
    f"SELECT c_custkey + 1000000000001 AS id, {_TIERS} FROM {{customer}} WHERE c_custkey % 9 = 2"
)

_CONTRAT = f"""
    CASE WHEN o_orderkey % 29 = 1 THEN 'A1' ELSE CAST(o_custkey % 10 AS STRING) END AS agence,
    CASE o_orderkey % 5 WHEN 0 THEN 'XOF' WHEN 1 THEN ' EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'XOF' ELSE
         CASE WHEN o_orderkey % 35 = 4 THEN '978' ELSE 'GBP' END END AS devise,
    CASE WHEN o_orderkey % 53 = 2 THEN CAST(o_orderkey AS STRING) WHEN o_orderkey % 59 = 2 THEN NULL
         ELSE concat('C', CAST(o_orderkey AS STRING)) END AS idcontrat,
    CAST(o_orderkey % 180 AS STRING) AS ancienneteimpaye,
    CASE o_orderkey % 6 WHEN 0 THEN '10234' WHEN 1 THEN '30411' WHEN 2 THEN '14259' WHEN 3 THEN '99999'
         WHEN 4 THEN '48350' ELSE NULL END AS objetfinance,
    CASE o_orderkey % 5 WHEN 0 THEN 'p' WHEN 1 THEN 'D' WHEN 2 THEN ' P ' WHEN 3 THEN 'LEASING' ELSE 'd' END AS typcontrat,
    {_layout_case('o_orderkey', 'o_orderdate')} AS datouv,
    CASE WHEN o_orderkey % 61 = 3 THEN NULL ELSE {_layout_case('o_custkey', 'o_orderdate')} END AS datech,
    CAST(o_custkey AS STRING) AS idtiers,
    CAST(o_custkey % 20 AS STRING) AS tauxcontrat,
    CASE WHEN o_orderstatus = 'O' THEN '1' ELSE '0' END AS actif
"""

STG_CONTRAT = (
    f"SELECT o_orderkey + 1 AS id, {_CONTRAT} FROM {{orders}} UNION ALL "
    f"SELECT o_orderkey + 1000000000001 AS id, {_CONTRAT} FROM {{orders}} WHERE o_orderkey % 11 = 6"
)

_LINES = """(SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(date_trunc('month', l_shipdate) AS DATE)) AS d,
    CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS net,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS gross,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) AS DECIMAL(18,0)) AS qty
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS lines"""


def _amount(text: str, key: str) -> str:
    """SQL that renders a number plainly, with a comma, with a no-break space, or as junk."""
    return f"""CASE {key} % 9 WHEN 0 THEN replace({text}, '.', ',') WHEN 1 THEN concat(substr({text}, 1, 2), chr(160), substr({text}, 3))
        WHEN 2 THEN concat(' ', {text}, ' ') WHEN 3 THEN CASE WHEN {key} % 27 = 3 THEN '1.25E3' ELSE {text} END
        WHEN 4 THEN CASE WHEN {key} % 45 = 4 THEN 'N/D' WHEN {key} % 45 = 13 THEN NULL WHEN {key} % 45 = 22 THEN '' ELSE {text} END
        ELSE {text} END"""


_COMPTA = f"""
    CAST(s % 10 AS STRING) AS agence,
    CASE p % 4 WHEN 0 THEN 'XOF' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD ' ELSE CASE WHEN p % 28 = 3 THEN '952' ELSE 'CHF' END END AS devise,
    CASE WHEN p % 97 = 5 THEN 'X-1' ELSE CAST(1000000 + p AS STRING) END AS compte,
    CASE WHEN p % 43 = 7 THEN 'CH' ELSE CAST(p % 50 AS STRING) END AS chapitre,
    CASE WHEN p % 6 = 5 THEN NULL ELSE concat('Compte ', CAST(p % 3 + n % 2 AS STRING)) END AS libellecompte,
    CASE WHEN o % 71 = 3 THEN '' ELSE CAST(o % 2000 AS STRING) END AS idtiers,
    {_amount('CAST(gross AS STRING)', '(o + n)')} AS soldeorigine,
    {_amount('CAST(net AS STRING)', '(o + n + 4)')} AS soldeconvertie,
    CASE p % 3 WHEN 0 THEN 'XOF' WHEN 1 THEN 'JPY' ELSE ' ' END AS devisebbnq,
    {_amount('CAST(qty AS STRING)', '(o + n + 2)')} AS cumulmvtdb,
    CAST(qty AS STRING) AS cumulmvtcr,
    CAST(gross AS STRING) AS soldeinitdebmois,
    CASE WHEN o % 5 = 0 THEN NULL WHEN o % 7 = 0 THEN concat('X', CAST(o AS STRING)) WHEN o % 11 = 0 THEN ''
         ELSE concat('C', CAST(o AS STRING)) END AS idcontrat,
    CAST(gross AS STRING) AS amount,
    CASE WHEN n % 5 = 0 THEN '0' ELSE '1' END AS actif,
    CASE WHEN n % 2 = 0 THEN {_date_text('d', 'D/M/Y')} ELSE {_date_text('d', 'Y-M-D')} END AS date_bal
"""

STG_COMPTA = (
    f"SELECT o * 10 + n AS id, {_COMPTA} FROM {_LINES} UNION ALL "
    f"SELECT o * 10 + n + 1000000000000 AS id, {_COMPTA} FROM {_LINES} WHERE o % 23 = 8"
)

VIEWS = {"stg_tiers": STG_TIERS, "stg_contrat": STG_CONTRAT, "stg_compta": STG_COMPTA}


def staging(spark, sf_dir, name):
    return view(spark, sf_dir, VIEWS[name])


def staging_sql(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    views = {n: duck(VIEWS[n]) for n in names or VIEWS}
    views |= extra or {}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in views.items()) + "\n" + sql
