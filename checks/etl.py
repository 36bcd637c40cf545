"""Cleaning, recoding, quality rules and datamart loading over the staging fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancier.functions import cleaning as C
from balancier.functions import recode as R
from balancier.operators import datamart as D
from balancier.operators import quality as Q
from balancier.session import PASSING, shuffles_removed, work_folder, written
from balancier.sources import load as L
from balancier.sources.readers import discover, spark_columns
from balancier.sources.tabular import tidy
from checks.registry import ORACLE, check
from checks.staging import staging, staging_sql
from checks.tables import TEST_TABLES, duck, table, view

NUM = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INT = "^-?[0-9]+$"
LOOSE = r"^-?[0-9]+\.?[0-9]*$"


def nt(c: str) -> str:
    return rf"replace(regexp_replace(nullif(trim({c}), ''), '[\s\x{{00A0}}]', '', 'g'), ',', '.')"


def long_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({nt(c)}, '{NUM}') THEN CAST(round_even(CAST({nt(c)} AS DOUBLE), 0) AS BIGINT) END"


def dec_sql(c: str) -> str:
    return f"TRY_CAST({nt(c)} AS DECIMAL(38,10))"


def int_sql(c: str, dtype: str = "INT", pattern: str = INT) -> str:
    return f"CASE WHEN regexp_matches(nullif(trim({c}), ''), '{pattern}') THEN TRY_CAST(trim({c}) AS {dtype}) END"


def date_sql(c: str) -> str:
    return f"""CASE WHEN regexp_matches(trim({c}), '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN CAST(try_strptime(trim({c}), '%d/%m/%Y') AS DATE)
        WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(trim({c}) AS DATE) END"""


def norm_sql(c: str) -> str:
    pats = [
        ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "%d/%m/%Y"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "%Y-%m-%d"),
        ("^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "%d-%m-%Y"), ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "%m/%d/%Y"),
        ("^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "%Y/%m/%d"), (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "%d.%m.%Y"),
    ]
    tries = [f"CASE WHEN regexp_matches(trim({c}), '{p}') THEN try_strptime(trim({c}), '{f}') END" for p, f in pats]
    tries.append(f"CASE WHEN contains({c}, 'T') THEN try_strptime(substr(trim({c}), 1, 10), '%Y-%m-%d') END")
    return f"coalesce(strftime(coalesce({', '.join(tries)}), '%d/%m/%Y'), {c})"


@check(
    "clean_numbers",
    staging_sql(
        f"""SELECT id, {int_sql('compte', 'BIGINT')} AS compte, {long_sql('soldeorigine')} AS soldeorigine,
        CAST({dec_sql('soldeconvertie')} AS DOUBLE) AS soldeconvertie, {long_sql('cumulmvtdb')} AS cumulmvtdb FROM stg_compta""",
        "stg_compta",
    ),
)
def clean_numbers(spark, sf_dir):
    return staging(spark, sf_dir, "stg_compta").select(
        "id", C.guarded("compte", "bigint").alias("compte"), C.clean_long("soldeorigine").alias("soldeorigine"),
        C.clean_decimal("soldeconvertie").cast("double").alias("soldeconvertie"), C.clean_long("cumulmvtdb").alias("cumulmvtdb"),
    )


@check(
    "clean_dates",
    staging_sql(
        f"""SELECT id, {norm_sql('datouv')} AS datouv, {norm_sql('datech')} AS datech,
        {date_sql(norm_sql('datouv'))} AS opened, {date_sql('datech')} AS due FROM stg_contrat""",
        "stg_contrat",
    ),
)
def clean_dates(spark, sf_dir):
    rows = staging(spark, sf_dir, "stg_contrat").select(
        "id", C.normalise_date("datouv").alias("datouv"), C.normalise_date("datech").alias("datech"), C.parse_date("datech").alias("due")
    )
    return rows.withColumn("opened", C.parse_date("datouv"))


def _values(pairs) -> str:
    def text(x):
        return "'" + x + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(text(x) for x in p) + ")" for p in pairs) + ")"


# Expected codes of the values that the staging tables hold; 99999, 999, 'US' and '99' have none.
PURPOSE_CODES = "(VALUES (10234, 1340), (30411, 1311), (14259, 1320), (48350, 1330))"
AGENT_CODES = "(VALUES (100, 21100), (230, 22220), (320, 24200), (400, 24200), (266, 21311), (203, 23300))"
ZONE_CODES = "(VALUES ('SN', 110), ('CI', 120), ('BJ', 120), ('FR', 143), ('CM', 141), ('GM', 142))"
_LABEL = """CASE z WHEN 110 THEN 'Etat du Declarant' WHEN 120 THEN 'Autres Etats Membre de l''UMOA' WHEN 141 THEN 'Autre pays de la Zone Franc'
    WHEN 142 THEN 'Autre Etats membres de la CEDEAO' WHEN 143 THEN 'Zone euro' ELSE 'Autres Etats' END"""


@check(
    "recode_exact",
    staging_sql(
        f"""SELECT c.id, coalesce(CAST(m.code AS VARCHAR), c.objetfinance) AS objetfinance,
        CASE lower(trim(c.typcontrat)) WHEN 'p' THEN 'PRET' WHEN 'd' THEN 'COMPTE ORDINAIRE' ELSE c.typcontrat END AS typcontrat
        FROM stg_contrat c LEFT JOIN {PURPOSE_CODES} m(src, code)
        ON m.src = CASE WHEN regexp_matches(trim(c.objetfinance), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(c.objetfinance) AS INT) END""",
        "stg_contrat",
    ),
)
def recode_exact(spark, sf_dir):
    out = R.recode_contracts(staging(spark, sf_dir, "stg_contrat"))
    return out.select("id", "objetfinance", "typcontrat")


@check(
    "recode_default",
    staging_sql(
        f"""SELECT c.id, coalesce(CAST(a.code AS VARCHAR), c.agenteco) AS agenteco,
        CASE WHEN c.residence IS NOT NULL THEN coalesce(z.zone, 144) END AS residencenum
        FROM stg_tiers c LEFT JOIN {ZONE_CODES} z(pays, zone) ON z.pays = upper(trim(c.residence))
        LEFT JOIN {AGENT_CODES} a(src, code) ON CAST(a.src AS VARCHAR) = trim(c.agenteco)""",
        "stg_tiers",
    ),
)
def recode_default(spark, sf_dir):
    return R.recode_customers(staging(spark, sf_dir, "stg_tiers")).select("id", "agenteco", "residencenum")


_KEYS = sorted({(k, code) for first, last, code in R.SECTION_RUNS for k in (first, last)})


@check(
    "recode_nearest",
    staging_sql(
        f"""SELECT c.id, CASE WHEN n.v IS NULL THEN c.sectionactivite ELSE CAST((SELECT k.code FROM {_values(_KEYS)} k(k, code)
            ORDER BY abs(k.k - n.v), k.k LIMIT 1) AS VARCHAR) END AS sectionactivite
        FROM stg_tiers c JOIN (SELECT id, CASE WHEN regexp_matches(sectionactivite, '{INT}')
            THEN CAST(sectionactivite AS INT) // 10 END AS v FROM stg_tiers) n USING (id)""",
        "stg_tiers",
    ),
)
def recode_nearest(spark, sf_dir):
    return R.recode_customers(staging(spark, sf_dir, "stg_tiers")).select("id", "sectionactivite")


_NEAR_KEYS = "SELECT l_orderkey * 7 + l_linenumber * 1000 AS key, concat('K', CAST(l_suppkey AS STRING)) AS code FROM {lineitem}"
_NEAR_VALUES = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE (o_custkey * 7919 + o_orderkey * 31) % 900000 - 2000 END AS v FROM {orders}"


@check(
    "recode_nearest_table",
    f"""WITH keys AS (SELECT key, min(code) AS code FROM ({duck(_NEAR_KEYS)}) GROUP BY 1), rows AS ({duck(_NEAR_VALUES)}),
    low AS (SELECT o_orderkey, key, code FROM rows ASOF JOIN keys ON rows.v >= keys.key),
    high AS (SELECT o_orderkey, key, code FROM rows ASOF JOIN keys ON rows.v <= keys.key)
    SELECT o_orderkey, v, CASE WHEN low.key IS NULL THEN high.code WHEN high.key IS NULL OR v - low.key <= high.key - v THEN low.code ELSE high.code END AS code
    FROM rows LEFT JOIN low USING (o_orderkey) LEFT JOIN high USING (o_orderkey)""",
)
def recode_nearest_table(spark, sf_dir):
    """The nearest key of a stored table of keys."""
    return R.nearest_from(view(spark, sf_dir, _NEAR_VALUES), "v", view(spark, sf_dir, _NEAR_KEYS), "code")


def _repair_sql(cols: str, where: str = "") -> str:
    return f"""SELECT {cols},
        CASE WHEN nationalite IS NULL OR nationalite = '' OR regexp_matches(nationalite, '{LOOSE}') THEN residence ELSE nationalite END AS nationalite,
        CASE WHEN chiffreaffaires IS NULL OR chiffreaffaires = '' OR NOT regexp_matches(chiffreaffaires, '{INT}') THEN '0' ELSE chiffreaffaires END AS chiffreaffaires,
        CASE WHEN douteux IS NULL OR douteux = '' OR NOT regexp_matches(douteux, '{INT}') THEN '0' ELSE douteux END AS douteux
        FROM stg_tiers {where}"""


@check("repair_rows", staging_sql(_repair_sql("id"), "stg_tiers"))
def repair_rows(spark, sf_dir):
    out = Q.repair(staging(spark, sf_dir, "stg_tiers"), C.repair_customers())
    return out.select("id", "nationalite", "chiffreaffaires", "douteux")


def bad_sql(rules: Q.Rules, prefix: str = "") -> dict[str, str]:
    pattern = NUM if rules.number_pattern == C.NUMERIC else LOOSE
    out = {}
    for c in rules.integer:
        out[c] = f"({c} <> '' AND NOT regexp_matches({c}, '{INT}'))"
    for c in rules.numeric:
        out[c] = f"({c} <> '' AND NOT regexp_matches({c}, '{NUM}'))"
    for c in rules.not_numeric:
        out[c] = f"({c} <> '' AND regexp_matches({c}, '{pattern}'))"
    for c in rules.dates:
        out[c] = f"({c} <> '' AND NOT regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT regexp_matches({c}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'))"
    return {c: f"coalesce({e}, false)" for c, e in out.items()}


def null_sql(rules: Q.Rules) -> str:
    return "(" + " OR ".join(f"{c} IS NULL" for c in rules.required) + ")"


_BAD_LEDGER = " OR ".join(bad_sql(Q.LEDGER).values())
_TRIMMED = ", ".join(f"nullif(trim({c}), '')" for c in Q.LEDGER.key)
_DUP_LEDGER = f"(SELECT id, row_number() OVER (PARTITION BY {_TRIMMED} ORDER BY id) AS rn FROM stg_compta)"


@check(
    "dq_counters",
    staging_sql(
        f"""SELECT n.nulls, d.duplicates, t.bad_types, n.nulls + d.duplicates + t.bad_types AS total FROM
        (SELECT count(*) AS nulls FROM stg_compta WHERE {null_sql(Q.LEDGER)}) n,
        (SELECT count(*) AS duplicates FROM {_DUP_LEDGER} WHERE rn > 1) d,
        (SELECT count(*) AS bad_types FROM stg_compta WHERE {_BAD_LEDGER}) t""",
        "stg_compta",
    ),
)
def dq_counters(spark, sf_dir):
    return Q.counters(staging(spark, sf_dir, "stg_compta"), Q.LEDGER)


@check(
    "dq_type_breakdown",
    staging_sql(
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS failures FROM stg_compta WHERE {e}" for c, e in bad_sql(Q.LEDGER).items()),
        "stg_compta",
    ),
)
def dq_type_breakdown(spark, sf_dir):
    return Q.type_breakdown(staging(spark, sf_dir, "stg_compta"), Q.LEDGER)


@check(
    "dq_type_samples",
    staging_sql(
        "SELECT id, \"column\", value, rank FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY id) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT id, '{c}' AS \"column\", {c} AS value FROM stg_contrat WHERE {e}" for c, e in bad_sql(Q.CONTRACTS).items())
        + ")) WHERE rank <= 5",
        "stg_contrat",
    ),
)
def dq_type_samples(spark, sf_dir):
    return Q.type_samples(staging(spark, sf_dir, "stg_contrat"), Q.CONTRACTS)


@check(
    "dq_duplicates_key",
    staging_sql(
        """SELECT id, idcontrat, typcontrat FROM (SELECT *, row_number() OVER (PARTITION BY idcontrat ORDER BY id) AS rn
        FROM stg_contrat WHERE idcontrat IS NOT NULL) WHERE rn > 1""",
        "stg_contrat",
    ),
)
def dq_duplicates_key(spark, sf_dir):
    return Q.violations(staging(spark, sf_dir, "stg_contrat"), Q.CONTRACTS, "duplicates").select("id", "idcontrat", "typcontrat")


@check("dq_duplicates_row", staging_sql(
    f"SELECT id, compte, soldeorigine FROM stg_compta QUALIFY row_number() OVER (PARTITION BY {_TRIMMED} ORDER BY id) > 1", "stg_compta"))
def dq_duplicates_row(spark, sf_dir):
    return Q.violations(staging(spark, sf_dir, "stg_compta"), Q.LEDGER, "duplicates").select("id", "compte", "soldeorigine")


@check("dq_violations_nulls", staging_sql(f"SELECT id, residence, agenteco FROM stg_tiers WHERE {null_sql(Q.CUSTOMERS)}", "stg_tiers"))
def dq_violations_nulls(spark, sf_dir):
    return Q.violations(staging(spark, sf_dir, "stg_tiers"), Q.CUSTOMERS, "nulls").select("id", "residence", "agenteco")


@check(
    "dq_violations_types",
    staging_sql(f"SELECT id, idtiers, agenteco FROM stg_tiers WHERE {' OR '.join(bad_sql(Q.CUSTOMERS).values())}", "stg_tiers"),
)
def dq_violations_types(spark, sf_dir):
    return Q.violations(staging(spark, sf_dir, "stg_tiers"), Q.CUSTOMERS, "types").select("id", "idtiers", "agenteco")


def _stage_sql(rules: Q.Rules, source: str, p: str = "s") -> str:
    """CTEs s1 (rule 1 survivors), s2 (and rule 2), s3 (and rule 3)."""
    key = rules.key[0]
    return f"""{p}1 AS (SELECT * FROM {source} WHERE NOT {null_sql(rules)}),
        {p}2 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY id) AS rn FROM {p}1) WHERE rn = 1 OR {key} IS NULL),
        {p}3 AS (SELECT * FROM {p}2 WHERE NOT ({' OR '.join(bad_sql(rules).values())}))"""


@check(
    "dq_deletion_counts",
    staging_sql("", "stg_contrat").rstrip() + ",\n" + _stage_sql(Q.CONTRACTS, "stg_contrat")
    + """ SELECT a - b AS nulls, b - c AS duplicates, c - d AS bad_types, a - d AS total FROM
    (SELECT (SELECT count(*) FROM stg_contrat) a, (SELECT count(*) FROM s1) b, (SELECT count(*) FROM s2) c, (SELECT count(*) FROM s3) d)""",
)
def dq_deletion_counts(spark, sf_dir):
    return Q.deletion_counts(staging(spark, sf_dir, "stg_contrat"), Q.CONTRACTS)


_CLEAN_COLS = ["idtiers", "nomprenom", "residence", "agenteco", "sectionactivite", "datdouteux"]


@check(
    "dq_clean_customers",
    staging_sql("", "stg_tiers").rstrip() + ",\n" + _stage_sql(Q.CUSTOMERS, "stg_tiers")
    + ", fixed AS (" + _repair_sql("id, " + ", ".join(_CLEAN_COLS)).replace("FROM stg_tiers", "FROM s3") + ") SELECT id, "
    + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in [*_CLEAN_COLS, "nationalite", "chiffreaffaires", "douteux"]) + " FROM fixed",
)
def dq_clean_customers(spark, sf_dir):
    out = Q.clean(staging(spark, sf_dir, "stg_tiers"), Q.CUSTOMERS, C.repair_customers())
    return out.select("id", *_CLEAN_COLS, "nationalite", "chiffreaffaires", "douteux")


@check(
    "dq_orphans",
    staging_sql(
        """SELECT id, idcontrat FROM stg_compta c WHERE idcontrat IS NOT NULL AND idcontrat <> ''
        AND NOT EXISTS (SELECT 1 FROM stg_contrat k WHERE k.idcontrat = c.idcontrat)""",
        "stg_compta", "stg_contrat",
    ),
)
def dq_orphans(spark, sf_dir):
    out = Q.orphans(staging(spark, sf_dir, "stg_compta"), "idcontrat", staging(spark, sf_dir, "stg_contrat"))
    return out.select("id", "idcontrat").orderBy("id")


@check(
    "dq_orphan_counts",
    staging_sql(
        """SELECT count(*) AS orphans FROM stg_compta c WHERE idtiers IS NOT NULL AND idtiers <> ''
        AND NOT EXISTS (SELECT 1 FROM stg_tiers k WHERE k.idtiers = c.idtiers)""",
        "stg_compta", "stg_tiers",
    ),
)
def dq_orphan_counts(spark, sf_dir):
    return Q.orphan_count(staging(spark, sf_dir, "stg_compta"), "idtiers", staging(spark, sf_dir, "stg_tiers"))


_FACT_FROM = f"""SELECT DISTINCT {int_sql('agence')} AS numagence, nullif(trim(devise), '') AS devise, nullif(trim(devisebbnq), '') AS devisebnq,
    {int_sql('compte', 'BIGINT')} AS numcompte, {int_sql('chapitre', 'BIGINT')} AS chapitre,
    (SELECT max(t.idtiers) FROM stg_tiers t WHERE t.idtiers = nullif(trim(c.idtiers), '')) AS id_client,
    (SELECT max(k.idcontrat) FROM stg_contrat k WHERE k.idcontrat = nullif(trim(c.idcontrat), '')) AS id_contrat,
    {date_sql('date_bal')} AS date_value, {long_sql('soldeorigine')} AS soldeorigine, {dec_sql('soldeconvertie')} AS soldeconvertie,
    {long_sql('cumulmvtdb')} AS cumulmvtdb, {long_sql('cumulmvtcr')} AS cumulmvtcr, {long_sql('soldeinitdebmois')} AS soldeinitdebmois,
    {long_sql('amount')} AS amount, {int_sql('actif')} AS actif FROM stg_compta c"""


@check(
    "dq_balance_reconcile",
    staging_sql(
        f"""SELECT CAST(s AS DOUBLE) AS balance_sum, CAST(l AS DOUBLE) AS fact_sum,
        CAST(CASE WHEN abs(s - l) < 1 THEN 0 ELSE s - l END AS DOUBLE) AS difference FROM
        (SELECT coalesce(sum({dec_sql('soldeconvertie')}), 0) AS s FROM stg_compta),
        (SELECT coalesce(sum({dec_sql('soldeconvertie')}), 0) AS l FROM (SELECT DISTINCT * EXCLUDE id FROM stg_compta))""",
        "stg_compta",
    ),
)
def dq_balance_reconcile(spark, sf_dir):
    ledger = staging(spark, sf_dir, "stg_compta")
    loaded = ledger.drop("id").distinct().select(C.clean_decimal("soldeconvertie").alias("soldeconvertie"))
    out = Q.balance_sums(ledger, loaded)
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns])


@check(
    "balance_reconcile_loaded",
    staging_sql(
        f"""SELECT CAST(s AS DOUBLE) AS balance_sum, CAST(l AS DOUBLE) AS fact_sum,
        CAST(CASE WHEN abs(s - l) < 1 THEN 0 ELSE s - l END AS DOUBLE) AS difference FROM
        (SELECT coalesce(sum({dec_sql('soldeconvertie')}), 0) AS s FROM stg_compta),
        (SELECT coalesce(sum(soldeconvertie), 0) AS l FROM ({_FACT_FROM}))""",
    ),
)
def balance_reconcile_loaded(spark, sf_dir):
    """The ledger against the facts that it became."""
    ledger, dims = _small_dims(spark, sf_dir)
    out = Q.balance_sums(ledger, D.fact_rows(ledger, dims, accounts_known=True))
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns])


@check("dq_rejected_numbers", staging_sql(
    "SELECT " + ", ".join(f"count(CASE WHEN nullif(trim({c}), '') IS NOT NULL AND {dec_sql(c)} IS NULL THEN 1 END) AS {c}" for c in ("soldeorigine", "soldeconvertie", "cumulmvtdb"))
    + " FROM stg_compta", "stg_compta"))
def dq_rejected_numbers(spark, sf_dir):
    return Q.rejected_numbers(staging(spark, sf_dir, "stg_compta"), ["soldeorigine", "soldeconvertie", "cumulmvtdb"])


@check(
    "dim_distinct_union",
    staging_sql(
        """SELECT DISTINCT devise FROM (SELECT nullif(trim(devise), '') AS devise FROM stg_compta UNION ALL
        SELECT nullif(trim(devisebbnq), '') FROM stg_compta UNION ALL SELECT nullif(trim(devise), '') FROM stg_contrat) WHERE devise IS NOT NULL""",
        "stg_compta", "stg_contrat",
    ),
)
def dim_distinct_union(spark, sf_dir):
    ledger = D.currencies(staging(spark, sf_dir, "stg_compta"), "devise", "devisebbnq")
    return ledger.unionByName(D.currencies(staging(spark, sf_dir, "stg_contrat"), "devise")).distinct()


@check(
    "dim_insert_ignore",
    """WITH old AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 5),
    new AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
    fresh AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.p_brand = n.p_brand AND o.p_type IS NOT DISTINCT FROM n.p_type))
    SELECT * FROM fresh""",
)
def dim_insert_ignore(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = D.number_rows(part.filter("p_size <= 5").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"])
    kind = F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("p_type")
    new = part.select("p_brand", kind).distinct()
    return D.insert_ignore(old, new, ["p_brand", "p_type"]).drop("id")


@check(
    "dim_upsert_label",
    """WITH old AS (SELECT p_size AS numcompte, max(p_name) AS l FROM part WHERE p_size <= 30 GROUP BY 1),
    new AS (SELECT p_size AS numcompte, max(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END) AS l FROM part WHERE p_size > 20 GROUP BY 1)
    SELECT CAST(coalesce(o.numcompte, n.numcompte) AS BIGINT) AS numcompte, coalesce(n.l, o.l) AS libellecompte FROM old o FULL JOIN new n ON o.numcompte = n.numcompte""",
)
def dim_upsert_label(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("numcompte", F.col("p_size").cast("bigint"))
    old = part.filter("p_size <= 30").groupBy("numcompte").agg(F.max("p_name").alias("libellecompte"))
    label = F.when(F.col("p_size") % 4 != 0, F.col("p_type"))
    new = part.filter("p_size > 20").groupBy("numcompte").agg(F.max(label).alias("libellecompte"))
    numbered = D.number_rows(old, ["numcompte"])
    return D.upsert_label(numbered, new, "numcompte", "libellecompte").drop("id")


_RES = "SELECT DISTINCT nullif(trim(nationalite), '') AS pays, nullif(trim(residence), '') AS residence FROM stg_tiers"


@check(
    "dim_nullsafe_join",
    staging_sql(
        f"""SELECT d.pays, d.residence, count(*) AS clients FROM stg_tiers t JOIN ({_RES}) d
        ON d.pays IS NOT DISTINCT FROM nullif(trim(t.nationalite), '') AND d.residence IS NOT DISTINCT FROM nullif(trim(t.residence), '')
        WHERE d.pays IS NOT NULL OR d.residence IS NOT NULL GROUP BY ALL""",
        "stg_tiers",
    ),
)
def dim_nullsafe_join(spark, sf_dir):
    tiers = staging(spark, sf_dir, "stg_tiers").withColumn("residencenum", F.lit(None).cast("int"))
    dim = D.number_rows(D.residences(tiers), ["pays", "residence", "geo"])
    rows = tiers.select(C.blank_to_null("nationalite").alias("pays"), C.blank_to_null("residence").alias("residence"))
    found = D.lookup(rows, dim, {"pays": "pays", "residence": "residence"}, "id_residence", null_safe=True)
    return found.filter(F.col("id_residence").isNotNull()).groupBy("pays", "residence").agg(F.count(F.lit(1)).alias("clients"))


def _small_dims(spark, sf_dir):
    """The ledger and the dimensions found in it, each stored before it is looked up."""
    folder = work_folder(spark)
    ledger = written(staging(spark, sf_dir, "stg_compta"), f"{folder}/ledger")
    pool = written(D.ledger_members(ledger).distinct(), f"{folder}/members")
    names = ("sub_dim_agence", "sub_dim_devise", "sub_dim_chapitre", "sub_dim_date")
    dims = {n: D.number_rows(D.pooled(pool, n, D.POOLED[n]), list(D.POOLED[n])) for n in names} | {
        "sub_dim_compte": D.number_rows(D.pooled_accounts(pool), ["numcompte"]),
        "dim_client": staging(spark, sf_dir, "stg_tiers").select("idtiers").filter("idtiers IS NOT NULL").distinct(),
        "dim_contrat": staging(spark, sf_dir, "stg_contrat").select(F.col("idcontrat").alias("id")).filter("id IS NOT NULL").distinct(),
    }
    return ledger, {n: written(df, f"{folder}/{n}") for n, df in dims.items()}


@check("fact_keys", staging_sql(_FACT_FROM.replace("AS soldeconvertie,", "AS sc,").replace("SELECT DISTINCT", "SELECT * EXCLUDE sc, CAST(sc AS DOUBLE) AS soldeconvertie FROM (SELECT DISTINCT") + ")"))
def fact_keys(spark, sf_dir):
    """Fact rows with surrogate keys, shown by the natural keys those point at."""
    ledger, dims = _small_dims(spark, sf_dir)
    fact = D.fact_rows(ledger, dims, accounts_known=True)
    for out, name, key in (
        ("numagence", "sub_dim_agence", "id_agence"), ("devise", "sub_dim_devise", "id_devise"),
        ("chapitre", "sub_dim_chapitre", "id_chapitre"), ("date_value", "sub_dim_date", "id_date"),
        ("numcompte", "sub_dim_compte", "id_compte"),
    ):
        fact = D.lookup(fact, dims[name], {key: "id"}, out, id_col=out)
    bank = dims["sub_dim_devise"].withColumnRenamed("devise", "devisebnq")
    fact = D.lookup(fact, bank, {"id_devisebnq": "id"}, "devisebnq", id_col="devisebnq")
    fact = fact.withColumn("soldeconvertie", F.col("soldeconvertie").cast("double"))
    return fact.drop("id_agence", "id_devise", "id_devisebnq", "id_chapitre", "id_date", "id_compte")


# Facts of fifteen filled columns; every third order stands there twice, with higher ids.
_FACTS = """SELECT l_orderkey * 10 + l_linenumber + c.copy * 1000000000000 AS id, l_suppkey % 7 AS id_agence, l_partkey % 4 AS id_devise,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 5 END AS id_devisebnq, l_partkey % 90 AS id_compte, l_partkey % 50 AS id_chapitre,
    CAST(o_custkey % 20 AS STRING) AS id_client, CASE WHEN l_linenumber > 3 THEN NULL ELSE CAST(l_orderkey % 30 AS STRING) END AS id_contrat,
    CAST(year(l_shipdate) AS BIGINT) AS id_date, CAST(l_quantity AS BIGINT) % 3 AS soldeorigine, CAST(l_tax AS DECIMAL(18,4)) AS soldeconvertie,
    CAST(l_linenumber AS BIGINT) AS cumulmvtdb, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_linenumber % 2 AS BIGINT) END AS cumulmvtcr,
    CAST(l_suppkey % 2 AS BIGINT) AS soldeinitdebmois, CAST(l_quantity AS BIGINT) % 2 AS amount, CAST(l_linenumber % 2 AS INT) AS actif
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) c ON c.copy = 0 OR l_orderkey % 3 = 0"""
_FACT_COLS = ", ".join([*D.FACT_KEYS, *D.MEASURES])


@check("fact_dedup", f"SELECT min(id) AS id, {_FACT_COLS.replace('soldeconvertie', 'CAST(soldeconvertie AS DOUBLE) AS soldeconvertie')} FROM ({duck(_FACTS)}) GROUP BY {_FACT_COLS}")
def fact_dedup(spark, sf_dir):
    rows = D.dedup_fact(view(spark, sf_dir, _FACTS))
    return rows.withColumn("soldeconvertie", F.col("soldeconvertie").cast("double"))


@check(
    "repoint_winner",
    """WITH acc AS (SELECT p_partkey AS id, p_partkey // 3 AS numcompte FROM part),
    win AS (SELECT a.id, min(b.id) AS keep FROM acc a JOIN acc b USING (numcompte) GROUP BY a.id)
    SELECT keep AS id_compte, count(*) AS facts FROM lineitem JOIN win ON l_partkey = win.id GROUP BY keep""",
)
def repoint_winner(spark, sf_dir):
    accounts = view(spark, sf_dir, _ACCOUNTS)
    fact = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id_compte"))
    return D.repoint_accounts(fact, accounts).groupBy("id_compte").agg(F.count(F.lit(1)).alias("facts"))


_ACCOUNTS = "SELECT p_partkey AS id, p_partkey DIV 3 AS numcompte FROM {part}"


@check("accounts_kept", "SELECT min(p_partkey) AS id, p_partkey // 3 AS numcompte FROM part GROUP BY 2")
def accounts_kept(spark, sf_dir):
    return D.keep_lowest_account(view(spark, sf_dir, _ACCOUNTS))


@check(
    "category_backfill",
    """SELECT c_custkey, coalesce(m.id, 9) AS famille_id FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment)
        WHEN 1 THEN concat('  ', c_mktsegment, ' ') WHEN 2 THEN NULL ELSE c_mktsegment END AS famille FROM customer) c
    LEFT JOIN (VALUES (1, 'Automobile'), (2, 'BUILDING '), (3, 'Household'), (9, 'Autres')) m(id, name) ON lower(trim(m.name)) = lower(trim(c.famille))""",
)
def category_backfill(spark, sf_dir):
    rows = view(spark, sf_dir, """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment)
        WHEN 1 THEN concat('  ', c_mktsegment, ' ') WHEN 2 THEN NULL ELSE c_mktsegment END AS famille FROM {customer}""")
    names = spark.createDataFrame([(1, "Automobile"), (2, "BUILDING "), (3, "Household"), (9, "Autres")], "id int, name string")
    return D.backfill_category(rows, "famille", names, "famille_id", "Autres").drop("famille")


MAPPING = {"s_suppkey": "id", "s_name": "nomprenom", "s_acctbal": "solde", "s_text": "chiffreaffaires"}
_SUPPLIER = """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE concat(' ', s_name, ' ') END AS s_name,
    CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) AS s_acctbal,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(' ', CAST(s_suppkey AS STRING)) END AS s_text, s_nationkey FROM {supplier}"""


@check(
    "mapped_load",
    f"""SELECT s_suppkey AS id, CASE WHEN trim(s_name) = '' THEN NULL ELSE s_name END AS nomprenom,
    CAST(s_acctbal AS DOUBLE) AS solde, CAST(nullif(trim(s_text), '') AS INT) AS chiffreaffaires, DATE '2024-03-31' AS date_bal FROM ({duck(_SUPPLIER)})""",
)
def mapped_load(spark, sf_dir):
    types = {"id": "bigint", "nomprenom": "string", "solde": "decimal(18,2)", "chiffreaffaires": "int", "date_bal": "date"}
    out = L.project(view(spark, sf_dir, _SUPPLIER), MAPPING, types, date_bal="31/03/2024")
    return out.withColumn("solde", F.col("solde").cast("double"))


@check(
    "dim_accounts",
    staging_sql(
        f"""SELECT numcompte, max(l) AS libellecompte FROM (SELECT {int_sql('compte', 'BIGINT')} AS numcompte, nullif(trim(libellecompte), '') AS l FROM stg_compta)
        WHERE numcompte IS NOT NULL GROUP BY 1""",
        "stg_compta",
    ),
)
def dim_accounts(spark, sf_dir):
    return D.accounts(staging(spark, sf_dir, "stg_compta"))


@check(
    "dim_residences",
    staging_sql(
        f"""SELECT DISTINCT nullif(trim(nationalite), '') AS pays, nullif(trim(c.residence), '') AS residence, {_LABEL} AS geo FROM
        (SELECT t.*, CASE WHEN t.residence IS NOT NULL THEN coalesce(m.zone, 144) END AS z FROM stg_tiers t
         LEFT JOIN {ZONE_CODES} m(pays, zone) ON m.pays = upper(trim(t.residence))) c
        WHERE nullif(trim(nationalite), '') IS NOT NULL OR nullif(trim(c.residence), '') IS NOT NULL OR z IS NOT NULL""",
        "stg_tiers",
    ),
)
def dim_residences(spark, sf_dir):
    return D.residences(R.recode_customers(staging(spark, sf_dir, "stg_tiers")))


def _line(*values: str) -> str:
    """DuckDB SQL of one text of several values."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({v} AS VARCHAR), '~')" for v in values) + ")"


_CUSTOMER = ["idtiers", "nomprenom", "raisonsoc", "residence", "agenteco", "sectionactivite", "datdouteux", "nomgrpaffaires"]
_FIXED = [*_CUSTOMER, "nationalite", "chiffreaffaires", "douteux"]
_MEASURES = ["soldeorigine", "CAST(soldeconvertie * 10000 AS BIGINT)", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois", "amount", "actif"]
# The contents of all tables, surrogate ids shown by what they stand for.
MART = (
    staging_sql("").rstrip() + ",\n" + _stage_sql(Q.CUSTOMERS, "stg_tiers", "cu") + ",\n" + _stage_sql(Q.CONTRACTS, "stg_contrat", "co") + f""",
cu4 AS ({_repair_sql("id, grpaffaires, " + ", ".join(_CUSTOMER)).replace("FROM stg_tiers", "FROM cu3")}),
cu5 AS (SELECT id, grpaffaires, {", ".join(f"nullif(trim({c}), '') AS {c}" for c in _FIXED)} FROM cu4),
cu6 AS (SELECT cu5.* EXCLUDE (agenteco), coalesce(CAST(a.code AS VARCHAR), agenteco) AS agenteco,
    CASE WHEN cu5.residence IS NOT NULL THEN coalesce(zone, 144) END AS z,
    CASE WHEN regexp_matches(sectionactivite, '{INT}') THEN CAST(sectionactivite AS INT) // 10 END AS v
    FROM cu5 LEFT JOIN {ZONE_CODES} m(pays, zone) ON m.pays = upper(cu5.residence) LEFT JOIN {AGENT_CODES} a(src, code) ON CAST(a.src AS VARCHAR) = cu5.agenteco),
nearest AS (SELECT v, arg_min(k.code, (abs(k.k - v), k.k)) AS section FROM (SELECT DISTINCT v FROM cu6 WHERE v IS NOT NULL) x, {_values(_KEYS)} k(k, code) GROUP BY v),
customers AS (SELECT cu6.*, nationalite AS pays, {_LABEL} AS geo, section, {int_sql('douteux')} AS doubt, {date_sql('datdouteux')} AS doubt_day,
    douteux IS NOT NULL OR datdouteux IS NOT NULL AS doubted, nationalite IS NOT NULL OR residence IS NOT NULL OR z IS NOT NULL AS placed
    FROM cu6 LEFT JOIN nearest USING (v)),
contracts AS (SELECT nullif(trim(idcontrat), '') AS idcontrat, nullif(trim(idtiers), '') AS idtiers, {int_sql('agence')} AS agence, nullif(trim(devise), '') AS devise,
    p.code AS purpose, CASE lower(trim(typcontrat)) WHEN 'p' THEN 'PRET' WHEN 'd' THEN 'COMPTE ORDINAIRE' ELSE nullif(trim(typcontrat), '') END AS kind,
    {date_sql(norm_sql('datouv'))} AS opened, {date_sql(norm_sql('datech'))} AS due, {int_sql('ancienneteimpaye')} AS late, {int_sql('tauxcontrat')} AS rate, {int_sql('actif')} AS actif
    FROM co3 LEFT JOIN {PURPOSE_CODES} p(src, code) ON CAST(p.src AS VARCHAR) = trim(co3.objetfinance)),
facts AS ({_FACT_FROM.replace("FROM stg_tiers t", "FROM cu3 t").replace("FROM stg_contrat k", "FROM co3 k")}),
accounts AS (SELECT {int_sql('compte', 'BIGINT')} AS numcompte, max(nullif(trim(libellecompte), '')) AS label FROM stg_compta GROUP BY 1),
texts AS (
    SELECT DISTINCT 'sub_dim_residence' AS "table", {_line("pays", "residence", "geo")} AS content FROM customers WHERE placed
    UNION ALL SELECT DISTINCT 'sub_dim_douteux', {_line("doubt", "doubt_day")} FROM customers WHERE doubted
    UNION ALL SELECT 'sub_dim_grpaffaire', {_line("grpaffaires", "min(nomgrpaffaires)")} FROM customers WHERE grpaffaires IS NOT NULL GROUP BY grpaffaires
    UNION ALL SELECT 'sub_dim_agenteco', content FROM (VALUES ('25'), ('21100|Banque Centrales'), ('24200|Particuliers'), ('27000|Autres organismes')) x(content)
    UNION ALL SELECT 'sub_dim_sectionactivite', content FROM (VALUES ('89'), ('3|Peche, pisciculture, acquaculture')) x(content)
    UNION ALL SELECT 'sub_dim_objetfinance', content FROM (VALUES ('7'), ('1311|Credits immobiliers residentiel'), ('1360|Autres Credits')) x(content)
    UNION ALL SELECT DISTINCT 'sub_dim_agence', CAST(a AS VARCHAR) FROM (SELECT agence AS a FROM contracts UNION SELECT numagence FROM facts) WHERE a IS NOT NULL
    UNION ALL SELECT DISTINCT 'sub_dim_devise', a FROM (SELECT devise AS a FROM contracts UNION SELECT devise FROM facts UNION SELECT devisebnq FROM facts) WHERE a IS NOT NULL
    UNION ALL SELECT DISTINCT 'sub_dim_date', CAST(a AS VARCHAR) FROM (SELECT opened AS a FROM contracts UNION SELECT due FROM contracts UNION SELECT date_value FROM facts) WHERE a IS NOT NULL
    UNION ALL SELECT DISTINCT 'sub_dim_typcontrat', kind FROM contracts WHERE kind IS NOT NULL
    UNION ALL SELECT DISTINCT 'sub_dim_chapitre', CAST(chapitre AS VARCHAR) FROM facts WHERE chapitre IS NOT NULL
    UNION ALL SELECT 'sub_dim_compte', {_line("numcompte", "label")} FROM accounts WHERE numcompte IS NOT NULL
    UNION ALL SELECT 'dim_client', {_line("idtiers", "CASE WHEN placed THEN " + _line("pays", "residence", "geo") + " ELSE '~|~|~' END",
        "CASE WHEN agenteco IN ('21100', '22220', '24200', '21311', '23300') THEN agenteco END",
        "CASE WHEN doubted THEN " + _line("doubt", "doubt_day") + " ELSE '~|~' END", "grpaffaires", "section", "nomprenom", "raisonsoc", "chiffreaffaires")}
        FROM customers WHERE idtiers IS NOT NULL
    UNION ALL SELECT 'dim_contrat', {_line("idcontrat", "(SELECT max(c.idtiers) FROM cu5 c WHERE c.idtiers = contracts.idtiers)", "agence", "devise", "purpose", "kind", "opened", "due", "late", "rate", "actif")}
        FROM contracts WHERE idcontrat IS NOT NULL
    UNION ALL SELECT 'fact_balance', {_line("numagence", "devise", "devisebnq", "numcompte", "chapitre", "id_client", "id_contrat", "date_value", *_MEASURES)} FROM facts)
SELECT * FROM texts"""
)


def _contents(tables):
    """One line of text for every row of every table, keys replaced by what they point at."""

    def line(*values):
        return F.concat_ws("|", *[F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("~")) for v in values])

    def named(name, id_col, *columns):
        dim = tables[name]
        return dim.select(F.col("id").alias(id_col), line(*columns).alias(f"{id_col}_text"))

    def look(df, name, id_col, *columns):
        return df.join(named(name, id_col, *columns), id_col, "left").withColumn(
            f"{id_col}_text", F.coalesce(f"{id_col}_text", F.lit("|".join("~" * len(columns)))))

    plain = {
        "sub_dim_residence": ["pays", "residence", "geo"], "sub_dim_douteux": ["douteux", "datdouteux"], "sub_dim_grpaffaire": ["id", "nomgrpaffaires"],
        "sub_dim_agence": ["numagence"], "sub_dim_devise": ["devise"], "sub_dim_date": ["date_value"], "sub_dim_typcontrat": ["typcontrat"],
        "sub_dim_chapitre": ["chapitre"], "sub_dim_compte": ["numcompte", "libellecompte"],
    }
    out = [(n, tables[n].select(line(*c).alias("content"))) for n, c in plain.items()]
    for name, some in (("sub_dim_agenteco", [21100, 24200, 27000]), ("sub_dim_sectionactivite", [3]), ("sub_dim_objetfinance", [1311, 1360])):
        out.append((name, tables[name].agg(F.count(F.lit(1)).cast("string").alias("content"))))
        out.append((name, tables[name].where(F.col("id").isin(some)).select(line("id", "libelle").alias("content"))))
    clients = look(tables["dim_client"], "sub_dim_residence", "id_residence", "pays", "residence", "geo")
    clients = look(clients, "sub_dim_douteux", "id_douteux", "douteux", "datdouteux")
    out.append(("dim_client", clients.select(line(
        "idtiers", "id_residence_text", "id_agenteco", "id_douteux_text", "id_grpaffaire", "id_sectionactivite", "nomprenom", "raisonsoc", "chiffreaffaires").alias("content"))))
    contracts = tables["dim_contrat"].withColumnRenamed("id", "idcontrat")
    for name, key, column in (("sub_dim_agence", "id_agence", "numagence"), ("sub_dim_devise", "id_devise", "devise"), ("sub_dim_typcontrat", "id_typcontrat", "typcontrat"),
                              ("sub_dim_date", "id_dateouverture", "date_value"), ("sub_dim_date", "id_dateecheance", "date_value")):
        contracts = look(contracts, name, key, column)
    out.append(("dim_contrat", contracts.select(line(
        "idcontrat", "id_client", "id_agence_text", "id_devise_text", "id_objetfinance", "id_typcontrat_text", "id_dateouverture_text", "id_dateecheance_text",
        "ancienneteimpaye", "tauxcontrat", "actif").alias("content"))))
    facts = tables["fact_balance"]
    for name, key, column in (("sub_dim_agence", "id_agence", "numagence"), ("sub_dim_devise", "id_devise", "devise"), ("sub_dim_devise", "id_devisebnq", "devise"),
                              ("sub_dim_compte", "id_compte", "numcompte"), ("sub_dim_chapitre", "id_chapitre", "chapitre"), ("sub_dim_date", "id_date", "date_value")):
        facts = look(facts, name, key, column)
    measures = [(F.col(m) * 10000).cast("bigint") if m == "soldeconvertie" else m for m in D.MEASURES]
    out.append(("fact_balance", facts.select(line(
        "id_agence_text", "id_devise_text", "id_devisebnq_text", "id_compte_text", "id_chapitre_text", "id_client", "id_contrat", "id_date_text", *measures).alias("content"))))
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table"), "content") for n, df in out])


def _loaded(spark, sf_dir):
    folder = work_folder(spark)
    with shuffles_removed(spark):
        raw = [written(staging(spark, sf_dir, n), f"{folder}/raw_{n}", **PASSING) for n in ("stg_tiers", "stg_contrat", "stg_compta")]
        return D.clean_staging(*raw, folder), f"{folder}/mart"


@check("datamart_load", MART)
def datamart_load(spark, sf_dir):
    """Clean, recode and load all three staging tables; the contents of all fifteen tables."""
    clean, root = _loaded(spark, sf_dir)
    return _contents(D.load_datamart(spark, *clean, root))


@check("datamart_reload", MART)
def datamart_reload(spark, sf_dir):
    """Half of the ledger and the customers first, then all of it: the same contents as from one load."""
    (customers, contracts, ledger), root = _loaded(spark, sf_dir)
    some = ledger.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    # Labels go by the greatest of a load, so the first load sees those of all rows.
    D.load_datamart(spark, customers, contracts, some.withColumn("libellecompte", F.lit(None).cast("string")), root)
    return _contents(D.load_datamart(spark, customers, contracts, ledger, root))


@check("datamart_buckets", MART)
def datamart_buckets(spark, sf_dir):
    """Facts and contracts stored in buckets by contract: the same contents."""
    clean, root = _loaded(spark, sf_dir)
    return _contents(D.load_datamart(spark, *clean, root, buckets=8))


# Labels that the staging values come to, with their customers and contracts.
_SEEDED = """SELECT 'agenteco' AS kind, m.label, count(*) AS rows FROM stg_tiers t JOIN (VALUES
        ('100', 'Banque Centrales'), ('230', 'Societes non financieres privees nationales'), ('320', 'Particuliers'), ('400', 'Particuliers'),
        ('266', 'Societes d''assurances'), ('203', 'Administrations de securite sociale')) m(src, label) ON m.src = trim(t.agenteco) GROUP BY 2
    UNION ALL SELECT 'objetfinance', m.label, count(*) FROM stg_contrat t JOIN (VALUES ('10234', 'Credits a la consommation'),
        ('30411', 'Credits immobiliers residentiel'), ('14259', 'Credits d''exploitation'), ('48350', 'Credits d''equipement')) m(src, label)
        ON m.src = trim(t.objetfinance) GROUP BY 2"""


@check("labels_seeded", staging_sql(_SEEDED, "stg_tiers", "stg_contrat"))
def labels_seeded(spark, sf_dir):
    """Label tables of codes, stored and read back, and how many staging rows carry each label."""
    root = work_folder(spark)
    tables = D.seed_labels(spark, root)
    D.seed_labels(spark, root)  # a second seeding adds nothing
    agents = R.recode_customers(staging(spark, sf_dir, "stg_tiers")).select(F.lit("agenteco").alias("kind"), C.guarded("agenteco", "bigint").alias("id"))
    purposes = R.recode_contracts(staging(spark, sf_dir, "stg_contrat")).select(F.lit("objetfinance").alias("kind"), C.guarded("objetfinance", "bigint").alias("id"))
    found = [rows.join(spark.read.parquet(f"{root}/{name}"), "id") for rows, name in ((agents, "sub_dim_agenteco"), (purposes, "sub_dim_objetfinance"))]
    assert len(tables) == 3
    return found[0].unionByName(found[1]).groupBy("kind", F.col("libelle").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
    WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"""


@check(
    "catalog_tables",
    f"""SELECT table_name, CAST(ordinal_position AS INT) AS position, column_name AS name, {_TYPES} AS type, is_nullable = 'YES' AS nullable
    FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ({", ".join(f"'{t}'" for t in TEST_TABLES)})""",
)
def catalog_tables(spark, sf_dir):
    """The test tables as tables of a catalog, discovered with their columns."""
    database = "tables_" + sf_dir.rstrip("/").rpartition("/")[2].replace(".", "_").replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in TEST_TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} USING parquet OPTIONS (path '{sf_dir}/{name}.parquet')")
    found = discover(spark_columns(spark, database), database)
    return found.select("table_name", F.inline("columns"))


@check(
    "surrogate_ids",
    """SELECT count(*) FILTER (c_custkey % 3 <> 0) AS added, 1000 + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + 1 AS first_id,
    1000 + count(*) AS last_id, count(*) FILTER (c_custkey % 3 <> 0) AS ids, true AS kept, true AS again FROM customer""",
)
def surrogate_ids(spark, sf_dir):
    """Ids go on after the old ones without a gap, old ones stay, and a second run gives the same."""
    people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    old = D.number_rows(people.filter("c_custkey % 3 = 0").select("name"), ["name"], 1000)
    new = D.insert_ignore(old, people.select("name"), ["name"])
    twice = D.insert_ignore(old.unionByName(new), people.select("name"), ["name"])
    repeat = D.insert_ignore(old, people.orderBy(F.desc("c_custkey")).select("name"), ["name"])
    differ = new.join(repeat, ["id", "name"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("again"))
    nothing = twice.agg((F.count(F.lit(1)) == 0).alias("kept"))
    facts = new.agg(
        F.count(F.lit(1)).alias("added"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids")
    )
    return Q.one_row(facts, nothing, differ)


@check("load_reconciled", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def load_reconciled(spark, sf_dir):
    """One load whose rows all arrived, and one that came short and is never read."""
    folder = work_folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    whole, short = orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")
    L.load_table(whole, f"{folder}/orders", "first", whole.count(), f"{folder}/log")
    try:
        L.load_table(short, f"{folder}/orders", "second", short.count() + 1, f"{folder}/log")
    except ValueError:
        return L.read_loads(spark, f"{folder}/orders", f"{folder}/log").select("o_orderkey", "o_custkey")
    raise AssertionError("a short load was taken")


@check("quality_log", f"SELECT c.*, 'COMPLETED' AS status FROM ({ORACLE['dq_counters']}) c, (VALUES (1), (2)) r(run)")
def quality_log(spark, sf_dir):
    """Two runs of the counters, read back without their time."""
    path = f"{work_folder(spark)}/runs"
    for _ in range(2):
        L.log_run(dq_counters(spark, sf_dir), path)
    return spark.read.parquet(path).drop("executed_at")


_SHEET = """SELECT CASE WHEN page_id % 4 = 0 THEN ' ' ELSE concat(' ', url) END AS ` Url `, CASE WHEN page_id % 4 = 0 THEN NULL ELSE html END AS Content,
    CASE WHEN page_id % 8 = 4 THEN 'x ' ELSE '' END AS `  ` FROM {pages}"""


@check(
    "sheet_rows",
    f"""SELECT trim(" Url ") AS url, coalesce(trim(Content), '') AS content, trim("  ") AS col_2 FROM ({duck(_SHEET).replace('`', '"')})
    WHERE trim(" Url ") <> '' OR coalesce(trim(Content), '') <> '' OR trim("  ") <> ''""",
)
def sheet_rows(spark, sf_dir):
    return tidy(view(spark, sf_dir, _SHEET))
