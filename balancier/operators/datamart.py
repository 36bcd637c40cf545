"""Dimensions with surrogate keys, the fact table, and table maintenance."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balancier.functions import cleaning as C
from balancier.functions import recode as R
from balancier.functions.sections import SECTION_LABELS
from balancier.operators import buckets as B
from balancier.operators import quality as Q
from balancier.session import PASSING, shuffles_removed, work_folder, written

# Labels of the code dimensions.
AGENT_LABELS = {
    21100: "Banque Centrales",
    21210: "Centre des Cheques Postaux",
    21220: "Caisse National D'Epargne",
    21230: "Banques",
    21240: "Etablissements financiers a caractere bancaire autorises a recevoir des depots",
    21250: "Systemes Financiers Decentralises (SFD) autorises a collecter les depots",
    21311: "Societes d'assurances",
    21312: "Fonds de pension",
    21321: "Etablissements financiers a caractere bancaires non autorises a recevoir des depots",
    21322: "SFD non autorises a collecter de l'epargne",
    21323: "Divers autres intermediaires financiers",
    21330: "Auxiliaires financiers",
    23100: "Administration publique centrale",
    23200: "Administrations locales et regionales",
    23300: "Administrations de securite sociale",
    24100: "Entreprises individuelles",
    24200: "Particuliers",
    25000: "Institutions Sans But Lucratif au Service des Menages (ISBLSM)",
    26100: "Banques Multilaterales de Developpement",
    26200: "Autres institutions financieres internationales",
    27000: "Autres organismes",
    22120: "Etablissements publics a caractere indistruel ou commercial",
    22220: "Societes non financieres privees nationales",
    22110: "Societes publiques non financieres Production biens et services",
    22210: "Societes non financieres sous controle etranger",
}
PURPOSE_LABELS = {
    1311: "Credits immobiliers residentiel",
    1312: "Credits immobiliers commercial",
    1320: "Credits d'exploitation",
    1330: "Credits d'equipement",
    1340: "Credits a la consommation",
    1350: "Credits de tresorerie",
    1360: "Autres Credits",
}

FACT_KEYS = ("id_agence", "id_devise", "id_devisebnq", "id_compte", "id_chapitre", "id_client", "id_contrat", "id_date")
MEASURES = ("soldeorigine", "soldeconvertie", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois", "amount", "actif")


def not_yet_in(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the table lacks; NULL keys equal NULL keys."""
    known = existing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    cond = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return new.join(known, cond, "left_anti")


def number_rows(df: DataFrame, keys: Sequence[str], after: int = 0, id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """Dense ids after ``after`` for rows that are unique on ``keys``.

    Rows spread over hash buckets, are numbered inside each, and every bucket starts
    where the ones before it end. Ids follow the bucket and then the keys, so the same rows
    get the same ids in every run with as many buckets: four for each shuffle partition,
    unless the caller says how many.
    """
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most `buckets` rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = spread.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(starts), "_b")
    ident = (F.lit(after) + F.col("_start") + F.col("_i")).cast("bigint").alias(id_col)
    return numbered.select(ident, *df.columns)


def number_stored(stored: DataFrame, after: int = 0, id_col: str = "id") -> DataFrame:
    """Dense ids after ``after`` for rows read from Parquet files, without a shuffle.

    A row's id is its place in its file, and every file starts where the ones before it end.
    """
    columns = stored.columns
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_i"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # a row for each file
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ident = (F.lit(after) + F.col("_start") + F.col("_i") + 1).cast("bigint").alias(id_col)
    return placed.join(F.broadcast(starts), "_file").select(ident, *columns)


def _top(existing: DataFrame | None, id_col: str) -> int:
    if existing is None:
        return 0
    return existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]


def insert_ignore(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], id_col: str | None = "id") -> DataFrame:
    """Rows to append: distinct new keys the table lacks, numbered after its highest id."""
    fresh = new if existing is None else not_yet_in(new, existing, keys)
    if id_col is None:
        return fresh
    return number_rows(fresh, keys, _top(existing, id_col), id_col)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, chosen inside the aggregation."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r")).select("r.*").select(*df.columns)


def upsert_label(existing: DataFrame, new: DataFrame, key: str, label: str, id_col: str = "id") -> DataFrame:
    """The table after the upsert: a new label replaces the old unless it is NULL."""
    fresh = insert_ignore(existing.select(id_col, key), new.select(key), [key], id_col)
    old = existing.unionByName(fresh.withColumn(label, F.lit(None).cast("string")))
    incoming = new.select(F.col(key).alias("_k"), F.col(label).alias("_label"))
    return old.join(incoming, F.col(key) == F.col("_k"), "left").select(
        id_col, key, F.coalesce("_label", label).alias(label)
    )


def distinct_of(df: DataFrame, columns: Sequence[Column], name: str) -> DataFrame:
    """Distinct non-NULL values of several expressions, from one scan."""
    values = F.array_distinct(F.array(*columns))
    return df.select(F.explode(values).alias(name)).filter(F.col(name).isNotNull()).distinct()


# --- dimension members found in staging ------------------------------------------


def agencies(staging: DataFrame) -> DataFrame:
    return distinct_of(staging, [C.guarded("agence")], "numagence")


def currencies(staging: DataFrame, *columns: str) -> DataFrame:
    return distinct_of(staging, [C.blank_to_null(c) for c in columns], "devise")


def dates(staging: DataFrame, *columns: str) -> DataFrame:
    return distinct_of(staging, [C.parse_date(c) for c in columns], "date_value")


def chapters(ledger: DataFrame) -> DataFrame:
    return distinct_of(ledger, [C.guarded("chapitre", "bigint")], "chapitre")


def contract_types(contracts: DataFrame) -> DataFrame:
    return distinct_of(contracts, [C.blank_to_null("typcontrat")], "typcontrat")


def accounts(ledger: DataFrame) -> DataFrame:
    """One row per account with its greatest label."""
    rows = ledger.select(C.guarded("compte", "bigint").alias("numcompte"), C.blank_to_null("libellecompte").alias("l"))
    pairs = rows.filter(F.col("numcompte").isNotNull()).distinct()  # hashed; a text's maximum needs sorted rows
    return pairs.groupBy("numcompte").agg(F.max("l").alias("libellecompte"))


def residences(customers: DataFrame) -> DataFrame:
    rows = customers.select(
        C.blank_to_null("nationalite").alias("pays"), C.blank_to_null("residence").alias("residence"),
        R.zone_label("residencenum").alias("geo"), F.col("residencenum").isNotNull().alias("zoned"),
    )
    known = F.col("pays").isNotNull() | F.col("residence").isNotNull() | F.col("zoned")
    return rows.filter(known).select("pays", "residence", "geo").distinct()


def doubtful(customers: DataFrame) -> DataFrame:
    rows = customers.filter(C.blank_to_null("douteux").isNotNull() | C.blank_to_null("datdouteux").isNotNull())
    return rows.select(C.guarded("douteux").alias("douteux"), C.parse_date("datdouteux").alias("datdouteux")).distinct()


def groups(customers: DataFrame) -> DataFrame:
    rows = customers.filter(F.col("grpaffaires").isNotNull())
    name = F.min(C.blank_to_null("nomgrpaffaires")).alias("nomgrpaffaires")
    return rows.groupBy(F.col("grpaffaires").cast("bigint").alias("id")).agg(name)


#: Columns of the pooled dimensions, in the order of a member's ``a``, ``b`` and ``c``.
POOLED = {
    "sub_dim_residence": {"pays": "string", "residence": "string", "geo": "string"},
    "sub_dim_douteux": {"douteux": "int", "datdouteux": "date"},
    "sub_dim_agence": {"numagence": "int"},
    "sub_dim_devise": {"devise": "string"},
    "sub_dim_date": {"date_value": "date"},
    "sub_dim_typcontrat": {"typcontrat": "string"},
    "sub_dim_chapitre": {"chapitre": "bigint"},
}
#: Dimensions of a key and its label; a key that is known keeps its label, whatever comes.
LABELLED = {"sub_dim_grpaffaire": "nomgrpaffaires", "sub_dim_agenteco": "libelle", "sub_dim_sectionactivite": "libelle", "sub_dim_objetfinance": "libelle"}
#: Pairs of an account and a label, and the dates and clients of the ledger alone: members of no table.
ACCOUNT, FACT_DATE, FACT_CLIENT = "account", "fact_date", "fact_client"
MEMBER = ("a", "b", "c")


def _member(dimension: str, *values: Column) -> Column:
    texts = [v.cast("string") for v in values] + [F.lit(None).cast("string")] * (len(MEMBER) - len(values))
    return F.struct(F.lit(dimension).alias("dimension"), *[t.alias(n) for t, n in zip(texts, MEMBER)])


def ledger_members(ledger: DataFrame) -> DataFrame:
    """The members that each ledger row gives, copies kept."""
    return ledger.select(F.inline(F.array(
        _member("sub_dim_agence", C.guarded("agence")), _member("sub_dim_devise", C.blank_to_null("devise")),
        _member("sub_dim_devise", C.blank_to_null("devisebbnq")), _member("sub_dim_date", C.parse_date("date_bal")),
        _member(FACT_DATE, C.parse_date("date_bal")), _member("sub_dim_chapitre", C.guarded("chapitre", "bigint")),
        _member(ACCOUNT, C.guarded("compte", "bigint"), C.blank_to_null("libellecompte")),
        _member(FACT_CLIENT, C.blank_to_null("idtiers")),
    ))).where("a IS NOT NULL")


def pooled(pool: DataFrame, name: str, columns: Mapping[str, str]) -> DataFrame:
    """The members of one dimension under their own names and types."""
    rows = pool.where(F.col("dimension") == name)
    return rows.select(*[F.col(m).cast(t).alias(c) for m, (c, t) in zip(MEMBER, columns.items())])


def pooled_accounts(pool: DataFrame) -> DataFrame:
    """One row per account with its greatest label."""
    pairs = pooled(pool, ACCOUNT, {"numcompte": "bigint", "libellecompte": "string"})
    return pairs.groupBy("numcompte").agg(F.max("libellecompte").alias("libellecompte"))


def members(customers: DataFrame, contracts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``dimension, a, b, c``: the distinct members of all dimensions, from one scan of each staging table.

    Every row gives its members, and copies go in the task before they are shuffled.
    """
    doubt = C.blank_to_null("douteux").isNotNull() | C.blank_to_null("datdouteux").isNotNull()
    zone = F.when(F.col("residencenum").isNotNull(), R.zone_label("residencenum"))
    place = F.coalesce(C.blank_to_null("nationalite"), C.blank_to_null("residence"), zone).isNotNull()
    found = [
        customers.select(F.inline(F.array(
            F.when(place, _member("sub_dim_residence", C.blank_to_null("nationalite"), C.blank_to_null("residence"), R.zone_label("residencenum"))),
            F.when(doubt, _member("sub_dim_douteux", C.guarded("douteux"), C.parse_date("datdouteux"))),
            F.when(F.col("grpaffaires").isNotNull(), _member("sub_dim_grpaffaire", F.col("grpaffaires").cast("bigint"), C.blank_to_null("nomgrpaffaires"))),
        ))).where("dimension IS NOT NULL"),
        contracts.select(F.inline(F.array(
            _member("sub_dim_agence", C.guarded("agence")), _member("sub_dim_devise", C.blank_to_null("devise")),
            _member("sub_dim_date", C.parse_date("datouv")), _member("sub_dim_date", C.parse_date("datech")),
            _member("sub_dim_typcontrat", C.blank_to_null("typcontrat")),
        ))).where("a IS NOT NULL"),
        ledger_members(ledger),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def known_members(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The members that the dimensions have already."""
    columns = {**POOLED, **{name: ("id", label) for name, label in LABELLED.items()}}
    known = [
        tables[name].select(F.inline(F.array(_member(name, *[F.col(c) for c in own]))))
        for name, own in columns.items() if name in tables
    ]
    return reduce(DataFrame.unionByName, known) if known else None


def label_table(spark: SparkSession, labels: Mapping[int, str]) -> DataFrame:
    return spark.createDataFrame([(int(k), v) for k, v in labels.items()], "id bigint, libelle string")


def seed_labels(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The label tables of codes under ``root``; labels there stay as they are, and only missing codes are added."""
    tables = {name: df for name, df in read_tables(spark, root).items() if name in LABELS}
    for name, labels in LABELS.items():
        rows, count = _counted(insert_ignore(tables.get(name), label_table(spark, labels), ["id"], None))
        if count:
            rows.write.mode("append").parquet(f"{root}/{name}")
            tables[name] = _read(spark, root, name)
    return tables


# --- natural keys -> surrogate keys ------------------------------------------------


def lookup(df: DataFrame, dim: DataFrame, pairs: Mapping[str, str], out: str, id_col: str = "id", null_safe: bool = False) -> DataFrame:
    """Left join on ``pairs`` (staging column -> dimension column), adding the id as ``out``."""
    right = dim.select(F.col(id_col).alias(out), *[F.col(d).alias(f"_{out}_{d}") for d in pairs.values()])
    sides = [(F.col(s), F.col(f"_{out}_{d}")) for s, d in pairs.items()]
    cond = reduce(operator.and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in sides])
    return df.join(right, cond, "left").drop(*[f"_{out}_{d}" for d in pairs.values()])


def customer_rows(customers: DataFrame, dims: Mapping[str, DataFrame], arrival: str = "id") -> DataFrame:
    """Customer dimension rows with their keys resolved; the first arrival of an id wins."""
    prep = customers.select(
        F.col(arrival).alias("_arrival"),
        C.blank_to_null("idtiers").alias("idtiers"),
        C.blank_to_null("nationalite").alias("pays"),
        C.blank_to_null("residence").alias("residence"),
        R.zone_label("residencenum").alias("geo"),
        C.guarded("agenteco", "bigint", C.UNSIGNED).alias("agenteco"),
        C.guarded("sectionactivite", "bigint", C.UNSIGNED).alias("section"),
        F.col("grpaffaires").cast("bigint").alias("grp"),
        C.guarded("douteux").alias("douteux"),
        C.parse_date("datdouteux").alias("datdouteux"),
        C.blank_to_null("nomprenom").alias("nomprenom"),
        C.blank_to_null("raisonsoc").alias("raisonsoc"),
        C.blank_to_null("chiffreaffaires").alias("chiffreaffaires"),
    ).filter(F.col("idtiers").isNotNull())
    df = first_per_key(prep, "idtiers", "_arrival")
    df = lookup(df, dims["sub_dim_residence"], {"pays": "pays", "residence": "residence", "geo": "geo"}, "id_residence", null_safe=True)
    df = lookup(df, dims["sub_dim_agenteco"], {"agenteco": "id"}, "id_agenteco")
    df = lookup(df, dims["sub_dim_sectionactivite"], {"section": "id"}, "id_sectionactivite")
    df = lookup(df, dims["sub_dim_grpaffaire"], {"grp": "id"}, "id_grpaffaire")
    df = lookup(df, dims["sub_dim_douteux"], {"douteux": "douteux", "datdouteux": "datdouteux"}, "id_douteux", null_safe=True)
    return df.select(
        "idtiers", "id_residence", "id_agenteco", "id_douteux", "id_grpaffaire", "id_sectionactivite",
        "nomprenom", "raisonsoc", "chiffreaffaires",
    )


def contract_rows(contracts: DataFrame, dims: Mapping[str, DataFrame], arrival: str = "id") -> DataFrame:
    prep = contracts.select(
        F.col(arrival).alias("_arrival"),
        C.blank_to_null("idcontrat").alias("idcontrat"),
        C.blank_to_null("idtiers").alias("idtiers"),
        C.guarded("agence").alias("numagence"),
        C.blank_to_null("devise").alias("devise"),
        C.guarded("objetfinance", "bigint").alias("objet"),
        C.blank_to_null("typcontrat").alias("typcontrat"),
        C.parse_date("datouv").alias("ouverture"),
        C.parse_date("datech").alias("echeance"),
        C.guarded("ancienneteimpaye").alias("ancienneteimpaye"),
        C.guarded("tauxcontrat").alias("tauxcontrat"),
        C.guarded("actif").alias("actif"),
    ).filter(F.col("idcontrat").isNotNull())
    df = first_per_key(prep, "idcontrat", "_arrival")
    df = lookup(df, dims["sub_dim_agence"], {"numagence": "numagence"}, "id_agence")
    df = lookup(df, dims["sub_dim_devise"], {"devise": "devise"}, "id_devise")
    df = lookup(df, dims["sub_dim_objetfinance"], {"objet": "id"}, "id_objetfinance")
    df = lookup(df, dims["sub_dim_typcontrat"], {"typcontrat": "typcontrat"}, "id_typcontrat")
    df = lookup(df, dims["sub_dim_date"], {"ouverture": "date_value"}, "id_dateouverture")
    df = lookup(df, dims["sub_dim_date"], {"echeance": "date_value"}, "id_dateecheance")
    df = lookup(df, dims["dim_client"], {"idtiers": "idtiers"}, "id_client", id_col="idtiers")
    return df.select(
        F.col("idcontrat").alias("id"), "id_client", "id_agence", "id_devise", "id_objetfinance", "id_typcontrat",
        "id_dateouverture", "id_dateecheance", "ancienneteimpaye", "tauxcontrat", "actif",
    )


def resolved_rows(ledger: DataFrame, dims: Mapping[str, DataFrame], *kept: str, lost_clients: DataFrame | None = None) -> DataFrame:
    """Ledger rows as facts without id: values cleaned, keys resolved, copies kept.

    The accounts come last: copies have the same account, so with ``numcompte`` kept beside their
    columns they can be dropped where that join leaves them, without another shuffle.
    A client's key is the client's id, so where the ids without a client are known (``lost_clients``, each
    once), these are joined instead of all clients: while they are few, without a shuffle.
    """
    df = ledger.select(
        C.guarded("agence").alias("numagence"),
        C.blank_to_null("devise").alias("devise"),
        C.blank_to_null("devisebbnq").alias("devisebnq"),
        C.guarded("compte", "bigint").alias("numcompte"),
        C.guarded("chapitre", "bigint").alias("chapitre"),
        C.blank_to_null("idtiers").alias("idtiers"),
        C.blank_to_null("idcontrat").alias("idcontrat"),
        C.parse_date("date_bal").alias("date_bal"),
        *[(C.clean_decimal if m == "soldeconvertie" else C.clean_long)(m).alias(m) for m in MEASURES if m != "actif"],
        C.guarded("actif").alias("actif"),
    )
    df = lookup(df, dims["sub_dim_agence"], {"numagence": "numagence"}, "id_agence")
    df = lookup(df, dims["sub_dim_devise"], {"devise": "devise"}, "id_devise")
    df = lookup(df, dims["sub_dim_devise"], {"devisebnq": "devise"}, "id_devisebnq")
    df = lookup(df, dims["sub_dim_chapitre"], {"chapitre": "chapitre"}, "id_chapitre")
    df = lookup(df, dims["sub_dim_date"], {"date_bal": "date_value"}, "id_date")
    if lost_clients is None:
        df = lookup(df, dims["dim_client"], {"idtiers": "idtiers"}, "id_client", id_col="idtiers")
    else:
        df = lookup(df, lost_clients, {"idtiers": "idtiers"}, "_lost", id_col="idtiers")
        df = df.withColumn("id_client", F.when(F.col("_lost").isNull(), F.col("idtiers")))
    df = lookup(df, dims["dim_contrat"], {"idcontrat": "id"}, "id_contrat")
    df = lookup(df, dims["sub_dim_compte"], {"numcompte": "numcompte"}, "id_compte")
    return df.select(*FACT_KEYS, *MEASURES, *kept)


def fact_rows(ledger: DataFrame, dims: Mapping[str, DataFrame], accounts_known: bool = False) -> DataFrame:
    """Distinct fact rows (no id yet): keys resolved, whole-row copies dropped.

    An id without a parent becomes NULL, which can make rows alike that were not, so
    the copies go last. ``accounts_known`` says that ``dims`` has every account of the ledger: rows
    alike then have the same number of account, and need no shuffle of their own.
    """
    kept = ["numcompte"] if accounts_known else []
    return resolved_rows(ledger, dims, *kept).distinct().drop("numcompte")


def dedup_fact(fact: DataFrame) -> DataFrame:
    """One row per full payload, the lowest id kept."""
    return fact.groupBy(*FACT_KEYS, *MEASURES).agg(F.min("id").alias("id")).select("id", *FACT_KEYS, *MEASURES)


def account_winners(accounts_dim: DataFrame) -> DataFrame:
    """(losing id, kept id) for accounts that have several rows."""
    keep = (
        accounts_dim.filter(F.col("numcompte").isNotNull()).groupBy("numcompte")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )
    rows = accounts_dim.join(keep.select("numcompte", "keep_id"), "numcompte")
    return rows.filter(F.col("id") != F.col("keep_id")).select(F.col("id").alias("lost_id"), "keep_id")


def repoint_accounts(fact: DataFrame, accounts_dim: DataFrame) -> DataFrame:
    winners = account_winners(accounts_dim)
    moved = fact.join(winners, F.col("id_compte") == F.col("lost_id"), "left")
    return moved.withColumn("id_compte", F.coalesce("keep_id", "id_compte")).select(*fact.columns)


def keep_lowest_account(accounts_dim: DataFrame) -> DataFrame:
    lost = account_winners(accounts_dim).select(F.col("lost_id").alias("id"))
    return accounts_dim.join(lost, "id", "left_anti")


def backfill_category(df: DataFrame, text: str, lookup_table: DataFrame, out: str, default_name: str) -> DataFrame:
    """Free-text category -> id by trimmed, case-blind name; misses get the default's id."""
    names = lookup_table.select(F.lower(F.trim("name")).alias("_n"), F.col("id").alias("_id"))
    default = lookup_table.filter(F.col("name") == default_name).agg(F.min("id")).first()[0]
    joined = df.join(names, F.lower(F.trim(F.coalesce(text, F.lit("")))) == F.col("_n"), "left")
    return joined.withColumn(out, F.coalesce(out, "_id", F.lit(default)) if out in df.columns else F.coalesce("_id", F.lit(default))).drop("_n", "_id")


# --- the whole load -----------------------------------------------------------------


def clean_staging(customers: DataFrame, contracts: DataFrame, ledger: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quality rules and recodes of the three raw tables; customers and contracts are stored under ``folder``.

    These lose their offending rows. Ledger rows are only reported on, so the ledger is not copied: its
    blanks become NULL as it is read.
    """
    good_customers = Q.clean(customers, Q.CUSTOMERS, C.repair_customers())
    return (
        written(R.recode_customers(good_customers), f"{folder}/stg_tiers", **PASSING),
        written(R.recode_contracts(Q.clean(contracts, Q.CONTRACTS)), f"{folder}/stg_contrat", **PASSING),
        Q.blanks_to_null(ledger, Q.LEDGER.blanks),
    )


class Tables(dict):
    """Tables of a datamart by name; ``beside`` names the dimension that lies in the facts' buckets, if any."""

    beside: str | None = None


def _read(spark: SparkSession, root: str, name: str, buckets: int | None = None) -> DataFrame:
    if name in B.KEYS and buckets:
        return B.opened(spark, root, name, SCHEMAS[name], buckets)
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    return current_accounts(df) if name == "sub_dim_compte" else df


def read_tables(spark: SparkSession, root: str) -> Tables:
    """Tables already in the datamart folder."""
    out, buckets = Tables(), B.layout(spark, root)
    out.beside = B.BESIDE if buckets else None
    for name in TABLES:
        try:
            out[name] = _read(spark, root, name, buckets)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def current_accounts(stored: DataFrame) -> DataFrame:
    """Stored account rows -> one per account, with its latest label that is not NULL."""
    step = F.when(F.col("libellecompte").isNotNull(), F.col("load_no"))
    return stored.groupBy("numcompte").agg(F.min("id").alias("id"), F.max_by("libellecompte", step).alias("libellecompte"), F.max("load_no").alias("load_no"))


def append_accounts(existing: DataFrame | None, new: DataFrame, path: str) -> DataFrame:
    """Store new accounts and changed labels as rows of their own, so no file is rewritten."""
    spark = new.sparkSession
    if existing is None:
        number_rows(new, ["numcompte"]).withColumn("load_no", F.lit(1)).write.mode("append").parquet(path)
    else:
        top, load_no = existing.agg(F.max("id"), F.max("load_no") + 1).first()
        after = upsert_label(existing.drop("load_no"), new, "numcompte", "libellecompte")
        before = existing.select("id", F.col("libellecompte").alias("_old"))
        changed = ~F.col("libellecompte").eqNullSafe(F.col("_old")) | (F.col("id") > top)
        diff = after.join(before, "id", "left").filter(changed)
        fresh, count = _counted(diff.drop("_old").withColumn("load_no", F.lit(load_no)))
        if count:
            fresh.write.mode("append").parquet(path)
    return current_accounts(spark.read.schema(SCHEMAS["sub_dim_compte"]).parquet(path))


#: Stored columns of every table; with them no file is opened to learn its columns.
SCHEMAS = {
    **{name: "id bigint, " + ", ".join(f"{c} {t}" for c, t in columns.items()) for name, columns in POOLED.items()},
    "sub_dim_agenteco": "id bigint, libelle string",
    "sub_dim_sectionactivite": "id bigint, libelle string",
    "sub_dim_objetfinance": "id bigint, libelle string",
    "sub_dim_grpaffaire": "id bigint, nomgrpaffaires string",
    "sub_dim_compte": "id bigint, numcompte bigint, libellecompte string, load_no int",
    "dim_client": "idtiers string, id_residence bigint, id_agenteco bigint, id_douteux bigint, id_grpaffaire bigint, "
                  "id_sectionactivite bigint, nomprenom string, raisonsoc string, chiffreaffaires string",
    "dim_contrat": "id string, id_client string, id_agence bigint, id_devise bigint, id_objetfinance bigint, id_typcontrat bigint, "
                   "id_dateouverture bigint, id_dateecheance bigint, ancienneteimpaye int, tauxcontrat int, actif int",
    "fact_balance": "id bigint, id_agence bigint, id_devise bigint, id_devisebnq bigint, id_compte bigint, id_chapitre bigint, "
                    "id_client string, id_contrat string, soldeorigine bigint, soldeconvertie decimal(38,10), cumulmvtdb bigint, "
                    "cumulmvtcr bigint, soldeinitdebmois bigint, amount bigint, actif int, row_hash bigint, id_date bigint",
}
TABLES = tuple(SCHEMAS)
LABELS = {"sub_dim_agenteco": AGENT_LABELS, "sub_dim_sectionactivite": SECTION_LABELS, "sub_dim_objetfinance": PURPOSE_LABELS}


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows written to the work folder, and how many they are: what follows reads them from there."""
    out = written(rows, work_folder(rows.sparkSession), **PASSING)
    return out, out.count()  # from the files' footers


def load_datamart(
    spark: SparkSession, customers: DataFrame, contracts: DataFrame, ledger: DataFrame, root: str, buckets: int | None = None
) -> Tables:
    """Load the three cleaned staging tables into the parquet datamart under ``root``.

    Rows already there stay; a second load of the same data adds nothing and writes no table.
    Each table is written before the next needs it, so lookups plan with real sizes; all are
    only ever appended to. The ledger is read twice, for its members and for the facts. What a step
    shuffled is removed as the step ends, so disk holds the files of one step.

    With ``buckets``, the first load stores facts and contracts in as many buckets by contract, or
    twice, four times ... as many if they would hold more than ``buckets.ROWS`` rows on average, so
    that their join, the largest, needs no shuffle. A contract that would fill a bucket far beyond
    the others (see ``buckets.even``) keeps the plain layout, whose join splits hot keys. Later
    loads follow the first.
    """
    with shuffles_removed(spark):
        return _load(spark, customers, contracts, ledger, root, buckets)


def _load(spark: SparkSession, customers: DataFrame, contracts: DataFrame, ledger: DataFrame, root: str, buckets: int | None) -> Tables:
    tables = read_tables(spark, root)
    key = C.blank_to_null("idcontrat")
    if not tables and buckets and B.even(ledger, key, buckets):
        more = B.enough(ledger.count(), buckets)
        if more == buckets or B.even(ledger.filter(key.isNotNull()), key, more):  # rows without a key are dealt
            B.set_layout(spark, root, more)
            tables.beside = B.BESIDE
    buckets = B.layout(spark, root)

    def store(name: str, rows: DataFrame) -> None:
        if name in B.KEYS and buckets:
            rows, count = _counted(rows)
            B.append(rows, root, name, SCHEMAS[name], buckets, count)
        else:
            rows.write.mode("append").parquet(f"{root}/{name}")
        tables[name] = _read(spark, root, name, buckets)

    def store_new(name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Rows with keys of their own that the table lacks."""
        if name not in tables:
            store(name, rows)
            return
        fresh, count = _counted(not_yet_in(rows, tables[name], keys))
        if count:
            store(name, fresh)

    rows = [(name, str(key), label) for name, labels in LABELS.items() for key, label in labels.items()]
    fixed = spark.createDataFrame(rows, "dimension string, a string, b string").withColumn("c", F.lit(None).cast("string"))
    pool = members(customers, contracts, ledger).unionByName(fixed)
    known = known_members(tables)
    pool = pool if known is None else not_yet_in(pool, known, ["dimension", *MEMBER])
    path = work_folder(spark)
    pool.write.partitionBy("dimension").options(**PASSING).parquet(path)
    pool = spark.read.schema(pool.schema).parquet(path)
    found = {r["dimension"] for r in pool.select("dimension").distinct().collect()}  # names of dimensions

    def of(name: str, columns: Mapping[str, str]) -> DataFrame:
        return pooled(pool, name, columns)

    for name, columns in POOLED.items():
        if name in found or name not in tables:
            store(name, number_rows(of(name, columns), list(columns), _top(tables.get(name), "id")))
    for name in LABELS:
        if name in found or name not in tables:
            store_new(name, of(name, {"id": "bigint", "libelle": "string"}), ["id"])
    if "sub_dim_grpaffaire" in found or "sub_dim_grpaffaire" not in tables:
        named = of("sub_dim_grpaffaire", {"id": "bigint", "nomgrpaffaires": "string"})
        store_new("sub_dim_grpaffaire", named.groupBy("id").agg(F.min("nomgrpaffaires").alias("nomgrpaffaires")), ["id"])
    tables["sub_dim_compte"] = append_accounts(tables.get("sub_dim_compte"), pooled_accounts(pool), f"{root}/sub_dim_compte")

    # Known customers and contracts go before any key is looked up.
    store_new("dim_client", customer_rows(_unknown(customers, tables.get("dim_client"), "idtiers", "idtiers"), tables), ["idtiers"])
    store_new("dim_contrat", contract_rows(_unknown(contracts, tables.get("dim_contrat"), "idcontrat", "id"), tables), ["id"])
    # Read plainly, so that the join of the ledger splits hot contracts, and rows without one.
    plain = {**tables, "dim_contrat": _read(spark, root, "dim_contrat")}
    # Stored first: a join that plans with its size leaves the ledger where it is while few clients are lost.
    lost, _ = _counted(of(FACT_CLIENT, {"idtiers": "string"}).join(tables["dim_client"].select("idtiers"), "idtiers", "left_anti"))
    rows = resolved_rows(ledger, plain, "numcompte", lost_clients=lost)
    append_facts(rows, of(FACT_DATE, {"date_value": "date"}), tables, root, buckets)
    return tables


def _unknown(staging: DataFrame, dim: DataFrame | None, column: str, key: str) -> DataFrame:
    if dim is None:
        return staging
    return staging.join(dim.select(F.col(key).alias("_known")), C.blank_to_null(column) == F.col("_known"), "left_anti")


def row_hash(columns: Sequence[str]) -> Column:
    """64 bits of a row's values and of which of them are NULL."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def not_stored(rows: DataFrame, existing: DataFrame, columns: Sequence[str], hash_col: str = "row_hash") -> DataFrame:
    """Rows of ``rows`` that ``existing`` lacks, joined on the hash alone; the columns are compared where hashes meet.

    The comparisons stand in an array, as each of them would otherwise become two more join keys.
    """
    known = existing.select(F.col(hash_col).alias("_hash"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return rows.join(known, (F.col(hash_col) == F.col("_hash")) & ~F.array_contains(same, False), "left_anti")


def append_facts(rows: DataFrame, days: DataFrame, tables: dict[str, DataFrame], root: str, buckets: int | None = None) -> None:
    """Add facts the table lacks, one folder per date; ``days`` are the batch's dates, and only these are compared.

    Rows may repeat: copies go where the join of accounts leaves them. Each step stores its rows, so that
    no two steps' shuffles lie on disk together: the batch's rows, those the table lacks, which get their
    ids by their place there, and the facts by date. ``rows`` also have their ``numcompte``, and every
    account is in the tables.
    """
    path, existing, top = f"{root}/fact_balance", tables.get("fact_balance"), 0
    keys = [*FACT_KEYS, *MEASURES]
    rows, count = _counted(rows.distinct().select(*keys))
    if existing is not None:
        batch = lookup(days, tables["sub_dim_date"], {"date_value": "date_value"}, "id_date")
        # Only the folders of the batch's dates are read (and those of no date): the small side prunes them.
        dated = existing.join(batch.select("id_date").distinct(), "id_date", "left_semi")
        stored = dated.unionByName(existing.filter(F.col("id_date").isNull()))
        rows, count = _counted(not_stored(rows.withColumn("row_hash", row_hash(keys)), stored, keys).select(*keys))
        if not count:
            return
        top = _top(existing, "id")
    ids = number_stored(rows, top)
    if buckets:
        B.append(ids.withColumn("row_hash", row_hash(keys)), root, "fact_balance", SCHEMAS["fact_balance"], buckets, count)
    else:  # rows of a date come together, and a date too large for one file is split by size
        dates = ids.hint("rebalance", "id_date").sortWithinPartitions("id_date", "id")
        dates.withColumn("row_hash", row_hash(keys)).write.mode("append").partitionBy("id_date").parquet(path)
    tables["fact_balance"] = _read(rows.sparkSession, root, "fact_balance", buckets)


def table_counts(tables: Mapping[str, DataFrame], names: Sequence[str] = ("dim_client", "dim_contrat", "fact_balance")) -> DataFrame:
    out = None
    for name in names:
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
