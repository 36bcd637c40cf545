"""Rule checks on the three staging tables: counts, violations, kept rows."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancier.functions import cleaning as C


class Rules(NamedTuple):
    required: tuple[str, ...]  # rule 1: none may be NULL
    key: tuple[str, ...]  # rule 2: rows alike on these are duplicates
    whole_row: bool  # rule 2 compares trimmed values and NULL equals NULL
    integer: tuple[str, ...] = ()  # rule 3
    numeric: tuple[str, ...] = ()
    not_numeric: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    number_pattern: str = C.LOOSE_NUMERIC
    blanks: tuple[str, ...] = ()  # columns whose blanks become NULL


# Columns each rule looks at.
CUSTOMERS = Rules(
    required=("residence", "agenteco"),
    key=("idtiers",),
    whole_row=False,
    integer=("agenteco", "sectionactivite", "idtiers"),
    not_numeric=("nomprenom", "raisonsoc", "residence", "nomgrpaffaires"),
    blanks=("idtiers", "nomprenom", "raisonsoc", "residence", "agenteco", "sectionactivite", "chiffreaffaires",
            "nationalite", "douteux", "datdouteux", "nomgrpaffaires"),
)
CONTRACTS = Rules(
    required=("agence", "devise", "idcontrat", "ancienneteimpaye", "typcontrat", "datouv", "datech", "idtiers",
              "tauxcontrat", "actif"),
    key=("idcontrat",),
    whole_row=False,
    integer=("agence", "ancienneteimpaye", "objetfinance", "idtiers", "tauxcontrat", "actif"),
    not_numeric=("devise", "idcontrat", "typcontrat"),
    dates=("datouv", "datech"),
    blanks=("agence", "devise", "idcontrat", "ancienneteimpaye", "objetfinance", "typcontrat", "datouv", "datech",
            "idtiers", "tauxcontrat", "actif"),
)
_LEDGER = ("agence", "devise", "compte", "chapitre", "libellecompte", "idtiers", "soldeorigine", "soldeconvertie",
           "devisebbnq", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois", "idcontrat", "amount", "actif")
LEDGER = Rules(
    required=tuple(c for c in _LEDGER if c != "idcontrat"),
    key=(*_LEDGER, "date_bal"),
    whole_row=True,
    integer=("agence", "compte", "chapitre", "idtiers", "actif"),
    numeric=("soldeorigine", "soldeconvertie", "cumulmvtdb", "cumulmvtcr", "soldeinitdebmois", "amount"),
    not_numeric=("devise", "libellecompte", "devisebbnq", "idcontrat"),
    number_pattern=C.NUMERIC,
    blanks=_LEDGER,
)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def any_null(rules: Rules) -> Column:
    return reduce(operator.or_, [F.col(c).isNull() for c in rules.required])


def type_failures(rules: Rules) -> dict[str, Column]:
    """Column -> rows whose raw value breaks its type; NULL and '' always pass."""
    bad: dict[str, Column] = {}
    for c in rules.integer:
        bad[c] = ~F.col(c).rlike(C.INTEGER)
    for c in rules.numeric:
        bad[c] = ~F.col(c).rlike(C.NUMERIC)
    for c in rules.not_numeric:
        bad[c] = F.col(c).rlike(rules.number_pattern)
    for c in rules.dates:
        bad[c] = ~F.col(c).rlike(C.DASH_DATE.rstrip("$")) & ~F.col(c).rlike(C.SLASH_DATE.rstrip("$"))
    return {c: F.coalesce((F.col(c) != "") & cond, F.lit(False)) for c, cond in bad.items()}


def bad_type(rules: Rules) -> Column:
    return reduce(operator.or_, type_failures(rules).values())


def _keys(rules: Rules) -> list[Column]:
    return [(C.blank_to_null(c) if rules.whole_row else F.col(c)).alias(f"k{i}") for i, c in enumerate(rules.key)]


def _candidates(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that can be duplicates: with a single key, those that have one."""
    return df if rules.whole_row else df.filter(F.col(rules.key[0]).isNotNull())


def first_ids(df: DataFrame, rules: Rules, id_col: str = "id") -> DataFrame:
    """Lowest id of each key. Map-side aggregation, so a hot key costs one row per task."""
    return _candidates(df, rules).groupBy(*_keys(rules)).agg(F.min(id_col).alias(id_col)).select(id_col)


def duplicates(df: DataFrame, rules: Rules, id_col: str = "id") -> DataFrame:
    """Later copies: the candidates whose id is not its key's lowest. Joins on the unique id."""
    return _candidates(df, rules).join(first_ids(df, rules, id_col), id_col, "left_anti")


def drop_duplicates(df: DataFrame, rules: Rules, id_col: str = "id") -> DataFrame:
    """Keep the first arrival of each key, and every row without one.

    Only ids and keys are aggregated, which hashes; the wide rows are then picked by their unique
    id. A row without a key is a group of its own, by its id.
    """
    own = [] if rules.whole_row else [F.when(F.col(rules.key[0]).isNull(), F.col(id_col)).alias("own")]
    first = df.groupBy(*_keys(rules), *own).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_semi").select(*df.columns)


def _has_key(rules: Rules) -> Column:
    return F.lit(True) if rules.whole_row else F.col("k0").isNotNull()


def counters(df: DataFrame, rules: Rules) -> DataFrame:
    """One row: rows with NULLs, duplicates, rows with bad types, their sum.

    One pass: rows are flagged, then counted per key with map-side aggregation.
    """
    flagged = df.select(*_keys(rules), any_null(rules).alias("_null"), bad_type(rules).alias("_bad"))
    keys = [f"k{i}" for i in range(len(rules.key))]
    per_key = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_null").alias("nulls"), F.count_if("_bad").alias("bad")
    )
    sums = per_key.agg(
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(_has_key(rules), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_types"),
    )
    return sums.withColumn("total", F.col("nulls") + F.col("duplicates") + F.col("bad_types"))


def type_breakdown(df: DataFrame, rules: Rules) -> DataFrame:
    """(column, failures) for every typed column, from one pass."""
    bad = type_failures(rules)
    wide = df.agg(*[F.count_if(cond).alias(c) for c, cond in bad.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in bad])
    return wide.select(F.inline(pairs))


def type_samples(df: DataFrame, rules: Rules, n: int = 5, id_col: str = "id") -> DataFrame:
    """Up to n failing values of each column, first arrivals first."""
    hits = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, cond in type_failures(rules).items()]),
        lambda x: x.isNotNull(),
    )
    order = Window.partitionBy("column").orderBy(id_col)
    return (
        df.select(id_col, F.inline(hits))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def violations(df: DataFrame, rules: Rules, rule: str, id_col: str = "id") -> DataFrame:
    """Offending rows in arrival order; rule is nulls, duplicates or types."""
    found = {
        "nulls": lambda: df.filter(any_null(rules)),
        "duplicates": lambda: duplicates(df, rules, id_col),
        "types": lambda: df.filter(bad_type(rules)),
    }[rule]()
    return found.orderBy(id_col)


def repair(df: DataFrame, repairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Replace values where a repair applies."""
    return df.withColumns({c: F.when(cond, new).otherwise(F.col(c)) for c, (cond, new) in repairs.items()})


def repair_counts(df: DataFrame, repairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    return df.agg(*[F.count_if(cond).alias(c) for c, (cond, _) in repairs.items()])


def blanks_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: C.blank_to_null(c) for c in columns})


def clean(
    df: DataFrame, rules: Rules, repairs: Mapping[str, tuple[Column, Column]] | None = None, id_col: str = "id"
) -> DataFrame:
    """Rows that survive rules 1, 2 and 3 in that order, repaired and with blanks as NULL."""
    kept = drop_duplicates(df.filter(~any_null(rules)), rules, id_col)
    if repairs:
        kept = repair(kept, repairs)
    return blanks_to_null(kept.filter(~bad_type(rules)), rules.blanks)


def deletion_counts(df: DataFrame, rules: Rules, id_col: str = "id") -> DataFrame:
    """One row with what ``clean`` deletes per rule; each rule sees what the last one left.

    One pass: the lowest-id row of each key, taken inside the aggregation, says whether
    the row that survives rule 2 breaks rule 3. Its id and flag are one number, so that the
    aggregation can hash. Rows without a key are all kept by rule 2.
    """
    flagged = df.select(*_keys(rules), F.col(id_col).alias("_id"), any_null(rules).alias("_null"), bad_type(rules).alias("_bad"))
    left = ~F.col("_null")
    per_key = flagged.groupBy("k0").agg(
        F.count_if("_null").alias("nulls"),
        F.count_if(left).alias("n"),
        F.min(F.when(left, F.col("_id").cast("decimal(20,0)") * 2 + F.col("_bad").cast("int"))).alias("first"),
        F.count_if(left & F.col("_bad")).alias("bad"),
    )
    keyed = F.col("k0").isNotNull()
    bad = F.when(keyed, F.coalesce(F.pmod("first", F.lit(2)), F.lit(0)).cast("bigint")).otherwise(F.col("bad"))
    sums = per_key.agg(
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(keyed & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("bad_types"),
    )
    return sums.withColumn("total", F.col("nulls") + F.col("duplicates") + F.col("bad_types"))


def orphan_keys(df: DataFrame, key: str, parents: DataFrame, parent_key: str | None = None) -> DataFrame:
    """(key, rows) of non-blank keys with no parent. Keys are counted before they are joined."""
    used = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = parents.select(F.col(parent_key or key).alias(key))
    return used.join(known, key, "left_anti")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str | None = None) -> DataFrame:
    """The rows themselves."""
    lost = orphan_keys(df, key, parents, parent_key).select(key)
    return df.join(lost, key, "left_semi").select(*df.columns)


def orphan_count(df: DataFrame, key: str, parents: DataFrame, parent_key: str | None = None) -> DataFrame:
    return orphan_keys(df, key, parents, parent_key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))


def balance_sums(ledger: DataFrame, fact: DataFrame) -> DataFrame:
    """One row: staging sum, fact sum and their difference, near-zero values as 0."""
    total = "decimal(37,10)"
    staged = ledger.agg(F.coalesce(F.sum(C.clean_decimal("soldeconvertie")), F.lit(0)).cast(total).alias("s"))
    loaded = fact.agg(F.coalesce(F.sum("soldeconvertie"), F.lit(0)).cast(total).alias("l"))
    return one_row(staged, loaded).select(
        C.near_zero("s").alias("balance_sum"),
        C.near_zero("l").alias("fact_sum"),
    ).withColumn("difference", C.near_zero(F.col("balance_sum") - F.col("fact_sum")))


def rejected_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, non-blank values that no clean number comes out of."""
    return df.agg(*[F.count_if(C.blank_to_null(c).isNotNull() & C.clean_decimal(c).isNull()).alias(c) for c in columns])
