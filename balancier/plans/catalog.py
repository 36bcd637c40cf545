"""The star: which tables there are, how they join, and the names users may write."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.session import PASSING, shuffles_removed, work_folder, written

FACT, CALENDAR = "f", "sub_dim_date"


class SpecError(ValueError):
    """A metric, ratio or shock definition that cannot be evaluated."""


class Node(NamedTuple):
    """One table in one role. ``parent`` is the alias it hangs on."""

    table: str
    parent: str | None
    parent_key: str | None
    key: str | None
    prefix: str
    columns: Mapping[str, str]  # name -> type


class Field(NamedTuple):
    name: str  # canonical, e.g. subDimResidence.pays
    alias: str
    column: str
    dtype: str

    @property
    def flat(self) -> str:
        """Column name in the star view."""
        return f"{self.alias}_{self.column}"


# Types of columns.
NUMBER, TEXT, DATE = "NUMBER", "TEXT", "DATE"
# Tables, roles, join keys and typed columns of the star.
NODES: dict[str, Node] = {
    "f": Node(
        "fact_balance", None, None, None, "",
        {
            "id": NUMBER, "id_agence": NUMBER, "id_devise": NUMBER, "id_devisebnq": NUMBER, "id_compte": NUMBER,
            "id_chapitre": NUMBER, "id_client": TEXT, "id_contrat": TEXT, "id_date": NUMBER, "soldeorigine": NUMBER,
            "soldeconvertie": NUMBER, "cumulmvtdb": NUMBER, "cumulmvtcr": NUMBER, "soldeinitdebmois": NUMBER,
            "amount": NUMBER, "actif": NUMBER,
        },
    ),
    "cl": Node(
        "dim_client", "f", "id_client", "idtiers", "dimClient.",
        {
            "idtiers": TEXT, "id_residence": NUMBER, "id_agenteco": NUMBER, "id_douteux": NUMBER,
            "id_grpaffaire": NUMBER, "id_sectionactivite": NUMBER, "nomprenom": TEXT, "raisonsoc": TEXT,
            "chiffreaffaires": TEXT,
        },
    ),
    "dc": Node(
        "dim_contrat", "f", "id_contrat", "id", "dimContrat.",
        {
            "id": TEXT, "id_client": TEXT, "id_agence": NUMBER, "id_devise": NUMBER, "id_objetfinance": NUMBER,
            "id_typcontrat": NUMBER, "id_dateouverture": NUMBER, "id_dateecheance": NUMBER,
            "ancienneteimpaye": NUMBER, "tauxcontrat": NUMBER, "actif": NUMBER,
        },
    ),
    "agf": Node("sub_dim_agence", "f", "id_agence", "id", "subDimAgence.", {"numagence": NUMBER}),
    "c": Node("sub_dim_compte", "f", "id_compte", "id", "subDimCompte.", {"numcompte": TEXT, "libellecompte": TEXT}),
    "ch": Node("sub_dim_chapitre", "f", "id_chapitre", "id", "subDimChapitre.", {"chapitre": NUMBER}),
    "dtf": Node("sub_dim_date", "f", "id_date", "id", "subDimDate.", {"date_value": DATE}),
    "dvf": Node("sub_dim_devise", "f", "id_devise", "id", "subDimDevise.", {"devise": TEXT}),
    "dvb": Node("sub_dim_devise", "f", "id_devisebnq", "id", "subDimDeviseBnq.", {"devise": TEXT}),
    "res": Node("sub_dim_residence", "cl", "id_residence", "id", "subDimResidence.", {"pays": TEXT, "residence": TEXT, "geo": TEXT}),
    "aec": Node("sub_dim_agenteco", "cl", "id_agenteco", "id", "subDimAgenteco.", {"libelle": TEXT}),
    "dout": Node("sub_dim_douteux", "cl", "id_douteux", "id", "subDimDouteux.", {"douteux": NUMBER, "datdouteux": DATE}),
    "gaf": Node("sub_dim_grpaffaire", "cl", "id_grpaffaire", "id", "subDimGrpaffaire.", {"nomgrpaffaires": TEXT}),
    "sac": Node("sub_dim_sectionactivite", "cl", "id_sectionactivite", "id", "subDimSectionactivite.", {"libelle": TEXT}),
    "agc": Node("sub_dim_agence", "dc", "id_agence", "id", "dimContrat.subDimAgence.", {"numagence": NUMBER}),
    "dvc": Node("sub_dim_devise", "dc", "id_devise", "id", "dimContrat.subDimDevise.", {"devise": TEXT}),
    "ofc": Node("sub_dim_objetfinance", "dc", "id_objetfinance", "id", "dimContrat.subDimObjetfinance.", {"libelle": TEXT}),
    "tyc": Node("sub_dim_typcontrat", "dc", "id_typcontrat", "id", "dimContrat.subDimTypcontrat.", {"typcontrat": TEXT}),
    "dto": Node("sub_dim_date", "dc", "id_dateouverture", "id", "dimContrat.subDimDateOuverture.", {"date_value": DATE}),
    "dte": Node("sub_dim_date", "dc", "id_dateecheance", "id", "dimContrat.subDimDateEcheance.", {"date_value": DATE}),
}

# Short names that no rule below derives.
SHORT_NAMES = {
    "contratActif": "dimContrat.actif",
    "numagence": "subDimAgence.numagence",
    "numagencecontrat": "dimContrat.subDimAgence.numagence",
    "dateouverture": "dimContrat.subDimDateOuverture.dateValue",
    "dateecheance": "dimContrat.subDimDateEcheance.dateValue",
    "datevalue": "subDimDate.dateValue",
    "devise": "subDimDevise.devise",
    "devisefact": "subDimDevise.devise",
    "devisebnq": "subDimDeviseBnq.devise",
    "devisecontrat": "dimContrat.subDimDevise.devise",
    "libelleagenteco": "subDimAgenteco.libelle",
    "sectionactivite": "subDimSectionactivite.libelle",
    "grpaffaire": "subDimGrpaffaire.nomgrpaffaires",
    "anciennete_impaye": "dimContrat.ancienneteimpaye",
    "dc.anciennete_impaye": "dimContrat.ancienneteimpaye",
}


def _camel(column: str) -> str:
    head, *tail = column.split("_")
    return head + "".join(part.capitalize() for part in tail)


def _canonical_fields() -> list[Field]:
    return [
        Field(node.prefix + _camel(column), alias, column, dtype)
        for alias, node in NODES.items()
        for column, dtype in node.columns.items()
    ]


def _lookup(fields: list[Field]) -> dict[str, Field]:
    """Lower-case spelling -> field. Earlier spellings win over later, looser ones."""
    names: dict[str, Field] = {f.name.lower(): f for f in fields}
    for short, target in SHORT_NAMES.items():
        names.setdefault(short.lower(), names[target.lower()])
    for f in fields:  # alias.column
        names.setdefault(f"{f.alias}.{f.column}", f)
        names.setdefault(f"{f.alias}.{f.column.replace('_', '')}", f)
    for f in fields:  # table.column; the first role of a table wins
        if f.alias != FACT:
            names.setdefault(f"{NODES[f.alias].table}.{f.column}", f)
    owners: dict[str, list[Field]] = {}
    for f in fields:
        owners.setdefault(f.column, []).append(f)
    for column, holders in owners.items():  # bare column, when only one field has it
        if len(holders) == 1:
            names.setdefault(column, holders[0])
            names.setdefault(column.replace("_", ""), holders[0])
    return names


FIELDS = _canonical_fields()
_NAMES = _lookup(FIELDS)


def resolve(name: str) -> Field:
    try:
        return _NAMES[name.strip().lower()]
    except (KeyError, AttributeError):
        raise SpecError(f"Unknown field: {name}") from None


def exists(name: str) -> bool:
    return isinstance(name, str) and name.strip().lower() in _NAMES


def supported_fields() -> dict[str, list[str]]:
    """Spellings by table, sorted."""
    out: dict[str, list[str]] = {}
    for spelling in sorted(_NAMES):
        out.setdefault(NODES[_NAMES[spelling].alias].table, []).append(spelling)
    return dict(sorted(out.items()))


def column_of(name: str, swap: Mapping[str, str] | None = None) -> Column:
    """The field's column in the star view; account numbers read as text.

    ``swap`` names other columns to read instead, as when a shocked copy exists.
    """
    field = resolve(name)
    col = F.col((swap or {}).get(field.flat, field.flat))
    return col.cast("string") if field.column == "numcompte" else col


def needed_roles(fields: Iterable[str]) -> list[str]:
    """Aliases to join for these fields, parents before children."""
    wanted: set[str] = set()
    for name in fields:
        alias: str | None = resolve(name).alias
        while alias is not None:
            wanted.add(alias)
            alias = NODES[alias].parent
    return [a for a in NODES if a in wanted and a != FACT]


#: The tables that grow with the business, those of narrow rows first.
LARGE = ("sub_dim_compte", "dim_contrat", "dim_client")


def _join_order(roles: list[str], beside: str | None = None, whole: bool = False) -> list[str]:
    """The date first, then small tables, then customers and contracts.

    A filter on a joined table turns its join into an inner one; early joins then spare
    the later, shuffled ones the rows they drop. A table ``beside`` the facts, in the same buckets,
    comes right after the date, before any shuffle takes the facts out of their buckets. Where the
    ``whole`` view is asked for, large tables come before the small ones, whose texts no shuffle then carries.
    """
    if whole:
        place = {t: i for i, t in enumerate(LARGE)}
        return sorted(roles, key=lambda r: (r != "dtf", NODES[r].table != beside, place.get(NODES[r].table, len(LARGE))))
    return sorted(roles, key=lambda r: (r != "dtf", NODES[r].table != beside, NODES[r].table.startswith("dim_")))


class Narrowed(dict):
    """The tables with other facts in place; the rest is asked of the tables when needed."""

    def __init__(self, tables: Mapping[str, DataFrame], facts: DataFrame):
        super().__init__(fact_balance=facts)
        self._tables, self.beside = tables, getattr(tables, "beside", None)

    def __missing__(self, name: str) -> DataFrame:
        return self._tables[name]


def on_dates(tables: Mapping[str, DataFrame], days: DataFrame) -> Narrowed:
    """The tables with the facts of these rows of the calendar only.

    Their ids, a few for each date, become a filter on the fact's own key, which Spark pushes down to
    where the facts are read: those of other dates are neither read from a folder nor shuffled.
    """
    found = days.select(NODES["dtf"].key).distinct().collect()
    ids = sorted(r[0] for r in found if r[0] is not None)
    facts, key = tables[NODES[FACT].table], F.col(NODES["dtf"].parent_key)
    # One id is a range of one: an equality would replace the key in the join with the calendar, which prunes folders.
    wanted = key.between(ids[0], ids[0]) if len(ids) == 1 else key.isin(ids)
    return Narrowed(tables, facts.filter(wanted))


def _stored(df: DataFrame) -> DataFrame:
    """Rows written to the work folder; the shuffles that led to them leave the disk."""
    with shuffles_removed(df.sparkSession):
        return written(df, work_folder(df.sparkSession), **PASSING)


def star(tables: Mapping[str, DataFrame], fields: Iterable[str] | None = None, by_steps: bool = False) -> DataFrame:
    """The flat view over the fields asked for (all 57 by default), one row per fact.

    Only the roles those fields need are joined. Second-hop tables are attached to
    their dimension first, so they meet the dimension's rows and not the fact's, and
    each side carries just the columns that are used. Tables that say so (``beside``) have a
    dimension in the facts' buckets; it is joined without a shuffle. The calendar, a row for each
    date, is broadcast: its size is not known before it is read where it is derived.
    ``by_steps`` stores the facts after each join with a large table but the last, so that the disk holds
    one shuffle of the facts at a time; else all of them lie there until the view has been read.
    """
    beside = getattr(tables, "beside", None)
    names = [f.name for f in FIELDS] if fields is None else list(dict.fromkeys(fields))
    used = {resolve(n) for n in names}
    roles = needed_roles(names)

    def branch(alias: str) -> DataFrame:
        node = NODES[alias]
        children = _join_order([r for r in roles if NODES[r].parent == alias], beside, fields is None)
        own = [f.column for f in FIELDS if f.alias == alias and f in used]
        links = [NODES[r].parent_key for r in children]
        keep = list(dict.fromkeys([*([node.key] if node.key else []), *own, *links]))
        df = tables[node.table].select(*[F.col(c).alias(f"{alias}_{c}") for c in keep])
        large = [r for r in children if NODES[r].table in LARGE] if by_steps and alias == FACT else []
        for child in children:
            link = f"{alias}_{NODES[child].parent_key}"
            key = f"{child}_{NODES[child].key}"
            right = F.broadcast(branch(child)) if NODES[child].table == CALENDAR else branch(child)
            if NODES[child].table == beside:  # facts without a key lie in one bucket, which one task would read
                apart, df = df.filter(F.col(link).isNull()), df.filter(F.col(link).isNotNull())
            df = df.join(right, F.col(link) == F.col(key), "left")
            if NODES[child].table == beside:
                df = df.unionByName(apart.withColumns({c: F.lit(None).cast(t) for c, t in right.dtypes}))
            if not any(f.flat == key for f in used):
                df = df.drop(key)
            if child in large[:-1]:
                df = _stored(df)
        flat = {f.flat for f in used}
        spare = [f"{alias}_{c}" for c in links if f"{alias}_{c}" not in flat and c != node.key]
        return df.drop(*spare)

    return branch(FACT)
