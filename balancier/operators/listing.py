"""Paged listings of datamart tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 20


class Page(NamedTuple):
    items: DataFrame
    page: int
    size: int
    total_elements: int
    total_pages: int


def page_of(df: DataFrame, order: Sequence[str | Column], page: int = 0, size: int = PAGE_SIZE) -> Page:
    """One page in the given order, which must be unique: a top-k of all rows up to it.

    To go on far into a large table use ``page_after``, whose cost does not grow with the page.
    """
    page, size = max(page, 0), size if size > 0 else PAGE_SIZE
    total = df.count()
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    return Page(df.orderBy(*keys).offset(page * size).limit(size), page, size, total, math.ceil(total / size))


def page_after(df: DataFrame, key: str, after: object = None, size: int = PAGE_SIZE) -> DataFrame:
    """The next rows by a unique key that is never null, after the last one seen; reads no count."""
    rest = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


CLIENT_LABELS = (
    ("id_residence", "sub_dim_residence", {"pays": "pays", "geo": "geo"}),
    ("id_agenteco", "sub_dim_agenteco", {"libelle": "libelle"}),
    ("id_douteux", "sub_dim_douteux", {"douteux": "douteux"}),
    ("id_grpaffaire", "sub_dim_grpaffaire", {"nomgrpaffaires": "nomgroupaffaire"}),
    ("id_sectionactivite", "sub_dim_sectionactivite", {"libelle": "sectionactivite"}),
)
CONTRACT_LABELS = (
    ("id_agence", "sub_dim_agence", {"numagence": "numagence"}),
    ("id_devise", "sub_dim_devise", {"devise": "devise"}),
    ("id_objetfinance", "sub_dim_objetfinance", {"libelle": "objetfinance"}),
    ("id_typcontrat", "sub_dim_typcontrat", {"typcontrat": "typcontrat"}),
    ("id_dateouverture", "sub_dim_date", {"date_value": "dateouverture"}),
    ("id_dateecheance", "sub_dim_date", {"date_value": "dateecheance"}),
    ("id_client", "dim_client", {"nomprenom": "nomprenom"}),
)
BALANCE_LABELS = (
    ("id_agence", "sub_dim_agence", {"numagence": "numagence"}),
    ("id_devise", "sub_dim_devise", {"devise": "devise"}),
    ("id_devisebnq", "sub_dim_devise", {"devise": "devisebanque"}),
    ("id_compte", "sub_dim_compte", {"libellecompte": "libellecompte"}),
    ("id_chapitre", "sub_dim_chapitre", {"chapitre": "chapitre"}),
    ("id_date", "sub_dim_date", {"date_value": "datevalue"}),
)
Labels = Sequence[tuple[str, str, Mapping[str, str]]]


def labelled(rows: DataFrame, tables: Mapping[str, DataFrame], labels: Labels) -> DataFrame:
    """The rows with their keys replaced by the labels those point at."""
    keep = [c for c in rows.columns if c == "id_client" or c not in {key for key, _, _ in labels}]
    for key, name, columns in labels:
        dim_key = "idtiers" if name == "dim_client" else "id"
        right = tables[name].select(F.col(dim_key).alias("_k"), *[F.col(c).alias(out) for c, out in columns.items()])
        rows = rows.join(right, F.col(key) == F.col("_k"), "left").drop("_k")
        keep += columns.values()
    return rows.select(*keep)


def _listing(tables: Mapping[str, DataFrame], name: str, key: str, labels: Labels, page: int, size: int) -> Page:
    """Labels are looked up for the page's rows only, as each key has at most one label."""
    found = page_of(tables[name], [key], page, size)
    return found._replace(items=labelled(found.items, tables, labels).orderBy(key))


def client_page(tables: Mapping[str, DataFrame], page: int = 0, size: int = PAGE_SIZE) -> Page:
    return _listing(tables, "dim_client", "idtiers", CLIENT_LABELS, page, size)


def contract_page(tables: Mapping[str, DataFrame], page: int = 0, size: int = PAGE_SIZE) -> Page:
    return _listing(tables, "dim_contrat", "id", CONTRACT_LABELS, page, size)


def balance_page(tables: Mapping[str, DataFrame], page: int = 0, size: int = PAGE_SIZE) -> Page:
    return _listing(tables, "fact_balance", "id", BALANCE_LABELS, page, size)


def dimension_page(tables: Mapping[str, DataFrame], name: str, page: int = 0, size: int = PAGE_SIZE) -> Page:
    """Any of the twelve small dimensions, by id."""
    return page_of(tables[name], ["id"], page, size)
