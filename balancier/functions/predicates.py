"""Filter dicts -> boolean Columns."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from balancier.plans.catalog import SpecError, column_of, exists, resolve

# Accepted operator spellings.
SPELLINGS = {
    "EQ": ("=", "EQ"),
    "NE": ("!=", "<>", "NE"),
    "GT": (">", "GT"),
    "GTE": (">=", "GTE"),
    "LT": ("<", "LT"),
    "LTE": ("<=", "LTE"),
    "LIKE": ("LIKE",),
    "STARTS_WITH": ("STARTS WITH", "STARTS_WITH", "STARTSWITH", "BEGINS WITH", "BEGINS_WITH", "BEGINSWITH"),
    "ENDS_WITH": ("ENDS WITH", "ENDS_WITH", "ENDSWITH"),
    "CONTAINS": ("CONTAINS",),
    "IN": ("IN",),
    "NOT_IN": ("NOT IN", "NOT_IN"),
    "BETWEEN": ("BETWEEN",),
    "IS_NULL": ("IS NULL", "IS_NULL"),
    "IS_NOT_NULL": ("IS NOT NULL", "IS_NOT_NULL"),
}
_BY_SPELLING = {s: name for name, spellings in SPELLINGS.items() for s in spellings}
_COMPARE = {
    "EQ": operator.eq, "NE": operator.ne, "GT": operator.gt,
    "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le,
}
PATTERNS = ("LIKE", "STARTS_WITH", "ENDS_WITH", "CONTAINS")
RANGES = ("GT", "GTE", "LT", "LTE", "BETWEEN")
UNARY = ("IS_NULL", "IS_NOT_NULL")


def operator_name(raw: str) -> str:
    try:
        return _BY_SPELLING[" ".join(raw.upper().split())]
    except (KeyError, AttributeError):
        raise SpecError(f"no filter compares by {raw!r}") from None


def literal(value: Any, dtype: str | None = None) -> Column:
    """Typed literal: floats become exact decimals, ISO strings dates on DATE fields."""
    if dtype == "DATE" and isinstance(value, str):
        return F.lit(date.fromisoformat(value))
    if isinstance(value, float):
        return F.lit(Decimal(str(value)))
    return F.lit(value)


def is_condition(node: Any) -> bool:
    return (
        isinstance(node, Mapping)
        and "field" in node
        and "operator" in node
        and not {"logic", "conditions", "groups"} & set(node)
    )


def parts(node: Any) -> tuple[str, list[Mapping], list[Any]]:
    """(logic, conditions, nested groups) of any filter shape: list, condition or group."""
    if isinstance(node, (list, tuple)):
        return "AND", [n for n in node if is_condition(n)], [n for n in node if not is_condition(n)]
    if is_condition(node):
        return "AND", [node], []
    if not isinstance(node, Mapping):
        raise SpecError("a filter is a dict or a list of them")
    logic = str(node.get("logic", "AND")).strip().upper()
    if logic not in ("AND", "OR"):
        raise SpecError(f"filters are joined by AND or OR, not by {logic}")
    conditions, groups = list(node.get("conditions", [])), list(node.get("groups", []))
    if not conditions and not groups:
        raise SpecError("a filter without conditions")
    return logic, conditions, groups


def conditions_of(node: Any) -> Iterator[Mapping]:
    if node is None:
        return
    _, conditions, groups = parts(node)
    yield from conditions
    for group in groups:
        yield from conditions_of(group)


def fields_in(node: Any) -> list[str]:
    return [c["field"] for c in conditions_of(node)]


def condition(cond: Mapping, ignore_case: bool = False, swap: Mapping[str, str] | None = None) -> Column:
    field = resolve(cond["field"])
    col = column_of(cond["field"], swap)
    op = operator_name(cond["operator"])
    if op == "IS_NULL":
        return col.isNull()
    if op == "IS_NOT_NULL":
        return col.isNotNull()
    value = cond.get("value", cond.get("values"))
    if op == "BETWEEN":
        return col.between(literal(value[0], field.dtype), literal(value[1], field.dtype))
    if op in ("IN", "NOT_IN"):
        found = col.isin(*[literal(v, field.dtype) for v in value])
        return ~found if op == "NOT_IN" else found
    if op in PATTERNS:
        col = col.cast("string")
        if ignore_case:
            col, value = F.lower(col), value.lower()
        if op == "LIKE":
            return col.like(value)
        return {"STARTS_WITH": col.startswith, "ENDS_WITH": col.endswith, "CONTAINS": col.contains}[op](value)
    return _COMPARE[op](col, literal(value, field.dtype))


def predicate(node: Any, ignore_case: bool = False, swap: Mapping[str, str] | None = None) -> Column:
    """Fold a filter of any nesting into one Column (SQL three-valued logic)."""
    logic, conditions, groups = parts(node)
    terms = [condition(c, ignore_case, swap) for c in conditions] + [predicate(g, ignore_case, swap) for g in groups]
    return reduce(operator.or_ if logic == "OR" else operator.and_, terms)
