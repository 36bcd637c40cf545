"""Metric definitions (plain dicts) -> aggregate Columns over the star view."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from balancier.functions import predicates as P
from balancier.plans.catalog import SpecError, column_of, resolve

FUNCTIONS = ("SUM", "AVG", "COUNT", "MIN", "MAX")
ARITHMETIC = ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")


class Spec(NamedTuple):
    expression: Mapping
    where: Any
    group_by: list[str]
    order_by: list[tuple[str, bool]]  # (field or "value", ascending)
    limit: int | None


NODES = ("FIELD", "VALUE", "AGGREGATION", *ARITHMETIC)


def _type(node: Mapping) -> str:
    kind = str(node.get("type")).strip().upper() if isinstance(node, Mapping) else None
    if kind not in NODES:
        raise SpecError(f"no such expression node: {node!r}")
    return kind


def has_aggregate(node: Mapping) -> bool:
    kind = _type(node)
    return kind == "AGGREGATION" or (
        kind in ARITHMETIC and (has_aggregate(node["left"]) or has_aggregate(node["right"]))
    )


def _ordering(raw: Any) -> list[tuple[str, bool]]:
    out = []
    for item in raw or []:
        if isinstance(item, str):
            out.append((item.strip(), True))
        else:
            out.append((item["field"].strip(), str(item.get("direction", "ASC")).strip().upper() != "DESC"))
    return out


def read_spec(raw: Mapping) -> Spec:
    """Put the parts of a metric definition in one shape.

    Only what no plan would show is refused here: names that are not in the star, and rows cut
    off in no order. Types are left to the analyzer.
    """
    whole = "expression" in raw and "type" not in raw
    expression = raw["expression"] if whole else raw
    where = raw.get("where") or raw.get("filter") or (raw.get("filters") if whole else None) or None
    group_by = [g.strip() for g in raw.get("groupBy", [])]
    order_by = _ordering(raw.get("orderBy"))
    cuts = [raw[k] for k in ("limit", "top") if raw.get(k) is not None]
    spec = Spec(expression, where, group_by, order_by, cuts[0] if cuts else None)
    fields_of(spec, with_order=True)  # resolves every name
    groups = {resolve(g).name for g in group_by}
    loose = [n for n, _ in order_by if groups and n.lower() != "value" and resolve(n).name not in groups]
    for wrong, why in (
        (len(cuts) > 1, "give a limit or a top, not both"),
        (any(isinstance(n, bool) or not isinstance(n, int) or n < 1 for n in cuts), "rows are cut at a whole number above 0"),
        (cuts and not order_by, "rows are cut in some order only"),
        (loose, f"groups have no {', '.join(loose)} to be ordered by"),
    ):
        if wrong:
            raise SpecError(why)
    return spec


def _expression_fields(node: Mapping) -> Iterator[str]:
    kind = _type(node)
    if kind in ("FIELD", "AGGREGATION") and node.get("field"):
        yield node["field"]
    if kind == "AGGREGATION":
        if node.get("expression"):
            yield from _expression_fields(node["expression"])
        yield from P.fields_in(node.get("filters"))
    if kind in ARITHMETIC:
        yield from _expression_fields(node["left"])
        yield from _expression_fields(node["right"])


def fields_of(spec: Spec, with_order: bool = False) -> list[str]:
    """Canonical fields the metric depends on; ordering fields count only on request."""
    names = [*_expression_fields(spec.expression), *P.fields_in(spec.where), *spec.group_by]
    if with_order:
        names += [name for name, _ in spec.order_by if name.lower() != "value"]
    return list(dict.fromkeys(resolve(n).name for n in names))


class Reading(NamedTuple):
    """How to read the star: which columns stand in for others, and the what-if rules.

    In a what-if, empty aggregates and divisions by (nearly) zero count as 0 and
    patterns ignore case. ``whole`` names 64-bit integer columns: their sums run on
    decimals, as the total of a large table need not fit 64 bits.
    """

    swap: Mapping[str, str] | None = None
    what_if: bool = False
    whole: frozenset[str] = frozenset()

    def filter(self, node: Any) -> Column:
        return P.predicate(node, self.what_if, self.swap)


PLAIN = Reading()


def reading_of(rows: DataFrame, swap: Mapping[str, str] | None = None, what_if: bool = False) -> Reading:
    whole = frozenset(f.name for f in rows.schema if isinstance(f.dataType, T.LongType))
    return Reading(swap, what_if, whole)


NEAR_ZERO = 1e-12


def _arith(kind: str, left: Column, right: Column) -> Column:
    if kind == "DIVIDE":
        left, right = left.cast("double"), right.cast("double")
        return left / F.nullif(right, F.lit(0.0))
    return {"ADD": left + right, "SUBTRACT": left - right, "MULTIPLY": left * right}[kind]


def _whole(name: str, reading: Reading) -> Column:
    """The field's column; 64-bit integers as decimals, so that products and totals stay exact."""
    col, flat = column_of(name, reading.swap), resolve(name).flat
    return col.cast("decimal(20,0)") if (reading.swap or {}).get(flat, flat) in reading.whole else col


def row_value(node: Mapping, reading: Reading = PLAIN) -> Column:
    """Row-level expression."""
    kind = _type(node)
    if kind == "FIELD":
        return _whole(node["field"], reading)
    if kind == "VALUE":
        return P.literal(node["value"])
    if kind == "AGGREGATION":
        raise SpecError("an aggregate inside an aggregate")
    return _arith(kind, row_value(node["left"], reading), row_value(node["right"], reading))


def aggregate_input(node: Mapping, where: Column | None, reading: Reading = PLAIN) -> tuple[str, Column]:
    """The function of an aggregate node, and what it runs on: NULL for rows its filters leave out."""
    function = node["function"].strip().upper()
    if function not in FUNCTIONS:
        raise SpecError(f"no such aggregate: {function}")
    if node.get("expression"):
        x = row_value(node["expression"], reading)
    elif node.get("field"):
        x = _whole(node["field"], reading) if function in ("SUM", "AVG") else column_of(node["field"], reading.swap)
    else:
        x = F.lit(1)
    keep = [c for c in (where, reading.filter(node["filters"]) if node.get("filters") else None) if c is not None]
    return function, F.when(reduce(lambda a, b: a & b, keep), x) if keep else x


def mean(total: Column, count: Column) -> Column:
    """From an exact sum, so whatever order the rows come in."""
    return total.cast("double") / F.nullif(count.cast("double"), F.lit(0.0))


def _aggregate(node: Mapping, where: Column | None, reading: Reading) -> Column:
    function, x = aggregate_input(node, where, reading)
    distinct = node.get("distinct") is True
    if function == "COUNT":
        return (F.count_distinct(x) if distinct else F.count(x)).cast("double")
    if function == "SUM":
        out = (F.sum_distinct(x) if distinct else F.sum(x)).cast("double")
    elif function == "AVG":
        out = mean(F.sum_distinct(x), F.count_distinct(x)) if distinct else mean(F.sum(x), F.count(x))
    else:
        out = {"MIN": F.min, "MAX": F.max}[function](x).cast("double")
    return F.coalesce(out, F.lit(0.0)) if reading.what_if else out


def combine(expression: Mapping, leaf: Callable[[Mapping], Column], what_if: bool = False) -> Column:
    """A metric's arithmetic over the values that ``leaf`` gives for its aggregates and fields."""
    kind = _type(expression)
    if kind in ("AGGREGATION", "FIELD"):
        return leaf(expression)
    if kind == "VALUE":
        return P.literal(expression["value"]).cast("double")
    left, right = (combine(expression[side], leaf, what_if) for side in ("left", "right"))
    if kind == "DIVIDE" and what_if:
        return F.coalesce(left / F.when(F.abs(right) >= NEAR_ZERO, right), F.lit(0.0))
    return _arith(kind, left, right)


def aggregates_of(expression: Mapping) -> Iterator[Mapping]:
    kind = _type(expression)
    if kind == "AGGREGATION":
        yield expression
    elif kind in ARITHMETIC:
        yield from aggregates_of(expression["left"])
        yield from aggregates_of(expression["right"])


def metric_column(expression: Mapping, where: Column | None = None, reading: Reading = PLAIN) -> Column:
    """Aggregate Column of a metric, as a double.

    ``where`` narrows every aggregate in it, so metrics with different row filters
    share one pass over the same rows. Sums run on the column's own exact type and
    turn into doubles after aggregation.
    """

    def leaf(node: Mapping) -> Column:
        if _type(node) == "FIELD":
            return column_of(node["field"], reading.swap).cast("double")
        return _aggregate(node, where, reading)

    return combine(expression, leaf, reading.what_if)


def scalar_column(spec: Spec, reading: Reading = PLAIN) -> Column:
    """A metric's value over all rows, its own row filter included."""
    where = reading.filter(spec.where) if spec.where is not None else None
    return metric_column(spec.expression, where, reading)
