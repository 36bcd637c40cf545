"""Ratios: arithmetic over metric columns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.plans.catalog import SpecError
from balancier.plans.specs import ARITHMETIC, NEAR_ZERO

# Fixed value: the stored error of a ratio whose divisor is zero.
ZERO_MESSAGE = "Division by zero is not allowed"


def _type(node: Mapping) -> str:
    kind = str(node.get("type", "")).strip().upper() if isinstance(node, Mapping) else ""
    if kind == "PARAM" and not str(node.get("code") or "").strip():
        raise SpecError(f"a PARAM without a code: {node!r}")
    if kind == "CONSTANT" and not isinstance(node.get("value"), (int, float)):
        raise SpecError(f"a CONSTANT without a number: {node!r}")
    if kind not in ("PARAM", "CONSTANT", *ARITHMETIC):
        raise SpecError(f"no such ratio node: {node!r}")
    return kind


def codes_of(tree: Mapping) -> list[str]:
    """Metric codes a ratio refers to, in order of first use."""
    kind = _type(tree)
    if kind == "PARAM":
        return [tree["code"].strip()]
    if kind == "CONSTANT":
        return []
    return list(dict.fromkeys([*codes_of(tree["left"]), *codes_of(tree["right"])]))


def ratio_column(tree: Mapping, on_zero: str = "null", prefix: str = "") -> Column:
    """A ratio over metric columns; a missing metric value counts as 0.

    ``on_zero`` says what a division by (nearly) zero gives: ``null``, ``zero``, or
    ``error``, which fails the query.
    """
    kind = _type(tree)
    if kind == "PARAM":
        return F.coalesce(F.col(f"`{prefix}{tree['code'].strip()}`").cast("double"), F.lit(0.0))
    if kind == "CONSTANT":
        return F.lit(float(tree["value"]))
    left, right = (ratio_column(tree[s], on_zero, prefix) for s in ("left", "right"))
    if kind != "DIVIDE":
        return {"ADD": left + right, "SUBTRACT": left - right, "MULTIPLY": left * right}[kind]
    quotient = left / F.when(F.abs(right) >= NEAR_ZERO, right)
    if on_zero == "zero":
        return F.coalesce(quotient, F.lit(0.0))
    if on_zero == "error":
        return F.when(F.abs(right) < NEAR_ZERO, F.raise_error(F.lit(ZERO_MESSAGE)).cast("double")).otherwise(quotient)
    return quotient


def ratios_wide(metrics: DataFrame, ratios: Mapping[str, Mapping], keys: Iterable[str] = (), on_zero: str = "null") -> DataFrame:
    return metrics.select(*keys, *[ratio_column(tree, on_zero).alias(code) for code, tree in ratios.items()])


def ratios_long(metrics: DataFrame, ratios: Mapping[str, Mapping], keys: Iterable[str] = (), on_zero: str = "null") -> DataFrame:
    """(keys, code, value, inputs) rows; inputs maps the ratio's metric codes to their values."""
    one = [
        F.struct(
            F.lit(code).alias("code"),
            ratio_column(tree, on_zero).alias("value"),
            _inputs(tree).alias("inputs"),
        )
        for code, tree in ratios.items()
    ]
    return metrics.select(*keys, F.inline(F.array(*one)))


def _inputs(tree: Mapping) -> Column:
    pairs = [x for c in codes_of(tree) for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def needed_metrics(ratios: Mapping[str, Mapping], catalog: Mapping[str, Mapping]) -> dict[str, Mapping]:
    """The metric definitions these ratios use."""
    wanted = list(dict.fromkeys(c for tree in ratios.values() for c in codes_of(tree)))
    unknown = [c for c in wanted if c not in catalog]
    if unknown:
        raise SpecError(f"no metrics of these codes: {unknown}")
    return {c: catalog[c] for c in wanted}


def read_config(config: DataFrame, formula: str = "formula_json") -> dict[str, tuple[int, Mapping]]:
    """Active definitions of a configuration table: code -> (id, formula)."""
    rows = config.filter("is_active").select("id", "code", formula).orderBy("id").toLocalIterator()  # read by people, so small
    return {r["code"]: (r["id"], json.loads(r[formula])) for r in rows}
