"""Metric states kept by date: a fill after a load reads the new facts only.

Every aggregate of a metric is kept as what can be merged: sums, counts, least and greatest
values, and for DISTINCT the values themselves. A refresh reads the facts above the id up to which
a state is known, adds their states as a part of its own, and publishes all it wrote by one log
line, so a refresh that breaks stays unread. States are named by what they aggregate: a metric
whose definition changed is a new state, and one pass over the older facts makes it.

Facts must only be appended and numbered upwards, as ``datamart.append_facts`` does. Late facts of
a closed date are merged with what is kept. Labels are taken as they are when a fact is read; after
a change of labels that metrics filter by, start a new folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from balancier.operators.metrics import DATE_FIELD, read_scalars
from balancier.plans.catalog import Narrowed, SpecError, column_of, star
from balancier.plans.specs import Spec, aggregate_input, aggregates_of, combine, fields_of, mean, reading_of

FACT_ID = "id"
DAY = "reference_date"
LOG = "part string, states array<string>, after bigint, upto bigint"
#: What each aggregate is put together from; DISTINCT ones from their values.
KINDS = {"SUM": ("total",), "COUNT": ("count",), "AVG": ("total", "count"), "MIN": ("least",), "MAX": ("greatest",)}
BUILD = {"total": F.sum, "count": F.count, "least": F.min, "greatest": F.max}
MERGE = {**BUILD, "count": F.sum}
VALUES = "values"
#: The newest fact of a date.
NEWEST = "newest"


class State(NamedTuple):
    name: str
    kind: str
    node: Mapping
    spec: Spec


def _names(node: Mapping, spec: Spec) -> dict[str, str]:
    """Kind -> name of the state. Equal aggregates of different metrics share a state."""
    function = str(node["function"]).strip().upper()
    if function not in KINDS:
        raise SpecError(f"no such aggregate: {function}")
    kinds = (VALUES,) if node.get("distinct") is True and function not in ("MIN", "MAX") else KINDS[function]
    what = {key: node.get(key) for key in ("field", "expression", "filters")} | {"where": spec.where}
    out = {}
    for kind in kinds:
        # A total reads whole numbers as decimals, the others read the column as it is.
        text = json.dumps([kind, function in ("SUM", "AVG"), what], sort_keys=True, default=lambda v: [type(v).__name__, str(v)])
        out[kind] = f"{kind}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"
    return out


def states_of(specs: Mapping[str, Spec]) -> dict[str, State]:
    out = {}
    for code, spec in specs.items():
        for node in aggregates_of(spec.expression):
            for kind, name in _names(node, spec).items():
                out.setdefault(name, State(name, kind, node, spec))
    return out


def _input(state: State, rows: DataFrame) -> Column:
    reading = reading_of(rows)
    where = reading.filter(state.spec.where) if state.spec.where is not None else None
    return aggregate_input(state.node, where, reading)[1]


def _star(tables: Mapping[str, DataFrame], states: Iterable[State]) -> DataFrame:
    fields = []
    for state in states:
        fields += fields_of(Spec(state.node, state.spec.where, [], [], None))
    rows = star(tables, [*fields, DATE_FIELD, FACT_ID])
    return rows.filter(column_of(DATE_FIELD).isNotNull())


def _sums(rows: DataFrame, states: Iterable[State]) -> DataFrame:
    built = [BUILD[s.kind](_input(s, rows)).alias(s.name) for s in states if s.kind != VALUES]
    dated = F.count(F.lit(1)).alias("facts")  # there is a row for every date, whatever is asked for
    newest = F.max(column_of(FACT_ID)).alias(NEWEST)
    return rows.groupBy(column_of(DATE_FIELD).alias(DAY)).agg(dated, newest, *built)


def _values(rows: DataFrame, states: Iterable[State]) -> DataFrame:
    """(date, state, value as text), each once; a hot value is one row in every task."""
    cells = []
    for s in states:
        x = _input(s, rows)
        if isinstance(rows.select(x).schema[0].dataType, (T.FloatType, T.DoubleType)):
            x = x + F.lit(0.0)  # -0.0 is 0.0
        cells.append(F.struct(F.lit(s.name).alias("state"), x.cast("string").alias("value")))
    pairs = rows.select(column_of(DATE_FIELD).alias(DAY), F.inline(F.array(*cells)))
    return pairs.filter(F.col("value").isNotNull()).distinct()


def read_log(spark: SparkSession, root: str) -> list:
    """One row for each part of a refresh: few, and written by this module."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _marks(log: Iterable) -> dict[str, int]:
    """The fact up to which each state is known. Parts of two writers at once would count facts twice."""
    marks: dict[str, int] = {}
    for line in sorted(log, key=lambda line: line["upto"]):
        for name in line["states"]:
            if marks.get(name, 0) != line["after"]:
                raise ValueError(f"facts after {line['after']} were kept by more than one refresh; start a new folder")
            marks[name] = line["upto"]
    return marks


def refresh(tables: Mapping[str, DataFrame], raw: Mapping[str, Mapping], root: str) -> int:
    """Bring the states of these metrics up to the newest fact; returns how many parts were written.

    States known up to the same fact share one pass, so after a load there is one over the new
    facts, and one over the older facts for metrics that are new. The first pass, over the fewest
    facts, says which the newest is.
    """
    facts = tables["fact_balance"]
    spark = facts.sparkSession
    wanted = states_of(read_scalars(raw))
    marks = _marks(read_log(spark, root))
    groups: dict[int | None, list[State]] = {}
    for name, state in wanted.items():
        groups.setdefault(marks.get(name), []).append(state)
    known, newest = max(marks.values(), default=0), None
    lines = []
    for after, states in sorted(groups.items(), key=lambda g: -1 if g[0] is None else g[0], reverse=True):
        if newest is not None and after == newest:
            continue
        part = uuid.uuid4().hex
        # Row groups below the mark are left out by their statistics.
        between = facts.filter(F.col(FACT_ID) > (after or 0))
        if newest is not None:
            between = between.filter(F.col(FACT_ID) <= newest)
        _sums(_star(Narrowed(tables, between), states), states).write.parquet(f"{root}/sums/{part}")
        if newest is None:
            top = spark.read.schema(f"{NEWEST} bigint").parquet(f"{root}/sums/{part}").agg(F.max(NEWEST)).first()[0]
            newest = max(known, top or 0)
            if after == newest:
                continue  # no new facts: the part stays unread
            between = between.filter(F.col(FACT_ID) <= newest)
        distinct = [s for s in states if s.kind == VALUES]
        if distinct:
            _values(_star(Narrowed(tables, between), distinct), distinct).write.parquet(f"{root}/values/{part}")
        lines.append((part, [s.name for s in states], after or 0, newest))
    if lines:
        spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return len(lines)


def _finished(node: Mapping, spec: Spec) -> Column:
    function, names = str(node["function"]).strip().upper(), _names(node, spec)
    if VALUES in names:
        total, count = F.col(f"total_{names[VALUES]}"), F.col(f"count_{names[VALUES]}")
        return {"COUNT": F.coalesce(count, F.lit(0)).cast("double"), "SUM": total.cast("double"), "AVG": mean(total, count)}[function]
    if function == "AVG":
        return mean(F.col(names["total"]), F.col(names["count"]))
    return F.col(next(iter(names.values()))).cast("double")


def metrics_by_date(tables: Mapping[str, DataFrame], raw: Mapping[str, Mapping], root: str) -> DataFrame:
    """What ``metrics.metrics_by_date`` gives, from the kept states; no fact is read.

    The tables give the types of their columns only. States of these metrics that were not
    refreshed together with the newest are refused.
    """
    spark = tables["fact_balance"].sparkSession
    specs = read_scalars(raw)
    wanted = states_of(specs)
    log = read_log(spark, root)
    marks = _marks(log)
    newest = max(marks.values(), default=0)
    behind = [name for name in wanted if marks.get(name, -1) < newest]
    if behind:
        raise SpecError(f"refresh these metrics first: {len(behind)} of their states are missing or old")
    rows = _star(tables, wanted.values())
    plain = [s for s in wanted.values() if s.kind != VALUES]
    schema = _sums(rows, plain).schema
    merged = spark.read.schema(schema).parquet(*[f"{root}/sums/{line['part']}" for line in log]).groupBy(DAY).agg(
        F.sum("facts").alias("facts"), *[MERGE[s.kind](s.name).alias(s.name) for s in plain]
    )
    distinct = [s for s in wanted.values() if s.kind == VALUES]
    if distinct:
        merged = merged.join(_distinct(spark, rows, distinct, log, root), DAY, "left")
    columns = []
    for code, spec in specs.items():
        columns.append(combine(spec.expression, lambda node, spec=spec: _leaf(node, spec)).alias(code))
    return merged.select(DAY, *columns)


def _leaf(node: Mapping, spec: Spec) -> Column:
    if node["type"].strip().upper() == "FIELD":
        raise SpecError("a field outside an aggregate has no state")
    return _finished(node, spec)


def _distinct(spark: SparkSession, rows: DataFrame, states: list[State], log: Iterable, root: str) -> DataFrame:
    """Per date the count of each state's values, and their total where they are numbers."""
    names = {s.name for s in states}
    parts = [line["part"] for line in log if any(n.startswith(VALUES) for n in line["states"])]
    kept = spark.read.schema(f"{DAY} date, state string, value string").parquet(*[f"{root}/values/{p}" for p in parts])
    once = kept.filter(F.col("state").isin(*names)).distinct()
    columns = []
    for s in states:
        own, kind = F.col("state") == s.name, rows.select(_input(s, rows)).schema[0].dataType
        columns.append(F.count_if(own).alias(f"count_{s.name}"))
        total = F.sum(F.when(own, F.col("value").cast(kind))) if isinstance(kind, T.NumericType) else F.max(F.lit(None).cast("double"))
        columns.append(total.alias(f"total_{s.name}"))
    return once.groupBy(DAY).agg(*columns)
