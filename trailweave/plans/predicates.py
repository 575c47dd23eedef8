"""Filters of a box as Column predicates and joins; null never passes a filter."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cel import Expressions, Frame, declared_kinds, entities
from ..log import Log, brought_value, number, seconds_between
from ..operators.temporal import latest_at


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _within(c: Column, low: Any, high: Any) -> Column:
    p = c.isNotNull()
    if low is not None:
        p = p & (c >= F.lit(low))
    return p & (c <= F.lit(high)) if high is not None else p


def value_test(v: Column, test: dict[str, Any]) -> Column:
    """A test of a VALUE struct; bounds are inclusive and numbers compare across kinds."""
    kind = test["type"]
    if kind in ("Float", "Integer"):
        p = _within(number(v), test.get("min"), test.get("max"))
    elif kind == "Boolean":
        p = v["b"] == F.lit(bool(test["is_true"]))
    elif kind == "String":
        p = v["s"].isin(list(test["is_in"]))
    elif kind == "Time":
        p = time_test(v["t"], test)
    else:
        raise ValueError(f"unknown value test {kind}")
    return holds(p)


def time_test(t: Column, test: dict[str, Any]) -> Column:
    bound = lambda x: None if x is None else F.lit(x).cast("timestamp_ntz")
    low, high = bound(test.get("from")), bound(test.get("to"))
    p = t.isNotNull()
    p = p & (t >= low) if low is not None else p
    return p & (t <= high) if high is not None else p


def variables(f: dict[str, Any]) -> set[str]:
    """Variables that a filter looks at; an expression may use any."""
    found = {f[k] for k in ("event", "object", "other_object", "from_event", "to_event", "var_1", "var_2") if f.get(k)}
    if isinstance(f.get("at_time"), dict) and f["at_time"].get("event"):
        found.add(f["at_time"]["event"])
    return found


def relation(log: Log, f: dict[str, Any], types: dict[str, list[str]], known: dict[str, list[str]] | None = None) -> DataFrame:
    """Distinct pairs of an O2E or O2O filter, named by its variables; events bring their time.

    ``known`` has the types of variables that the pairs will be joined to; where ids are unique, pairs of other types are left out.
    """
    if f["type"] == "O2E":
        pairs, ends = (log.values or log).e2o, {f["object"]: ("ob_id", "ob_type"), f["event"]: ("ev_id", "ev_type")}
    else:
        pairs, ends = log.o2o, {f["object"]: ("src_id", "src_type"), f["other_object"]: ("dst_id", "dst_type")}
    if f.get("qualifier") is not None:
        pairs = pairs.filter(F.col("qualifier") == f["qualifier"])
    columns = []
    for var, (id_, type_) in ends.items():
        if var in types:
            pairs = pairs.filter(F.col(type_).isin(types[var]))
        elif log.single and known and var in known:
            pairs = pairs.filter(F.col(type_).isin(known[var]))
        columns.append(F.col(id_).alias(var))
    if f["type"] == "O2E":
        columns.append(F.col("ev_time").alias(f"{f['event']}_time"))
        columns += log.brought(f["event"]) if f["event"] in types else []
    return pairs.select(*columns) if log.single else pairs.select(*columns).distinct()


def tested(df: DataFrame, log: Log, f: dict[str, Any], types: dict[str, list[str]]) -> tuple[DataFrame, Column]:
    """``df`` with what the filter needs, and its predicate; a row of ``df`` stays a row."""
    kind, flag = f["type"], f"_f{len(df.columns)}"

    def flagged(hits: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
        return df.join(hits.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left"), F.col(flag).isNotNull()

    if kind in ("O2E", "O2O"):
        pair = [f["object"], f["event" if kind == "O2E" else "other_object"]]
        return flagged(relation(log, f, {}, types), pair)
    if kind == "TimeBetweenEvents":
        gap = seconds_between(f"{f['from_event']}_time", f"{f['to_event']}_time")
        return df, _within(gap, f.get("min_seconds"), f.get("max_seconds"))
    if kind == "NotEqual":
        a, b = f["var_1"], f["var_2"]
        if not {a, b} <= set(df.columns):
            return df, F.lit(False)
        return df, F.lit(True) if a[0] != b[0] else F.col(a) != F.col(b)
    if kind == "EventAttributeValueFilter":
        var, name, test = f["event"], f["attribute_name"], f["value_filter"]
        if name == "ocel:id":
            return df, F.col(var).isin(list(test["is_in"])) if test["type"] == "String" else F.lit(False)
        if name == "ocel:time":
            return df, time_test(F.col(f"{var}_time"), test) if test["type"] == "Time" else F.lit(False)
        if (brought := brought_value(df, var, name)) is not None:
            return df, value_test(brought, test)
        hits = log.event_attr.filter(F.col("name") == name).filter(value_test(F.col("value"), test)).select(F.col("ev_id").alias(var))
        return flagged(hits, [var])
    if kind == "ObjectAttributeValueFilter":
        var, name, test, when = f["object"], f["attribute_name"], f["value_filter"], f["at_time"]["type"]
        if name == "ocel:id":
            return df, F.col(var).isin(list(test["is_in"])) if test["type"] == "String" else F.lit(False)
        versions = log.object_attr.filter(F.col("name") == name)
        if when == "Always":  # no version fails; none at all passes
            joined, some = flagged(versions.filter(~value_test(F.col("value"), test)).select(F.col("ob_id").alias(var)), [var])
            return joined, ~some
        if when == "Sometime":
            return flagged(versions.filter(value_test(F.col("value"), test)).select(F.col("ob_id").alias(var)), [var])
        event = f["at_time"]["event"]
        latest = latest_at(df, [event], versions.withColumnRenamed("ob_id", var), var, f"{event}_time", F.col("value"))
        return flagged(latest.filter(value_test(F.col("latest"), test)), [var, event])
    if kind in ("Expr", "BasicFilterCEL", "AdvancedCEL"):
        if f.get("sql"):
            return df, F.expr(f["sql"])
        frame = Frame(log, declared_kinds(log), f"f{len(df.columns)}_")
        expressions = Expressions(frame, entities(frame, {c: types.get(c) for c in df.columns if re.fullmatch(r"[eo]\d+", c)}))
        p = expressions.predicate(f["cel"])
        return expressions.joined(df), p
    raise ValueError(f"unknown filter {kind}")
