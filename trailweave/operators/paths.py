"""Path schemas: chains of typed relations between a source and a target type.

The type graph is a distinct aggregate; schemas are enumerated over it on the
driver (types are few); instances are joined in Spark, one equi-join per hop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import Log, seconds_between
from ..plans.tree import Box, Tree
from .statistics import histogram


@dataclass(frozen=True)
class Hop:
    source: str
    target: str
    qualifier: str
    kind: str  #: e2o or o2o
    reverse: bool


def type_graph(log: Log) -> DataFrame:
    """(source, target, qualifier, kind, n): distinct typed relations."""
    e2o = log.e2o.groupBy(F.col("ev_type").alias("source"), F.col("ob_type").alias("target"), "qualifier").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("e2o"))
    o2o = log.o2o.groupBy(F.col("src_type").alias("source"), F.col("dst_type").alias("target"), "qualifier").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("o2o"))
    return e2o.unionByName(o2o).select("source", "target", "qualifier", "kind", "n")


def enumerate_schemas(graph: list[tuple], source: str, target: str | None, longest: int, allowed: set[str] | None = None) -> list[tuple[Hop, ...]]:
    """Type-level paths without repeated types, in either direction of a relation, by length and then by name."""
    hops: dict[str, list[Hop]] = {}
    for a, b, q, kind, *_ in graph:
        hops.setdefault(a, []).append(Hop(a, b, q, kind, False))
        hops.setdefault(b, []).append(Hop(b, a, q, kind, True))
    out, level = [], [()]
    for _ in range(longest):
        grown = []
        for path in level:
            at = path[-1].target if path else source
            seen = {source, *(h.target for h in path)}
            for hop in sorted(hops.get(at, []), key=lambda h: (h.target, h.qualifier, h.kind, h.reverse)):
                if hop.target not in seen and (allowed is None or hop.target in allowed or hop.target == target):
                    grown.append((*path, hop))
        out += [p for p in grown if target is None or p[-1].target == target]
        level = [p for p in grown if p[-1].target != target]
    return out


def _events(log: Log) -> set[str]:
    return {r[0] for r in log.event.select("ev_type").distinct().collect()}


def connections(log: Log, path: tuple[Hop, ...], temporal: str = "None", within: float = 0.0, event_types: set[str] | None = None) -> DataFrame:
    """(source, target, source_time, target_time, n): connected pairs and their number of instance paths.

    ``Forward`` asks for events in order along the path, ``Bounded`` also for at most ``within`` seconds between them.
    """
    events = _events(log) if event_types is None else event_types
    first = path[0].source
    if first in events:
        df = log.event.filter(F.col("ev_type") == first).select(F.col("ev_id").alias("source"), F.col("ev_id").alias("at"), F.col("ev_time").alias("source_time"), F.col("ev_time").alias("last"))
    else:
        df = log.object.filter(F.col("ob_type") == first).select(F.col("ob_id").alias("source"), F.col("ob_id").alias("at"), F.lit(None).cast("timestamp_ntz").alias("source_time"), F.lit(None).cast("timestamp_ntz").alias("last"))
    df = df.withColumn("n", F.lit(1).cast("long"))
    for hop in path:
        a, b = (hop.target, hop.source) if hop.reverse else (hop.source, hop.target)
        if hop.kind == "e2o":
            rel = log.e2o.filter((F.col("ev_type") == a) & (F.col("ob_type") == b) & (F.col("qualifier") == hop.qualifier)).select(F.col("ev_id").alias("x"), F.col("ob_id").alias("y"), F.when(F.lit(hop.reverse), F.col("ev_time")).alias("time")).distinct()
        else:
            rel = log.o2o.filter((F.col("src_type") == a) & (F.col("dst_type") == b) & (F.col("qualifier") == hop.qualifier)).select(F.col("src_id").alias("x"), F.col("dst_id").alias("y"), F.lit(None).cast("timestamp_ntz").alias("time")).distinct()
        rel = rel.select(F.col("y").alias("at"), F.col("x").alias("next"), "time") if hop.reverse else rel.select(F.col("x").alias("at"), F.col("y").alias("next"), "time")
        df = df.join(rel, "at")
        if temporal != "None":
            gap = seconds_between("last", "time")
            ok = F.col("last").isNull() | F.col("time").isNull() | (gap >= 0)
            df = df.filter(ok & (F.col("last").isNull() | F.col("time").isNull() | (gap <= max(0.0, within)))) if temporal == "Bounded" else df.filter(ok)
        # paths that meet are counted, not kept apart
        df = df.groupBy("source", "source_time", F.col("next").alias("at"), F.coalesce("time", "last").alias("last")).agg(F.sum("n").alias("n"))
    last = path[-1].target
    target_time = F.col("last") if last in events else F.lit(None).cast("timestamp_ntz")
    return df.groupBy("source", "source_time", F.col("at").alias("target"), target_time.alias("target_time")).agg(F.sum("n").alias("n")).select("source", "target", "source_time", "target_time", "n")


def selected(pairs: DataFrame, how: str) -> DataFrame:
    """All pairs, or the First, Last or Closest target of each source by time; ties by id."""
    if how == "All":
        return pairs
    distance = F.abs(seconds_between("source_time", "target_time"))
    order = {"First": [F.col("target_time").asc()], "Last": [F.col("target_time").desc()], "Closest": [distance.asc()]}[how]
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(*order, "target"))).filter("rank = 1").drop("rank")


def metrics(log: Log, path: tuple[Hop, ...], pairs: DataFrame, event_types: set[str] | None = None) -> DataFrame:
    """One row: sources, connected, support, reached, coverage, selectivity, reach, exclusivity, path_count."""
    events = _events(log) if event_types is None else event_types

    def size(t):
        return (log.event.filter(F.col("ev_type") == t) if t in events else log.object.filter(F.col("ob_type") == t)).agg(F.count(F.lit(1)))

    own = pairs.agg(F.count_distinct("source").alias("connected"), F.count_distinct("target").alias("reached"), F.count(F.lit(1)).alias("support"), F.coalesce(F.sum("n"), F.lit(0)).alias("path_count"))
    out = own.crossJoin(size(path[0].source).toDF("sources")).crossJoin(size(path[-1].target).toDF("targets"))  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("sources", "targets", "connected", "reached", "support", "path_count", ratio("connected", "sources").alias("coverage"), ratio("connected", "support").alias("selectivity"), ratio("reached", "targets").alias("reach"), ratio("reached", "support").alias("exclusivity"))


def throughput(pairs: DataFrame) -> DataFrame:
    """One row: low, high, mean and median seconds of pairs of events."""
    s = seconds_between("source_time", "target_time")
    return pairs.agg(F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.median(s).alias("median"))


def fingerprint(pairs: DataFrame) -> DataFrame:
    """One row that is equal for equal sets of pairs, whatever their order: number and two sums of hashes."""
    pair = pairs.select("source", "target").distinct()
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), "source", "target").cast("decimal(38,0)"))
    return pair.agg(F.count(F.lit(1)).alias("pairs"), h("a").alias("h1"), h("b").alias("h2"))


def same_connections(first: DataFrame, second: DataFrame) -> bool:
    """Whether two schemas connect the same pairs: by fingerprint, then exactly."""
    if fingerprint(first).first() != fingerprint(second).first():
        return False
    a, b = (p.select("source", "target").distinct() for p in (first, second))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def equivalence_classes(log: Log, schemas: list[tuple[Hop, ...]], event_types: set[str] | None = None) -> DataFrame:
    """(nth, class, pairs): schemas that connect the same pairs share the number of the first; told by two sums of hashes and the number of pairs."""
    events = _events(log) if event_types is None else event_types
    out = None
    for i, path in enumerate(schemas):
        row = fingerprint(connections(log, path, event_types=events)).select(F.lit(i).alias("nth"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("class", F.min("nth").over(W.partitionBy("pairs", "h1", "h2"))).select("nth", "class", "pairs")  # a row per schema


def schema_name(path: tuple[Hop, ...]) -> str:
    return path[0].source + "".join(f" -{'<' if h.reverse else '>'}{h.qualifier}- {h.target}" for h in path)


def discover_schemas(log: Log, source: str, target: str | None, longest: int, most: int = 50, temporal: str = "None", within: float = 0.0, selectivity: float | None = None, most_connections: int | None = None) -> DataFrame:
    """(schema, metrics…, ended_early) of every schema, those that connect something first, then by selectivity and support.

    Schemas under a ``selectivity`` are left out; ``ended_early`` marks those with over ``most_connections``
    pairs, whose metrics still cover all.
    """
    events = _events(log)
    out = None
    for i, path in enumerate(enumerate_schemas([tuple(r) for r in type_graph(log).collect()], source, target, longest)):  # types are few
        row = metrics(log, path, connections(log, path, temporal, within, events), events).select(F.lit(i).alias("nth"), F.lit(schema_name(path)).alias("schema"), "*")
        out = row if out is None else out.unionByName(row)
    if selectivity is not None:
        out = out.filter(F.col("selectivity") >= selectivity)
    out = out.withColumn("ended_early", F.col("support") > most_connections if most_connections is not None else F.lit(False))
    return out.orderBy(F.desc(F.col("support") > 0), F.desc("selectivity"), F.desc("support"), "nth").limit(most)


def schema_detail(log: Log, path: tuple[Hop, ...], temporal: str = "None", within: float = 0.0, bins: int = 20) -> dict[str, DataFrame]:
    """One schema's ``metrics``, ``throughput``, ``durations`` (bins of seconds), ``targets_per_source`` and ``sources_per_target`` (k, n; zeros included) and ``connections``."""
    events = _events(log)
    pairs = connections(log, path, temporal, within, events)

    def per(end: str, other: str, kind: str) -> DataFrame:
        every = log.event.filter(F.col("ev_type") == kind).select(F.col("ev_id").alias(end)) if kind in events else log.object.filter(F.col("ob_type") == kind).select(F.col("ob_id").alias(end))
        counted = pairs.groupBy(end).agg(F.count_distinct(other).alias("k"))
        return every.join(counted, end, "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    return {
        "metrics": metrics(log, path, pairs, events), "throughput": throughput(pairs), "durations": histogram(pairs.select(seconds_between("source_time", "target_time").alias("v")), "v", bins),
        "targets_per_source": per("source", "target", path[0].source), "sources_per_target": per("target", "source", path[-1].target), "connections": pairs,
    }


def combined_tree(schemas: list[tuple[Hop, ...]], event_types: set[str], within: float | None = None) -> Tree:
    """One query that all schemas hold for: their source and target are shared, and so are the variables of equal beginnings."""
    names: dict[tuple, str] = {}
    box, n = Box(), {"e": 0, "o": 0}

    def variable(key: tuple, t: str) -> str:
        if key not in names:
            kind = "e" if t in event_types else "o"
            n[kind] += 1
            names[key] = f"{kind}{n[kind]}"
            (box.events if kind == "e" else box.objects)[names[key]] = [t]
        return names[key]

    def add(f: dict) -> None:
        if f not in box.filters:
            box.filters.append(f)

    for path in schemas:
        at, last = variable((), path[0].source), None
        last = at if at[0] == "e" else None
        for i, h in enumerate(path, 1):
            key = ("target", h.target) if i == len(path) else path[:i]
            to = variable(key, h.target)
            a, b = (to, at) if h.reverse else (at, to)
            if h.kind == "e2o":
                add({"type": "O2E", "object": b, "event": a, "qualifier": h.qualifier})
            else:
                add({"type": "O2O", "object": a, "other_object": b, "qualifier": h.qualifier})
            if to[0] == "e":
                if last:
                    add({"type": "TimeBetweenEvents", "from_event": last, "to_event": to, "min_seconds": 0.0, "max_seconds": within})
                last = to
            at = to
    return Tree([box])


def to_tree(path: tuple[Hop, ...], event_types: set[str], within: float | None = None) -> Tree:
    """A query with a variable per type on the path, its relations as filters, and events in order."""
    names, n = {}, {"e": 0, "o": 0}
    for t in [path[0].source, *(h.target for h in path)]:
        kind = "e" if t in event_types else "o"
        n[kind] += 1
        names[t] = f"{kind}{n[kind]}"
    box = Box(events={v: [t] for t, v in names.items() if v[0] == "e"}, objects={v: [t] for t, v in names.items() if v[0] == "o"})
    for h in path:
        a, b = (h.target, h.source) if h.reverse else (h.source, h.target)
        if h.kind == "e2o":
            box.filters.append({"type": "O2E", "object": names[b], "event": names[a], "qualifier": h.qualifier})
        else:
            box.filters.append({"type": "O2O", "object": names[a], "other_object": names[b], "qualifier": h.qualifier})
    order = list(box.events)
    for a, b in zip(order, order[1:], strict=False):
        box.filters.append({"type": "TimeBetweenEvents", "from_event": a, "to_event": b, "min_seconds": 0.0, "max_seconds": within})
    return Tree([box])
