"""Declarative arcs between activities: statistics, conformance, discovery, projection.

An arc says how many target events a source event has, for each binding of
``each`` objects of the source event; ``any`` and ``all`` restrict targets to
events with some, or all, of the source's objects of a label.  A label is an object
type, or ``Linked(first, second)``: the objects of type ``second`` that the source event's
objects of type ``first`` are related to.  The violation share counts (source event,
binding) rows whose number of targets is out of bounds.

With one ``each`` label, targets are counted by windows over an object's sorted
events, and no pairs are formed.  An arc with one ``any`` label that asks for at least one
target looks at each object's first and last target only.  Arcs with ``each`` and ``all``
types join sources and targets by the bound objects and one of the source's ``all`` objects,
each event having its objects beside it as sets.  Other arcs join sources and targets by
shared object.  Without objects of an ``all`` label a source is not
restricted by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import Log
from .discovery import type_names
from .flows import events_of

INIT, EXIT = "<init>", "<exit>"
TARGET_BINS = 25


@dataclass(frozen=True)
class Linked:
    """A label by O2O relations from type ``first`` to type ``second``; ``reversed`` ones lead from second to first."""

    first: str
    second: str
    reversed: bool = False

    def __str__(self) -> str:
        return f"{self.first}{'<' if self.reversed else '>'}{self.second}"


Label = str | Linked


@dataclass(frozen=True)
class Arc:
    source: str
    target: str
    kind: str = "EF"  #: AS, EF, EP, DF or DP
    low: int | None = 1
    high: int | None = None
    each: tuple[Label, ...] = ()
    any: tuple[Label, ...] = ()
    all: tuple[Label, ...] = field(default=())

    def __str__(self) -> str:
        label = ", ".join([*(f"Each({t})" for t in self.each), *(f"Any({t})" for t in self.any), *(f"All({t})" for t in self.all)])
        return f"{self.kind}({self.source}, {self.target}, {label or '-'}, {self.low or 0}, {'∞' if self.high is None else self.high})"


def _objects(log: Log, label: Label, source: bool) -> DataFrame:
    """(ob_id, ev_id, ev_type, ev_time): events with the label's objects, as sources or as targets."""
    if isinstance(label, str):
        return events_of(log, label).drop("ob_type")
    if not source:
        return events_of(log, label.second).drop("ob_type")
    here, there = ("dst", "src") if label.reversed else ("src", "dst")
    links = log.o2o.filter((F.col(f"{here}_type") == label.first) & (F.col(f"{there}_type") == label.second)).select(F.col(f"{here}_id").alias("ob_id"), F.col(f"{there}_id").alias("other")).distinct()
    return events_of(log, label.first).drop("ob_type").join(links, "ob_id").select(F.col("other").alias("ob_id"), "ev_id", "ev_type", "ev_time").distinct()


def _of(log: Log, activity: str, label: Label, names: tuple[str, str], source: bool) -> DataFrame:
    return _objects(log, label, source).filter(F.col("ev_type") == activity).select(F.col("ev_id").alias(names[0]), F.col("ob_id").alias(names[1]))


def _trace(log: Log, label: Label) -> DataFrame:
    """Events by the label's objects, marked as sources, as targets, or as both."""
    mark = lambda df, s, t: df.withColumns({"is_source": F.lit(s), "is_target": F.lit(t), "us": F.unix_micros(F.col("ev_time").cast("timestamp"))})
    if isinstance(label, str):
        return mark(_objects(log, label, True), True, True)
    return mark(_objects(log, label, True), True, False).unionByName(mark(_objects(log, label, False), False, True))


def _window(kind: str, by: W) -> W:
    """The frame of an event's targets: all events, later or earlier ones; frames only grow."""
    if kind == "AS":
        return by
    return by.orderBy(F.desc("us") if kind in ("EF", "DF") else F.col("us")).rangeBetween(W.unboundedPreceding, -1)


def _neighbour(kind: str, column: str) -> Column:
    """A column of the next or previous event of the object by time, then id, if it is strictly later or earlier."""
    order = W.partitionBy("ob_id").orderBy("us", "ev_id")
    step = F.lead if kind == "DF" else F.lag
    other = step("us").over(order)
    return F.when(other > F.col("us") if kind == "DF" else other < F.col("us"), step(column).over(order))


def matched(log: Log, arc: Arc) -> tuple[DataFrame, list[str]]:
    """(keys, s_time, n, first): source rows with their number of targets and the earliest one's time; and the keys."""
    if not (arc.each or arc.any or arc.all):
        raise ValueError("an arc without labels matches every event; use unlabelled_violation")
    if arc.kind in ("DF", "DP") and not arc.each:
        raise ValueError("directly-follows arcs need an object of their own (each)")
    if len(arc.each) == 1 and not arc.any and not arc.all and (arc.kind in ("AS", "EF", "EP") or isinstance(arc.each[0], str)):
        trace = _trace(log, arc.each[0])
        if arc.kind in ("DF", "DP"):
            # our definition: the neighbour in the trace of the bound object
            hit = _neighbour(arc.kind, "ev_type") == arc.target
            trace = trace.withColumns({"n": F.coalesce(hit.cast("long"), F.lit(0)), "first": F.when(hit, _neighbour(arc.kind, "ev_time"))})
        else:
            of = F.when(F.col("is_target") & (F.col("ev_type") == arc.target), F.col("ev_time"))
            frame = _window(arc.kind, W.partitionBy("ob_id"))
            trace = trace.filter(F.col("ev_type").isin(arc.source, arc.target)).withColumns({"n": F.count(of).over(frame), "first": F.min(of).over(frame)})
        rows = trace.filter(F.col("is_source") & (F.col("ev_type") == arc.source))
        return rows.select(F.col("ev_id").alias("s"), F.col("ob_id").alias("each0"), F.col("ev_time").alias("s_time"), "n", "first"), ["s", "each0"]
    pairs, free, rows, keys = _paired(log, arc)
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t_time").alias("first"))
    out = rows.join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if free is not None:
        out = out.join(free.select(*keys), keys, "left_anti").unionByName(_among_all(log, arc, free))
    return out, keys


#: When an event is a target of a source.
LATER = {"EF": "t_time > s_time", "DF": "t_time > s_time", "EP": "t_time < s_time", "DP": "t_time < s_time", "AS": "true"}


def _by_sets(log: Log, arc: Arc) -> bool:
    """Whether the arc is one of ``_sharing``; where ids may repeat, an event has no one set of objects."""
    return bool(log.single and arc.each and arc.all and arc.kind in ("AS", "EF", "EP") and all(isinstance(x, str) for x in (*arc.each, *arc.any, *arc.all)))


def _sets(log: Log, activity: str, types: list[str], side: str) -> DataFrame:
    """An activity's events (side, {side}_time) with the ids of their objects of each type as a set ``{side}:{type}``."""
    when = F.col("ev_type") == activity
    at = [F.col("ev_id").alias(side), F.col("ev_time").alias(f"{side}_time")]
    if log.values:
        df = log.values.objects
        known = df.schema["of"].dataType.names
        return df.filter(when).select(*at, *[(F.col("of").getField(t) if t in known else F.array().cast("array<string>")).alias(f"{side}:{t}") for t in types])
    return log.e2o.filter(when & F.col("ob_type").isin(types)).groupBy(*at).agg(*[F.collect_set(F.when(F.col("ob_type") == t, F.col("ob_id"))).alias(f"{side}:{t}") for t in types])


def _sharing(log: Log, arc: Arc, bare: bool) -> tuple[DataFrame, Callable[[str], DataFrame], list[str]]:
    """Source rows (keys, s_time, sets), their join with matching targets, and the keys, for arcs with ``each`` and ``all`` types.

    A source goes to its targets by the bound objects and its smallest object of the first ``all`` type, so that
    a pair meets once; the sets say whether the target has the others.  ``bare`` tells whether there may be
    sources without an object of that type, which meet by the bound objects alone.
    """
    types = list(dict.fromkeys([*arc.each, *arc.any, *arc.all]))
    keys, label = [f"each{i}" for i in range(len(arc.each))], arc.all[0]
    s, t = (lambda x: F.col(f"`s:{x}`")), (lambda x: F.col(f"`t:{x}`"))
    rows, targets = _sets(log, arc.source, types, "s"), _sets(log, arc.target, types, "t")
    for key, x in zip(keys, arc.each, strict=True):
        rows, targets = rows.withColumn(key, F.explode(s(x))), targets.withColumn(key, F.explode(t(x)))
    # only sets that a test looks at are dealt, and the object by which the two meet is left out of them
    used = list(dict.fromkeys([*arc.any, *arc.all]))
    keep = lambda df, side: df.select(side, f"{side}_time", *keys, *[f"`{side}:{x}`" for x in used])
    rows, targets = keep(rows, "s"), keep(targets, "t")
    p = F.expr(LATER[arc.kind])
    for x in dict.fromkeys(arc.all):
        p = p & (F.size(F.array_except(s(x), t(x))) == 0)
    for x in dict.fromkeys(arc.any):
        p = p & F.arrays_overlap(s(x), t(x))

    def joined(how: str) -> DataFrame:
        one, many = rows.filter(F.size(s(label)) > 0).withColumn("ob", F.array_min(s(label))), targets.withColumn("ob", F.explode(t(label)))
        if label not in arc.any:
            one, many = one.withColumn(f"s:{label}", F.array_remove(s(label), F.col("ob"))), many.withColumn(f"t:{label}", F.array_remove(t(label), F.col("ob")))
        out = _meet(one, many, [*keys, "ob"], p, how)
        return out.unionByName(_meet(rows.filter(F.size(s(label)) == 0), targets, keys, p, how), allowMissingColumns=True) if bare else out

    return rows, joined, ["s", *keys]


def _meet(left: DataFrame, right: DataFrame, on: list[str], p: Column, how: str) -> DataFrame:
    """Rows with equal ``on`` that pass a test of both sides' other columns."""
    right = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[f"`{c}`" for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, same & p, how)


def _shared_violation(log: Log, arc: Arc) -> DataFrame:
    """(rows, violated) of an arc of ``_sharing``: sources without a target are not dealt once more to be counted."""
    rows, _, keys = _sharing(log, arc, False)
    # a look at the sources: their number, and whether some meet by the bound objects alone
    total, bare = rows.agg(F.count(F.lit(1)), F.count(F.when(F.size(F.col(f"`s:{arc.all[0]}`")) == 0, 1))).first()
    _, joined, _ = _sharing(log, arc, bool(bare))
    if (arc.low or 0) <= 1 and arc.high is None:
        met = joined("left_semi").select(F.lit(1).alias("n"))
    else:
        met = joined("inner").groupBy(*keys, "ob").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0 if (arc.low or 0) <= 0 else 1).cast("long")
    out = met.agg(F.count(F.lit(1)).alias("k"), F.count(F.when(~_in_bounds(F.col("n"), arc), 1)).alias("bad"))
    return out.select(F.lit(total).cast("long").alias("rows"), (F.col("bad") + (F.lit(total) - F.col("k")) * none).alias("violated"))


def _paired(log: Log, arc: Arc) -> tuple[DataFrame, DataFrame | None, DataFrame, list[str]]:
    """Matching (keys, s_time, t, t_time), rows that no label restricts, all source rows, and their keys."""
    if _by_sets(log, arc):
        rows, met, keys = _sharing(log, arc, True)
        return met("inner").select(*keys, "s_time", "t", "t_time"), None, rows.select(*keys, "s_time"), keys
    rows, keys = log.event.filter(F.col("ev_type") == arc.source).select(F.col("ev_id").alias("s"), F.col("ev_time").alias("s_time")), ["s"]
    times = log.event.filter(F.col("ev_type") == arc.target).select(F.col("ev_id").alias("t"), F.col("ev_time").alias("t_time"))
    pairs, free, alls = None, None, list(arc.all)
    for i, label in enumerate(arc.each):
        rows = rows.join(_of(log, arc.source, label, ("s", f"each{i}"), True), "s")
        keys.append(f"each{i}")
    sources = lambda label: _of(log, arc.source, label, ("s", "ob"), True)
    targets = lambda label: _of(log, arc.target, label, ("t", "ob"), False)
    sizes = lambda label: sources(label).groupBy("s").agg(F.count(F.lit(1)).alias("of"))
    later = LATER[arc.kind]
    if arc.each:
        link = times
        for i, label in enumerate(arc.each):
            link = link.join(_of(log, arc.target, label, ("t", f"each{i}"), False), "t")
        if alls:
            # sources and targets meet where they share the bound objects and one of the label's, not by either alone
            label = alls.pop(0)
            size = sizes(label)
            bare = rows.join(size, "s", "left_anti").join(link, keys[1:]).filter(later)
            met = rows.join(sources(label), "s").join(size, "s").join(link.join(targets(label), "t"), [*keys[1:], "ob"]).filter(later)
            met = met.groupBy(*keys, "s_time", "t", "t_time", "of").agg(F.count(F.lit(1)).alias("k")).filter("k = of")
            pairs = met.select(*keys, "s_time", "t", "t_time").unionByName(bare.select(*keys, "s_time", "t", "t_time"))
        else:
            pairs = rows.join(link, keys[1:]).filter(later)
    shared = lambda label: sources(label).join(targets(label), "ob").groupBy("s", "t").agg(F.count(F.lit(1)).alias("k"))
    for label in arc.any:
        some = shared(label).select("s", "t") if pairs is None else _common(pairs, sources(label), targets(label)).select("s", "t")
        pairs = rows.join(some, "s").join(times, "t").filter(later) if pairs is None else pairs.join(some, ["s", "t"], "left_semi")
    if pairs is None:
        free = rows
    for label in alls:
        size = sizes(label)
        every = (shared(label) if pairs is None else _common(pairs, sources(label), targets(label))).join(size, "s").filter("k = of").select("s", "t")
        kept = None if pairs is None else pairs.join(every, ["s", "t"], "left_semi").unionByName(pairs.join(size, "s", "left_anti"))
        if free is not None:
            every = every if pairs is None else shared(label).join(size, "s").filter("k = of").select("s", "t")
            fresh = free.join(every, "s").join(times, "t").filter(later).select(*keys, "s_time", "t", "t_time")
            kept, free = fresh if kept is None else kept.unionByName(fresh), free.join(size, "s", "left_anti")
        pairs = kept
    if arc.kind in ("DF", "DP"):
        near = _trace(log, arc.each[0]).select(F.col("ob_id").alias("each0"), F.col("ev_id").alias("s"), _neighbour(arc.kind, "ev_id").alias("t"))
        pairs = pairs.join(near, ["each0", "s", "t"], "left_semi")
    return pairs, free, rows, keys


def _common(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, t, k): of pairs that are found, how many objects both have; others have no row."""
    return pairs.select("s", "t").distinct().join(sources, "s").join(targets, ["t", "ob"]).groupBy("s", "t").agg(F.count(F.lit(1)).alias("k"))


SLOTS = 4096


def _among_all(log: Log, arc: Arc, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``s_time``) with ``n`` and ``first`` over all events of the target type.

    Times are dealt to slots; windows count within a slot, and sums over the slots (a bounded number) do the rest.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    targets = log.event.filter(F.col("ev_type") == arc.target).select(micros("ev_time").alias("us"))
    low, high = targets.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return rows.withColumns({"n": F.lit(0).cast("long"), "first": F.lit(None).cast("timestamp_ntz")})
    width = (high - low) // SLOTS + 1
    slot = F.least(F.greatest(F.floor((F.col("us") - low) / width), F.lit(-1)), F.lit(SLOTS)).cast("int")
    both = rows.select(micros("s_time").alias("us"), F.struct(*rows.columns).alias("row")).unionByName(targets, allowMissingColumns=True).withColumn("slot", slot)
    at = F.when(F.col("row").isNull(), F.col("us"))
    within = _window(arc.kind, W.partitionBy("slot"))
    inner = both.withColumns({"k": F.count(at).over(within), "near": F.min(at).over(within)}).filter("row is not null")
    later = arc.kind in ("EF", "DF")
    sums = targets.withColumn("slot", slot).groupBy("slot").agg(F.count(F.lit(1)).alias("m"), F.min("us").alias("t")).unionByName(inner.select("slot", F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("t")).distinct()).groupBy("slot").agg(F.sum("m").alias("m"), F.min("t").alias("t"))
    across = W.partitionBy(F.lit(0)).orderBy(F.desc("slot") if later else "slot").rowsBetween(W.unboundedPreceding, -1)  # a row per slot
    sums = sums.select("slot", *([F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("t")] if arc.kind == "AS" else [F.coalesce(F.sum("m").over(across), F.lit(0)).alias("m"), F.min("t").over(across).alias("t")]))
    if arc.kind == "AS":
        total = targets.agg(F.count(F.lit(1)).alias("n"), F.timestamp_micros(F.min("us")).cast("timestamp_ntz").alias("first"))
        return rows.crossJoin(F.broadcast(total))  # one row
    return inner.join(F.broadcast(sums), "slot").select("row.*", (F.col("k") + F.col("m")).alias("n"), F.timestamp_micros(F.least("near", "t")).cast("timestamp_ntz").alias("first"))


def _in_bounds(n: Column, arc: Arc) -> Column:
    p = n >= (arc.low or 0)
    return p & (n <= arc.high) if arc.high is not None else p


def _some_shared(log: Log, arc: Arc) -> DataFrame:
    """(s, n): whether a source has a target with one of its objects, from each object's first and last target."""
    rows = log.event.filter(F.col("ev_type") == arc.source).select(F.col("ev_id").alias("s"), F.col("ev_time").alias("s_time"))
    label, = arc.any
    ends = _objects(log, label, False).filter(F.col("ev_type") == arc.target).groupBy("ob_id").agg(F.min("ev_time").alias("a"), F.max("ev_time").alias("b"))
    of = _objects(log, label, True).filter(F.col("ev_type") == arc.source).join(ends, "ob_id").groupBy(F.col("ev_id").alias("s")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    some = {"EF": F.col("b") > F.col("s_time"), "EP": F.col("a") < F.col("s_time"), "AS": F.col("a").isNotNull()}[arc.kind]
    return rows.join(of, "s", "left").select("s", F.coalesce(some, F.lit(False)).cast("long").alias("n"))


def violation(log: Log, arc: Arc) -> DataFrame:
    """One row: rows, violated, share (0 without rows)."""
    exists = len(arc.any) == 1 and not arc.each and not arc.all and (arc.low or 0) <= 1 and arc.high is None and arc.kind in ("AS", "EF", "EP")
    if _by_sets(log, arc):
        out = _shared_violation(log, arc)
    else:
        counted = _some_shared(log, arc) if exists else matched(log, arc)[0]
        out = counted.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~_in_bounds(F.col("n"), arc), 1)).alias("violated"))
    return out.withColumn("share", F.when(F.col("rows") > 0, F.col("violated") / F.col("rows")).otherwise(0.0))


def unlabelled_violation(log: Log, source: str, target: str, kind: str) -> DataFrame:
    """As ``violation`` for an arc without labels that asks for at least one target: only the target's first or last time matters."""
    span = log.event.filter(F.col("ev_type") == target).agg(F.min("ev_time").alias("a"), F.max("ev_time").alias("b"))
    some = {"EF": F.col("b") > F.col("ev_time"), "EP": F.col("a") < F.col("ev_time"), "AS": F.col("a").isNotNull()}[kind]
    df = log.event.filter(F.col("ev_type") == source).crossJoin(F.broadcast(span))  # one row
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.coalesce(some, F.lit(False)), 1)).alias("violated"))
    return out.withColumn("share", F.when(F.col("rows") > 0, F.col("violated") / F.col("rows")).otherwise(0.0))


def conformance(log: Log, arc: Arc) -> DataFrame:
    return violation(log, arc).select((1 - F.col("share")).alias("conformance"))


def activity_statistics(log: Log, activity: str) -> DataFrame:
    """(what, ob_type, k, n): events of the activity per object (zeros included, types that occur with it) and objects per event.

    The activities ``<init> T`` and ``<exit> T`` stand for the first and last event of each object of type T.
    """
    for name in (INIT, EXIT):
        if activity.startswith(f"{name} "):
            ob_type = activity.removeprefix(f"{name} ")
            n = log.e2o.filter(F.col("ob_type") == ob_type).agg(F.count_distinct("ob_id").alias("n"))
            what = F.explode(F.array(F.lit("events per object"), F.lit("objects per event")))
            return n.filter("n > 0").select(what.alias("what"), F.lit(ob_type).alias("ob_type"), F.lit(1).cast("long").alias("k"), "n")
    of = log.e2o.filter(F.col("ev_type") == activity)
    per_object = of.groupBy("ob_type", "ob_id").agg(F.count(F.lit(1)).alias("k"))
    here = per_object.select("ob_type").distinct()
    objects = log.object.join(F.broadcast(here), "ob_type", "left_semi")  # types
    events = objects.join(per_object, ["ob_type", "ob_id"], "left").select("ob_type", F.coalesce("k", F.lit(0)).alias("k")).groupBy("ob_type", "k").agg(F.count(F.lit(1)).alias("n"))
    per_event = of.groupBy("ob_type", "ev_id").agg(F.count(F.lit(1)).alias("k")).groupBy("ob_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return events.select(F.lit("events per object").alias("what"), "ob_type", "k", "n").unionByName(per_event.select(F.lit("objects per event").alias("what"), "ob_type", "k", "n"))


def edge_durations(log: Log, arc: Arc) -> DataFrame:
    """(binding keys, ms): milliseconds from each source row to its earliest matching target."""
    rows, keys = matched(log, arc)
    ms = F.floor((F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("s_time").cast("timestamp"))) / 1000)
    return rows.filter("first is not null").select(*keys, ms.cast("long").alias("ms"))


#: Round numbers for the width of a bin, each up to a bound of the rough width's leading digits.
ROUND = ((1.5, 1), (3, 2), (7, 5), (10, 10))


def binned(durations: DataFrame, column: str = "ms") -> DataFrame:
    """(low, high, n, percentage) of about ``TARGET_BINS`` bins of a round width, empty ones left out; equal values are one bin of no width."""
    span = durations.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"), F.count(column).alias("total"))
    rough = (F.col("b") - F.col("a")) / TARGET_BINS
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    lead = F.coalesce(*[F.when(rough / power < bound, m) for bound, m in ROUND], F.lit(ROUND[-1][1]))
    span = span.withColumn("width", F.when(F.col("b") > F.col("a"), power * lead))
    start = F.coalesce(F.floor(F.col("a") / F.col("width")) * F.col("width"), F.col("a"))
    last = F.ceil(F.col("b") / F.col("width")) - F.floor(F.col("a") / F.col("width")) - 1
    span = span.select("total", "width", start.alias("start"), last.alias("last"))
    values = durations.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(span))  # one row
    nth = F.coalesce(F.least(F.floor((F.col(column) - F.col("start")) / F.col("width")), F.col("last")), F.lit(0))
    counted = values.groupBy(nth.alias("nth"), "start", "width", "total").agg(F.count(F.lit(1)).alias("n"))
    width = F.coalesce("width", F.lit(0.0))
    return counted.select((F.col("start") + F.col("nth") * width).alias("low"), F.when(F.col("width").isNull(), F.col("start")).otherwise(F.col("start") + (F.col("nth") + 1) * width).alias("high"), "n", (100 * F.col("n") / F.col("total")).alias("percentage"))


def discover_arcs(log: Log, labels: list[Label], noise: float = 0.2, kinds: tuple[str, ...] = ("EF",), names: list[str] | None = None) -> DataFrame:
    """(label, kind, source, target, share): arcs with one ``each`` label whose violation share is at most ``noise``.

    One sorted pass per label and direction gives every pair of activities at once.  ``AS`` asks for another event.
    """
    names = type_names(log) if names is None else names
    out = None
    for label in labels:
        trace = _trace(log, label)
        # every column is of one window in one order, so that a task sorts its rows once
        whole = W.partitionBy("ob_id").orderBy("us", "ev_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        of = lambda t, c: F.when(F.col("is_target") & (F.col("ev_type") == t), c)
        columns = {}
        for kind in kinds:
            if kind in ("DF", "DP"):
                columns[kind] = F.array(_neighbour(kind, "ev_type"))
                continue
            hit = {
                "EF": lambda t: F.max(of(t, F.col("us"))).over(whole) > F.col("us"),
                "EP": lambda t: F.min(of(t, F.col("us"))).over(whole) < F.col("us"),
                "AS": lambda t: F.count(of(t, F.lit(1))).over(whole) > F.coalesce(of(t, F.lit(1)), F.lit(0)),
            }[kind]
            columns[kind] = F.array_compact(F.array(*[F.when(hit(t), F.lit(t)) for t in names]))
        found = trace.withColumns({f"_{k}": c for k, c in columns.items()}).filter("is_source")
        sources = found.groupBy(F.col("ev_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("targets")) for k in kinds]))
        hits = found.select(F.col("ev_type").alias("source"), each.alias("x")).select("source", "x.kind", F.explode("x.targets").alias("target")).groupBy("source", "kind", "target").agg(F.count("target").alias("k"))
        rows = hits.join(F.broadcast(sources), "source").select(F.lit(str(label)).alias("label"), "kind", "source", "target", (1 - F.col("k") / F.col("n")).alias("share")).filter((F.col("share") <= noise) & F.col("target").isNotNull())  # types
        out = rows if out is None else out.unionByName(rows)
    return out


def discover(log: Log, ob_types: list[str], noise: float = 0.2) -> DataFrame:
    """(ob_type, source, target, share): EF arcs with one ``each`` type."""
    return discover_arcs(log, list(ob_types), noise).select(F.col("label").alias("ob_type"), "source", "target", "share")


def refined(log: Log, arc: Arc, noise: float = 0.2, most: int = 20) -> Arc:
    """The arc with the tightest bounds on the number of targets that leave its violation share at most ``noise``.

    ``low`` rises and then ``high`` falls as far as the noise allows; bounds over ``most`` stay open.
    """
    rows, _ = matched(log, Arc(arc.source, arc.target, arc.kind, 0, None, arc.each, arc.any, arc.all))
    counts = {r["n"]: r["k"] for r in rows.groupBy(F.least("n", F.lit(most + 1)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}  # most + 2 rows
    total = sum(counts.values())
    share = lambda low, high: sum(k for n, k in counts.items() if n < low or n > high) / max(total, 1)
    low = max((n for n in range(most + 1) if share(n, most + 1) <= noise), default=0)
    high = min((n for n in range(low, most + 1) if share(low, n) <= noise), default=None)
    return Arc(arc.source, arc.target, arc.kind, low, high, arc.each, arc.any, arc.all)


def reduced(arcs: list[Arc]) -> list[Arc]:
    """Without arcs that two others imply by transitivity (same kind and labels); a small list on the driver."""
    have = set(arcs)
    same = lambda a, b: (a.kind, a.each, a.any, a.all, a.low, a.high) == (b.kind, b.each, b.any, b.all, b.low, b.high)
    middle = lambda a: any(b.source == a.source and b.target not in (a.source, a.target) and same(a, b) and any(c.source == b.target and c.target == a.target and same(a, c) for c in have) for b in have)
    return [a for a in arcs if a.source == a.target or not middle(a)]


def projected(arcs: list[Arc], activities: set[str], reduce: bool = True) -> list[Arc]:
    """Arcs among some activities; paths through removed ones become arcs."""
    found = set(arcs)
    for gone in sorted({x for a in arcs for x in (a.source, a.target)} - activities):
        into, out = [a for a in found if a.target == gone != a.source], [a for a in found if a.source == gone != a.target]
        found |= {Arc(a.source, b.target, a.kind, a.low, a.high, a.each, a.any, a.all) for a in into for b in out if (a.kind, a.each) == (b.kind, b.each)}
        found = {a for a in found if gone not in (a.source, a.target)}
    out = sorted(found, key=str)
    return reduced(out) if reduce else out


def template(arcs: list[Arc]) -> str:
    return "\n".join(str(a) for a in arcs)
