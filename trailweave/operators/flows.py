"""Directly-follows, variants, traces and times, as windows and aggregates over one object's events.

Events of an object are ordered by time, then id.  Where the contract leaves a
definition open, the docstring states ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import Log, seconds_between


def events_of(log: Log, ob_type: str | None = None) -> DataFrame:
    """Distinct (ob_id, ob_type, ev_id, ev_type, ev_time)."""
    df = log.e2o if ob_type is None else log.e2o.filter(F.col("ob_type") == ob_type)
    df = df.select("ob_id", "ob_type", "ev_id", "ev_type", "ev_time")
    return df if log.single else df.distinct()


def _order() -> W:
    return W.partitionBy("ob_id").orderBy("ev_time", "ev_id")


def directly_follows(log: Log, ob_type: str | None = None) -> DataFrame:
    """(ob_type, source, target, n): how often one activity directly follows another for an object."""
    pairs = events_of(log, ob_type).select("ob_type", F.col("ev_type").alias("source"), F.lead("ev_type").over(_order()).alias("target"))
    return pairs.filter(F.col("target").isNotNull()).groupBy("ob_type", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def case_directly_follows(cases: DataFrame) -> DataFrame:
    """(source, target, n) of a case-centric log (case_id, activity, ts, and ``pos`` or ``ev_id`` to break ties)."""
    tie = "pos" if "pos" in cases.columns else "ev_id"
    order = W.partitionBy("case_id").orderBy("ts", tie)
    pairs = cases.select(F.col("activity").alias("source"), F.lead("activity").over(order).alias("target"))
    return pairs.filter("target is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def start_end(log: Log) -> DataFrame:
    """(ob_type, ev_type, starts, ends): objects whose first or last event is of the activity."""
    key = F.struct("ev_time", "ev_id")
    ends = events_of(log).groupBy("ob_type", "ob_id").agg(F.min_by("ev_type", key).alias("first"), F.max_by("ev_type", key).alias("last"))
    both = ends.select("ob_type", F.explode(F.array(F.struct(F.col("first").alias("ev_type"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("last").alias("ev_type"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    return both.groupBy("ob_type", "x.ev_type").agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def traces(log: Log, ob_type: str) -> DataFrame:
    """(ob_id, trace): an object's activities in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ev_time", "ev_id", "ev_type")))
    return events_of(log, ob_type).groupBy("ob_id").agg(F.transform(ordered, lambda x: x["ev_type"]).alias("trace"))


def variants(log: Log, ob_type: str) -> DataFrame:
    """(trace, n): how many objects have each trace."""
    return traces(log, ob_type).groupBy("trace").agg(F.count(F.lit(1)).alias("n"))


def top_variants(log: Log, ob_type: str, top: int) -> DataFrame:
    return variants(log, ob_type).orderBy(F.desc("n"), "trace").limit(top)


def flatten(log: Log, ob_type: str) -> DataFrame:
    """The case-centric event log of an object type: (case_id, pos, activity, ev_id, ts)."""
    return events_of(log, ob_type).select(F.col("ob_id").alias("case_id"), F.row_number().over(_order()).alias("pos"), F.col("ev_type").alias("activity"), "ev_id", F.col("ev_time").alias("ts"))


def predecessors(log: Log, ob_type: str | None = None) -> DataFrame:
    """(ev_id, ob_id, before): time of the event before this one for the object."""
    df = events_of(log, ob_type)
    return df.select("ev_id", "ev_time", "ob_id", F.lag("ev_time").over(_order()).alias("before")).filter("before is not null")


def sojourn(log: Log, top: int | None = None) -> DataFrame:
    """(ev_id, seconds) since the latest predecessor over the event's objects; events without one are absent."""
    df = predecessors(log).groupBy("ev_id", "ev_time").agg(F.max("before").alias("before")).select("ev_id", seconds_between("before", "ev_time").alias("seconds"))
    return df if top is None else df.orderBy(F.desc("seconds"), "ev_id").limit(top)


def synchronisation(log: Log, top: int | None = None, ob_type: str | None = None) -> DataFrame:
    """(ev_id, seconds) between the earliest and the latest predecessor over the event's objects."""
    df = predecessors(log, ob_type).groupBy("ev_id").agg(F.min("before").alias("a"), F.max("before").alias("b")).select("ev_id", seconds_between("a", "b").alias("seconds"))
    return df if top is None else df.orderBy(F.desc("seconds"), "ev_id").limit(top)


def attribute_changes(log: Log, ob_type: str, attr: str) -> DataFrame:
    """(ob_id, nth, ts, value): versions of an attribute in order."""
    ids = log.object.filter(F.col("ob_type") == ob_type).select("ob_id")
    versions = log.object_attr.filter(F.col("name") == attr).join(ids, "ob_id", "left_semi")
    return versions.select("ob_id", F.row_number().over(W.partitionBy("ob_id").orderBy("ts", "ordinal")).alias("nth"), "ts", "value")


def dotted_chart(log: Log, ob_type: str) -> DataFrame:
    """A dot per event of an object: its time, seconds since the case's start, share of its duration, and step."""
    case = W.partitionBy("ob_id")
    df = events_of(log, ob_type).withColumn("start", F.min("ev_time").over(case)).withColumn("end", F.max("ev_time").over(case))
    since, whole = seconds_between("start", "ev_time"), seconds_between("start", "end")
    return df.select("ob_id", "ev_id", "ev_type", F.col("ev_time").alias("time"), since.alias("since_start"), F.when(whole == 0, 0.0).otherwise(since / whole).alias("relative"), F.row_number().over(_order()).alias("step"))


def timestamp_histogram(log: Log, bins: int) -> DataFrame:
    """(bin, ev_type, n) of event times in equal bins."""
    df = log.event.select("ev_type", F.unix_micros(F.col("ev_time").cast("timestamp")).alias("us"))
    span = df.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("us") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin"), "ev_type").agg(F.count(F.lit(1)).alias("n"))  # span is one row


def conversion_rate(log: Log, activity: str, source_type: str, target_type: str) -> DataFrame:
    """Share of the source objects at an activity whose events of it also have a target object.

    One row: sources, converted, rate.
    """
    at = log.e2o.filter(F.col("ev_type") == activity)
    targets = at.filter(F.col("ob_type") == target_type).select("ev_id").distinct().withColumn("hit", F.lit(1))
    per_source = at.filter(F.col("ob_type") == source_type).select("ob_id", "ev_id").join(targets, "ev_id", "left").groupBy("ob_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per_source.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("hit"), F.lit(0)).alias("converted")).withColumn("rate", F.when(F.col("sources") > 0, F.col("converted") / F.col("sources")))


def pair_counts(log: Log) -> DataFrame:
    """(ev_type, ob_type, events, objects) that are related."""
    return log.e2o.groupBy("ev_type", "ob_type").agg(F.count_distinct("ev_id").alias("events"), F.count_distinct("ob_id").alias("objects"))


def with_bounds(log: Log) -> Log:
    """The log with a synthetic ``<init> T`` and ``<exit> T`` event for each object that has events, at its first and last time."""
    out = log
    spans = events_of(log).groupBy("ob_id", "ob_type").agg(F.min("ev_time").alias("a"), F.max("ev_time").alias("b"))
    for word, column in (("init", "a"), ("exit", "b")):
        ev = spans.select(F.concat(F.lit(f"<{word}> "), "ob_id").alias("ev_id"), F.concat(F.lit(f"<{word}> "), "ob_type").alias("ev_type"), F.col(column).alias("ev_time"), "ob_id")
        out = out.with_events(ev.select("ev_id", "ev_type", "ev_time"), ev.select("ev_id", "ob_id", F.lit(word).alias("qualifier")))
    return out
