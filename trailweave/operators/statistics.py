"""Inspection of a log: counts, relation matrices, attribute statistics, lookups, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log, number

BINS, TOP = 20, 20
FRONTIER = 500_000  #: nodes of a step that are sent to every task


def types(log: Log, scope: str) -> DataFrame:
    """Names of all types of a scope: declared ones and ones that occur."""
    name, frame = ("ev_type", log.event) if scope == "event" else ("ob_type", log.object)
    declared = log.type_decl.filter(F.col("scope") == scope).select(F.col("type_name").alias(name))
    return declared.unionByName(frame.select(name)).distinct()


def type_counts(log: Log) -> DataFrame:
    """(scope, type_name, n) for every type, also those without members."""
    out = []
    for scope, name, frame in (("event", "ev_type", log.event), ("object", "ob_type", log.object)):
        n = frame.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        out.append(types(log, scope).join(n, name, "left").select(F.lit(scope).alias("scope"), F.col(name).alias("type_name"), F.coalesce("n", F.lit(0)).alias("n")))
    return out[0].unionByName(out[1])


def _matrix(found: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    # the number of types bounds both sides of this product
    every = left.crossJoin(right)
    return every.join(found, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("qualifiers", F.array().cast("array<string>")).alias("qualifiers"))


def e2o_matrix(log: Log) -> DataFrame:
    """(ev_type, ob_type, n, qualifiers): relations of each pair of types, zero for pairs without."""
    found = log.e2o.groupBy("ev_type", "ob_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("qualifier")).alias("qualifiers"))
    return _matrix(found, types(log, "event"), types(log, "object"), ["ev_type", "ob_type"])


def o2o_matrix(log: Log) -> DataFrame:
    found = log.o2o.groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("qualifier")).alias("qualifiers"))
    t = types(log, "object")
    return _matrix(found, t.withColumnRenamed("ob_type", "src_type"), t.withColumnRenamed("ob_type", "dst_type"), ["src_type", "dst_type"])


def involvements(log: Log) -> DataFrame:
    """(ev_type, ob_type, least, most) objects of a type per event; least is 0 if some event of the type has none."""
    per_event = log.e2o.groupBy("ev_type", "ob_type", "ev_id").agg(F.count_distinct("ob_id").alias("k"))
    per_type = per_event.groupBy("ev_type", "ob_type").agg(F.min("k").alias("low"), F.max("k").alias("most"), F.count(F.lit(1)).alias("events"))
    totals = log.event.groupBy("ev_type").agg(F.count(F.lit(1)).alias("total"))
    return per_type.join(totals, "ev_type").select("ev_type", "ob_type", F.when(F.col("events") < F.col("total"), 0).otherwise(F.col("low")).cast("long").alias("least"), "most")


def attribute_values(log: Log, scope: str, type_name: str, attr: str) -> DataFrame:
    """(id, value) of the attribute; events without it, and objects without any version, have a null value."""
    if scope == "event":
        base, values = log.event.filter(F.col("ev_type") == type_name).select(F.col("ev_id").alias("id")), log.event_attr.select(F.col("ev_id").alias("id"), "name", "value")
    else:
        base, values = log.object.filter(F.col("ob_type") == type_name).select(F.col("ob_id").alias("id")), log.object_attr.select(F.col("ob_id").alias("id"), "name", "value")
    return base.join(values.filter((F.col("name") == attr) & (F.col("value.kind") != "null")).select("id", "value"), "id", "left")


def numeric_stats(log: Log, scope: str, type_name: str, attr: str) -> DataFrame:
    """One row: low, high, mean, n and nulls."""
    v = attribute_values(log, scope, type_name, attr).withColumn("v", number("value"))
    return v.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count("v").alias("n"), F.count_distinct(F.when(F.col("v").isNull(), F.col("id"))).alias("nulls"))


def histogram(values: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n) of equal bins; the largest value is in the last; equal values make one bin of width 1."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    low = F.when(F.col("hi") == F.col("lo"), F.col("lo")).otherwise(F.col("lo") + width * F.col("bin"))
    high = F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("lo") + width * (F.col("bin") + 1))
    counted = values.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # span is one row
    return counted.select("bin", low.alias("low"), high.alias("high"), "n")


def numeric_histogram(log: Log, scope: str, type_name: str, attr: str, bins: int = BINS) -> DataFrame:
    return histogram(attribute_values(log, scope, type_name, attr).select(number("value").alias("v")), "v", bins)


def string_stats(log: Log, scope: str, type_name: str, attr: str, top: int = TOP) -> DataFrame:
    """(value, n) of the most frequent values; ties by value."""
    v = attribute_values(log, scope, type_name, attr).select(F.col("value.s").alias("v")).filter("v is not null")
    return v.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(top)


def boolean_stats(log: Log, scope: str, type_name: str, attr: str) -> DataFrame:
    v = attribute_values(log, scope, type_name, attr).withColumn("v", F.col("value.b"))
    return v.agg(F.count(F.when(F.col("v"), 1)).alias("true"), F.count(F.when(~F.col("v"), 1)).alias("false"), F.count_distinct(F.when(F.col("v").isNull(), F.col("id"))).alias("nulls"))


def time_stats(log: Log, type_name: str) -> DataFrame:
    """One row: first, last and n of a type's event times."""
    return log.event.filter(F.col("ev_type") == type_name).agg(F.min("ev_time").alias("first"), F.max("ev_time").alias("last"), F.count(F.lit(1)).alias("n"))


def time_histogram(log: Log, type_name: str, attr: str | None = None, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n) in milliseconds, of a type's event times or of a time attribute."""
    times = log.event.filter(F.col("ev_type") == type_name).select(F.col("ev_time").alias("t")) if attr is None else attribute_values(log, "event", type_name, attr).select(F.col("value.t").alias("t"))
    return histogram(times.select((F.unix_micros(F.col("t").cast("timestamp")) / 1000).alias("v")), "v", bins)


def sample_ids(log: Log, scope: str, type_name: str, limit: int = 1000) -> DataFrame:
    frame, key, kind = (log.event, "ev_id", "ev_type") if scope == "event" else (log.object, "ob_id", "ob_type")
    return frame.filter(F.col(kind) == type_name).select(F.col(key).alias("id")).orderBy("id").limit(min(limit, 1000))


def get_event(log: Log, ev_id: str) -> DataFrame:
    """The event with its attributes and relations as nested columns; no row if there is none."""
    attrs = log.event_attr.filter(F.col("ev_id") == ev_id).groupBy("ev_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    rels = log.e2o.filter(F.col("ev_id") == ev_id).groupBy("ev_id").agg(F.array_sort(F.collect_list(F.struct("ob_id", "qualifier"))).alias("relations"))
    return log.event.filter(F.col("ev_id") == ev_id).join(attrs, "ev_id", "left").join(rels, "ev_id", "left")


def get_object(log: Log, ob_id: str) -> DataFrame:
    attrs = log.object_attr.filter(F.col("ob_id") == ob_id).groupBy("ob_id").agg(F.array_sort(F.collect_list(F.struct("name", "ts", "ordinal", "value"))).alias("attributes"))
    rels = log.o2o.filter(F.col("src_id") == ob_id).groupBy(F.col("src_id").alias("ob_id")).agg(F.array_sort(F.collect_list(F.struct("dst_id", "qualifier"))).alias("relations"))
    return log.object.filter(F.col("ob_id") == ob_id).join(attrs, "ob_id", "left").join(rels, "ob_id", "left")


def symmetric_relations(log: Log) -> DataFrame:
    """(src, dst, qualifier, reversed): every relation from both ends."""
    e2o = log.e2o.select(F.col("ev_id").alias("src"), F.col("ob_id").alias("dst"), "qualifier")
    o2o = log.o2o.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "qualifier")
    forward = e2o.unionByName(o2o).withColumn("reversed", F.lit(False))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "qualifier", F.lit(True).alias("reversed")))


def _reached(log: Log, root: str, max_distance: int, threshold: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, distance) within a number of relations of the root, and the relations (src, dst, qualifier, reversed) passed in each step."""
    edges = symmetric_relations(log)
    known = log.event.select(F.col("ev_id").alias("id")).unionByName(log.object.select(F.col("ob_id").alias("id")))
    seen = frontier = known.filter(F.col("id") == root).select("id", F.lit(0).alias("distance")).distinct().persist()
    passed = []
    for step in range(1, max_distance + 1):
        # a frontier of few nodes goes to the relations, not the relations to it
        near = frontier.select(F.col("id").alias("src"))
        here = edges.join(F.broadcast(near) if frontier.count() <= FRONTIER else near, "src")
        if step == 1:
            here = here.filter(F.col("src") == root)
        here = here.persist()
        if step > 1:  # degrees of the frontier alone
            degree = here.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
            here = here.join(degree.filter(F.col("degree") < threshold), "src", "left_semi")
        passed.append(here)
        frontier = here.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(step).alias("distance")).persist()
        seen = seen.unionByName(frontier)
    return seen, passed


def neighbourhood(log: Log, root: str, max_distance: int, threshold: int = 1000) -> DataFrame:
    """(id, distance) within a number of relations of the root, breadth first.

    Nodes with ``threshold`` or more neighbours are reached but not passed, except
    the root.  No row if the root is not in the log.  ``max_distance`` bounds the joins; each step is kept.
    """
    return _reached(log, root, max_distance, threshold)[0]


def neighbourhood_arcs(log: Log, root: str, max_distance: int, threshold: int = 1000, spanning_tree: bool = False) -> DataFrame:
    """(src, dst, qualifier, reversed): relations passed from the root outwards, each in the direction it is passed first.

    A relation between two nodes that are both passed is listed once, from the nearer one (or the one of
    smaller id).  A spanning tree has one arc to each node but the root: that of smallest source, qualifier and direction.
    """
    seen, passed = _reached(log, root, max_distance, threshold)
    arcs = None
    for step, here in enumerate(passed, 1):
        mine = here.select("src", "dst", "qualifier", "reversed", F.lit(step).alias("step"))
        arcs = mine if arcs is None else arcs.unionByName(mine)
    if arcs is None:
        return seen.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("qualifier"), F.lit(False).alias("reversed")).limit(0)
    if spanning_tree:
        first = seen.filter("distance > 0").select(F.col("id").alias("dst"), F.col("distance").alias("step"))
        return arcs.join(first, ["dst", "step"]).groupBy("dst").agg(F.min(F.struct("src", "qualifier", "reversed")).alias("a")).select("a.src", "dst", "a.qualifier", "a.reversed")
    ends = [F.when(F.col("reversed"), F.col("dst")).otherwise(F.col("src")), F.when(F.col("reversed"), F.col("src")).otherwise(F.col("dst"))]
    return arcs.groupBy(ends[0].alias("_a"), ends[1].alias("_b"), "qualifier").agg(F.min(F.struct("step", "src", "dst", "reversed")).alias("a")).select("a.src", "a.dst", "qualifier", "a.reversed")
