"""Constraint discovery from distributions that Spark aggregates.

Only histograms whose size is bounded by distinct counts or by step numbers reach
the driver; instances never do.  No sampling: every instance counts.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import Log
from ..plans.tree import Box, Gate, Tree
from .flows import events_of

MOST_STEPS = 1000


def related_counts(log: Log, ob_type: str) -> DataFrame:
    """(id, ref, type, k): related entities of each object of a type.

    ``Object`` (forward) and ``ObjectReversed`` references count zero for objects without;
    ``EventReversed`` references count only objects that have such an event.
    """
    ids = log.object.filter(F.col("ob_type") == ob_type).select(F.col("ob_id").alias("id"))
    parts = [
        log.o2o.filter(F.col("src_type") == ob_type).select(F.col("src_id").alias("id"), F.lit("Object").alias("ref"), F.col("dst_type").alias("type")),
        log.o2o.filter(F.col("dst_type") == ob_type).select(F.col("dst_id").alias("id"), F.lit("ObjectReversed").alias("ref"), F.col("src_type").alias("type")),
        log.e2o.filter(F.col("ob_type") == ob_type).select(F.col("ob_id").alias("id"), F.lit("EventReversed").alias("ref"), F.col("ev_type").alias("type")),
    ]
    some = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id", "ref", "type").agg(F.count(F.lit(1)).alias("k"))
    # zeros are added as one row per (reference, type) with the number of objects that lack it
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    return some.withColumn("w", F.lit(1).cast("long")).unionByName(
        some.filter("ref <> 'EventReversed'").groupBy("ref", "type").agg(F.count(F.lit(1)).alias("with")).crossJoin(total).select(F.lit(None).cast("string").alias("id"), "ref", "type", F.lit(0).cast("long").alias("k"), (F.col("total") - F.col("with")).alias("w")).filter("w > 0")
    )


def count_distribution(log: Log, ob_type: str) -> DataFrame:
    """(ref, type, k, n): how many objects have k related entities."""
    return related_counts(log, ob_type).groupBy("ref", "type", "k").agg(F.sum("w").alias("n"))


@dataclass(frozen=True)
class CountConstraint:
    root_type: str
    ref: str
    related_type: str
    low: int | None
    high: int | None

    @property
    def name(self) -> str:
        if self.low == self.high and self.low is not None:
            span = f"={self.low}"
        elif self.low is None or self.low == 0 and self.high is not None:
            span = f"≤{self.high}"
        else:
            span = f"≥{self.low}" if self.high is None else f"{self.low}-{self.high}"
        return f"{span} '{self.related_type}' per '{self.root_type}'"

    def tree(self) -> Tree:
        if self.ref == "EventReversed":
            child = Box(events={"e1": [self.related_type]}, filters=[{"type": "O2E", "object": "o1", "event": "e1", "qualifier": None}])
        else:
            ends = ("o1", "o2") if self.ref == "Object" else ("o2", "o1")
            child = Box(objects={"o2": [self.related_type]}, filters=[{"type": "O2O", "object": ends[0], "other_object": ends[1], "qualifier": None}])
        test = {"type": "NumChilds", "child_name": "A", "min": self.low, "max": self.high}
        return Tree([Box(objects={"o1": [self.root_type]}, constraints=[{"type": "SizeFilter", "filter": test}], children=[1]), child], {(0, 1): "A"})


def covering_ranges(histogram: dict[int, int], coverage: float) -> list[tuple[int, int]]:
    """Ranges that hold the wanted share of the values: around the mean, from zero up, and from far above down; none that contains another.

    A range grows by a hundredth of the deviation (at least 1) at an end that may move; how often
    follows from cumulative counts by bisection.
    """
    keys = sorted(histogram)
    upto = [0, *accumulate(histogram[k] for k in keys)]
    total, mean = upto[-1], sum(k * n for k, n in histogram.items()) / upto[-1]
    step = max(1, round(0.01 * math.sqrt(sum(n * (k - mean) ** 2 for k, n in histogram.items()) / total)))
    inside = lambda r: upto[bisect_right(keys, r[1])] - upto[bisect_left(keys, r[0])]
    middle, found = math.floor(mean), []
    for start, down, up in ((middle, step, step), (0, 0, step), (10 + 10 * middle, step, 0)):
        grown = lambda n: (max(0, start - n * down), start + n * up)  # noqa: B023, E731
        n = bisect_left(range(MOST_STEPS), math.ceil(total * coverage - 1e-9), key=lambda n: inside(grown(n)))  # noqa: B023
        if n < MOST_STEPS:
            found.append(grown(n))
    return sorted({a for a in found if not any(b != a and a[0] <= b[0] and b[1] <= a[1] for b in found)})


def count_histograms(log: Log, ob_type: str) -> dict[tuple[str, str], dict[int, int]]:
    """Histogram per (reference, type) with a mean of at most 30: one row per type and distinct count reaches the driver."""
    rows = count_distribution(log, ob_type)
    of_type = W.partitionBy("ref", "type")
    mean = F.sum(F.col("k") * F.col("n")).over(of_type) / F.sum("n").over(of_type)
    out: dict[tuple[str, str], dict[int, int]] = {}
    for r in rows.withColumn("mean", mean).filter("mean > 0 and mean <= 30").collect():
        out.setdefault((r["ref"], r["type"]), {})[r["k"]] = r["n"]
    return out


def discover_counts(log: Log, ob_type: str, *coverages: float) -> list[CountConstraint]:
    out = set()
    for (ref, related), histogram in count_histograms(log, ob_type).items():
        least, most = min(histogram), max(histogram)
        for coverage in coverages:
            for low, high in covering_ranges(histogram, coverage):
                out.add(CountConstraint(ob_type, ref, related, None if 0 < low < least else low, None if high > most else high))
    return sorted(out, key=lambda c: (c.ref, c.related_type, c.low or 0, c.high or 0))


def type_names(log: Log) -> list[str]:
    """Names of event types: a bounded list."""
    return sorted(r[0] for r in log.event.select("ev_type").distinct().collect())


def delays(log: Log, ob_type: str, strict: bool = False, names: list[str] | None = None) -> DataFrame:
    """(ob_id, ev_id, source, target, delay): seconds from each event of an object to the next other event of each type.

    ``delay`` is null if there is none.  Events at the same time follow each other unless ``strict``.  One
    sort per object, latest event first, with frames that only grow: linear in its events.
    """
    df = events_of(log, ob_type).withColumn("us", F.unix_micros(F.col("ev_time").cast("timestamp")))
    base = W.partitionBy("ob_id").orderBy(F.desc("us"))
    later, after, level = base.rangeBetween(W.unboundedPreceding, -1), base.rangeBetween(W.unboundedPreceding, 0), base.rangeBetween(0, 0)
    names = type_names(log) if names is None else names
    for i, t in enumerate(names):
        of = F.when(F.col("ev_type") == t, F.col("us"))
        following = F.min(of).over(later)
        if not strict:
            twin = F.count(of).over(level) > 1
            following = F.when(F.col("ev_type") != t, F.min(of).over(after)).otherwise(F.when(twin, F.col("us")).otherwise(following))
        df = df.withColumn(f"at{i}", following)
    entries = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"at{i}").alias("at")) for i, t in enumerate(names)])
    return df.select("ob_id", "ev_id", F.col("ev_type").alias("source"), "us", F.explode(entries).alias("x")).select(
        "ob_id", "ev_id", "source", F.col("x.target").alias("target"), ((F.col("x.at") - F.col("us")) / 1e6).alias("delay")
    )


def discover_follows(log: Log, ob_type: str, coverage: float) -> DataFrame:
    """(source, target, low, high): activities that follow quickly enough for the wanted share of events.

    ``high`` is the smallest multiple of the delays' deviation that covers the share.  Pairs without
    deviation count only if all delays are zero.
    """
    rows = delays(log, ob_type).withColumn("ms", F.floor(F.col("delay") * 1000) / 1000)
    pairs = rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.count("ms").alias("m"), F.stddev_pop("ms").alias("sigma")).withColumn("need", F.ceil(F.col("n") * coverage - 1e-9)).filter("m > 0 and m >= n * " + repr(coverage))
    step = F.when(F.col("ms") <= 0, 0).otherwise(F.when(F.col("sigma") > 0, F.ceil(F.col("ms") / F.col("sigma") - 1e-12)).otherwise(MOST_STEPS))
    stepped = rows.filter("ms is not null").join(F.broadcast(pairs), ["source", "target"]).groupBy("source", "target", "need", "sigma", F.least(step, F.lit(MOST_STEPS)).alias("step")).agg(F.count(F.lit(1)).alias("k"))  # pairs of types
    running = F.sum("k").over(W.partitionBy("source", "target").orderBy("step"))
    return stepped.withColumn("covered", running).filter((F.col("covered") >= F.col("need")) & (F.col("step") < MOST_STEPS)).groupBy("source", "target", "sigma").agg(F.min("step").alias("step")).select("source", "target", F.lit(0.0).alias("low"), (F.col("step") * F.col("sigma")).alias("high"))


def follows_tree(ob_type: str, source: str, target: str, low: float | None, high: float | None) -> Tree:
    link = lambda e: {"type": "O2E", "object": "o1", "event": e, "qualifier": None}
    gap = {"type": "TimeBetweenEvents", "from_event": "e1", "to_event": "e2", "min_seconds": low, "max_seconds": high}
    test = {"type": "SizeFilter", "filter": {"type": "NumChilds", "child_name": "A", "min": 1, "max": None}}
    return Tree([Box(objects={"o1": [ob_type]}, events={"e1": [source]}, filters=[link("e1")], constraints=[test], children=[1]), Box(events={"e2": [target]}, filters=[link("e2"), gap, {"type": "NotEqual", "var_1": "e1", "var_2": "e2"}])], {(0, 1): "A"})


def either(first: Tree, second: Tree, objects: dict[str, list[str]]) -> Tree:
    """A tree over the objects whose OR gate holds the two trees below it."""
    nodes, edges = [Box(objects=objects, constraints=[{"type": "SAT", "child_names": ["U"]}], children=[1]), Gate("OR", [2, 2 + len(first.nodes)])], {(0, 1): "U", (1, 2): "A", (1, 2 + len(first.nodes)): "B"}
    for part in (first, second):
        at = len(nodes)
        for i, n in enumerate(part.nodes):
            box = part.box(i)
            own = {k: v for k, v in box.objects.items() if i or k not in objects}
            nodes.append(Box(box.events, own, box.filters, box.size_filters, box.constraints, box.labels, box.attributes, {}, [c + at for c in n.children]))
        edges |= {(p + at, c + at): name for (p, c), name in part.edges.items()}
    return Tree(nodes, edges)


def discover_either(log: Log, ob_type: str, coverage: float, lift: float = 1.1) -> list[tuple[str, Tree]]:
    """Pairs of count constraints on different types of which an object satisfies at least one.

    Candidates are the count constraints at 0.11, 0.7 and 1 times the coverage.  A pair counts
    if the share that satisfies either reaches the coverage and exceeds what
    independence predicts by ``lift``.  All pairs are measured in one pass.
    """
    candidates = discover_counts(log, ob_type, 0.11 * coverage, 0.7 * coverage, coverage)
    if len(candidates) < 2:
        return []
    ids = log.object.filter(F.col("ob_type") == ob_type).select(F.col("ob_id").alias("id"))
    keys = sorted({(c.ref, c.related_type) for c in candidates})
    counts = related_counts(log, ob_type).filter("id is not null").groupBy("id").agg(*[F.sum(F.when((F.col("ref") == r) & (F.col("type") == t), F.col("k"))).alias(f"k{i}") for i, (r, t) in enumerate(keys)])
    wide = ids.join(counts, "id", "left")
    value = lambda c: F.coalesce(F.col(f"k{keys.index((c.ref, c.related_type))}"), F.lit(0))
    holds = [(value(c) >= (c.low or 0)) & ((value(c) <= c.high) if c.high is not None else F.lit(True)) for c in candidates]
    # objects with the same outcomes count together; pairs are formed of these patterns only
    patterns = wide.select(F.array(*[F.coalesce(h, F.lit(False)) for h in holds]).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    total = ids.count()
    pairs = [(i, j) for i in range(len(candidates)) for j in range(i + 1) if i == j or candidates[i].related_type != candidates[j].related_type]
    listed = log.spark.createDataFrame(pairs, "i int, j int").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))  # one row
    either_ = patterns.crossJoin(F.broadcast(listed)).select("s", "n", F.explode("pairs").alias("p")).filter(F.get("s", F.col("p.i")) | F.get("s", F.col("p.j")))
    share = {(r["i"], r["j"]): r["n"] / total for r in either_.groupBy("p.i", "p.j").agg(F.sum("n").alias("n")).collect()}
    out = []
    for i, j in pairs:
        a, b, both = share.get((i, i), 0.0), share.get((j, j), 0.0), share.get((i, j), 0.0)
        if i != j and max(a, b) < coverage <= both and both >= lift * (1 - (1 - a) * (1 - b)):
            out.append((f"{candidates[i].name} OR {candidates[j].name}", either(candidates[i].tree(), candidates[j].tree(), {"o1": [ob_type]})))
    return out


def auto_discover(log: Log, ob_types: list[str], coverage: float = 0.9, counts: bool = True, follows: bool = True, alternatives: bool = True) -> list[tuple[str, Tree]]:
    """Named trees of every kind of constraint for each object type; as many as there are pairs of types."""
    found: list[tuple[str, Tree]] = []
    for t in ob_types:
        if follows:
            for r in discover_follows(log, t, coverage).orderBy("source", "target").collect():  # pairs of types
                found.append((f"'{r['target']}' after '{r['source']}' per '{t}'", follows_tree(t, r["source"], r["target"], r["low"], r["high"])))
        if counts:
            found += [(c.name, c.tree()) for c in discover_counts(log, t, coverage)]
        if alternatives:
            found += discover_either(log, t, coverage)
    return found
