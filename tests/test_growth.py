"""Plans that keep shuffles and a task's memory in proportion to the input, and their rows on odd tables."""

import random
import re
import shutil
from dataclasses import replace
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from trailweave.functions.cel import Cel
from trailweave.log import Log, related, related_objects
from trailweave.operators import declare, flows, pairs, statistics
from trailweave.operators.declare import Arc
from trailweave.operators.pairs import paired
from trailweave.operators.temporal import range_join
from trailweave.plans.evaluate import evaluate
from trailweave.plans.tree import Box, Tree
from trailweave.queries import QUERIES
from trailweave.sources import tables

from .fixtures import small_log

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def line(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def folder(tmp_path, **frames):
    out = tmp_path / "tables"
    shutil.copytree(SF, out, dirs_exist_ok=True)
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / "new" / name))
        (out / f"{name}.parquet").unlink()
        shutil.copytree(tmp_path / "new" / name, out / f"{name}.parquet")
    return str(out)


def test_shipments_without_repeated_keys_are_not_shuffled(spark):
    log = tables.load(spark, "/root/testdata/sf0.1")
    assert log.single
    for df in (log.event, log.e2o, log.event_attr):
        assert "Window" not in plan(df)
    assert "Aggregate" not in plan(flows.events_of(log))


def test_shipments_with_repeated_keys(spark, line, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tables, "FEW", few)
    more = line.filter("l_orderkey % 7 = 0")
    place = folder(tmp_path, lineitem=line.unionByName(more.withColumn("l_quantity", F.col("l_quantity") - 1)).unionByName(more.limit(3)))
    got = tables.shipments(spark, place)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    order = tables.W.partitionBy(*keys).orderBy(*[c for c in line.columns if c not in keys])
    want = spark.read.parquet(f"{place}/lineitem.parquet").withColumn("rn", F.row_number().over(order)).withColumn("ev_id", tables._id("sh", *keys, "rn"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.filter("rn > 1").count() > 3


def test_tables_with_repeated_or_missing_ids_are_not_single(spark, line, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert not tables.load(spark, folder(tmp_path / "a", orders=orders.unionByName(orders.limit(1)))).single
    assert not tables.load(spark, folder(tmp_path / "b", lineitem=line.withColumn("l_partkey", F.when(F.col("l_orderkey") != 1, F.col("l_partkey"))))).single
    log = tables.load(spark, str(tmp_path / "a" / "tables"))
    assert flows.events_of(log, "order").count() == flows.events_of(log, "order").distinct().count()


def test_few_nodes_go_to_the_relations(spark, monkeypatch):
    log = small_log(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, kind in ((10, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(statistics, "FRONTIER", few, raising=False)
            seen, passed = statistics._reached(log, "i1", 2, 100)
            assert all(kind in h._jdf.queryExecution().withCachedData().toString() for h in passed[:1])
            assert {r["id"] for r in seen.collect()} >= {"i1", "o1", "e4"}
            spark.catalog.clearCache()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def by_nested_loops(log, arc):
    """Source rows without a later target that has the bound object and all parts of the source."""
    of = {}
    for r in log.e2o.collect():
        of.setdefault(r["ev_id"], {}).setdefault(r["ob_type"], set()).add(r["ob_id"])
    times = {r["ev_id"]: r["ev_time"] for r in log.event.collect() if r["ev_type"] == "ship"}
    rows = [(s, o) for s in times for o in of[s]["order"]]
    hit = lambda s, o, t: o in of[t]["order"] and times[t] > times[s] and of[s].get("part", set()) <= of[t].get("part", set())
    return len(rows), sum(not any(hit(s, o, t) for t in times) for s, o in rows)


def test_all_label_meets_by_both_objects(spark):
    rng, base = random.Random(3), small_log(spark)
    event = spark.createDataFrame([(f"e{i}", "ship", D(2024, 1, 1 + rng.randrange(9))) for i in range(60)], base.event.schema)
    obj = spark.createDataFrame([(f"o{i}", "order") for i in range(6)] + [(f"p{i}", "part") for i in range(4)], base.object.schema)
    pairs = {(f"e{i}", f"o{rng.randrange(6)}") for i in range(60) for _ in range(2)} | {(f"e{i}", f"p{rng.randrange(4)}") for i in range(60) for _ in range(rng.randrange(3))}
    e2o = related(event, obj, spark.createDataFrame([(e, o, "q") for e, o in sorted(pairs)], "ev_id string, ob_id string, qualifier string"))
    log = Log(event, obj, base.event_attr, base.object_attr, e2o, related_objects(obj, spark.createDataFrame([], "src_id string, dst_id string, qualifier string")), base.type_decl)
    arc = Arc("ship", "ship", "EF", 1, None, each=("order",), all=("part",))
    row = declare.violation(log, arc).first()
    assert (row["rows"], row["violated"]) == by_nested_loops(log, arc)
    two = declare.violation(log, Arc("ship", "ship", "EF", 1, None, each=("order",), all=("part", "part"))).first()
    other = declare.violation(log, Arc("ship", "ship", "EF", 1, None, each=("order",), any=("order",), all=("part",))).first()
    assert tuple(two) == tuple(other) == tuple(row)
    assert not re.search(r"Join Inner, \(ob#\d+ = ob#\d+\)", plan(declare.violation(log, arc)))


def test_all_label_meets_once_by_sets(spark):
    """Of tables no event is looked up by its id; rows are those of the general plan."""
    for tables_or_not in (True, False):
        log = tables.load(spark, SF)
        log = log if tables_or_not else replace(log, valued=None)
        for arc in (Arc("ship item", "ship item", "EF", 1, None, each=("order",), all=("part",)), Arc("place order", "ship item", "EF", 2, 5, each=("order",), all=("customer",)), Arc("ship item", "place order", "EP", 1, 1, each=("order",), all=("nation",)))[: 3 if tables_or_not else 1]:
            got = declare.violation(log, arc)
            assert not tables_or_not or not re.search(r"\((s|t|ev_id)#\d+ = ", plan(got))
            assert tuple(got.first()) == tuple(declare.violation(replace(log, single=False), arc).first())
    rng, base = random.Random(4), small_log(spark)
    event = spark.createDataFrame([(f"e{i}", rng.choice(("ship", "pay")), D(2024, 1, 1 + rng.randrange(9))) for i in range(80)], base.event.schema)
    obj = spark.createDataFrame([(f"{t}{i}", n) for t, n, k in (("o", "order", 3), ("p", "part", 4), ("q", "place", 3)) for i in range(k)], base.object.schema)
    pairs_ = {(f"e{i}", f"{t}{rng.randrange(k)}") for i in range(80) for t, k in (("o", 3), ("p", 4), ("q", 3)) for _ in range(rng.randrange(3))}
    log = Log(event, obj, base.event_attr, base.object_attr, related(event, obj, spark.createDataFrame([(e, o, "q") for e, o in sorted(pairs_)], "ev_id string, ob_id string, qualifier string")), related_objects(obj, spark.createDataFrame([], "src_id string, dst_id string, qualifier string")), base.type_decl)
    one = replace(log, single=True)
    kinds = (("EF", 1, None), ("EP", 2, 3), ("AS", 0, 4))
    for i, labels in enumerate(({"each": ("order",), "all": ("part",)}, {"each": ("order",), "all": ("part", "place")}, {"each": ("order", "place"), "all": ("part",)}, {"each": ("order",), "any": ("place",), "all": ("part",)}, {"each": ("order",), "any": ("part",), "all": ("part",)}, {"each": ("order",), "all": ("order",)})):
        for kind, low, high in (kinds[i % 3], kinds[(i + 1) % 3]):
            arc = Arc("ship", "pay", kind, low, high, **labels)
            assert tuple(declare.violation(one, arc).first()) == tuple(declare.violation(log, arc).first())
    columns = ["s", "each0", "s_time", "n", "first"]
    assert sorted(map(str, declare.matched(one, arc)[0].select(*columns).collect())) == sorted(map(str, declare.matched(log, arc)[0].select(*columns).collect()))


def test_discovery_sorts_once(spark):
    found = declare.discover_arcs(small_log(spark), ["order"], 0.9, ("AS", "EF", "EP", "DF", "DP"))
    text = physical(found)
    assert text.count("Window [") and len({x.split("Window [")[1].rsplit("], [", 2)[-1] for x in text.splitlines() if "Window [" in x}) == 1


def test_restriction_broadcasts_no_ids(spark):
    log = small_log(spark)
    cut = log.without_objects(log.object.filter("ob_type = 'item'"))
    assert "BroadcastHashJoin" not in physical(cut.e2o) and "ShuffledHashJoin" in physical(cut.e2o)
    assert cut.e2o.count() == 6 and cut.object.count() == 2


def test_time_range_meets_in_narrow_buckets_spread_over_tasks(spark):
    rng = random.Random(5)
    frame = lambda v, n: spark.createDataFrame([(f"{v}{i}", D(2024, 1, 1, 0, 0, rng.randrange(4), rng.randrange(10) * 100_000)) for i in range(n)] + [(f"{v}none", None), (f"{v}old", D(1969, 12, 31, 23, 59, 59))], f"{v} string, {v}_time timestamp_ntz")
    left, right = frame("a", 60), frame("b", 60)
    a, b = ([tuple(r) for r in df.collect() if r[1]] for df in (left, right))
    for low, high in ((0.0, 1.0), (0.1, 0.3), (-0.7, 0.2), (0.5, 0.5), (0.0, 0.0), (-1e300, float("inf")), (2.0, 1.0)):
        got = sorted((r["a"], r["b"]) for r in range_join(left, right, "a_time", "b_time", low, high).collect())
        assert got == sorted((x, y) for x, s in a for y, t in b if low <= (t - s) / timedelta(microseconds=1) / 1e6 <= high)
    near = range_join(left, right, "a_time", "b_time", 0.0, 1.0)
    met, = (x for x in plan(near).splitlines() if "Join Inner" in x)
    assert "as timestamp" not in met  # times are numbers before they meet, not pair by pair
    assert near.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pairs_of_like_variables_are_formed_last(spark):
    """What hangs on either of two orders of a customer is bound before the orders meet."""
    df = QUERIES["corpus_q7"](spark, SF)
    last = next(x for x in plan(df).splitlines() if "Join" in x)
    assert re.search(r"\(o1#\d+ = o1#\d+\)", last) and "NOT (o2" in last
    small = small_log(spark)
    o2o = related_objects(small.object, spark.createDataFrame([("o1", "i1", "of"), ("o2", "i1", "of")], "src_id string, dst_id string, qualifier string"))
    links = [{"type": "O2O", "object": o, "other_object": "o3"} for o in ("o1", "o2")] + [{"type": "O2E", "object": o, "event": e} for o, e in (("o1", "e1"), ("o2", "e2"))]
    box = Box(objects={"o1": ["order"], "o2": ["order"], "o3": ["item"]}, events={"e1": ["place"], "e2": ["pay", "cancel"]}, filters=[*links, {"type": "TimeBetweenEvents", "from_event": "e1", "to_event": "e2", "min_seconds": 0.0}])
    got = evaluate(Tree([box]), replace(small, o2o=o2o))[0]
    assert sorted((r["o1"], r["o2"], r["o3"], r["e1"], r["e2"]) for r in got.collect()) == [(a, b, "i1", x, y) for a, x in (("o1", "e1"), ("o2", "e2")) for b, y in (("o1", "e3"), ("o2", "e6"))]


VALUED = ("gate_and", "cel_size_constraint", "labelled_bindings", "page_violated", "constraint_any", "constraint_or")


def test_attributes_come_along_with_the_events(spark):
    """No query meets the attributes by a join on the event, and rows are those of such a join."""
    log = tables.load(spark, SF)
    assert log.values and not log.with_events(log.event.limit(0)).values and not replace(log, event_attr=log.event_attr.filter("name = 'k'")).values
    for name in VALUED:
        assert not re.search(r"(e2|ev_id)#\d+ = (e2|ev_id)#\d+", plan(QUERIES[name](spark, SF)))
    test = lambda n, **t: {"type": "EventAttributeValueFilter", "event": "e1", "attribute_name": n, "value_filter": t}
    box = lambda types, **more: Box(events={"e1": types}, objects={"o1": ["order", "customer"]}, filters=[{"type": "O2E", "object": "o1", "event": "e1"}], **more)
    mixed = ["place order", "ship item", "click"]
    boxes = [
        box(mixed, constraints=[{"type": "Filter", "filter": test("k", type="Integer", min=5)}, {"type": "Filter", "filter": test("returnflag", type="String", is_in=["R"])}]),
        box(mixed, labels=[("none", Cel("e1.attr('quantity') == null")), ("q", Cel("e1.attr('quantity') * 2.0")), ("v", Cel("e1.attr('value')"))]),
        box(mixed, attributes=[{"var": "e1", "name": "quantity", "kind": "float"}], labels=[("big", "e1_quantity > 20")]),
    ]
    for b in boxes:
        got, want = (evaluate(Tree([b]), x)[0] for x in (log, replace(log, valued=None)))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_relations_bring_only_the_types_that_they_meet(spark):
    assert "concat(s-" not in plan(QUERIES["descendants_of_filtered_parent"](spark, SF))


def test_children_are_counted_where_they_are(spark):
    text = plan(QUERIES["descendants_of_filtered_parent"](spark, "/root/testdata/sf0.1"))
    assert text.count("Join") == 1 and "Aggregate" not in text
    log = tables.load(spark, SF)
    for bounds in ({"min": 3, "max": 5}, {"min": 1}, {"max": 0}, {"max": 2}):
        named = lambda n: {"type": "NumChilds", "child_name": n, **bounds}
        nodes = [Box(events={"e2": ["ship item"]}, filters=[{"type": "O2E", "object": "o1", "event": "e2"}], children=[2]), Box(objects={"o2": ["part"]}, filters=[{"type": "O2E", "object": "o2", "event": "e2"}])]
        one, two = (evaluate(Tree([Box(objects={"o1": ["order"]}, size_filters=f, children=[1]), *nodes], {(0, 1): "A"}), log) for f in ([named("A")], [named("A"), {"type": "Expr", "sql": "true"}]))
        for i in range(3):
            assert one[i].columns == two[i].columns
            assert sorted(map(str, one[i].collect())) == sorted(map(str, two[i].collect()))


def of_one_place(spark, most):
    """A log whose first place has most of the sellers, the second has two, and the third has one; and the pairs of a place's sellers."""
    base, places = small_log(spark), [(f"s{i}", f"n{2 if i == 0 else 1 if i < 3 else 0}") for i in range(most + 3)]
    obj = spark.createDataFrame([(s, "seller") for s, _ in places] + [(f"n{i}", "place") for i in range(3)], base.object.schema)
    o2o = related_objects(obj, spark.createDataFrame([(s, n, "in") for s, n in places], "src_id string, dst_id string, qualifier string"))
    box = Box(objects={"o1": ["seller"], "o2": ["place"], "o3": ["seller"]}, filters=[{"type": "O2O", "object": o, "other_object": "o2"} for o in ("o1", "o3")] + [{"type": "NotEqual", "var_1": "o1", "var_2": "o3"}])
    return evaluate(Tree([box]), replace(base, object=obj, o2o=o2o))[0], places


def test_pairs_of_one_object_spread_over_tasks(spark):
    df, _ = of_one_place(spark, 2500)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2500 * 2499 + 2 and max(tasks) < 0.8 * sum(tasks)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("few", [0, 10])
def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(pairs, "FEW", few)
    for block in (1, 7, 60):
        monkeypatch.setattr(pairs, "BLOCK", block)
        df, places = of_one_place(spark, 40)
        assert sorted((r["o1"], r["o2"], r["o3"]) for r in df.collect()) == sorted((a, m, b) for a, m in places for b, n in places if m == n and a != b)
    monkeypatch.setattr(pairs, "BLOCK", 2)
    frame = lambda v, n: spark.createDataFrame([(f"{v}{i}", None if i % 5 == 4 else i % 3, i if i % 2 else None) for i in range(n)], f"{v} string, k int, `@x:{v}` int")
    left, right = frame("a", 20), frame("b", 30)
    got, want = paired(left, right, "k"), left.join(right, "k")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_of_one_moment_spread_over_tasks(spark, monkeypatch):
    at = lambda v: spark.createDataFrame([(f"{v}{i}", D(2024, 1, 1)) for i in range(2500)], f"{v} string, {v}_time timestamp_ntz")
    near = range_join(at("a"), at("b"), "a_time", "b_time", 0.0, 1.0)
    tasks = [r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2500 * 2500 and max(tasks) < 0.8 * sum(tasks)
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rng = random.Random(6)
    frame = lambda v, n: spark.createDataFrame([(f"{v}{i}", D(2024, 1, 1, 0, 0, rng.randrange(4), rng.randrange(10) * 100_000)) for i in range(n)] + [(f"{v}none", None), (f"{v}old", D(1969, 12, 31, 23, 59, 59))], f"{v} string, {v}_time timestamp_ntz")
    left, right = frame("a", 40), frame("b", 60)
    a, b = ([tuple(r) for r in df.collect() if r[1]] for df in (left, right))
    for low, high in ((0.0, 1.0), (-0.7, 0.2), (0.5, 0.5)):
        near = range_join(left, right, "a_time", "b_time", low, high)
        assert near.columns == ["a", "a_time", "b", "b_time"]
        assert sorted(tuple(r) for r in near.collect()) == sorted((x, s, y, t) for x, s in a for y, t in b if low <= (t - s) / timedelta(microseconds=1) / 1e6 <= high)
