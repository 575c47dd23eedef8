"""Files round trip, extraction policies, declarative arcs and discovery on small data, streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tests.fixtures import small_log
from trailweave.operators import declare, discovery, flows, paths, statistics
from trailweave.operators.declare import Arc
from trailweave.operators.export import binding_table
from trailweave.operators.paths import Hop
from trailweave.plans.evaluate import evaluate
from trailweave.queries.trees import Box, check, ev_attr, o2e, tree
from trailweave.sources import files
from trailweave.sources.extract import Blueprint, Mapping, Rows, ids, template, timestamp
from trailweave.streaming import incremental


@pytest.fixture(scope="module")
def log(spark):
    return small_log(spark).persist()


def content(log):
    frames = log.frames()
    frames["object_attr"] = frames["object_attr"].drop("ordinal")
    return {name: sorted(map(str, (r.asDict(True) for r in df.select(*sorted(df.columns)).collect()))) for name, df in frames.items()}


@pytest.mark.parametrize("format", ["jsonl", "csv", "parquet"])
def test_round_trip(spark, log, tmp_path, format):
    files.WRITERS[format](log, str(tmp_path / "log"))
    assert content(files.read(spark, str(tmp_path / "log"), format)) == content(log)


def test_json(spark, log, tmp_path):
    doc = {
        "eventTypes": [{"name": "place", "attributes": [{"name": "amount", "type": "integer"}]}], "objectTypes": [{"name": "order", "attributes": []}],
        "events": [{"id": "e1", "type": "place", "time": "2024-01-01T01:00:00+01:00", "attributes": [{"name": "amount", "value": 100}], "relationships": [{"objectId": "o1", "qualifier": "order"}]}],
        "objects": [{"id": "o1", "type": "order", "attributes": [], "relationships": []}],
    }
    (tmp_path / "log.json").write_text(json.dumps(doc, indent=1))
    out = files.read(spark, str(tmp_path / "log.json"), "json")
    assert str(out.event.first()["ev_time"]) == "2024-01-01 00:00:00"
    assert out.event_attr.first()["value"]["i"] == 100 and out.e2o.count() == 1


def test_xml_and_xes(spark, tmp_path):
    (tmp_path / "log.xml").write_text("""<log><object-types><object-type name="order"><attributes/></object-type></object-types>
      <event-types><event-type name="place"><attributes><attribute name="amount" type="integer"/></attributes></event-type></event-types>
      <objects><object id="o1" type="order"><attributes><attribute name="s" time="2024-01-01T00:00:00Z">new</attribute></attributes><objects/></object></objects>
      <events><event id="e1" type="place" time="2024-01-02T00:00:00Z"><attributes><attribute name="amount">7</attribute></attributes><objects><relationship object-id="o1" qualifier="order"/></objects></event></events></log>""")
    out = files.read(spark, str(tmp_path / "log.xml"), "xml")
    assert [tuple(r) for r in out.e2o.select("ev_id", "ob_id", "qualifier").collect()] == [("e1", "o1", "order")]
    assert out.event_attr.first()["value"]["i"] == 7 and out.object_attr.first()["value"]["s"] == "new"
    (tmp_path / "log.xes").write_text("""<log><trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T00:00:00Z"/></event>
      <event><string key="concept:name" value="b"/><date key="time:timestamp" value="2024-01-02T00:00:00Z"/></event></trace></log>""")
    assert [(r["case_id"], r["pos"], r["activity"]) for r in files.read_xes(spark, str(tmp_path / "log.xes")).orderBy("pos").collect()] == [("c1", 1, "a"), ("c1", 2, "b")]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "log.sqlite") as db:
        db.executescript("""CREATE TABLE event_map_type(ocel_type, ocel_type_map); INSERT INTO event_map_type VALUES ('place order', 'Place');
          CREATE TABLE object_map_type(ocel_type, ocel_type_map); INSERT INTO object_map_type VALUES ('order', 'Order');
          CREATE TABLE event_Place(ocel_id TEXT, ocel_time TIMESTAMP, amount INTEGER); INSERT INTO event_Place VALUES ('e1', '2024-01-01T00:00:00Z', 5);
          CREATE TABLE object_Order(ocel_id TEXT, ocel_time TIMESTAMP, ocel_changed_field TEXT, state TEXT); INSERT INTO object_Order VALUES ('o1', '1970-01-01T00:00:00Z', NULL, 'new'), ('o1', '2024-01-02T00:00:00Z', 'state', 'sent');
          CREATE TABLE event_object(ocel_event_id, ocel_object_id, ocel_qualifier); INSERT INTO event_object VALUES ('e1', 'o1', 'order');
          CREATE TABLE object_object(ocel_source_id, ocel_target_id, ocel_qualifier);""")
    out = files.read(spark, str(tmp_path / "log.sqlite"), "sqlite")
    assert out.object.count() == 1 and out.object_attr.count() == 2 and out.e2o.count() == 1 and out.event_attr.first()["value"]["i"] == 5
    with pytest.raises(ValueError):
        files.read(spark, "x", "nope")


def test_export(log):
    t = tree(Box(objects={"o1": ["order"]}, events={"e1": ["place"]}, filters=[o2e("o1", "e1")], constraints=[check(ev_attr("e1", "amount", type="Float", min=10))]))
    out = binding_table(evaluate(t, log)[0], log, {"o1": ["state"], "e1": ["amount"]})
    assert out.columns == ["o1", "o1.state", "e1", "e1.amount", "Satisfied"]
    assert sorted(tuple(r) for r in out.collect()) == [("o1", "new", "e1", "100", True), ("o2", None, "e2", "5", False)]


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.createDataFrame([("1", "a;b", "2024-01-01", 10), ("2", " a ; c", "2024-01-02", None), ("2", "", "bad", 3)], "id string, things string, day string, n int"), "u": spark.createDataFrame([("1", "x")], "id string, name string")}


def test_extraction_policies(spark, tables):
    maps = [Mapping(Rows("t"), "event", "made", "id", time="day", attributes={"n": ("n", "integer")}), Mapping(Rows("u"), "object", "thing", "'a'"), Mapping(Rows("t"), "e2o", ">thing", source="id", target="things", split=";", qualifier="'q'")]
    dropped = Blueprint(maps).run(tables)
    assert sorted((r["ev_id"], r["ob_id"]) for r in dropped.e2o.collect()) == [("1", "a"), ("2", "a")] and dropped.event.count() == 2
    assert {r["ob_id"] for r in Blueprint(maps, missing="create").run(tables).object.collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        Blueprint(maps, missing="error").run(tables)
    twice = [Mapping(Rows("t"), "object", "thing", "id", order="n"), Mapping(Rows("u"), "object", "other", "id")]
    assert {r["ob_id"]: r["ob_type"] for r in Blueprint(twice).run(tables).object.collect()} == {"1": "thing", "2": "thing"}
    with pytest.raises(ValueError):
        Blueprint(twice, duplicates="error").run(tables)
    assert Blueprint([Mapping(Rows("t"), "object", "thing", "nothing")]).problems(tables) and not Blueprint(maps).problems(tables)


def test_extraction_parts(spark, tables):
    both = Rows(of=(Rows("t"), Rows("u")), on=(("id", "id"),)).frame(tables)
    assert both.count() == 1 and "name" in both.columns
    assert Rows(of=(Rows("t"), Rows("u"))).frame(tables).count() == 4 and Rows("t", where="n > 5").frame(tables).count() == 1
    row = spark.range(1).select(template("x-{id}-y").alias("a"), ids("' a ;; b '", ";").alias("b"), timestamp("86400", "unix seconds").alias("c"), timestamp("'02.01.1970'", "dd.MM.yyyy").alias("d")).first()
    assert (row["a"], row["b"], str(row["c"]), str(row["d"])) == ("x-0-y", ["a", "b"], "1970-01-02 00:00:00", "1970-01-02 00:00:00")


def test_bounds_and_mutation(log):
    out = flows.with_bounds(log)
    assert out.event.count() == log.event.count() + 6 and out.e2o.filter("qualifier = 'init'").count() == 3
    assert log.without_events(log.event.filter("ev_type = 'ship'")).e2o.count() == 4
    assert log.without_objects(log.object.filter("ob_type = 'item'")).o2o.count() == 0


def test_neighbourhood_threshold(log):
    near = lambda d, t=100: {r["id"] for r in statistics.neighbourhood(log, "i1", d, t).collect()}
    assert near(0) == {"i1"} and near(1) == {"i1", "o1", "e4"} and near(2) == {"i1", "o1", "e4", "e1", "e3", "e5"} and near(2, 1) == near(1)
    assert statistics.neighbourhood(log, "missing", 2).count() == 0


def test_covering_ranges():
    assert discovery.covering_ranges({1: 10}, 0.9) == [(1, 1)]
    assert discovery.covering_ranges({0: 5, 1: 90, 9: 5}, 0.9) == [(1, 1)] or (1, 1) in discovery.covering_ranges({0: 5, 1: 90, 9: 5}, 0.9)
    for ranges in (discovery.covering_ranges({k: 10 for k in range(8)}, 0.7),):
        assert ranges and all(sum(10 for k in range(8) if a <= k <= b) >= 56 for a, b in ranges)


def test_discovered_trees_hold(log):
    for c in discovery.discover_counts(log, "order", 1.0):
        frame = evaluate(c.tree(), log)[0]
        if c.ref != "EventReversed":
            assert frame.filter("violated is not null").count() == 0, c.name
    assert evaluate(discovery.follows_tree("order", "place", "cancel", 0.0, None), log)[0].filter("violated is not null").count() == 1


def test_arcs(log):
    def share(arc):
        r = declare.violation(log, arc).first()
        return r["rows"], r["violated"]

    assert share(Arc("place", "ship", each=("order",))) == (2, 1)
    assert share(Arc("place", "ship", low=2, high=2, each=("order",))) == (2, 1)
    assert share(Arc("ship", "place", "EP", each=("order",))) == (2, 0)
    assert share(Arc("pay", "ship", "DF", each=("order",))) == (1, 0) and share(Arc("place", "ship", "DF", each=("order",))) == (2, 2)
    assert share(Arc("ship", "ship", any=("order",))) == (2, 1)
    # a source without items asks for nothing of them
    assert share(Arc("place", "cancel", all=("item",))) == (2, 0)
    assert declare.unlabelled_violation(log, "place", "cancel", "EF").first()["share"] == 0
    a, b, c = Arc("x", "y", each=("o",)), Arc("y", "z", each=("o",)), Arc("x", "z", each=("o",))
    assert declare.reduced([a, b, c]) == [a, b] and declare.projected([a, b], {"x", "z"}) == [c] and "EF(x, y, Each(o), 1, ∞)" in declare.template([a])


def test_bins(spark):
    df = spark.createDataFrame([(i * 1000,) for i in range(101)], "ms long")
    rows = declare.binned(df).orderBy("low").collect()
    assert sum(r["n"] for r in rows) == 101 and abs(sum(r["percentage"] for r in rows) - 100) < 1e-9 and {r["high"] - r["low"] for r in rows} == {5000.0}
    assert declare.binned(df.limit(1)).first()["percentage"] == 100.0 and declare.binned(df.limit(0)).count() == 0


def test_schemas(log):
    graph = [tuple(r) for r in paths.type_graph(log).collect()]
    found = paths.enumerate_schemas(graph, "place", "item", 3)
    assert [[h.target for h in p] for p in found] == [["order", "item"], ["order", "ship", "item"]]
    direct = paths.connections(log, found[0])
    assert [(r["source"], r["target"], r["n"]) for r in direct.collect()] == [("e1", "i1", 1)]
    assert paths.same_connections(direct, paths.connections(log, found[1]))
    assert paths.connections(log, (Hop("ship", "order", "order", "e2o", False), Hop("order", "place", "order", "e2o", True)), "Forward").count() == 0
    assert evaluate(paths.to_tree(found[0], {"place", "ship", "pay", "cancel"}), log)[0].count() == 1


def test_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    events = incremental.event_stream(spark, source)
    query = incremental.activity_counts(events, "1 day").writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = spark.read.parquet(f"{source}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    found = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    want = {(r["window"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    assert found and all(want[k] == n for k, n in found.items())
    assert incremental.sessions(events).isStreaming and incremental.followed(events, "click", "purchase", 3600).isStreaming
