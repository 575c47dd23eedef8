"""Golden queries over the small log, truth tables, and random trees against a nested-loop oracle."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import small_log
from trailweave.plans.evaluate import evaluate, page, summary
from trailweave.plans.tree import Box, Gate, Tree, from_json
from trailweave.queries.trees import check, ev_attr, expr, gap, num, o2e, o2o, ob_attr, over, size, tree


@pytest.fixture(scope="module")
def log(spark):
    return small_log(spark).persist()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan(log):
    frame = evaluate(tree(Box(objects={"o1": ["order"]})), log)[0]
    assert rows(frame, "o1", "violated") == [("o1", None), ("o2", None)]


def test_related_events(log):
    t = tree(Box(objects={"o1": ["order"]}, events={"e1": ["ship"]}, filters=[o2e("o1", "e1")]))
    assert rows(evaluate(t, log)[0], "o1", "e1") == [("o1", "e4"), ("o1", "e5")]


@pytest.mark.parametrize(("qualifier", "n"), [("order", 0), ("item", 1), (None, 1)])
def test_qualifier(log, qualifier, n):
    t = tree(Box(objects={"o1": ["item"]}, events={"e1": ["ship"]}, filters=[o2e("o1", "e1", qualifier)]))
    assert evaluate(t, log)[0].count() == n


def test_filter_drops_and_constraint_classifies(log):
    big = ev_attr("e1", "amount", type="Float", min=10)
    box = {"objects": {"o1": ["order"]}, "events": {"e1": ["place"]}}
    assert rows(evaluate(tree(Box(**box, filters=[o2e("o1", "e1"), big])), log)[0], "o1", "violated") == [("o1", None)]
    assert {r["o1"]: r["violated"] for r in evaluate(tree(Box(**box, filters=[o2e("o1", "e1")], constraints=[check(big)])), log)[0].collect()} == {"o1": None, "o2": 0}


@pytest.mark.parametrize(("name", "bad"), [("A", {"o2"}), ("unknown", {"o1", "o2"})])
def test_number_of_children(log, name, bad):
    t = tree(Box(objects={"o1": ["order"]}, constraints=[size(num(name, 1))], children=[1]), Box(events={"e1": ["pay"]}, filters=[o2e("o1", "e1")]), _0_1="A")
    frames = evaluate(t, log)
    assert {r["o1"] for r in frames[0].filter("violated = 0").collect()} == bad
    assert rows(frames[1], "o1", "e1") == [("o1", "e3")]
    assert [tuple(r) for r in summary(frames).orderBy("node").collect()] == [(0, 2, len(bad)), (1, 1, 0)]


def test_paging(log):
    t = tree(Box(objects={"o1": ["order"]}, events={"e1": ["place"]}, filters=[o2e("o1", "e1")], constraints=[check(ev_attr("e1", "amount", type="Integer", min=10))]))
    frame = evaluate(t, log)[0]
    assert rows(page(frame, 0, 10, violated=True), "o1", "e1") == [("o2", "e2")]
    assert page(frame, 1, 1).count() == 1 and page(frame, 10, 10).count() == 0
    with pytest.raises(ValueError):
        page(frame, 0, 1001)


# what a child of each content does to each constraint: no bindings, all good, mixed, all bad, unknown
TABLE = {"SAT": (0, 0, 1, 1, 1), "ANY": (1, 0, 0, 1, 1), "NOT": (0, 1, 1, 0, 1), "OR": (0, 0, 1, 1, 0), "AND": (0, 0, 1, 1, 0)}


@pytest.mark.parametrize("kind", TABLE)
def test_truth_table(log, kind):
    children = [("none", "cancel", 9), ("good", "ship", 1), ("mixed", "ship", 5), ("bad", "ship", 9)]
    found = []
    for _, activity, day in children:
        test = ev_attr("e1", "ocel:time", type="Time", **{"from": f"2024-01-0{day}"})
        t = tree(Box(objects={"o1": ["order"]}, filters=[ob_attr("o1", "ocel:id", "Always", type="String", is_in=["o1"])], constraints=[over(kind, "A")], children=[1]), Box(events={"e1": [activity]}, filters=[o2e("o1", "e1")], constraints=[check(test)]), _0_1="A")
        found.append(int(evaluate(t, log)[0].first()["violated"] == 0))
    t = tree(Box(objects={"o1": ["item"]}, constraints=[over(kind, "X")]))
    found.append(int(evaluate(t, log)[0].first()["violated"] == 0))
    assert tuple(found) == TABLE[kind]


@pytest.mark.parametrize(("kind", "violated"), [("SAT", False), ("ANY", False), ("NOT", True), ("OR", True), ("AND", False)])
def test_no_child_names(log, kind, violated):
    t = tree(Box(objects={"o1": ["item"]}, constraints=[over(kind)]))
    assert (evaluate(t, log)[0].first()["violated"] == 0) == violated


def test_versions_at_an_event(log):
    at = lambda word: tree(Box(objects={"o1": ["order"]}, events={"e1": ["ship"]}, filters=[o2e("o1", "e1"), ob_attr("o1", "state", {"type": "AtEvent", "event": "e1"}, type="String", is_in=[word])]))
    assert evaluate(at("late"), log)[0].count() == 2  # equal times: the later version counts
    assert evaluate(at("sent"), log)[0].count() == 0


def test_missing_versions(log):
    count = lambda when: evaluate(tree(Box(objects={"o1": ["order"]}, filters=[ob_attr("o1", "state", when, type="String", is_in=["new", "sent", "late"])])), log)[0].count()
    assert (count("Always"), count("Sometime")) == (2, 1)


def test_shadowed_variable(log):
    t = tree(Box(objects={"o1": ["order"]}, constraints=[size(num("A", 2))], children=[1]), Box(objects={"o1": ["item", "order"]}), _0_1="A")
    frames = evaluate(t, log)
    assert frames[1].count() == 6 and frames[0].filter("violated is null").count() == 2
    t.nodes[0].constraints = [size(num("A", 3, 3))]
    assert evaluate(t, log)[0].filter("violated is null").count() == 2
    t.nodes[0].constraints, t.nodes[0].size_filters = [], [num("A", 3, 3)]
    assert evaluate(t, log)[1].count() == 6


def test_dropped_parents_take_their_descendants(log):
    t = tree(Box(objects={"o1": ["order"]}, size_filters=[num("A", 1)], children=[1]), Box(events={"e1": ["ship", "place"]}, filters=[o2e("o1", "e1")], size_filters=[num("B", 1)], children=[2]), Box(objects={"o2": ["item"]}, filters=[o2e("o2", "e1")]), _0_1="A", _1_2="B")
    frames = evaluate(t, log)
    assert [frames[i].count() for i in range(3)] == [1, 1, 1]


def test_labels_and_child_lists(log):
    t = tree(Box(objects={"o1": ["order"]}, labels=[("n", "size(A)"), ("twice", "2 * n")], size_filters=[expr("n >= 0")], children=[1]), Box(events={"e1": ["ship"]}, filters=[o2e("o1", "e1")]), _0_1="A")
    assert rows(evaluate(t, log)[0], "o1", "n", "twice") == [("o1", 2, 4), ("o2", 0, 0)]


def test_wire_format(log):
    text = """{"nodes":[{"Box":[{"newEventVars":{"0":["place"]},"newObjectVars":{"0":["order"]},"filters":[{"type":"O2E","object":0,"event":0,"qualifier":null}],
      "sizeFilters":[],"constraints":[{"type":"SizeFilter","filter":{"type":"NumChilds","child_name":"A","min":1,"max":null}}]},[1]]},
      {"Box":[{"newEventVars":{"1":["ship"]},"newObjectVars":{},"filters":[{"type":"O2E","object":0,"event":1,"qualifier":null},{"type":"TimeBetweenEvents","from_event":0,"to_event":1,"min_seconds":0,"max_seconds":null}],"sizeFilters":[],"constraints":[]},[]]}],
      "edgeNames":[[[0,1],"A"]]}"""
    assert rows(evaluate(from_json(text), log)[0].filter("violated is not null"), "o1", "e1") == [("o2", "e2")]


@pytest.mark.parametrize("bad", [Tree([Box(children=[1]), Box(children=[0])]), Tree([Box(children=[1, 2]), Box(), Box()], {(0, 1): "A", (0, 2): "A"}), Tree([Box(children=[5])])])
def test_bad_trees(bad):
    with pytest.raises(ValueError):
        bad.validate()


def test_unbound_variable(log):
    with pytest.raises(ValueError):
        evaluate(tree(Box(objects={"o1": ["order"]}, filters=[o2e("o1", "e9")])), log)


class Loops:
    """Nested loops over collected rows: the meaning of a tree, spelled out."""

    def __init__(self, log):
        self.event = {r["ev_id"]: (r["ev_type"], r["ev_time"]) for r in log.event.collect()}
        self.object = {r["ob_id"]: r["ob_type"] for r in log.object.collect()}
        self.e2o = {(r["ev_id"], r["ob_id"]) for r in log.e2o.collect()}
        self.o2o = {(r["src_id"], r["dst_id"]) for r in log.o2o.collect()}

    def passes(self, f, b):
        if f["type"] == "O2E":
            return (b[f["event"]], b[f["object"]]) in self.e2o
        if f["type"] == "O2O":
            return (b[f["object"]], b[f["other_object"]]) in self.o2o
        if f["type"] == "NotEqual":
            return b[f["var_1"]] != b[f["var_2"]]
        s = (self.event[b[f["to_event"]]][1] - self.event[b[f["from_event"]]][1]).total_seconds()
        return (f["min_seconds"] is None or s >= f["min_seconds"]) and (f["max_seconds"] is None or s <= f["max_seconds"])

    def run(self, t, at, parent):
        box, out = t.box(at), []
        domains = [[(v, e) for e in self.event if self.event[e][0] in ts] for v, ts in box.events.items()] + [[(v, o) for o in self.object if self.object[o] in ts] for v, ts in box.objects.items()]
        for combo in itertools.product(*domains):
            b = {**parent, **dict(combo)}
            if not all(self.passes(f, b) for f in box.filters):
                continue
            kids = {t.name(at, c): self.run(t, c, b) for c in box.children}
            if not all(self.within(f, kids) for f in box.size_filters):
                continue
            broken = next((i for i, c in enumerate(box.constraints) if not self.satisfied(c, b, kids)), None)
            out.append((tuple(sorted(b.items())), broken))
        return out

    def within(self, f, kids):
        n = len(kids[f["child_name"]])
        return (f["min"] is None or n >= f["min"]) and (f["max"] is None or n <= f["max"])

    def satisfied(self, c, b, kids):
        if c["type"] == "Filter":
            return self.passes(c["filter"], b)
        if c["type"] == "SizeFilter":
            return self.within(c["filter"], kids)
        sets = [kids[n] for n in c["child_names"]]
        good = [any(v is None for _, v in s) for s in sets]
        clean = [all(v is None for _, v in s) for s in sets]
        return {"SAT": all(clean), "ANY": all(good), "NOT": not all(good), "OR": any(clean), "AND": all(clean)}[c["type"]]


def random_tree(rng):
    def box(bound, depth, names):
        own = {}
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice("eo")
            v = f"{kind}{1 + sum(x[0] == kind for x in [*bound, *own])}"
            own[v] = rng.sample(["place", "pay", "ship", "cancel"] if kind == "e" else ["order", "item"], rng.randint(1, 2))
        seen = [*bound, *own]
        events, objects = [v for v in seen if v[0] == "e"], [v for v in seen if v[0] == "o"]
        fs = [o2e(rng.choice(objects), rng.choice(events)) for _ in range(rng.randint(0, 2)) if events and objects]
        if len(objects) > 1 and rng.random() < 0.4:
            fs.append(o2o(*rng.sample(objects, 2)))
        if len(events) > 1 and rng.random() < 0.6:
            a, b = rng.sample(events, 2)
            fs.append(gap(a, b, rng.choice([None, 0.0, -86400.0]), rng.choice([None, 2 * 86400.0])))
        return Box(events={v: t for v, t in own.items() if v[0] == "e"}, objects={v: t for v, t in own.items() if v[0] == "o"}, filters=fs), seen

    nodes, edges = [], {}
    root, seen = box([], 0, None)
    nodes.append(root)
    for i in range(rng.randint(0, 2)):
        child, _ = box(seen, 1, None)
        if child.filters and rng.random() < 0.5:
            child.constraints = [check(child.filters.pop())]
        nodes.append(child)
        root.children.append(i + 1)
        edges[(0, i + 1)] = f"C{i + 1}"
    names = list(edges.values())
    if names:
        root.constraints = [rng.choice([over(rng.choice(["SAT", "ANY", "NOT", "OR", "AND"]), *names), size(num(names[0], rng.choice([None, 1, 2]), rng.choice([None, 1, 3])))])]
        if rng.random() < 0.3:
            root.size_filters = [num(names[-1], 1)]
    return Tree(nodes, edges)


@pytest.mark.parametrize("seed", range(12))
def test_random_trees(log, seed):
    t = random_tree(random.Random(seed))
    frame = evaluate(t, log)[0]
    names = [c for c in frame.columns if c[0] in "eo" and c[1:].isdigit()]
    got = sorted((tuple(sorted((v, r[v]) for v in names)), r["violated"]) for r in frame.collect()) if frame.columns else []
    assert sorted(got, key=str) == sorted(Loops(log).run(t, 0, {}), key=str)


def test_gate_equals_constraint(log):
    ship = Box(events={"e1": ["ship"]}, filters=[o2e("o1", "e1")], constraints=[check(gap("e1", "e1", 1.0))])
    pay = Box(events={"e1": ["pay"]}, filters=[o2e("o1", "e1")])
    t = Tree([Box(objects={"o1": ["order"]}, constraints=[over("SAT", "G")], children=[1]), Gate("OR", [2, 3]), ship, pay], {(0, 1): "G"})
    assert evaluate(t, log)[0].filter(F.col("violated").isNotNull()).count() == 0
    t.nodes[1] = Gate("AND", [2, 3])
    assert rows(evaluate(t, log)[0].filter("violated is not null"), "o1") == [("o1",)]


def test_hub_objects_are_linear(spark):
    """One object of many events: windows that only grow, not a frame per event."""
    import time

    from trailweave.log import Log
    from trailweave.operators import declare, discovery

    n = 60_000
    e2o = spark.range(n).select(F.concat(F.lit("e"), F.col("id")).alias("ev_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("ev_type"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ev_time"), F.lit("hub").alias("ob_id"), F.lit("x").alias("ob_type"), F.lit("q").alias("qualifier"))
    event = e2o.select("ev_id", "ev_type", "ev_time")
    log = Log(event, None, None, None, e2o, None, None)
    start = time.perf_counter()
    assert discovery.delays(log, "x").filter("delay is null").count() == 4  # to the other type and to their own, near the end
    assert declare.violation(log, declare.Arc("a", "b", each=("x",))).first()["violated"] == 0
    assert time.perf_counter() - start < 60


def test_results_have_a_version(log):
    from trailweave.plans.evaluate import label_bindings, profile, results

    t = tree(Box(objects={"o1": ["order"]}, events={"e1": ["ship"]}, filters=[o2e("o1", "e1")], constraints=[check(gap("e1", "e1", 1.0))]))
    old, new = results(t, log), results(t, log)
    assert new.page(new.version, 0, 0, 10).count() == 2 and {r["version"] for r in new.summary().collect()} == {new.version}
    with pytest.raises(ValueError):
        new.page(old.version, 0, 0, 10)
    assert [tuple(r) for r in label_bindings(t, log, ["o1"]).collect()] == [("o1", False)]
    assert [r["rows"] for r in profile(t, log).orderBy("step").collect()] == [2, 2]


def test_auto_discovery(log):
    from trailweave.operators.discovery import auto_discover, covering_ranges

    found = auto_discover(log, ["order"], 0.5)
    assert len({name for name, _ in found}) == len(found) and any(name.startswith("=") for name, _ in found)
    assert all(evaluate(t, log)[0].count() >= 0 for _, t in found[:3])
    assert covering_ranges({0: 1, 1: 5, 2: 5, 9: 1}, 0.8) == [(0, 2), (1, 3)] and covering_ranges({3: 4}, 1.0) == [(3, 3)]
