"""Registered tree queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filtering import filter_log
from ..plans.evaluate import evaluate, label_bindings, page, profile, summary
from ..plans.tree import Box, Gate, Tree
from ..sources.tables import load
from .base import sql

DAY = 86400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def o2e(o, e, qualifier=None, label=None):
    return {"type": "O2E", "object": o, "event": e, "qualifier": qualifier, "filterLabel": label}


def o2o(o, other, qualifier=None):
    return {"type": "O2O", "object": o, "other_object": other, "qualifier": qualifier}


def gap(a, b, low=None, high=None):
    return {"type": "TimeBetweenEvents", "from_event": a, "to_event": b, "min_seconds": low, "max_seconds": high}


def different(a, b):
    return {"type": "NotEqual", "var_1": a, "var_2": b}


def ev_attr(e, name, **test):
    return {"type": "EventAttributeValueFilter", "event": e, "attribute_name": name, "value_filter": test}


def ob_attr(o, name, at, **test):
    return {"type": "ObjectAttributeValueFilter", "object": o, "attribute_name": name, "at_time": at if isinstance(at, dict) else {"type": at}, "value_filter": test}


def expr(text):
    return {"type": "Expr", "sql": text}


def num(child, low=None, high=None):
    return {"type": "NumChilds", "child_name": child, "min": low, "max": high}


def size(f):
    return {"type": "SizeFilter", "filter": f}


def check(f):
    return {"type": "Filter", "filter": f}


def over(kind, *names):
    return {"type": kind, "child_names": list(names)}


def tree(*nodes, **edges):
    """Nodes and edge names as ``_0_1="A"``."""
    return Tree(list(nodes), {tuple(int(x) for x in k.strip("_").split("_")): v for k, v in edges.items()})


def register(name: str, t: Tree, columns: str, oracle: str, ctes: str = "", node: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(t, load(spark, sf_dir))[node].select(*columns.split())

    QUERIES[name] = run
    SQL[name] = sql(oracle, ctes)


ORDER, PLACE, SHIP = {"o1": ["order"]}, {"e1": ["place order"]}, {"e2": ["ship item"]}
CUSTOMER, PURCHASE = {"o1": ["customer"]}, {"e1": ["purchase"]}
ORDERS_PLACED = "op AS (SELECT ob_id AS o1, ev_id AS e1, ev_time AS t1 FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order')"
SHIPS = "os AS (SELECT ob_id AS o1, ev_id AS e2, ev_time AS t2 FROM e2o WHERE ev_type = 'ship item' AND ob_type = 'order')"
BUYS = "cb AS (SELECT ob_id AS o1, ev_id AS e1, ev_time AS t1 FROM e2o WHERE ev_type = 'purchase' AND ob_type = 'customer')"
NONE = "CAST(NULL AS INTEGER)"

# scans and binding steps
register("scan_objects_of_type", tree(Box(objects=ORDER)), "o1", "SELECT ob_id AS o1 FROM object WHERE ob_type = 'order'")
register("scan_events_of_type", tree(Box(events={"e1": ["purchase", "click"]})), "e1 e1_time", "SELECT ev_id AS e1, ev_time AS e1_time FROM event WHERE ev_type IN ('purchase', 'click')")
register("bind_e2o", tree(Box(objects=CUSTOMER, events=PURCHASE, filters=[o2e("o1", "e1")])), "o1 e1", "SELECT DISTINCT ob_id AS o1, ev_id AS e1 FROM e2o WHERE ev_type = 'purchase' AND ob_type = 'customer'")
register("bind_e2o_qualifier", tree(Box(objects={"o1": ["supplier"]}, events={"e1": ["ship item"]}, filters=[o2e("o1", "e1", "supplier")])), "o1 e1", "SELECT ob_id AS o1, ev_id AS e1 FROM e2o WHERE qualifier = 'supplier' AND ev_type = 'ship item' AND ob_type = 'supplier'")
register("bind_o2o_forward", tree(Box(objects={"o1": ["order"], "o2": ["customer"]}, filters=[o2o("o1", "o2")])), "o1 o2", "SELECT src_id AS o1, dst_id AS o2 FROM o2o WHERE src_type = 'order' AND dst_type = 'customer'")
register("bind_o2o_reverse", tree(Box(objects={"o1": ["nation"], "o2": ["supplier"]}, filters=[o2o("o2", "o1", "located in")])), "o1 o2", "SELECT dst_id AS o1, src_id AS o2 FROM o2o WHERE src_type = 'supplier' AND dst_type = 'nation'")
register("bind_multi_type", tree(Box(objects={"o1": ["part", "supplier"]}, events={"e1": ["ship item", "place order"]}, filters=[o2e("o1", "e1")])), "o1 e1", "SELECT DISTINCT ob_id AS o1, ev_id AS e1 FROM e2o WHERE ob_type IN ('part', 'supplier')")
register("cross_bind", tree(Box(objects={"o1": ["region"], "o2": ["nation"]})), "o1 o2", "SELECT a.ob_id AS o1, b.ob_id AS o2 FROM object a, object b WHERE a.ob_type = 'region' AND b.ob_type = 'nation'")

# filters
register("filter_time_between", tree(Box(objects=ORDER, events={**PLACE, **SHIP}, filters=[o2e("o1", "e1"), o2e("o1", "e2"), gap("e1", "e2", 0.0, 90 * DAY)])), "o1 e1 e2", "SELECT DISTINCT o1, e1, e2 FROM op JOIN os USING (o1) WHERE epoch(t2 - t1) BETWEEN 0 AND 7776000", f"{ORDERS_PLACED}, {SHIPS}")
register("filter_time_between_unlinked", tree(Box(events={"e1": ["signup"], "e2": ["error"]}, filters=[gap("e1", "e2", 0.0, 3600.0)])), "e1 e2", "SELECT a.ev_id AS e1, b.ev_id AS e2 FROM event a JOIN event b ON b.ev_time BETWEEN a.ev_time AND a.ev_time + INTERVAL 1 HOUR WHERE a.ev_type = 'signup' AND b.ev_type = 'error'")
register("filter_not_equal", tree(Box(objects={"o1": ["supplier"], "o2": ["nation"], "o3": ["supplier"]}, filters=[o2o("o1", "o2"), o2o("o3", "o2"), different("o1", "o3")])), "o1 o2 o3", "SELECT a.src_id AS o1, a.dst_id AS o2, b.src_id AS o3 FROM o2o a JOIN o2o b ON a.dst_id = b.dst_id AND a.src_id <> b.src_id WHERE a.src_type = 'supplier' AND b.src_type = 'supplier'")
register("filter_event_attr_float", tree(Box(events=PLACE, filters=[ev_attr("e1", "totalprice", type="Float", min=100000.0)])), "e1", "SELECT ev_id AS e1 FROM event_num WHERE name = 'totalprice' AND v >= 100000")
register("filter_event_attr_int", tree(Box(events=PURCHASE, filters=[ev_attr("e1", "k", type="Integer", min=10, max=50)])), "e1", "SELECT ev_id AS e1 FROM event_num JOIN event USING (ev_id) WHERE ev_type = 'purchase' AND name = 'k' AND v BETWEEN 10 AND 50")
register("filter_event_attr_string", tree(Box(events={"e1": ["ship item"]}, filters=[ev_attr("e1", "returnflag", type="String", is_in=["R", "A"])])), "e1", "SELECT ev_id AS e1 FROM event_str WHERE name = 'returnflag' AND v IN ('R', 'A')")
register("filter_event_attr_time", tree(Box(events=PLACE, filters=[ev_attr("e1", "ocel:time", type="Time", **{"from": "1995-01-01", "to": "1996-12-31"})])), "e1", "SELECT ev_id AS e1 FROM event WHERE ev_type = 'place order' AND ev_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
register("filter_event_attr_id", tree(Box(events=PURCHASE, filters=[{"type": "Expr", "sql": "e1_time is not null"}, ev_attr("e1", "ocel:id", type="String", is_in=["ev-1", "ev-2", "ev-3", "ev-4", "ev-5", "ev-6", "ev-7", "ev-8", "ev-9"])])), "e1", "SELECT ev_id AS e1 FROM event WHERE ev_type = 'purchase' AND ev_id IN ('ev-1','ev-2','ev-3','ev-4','ev-5','ev-6','ev-7','ev-8','ev-9')")
register("filter_object_attr_always", tree(Box(objects=ORDER, filters=[ob_attr("o1", "returnflag", "Always", type="String", is_in=["R", "N"])])), "o1", "SELECT ob_id AS o1 FROM object WHERE ob_type = 'order' AND ob_id NOT IN (SELECT ob_id FROM flag WHERE v NOT IN ('R', 'N'))")
register("filter_object_attr_sometime", tree(Box(objects=ORDER, filters=[ob_attr("o1", "returnflag", "Sometime", type="String", is_in=["R"])])), "o1", "SELECT DISTINCT ob_id AS o1 FROM flag WHERE v = 'R'")
register(
    "filter_object_attr_at_event", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1"), ob_attr("o1", "returnflag", {"type": "AtEvent", "event": "e1"}, type="String", is_in=["R"])])), "o1 e1",
    "SELECT o1, e1 FROM (SELECT o1, e1, arg_max(v, (ts, ordinal)) AS v FROM op JOIN flag ON ob_id = o1 AND ts <= t1 GROUP BY o1, e1) WHERE v = 'R'", ORDERS_PLACED,
)
register("filter_object_attr_number", tree(Box(objects={"o1": ["part"]}, filters=[ob_attr("o1", "size", "Always", type="Float", max=10.0)])), "o1", "SELECT ob_id AS o1 FROM object_num WHERE name = 'size' AND v <= 10")
register(
    "filter_expression", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1"), expr("e1_totalprice > 50000 and o1_status in ('O', 'F') and year(e1_time) >= 1995")], attributes=[{"var": "e1", "name": "totalprice", "kind": "float"}, {"var": "o1", "name": "status", "kind": "string"}])), "o1 e1",
    "SELECT o1, e1 FROM op JOIN event_num n ON n.ev_id = e1 AND n.name = 'totalprice' JOIN object_str s ON s.ob_id = o1 AND s.name = 'status' WHERE n.v > 50000 AND s.v IN ('O', 'F') AND year(t1) >= 1995", ORDERS_PLACED,
)

# child-set filters
COUNT_SHIPS = "n AS (SELECT o1, count(*) AS n FROM os GROUP BY o1), os1 AS (SELECT object.ob_id AS o1, coalesce(n, 0) AS n FROM object LEFT JOIN n ON n.o1 = ob_id WHERE ob_type = 'order')"
SHIP_OF = Box(events=SHIP, filters=[o2e("o1", "e2")])


def _children(*names):
    return {f"_0_{i + 1}": n for i, n in enumerate(names)}


register("size_num_childs", tree(Box(objects=ORDER, size_filters=[num("A", 3, 5)], children=[1]), SHIP_OF, _0_1="A"), "o1", "SELECT o1 FROM os1 WHERE n BETWEEN 3 AND 5", f"{SHIPS}, {COUNT_SHIPS}")
register("size_num_childs_zero", tree(Box(objects=ORDER, size_filters=[num("A", None, 0)], children=[1]), SHIP_OF, _0_1="A"), "o1", "SELECT o1 FROM os1 WHERE n = 0", f"{SHIPS}, {COUNT_SHIPS}")
register(
    "size_num_childs_proj", tree(Box(objects=CUSTOMER, size_filters=[{"type": "NumChildsProj", "child_name": "A", "var_name": "o3", "min": 40, "max": None}], children=[1]), Box(objects={"o2": ["order"], "o3": ["part"]}, events=SHIP, filters=[o2o("o2", "o1"), o2e("o2", "e2"), o2e("o3", "e2")]), _0_1="A"), "o1",
    "SELECT r.dst_id AS o1 FROM o2o r JOIN e2o a ON a.ob_id = r.src_id AND a.ev_type = 'ship item' JOIN e2o b ON b.ev_id = a.ev_id AND b.ob_type = 'part' WHERE r.src_type = 'order' GROUP BY 1 HAVING count(DISTINCT b.ob_id) >= 40",
)
register(
    "size_binding_set_equal", tree(Box(objects=ORDER, size_filters=[{"type": "BindingSetEqual", "child_names": ["A", "B"]}], children=[1, 2]), SHIP_OF, Box(events=SHIP, filters=[o2e("o1", "e2"), ev_attr("e2", "quantity", type="Float", min=10.0)]), **_children("A", "B")), "o1",
    "SELECT ob_id AS o1 FROM object WHERE ob_type = 'order' AND ob_id NOT IN (SELECT o1 FROM os JOIN event_num n ON n.ev_id = e2 AND n.name = 'quantity' WHERE n.v < 10)", SHIPS,
)
register(
    "size_binding_set_projection_equal",
    tree(Box(objects=CUSTOMER, size_filters=[{"type": "BindingSetProjectionEqual", "child_name_with_var_name": [["A", "o2"], ["B", "o2"]]}], children=[1, 2]), Box(objects={"o2": ["order"]}, filters=[o2o("o2", "o1")]), Box(objects={"o2": ["order"]}, events=SHIP, filters=[o2o("o2", "o1"), o2e("o2", "e2")]), **_children("A", "B")), "o1",
    "SELECT ob_id AS o1 FROM object WHERE ob_type = 'customer' AND ob_id NOT IN (SELECT dst_id FROM o2o WHERE src_type = 'order' AND src_id NOT IN (SELECT o1 FROM os))", SHIPS,
)
register(
    "size_advanced_expression", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")], size_filters=[expr("size(A) >= 2 and forall(A, b -> b.e2_time >= e1_time)")], children=[1]), SHIP_OF, _0_1="A"), "o1 e1",
    "SELECT o1, e1 FROM op JOIN os USING (o1) GROUP BY o1, e1 HAVING count(*) >= 2 AND bool_and(t2 >= t1)", f"{ORDERS_PLACED}, {SHIPS}",
)

# constraints
BIG = ev_attr("e2", "quantity", type="Float", max=40.0)
QUANTITY = "q AS (SELECT o1, e2, v <= 40 AS ok FROM os JOIN event_num n ON n.ev_id = e2 AND n.name = 'quantity'), g AS (SELECT ob_id AS o1, count(e2) AS n, count(CASE WHEN ok THEN 1 END) AS good, count(CASE WHEN NOT ok THEN 1 END) AS bad FROM object LEFT JOIN q ON o1 = ob_id WHERE ob_type = 'order' GROUP BY 1)"
register("constraint_filter", tree(Box(events={"e2": ["ship item"]}, constraints=[check(BIG)])), "e2 violated", "SELECT ev_id AS e2, CASE WHEN v <= 40 THEN NULL ELSE 0 END AS violated FROM event_num WHERE name = 'quantity'")
register("constraint_size", tree(Box(objects=ORDER, constraints=[size(num("A", 1)), size(num("A", None, 5))], children=[1]), SHIP_OF, _0_1="A"), "o1 violated", "SELECT o1, CASE WHEN n < 1 THEN 0 WHEN n > 5 THEN 1 END AS violated FROM os1", f"{SHIPS}, {COUNT_SHIPS}")
CHECKED = Box(events=SHIP, filters=[o2e("o1", "e2")], constraints=[check(BIG)])
for kind, broken in (("SAT", "bad > 0"), ("ANY", "good = 0"), ("NOT", "good > 0"), ("OR", "bad > 0"), ("AND", "bad > 0")):
    register(f"constraint_{kind.lower()}", tree(Box(objects=ORDER, constraints=[over(kind, "A")], children=[1]), CHECKED, _0_1="A"), "o1 violated", f"SELECT o1, CASE WHEN {broken} THEN 0 END AS violated FROM g", f"{SHIPS}, {QUANTITY}")
register(
    "constraint_unknown_child", tree(Box(objects={"o1": ["nation"]}, constraints=[over("AND", "X"), over("OR", "X"), over("SAT", "X")])), "o1 violated", "SELECT ob_id AS o1, 2 AS violated FROM object WHERE ob_type = 'nation'"
)
EARLY = Box(events=SHIP, filters=[o2e("o1", "e2")], constraints=[check(ev_attr("e2", "quantity", type="Float", min=20.0))])
TWO = "q AS (SELECT o1, e2, v <= 40 AS a, v >= 20 AS b FROM os JOIN event_num n ON n.ev_id = e2 AND n.name = 'quantity'), g AS (SELECT ob_id AS o1, coalesce(bool_and(a), true) AS all_a, coalesce(bool_and(b), true) AS all_b, coalesce(bool_or(a), false) AS any_a FROM object LEFT JOIN q ON o1 = ob_id WHERE ob_type = 'order' GROUP BY 1)"
for kind, ok in (("OR", "all_a OR all_b"), ("AND", "all_a AND all_b")):
    register(f"gate_{kind.lower()}", tree(Box(objects=ORDER, constraints=[over("SAT", "G")], children=[1]), Gate(kind, [2, 3]), CHECKED, EARLY, _0_1="G"), "o1 violated", f"SELECT o1, CASE WHEN NOT ({ok}) THEN 0 END AS violated FROM g", f"{SHIPS}, {TWO}")
register("gate_not", tree(Box(objects=ORDER, constraints=[over("SAT", "G")], children=[1]), Gate("NOT", [2]), CHECKED, _0_1="G"), "o1 violated", "SELECT o1, CASE WHEN any_a THEN 0 END AS violated FROM g", f"{SHIPS}, {TWO}")

# trees
DEEP = tree(Box(objects={"o1": ["nation"]}, constraints=[over("SAT", "A")], children=[1]), Box(objects={"o2": ["customer"]}, filters=[o2o("o2", "o1")], constraints=[size(num("B", 5))], children=[2]), Box(objects={"o3": ["order"]}, filters=[o2o("o3", "o2")]), _0_1="A", _1_2="B")
DEEP_SQL = "c AS (SELECT dst_id AS o1, src_id AS o2 FROM o2o WHERE src_type = 'customer'), n AS (SELECT dst_id AS o2, count(*) AS n FROM o2o WHERE src_type = 'order' GROUP BY 1), m AS (SELECT o1, c.o2, CASE WHEN coalesce(n, 0) < 5 THEN 0 END AS violated FROM c LEFT JOIN n ON n.o2 = c.o2)"
register("nested_three_levels", DEEP, "o1 violated", "SELECT ob_id AS o1, CASE WHEN count(violated) > 0 THEN 0 END AS violated FROM object LEFT JOIN m ON o1 = ob_id WHERE ob_type = 'nation' GROUP BY ob_id", DEEP_SQL)
register("nested_middle_level", DEEP, "o1 o2 violated", "SELECT o1, o2, violated FROM m", DEEP_SQL, node=1)
register(
    "descendants_of_filtered_parent", tree(Box(objects=ORDER, size_filters=[num("A", 6)], children=[1]), SHIP_OF, _0_1="A"), "o1 e2 violated", f"SELECT o1, e2, {NONE} AS violated FROM os WHERE o1 IN (SELECT o1 FROM os1 WHERE n >= 6)", f"{SHIPS}, {COUNT_SHIPS}", node=1
)
register(
    "labels_scalar", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")], labels=[("price", "e1_totalprice"), ("large", "price > 100000"), ("y", "year(e1_time)")], attributes=[{"var": "e1", "name": "totalprice", "kind": "float"}])), "o1 price large y",
    "SELECT o1, v AS price, v > 100000 AS large, CAST(year(t1) AS INTEGER) AS y FROM op JOIN event_num n ON n.ev_id = e1 AND n.name = 'totalprice'", ORDERS_PLACED,
)
register(
    "labels_child_aggregate", tree(Box(objects=ORDER, labels=[("last", "array_max(transform(A, b -> b.e2_time))"), ("n", "size(A)")], children=[1]), SHIP_OF, _0_1="A"), "o1 last n",
    "SELECT ob_id AS o1, max(t2) AS last, CAST(count(e2) AS INTEGER) AS n FROM object LEFT JOIN os ON o1 = ob_id WHERE ob_type = 'order' GROUP BY ob_id", SHIPS,
)
register(
    "shadowed_variable", tree(Box(objects={"o1": ["customer"]}, constraints=[size(num("A", 1))], children=[1]), Box(objects={"o1": ["region"]}), _0_1="A"), "o1__1 o1", "SELECT a.ob_id AS o1__1, b.ob_id AS o1 FROM object a, object b WHERE a.ob_type = 'customer' AND b.ob_type = 'region'", node=1
)

# corpus of realistic shapes
register("corpus_q1", tree(Box(objects=ORDER, constraints=[size(num("A", 1, 1))], children=[1]), Box(events=PLACE, filters=[o2e("o1", "e1")]), _0_1="A"), "o1 violated", f"SELECT ob_id AS o1, {NONE} AS violated FROM object WHERE ob_type = 'order'")
register(
    "corpus_q2", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")], constraints=[size(num("A", 1))], children=[1]), Box(events=SHIP, filters=[o2e("o1", "e2"), gap("e1", "e2", 0.0, 90 * DAY)]), _0_1="A"), "o1 e1 violated",
    "SELECT op.o1, e1, CASE WHEN count(e2) = 0 THEN 0 END AS violated FROM op LEFT JOIN os ON os.o1 = op.o1 AND epoch(t2 - t1) BETWEEN 0 AND 7776000 GROUP BY op.o1, e1", f"{ORDERS_PLACED}, {SHIPS}",
)
register("corpus_q3", tree(Box(events={"e1": ["ship item"]}, constraints=[size(num("A", 1, 1))], children=[1]), Box(objects={"o1": ["part"]}, filters=[o2e("o1", "e1")]), _0_1="A"), "e1 violated", f"SELECT ev_id AS e1, {NONE} AS violated FROM event WHERE ev_type = 'ship item'")
register(
    "corpus_q4", tree(Box(objects=CUSTOMER, events=PURCHASE, filters=[o2e("o1", "e1")], constraints=[size(num("A", 1))], children=[1]), Box(objects={"o2": ["order"]}, events=SHIP, filters=[o2o("o2", "o1"), o2e("o2", "e2"), gap("e1", "e2", 0.0)]), _0_1="A"), "o1 e1 violated",
    "SELECT cb.o1, cb.e1, CASE WHEN coalesce(m.t2 < cb.t1, true) THEN 0 END AS violated FROM cb LEFT JOIN (SELECT r.dst_id AS o1, max(t2) AS t2 FROM o2o r JOIN os ON os.o1 = r.src_id GROUP BY 1) m ON m.o1 = cb.o1", f"{BUYS}, {SHIPS}",
)
register(
    "corpus_q5", tree(Box(objects={"o1": ["order"], "o2": ["customer"]}, events=PLACE, filters=[o2o("o1", "o2"), o2e("o1", "e1")], constraints=[over("SAT", "A")], children=[1]), Box(events=SHIP, filters=[o2e("o1", "e2")], constraints=[check(BIG)]), _0_1="A"), "o1 o2 e1 violated",
    "SELECT op.o1, r.dst_id AS o2, e1, CASE WHEN bad > 0 THEN 0 END AS violated FROM op JOIN o2o r ON r.src_id = op.o1 AND r.dst_type = 'customer' JOIN g ON g.o1 = op.o1", f"{ORDERS_PLACED}, {SHIPS}, {QUANTITY}",
)
register(
    "corpus_q7", tree(Box(objects={"o1": ["customer"], "o2": ["order"], "o3": ["order"]}, events={"e1": ["place order"], "e2": ["place order"]}, filters=[o2o("o2", "o1"), o2o("o3", "o1"), o2e("o2", "e1", "order"), o2e("o3", "e2", "order"), different("o2", "o3")])), "o1 o2 o3 e1 e2",
    "SELECT a.dst_id AS o1, a.src_id AS o2, b.src_id AS o3, x.e1, y.e1 AS e2 FROM o2o a JOIN o2o b ON a.dst_id = b.dst_id AND a.src_id <> b.src_id JOIN op x ON x.o1 = a.src_id JOIN op y ON y.o1 = b.src_id WHERE a.dst_type = 'customer'", ORDERS_PLACED,
)


def forest_two_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(evaluate(tree(Box(objects={"o1": ["nation"]}), Box(events=PURCHASE, constraints=[check(ev_attr("e1", "k", type="Integer", max=50))])), load(spark, sf_dir)))


QUERIES["forest_two_roots"] = forest_two_roots
SQL["forest_two_roots"] = sql("SELECT 0 AS node, count(*) AS situations, CAST(0 AS BIGINT) AS violated FROM nation UNION ALL SELECT 1, count(*), count(*) FILTER (NOT coalesce(v <= 50, false)) FROM event LEFT JOIN event_num n ON n.ev_id = event.ev_id AND n.name = 'k' WHERE ev_type = 'purchase'")


def node_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(evaluate(DEEP, load(spark, sf_dir)))


QUERIES["node_summary"] = node_summary
SQL["node_summary"] = sql(
    "SELECT 0 AS node, count(*) AS situations, count(violated) AS violated FROM (SELECT ob_id, CASE WHEN count(violated) > 0 THEN 0 END AS violated FROM object LEFT JOIN m ON o1 = ob_id WHERE ob_type = 'nation' GROUP BY ob_id) UNION ALL SELECT 1, count(*), count(violated) FROM m UNION ALL SELECT 2, count(*), CAST(0 AS BIGINT) FROM o2o WHERE src_type = 'order'", DEEP_SQL
)


def page_violated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(Box(objects=ORDER, constraints=[over("SAT", "A")], children=[1]), CHECKED, _0_1="A")
    return page(evaluate(t, load(spark, sf_dir))[0], 20, 50, violated=True).select("o1", "violated")


QUERIES["page_violated"] = page_violated
SQL["page_violated"] = sql("SELECT o1, 0 AS violated FROM g WHERE bad > 0 ORDER BY o1 LIMIT 50 OFFSET 20", f"{SHIPS}, {QUANTITY}")



def plan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(tree(Box(objects=ORDER, events={**PLACE, **SHIP}, filters=[o2e("o1", "e1"), o2e("o1", "e2"), gap("e1", "e2", 0.0)])), load(spark, sf_dir)).select("node", "step", "rows")


QUERIES["plan_profile"] = plan_profile
SQL["plan_profile"] = sql("SELECT 0 AS node, 1 AS step, count(*) AS rows FROM object WHERE ob_type = 'order' UNION ALL SELECT 0, 2, count(*) FROM op UNION ALL SELECT 0, 3, count(*) FROM op JOIN os USING (o1) WHERE t2 >= t1", f"{ORDERS_PLACED}, {SHIPS}")


def labelled_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_bindings(tree(Box(objects=ORDER, events=SHIP, filters=[o2e("o1", "e2")], constraints=[check(BIG)])), load(spark, sf_dir), ["o1"])


QUERIES["labelled_bindings"] = labelled_bindings
SQL["labelled_bindings"] = sql("SELECT o1, bool_and(ok) AS satisfied FROM q GROUP BY o1", f"{SHIPS}, {QUANTITY}")

# log filtering
FILTER = tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1", None, "INCLUDED"), ev_attr("e1", "totalprice", type="Float", min=100000.0)], marks={"o1": "INCLUDED", "e1": "INCLUDED"}))
BIG_ORDERS = "b AS (SELECT ev_id, replace(ev_id, 'po-', 'o-') AS ob_id FROM event_num WHERE name = 'totalprice' AND v >= 100000)"
DROP = tree(Box(objects={"o1": ["supplier"]}, filters=[ob_attr("o1", "acctbal", "Always", type="Float", max=0.0)], marks={"o1": "EXCLUDED"}))
POOR = "b AS (SELECT ob_id FROM object_num WHERE name = 'acctbal' AND ob_id LIKE 's-%' AND v <= 0)"
for name, t, frame, columns, oracle, ctes in (
    ("filter_log_objects", FILTER, "object", ["ob_id", "ob_type"], "SELECT ob_id, 'order' AS ob_type FROM b", BIG_ORDERS),
    ("filter_log_events", FILTER, "event", ["ev_id", "ev_type"], "SELECT ev_id, 'place order' AS ev_type FROM b", BIG_ORDERS),
    ("filter_log_e2o", FILTER, "e2o", ["ev_id", "ob_id", "qualifier"], "SELECT ev_id, ob_id, 'order' AS qualifier FROM b", BIG_ORDERS),
    ("filter_log_excluded", DROP, "object", ["ob_id", "ob_type"], "SELECT ob_id, ob_type FROM object WHERE ob_id NOT IN (SELECT ob_id FROM b)", POOR),
    ("filter_log_o2o", DROP, "o2o", ["src_id", "dst_id", "qualifier"], "SELECT src_id, dst_id, qualifier FROM o2o WHERE src_id NOT IN (SELECT ob_id FROM b)", POOR),
):
    def run(spark, sf_dir, t=t, frame=frame, columns=columns):
        return getattr(filter_log(t, load(spark, sf_dir)), frame).select(*columns)

    QUERIES[name], SQL[name] = run, sql(oracle, ctes)
