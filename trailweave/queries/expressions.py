"""Registered queries of CEL expressions, a few per function, with the SQL that gives the same rows."""

from __future__ import annotations

from ..functions.cel import Cel
from ..plans.evaluate import evaluate
from ..sources.tables import load
from .base import sql
from .trees import ORDER, ORDERS_PLACED, PLACE, PURCHASE, SHIP, SHIPS, Box, o2e, tree

QUERIES, SQL = {}, {}
QUANTITIES = "a AS (SELECT o1, count(e2) AS n, sum(q.v) AS total, avg(q.v) AS mean, min(t2) AS first, max(t2) AS last, min(q.v) AS least, max(q.v) AS most, count(*) FILTER (q.v > 20) AS large, coalesce(bool_or(f.v = 'R'), false) AS returned, coalesce(bool_and(q.v <= 40), true) AS small FROM os JOIN event_num q ON q.ev_id = e2 AND q.name = 'quantity' JOIN event_str f ON f.ev_id = e2 AND f.name = 'returnflag' GROUP BY o1)"
PLACED = f"{ORDERS_PLACED}, p AS (SELECT o1, e1, t1, n.v AS price, s.v AS status FROM op JOIN event_num n ON n.ev_id = e1 AND n.name = 'totalprice' JOIN object_str s ON s.ob_id = o1 AND s.name = 'status')"
WITH_CHILDREN = f"{PLACED}, {SHIPS}, {QUANTITIES}"


def register(name: str, texts: dict[str, str], oracle: str, ctes: str, root: Box | None = None, child: Box | None = None, keys: tuple[str, ...] = ("o1", "e1")) -> None:
    """Labels of orders and their placing, with their shipments as ``A``."""
    root = root or Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")])
    root.labels = [(label, Cel(text)) for label, text in texts.items()]
    nodes = [root]
    if child is not False and any("A" in t for t in texts.values()):
        root.children = [1]
        nodes.append(child or Box(events=SHIP, filters=[o2e("o1", "e2")]))
    t = tree(*nodes, **({"_0_1": "A"} if len(nodes) > 1 else {}))
    QUERIES[name] = lambda spark, sf_dir: evaluate(t, load(spark, sf_dir))[0].select(*keys, *texts)
    SQL[name] = sql(oracle, ctes)


register("cel_id_type_time", {"id": "o1.id() + '/' + e1.id()", "kind": "o1.type() + ' of ' + e1.type()", "at": "e1.time()", "year": "e1.time() >= timestamp('1996-01-01T00:00:00Z')"},
    "SELECT o1, e1, o1 || '/' || e1 AS id, 'order of place order' AS kind, strftime(t1, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, t1 >= TIMESTAMP '1996-01-01' AS year FROM op", ORDERS_PLACED)
register("cel_type_of_many", {"kind": "o1.type()", "is_part": "o1.type() == 'part' || e1.type() == 'place order'"}, "SELECT DISTINCT ob_id AS o1, ev_id AS e1, ob_type AS kind, ob_type = 'part' OR ev_type = 'place order' AS is_part FROM e2o WHERE ob_type IN ('part', 'supplier') OR (ob_type = 'order' AND ev_type = 'place order') AND ev_type IN ('ship item', 'place order') ", "",
    Box(objects={"o1": ["part", "supplier", "order"]}, events={"e1": ["place order", "ship item"]}, filters=[o2e("o1", "e1")], size_filters=[{"type": "AdvancedCEL", "cel": "o1.type() != 'order' || e1.type() == 'place order'"}]))
register("cel_attr", {"price": "e1.attr('totalprice')", "status": "o1.attr('status')", "none": "o1.attr('missing') == null", "dear": "e1.attr('totalprice') > 100000.0 ? 'dear' : 'cheap'"},
    "SELECT o1, e1, price, status, true AS none, CASE WHEN price > 100000 THEN 'dear' ELSE 'cheap' END AS dear FROM p", PLACED)
register("cel_attr_at", {"then": "o1.attrAt('returnflag', e1.time() + duration('2400h'))", "first": "o1.attr('returnflag')", "known": "o1.attrAt('returnflag', e1.time() + duration('2400h')) != null"},
    "SELECT op.o1, e1, v AS \"then\", w AS first, v IS NOT NULL AS known FROM op LEFT JOIN (SELECT o1, arg_max(v, (ts, ordinal)) AS v FROM op JOIN flag ON ob_id = o1 AND ts <= t1 + INTERVAL 100 DAY GROUP BY o1) x ON x.o1 = op.o1 LEFT JOIN (SELECT ob_id, arg_min(v, ordinal) AS w FROM flag GROUP BY 1) y ON y.ob_id = op.o1", ORDERS_PLACED)
register("cel_attrs", {"n": "e1.attrs().size()", "m": "o1.attrs().filter(a, a[0] == 'returnflag').size()", "paid": "o1.attrs().exists(a, a[0] == 'status' && a[1] == 'F')"},
    "SELECT p.o1, e1, CAST(2 AS BIGINT) AS n, coalesce(m, 0) AS m, status = 'F' AS paid FROM p LEFT JOIN (SELECT ob_id, count(*) AS m FROM flag GROUP BY 1) f ON f.ob_id = p.o1", PLACED)
register("cel_log_totals", {"events": "numEvents()", "objects": "numObjects()", "buys": "events().filter(e, e.type() == 'purchase').size()", "early": "events().exists(e, e.time() < timestamp('1990-01-01T00:00:00Z'))", "named": "objects().all(o, o.id().matches('^[a-z]-[0-9]+$'))"},
    "SELECT ob_id AS o1, (SELECT count(*) FROM event) AS events, (SELECT count(*) FROM object) AS objects, (SELECT count(*) FROM event WHERE ev_type = 'purchase') AS buys, (SELECT min(ev_time) < TIMESTAMP '1990-01-01' FROM event) AS early, (SELECT bool_and(regexp_matches(ob_id, '^[a-z]-[0-9]+$')) FROM object) AS named FROM object WHERE ob_type = 'region'", "",
    Box(objects={"o1": ["region"]}), child=False, keys=("o1",))
register("cel_child_sum_avg", {"total": "A.map(a, a['e2'].attr('quantity')).sum()", "mean": "A.size() > 0 ? A.map(a, a.e2.attr('quantity')).avg() : -1.0", "none": "string(A.filter(a, a.e2.attr('quantity') < 0.0).map(a, 1).avg()) == 'NaN'"},
    "SELECT op.o1, e1, coalesce(total, 0) AS total, coalesce(mean, -1) AS mean, true AS none FROM op LEFT JOIN a ON a.o1 = op.o1", WITH_CHILDREN)
register("cel_child_min_max", {"least": "min(A.map(a, a.e2.attr('quantity')))", "most": "max(A.map(a, a.e2.attr('quantity')))", "lag": "max(A.map(a, a['e2'].time() - e1.time()))", "first": "min(A.map(a, a['e2'].time()))"},
    "SELECT op.o1, e1, least, most, CASE WHEN last IS NULL THEN NULL WHEN last = t1 THEN 'P0D' ELSE CASE WHEN last < t1 THEN '-' ELSE '' END || 'PT' || CAST(abs(epoch(last - t1)) AS BIGINT) || 'S' END AS lag, strftime(first, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first FROM op LEFT JOIN a ON a.o1 = op.o1", WITH_CHILDREN)
register("cel_child_filter_exists_all", {"large": "A.filter(a, a.e2.attr('quantity') > 20.0).size()", "returned": "A.exists(a, a.e2.attr('returnflag') == 'R')", "small": "A.all(a, a.e2.attr('quantity') <= 40.0)", "flagged": "'R' in A.map(a, a.e2.attr('returnflag'))", "held": "A.map(a, a.e2.attr('returnflag')).contains('R')"},
    "SELECT op.o1, e1, coalesce(large, 0) AS large, coalesce(returned, false) AS returned, coalesce(small, true) AS small, coalesce(returned, false) AS flagged, coalesce(returned, false) AS held FROM op LEFT JOIN a ON a.o1 = op.o1", WITH_CHILDREN)
register("cel_child_satisfied", {"good": "A.filter(a, a['satisfied']).size()", "labelled": "A.map(a, a.half).sum()", "known": "has({'a': 1}.a) && !has({'a': 1}.b)"},
    "SELECT op.o1, e1, coalesce(n - large, 0) AS good, coalesce(total, 0) / 2 AS labelled, true AS known FROM op LEFT JOIN a ON a.o1 = op.o1", WITH_CHILDREN,
    child=Box(events=SHIP, filters=[o2e("o1", "e2")], labels=[("half", Cel("e2.attr('quantity') / 2"))], constraints=[{"type": "Filter", "filter": {"type": "BasicFilterCEL", "cel": "e2.attr('quantity') <= 20.0"}}]))
register("cel_lists", {"total": "[1, 2, 3].map(x, x * 2).sum()", "mean": "[1, 2, 6].avg()", "low": "min(3, 1, 2)", "high": "max([3, 9, 2])", "n": "size([1, 2] + [3])", "some": "[1, 2, 3].filter(x, x > 1).size()", "any": "[1, 2].exists(x, x == 2)", "every": "[1, 2].all(x, x > 1)", "inside": "o1.attr('status') in ['O', 'F']", "second": "[4, 5, 6][1]"},
    "SELECT o1, e1, 12.0 AS total, 3.0 AS mean, CAST(1 AS BIGINT) AS low, CAST(9 AS BIGINT) AS high, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS some, true AS any, false AS every, status IN ('O', 'F') AS inside, CAST(5 AS BIGINT) AS second FROM p", PLACED)
register("cel_strings", {"n": "size(o1.id())", "start": "e1.id().startsWith('po-1')", "end": "e1.id().endsWith('7')", "inside": "o1.id().contains('12')", "like": "o1.id().matches('^o-[0-9]{3}$')", "text": "string(12) + '|' + string(1 < 2) + '|' + string(duration('90m'))", "number": "double('2.5') + double(int('7') / 2)"},
    "SELECT o1, e1, length(o1) AS n, e1 LIKE 'po-1%' AS start, e1 LIKE '%7' AS \"end\", contains(o1, '12') AS inside, regexp_matches(o1, '^o-[0-9]{3}$') AS \"like\", '12|true|1h30m0s' AS text, 5.5 AS number FROM op", ORDERS_PLACED)
register("cel_arithmetic", {"a": "7 / 2 + 7 % 4 - -3 * 2", "b": "e1.attr('totalprice') / 1000.0 - 2.0 * 3.5", "c": "1 < 2 && !(2 <= 1) || false", "d": "5.0 / 0.0 > 1000.0", "e": "duration('1h') + duration('30m')", "f": "e1.time() - duration('24h')", "g": "e1 == e1 && o1 != e1"},
    "SELECT o1, e1, CAST(12 AS BIGINT) AS a, price / 1000 - 7 AS b, true AS c, true AS d, 'PT5400S' AS e, strftime(t1 - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS f, true AS g FROM p", PLACED)
register("cel_labels_in_order", {"price": "e1.attr('totalprice')", "tenth": "price / 10.0", "rank": "tenth > 10000.0 ? 2 : tenth > 5000.0 ? 1 : 0"},
    "SELECT o1, e1, price, price / 10 AS tenth, CASE WHEN price / 10 > 10000 THEN 2 WHEN price / 10 > 5000 THEN 1 ELSE 0 END AS rank FROM p", PLACED)


def _tree(name, t, columns, oracle, ctes):
    QUERIES[name] = lambda spark, sf_dir: evaluate(t, load(spark, sf_dir))[0].select(*columns.split())
    SQL[name] = sql(oracle, ctes)


_tree("cel_filter", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1"), {"type": "BasicFilterCEL", "cel": "e1.attr('totalprice') > 50000.0 && o1.attr('status') in ['O', 'F'] && e1.time() >= timestamp('1995-01-01T00:00:00Z')"}])), "o1 e1", "SELECT o1, e1 FROM p WHERE price > 50000 AND status IN ('O', 'F') AND t1 >= TIMESTAMP '1995-01-01'", PLACED)
_tree("cel_filter_integer", tree(Box(events=PURCHASE, filters=[{"type": "BasicFilterCEL", "cel": "e1.attr('k') % 2 == 1 && e1.attr('k') / 10 >= 3"}])), "e1", "SELECT ev_id AS e1 FROM event JOIN event_num USING (ev_id) WHERE ev_type = 'purchase' AND name = 'k' AND v % 2 = 1 AND v // 10 >= 3", "")
_tree("cel_size_filter", tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")], size_filters=[{"type": "AdvancedCEL", "cel": "A.size() >= 2 && A.all(a, a.e2.time() >= e1.time())"}], children=[1]), Box(events=SHIP, filters=[o2e("o1", "e2")]), _0_1="A"), "o1 e1", "SELECT o1, e1 FROM op JOIN os USING (o1) GROUP BY o1, e1 HAVING count(*) >= 2 AND bool_and(t2 >= t1)", f"{ORDERS_PLACED}, {SHIPS}")
_tree("cel_size_constraint", tree(Box(objects=ORDER, constraints=[{"type": "SizeFilter", "filter": {"type": "AdvancedCEL", "cel": "A.map(a, a.e2.attr('quantity')).sum() <= 100.0"}}], children=[1]), Box(events=SHIP, filters=[o2e("o1", "e2")]), _0_1="A"), "o1 violated", "SELECT ob_id AS o1, CASE WHEN coalesce(total, 0) > 100 THEN 0 END AS violated FROM object LEFT JOIN a ON a.o1 = ob_id WHERE ob_type = 'order'", f"{SHIPS}, {QUANTITIES}")
_tree("corpus_q6", tree(Box(labels=[("max_dur", Cel("string(max(A.map(b, b['e2'].time() - b['e1'].time())))"))], children=[1]), Box(objects=ORDER, events={**PLACE, **SHIP}, filters=[o2e("o1", "e1"), o2e("o1", "e2")]), _0_1="A"), "max_dur violated",
    "SELECT CAST(s // 3600 AS BIGINT) || 'h' || CAST(s % 3600 // 60 AS BIGINT) || 'm' || CAST(s % 60 AS BIGINT) || 's' AS max_dur, CAST(NULL AS INTEGER) AS violated FROM (SELECT max(epoch_us(t2) - epoch_us(t1)) // 1000000 AS s FROM op JOIN os USING (o1))", f"{ORDERS_PLACED}, {SHIPS}")
