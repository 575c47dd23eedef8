"""Registered discovery, declarative-arc and path-schema queries, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declare, discovery, paths
from ..operators.declare import Arc, Linked
from ..operators.paths import Hop
from ..sources.tables import load
from .base import sql

QUERIES, SQL = {}, {}


def register(name, build, oracle=None, ctes=""):
    QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir))
    if oracle:
        SQL[name] = sql(oracle, ctes)


# discovery
register(
    "count_distribution", lambda log: discovery.count_distribution(log, "customer"),
    """SELECT ref, type, k, count(*) AS n FROM (
      SELECT dst_id AS id, 'ObjectReversed' AS ref, src_type AS type, count(*) AS k FROM o2o WHERE dst_type = 'customer' GROUP BY ALL
      UNION ALL SELECT src_id, 'Object', dst_type, count(*) FROM o2o WHERE src_type = 'customer' GROUP BY ALL
      UNION ALL SELECT ob_id, 'EventReversed', ev_type, count(*) FROM e2o WHERE ob_type = 'customer' GROUP BY ALL
      UNION ALL SELECT ob_id, 'ObjectReversed', 'order', 0 FROM object WHERE ob_type = 'customer' AND ob_id NOT IN (SELECT dst_id FROM o2o)) GROUP BY ref, type, k""",
)


def _constraints(log):
    rows = [(c.name, c.ref, c.low, c.high) for c in discovery.discover_counts(log, "order", 0.9)]
    return log.spark.createDataFrame(rows, "name string, ref string, low long, high long")


register(
    "discover_counts", _constraints,
    """SELECT DISTINCT CASE WHEN low = high THEN '=' || low WHEN low IS NULL OR (low = 0 AND high IS NOT NULL) THEN '≤' || high WHEN high IS NULL THEN '≥' || low ELSE low || '-' || high END || ' ' || chr(39) || type || chr(39) || ' per ' || chr(39) || 'order' || chr(39) AS name, ref, low, high FROM (
      SELECT ref, type, CASE WHEN a > 0 AND a < least_k THEN NULL ELSE a END AS low, CASE WHEN b > most_k THEN NULL ELSE b END AS high FROM r x JOIN s USING (ref, type)
      WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.ref = x.ref AND y.type = x.type AND (y.a, y.b) <> (x.a, x.b) AND y.a >= x.a AND y.b <= x.b))""",
    """k AS (SELECT src_id AS id, 'Object' AS ref, dst_type AS type, count(*) AS k FROM o2o WHERE src_type = 'order' GROUP BY ALL UNION ALL SELECT ob_id, 'EventReversed', ev_type, count(*) FROM e2o WHERE ob_type = 'order' GROUP BY ALL),
    h AS (SELECT ref, type, k, count(*) AS n FROM k GROUP BY ALL),
    s AS (SELECT ref, type, sum(n) AS total, sum(k * n) / sum(n) AS mean, min(k) AS least_k, max(k) AS most_k, greatest(1, round(0.01 * sqrt(greatest(0, sum(n * k * k) / sum(n) - pow(sum(k * n) / sum(n), 2))))) AS step FROM h GROUP BY ref, type HAVING mean > 0 AND mean <= 30),
    c AS (SELECT ref, type, way, i, CAST(CASE way WHEN 0 THEN greatest(0, floor(mean) - i * step) WHEN 1 THEN 0 ELSE greatest(0, 10 + 10 * floor(mean) - i * step) END AS BIGINT) AS a, CAST(CASE way WHEN 0 THEN floor(mean) + i * step WHEN 1 THEN i * step ELSE 10 + 10 * floor(mean) END AS BIGINT) AS b, total FROM s, range(3) AS w(way), range(1000) AS j(i)),
    r AS (SELECT DISTINCT ref, type, a, b FROM (SELECT *, row_number() OVER (PARTITION BY ref, type, way ORDER BY i) AS nth FROM c WHERE (SELECT sum(n) FROM h WHERE h.ref = c.ref AND h.type = c.type AND h.k BETWEEN a AND b) >= ceil(total * 0.9 - 1e-9)) WHERE nth = 1)""",
)
DELAYS = """eo AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'order'), tt AS (SELECT DISTINCT ev_type FROM event),
d AS (SELECT a.ob_id, a.ev_id, a.ev_type AS source, tt.ev_type AS target, (SELECT min(epoch_us(b.ev_time)) FROM eo b WHERE b.ob_id = a.ob_id AND b.ev_type = tt.ev_type AND b.ev_id <> a.ev_id AND b.ev_time >= a.ev_time) AS nx, epoch_us(a.ev_time) AS us FROM eo a CROSS JOIN tt)"""
register("delays_to_next", lambda log: discovery.delays(log, "order"), "SELECT ob_id, ev_id, source, target, (nx - us) / 1e6 AS delay FROM d", DELAYS)
register("discover_ef", lambda log: discovery.discover_follows(log, "order", 0.6).withColumn("high", F.round("high", 3)), """
SELECT source, target, 0.0::DOUBLE AS low, round(min(step) * any_value(sigma), 3) AS high FROM (
  SELECT *, sum(k) OVER (PARTITION BY source, target ORDER BY step) AS covered FROM (
    SELECT source, target, need, sigma, least(CASE WHEN ms <= 0 THEN 0 WHEN sigma > 0 THEN ceil(ms / sigma - 1e-12) ELSE 1000 END, 1000) AS step, count(*) AS k
    FROM m JOIN p USING (source, target) WHERE ms IS NOT NULL GROUP BY ALL)) WHERE covered >= need AND step < 1000 GROUP BY source, target""",
    DELAYS + ", m AS (SELECT source, target, floor((nx - us) / 1000) / 1000 AS ms FROM d), p AS (SELECT source, target, ceil(count(*) * 0.6 - 1e-9) AS need, stddev_pop(ms) AS sigma FROM m GROUP BY 1, 2 HAVING count(ms) > 0 AND count(ms) >= count(*) * 0.6)",
)


def _either(log):
    found = discovery.discover_either(log, "customer", 0.8, 1.0)
    return log.spark.createDataFrame([(name, len(t.nodes)) for name, t in found], "name string, nodes int")


register("discover_or", _either)

# declarative arcs
EACH = Arc("place order", "ship item", "EF", 1, None, each=("order",))
OWN = "so AS (SELECT ev_id AS s, ob_id, ev_time AS a FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order'), ts AS (SELECT ev_id AS t, ob_id, ev_time AS b FROM e2o WHERE ev_type = 'ship item' AND ob_type = 'order')"
SHARE = "SELECT count(*) AS rows, count(*) FILTER (bad) AS violated, CASE WHEN count(*) > 0 THEN count(*) FILTER (bad) / count(*) ELSE 0 END AS share FROM v"
VIOLATED = "v AS (SELECT s, so.ob_id, count(t) < 1 AS bad FROM so LEFT JOIN ts ON ts.ob_id = so.ob_id AND b > a GROUP BY s, so.ob_id)"
register("ocd_violation_each", lambda log: declare.violation(log, EACH), SHARE, f"{OWN}, {VIOLATED}")
register(
    "ocd_violation_counts", lambda log: declare.violation(log, Arc("place order", "ship item", "AS", 2, 5, each=("order",))), SHARE,
    f"{OWN}, v AS (SELECT s, so.ob_id, count(t) NOT BETWEEN 2 AND 5 AS bad FROM so LEFT JOIN ts ON ts.ob_id = so.ob_id GROUP BY s, so.ob_id)",
)
register("ocd_violation_precedence", lambda log: declare.violation(log, Arc("ship item", "place order", "EP", 1, 1, each=("order",))), SHARE, f"{OWN}, v AS (SELECT t, ts.ob_id, count(s) <> 1 AS bad FROM ts LEFT JOIN so ON ts.ob_id = so.ob_id AND a < b GROUP BY t, ts.ob_id)")
SHIPMENT = "sp AS (SELECT ev_id AS s, ob_id, ev_time AS a FROM e2o WHERE ev_type = 'ship item' AND ob_type IN ('part', 'order')), pr AS (SELECT DISTINCT x.s, y.s AS t, x.a, y.a AS b, x.ob_id FROM sp x JOIN sp y USING (ob_id))"
register("ocd_violation_any", lambda log: declare.violation(log, Arc("ship item", "ship item", "EF", 1, None, any=("order",))), SHARE, f"{SHIPMENT}, v AS (SELECT e.ev_id, count(DISTINCT t) < 1 AS bad FROM event e LEFT JOIN (SELECT s, t FROM pr WHERE b > a AND ob_id LIKE 'o-%') p ON p.s = e.ev_id WHERE ev_type = 'ship item' GROUP BY e.ev_id)")
register("ocd_violation_all", lambda log: declare.violation(log, Arc("ship item", "ship item", "EF", 1, None, each=("order",), all=("part",))), SHARE, f"{SHIPMENT}, v AS (SELECT e.ev_id, count(p.t) < 1 AS bad FROM event e LEFT JOIN (SELECT x.s, x.t FROM pr x JOIN pr y USING (s, t) WHERE x.b > x.a AND x.ob_id LIKE 'o-%' AND y.ob_id LIKE 'p-%') p ON p.s = e.ev_id WHERE ev_type = 'ship item' GROUP BY e.ev_id)")
register("ocd_violation_unlabelled", lambda log: declare.unlabelled_violation(log, "signup", "purchase", "EF"), SHARE, "v AS (SELECT ev_id, ev_time >= (SELECT max(ev_time) FROM event WHERE ev_type = 'purchase') AS bad FROM event WHERE ev_type = 'signup')")
register(
    "ocd_violation_directly", lambda log: declare.violation(log, Arc("click", "purchase", "DF", 1, None, each=("customer",))), SHARE,
    "eo AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'customer'), l AS (SELECT *, lead(ev_type) OVER w AS nxt, lead(ev_time) OVER w AS nt FROM eo WINDOW w AS (PARTITION BY ob_id ORDER BY ev_time, ev_id)), v AS (SELECT ev_id, NOT coalesce(nxt = 'purchase' AND nt > ev_time, false) AS bad FROM l WHERE ev_type = 'click')",
)
register("ocd_conformance", lambda log: declare.conformance(log, EACH), "SELECT 1 - count(*) FILTER (bad) / count(*) AS conformance FROM v", f"{OWN}, {VIOLATED}")
register(
    "ocd_activity_stats", lambda log: declare.activity_statistics(log, "ship item"),
    "SELECT 'objects per event' AS what, ob_type, k, count(*) AS n FROM (SELECT ob_type, ev_id, count(*) AS k FROM e2o WHERE ev_type = 'ship item' GROUP BY 1, 2) GROUP BY ALL UNION ALL SELECT 'events per object', ob_type, k, count(*) FROM (SELECT o.ob_type, o.ob_id, count(ev_id) AS k FROM object o LEFT JOIN e2o ON e2o.ob_id = o.ob_id AND ev_type = 'ship item' WHERE o.ob_type IN ('order', 'part', 'supplier') GROUP BY 1, 2) GROUP BY ALL",
)
register("ocd_edge_stats", lambda log: declare.edge_durations(log, EACH).select("s", "ms"), "SELECT s, CAST(floor((epoch_us(min(b)) - epoch_us(a)) / 1000) AS BIGINT) AS ms FROM so JOIN ts ON ts.ob_id = so.ob_id AND b > a GROUP BY s, so.ob_id, a", OWN)
register(
    "ocd_edge_bins", lambda log: declare.binned(declare.edge_durations(log, EACH)).withColumn("percentage", F.round("percentage", 6)),
    "SELECT floor(a / width) * width + nth * width AS low, floor(a / width) * width + (nth + 1) * width AS high, count(*) AS n, round(100.0 * count(*) / any_value(total), 6) AS percentage FROM (SELECT *, least(floor((ms - floor(a / width) * width) / width), ceil(b / width) - floor(a / width) - 1) AS nth FROM d, w) GROUP BY nth, a, width",
    f"{OWN}, d AS (SELECT floor((epoch_us(min(b)) - epoch_us(a)) / 1000) AS ms FROM so JOIN ts ON ts.ob_id = so.ob_id AND b > a GROUP BY s, so.ob_id, a), v AS (SELECT min(ms) AS a, max(ms) AS b, count(*) AS total, (max(ms) - min(ms)) / 25 AS rough FROM d), w AS (SELECT *, pow(10.0, floor(log10(rough))) * CASE WHEN rough / pow(10.0, floor(log10(rough))) < 1.5 THEN 1 WHEN rough / pow(10.0, floor(log10(rough))) < 3 THEN 2 WHEN rough / pow(10.0, floor(log10(rough))) < 7 THEN 5 ELSE 10 END AS width FROM v)",
)
register("ocd_init_stats", lambda log: declare.activity_statistics(log, "<init> customer"), "SELECT what, 'customer' AS ob_type, CAST(1 AS BIGINT) AS k, (SELECT count(DISTINCT ob_id) FROM e2o WHERE ob_type = 'customer') AS n FROM (VALUES ('events per object'), ('objects per event')) AS t(what)")
register(
    "ocd_violation_linked", lambda log: declare.violation(log, Arc("ship item", "purchase", "EF", 1, None, each=(Linked("order", "customer"),))), SHARE,
    "x AS (SELECT DISTINCT e.ev_id AS s, r.dst_id AS c, e.ev_time AS a FROM e2o e JOIN o2o r ON r.src_id = e.ob_id AND r.dst_type = 'customer' WHERE e.ev_type = 'ship item' AND e.ob_type = 'order'), y AS (SELECT ob_id AS c, max(ev_time) AS b FROM e2o WHERE ev_type = 'purchase' AND ob_type = 'customer' GROUP BY 1), v AS (SELECT s, coalesce(b <= a, true) AS bad FROM x LEFT JOIN y USING (c))",
)
register(
    "ocd_violation_all_free", lambda log: declare.violation(log, Arc("signup", "purchase", "EF", 2, 40, all=("order",))), SHARE,
    "z AS (SELECT ev_type, count(*) FILTER (ev_type = 'purchase') OVER (ORDER BY ev_time DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) FILTER (ev_type = 'purchase') OVER (ORDER BY ev_time DESC RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS n FROM event WHERE ev_type IN ('signup', 'purchase')), v AS (SELECT n NOT BETWEEN 2 AND 40 AS bad FROM z WHERE ev_type = 'signup')",
)
register(
    "ocd_discover_kinds", lambda log: declare.discover_arcs(log, ["customer"], 0.9, ("AS", "EF", "EP", "DF", "DP")).withColumn("share", F.round("share", 6)),
    "SELECT 'customer' AS label, kind, source, target, round(1 - count(*) / any_value(n), 6) AS share FROM h JOIN s USING (source) GROUP BY kind, source, target HAVING 1 - count(*) / any_value(n) <= 0.9",
    """eo AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'customer'), x AS (SELECT ob_id, ev_type, min(ev_time) AS a, max(ev_time) AS b, count(*) AS n FROM eo GROUP BY 1, 2),
    l AS (SELECT *, lead(ev_type) OVER w AS nt, lead(ev_time) OVER w AS nx, lag(ev_type) OVER w AS pt, lag(ev_time) OVER w AS px FROM eo WINDOW w AS (PARTITION BY ob_id ORDER BY ev_time, ev_id)),
    h AS (SELECT 'EF' AS kind, eo.ev_type AS source, x.ev_type AS target FROM eo JOIN x USING (ob_id) WHERE b > ev_time UNION ALL SELECT 'EP', eo.ev_type, x.ev_type FROM eo JOIN x USING (ob_id) WHERE a < ev_time UNION ALL SELECT 'AS', eo.ev_type, x.ev_type FROM eo JOIN x USING (ob_id) WHERE x.n > CASE WHEN x.ev_type = eo.ev_type THEN 1 ELSE 0 END UNION ALL SELECT 'DF', ev_type, nt FROM l WHERE nx > ev_time UNION ALL SELECT 'DP', ev_type, pt FROM l WHERE px < ev_time),
    s AS (SELECT ev_type AS source, count(*) AS n FROM eo GROUP BY 1)""",
)


def _refined(log):
    arc = declare.refined(log, EACH)
    return log.spark.createDataFrame([(arc.low, arc.high)], "low long, high long")


register(
    "ocd_refined", _refined,
    "SELECT low, (SELECT min(i) FROM range(low, 21) AS j(i) WHERE (SELECT count(*) FILTER (n < low OR n > i) FROM c) <= 0.2 * (SELECT count(*) FROM c)) AS high FROM (SELECT max(i) AS low FROM range(0, 21) AS j(i) WHERE (SELECT count(*) FILTER (n < i) FROM c) <= 0.2 * (SELECT count(*) FROM c))",
    f"{OWN}, c AS (SELECT least(count(t), 21) AS n FROM so LEFT JOIN ts ON ts.ob_id = so.ob_id AND b > a GROUP BY s, so.ob_id)",
)
register(
    "ocd_discover", lambda log: declare.discover(log, ["order", "customer"], 0.5).withColumn("share", F.round("share", 6)),
    "SELECT ob_type, source, target, round(1 - count(nx) / count(*), 6) AS share FROM (SELECT a.ob_type, a.ev_type AS source, tt.ev_type AS target, (SELECT min(b.ev_time) FROM eo b WHERE b.ob_id = a.ob_id AND b.ev_type = tt.ev_type AND b.ev_time > a.ev_time) AS nx FROM eo a CROSS JOIN tt) GROUP BY 1, 2, 3 HAVING 1 - count(nx) / count(*) <= 0.5",
    "eo AS (SELECT DISTINCT ob_id, ob_type, ev_id, ev_type, ev_time FROM e2o WHERE ob_type IN ('order', 'customer')), tt AS (SELECT DISTINCT ev_type FROM event)",
)


def _projected(log):
    arcs = [Arc(r["source"], r["target"], each=(r["ob_type"],)) for r in declare.discover(log, ["customer"], 0.7).collect()]  # pairs of types
    lines = declare.template(declare.projected(arcs, {"click", "view", "purchase"})).split("\n")
    return log.spark.createDataFrame([(x,) for x in lines], "arc string")


register("ocd_project", _projected)

# path schemas
TO_REGION = (Hop("order", "customer", "placed by", "o2o", False), Hop("customer", "nation", "located in", "o2o", False))
SHIPPED = (Hop("place order", "order", "order", "e2o", False), Hop("order", "ship item", "order", "e2o", True))
register("path_type_graph", paths.type_graph, "SELECT ev_type AS source, ob_type AS target, qualifier, 'e2o' AS kind, count(*) AS n FROM e2o GROUP BY ALL UNION ALL SELECT src_type, dst_type, qualifier, 'o2o', count(*) FROM o2o GROUP BY ALL")


def _enumerated(log):
    graph = [tuple(r) for r in paths.type_graph(log).collect()]
    found = paths.enumerate_schemas(graph, "place order", "nation", 4)
    return log.spark.createDataFrame([(i, len(p), " / ".join(h.target for h in p)) for i, p in enumerate(found)], "nth int, hops int, through string")


register(
    "path_enumerate", _enumerated, "SELECT CAST(row_number() OVER (ORDER BY len(keys), keys) - 1 AS INTEGER) AS nth, CAST(len(keys) AS INTEGER) AS hops, array_to_string(names, ' / ') AS through FROM walk WHERE here = 'nation'",
    """g AS (SELECT DISTINCT ev_type AS a, ob_type AS b, qualifier AS q, 'e2o' AS kind FROM e2o UNION SELECT DISTINCT src_type, dst_type, qualifier, 'o2o' FROM o2o),
    hop AS (SELECT a, b, b || chr(1) || q || chr(1) || kind || chr(1) || '0' AS key FROM g UNION ALL SELECT b, a, a || chr(1) || q || chr(1) || kind || chr(1) || '1' FROM g),
    walk AS (SELECT 'place order' AS here, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS keys UNION ALL SELECT b, list_append(names, b), list_append(keys, key) FROM walk JOIN hop ON hop.a = here WHERE len(keys) < 4 AND here <> 'nation' AND b <> 'place order' AND NOT list_contains(names, b))""",
)
SQL["path_enumerate"] = SQL["path_enumerate"].replace("WITH ", "WITH RECURSIVE ", 1)
PAIRS = "p AS (SELECT so.s AS source, ts.t AS target, a AS source_time, b AS target_time FROM so JOIN ts USING (ob_id))"
register("path_connections", lambda log: paths.connections(log, SHIPPED), "SELECT source, target, source_time, target_time, CAST(1 AS BIGINT) AS n FROM p", f"{OWN}, {PAIRS}")
register("path_forward", lambda log: paths.connections(log, SHIPPED, "Forward").select("source", "target"), "SELECT source, target FROM p WHERE target_time >= source_time", f"{OWN}, {PAIRS}")
register("path_bounded", lambda log: paths.connections(log, SHIPPED, "Bounded", 90 * 86400.0).select("source", "target"), "SELECT source, target FROM p WHERE epoch(target_time - source_time) BETWEEN 0 AND 7776000", f"{OWN}, {PAIRS}")
register(
    "path_metrics", lambda log: paths.metrics(log, TO_REGION, paths.connections(log, TO_REGION)),
    "SELECT (SELECT count(*) FROM orders) AS sources, (SELECT count(*) FROM nation) AS targets, count(DISTINCT o) AS connected, count(DISTINCT n) AS reached, count(*) AS support, count(*) AS path_count, count(DISTINCT o) / (SELECT count(*) FROM orders) AS coverage, count(DISTINCT o) / count(*) AS selectivity, count(DISTINCT n) / (SELECT count(*) FROM nation) AS reach, count(DISTINCT n) / count(*) AS exclusivity FROM (SELECT a.src_id AS o, b.dst_id AS n FROM o2o a JOIN o2o b ON a.dst_id = b.src_id WHERE a.src_type = 'order' AND b.src_type = 'customer')",
)
register("path_throughput", lambda log: paths.throughput(paths.connections(log, SHIPPED)).withColumn("mean", F.round("mean", 2)), "SELECT min(s) AS low, max(s) AS high, round(avg(s), 2) AS mean, median(s) AS median FROM (SELECT (epoch_us(target_time) - epoch_us(source_time)) / 1e6 AS s FROM p)", f"{OWN}, {PAIRS}")
for how, order in (("First", "target_time"), ("Last", "target_time DESC"), ("Closest", "abs(epoch_us(target_time) - epoch_us(source_time))")):
    register(f"path_{how.lower()}", lambda log, how=how: paths.selected(paths.connections(log, SHIPPED), how).select("source", "target"), f"SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}, target) AS r FROM p) WHERE r = 1", f"{OWN}, {PAIRS}")
register(
    "path_discover", lambda log: paths.discover_schemas(log, "place order", "customer", 3),
    "SELECT nth, schema, sources, targets, connected, reached, support, support AS path_count, connected / sources AS coverage, connected / support AS selectivity, reached / targets AS reach, reached / support AS exclusivity, false AS ended_early FROM (SELECT (SELECT count(*) FROM orders) AS sources, (SELECT count(*) FROM customer) AS targets, count(DISTINCT o_orderkey) AS connected, count(DISTINCT o_custkey) AS reached, count(*) AS support FROM orders), (VALUES (0, 'place order ->customer- customer'), (1, 'place order ->order- order ->placed by- customer')) AS t(nth, schema)",
)
register(
    "path_detail_zeros", lambda log: paths.schema_detail(log, (Hop("customer", "order", "placed by", "o2o", True),))["targets_per_source"],
    "SELECT n AS k, count(*) AS n FROM (SELECT ob_id, count(src_id) AS n FROM object LEFT JOIN o2o ON dst_id = ob_id AND src_type = 'order' WHERE ob_type = 'customer' GROUP BY 1) GROUP BY 1",
)
register("path_detail_durations", lambda log: paths.schema_detail(log, SHIPPED, "Forward")["durations"].select("bin", "n"), "SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 20.0)), 19) END AS INTEGER) AS bin, count(*) AS n FROM (SELECT (epoch_us(target_time) - epoch_us(source_time)) / 1e6 AS v FROM p WHERE target_time >= source_time), (SELECT min((epoch_us(target_time) - epoch_us(source_time)) / 1e6) AS lo, max((epoch_us(target_time) - epoch_us(source_time)) / 1e6) AS hi FROM p WHERE target_time >= source_time) GROUP BY 1", f"{OWN}, {PAIRS}")
register("path_classes", lambda log: paths.equivalence_classes(log, [SHIPPED, TO_REGION, SHIPPED]), "SELECT nth, class, pairs FROM (VALUES (0, 0, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM p))), (1, 1, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey)), (2, 0, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM p)))) AS t(nth, class, pairs)", f"{OWN}, {PAIRS}")
register("path_pairs_fingerprint", lambda log: paths.fingerprint(paths.connections(log, SHIPPED)).select("pairs"), "SELECT count(*) AS pairs FROM (SELECT DISTINCT source, target FROM p)", f"{OWN}, {PAIRS}")


def _as_tree(log):
    from ..plans.evaluate import evaluate

    return evaluate(paths.to_tree(SHIPPED, {"place order", "ship item"}, 90 * 86400.0), log)[0].select("e1", "o1", "e2")


def _combined(log):
    from ..plans.evaluate import evaluate

    both = [(Hop("place order", "customer", "customer", "e2o", False),), (Hop("place order", "order", "order", "e2o", False), Hop("order", "customer", "placed by", "o2o", False))]
    return evaluate(paths.combined_tree(both, {"place order"}), log)[0].select("e1", "o1", "o2")


register("path_combined_query", _combined, "SELECT 'po-' || o_orderkey AS e1, 'c-' || o_custkey AS o1, 'o-' || o_orderkey AS o2 FROM orders")
register("path_to_query", _as_tree, "SELECT s AS e1, so.ob_id AS o1, t AS e2 FROM so JOIN ts ON ts.ob_id = so.ob_id WHERE epoch(b - a) BETWEEN 0 AND 7776000", OWN)
