"""Registered analyses, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..log import value
from ..operators import flows, statistics
from ..plans.evaluate import evaluate
from ..plans.tree import Box, Tree
from ..sources.tables import load
from .base import sql

QUERIES, SQL = {}, {}


def register(name, build, oracle=None, ctes=""):
    QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir))
    if oracle:
        SQL[name] = sql(oracle, ctes)


TYPES = "ot AS (SELECT DISTINCT ob_type FROM object), et AS (SELECT DISTINCT ev_type FROM event UNION SELECT * FROM (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase')))"
OF = "eo AS (SELECT DISTINCT ob_id, ob_type, ev_id, ev_type, ev_time FROM e2o)"

register("type_counts", statistics.type_counts, "SELECT 'event' AS scope, et.ev_type AS type_name, count(ev_id) AS n FROM et LEFT JOIN event USING (ev_type) GROUP BY 1, 2 UNION ALL SELECT 'object', ob_type, count(*) FROM object GROUP BY 1, 2", TYPES)
register(
    "info_e2o_matrix", lambda log: statistics.e2o_matrix(log).withColumn("qualifiers", F.array_join("qualifiers", ",")),
    "SELECT ev_type, ob_type, count(ev_id) AS n, coalesce(string_agg(DISTINCT qualifier, ',' ORDER BY qualifier), '') AS qualifiers FROM et CROSS JOIN ot LEFT JOIN e2o USING (ev_type, ob_type) GROUP BY 1, 2", TYPES,
)
register(
    "info_o2o_matrix", lambda log: statistics.o2o_matrix(log).withColumn("qualifiers", F.array_join("qualifiers", ",")),
    "SELECT a.ob_type AS src_type, b.ob_type AS dst_type, count(src_id) AS n, coalesce(string_agg(DISTINCT qualifier, ',' ORDER BY qualifier), '') AS qualifiers FROM ot a CROSS JOIN ot b LEFT JOIN o2o ON src_type = a.ob_type AND dst_type = b.ob_type GROUP BY 1, 2", TYPES,
)
register(
    "info_involvements", statistics.involvements,
    "SELECT ev_type, ob_type, CASE WHEN count(*) < any_value(total) THEN 0 ELSE min(k) END AS least, max(k) AS most FROM (SELECT ev_type, ob_type, ev_id, count(DISTINCT ob_id) AS k FROM e2o GROUP BY 1, 2, 3) JOIN (SELECT ev_type, count(*) AS total FROM event GROUP BY 1) USING (ev_type) GROUP BY 1, 2",
)
register("attr_stats_float", lambda log: statistics.numeric_stats(log, "event", "place order", "totalprice").withColumn("mean", F.round("mean", 4)), "SELECT min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, count(v) AS n, CAST(0 AS BIGINT) AS nulls FROM event_num WHERE name = 'totalprice'")
register("attr_stats_integer", lambda log: statistics.numeric_stats(log, "object", "part", "size").withColumn("mean", F.round("mean", 4)), "SELECT CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, round(avg(v), 4) AS mean, count(v) AS n, CAST(0 AS BIGINT) AS nulls FROM object_num WHERE name = 'size'")
register("attr_stats_missing", lambda log: statistics.numeric_stats(log, "event", "click", "k").select("n", "nulls"), "SELECT count(v) AS n, count(*) - count(v) AS nulls FROM event JOIN event_num USING (ev_id) WHERE ev_type = 'click' AND name = 'k'")
register(
    "attr_histogram", lambda log: statistics.numeric_histogram(log, "object", "part", "size").select("bin", "n"),
    "SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS n FROM object_num, (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM object_num WHERE name = 'size') WHERE name = 'size' GROUP BY 1",
)
register("attr_stats_string", lambda log: statistics.string_stats(log, "object", "part", "brand"), "SELECT v, count(*) AS n FROM object_str WHERE name = 'brand' GROUP BY v ORDER BY n DESC, v LIMIT 20")
register("attr_stats_versions", lambda log: statistics.string_stats(log, "object", "order", "returnflag"), "SELECT v, count(*) AS n FROM flag GROUP BY v ORDER BY n DESC, v LIMIT 20")
register("attr_stats_time", lambda log: statistics.time_stats(log, "purchase"), "SELECT min(ev_time) AS first, max(ev_time) AS last, count(*) AS n FROM event WHERE ev_type = 'purchase'")
register("sample_ids", lambda log: statistics.sample_ids(log, "object", "supplier", 7), "SELECT ob_id AS id FROM object WHERE ob_type = 'supplier' ORDER BY id LIMIT 7")
register("get_event", lambda log: statistics.get_event(log, "po-1").select("ev_id", "ev_type", F.size("attributes").alias("n_attr"), F.size("relations").alias("n_rel")), "SELECT ev_id, ev_type, 2 AS n_attr, 2 AS n_rel FROM event WHERE ev_id = 'po-1'")
register("get_object", lambda log: statistics.get_object(log, "c-1").select("ob_id", "ob_type", F.size("attributes").alias("n_attr"), F.size("relations").alias("n_rel")), "SELECT ob_id, ob_type, 2 AS n_attr, 1 AS n_rel FROM object WHERE ob_id = 'c-1'")
register("symmetric_relations", lambda log: statistics.symmetric_relations(log).groupBy("qualifier", "reversed").agg(F.count(F.lit(1)).alias("n")), "SELECT qualifier, r AS reversed, count(*) AS n FROM (SELECT qualifier FROM e2o UNION ALL SELECT qualifier FROM o2o), (VALUES (true), (false)) AS b(r) GROUP BY 1, 2")
register(
    "neighbourhood_graph", lambda log: statistics.neighbourhood(log, "c-1", 2),
    "SELECT id, min(d) AS distance FROM (SELECT 'c-1' AS id, 0 AS d UNION ALL SELECT dst, 1 FROM r WHERE src = 'c-1' UNION ALL SELECT b.dst, 2 FROM r a JOIN r b ON a.dst = b.src JOIN (SELECT src FROM r GROUP BY src HAVING count(*) < 1000) k ON k.src = b.src WHERE a.src = 'c-1') GROUP BY id",
    "f AS (SELECT ev_id AS src, ob_id AS dst FROM e2o UNION SELECT src_id, dst_id FROM o2o), r AS (SELECT src, dst FROM f UNION SELECT dst, src FROM f)",
)
RELATIONS = "f AS (SELECT ev_id AS src, ob_id AS dst, qualifier FROM e2o UNION ALL SELECT src_id, dst_id, qualifier FROM o2o), r AS (SELECT *, false AS reversed FROM f UNION ALL SELECT dst, src, qualifier, true FROM f), n1 AS (SELECT DISTINCT dst FROM r WHERE src = 'c-1' AND dst <> 'c-1'), p AS (SELECT *, 1 AS step FROM r WHERE src = 'c-1' UNION ALL SELECT r.*, 2 FROM r JOIN n1 ON r.src = n1.dst WHERE r.src IN (SELECT src FROM (SELECT DISTINCT src, dst FROM r) GROUP BY src HAVING count(*) < 1000))"
register(
    "neighbourhood_arcs", lambda log: statistics.neighbourhood_arcs(log, "c-1", 2),
    "SELECT src, dst, qualifier, reversed FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN reversed THEN dst ELSE src END, CASE WHEN reversed THEN src ELSE dst END, qualifier ORDER BY step, src, dst, reversed) AS nth FROM p) WHERE nth = 1", RELATIONS,
)
register(
    "neighbourhood_tree", lambda log: statistics.neighbourhood_arcs(log, "c-1", 2, spanning_tree=True),
    "SELECT src, dst, qualifier, reversed FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, qualifier, reversed) AS nth FROM p WHERE dst <> 'c-1' AND (step = 1 OR dst NOT IN (SELECT dst FROM n1))) WHERE nth = 1", RELATIONS,
)
register(
    "attr_histogram_time", lambda log: statistics.time_histogram(log, "purchase").select("bin", "n"),
    "SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS n FROM (SELECT epoch_us(ev_time) / 1000 AS v FROM event WHERE ev_type = 'purchase'), (SELECT min(epoch_us(ev_time)) / 1000 AS lo, max(epoch_us(ev_time)) / 1000 AS hi FROM event WHERE ev_type = 'purchase') GROUP BY 1",
)


def with_flags(log):
    """The log with a yes-or-no attribute of placings: whether the order is urgent."""
    urgent = log.event_attr.filter("name = 'priority'").select("ev_id", F.lit("urgent").alias("name"), value(F.col("value.s").startswith("1"), "boolean").alias("value"))
    return replace(log, event_attr=log.event_attr.unionByName(urgent))


register("attr_stats_boolean", lambda log: statistics.boolean_stats(with_flags(log), "event", "place order", "urgent"), "SELECT count(*) FILTER (v LIKE '1%') AS true, count(*) FILTER (v NOT LIKE '1%') AS false, CAST(0 AS BIGINT) AS nulls FROM event_str WHERE name = 'priority'")
register("filter_event_attr_boolean", lambda log: evaluate(Tree([Box(events={"e1": ["place order"]}, filters=[{"type": "EventAttributeValueFilter", "event": "e1", "attribute_name": "urgent", "value_filter": {"type": "Boolean", "is_true": True}}])]), with_flags(log))[0].select("e1"), "SELECT ev_id AS e1 FROM event_str WHERE name = 'priority' AND v LIKE '1%'")
register("filter_object_id", lambda log: evaluate(Tree([Box(objects={"o1": ["order"]}, filters=[{"type": "ObjectAttributeValueFilter", "object": "o1", "attribute_name": "ocel:id", "at_time": {"type": "Always"}, "value_filter": {"type": "String", "is_in": ["o-1", "o-2", "c-3"]}}])]), log)[0].select("o1"), "SELECT ob_id AS o1 FROM object WHERE ob_type = 'order' AND ob_id IN ('o-1', 'o-2', 'c-3')")

# flows
LEAD = "l AS (SELECT *, lead(ev_type) OVER w AS nxt, lag(ev_time) OVER w AS before, row_number() OVER w AS pos FROM eo WINDOW w AS (PARTITION BY ob_id ORDER BY ev_time, ev_id))"
register("dfg_per_type", lambda log: flows.directly_follows(log, "customer"), "SELECT ob_type, ev_type AS source, nxt AS target, count(*) AS n FROM l WHERE ob_type = 'customer' AND nxt IS NOT NULL GROUP BY 1, 2, 3", f"{OF}, {LEAD}")
register("dfg_cases", lambda log: flows.case_directly_follows(flows.flatten(log, "order")), "SELECT ev_type AS source, nxt AS target, count(*) AS n FROM l WHERE ob_type = 'order' AND nxt IS NOT NULL GROUP BY 1, 2", f"{OF}, {LEAD}")
register("dfg_all_types", flows.directly_follows, "SELECT ob_type, ev_type AS source, nxt AS target, count(*) AS n FROM l WHERE nxt IS NOT NULL GROUP BY 1, 2, 3", f"{OF}, {LEAD}")
register(
    "oc_dfg_start_end", flows.start_end,
    "SELECT ob_type, ev_type, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM (SELECT ob_type, arg_min(ev_type, (ev_time, ev_id)) AS ev_type, 1 AS s, 0 AS e FROM eo GROUP BY ob_type, ob_id UNION ALL SELECT ob_type, arg_max(ev_type, (ev_time, ev_id)), 0, 1 FROM eo GROUP BY ob_type, ob_id) GROUP BY 1, 2", OF,
)
register("variants", lambda log: flows.variants(log, "order").withColumn("trace", F.array_join("trace", ">")), "SELECT trace, count(*) AS n FROM (SELECT string_agg(ev_type, '>' ORDER BY ev_time, ev_id) AS trace FROM eo WHERE ob_type = 'order' GROUP BY ob_id) GROUP BY 1", OF)
register("variants_top", lambda log: flows.top_variants(log, "order", 5).withColumn("trace", F.array_join("trace", ">")), "SELECT array_to_string(trace, '>') AS trace, n FROM (SELECT trace, count(*) AS n FROM (SELECT list(ev_type ORDER BY ev_time, ev_id) AS trace FROM eo WHERE ob_type = 'order' GROUP BY ob_id) GROUP BY 1 ORDER BY n DESC, trace LIMIT 5)", OF)
register("object_trace", lambda log: flows.traces(log, "customer").withColumn("trace", F.array_join("trace", ">")), "SELECT ob_id, string_agg(ev_type, '>' ORDER BY ev_time, ev_id) AS trace FROM eo WHERE ob_type = 'customer' GROUP BY ob_id", OF)
register("flatten", lambda log: flows.flatten(log, "customer"), "SELECT ob_id AS case_id, CAST(pos AS INTEGER) AS pos, ev_type AS activity, ev_id, ev_time AS ts FROM l WHERE ob_type = 'customer'", f"{OF}, {LEAD}")
register("sojourn", flows.sojourn, "SELECT ev_id, epoch_us(any_value(ev_time)) / 1e6 - epoch_us(max(before)) / 1e6 AS seconds FROM l WHERE before IS NOT NULL GROUP BY ev_id", f"{OF}, {LEAD}")
register("sojourn_top", lambda log: flows.sojourn(log, 10), "SELECT ev_id, (epoch_us(any_value(ev_time)) - epoch_us(max(before))) / 1e6 AS seconds FROM l WHERE before IS NOT NULL GROUP BY ev_id ORDER BY seconds DESC, ev_id LIMIT 10", f"{OF}, {LEAD}")
register("synchronisation", flows.synchronisation, "SELECT ev_id, (epoch_us(max(before)) - epoch_us(min(before))) / 1e6 AS seconds FROM l WHERE before IS NOT NULL GROUP BY ev_id", f"{OF}, {LEAD}")
register("attr_changes", lambda log: flows.attribute_changes(log, "order", "returnflag").select("ob_id", "nth", "ts", F.col("value.s").alias("v")), "SELECT ob_id, CAST(row_number() OVER (PARTITION BY ob_id ORDER BY ts, ordinal) AS INTEGER) AS nth, ts, v FROM flag")
register(
    "dotted_chart", lambda log: flows.dotted_chart(log, "order").withColumn("relative", F.round("relative", 6)),
    "SELECT ob_id, ev_id, ev_type, ev_time AS time, (epoch_us(ev_time) - epoch_us(a)) / 1e6 AS since_start, round(CASE WHEN a = b THEN 0 ELSE (epoch_us(ev_time) - epoch_us(a)) / (epoch_us(b) - epoch_us(a)) END, 6) AS relative, CAST(pos AS INTEGER) AS step FROM l JOIN (SELECT ob_id, min(ev_time) AS a, max(ev_time) AS b FROM eo GROUP BY 1) USING (ob_id) WHERE ob_type = 'order'", f"{OF}, {LEAD}",
)
register(
    "timestamp_histogram", lambda log: flows.timestamp_histogram(log, 30),
    "SELECT CAST(least(floor((epoch_us(ev_time) - lo) * 30.0 / (hi - lo)), 29) AS INTEGER) AS bin, ev_type, count(*) AS n FROM event, (SELECT min(epoch_us(ev_time)) AS lo, max(epoch_us(ev_time)) AS hi FROM event) GROUP BY 1, 2",
)
register("conversion_rate", lambda log: flows.conversion_rate(log, "place order", "customer", "order"), "SELECT count(*) AS sources, count(*) AS converted, 1.0::DOUBLE AS rate FROM (SELECT DISTINCT ob_id FROM e2o WHERE ev_type = 'place order' AND ob_type = 'customer')")
register("pair_counts", flows.pair_counts, "SELECT ev_type, ob_type, count(DISTINCT ev_id) AS events, count(DISTINCT ob_id) AS objects FROM e2o GROUP BY 1, 2")
register("bounded_log", lambda log: flows.with_bounds(log).event.groupBy("ev_type").agg(F.count(F.lit(1)).alias("n")), "SELECT ev_type, count(*) AS n FROM event GROUP BY 1 UNION ALL SELECT '<init> ' || ob_type, count(DISTINCT ob_id) FROM e2o GROUP BY 1 UNION ALL SELECT '<exit> ' || ob_type, count(DISTINCT ob_id) FROM e2o GROUP BY 1")
register("entities_of_type", lambda log: log.without_objects(log.object.filter("ob_type = 'part'")).e2o.groupBy("ob_type").agg(F.count(F.lit(1)).alias("n")), "SELECT ob_type, count(*) AS n FROM e2o WHERE ob_type <> 'part' GROUP BY 1")
