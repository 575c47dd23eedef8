"""Registered extraction, export and stream queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.export import binding_table
from ..plans.evaluate import evaluate
from ..sources import extract
from ..sources.extract import Blueprint, Mapping, Rows
from ..sources.tables import load
from ..streaming import incremental
from .base import sql
from .trees import ORDER, PLACE, Box, check, ev_attr, o2e, tree

QUERIES, SQL = {}, {}

BLUEPRINT = Blueprint(
    [
        Mapping(Rows("customer"), "object", "customer", "c_custkey", attributes={"acctbal": ("c_acctbal", "float"), "segment": ("c_mktsegment", "string")}),
        Mapping(Rows("orders"), "object", "order", "concat('o', o_orderkey)", attributes={"status": ("o_orderstatus", "string")}),
        Mapping(Rows("orders"), "event", "place order", "concat('po', o_orderkey)", time="o_orderdate", attributes={"price": ("o_totalprice", "float")}),
        Mapping(Rows("orders"), "e2o", ">order", source="concat('po', o_orderkey)", target="concat('o', o_orderkey)", qualifier="'order'"),
        Mapping(Rows(of=(Rows("orders"), Rows("customer")), on=(("o_custkey", "c_custkey"),)), "o2o", ">customer", source="concat('o', o_orderkey)", target="c_custkey", qualifier="lower(c_mktsegment)", when="o_orderstatus <> 'P'"),
        Mapping(Rows("events", where="event_type = 'purchase'"), "event", "purchase", "concat('ev', event_id)", time="ts", attributes={"k": ("get_json_object(props, '$.k')", "integer")}),
        Mapping(Rows("events", where="event_type = 'purchase'"), "e2o", ">customer", source="concat('ev', event_id)", target="concat_ws(';', user_id, user_id + 1000000000)", split=";", qualifier="'buyer'"),
    ]
)
SOURCES = ("customer", "orders", "events")


def extracted(spark, sf_dir):
    return BLUEPRINT.run({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES})


def register(name, build, oracle=None, ctes=""):
    QUERIES[name] = build
    if oracle:
        SQL[name] = oracle if ctes is None else sql(oracle, ctes)


register("extract_objects", lambda s, d: extracted(s, d).object.groupBy("ob_type").agg(F.count(F.lit(1)).alias("n")), "SELECT 'customer' AS ob_type, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders", None)
register("extract_events", lambda s, d: extracted(s, d).event, "SELECT 'po' || o_orderkey AS ev_id, 'place order' AS ev_type, o_orderdate AS ev_time FROM orders UNION ALL SELECT 'ev' || event_id, 'purchase', ts FROM events WHERE event_type = 'purchase'", None)
register("extract_e2o", lambda s, d: extracted(s, d).e2o.select("ev_id", "ob_id", "qualifier"), "SELECT 'po' || o_orderkey AS ev_id, 'o' || o_orderkey AS ob_id, 'order' AS qualifier FROM orders UNION ALL SELECT 'ev' || event_id, user_id::VARCHAR, 'buyer' FROM events WHERE event_type = 'purchase'", None)
register("extract_o2o", lambda s, d: extracted(s, d).o2o.select("src_id", "dst_id", "qualifier"), "SELECT 'o' || o_orderkey AS src_id, c_custkey::VARCHAR AS dst_id, lower(c_mktsegment) AS qualifier FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'", None)
register("extract_attributes", lambda s, d: extracted(s, d).event_attr.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("value.f").alias("floats"), F.count("value.i").alias("integers")), "SELECT 'price' AS name, count(*) AS n, count(o_totalprice) AS floats, CAST(0 AS BIGINT) AS integers FROM orders UNION ALL SELECT 'k', count(*), CAST(0 AS BIGINT), count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) FROM events WHERE event_type = 'purchase'", None)
register(
    "extract_report", lambda s, d: BLUEPRINT.report({t: s.read.parquet(f"{d}/{t}.parquet") for t in SOURCES}),
    "WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS p, (SELECT count(*) FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase') AS b, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P') AS r) SELECT unnest(['event', 'object', 'event_attr', 'object_attr', 'e2o', 'o2o', 'type_decl']) AS frame, unnest([o + p, c + o, o + p, 2 * c + o, o + b, r, 5]) AS rows FROM n",
    None,
)


def _ordered(s, d):
    """Orders to the first of three groups that fits."""
    kinds = [("big", "o_totalprice > 200000"), ("finished", "o_orderstatus = 'F'"), ("other", None)]
    mappings = [Mapping(Rows("orders"), "object", kind, "concat('o', o_orderkey)", when=when, group="orders") for kind, when in kinds]
    return Blueprint(mappings).run({"orders": s.read.parquet(f"{d}/orders.parquet")}).object.groupBy("ob_type").agg(F.count(F.lit(1)).alias("n"))


register("extract_ordered", _ordered, "SELECT CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'other' END AS ob_type, count(*) AS n FROM orders GROUP BY 1", None)


def _scratch(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="trailweave-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _stream_counts(spark, sf_dir):
    """Hours that the watermark has closed once the whole table is read as a stream."""
    return incremental.drained(incremental.activity_counts(incremental.event_stream(spark, sf_dir).withColumn("value", F.lit(1.0))), spark, _scratch(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


register("stream_activity_counts", _stream_counts, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2", None)
register("column_domain", lambda s, d: extract.domain(s.read.parquet(f"{d}/customer.parquet"), "c_mktsegment"), "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1", None)


def _export(spark, sf_dir):
    log = load(spark, sf_dir)
    t = tree(Box(objects=ORDER, events=PLACE, filters=[o2e("o1", "e1")], constraints=[check(ev_attr("e1", "totalprice", type="Float", min=100000.0))]))
    out = binding_table(evaluate(t, log)[0], log, {"o1": ["status", "returnflag"], "e1": ["priority"]})
    return out.toDF(*[c.replace(".", "_") for c in out.columns])


register(
    "export_table", _export,
    "SELECT o1, f.v AS o1_returnflag, s.v AS o1_status, e1, p.v AS e1_priority, n.v >= 100000 AS \"Satisfied\" FROM op JOIN object_str s ON s.ob_id = o1 AND s.name = 'status' JOIN event_str p ON p.ev_id = e1 AND p.name = 'priority' JOIN event_num n ON n.ev_id = e1 AND n.name = 'totalprice' LEFT JOIN (SELECT ob_id, arg_min(v, (ts, ordinal)) AS v FROM flag GROUP BY 1) f ON f.ob_id = o1",
    "op AS (SELECT ob_id AS o1, ev_id AS e1, ev_time AS t1 FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order')",
)
