"""The star-schema tables as an object-centric log: projections and unions only; shipments are numbered where their keys repeat."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import HIDDEN, VALUE, Log, Valued, hidden, value

EPOCH = "1970-01-01 00:00:00"


def _id(prefix: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEW = 50_000  #: repeated keys that a plan may hold; with more of them all rows are numbered by one sort


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with an id; rows that share all four keys are numbered by their other columns.

    One pass over a hash of the keys finds the repeated ones, so that rows with keys of their own,
    mostly all of them, need no shuffle: they are number 1.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = W.partitionBy(*KEYS).orderBy(*[c for c in line.columns if c not in KEYS])
    hash_ = F.xxhash64(*KEYS)
    # dealt by hash before it is counted: no map of nearly as many groups as rows is built twice
    repeated = line.select(hash_.alias("h")).repartition("h").groupBy("h").count().filter("count > 1").select("h")
    found = [r[0] for r in repeated.limit(FEW + 1).collect()]
    if len(found) > FEW:
        numbered = line.withColumn("rn", F.row_number().over(order))
    elif found:
        held = F.broadcast(spark.createDataFrame([(h,) for h in found], "_h long"))
        alone, shared = (line.withColumn("_h", hash_).join(held, "_h", how).drop("_h") for how in ("left_anti", "left_semi"))
        numbered = alone.withColumn("rn", F.lit(1)).unionByName(shared.withColumn("rn", F.row_number().over(order)))
    else:
        numbered = line.withColumn("rn", F.lit(1))
    return numbered.withColumn("ev_id", _id("sh", *KEYS, "rn"))


def _single(tables: dict[str, DataFrame], line: DataFrame) -> bool:
    """Whether each table's ids are its own: no key repeats, and no line item lacks one (shipments are numbered)."""
    keys = [df.select(F.lit(key).alias("t"), F.col(key).cast("string").alias("k")) for key, df in tables.items()]
    several = _union(keys).repartition("t", "k").groupBy("t", "k").count().filter("count > 1").limit(1).count()
    lacking = line.filter(F.greatest(*[F.col(k).isNull() for k in KEYS])).limit(1).count()
    return not several and not lacking


@lru_cache(maxsize=8)
def load(spark: SparkSession, sf_dir: str) -> Log:
    """The log of a folder of tables; plans only, after a look for repeated keys, so a second call costs nothing."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, orders, part, supplier, nation, region, events = (read(n) for n in ("customer", "orders", "part", "supplier", "nation", "region", "events"))
    line = shipments(spark, sf_dir)
    epoch = F.lit(EPOCH).cast("timestamp_ntz")

    def obj(df, prefix, key, kind):
        return df.select(_id(prefix, key).alias("ob_id"), F.lit(kind).alias("ob_type"))

    objects = _union([obj(customer, "c", "c_custkey", "customer"), obj(orders, "o", "o_orderkey", "order"), obj(part, "p", "p_partkey", "part"), obj(supplier, "s", "s_suppkey", "supplier"), obj(nation, "n", "n_nationkey", "nation"), obj(region, "r", "r_regionkey", "region")])

    def link(df, a, a_key, a_type, b, b_key, b_type, qualifier):
        return df.select(_id(a, a_key).alias("src_id"), F.lit(a_type).alias("src_type"), _id(b, b_key).alias("dst_id"), F.lit(b_type).alias("dst_type"), F.lit(qualifier).alias("qualifier"))

    o2o = _union([
        link(orders, "o", "o_orderkey", "order", "c", "o_custkey", "customer", "placed by"), link(customer, "c", "c_custkey", "customer", "n", "c_nationkey", "nation", "located in"),
        link(supplier, "s", "s_suppkey", "supplier", "n", "s_nationkey", "nation", "located in"), link(nation, "n", "n_nationkey", "nation", "r", "n_regionkey", "region", "part of"),
    ])
    time = lambda c: F.col(c).cast("timestamp_ntz").alias("ev_time")
    k = F.get_json_object("props", "$.k").try_cast("long")
    own = [
        {"totalprice": (F.col("o_totalprice"), "float"), "priority": (F.col("o_orderpriority"), "string")},
        {"quantity": (F.col("l_quantity"), "float"), "extendedprice": (F.col("l_extendedprice"), "float"), "returnflag": (F.col("l_returnflag"), "string")},
        {"value": (F.col("value"), "float"), "k": (k, "integer")},
    ]
    names = tuple(n for o in own for n in o)

    def brought(attrs):
        """The fields of all attributes; those that the rows do not have are null."""
        fields = {n: value(*attrs[n]) for n in attrs}
        return [(fields[n][f.name] if n in fields else F.lit(None).cast(f.dataType)).alias(hidden("", n, f.name)) for n in names for f in VALUE.fields]

    of_orders, of_line, of_events = map(brought, own)
    event = _union([
        orders.select(_id("po", "o_orderkey").alias("ev_id"), F.lit("place order").alias("ev_type"), time("o_orderdate"), *of_orders),
        line.select("ev_id", F.lit("ship item").alias("ev_type"), time("l_shipdate"), *of_line),
        events.select(_id("ev", "event_id").alias("ev_id"), F.col("event_type").alias("ev_type"), time("ts"), *of_events),
    ])

    def rel(df, ev, ev_type, when, prefix, key, kind, qualifier):
        attrs = {id(orders): of_orders, id(line): of_line, id(events): of_events}[id(df)]
        return df.select(ev.alias("ev_id"), ev_type.alias("ev_type"), time(when), _id(prefix, key).alias("ob_id"), F.lit(kind).alias("ob_type"), F.lit(qualifier).alias("qualifier"), *attrs)

    place, ship = F.lit("place order"), F.lit("ship item")
    e2o = _union([
        rel(orders, _id("po", "o_orderkey"), place, "o_orderdate", "o", "o_orderkey", "order", "order"), rel(orders, _id("po", "o_orderkey"), place, "o_orderdate", "c", "o_custkey", "customer", "customer"),
        rel(line, F.col("ev_id"), ship, "l_shipdate", "o", "l_orderkey", "order", "order"), rel(line, F.col("ev_id"), ship, "l_shipdate", "p", "l_partkey", "part", "part"), rel(line, F.col("ev_id"), ship, "l_shipdate", "s", "l_suppkey", "supplier", "supplier"),
        rel(events, _id("ev", "event_id"), F.col("event_type"), "ts", "c", "user_id", "customer", "actor"),
    ])

    def beside(df, ev, ev_type, when, **keys):
        """Events with the ids of their objects by type."""
        ends = {"order": "o", "customer": "c", "part": "p", "supplier": "s"}
        of = [(F.array(_id(ends[t], keys[t])) if t in keys else F.array().cast("array<string>")).alias(t) for t in ends]
        return df.select(ev.alias("ev_id"), ev_type.alias("ev_type"), time(when), F.struct(*of).alias("of"))

    objects_of = _union([
        beside(orders, _id("po", "o_orderkey"), place, "o_orderdate", order="o_orderkey", customer="o_custkey"),
        beside(line, F.col("ev_id"), ship, "l_shipdate", order="l_orderkey", part="l_partkey", supplier="l_suppkey"),
        beside(events, _id("ev", "event_id"), F.col("event_type"), "ts", customer="user_id"),
    ])
    wide, (event, e2o) = (event, e2o, objects_of), (df.select(*[c for c in df.columns if not c.startswith(HIDDEN)]) for df in (event, e2o))

    ids = ((orders, _id("po", "o_orderkey")), (line, F.col("ev_id")), (events, _id("ev", "event_id")))
    event_attr = _union([df.select(ev.alias("ev_id"), F.lit(n).alias("name"), value(*of).alias("value")) for (df, ev), attrs in zip(ids, own, strict=True) for n, of in attrs.items()])

    def ob_attr(df, prefix, key, column, name, kind):
        return df.select(_id(prefix, key).alias("ob_id"), F.lit(name).alias("name"), epoch.alias("ts"), F.lit(0).cast("long").alias("ordinal"), value(F.col(column), kind).alias("value"))

    version = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "rn")).cast("long")
    object_attr = _union([
        ob_attr(customer, "c", "c_custkey", "c_acctbal", "acctbal", "float"), ob_attr(customer, "c", "c_custkey", "c_mktsegment", "mktsegment", "string"), ob_attr(orders, "o", "o_orderkey", "o_orderstatus", "status", "string"),
        ob_attr(part, "p", "p_partkey", "p_size", "size", "integer"), ob_attr(part, "p", "p_partkey", "p_retailprice", "retailprice", "float"), ob_attr(part, "p", "p_partkey", "p_brand", "brand", "string"), ob_attr(supplier, "s", "s_suppkey", "s_acctbal", "acctbal", "float"),
        line.select(_id("o", "l_orderkey").alias("ob_id"), F.lit("returnflag").alias("name"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), version.alias("ordinal"), value(F.col("l_returnflag"), "string").alias("value")),
    ])
    declared = [
        ("event", "place order", "totalprice", "float"), ("event", "place order", "priority", "string"), ("event", "ship item", "quantity", "float"), ("event", "ship item", "extendedprice", "float"), ("event", "ship item", "returnflag", "string"),
        *[("event", t, a, k) for t in ("signup", "error", "click", "view", "purchase") for a, k in (("value", "float"), ("k", "integer"))],
        ("object", "customer", "acctbal", "float"), ("object", "customer", "mktsegment", "string"), ("object", "order", "status", "string"), ("object", "order", "returnflag", "string"), ("object", "part", "size", "integer"), ("object", "part", "retailprice", "float"), ("object", "part", "brand", "string"), ("object", "supplier", "acctbal", "float"), ("object", "nation", None, None), ("object", "region", None, None),
    ]
    single = _single({"c_custkey": customer, "o_orderkey": orders, "p_partkey": part, "s_suppkey": supplier, "n_nationkey": nation, "r_regionkey": region, "event_id": events}, line)
    return Log(event, objects, event_attr, object_attr, e2o, o2o, spark.createDataFrame(declared, "scope string, type_name string, attr string, value_type string"), single, Valued(*wide, names, (event, e2o, event_attr)))
