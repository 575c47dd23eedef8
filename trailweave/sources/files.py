"""Readers and writers of event-log files: JSON, XML, CSV and Parquet bundles, SQLite, XES.

Readers give a ``Log`` of lazy frames; ids and types come from the files, relation ends
get their types by joins.  ``READERS`` and ``WRITERS`` are keyed by format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import Log, related, related_objects

_ATTR = "array<struct<name:string,type:string>>"
_TYPES = f"array<struct<name:string,attributes:{_ATTR}>>"
_REL = "array<struct<objectId:string,qualifier:string>>"
JSON_SCHEMA = (
    f"eventTypes {_TYPES}, objectTypes {_TYPES}, events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,relationships:{_REL}>>, "
    f"objects array<struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,relationships:{_REL}>>"
)


def typed(text: Column, kind: Column) -> Column:
    """A VALUE from text and a declared kind; text that does not parse is a string, null a null."""
    is_ = lambda *names: kind.isin(*names)
    i = F.when(is_("integer", "int"), text.try_cast("long"))
    f = F.when(is_("float", "double"), text.try_cast("double"))
    b = F.when(is_("boolean", "bool"), text.try_cast("boolean"))
    t = F.when(is_("time", "timestamp", "date"), utc(text))
    s = F.when(i.isNull() & f.isNull() & b.isNull() & t.isNull(), text)
    name = F.when(text.isNull(), "null").when(i.isNotNull(), "integer").when(f.isNotNull(), "float").when(b.isNotNull(), "boolean").when(t.isNotNull(), "time").otherwise("string")
    return F.struct(name.alias("kind"), s.alias("s"), i.alias("i"), f.alias("f"), b.alias("b"), t.alias("t"))


def utc(text: Column) -> Column:
    """A timestamp without zone, in UTC, from ISO text with or without an offset."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def text_of(v: str = "value") -> Column:
    """A VALUE as text; times in ISO form."""
    c = F.col(v)
    return F.coalesce(c["s"], c["i"].cast("string"), c["f"].cast("string"), c["b"].cast("string"), F.date_format(c["t"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def _assembled(event: DataFrame, obj: DataFrame, event_attr: DataFrame, object_attr: DataFrame, e2o: DataFrame, o2o: DataFrame, decl: DataFrame) -> Log:
    """Attributes as text with ids and names; relations as id pairs."""
    kinds = lambda scope: F.broadcast(decl.filter(F.col("scope") == scope).select(F.col("type_name").alias("_t"), F.col("attr").alias("name"), F.col("value_type").alias("_kind")))  # declared types
    ea = event_attr.join(event.select("ev_id", F.col("ev_type").alias("_t")), "ev_id").join(kinds("event"), ["_t", "name"], "left")
    oa = object_attr.join(obj.select("ob_id", F.col("ob_type").alias("_t")), "ob_id").join(kinds("object"), ["_t", "name"], "left")
    kind = F.coalesce("_kind", F.lit("string"))
    return Log(
        event, obj, ea.select("ev_id", "name", typed(F.col("text"), kind).alias("value")), oa.select("ob_id", "name", "ts", "ordinal", typed(F.col("text"), kind).alias("value")), related(event, obj, e2o), related_objects(obj, o2o), decl
    )


def read_json(spark: SparkSession, path: str) -> Log:
    """``{objectTypes, eventTypes, objects, events}`` documents."""
    return _from_documents(spark.read.schema(JSON_SCHEMA).json(path, multiLine=True))


def read_json_lines(spark: SparkSession, path: str) -> Log:
    """What ``write_json`` leaves: such documents, one per line, so that reading splits."""
    return _from_documents(spark.read.schema(JSON_SCHEMA).json(path))


def _from_documents(raw: DataFrame) -> Log:
    ev = raw.select(F.explode("events").alias("x")).select("x.*")
    ob = raw.select(F.explode("objects").alias("x")).select("x.*")
    decl = None
    for scope, column in (("event", "eventTypes"), ("object", "objectTypes")):
        t = raw.select(F.explode(column).alias("x")).select(F.lit(scope).alias("scope"), F.col("x.name").alias("type_name"), F.explode_outer("x.attributes").alias("a")).select("scope", "type_name", F.col("a.name").alias("attr"), F.col("a.type").alias("value_type"))
        decl = t if decl is None else decl.unionByName(t)
    attr = F.posexplode("attributes").alias("ordinal", "a")
    return _assembled(
        ev.select(F.col("id").alias("ev_id"), F.col("type").alias("ev_type"), utc(F.col("time")).alias("ev_time")),
        ob.select(F.col("id").alias("ob_id"), F.col("type").alias("ob_type")),
        ev.select(F.col("id").alias("ev_id"), attr).select("ev_id", F.col("a.name").alias("name"), F.col("a.value").alias("text")),
        ob.select(F.col("id").alias("ob_id"), attr).select("ob_id", F.col("a.name").alias("name"), utc(F.col("a.time")).alias("ts"), F.col("ordinal").cast("long").alias("ordinal"), F.col("a.value").alias("text")),
        ev.select(F.col("id").alias("ev_id"), F.explode("relationships").alias("r")).select("ev_id", F.col("r.objectId").alias("ob_id"), F.col("r.qualifier").alias("qualifier")),
        ob.select(F.col("id").alias("src_id"), F.explode("relationships").alias("r")).select("src_id", F.col("r.objectId").alias("dst_id"), F.col("r.qualifier").alias("qualifier")),
        decl,
    )


def write_json(log: Log, path: str) -> None:
    """One JSON line per part: types, events and objects as documents that ``read_json`` unites."""
    def types(scope):
        t = log.type_decl.filter(F.col("scope") == scope).groupBy("type_name").agg(F.array_sort(F.collect_list(F.when(F.col("attr").isNotNull(), F.struct(F.col("attr").alias("name"), F.col("value_type").alias("type"))))).alias("attributes"))
        return t.select(F.struct(F.col("type_name").alias("name"), "attributes").alias("x"))

    text = text_of()
    ea = log.event_attr.groupBy("ev_id").agg(F.collect_list(F.struct("name", text.alias("value"))).alias("attributes"))
    oa = log.object_attr.groupBy("ob_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", text.alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")))).alias("attributes"))
    er = log.e2o.groupBy("ev_id").agg(F.collect_list(F.struct(F.col("ob_id").alias("objectId"), "qualifier")).alias("relationships"))
    oo = log.o2o.groupBy(F.col("src_id").alias("ob_id")).agg(F.collect_list(F.struct(F.col("dst_id").alias("objectId"), "qualifier")).alias("relationships"))
    ev = log.event.join(ea, "ev_id", "left").join(er, "ev_id", "left").select(F.struct(F.col("ev_id").alias("id"), F.col("ev_type").alias("type"), F.date_format("ev_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), "attributes", "relationships").alias("x"))
    ob = log.object.join(oa, "ob_id", "left").join(oo, "ob_id", "left").select(F.struct(F.col("ob_id").alias("id"), F.col("ob_type").alias("type"), F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"), a["time"].alias("time"))).alias("attributes"), "relationships").alias("x"))
    parts = [("eventTypes", types("event")), ("objectTypes", types("object")), ("events", ev), ("objects", ob)]
    out = None
    for name, df in parts:
        line = df.select(F.to_json(F.struct(F.array("x").alias(name))).alias("value"))
        out = line if out is None else out.unionByName(line)
    out.write.mode("errorifexists").text(path)


def read_parquet(spark: SparkSession, path: str) -> Log:
    return Log(**{name: spark.read.parquet(f"{path}/{name}") for name in Log.FRAMES})


def write_parquet(log: Log, path: str) -> None:
    """A folder per frame; relations are partitioned by type, which later type filters prune."""
    for name, df in log.frames().items():
        writer = df.write.mode("errorifexists")
        by = {"e2o": ["ob_type"], "o2o": ["src_type"], "event": ["ev_type"], "object": ["ob_type"]}.get(name)
        (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{name}")


_CSV = {
    "event": "ev_id string, ev_type string, ev_time timestamp_ntz", "object": "ob_id string, ob_type string", "event_attr": "ev_id string, name string, text string", "object_attr": "ob_id string, name string, ts timestamp_ntz, ordinal long, text string",
    "e2o": "ev_id string, ob_id string, qualifier string", "o2o": "src_id string, dst_id string, qualifier string", "type_decl": "scope string, type_name string, attr string, value_type string",
}


def read_csv(spark: SparkSession, path: str) -> Log:
    f = {name: spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(f"{path}/{name}", header=True, escape='"', multiLine=True) for name, schema in _CSV.items()}
    return _assembled(f["event"], f["object"], f["event_attr"], f["object_attr"], f["e2o"], f["o2o"], f["type_decl"])


def write_csv(log: Log, path: str) -> None:
    text = text_of().alias("text")
    frames = log.frames() | {"event_attr": log.event_attr.select("ev_id", "name", text), "object_attr": log.object_attr.select("ob_id", "name", "ts", "ordinal", text), "e2o": log.e2o.select("ev_id", "ob_id", "qualifier"), "o2o": log.o2o.select("src_id", "dst_id", "qualifier")}
    for name, df in frames.items():
        df.write.mode("errorifexists").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(f"{path}/{name}", header=True, escape='"')


def read_xml(spark: SparkSession, path: str) -> Log:
    """The XML form: ``event`` and ``object`` elements with attributes and nested objects."""
    attr = "attributes struct<attribute:array<struct<_VALUE:string,_name:string,_time:string>>>"
    rel = "objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    ev = read("event", f"_id string, _type string, _time string, {attr}, {rel}").filter("_id is not null")
    ob = read("object", f"_id string, _type string, {attr}, {rel}").filter("_id is not null")
    decl = None
    for scope in ("event", "object"):
        t = read(f"{scope}-type", "_name string, attributes struct<attribute:array<struct<_name:string,_type:string>>>")
        t = t.select(F.lit(scope).alias("scope"), F.col("_name").alias("type_name"), F.explode_outer("attributes.attribute").alias("a")).select("scope", "type_name", F.col("a._name").alias("attr"), F.col("a._type").alias("value_type"))
        decl = t if decl is None else decl.unionByName(t)
    each = F.posexplode("attributes.attribute").alias("ordinal", "a")
    link = F.explode("objects.relationship").alias("r")
    return _assembled(
        ev.select(F.col("_id").alias("ev_id"), F.col("_type").alias("ev_type"), utc(F.col("_time")).alias("ev_time")), ob.select(F.col("_id").alias("ob_id"), F.col("_type").alias("ob_type")),
        ev.select(F.col("_id").alias("ev_id"), each).select("ev_id", F.col("a._name").alias("name"), F.col("a._VALUE").alias("text")),
        ob.select(F.col("_id").alias("ob_id"), each).select("ob_id", F.col("a._name").alias("name"), utc(F.col("a._time")).alias("ts"), F.col("ordinal").cast("long").alias("ordinal"), F.col("a._VALUE").alias("text")),
        ev.select(F.col("_id").alias("ev_id"), link).select("ev_id", F.col("r").getField("_object-id").alias("ob_id"), F.col("r._qualifier").alias("qualifier")),
        ob.select(F.col("_id").alias("src_id"), link).select("src_id", F.col("r").getField("_object-id").alias("dst_id"), F.col("r._qualifier").alias("qualifier")), decl,
    )


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """A case-centric log: (case_id, pos, activity, ts) of each event of each trace."""
    pair = "array<struct<_key:string,_value:string>>"
    raw = spark.read.format("xml").option("rowTag", "trace").schema(f"string {pair}, event array<struct<string:{pair},date:{pair}>>").load(path)
    pick = lambda entries, key: F.get(F.filter(entries, lambda a: a["_key"] == key), F.lit(0))["_value"]
    case = raw.select(pick(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("pos", "e"))
    return case.select("case_id", (F.col("pos") + 1).alias("pos"), pick(F.col("e.string"), "concept:name").alias("activity"), utc(pick(F.col("e.date"), "time:timestamp")).alias("ts"))


def _sqlite_rows(path: str, query: str):
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        yield from db.execute(query)


def read_sqlite(spark: SparkSession, path: str) -> Log:
    """The relational form: ``event``/``object`` tables, one table per type, and two junctions.

    SQLite is a single local file: it is read on the driver, for logs of desktop size.
    """
    rows = lambda q: list(_sqlite_rows(path, q))
    columns = lambda t: [(r[1], r[2].lower()) for r in rows(f'PRAGMA table_info("{t}")')]
    kinds = {"integer": "integer", "int": "integer", "real": "float", "float": "float", "double": "float", "boolean": "boolean", "timestamp": "time"}
    events, objects, ea, oa, decl = [], [], [], [], []
    for kind, into, attrs in (("event", events, ea), ("object", objects, oa)):
        for type_name, short in rows(f"SELECT ocel_type, ocel_type_map FROM {kind}_map_type"):
            fields = [(n, t) for n, t in columns(f"{kind}_{short}") if n not in ("ocel_id", "ocel_time", "ocel_changed_field")]
            decl += [(kind, type_name, n, kinds.get(t, "string")) for n, t in fields] or [(kind, type_name, None, None)]
            names = ["ocel_id", "ocel_time", *[n for n, _ in fields]]
            seen = set()
            for nth, r in enumerate(rows("SELECT " + ", ".join(f'"{n}"' for n in names) + f' FROM "{kind}_{short}"')):
                if kind == "event":
                    into.append((r[0], type_name, r[1]))
                elif r[0] not in seen:
                    seen.add(r[0])
                    into.append((r[0], type_name))
                for (n, _), v in zip(fields, r[2:], strict=True):
                    if v is not None:
                        attrs.append((r[0], n, str(v)) if kind == "event" else (r[0], n, r[1], nth, str(v)))
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    ev = frame(events, "ev_id string, ev_type string, t string").select("ev_id", "ev_type", utc(F.col("t")).alias("ev_time"))
    oattr = frame(oa, "ob_id string, name string, t string, ordinal long, text string").select("ob_id", "name", utc(F.col("t")).alias("ts"), "ordinal", "text")
    return _assembled(
        ev, frame(objects, "ob_id string, ob_type string"), frame(ea, "ev_id string, name string, text string"), oattr, frame(rows("SELECT ocel_event_id, ocel_object_id, ocel_qualifier FROM event_object"), "ev_id string, ob_id string, qualifier string"),
        frame(rows("SELECT ocel_source_id, ocel_target_id, ocel_qualifier FROM object_object"), "src_id string, dst_id string, qualifier string"), frame(decl, "scope string, type_name string, attr string, value_type string"),
    )


READERS: dict[str, Callable[[SparkSession, str], Log]] = {"json": read_json, "jsonl": read_json_lines, "xml": read_xml, "csv": read_csv, "parquet": read_parquet, "sqlite": read_sqlite}
WRITERS: dict[str, Callable[[Log, str], None]] = {"jsonl": write_json, "csv": write_csv, "parquet": write_parquet}


def read(spark: SparkSession, path: str, format: str) -> Log:
    if format not in READERS:
        raise ValueError(f"no reader for {format}; there are {sorted(READERS)}")
    return READERS[format](spark, path)


__all__ = ["READERS", "WRITERS", "read", "read_xes"]
