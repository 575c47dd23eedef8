"""Tabular extraction: a blueprint that turns tables into a log, as one DataFrame pipeline.

A blueprint names row sources (tables, filters, joins, unions) and mappings from
their rows to events, objects and relations.  Predicates and values are Spark SQL
text.  Policies: a repeated object id keeps the first by the order given or
fails; a relation with a missing end is dropped, creates the object, or fails (an
event is not created: it would have no time).  Mappings of one ``group`` apply in
order: a row goes to the first whose ``when`` holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import Log, related, related_objects
from .files import typed

TIME_FORMATS = {"auto": None, "unix seconds": F.timestamp_seconds, "unix millis": F.timestamp_millis}


@dataclass(frozen=True)
class Rows:
    """A row source: a table, or a filter, join or union of sources."""

    table: str | None = None
    of: tuple[Rows, ...] = ()
    where: str | None = None
    on: tuple[tuple[str, str], ...] = ()
    how: str = "inner"

    def frame(self, tables: dict[str, DataFrame]) -> DataFrame:
        if self.table is not None:
            df = tables[self.table]
        elif self.on:
            left, right = (s.frame(tables) for s in self.of)
            right = right.select(*[F.col(c).alias(f"_r_{c}") if c in left.columns else F.col(c) for c in right.columns])
            pairs = [left[a] == right[f"_r_{b}" if b in left.columns else b] for a, b in self.on]
            df = left.join(right, pairs, self.how)
        else:
            df = self.of[0].frame(tables)
            for s in self.of[1:]:
                df = df.unionByName(s.frame(tables), allowMissingColumns=True)
        return df.filter(F.expr(self.where)) if self.where else df


def timestamp(expression: str, format: str = "auto") -> Column:
    """A UTC timestamp without zone from a value: ISO text or a timestamp, Unix numbers, or text in a pattern."""
    c = F.expr(expression)
    if format == "auto":
        return c.try_cast("timestamp_ntz")
    if format in TIME_FORMATS:
        return F.to_utc_timestamp(TIME_FORMATS[format](c.cast("long")), F.current_timezone()).cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string"), F.lit(format)).cast("timestamp_ntz")


def template(text: str) -> Column:
    """``{column}`` places in a text filled from the row; null if one of them is null."""
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if piece:
            parts.append(F.col(piece).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def ids(expression: str, split: str | None = None, trim: bool = True) -> Column:
    """One id, or several split from one cell, as an array; empty ones are left out."""
    c = F.expr(expression).cast("string")
    found = F.split(c, split) if split else F.array(c)
    if trim:
        found = F.transform(found, lambda x: F.trim(x))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


@dataclass
class Mapping:
    """What the rows of a source become: ``event``, ``object``, ``e2o`` or ``o2o``."""

    rows: Rows
    to: str
    type: str = ""
    id: str = ""
    time: str = ""
    time_format: str = "auto"
    attributes: dict[str, tuple[str, str]] = field(default_factory=dict)  #: name: (expression, kind)
    source: str = ""
    target: str = ""
    qualifier: str = "''"
    split: str | None = None
    when: str | None = None
    order: str = ""
    group: str | None = None


@dataclass
class Blueprint:
    mappings: list[Mapping]
    duplicates: str = "first"  #: or error
    missing: str = "drop"  #: or create, or error
    prefix_ids: bool = False  #: ids rendered as type:id

    def problems(self, tables: dict[str, DataFrame]) -> list[str]:
        """What would fail, without running anything but analysis."""
        out = []
        for i, m in enumerate(self.mappings):
            try:
                df = m.rows.frame(tables)
                df.select(*[F.expr(x) for x in (m.id, m.source, m.target, m.qualifier, m.when, *(e for e, _ in m.attributes.values())) if x])
                if m.time:
                    df.select(timestamp(m.time, m.time_format))
                df.columns  # noqa: B018
            except Exception as e:  # noqa: BLE001
                out.append(f"mapping {i} to {m.to}: {str(e).splitlines()[0]}")
        return out

    def run(self, tables: dict[str, DataFrame]) -> Log:
        spark = next(iter(tables.values())).sparkSession
        out: dict[str, DataFrame | None] = dict.fromkeys(("event", "object", "event_attr", "object_attr", "e2o", "o2o"))
        decl = []

        def add(name: str, df: DataFrame) -> None:
            out[name] = df if out[name] is None else out[name].unionByName(df)

        for nth, m in enumerate(self.mappings):
            df = m.rows.frame(tables)
            for earlier in self.mappings[:nth] if m.group else []:
                if earlier.group == m.group:
                    df = df.filter(~F.coalesce(F.expr(earlier.when or "true"), F.lit(False)))
            df = df.filter(F.expr(m.when)) if m.when else df
            name = lambda expression, kind: F.concat(F.lit(f"{kind}:"), F.expr(expression).cast("string")) if self.prefix_ids and kind else F.expr(expression).cast("string")
            if m.to in ("event", "object"):
                key, kind = ("ev_id", "ev_type") if m.to == "event" else ("ob_id", "ob_type")
                df = df.withColumn("_id", name(m.id, m.type)).filter("_id is not null")
                decl += [(m.to, m.type, a, k) for a, (_, k) in m.attributes.items()] or [(m.to, m.type, None, None)]
                if m.to == "event":
                    add("event", df.select(F.col("_id").alias(key), F.lit(m.type).alias(kind), timestamp(m.time, m.time_format).alias("ev_time")).filter("ev_time is not null"))
                else:
                    order = F.expr(m.order).cast("string") if m.order else F.lit("")
                    add("object", df.select(F.col("_id").alias(key), F.lit(m.type).alias(kind), F.struct(F.lit(nth).alias("nth"), order.alias("order")).alias("_rank")))
                ts = timestamp(m.time, m.time_format) if m.time and m.to == "object" else F.lit("1970-01-01").cast("timestamp_ntz")
                for a, (expression, k) in m.attributes.items():
                    v = typed(F.expr(expression).cast("string"), F.lit(k)).alias("value")
                    row = [F.col("_id").alias(key), F.lit(a).alias("name")]
                    add(f"{m.to}_attr", df.select(*row, v) if m.to == "event" else df.select(*row, ts.alias("ts"), F.lit(nth).cast("long").alias("ordinal"), v))
            else:
                ends = ("ev_id", "ob_id") if m.to == "e2o" else ("src_id", "dst_id")
                types = m.type.split(">") if m.type else ["", ""]
                wrap = lambda c, kind: F.concat(F.lit(f"{kind}:"), c) if self.prefix_ids and kind else c
                rel = df.select(name(m.source, types[0]).alias(ends[0]), F.explode(ids(m.target, m.split)).alias("_t"), F.expr(m.qualifier).cast("string").alias("qualifier"))
                add(m.to, rel.select(ends[0], wrap(F.col("_t"), types[-1]).alias(ends[1]), "qualifier", F.lit(types[0]).alias("_from"), F.lit(types[-1]).alias("_type")).filter(f"{ends[0]} is not null"))
        frames = self._closed(spark, out)
        return Log(*frames, spark.createDataFrame(sorted(set(decl), key=str), "scope string, type_name string, attr string, value_type string"))

    def _closed(self, spark, out):
        """Duplicates and missing ends settled by the policies."""
        empty = lambda schema: spark.createDataFrame([], schema)
        event = out["event"] if out["event"] is not None else empty("ev_id string, ev_type string, ev_time timestamp_ntz")
        objects = out["object"] if out["object"] is not None else empty("ob_id string, ob_type string, _rank struct<nth:int,order:string>")
        if self.duplicates == "error" and not objects.groupBy("ob_id").count().filter("count > 1").isEmpty():
            raise ValueError("an object id occurs twice")
        first = F.row_number().over(W.partitionBy("ob_id").orderBy("_rank", "ob_type"))
        objects = objects.withColumn("_n", first).filter("_n = 1").select("ob_id", "ob_type")
        e2o = out["e2o"] if out["e2o"] is not None else empty("ev_id string, ob_id string, qualifier string, _from string, _type string")
        o2o = out["o2o"] if out["o2o"] is not None else empty("src_id string, dst_id string, qualifier string, _from string, _type string")
        named = e2o.select("ob_id", "_type").unionByName(o2o.select(F.col("dst_id").alias("ob_id"), "_type")).unionByName(o2o.select(F.col("src_id").alias("ob_id"), F.col("_from").alias("_type")))
        lacking = named.join(objects, "ob_id", "left_anti")
        if self.missing == "create":
            objects = objects.unionByName(lacking.groupBy("ob_id").agg(F.min("_type").alias("ob_type")))
        elif self.missing == "error" and not (lacking.isEmpty() and e2o.join(event, "ev_id", "left_anti").isEmpty()):
            raise ValueError("a relation names an object or an event that does not exist")
        ea = out["event_attr"] if out["event_attr"] is not None else empty("ev_id string, name string, value struct<kind:string,s:string,i:bigint,f:double,b:boolean,t:timestamp_ntz>")
        oa = out["object_attr"] if out["object_attr"] is not None else empty("ob_id string, name string, ts timestamp_ntz, ordinal long, value struct<kind:string,s:string,i:bigint,f:double,b:boolean,t:timestamp_ntz>")
        return event, objects, ea, oa, related(event, objects, e2o.drop("_from", "_type").distinct()), related_objects(objects, o2o.drop("_from", "_type").distinct())

    def report(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(frame, rows) of what a run gives."""
        log, out = self.run(tables), None
        for name, df in log.frames().items():
            row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("frame"), "rows")
            out = row if out is None else out.unionByName(row)
        return out


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of every table."""
    return [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]


def domain(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """(value, n): the most frequent values of a column; ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)
