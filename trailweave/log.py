"""The data model: an object-centric event log as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A dynamically typed attribute value: the kind and one field per kind.
VALUE = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("kind", "string"), ("s", "string"), ("i", "long"), ("f", "double"), ("b", "boolean"), ("t", "timestamp_ntz"))]}
)
_FIELD = {"string": "s", "integer": "i", "float": "f", "boolean": "b", "time": "t"}
_CAST = {"string": "string", "integer": "long", "float": "double", "boolean": "boolean", "time": "timestamp_ntz"}


def value(column: Column, kind: str) -> Column:
    """A typed column as a VALUE struct; null stays a value of kind ``null``."""
    fields = [F.when(column.isNull(), "null").otherwise(kind).alias("kind")]
    for name, field in _FIELD.items():
        fields.append((column if name == kind else F.lit(None)).cast(_CAST[name]).alias(field))
    return F.struct(*fields)


def brought_value(df: DataFrame, var: str, name: str) -> Column | None:
    """The VALUE of an event variable's attribute from columns that its rows brought along; missing is all fields null."""
    if hidden(var, name, "kind") not in df.columns:
        return None
    return F.struct(*[F.col(f"`{hidden(var, name, part)}`").alias(part) for part in VALUE.names])


def number(v: Column | str) -> Column:
    """The number in a VALUE (integers count as floats); null for other kinds."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v["f"], v["i"].cast("double"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from one timestamp to another as a double, at microsecond resolution."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


HIDDEN = "@value:"  #: begins the name of a column that brings a field of an event's attribute


def hidden(var: str, name: str, part: str) -> str:
    return f"{HIDDEN}{var}:{name}:{part}"


@dataclass(frozen=True)
class Valued:
    """``event`` and ``e2o`` of a log with the fields of events' attributes as columns ``hidden("", name, field)``.

    ``objects`` has (ev_id, ev_type, ev_time, of): the ids of an event's objects as an array per type.
    """

    event: DataFrame
    e2o: DataFrame
    objects: DataFrame
    names: tuple[str, ...]
    of: tuple[DataFrame, DataFrame, DataFrame]  #: the log's ``event``, ``e2o`` and ``event_attr`` that they repeat


@dataclass(frozen=True)
class Log:
    """Seven frames; ``e2o`` and ``o2o`` carry both endpoints' types, so that type filters reach the scan.

    event(ev_id, ev_type, ev_time) · object(ob_id, ob_type) ·
    event_attr(ev_id, name, value) · object_attr(ob_id, name, ts, ordinal, value) ·
    e2o(ev_id, ev_type, ev_time, ob_id, ob_type, qualifier) ·
    o2o(src_id, src_type, dst_id, dst_type, qualifier) ·
    type_decl(scope, type_name, attr, value_type)
    """

    event: DataFrame
    object: DataFrame
    event_attr: DataFrame
    object_attr: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    type_decl: DataFrame
    #: whether it is known that no two events or objects share an id, and no two E2O or O2O rows both ends
    single: bool = False
    #: events and relations that bring the events' attributes along, each event having at most one value of a name
    valued: Valued | None = field(default=None, compare=False)

    FRAMES = ("event", "object", "event_attr", "object_attr", "e2o", "o2o", "type_decl")

    @property
    def spark(self) -> SparkSession:
        return self.event.sparkSession

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.FRAMES}

    @property
    def values(self) -> Valued | None:
        """``valued`` where the frames that it repeats are still the log's."""
        ours = (self.event, self.e2o, self.event_attr)
        return self.valued if self.valued and self.single and all(a is b for a, b in zip(ours, self.valued.of, strict=True)) else None

    def naming(self, text: str) -> Log:
        """The log bringing along only those attributes that a text names."""
        v = self.values
        return replace(self, valued=v and replace(v, names=tuple(n for n in v.names if n in text)))

    def brought(self, var: str) -> list[Column]:
        """Columns of the attributes that ``values`` brings along for an event variable."""
        return [F.col(f"`{hidden('', n, part)}`").alias(hidden(var, n, part)) for n in self.values.names for part in VALUE.names] if self.values else []

    def persist(self) -> Log:
        """All frames cached; for repeated queries over one log."""
        return replace(self, valued=None, **{n: f.persist() for n, f in self.frames().items()})

    def restricted(self, events: DataFrame | None = None, objects: DataFrame | None = None) -> Log:
        """The log with only the events (column ``ev_id``) and objects (``ob_id``) given, and the relations between them.

        The ids are hashed partition by partition: a broadcast of all of them would fill every task.
        """
        out = dict(self.frames())
        if events is not None:
            keep = events.select("ev_id").distinct().hint("shuffle_hash")
            for name in ("event", "event_attr", "e2o"):
                out[name] = out[name].join(keep, "ev_id", "left_semi")
        if objects is not None:
            keep = objects.select("ob_id").distinct().hint("shuffle_hash")
            for name in ("object", "object_attr", "e2o"):
                out[name] = out[name].join(keep, "ob_id", "left_semi")
            for end in ("src_id", "dst_id"):
                out["o2o"] = out["o2o"].join(keep.withColumnRenamed("ob_id", end), end, "left_semi")
            out["o2o"] = out["o2o"].select(*self.o2o.columns)
        return Log(**{n: f.select(*getattr(self, n).columns) for n, f in out.items()}, single=self.single)

    # immutable counterparts of adding and deleting
    def with_events(self, events: DataFrame, relations: DataFrame | None = None) -> Log:
        """The log with more events, and relations (ev_id, ob_id, qualifier) of theirs."""
        event = self.event.unionByName(events.select(*self.event.columns))
        e2o = self.e2o if relations is None else self.e2o.unionByName(related(events, self.object, relations))
        return replace(self, event=event, e2o=e2o, single=False)

    def with_objects(self, objects: DataFrame) -> Log:
        return replace(self, object=self.object.unionByName(objects.select(*self.object.columns)), single=False)

    def without_events(self, ids: DataFrame) -> Log:
        return self.restricted(events=self.event.join(ids.select("ev_id").distinct().hint("shuffle_hash"), "ev_id", "left_anti"))

    def without_objects(self, ids: DataFrame) -> Log:
        return self.restricted(objects=self.object.join(ids.select("ob_id").distinct().hint("shuffle_hash"), "ob_id", "left_anti"))


def related(events: DataFrame, objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """E2O rows with both endpoints' columns from (ev_id, ob_id, qualifier); pairs with a missing endpoint go."""
    return pairs.join(events.select("ev_id", "ev_type", "ev_time"), "ev_id").join(objects.select("ob_id", "ob_type"), "ob_id").select("ev_id", "ev_type", "ev_time", "ob_id", "ob_type", "qualifier")


def related_objects(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """O2O rows with both endpoints' types from (src_id, dst_id, qualifier)."""
    source = objects.select(F.col("ob_id").alias("src_id"), F.col("ob_type").alias("src_type"))
    target = objects.select(F.col("ob_id").alias("dst_id"), F.col("ob_type").alias("dst_type"))
    return pairs.join(source, "src_id").join(target, "dst_id").select("src_id", "src_type", "dst_id", "dst_type", "qualifier")
