"""Expressions of query trees as Columns.

``Expressions`` turns CEL text into typed Columns over one frame of bindings.
Attributes, types and log totals that an expression asks for become joins of
that frame.  Lists of a child's bindings are never collected: ``map`` and
``filter`` work on the columns of the child's frame, and what ends the chain
(``size``, ``sum``, ``avg``, ``min``, ``max``, ``all``, ``exists``, ``in``)
is an aggregate of that frame by the parent's variables.

Defined here, where the language leaves it open: integers and doubles mix as doubles; the
division of integers truncates and fails for zero, that of doubles gives infinity
or NaN; a missing attribute is null, and only ``== null`` holds for it; of an event's
repeated attribute the smallest value counts, of an object's versions the first
stored; ``string`` of a duration is ``1h2m3s``; a label that is a duration or a time is ISO 8601
text, one that is a list or a map is null; ``now`` is the time of the query.  Not supported, with
an error: lists of one child, or labels of the parent, inside another list; elements of a child's list by number.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..log import Log, brought_value, number
from ..operators.temporal import latest_at


class Cel(str):
    """Text of an expression in CEL; other text is Spark SQL."""


_TOKEN = re.compile(r"""\s+|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+u?)|(?P<text>[rR]?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[=!<>]=|[-+*/%<>!?:.,()\[\]{}])""")
#: Operators by binding strength, loosest first.
_LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"))


def parse(text: str) -> tuple:
    """The expression as nested tuples, operator first."""
    words, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r} in {text!r}")
        at = m.end()
        if m.lastgroup:
            words.append((m.lastgroup, m[0]))
    words.append(("end", ""))
    here = 0

    def peek(*wanted: str) -> bool:
        return words[here][0] in ("op", "name") and words[here][1] in wanted

    def take(wanted: str | None = None) -> str:
        nonlocal here
        if wanted is not None and not peek(wanted):
            raise ValueError(f"{wanted!r} expected before {words[here][1]!r} in {text!r}")
        here += 1
        return words[here - 1][1]

    def listed(end: str, item: Callable) -> list:
        found = []
        while not peek(end):
            found.append(item())
            if not peek(end):
                take(",")
        take(end)
        return found

    def choice():
        test = level(0)
        if not peek("?"):
            return test
        take("?")
        yes = choice()
        take(":")
        return ("choice", test, yes, choice())

    def level(n: int):
        if n == len(_LEVELS):
            return unary()
        left = level(n + 1)
        while peek(*_LEVELS[n]):
            left = (take(), left, level(n + 1))
        return left

    def unary():
        if peek("!", "-"):
            return ("not" if take() == "!" else "minus", unary())
        return member(primary())

    def member(x):
        while peek(".", "["):
            if take() == "[":
                x = ("index", x, choice())
                take("]")
                continue
            name = take()
            if peek("("):
                take("(")
                x = ("call", name, x, listed(")", choice))
            else:
                x = ("index", x, ("literal", name))
        return x

    def primary():
        kind, word = words[here]
        if kind == "number":
            take()
            return ("literal", float(word) if re.search("[.eE]", word) else int(word.rstrip("u")))
        if kind == "text":
            take()
            return ("literal", ast.literal_eval(word))
        if kind == "name":
            take()
            if word in ("true", "false", "null"):
                return ("literal", {"true": True, "false": False, "null": None}[word])
            if peek("("):
                take("(")
                return ("call", word, None, listed(")", choice))
            return ("name", word)
        if peek("("):
            take("(")
            x = choice()
            take(")")
            return x
        if peek("["):
            take("[")
            return ("list", listed("]", choice))
        take("{")

        def pair():
            key = choice()
            take(":")
            return key, choice()

        return ("map", listed("}", pair))

    out = choice()
    if words[here][0] != "end":
        raise ValueError(f"{words[here][1]!r} is left over in {text!r}")
    return out


@dataclass
class Value:
    """A typed Column; ``value`` is an attribute of unknown kind (a VALUE struct), a duration counts microseconds."""

    kind: str  #: int, double, string, bool, time, duration, null, value, list, map, event, object or rows
    col: Column | None = None
    of: str | None = None  #: kind of a list's elements
    fields: dict[str, Value] = field(default_factory=dict)  #: of a map
    var: str | None = None  #: an entity's column in its frame
    types: list[str] | None = None  #: an entity's possible types
    frame: Frame | None = None
    item: Value | None = None  #: of rows
    when: Column | None = None


_KINDS = {"integer": "int", "float": "double", "string": "string", "boolean": "bool", "time": "time"}
_FIELDS = {"int": "i", "double": "f", "string": "s", "bool": "b", "time": "t"}
_SPARK = {"int": "long", "double": "double", "string": "string", "bool": "boolean", "time": "timestamp_ntz", "duration": "long", "null": "string"}


def kind_of(kind: T.DataType) -> str:
    """The kind of a Spark column."""
    for kinds, name in (((T.LongType, T.IntegerType, T.ShortType), "int"), ((T.DoubleType, T.FloatType, T.DecimalType), "double"), ((T.BooleanType,), "bool"), ((T.TimestampType, T.TimestampNTZType), "time"), ((T.StructType,), "value")):
        if isinstance(kind, kinds):
            return name
    return "string"


@lru_cache(maxsize=16)
def declared_kinds(log: Log) -> dict[tuple[str, str, str], str]:
    """(scope, type, attribute): kind; as many rows as the log declares attributes."""
    return {(r["scope"], r["type_name"], r["attr"]): _KINDS.get(r["value_type"], "value") for r in log.type_decl.filter("attr is not null").collect()}


class Frame:
    """What expressions ask of a frame of bindings beyond its columns, each as one join."""

    def __init__(self, log: Log, declared: dict[tuple[str, str, str], str], tag: str):
        self.log, self.declared, self.tag = log, declared, tag
        self.asked: dict[tuple, tuple[str, Callable[[DataFrame, str], DataFrame]]] = {}

    def ask(self, key: tuple, join: Callable[[DataFrame, str], DataFrame]) -> Column:
        name = self.asked.setdefault(key, (f"#{self.tag}{len(self.asked)}", join))[0]
        return F.col(f"`{name}`")

    def joined(self, df: DataFrame) -> DataFrame:
        for name, join in self.asked.values():
            if name not in df.columns:
                df = join(df, name)
        return df

    def type_of(self, x: Value) -> Column:
        if x.types is not None and len(x.types) == 1:
            return F.lit(x.types[0])
        source, a, b = (self.log.event, "ev_id", "ev_type") if x.kind == "event" else (self.log.object, "ob_id", "ob_type")
        return self.ask(("type", x.var), lambda df, n: df.join(source.select(F.col(a).alias(x.var), F.col(b).alias(n)), x.var, "left"))

    def kind(self, x: Value, name: str) -> str:
        kinds = {self.declared.get((x.kind, t, name), "value") for t in x.types or ["?"]}
        return kinds.pop() if len(kinds) == 1 else "value"

    def typed(self, x: Value, name: str, raw: Column) -> Value:
        """A VALUE column by the kind that all possible types of the entity declare."""
        kind = self.kind(x, name)
        return Value(kind, number(raw) if kind == "double" else raw if kind == "value" else raw[_FIELDS[kind]])

    def attribute(self, x: Value, name: str, at: Column | None = None) -> Value:
        if x.kind == "event":
            def join(df, n):
                if (brought := brought_value(df, x.var, name)) is not None:
                    # of a typed value only fields are read, so that the others are not carried
                    return df.withColumn(n, brought if self.kind(x, name) != "value" else F.when(brought["kind"].isNotNull(), brought))
                values = self.log.event_attr.filter(F.col("name") == name).groupBy(F.col("ev_id").alias(x.var)).agg(F.min("value").alias(n))
                return df.join(values, x.var, "left")

            return self.typed(x, name, self.ask(("attr", x.var, name), join))
        versions = self.log.object_attr.filter(F.col("name") == name)
        if at is None:
            def join(df, n):
                return df.join(versions.groupBy(F.col("ob_id").alias(x.var)).agg(F.min_by("value", F.struct("ordinal", "ts")).alias(n)), x.var, "left")

            return self.typed(x, name, self.ask(("attr", x.var, name), join))

        def as_of(df, n):
            df = df.withColumn(f"{n}at", at)
            found = latest_at(df, [], versions.withColumnRenamed("ob_id", x.var), x.var, f"{n}at", F.struct(F.col("value").alias("v"))).select(x.var, f"{n}at", F.col("latest.v").alias(n))
            return df.join(found, [x.var, f"{n}at"], "left")

        return self.typed(x, name, self.ask(("attrAt", x.var, name, str(at)), as_of))

    def attributes(self, x: Value) -> Value:
        """A list of [name, value, time]; events' attributes have no time."""
        if x.kind == "event":
            rows = self.log.event_attr.select(F.col("ev_id").alias(x.var), "name", "value", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("ordinal"))
        else:
            rows = self.log.object_attr.select(F.col("ob_id").alias(x.var), "name", "value", "ts", "ordinal")

        def join(df, n):
            lists = rows.groupBy(x.var).agg(F.array_sort(F.collect_list(F.struct("name", "ordinal", "ts", "value"))).alias(n))  # the attributes of one entity
            return df.join(lists, x.var, "left")

        return Value("list", F.coalesce(self.ask(("attrs", x.var), join), F.array()), of="attribute")

    def total(self, kind: str) -> Value:
        source = self.log.event if kind == "event" else self.log.object
        return Value("int", self.ask(("total", kind), lambda df, n: df.crossJoin(F.broadcast(source.agg(F.count(F.lit(1)).alias(n))))))  # one row


@dataclass
class Rows:
    """A list whose elements are rows of a frame: a child's bindings, or all events or objects."""

    df: DataFrame | None
    frame: Frame
    names: dict[str, Value]  #: what names mean in an expression over its rows
    item: Value
    aggregates: dict[str, tuple[Column, Column]] = field(default_factory=dict)

    def summary(self, keys: list[Column]) -> DataFrame:
        """The aggregates by the parent's variables, one row without any."""
        return self.frame.joined(self.df).groupBy(*keys).agg(*[e.alias(n) for n, (e, _) in self.aggregates.items()])


def entities(frame: Frame, types: dict[str, list[str] | None], columns: dict[str, str] | None = None) -> dict[str, Value]:
    """Variables as entities of a frame, under their own or other columns."""
    return {v: Value("event" if v[0] == "e" else "object", F.col((columns or {}).get(v, v)), var=(columns or {}).get(v, v), types=t, frame=frame) for v, t in types.items()}


def _number(x: Value) -> Column:
    if x.kind == "value":
        return number(x.col)
    if x.kind == "null":
        return F.lit(None).cast("double")
    if x.kind not in ("int", "double", "duration"):
        raise ValueError(f"a number is expected, not a {x.kind}")
    return x.col


def _as_float(x: Value) -> Column:
    """As sums count: numbers and texts of numbers; others are 0."""
    if x.kind in ("int", "double"):
        c = x.col.cast("double")
    elif x.kind == "value":
        c = F.coalesce(number(x.col), x.col["s"].try_cast("double"))
    elif x.kind == "string":
        c = x.col.try_cast("double")
    else:
        c = F.lit(0.0)
    return F.coalesce(c, F.lit(0.0))


def _alike(a: Value, b: Value) -> tuple[Column, Column, str]:
    """Both sides as one kind."""
    if a.kind == b.kind and a.kind != "value":
        return a.col, b.col, a.kind
    for x, y in ((a, b), (b, a)):
        if x.kind == "null":
            kind = y.kind if y.kind in _SPARK else "string"
            none = F.lit(None).cast(_SPARK[kind])
            return (none, y.col, kind) if x is a else (y.col, none, kind)
    if {a.kind, b.kind} <= {"int", "double", "value"}:
        return _number(a).cast("double"), _number(b).cast("double"), "double"
    if "value" in (a.kind, b.kind):
        kind = b.kind if a.kind == "value" else a.kind
        if kind in _FIELDS:
            pick = lambda x: x.col[_FIELDS[kind]] if x.kind == "value" else x.col
            return pick(a), pick(b), kind
    if {a.kind, b.kind} <= {"event", "object", "string"}:
        return a.col, b.col, "string"
    raise ValueError(f"a {a.kind} cannot be compared with a {b.kind}")


def _seconds(us: Column) -> Column:
    """Seconds of microseconds as text, without trailing zeros."""
    rest = F.regexp_replace(F.lpad((us % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    return F.concat(F.floor(us / 1_000_000).cast("string"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))


def _text(x: Value) -> Column:
    if x.kind == "duration":
        us = F.abs(x.col)
        hours, minutes = F.floor(us / 3_600_000_000), F.floor(us % 3_600_000_000 / 60_000_000)
        lead = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"))).otherwise(F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.lit("")))
        return F.concat(F.when(x.col < 0, "-").otherwise(F.lit("")), lead, _seconds(us % 60_000_000), F.lit("s"))
    if x.kind == "time":
        rest = F.regexp_replace(F.date_format(x.col, "SSSSSS"), "0+$", "")
        return F.concat(F.date_format(x.col, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("+00:00"))
    if x.kind == "value":
        return F.coalesce(x.col["s"], x.col["i"].cast("string"), x.col["f"].cast("string"), x.col["b"].cast("string"), _text(Value("time", x.col["t"])))
    return x.col.cast("string")


def label_column(x: Value) -> tuple[Column, str]:
    """A label's column and its kind from then on."""
    if x.kind == "duration":
        us = F.abs(x.col)
        return F.when(x.col == 0, "P0D").otherwise(F.concat(F.when(x.col < 0, "-").otherwise(F.lit("")), F.lit("PT"), _seconds(us), F.lit("S"))), "string"
    if x.kind == "time":
        return _text(x), "string"
    if x.kind in ("list", "map", "rows", "null"):
        return F.lit(None).cast("string"), "string"
    return x.col, "string" if x.kind in ("event", "object") else x.kind


_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "µs": 1, "ns": 0.001}


def microseconds(text: str) -> int:
    """A duration such as ``1h30m`` or ``-2.5s``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|µs|ns|m|s)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("+-") or not parts:
        raise ValueError(f"{text!r} is no duration")
    return round(sum(float(a) * _UNITS[b] for a, b in parts)) * (-1 if text[0] == "-" else 1)


class Expressions:
    """Compiles expressions over one frame; ``rows`` are the lists in scope by name."""

    def __init__(self, frame: Frame, names: dict[str, Value], rows: dict[str, Rows] | None = None):
        self.frame, self.names, self.rows = frame, names, rows or {}
        self.whole = {f"{kind}s": self._whole(kind) for kind in ("event", "object")}

    def _whole(self, kind: str) -> Rows:
        frame = Frame(self.frame.log, self.frame.declared, f"{kind}s")
        log, var = self.frame.log, "e0" if kind == "event" else "o0"
        df = log.event.select(F.col("ev_id").alias(var), F.col("ev_time").alias(f"{var}_time")) if kind == "event" else log.object.select(F.col("ob_id").alias(var))
        return Rows(df, frame, {}, entities(frame, {var: None})[var])

    def compile(self, text: str) -> Value:
        try:
            return self.of(parse(text), self.names)
        except ValueError as e:
            raise ValueError(f"{e} (in {text!r})") from e

    def predicate(self, text: str) -> Column:
        x = self.compile(text)
        if x.kind not in ("bool", "value"):
            raise ValueError(f"{text!r} is no yes-or-no expression")
        return F.coalesce(x.col if x.kind == "bool" else x.col["b"], F.lit(False))

    def joined(self, df: DataFrame) -> DataFrame:
        """The frame with attributes, totals and aggregates of the whole log."""
        df = self.frame.joined(df)
        for rows in self.whole.values():
            if rows.aggregates:
                df = df.crossJoin(F.broadcast(rows.summary([])))  # one row
        return df

    # -- nodes
    def of(self, node: tuple, names: dict[str, Value]) -> Value:
        kind, *rest = node
        if kind == "literal":
            return self.literal(rest[0])
        if kind == "name":
            return self.name(rest[0], names)
        if kind == "list":
            items = [self.of(x, names) for x in rest[0]]
            return self.array(items)
        if kind == "map":
            return Value("map", fields={self.constant(k): self.of(v, names) for k, v in rest[0]})
        if kind == "index":
            return self.index(self.of(rest[0], names), rest[1], names)
        if kind == "choice":
            test, yes, no = (self.of(x, names) for x in rest)
            a, b, kind = _alike(yes, no) if not (yes.kind == no.kind == "value") else (yes.col, no.col, "value")
            return Value(kind, F.when(test.col, a).otherwise(b))
        if kind == "not":
            return Value("bool", ~self.of(rest[0], names).col)
        if kind == "minus":
            x = self.of(rest[0], names)
            return Value("double" if x.kind == "value" else x.kind, -_number(x))
        if kind == "call":
            return self.call(*rest, names)
        return self.operator(kind, self.of(rest[0], names), self.of(rest[1], names))

    def literal(self, x: Any) -> Value:
        kinds = {bool: "bool", int: "int", float: "double", str: "string", type(None): "null"}
        kind = kinds[type(x)]
        return Value(kind, F.lit(x).cast(_SPARK[kind]))

    def constant(self, node: tuple) -> Any:
        if node[0] != "literal":
            raise ValueError("a constant is expected here")
        return node[1]

    def name(self, name: str, names: dict[str, Value]) -> Value:
        if name in names:
            return names[name]
        if name in self.rows:
            return Value("rows", var=name, item=self.rows[name].item, when=F.lit(True))
        if name == "now":
            return Value("time", F.current_timestamp().cast("timestamp_ntz"))
        raise ValueError(f"nothing is named {name}")

    def array(self, items: list[Value]) -> Value:
        if not items:
            return Value("list", F.array(), of="null")
        kind = items[0].kind
        if any(x.kind != kind for x in items):
            if not all(x.kind in ("int", "double") for x in items):
                raise ValueError("the elements of a list are of one kind")
            kind = "double"
        return Value("list", F.array(*[x.col.cast(_SPARK[kind]) if kind in _SPARK else x.col for x in items]), of=kind)

    def index(self, x: Value, key: tuple, names: dict[str, Value]) -> Value:
        if x.kind == "map":
            key = self.constant(key)
            if key not in x.fields:
                raise ValueError(f"there is no {key!r}")
            return x.fields[key]
        if x.kind == "attribute":
            part, kind = (("name", "string"), ("value", "value"), ("ts", "time"))[self.constant(key)]
            return Value(kind, x.col[part])
        if x.kind == "list":
            return Value(x.of, F.get(x.col, self.of(key, names).col.cast("int")))
        raise ValueError(f"a {x.kind} has no elements")

    def operator(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            pick = lambda x: x.col["b"] if x.kind == "value" else x.col
            return Value("bool", pick(a) & pick(b) if op == "&&" else pick(a) | pick(b))
        if op in ("==", "!="):
            if a.kind == b.kind == "value":
                same = F.coalesce(number(a.col) == number(b.col), a.col.eqNullSafe(b.col))
            elif "null" in (a.kind, b.kind):
                x = b if a.kind == "null" else a
                same = (x.col["kind"].isNull() | (x.col["kind"] == "null")) if x.kind == "value" else x.col.isNull()
            elif a.kind in ("event", "object") and b.kind in ("event", "object") and a.kind != b.kind:
                same = F.lit(False)
            else:
                left, right, _ = _alike(a, b)
                same = left.eqNullSafe(right)
            return Value("bool", same if op == "==" else ~same)
        if op in ("<", "<=", ">", ">="):
            left, right, _ = _alike(a, b)
            return Value("bool", {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op])
        if op == "in":
            return self.contains(b, a)
        return self.arithmetic(op, a, b)

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        pair = (a.kind, b.kind)
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        moment = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
        if op == "+" and "string" in pair and set(pair) <= {"string", "value"}:
            left, right, _ = _alike(a, b)
            return Value("string", F.concat(left, right))
        if op == "+" and pair == ("list", "list"):
            return Value("list", F.concat(a.col, b.col), of=a.of if a.of != "null" else b.of)
        if op == "-" and pair == ("time", "time"):
            return Value("duration", micros(a.col) - micros(b.col))
        if pair == ("time", "duration") and op in "+-":
            return Value("time", moment(micros(a.col) + b.col if op == "+" else micros(a.col) - b.col))
        if op == "+" and pair == ("duration", "time"):
            return Value("time", moment(a.col + micros(b.col)))
        if pair == ("duration", "duration") and op in "+-":
            return Value("duration", a.col + b.col if op == "+" else a.col - b.col)
        left, right = _number(a), _number(b)
        if pair == ("int", "int"):
            return Value("int", {"+": left + right, "-": left - right, "*": left * right, "/": F.call_function("div", left, right), "%": left % right}[op])
        if not set(pair) <= {"int", "double", "value"}:
            raise ValueError(f"{op} does not work on a {a.kind} and a {b.kind}")
        left, right = left.cast("double"), right.cast("double")
        endless = F.when((left == 0) | F.isnan(left), float("nan")).when(left > 0, float("inf")).otherwise(float("-inf"))
        ratio = F.when(right == 0, F.when(left.isNotNull(), endless)).otherwise(left / F.nullif(right, F.lit(0.0)))
        return Value("double", {"+": left + right, "-": left - right, "*": left * right, "/": ratio, "%": left % F.nullif(right, F.lit(0.0))}[op])

    # -- functions
    def call(self, name: str, target: tuple | None, args: list[tuple], names: dict[str, Value]) -> Value:
        if name in ("numEvents", "numObjects"):
            return self.frame.total("event" if name == "numEvents" else "object")
        if name in ("events", "objects"):
            return Value("rows", var=name, item=self.whole[name].item, when=F.lit(True))
        if name == "has":
            kind, x, key = args[0]
            x = self.of(x, names)
            if kind != "index" or x.kind != "map":
                raise ValueError("has() asks for a field of a map")
            return Value("bool", F.lit(self.constant(key) in x.fields))
        if name in ("duration", "timestamp"):
            x = self.constant(args[0]) if args[0][0] == "literal" else None
            if name == "timestamp":
                x = Value("string", F.lit(x)) if x is not None else self.of(args[0], names)
                return x if x.kind == "time" else Value("time", F.to_utc_timestamp(F.regexp_replace(x.col, r"(Z|[+-]\d\d:\d\d)$", "").cast("timestamp_ntz"), F.coalesce(F.nullif(F.regexp_extract(x.col, r"([+-]\d\d:\d\d)$", 1), F.lit("")), F.lit("+00:00"))).cast("timestamp_ntz"))
            return Value("duration", F.lit(microseconds(x)).cast("long"))
        first = self.of(target, names) if target is not None else None
        if name in ("map", "filter", "all", "exists", "exists_one"):
            return self.quantified(name, first, args[0][1], args[1], names)
        values = ([first] if first is not None else []) + [self.of(a, names) for a in args]
        x = values[0]
        if x.kind in ("event", "object") and name in ("id", "type", "time", "attr", "attrAt", "attrs"):
            return self.entity(name, x, args, values)
        if name == "size":
            return self.size(x)
        if name == "contains":
            return self.contains(x, values[1])
        if name in ("sum", "avg", "min", "max"):
            return self.folded(name, values)
        if name in ("startsWith", "endsWith", "matches"):
            test = {"startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[name]
            pick = lambda v: v.col["s"] if v.kind == "value" else v.col
            return Value("bool", test(pick(x), pick(values[1])))
        if name == "string":
            return Value("string", _text(x))
        if name in ("double", "int", "uint"):
            kind = "double" if name == "double" else "int"
            c = _text(x) if x.kind in ("value", "string") else x.col
            if name != "double" and x.kind in ("value", "string", "double"):
                c = c.cast("double") if x.kind != "double" else c
            return Value(kind, c.cast(_SPARK[kind]))
        raise ValueError(f"there is no function {name}")

    def entity(self, name: str, x: Value, args: list[tuple], values: list[Value]) -> Value:
        if name == "id":
            return Value("string", x.col)
        if name == "type":
            return Value("string", x.frame.type_of(x))
        if name == "time":
            if x.kind != "event":
                raise ValueError("only events have a time")
            return Value("time", F.col(f"{x.var}_time"))
        if name == "attrs":
            return x.frame.attributes(x)
        return x.frame.attribute(x, self.constant(args[0]), values[2].col if name == "attrAt" else None)

    def element(self, x: Value, col: Column) -> Value:
        return Value(x.of, col)

    def quantified(self, name: str, x: Value, var: str, body: tuple, names: dict[str, Value]) -> Value:
        if x.kind == "rows":
            rows = self.rows.get(x.var) or self.whole[x.var]
            inner = Expressions.__new__(Expressions)
            inner.frame, inner.names, inner.rows, inner.whole = rows.frame, rows.names, {}, {}
            got = inner.of(body, {**rows.names, **{n: v for n, v in names.items() if n not in self.names}, var: x.item})
            if name == "map":
                return Value("rows", var=x.var, item=got, when=x.when)
            test = F.coalesce(got.col, F.lit(False))
            if name == "filter":
                return Value("rows", var=x.var, item=x.item, when=x.when & test)
            if name == "all":
                return Value("bool", self.aggregate(x, F.bool_and(~x.when | test), F.lit(True)))
            n = F.count(F.when(x.when & test, 1))
            return Value("bool", self.aggregate(x, n > 0 if name == "exists" else n == 1, F.lit(False)))
        if x.kind != "list":
            raise ValueError(f"{name} works on lists")
        kinds: list[Value] = []

        def inner_of(c: Column) -> Column:
            kinds.append(self.of(body, {**names, var: self.element(x, c)}))
            return kinds[-1].col

        if name == "map":
            return Value("list", F.transform(x.col, inner_of), of=kinds[-1].kind if kinds else "null")
        test = lambda c: F.coalesce(inner_of(c), F.lit(False))
        if name == "filter":
            return Value("list", F.filter(x.col, test), of=x.of)
        if name == "exists_one":
            return Value("bool", F.size(F.filter(x.col, test)) == 1)
        return Value("bool", F.forall(x.col, test) if name == "all" else F.exists(x.col, test))

    def aggregate(self, x: Value, e: Column, empty: Column) -> Column:
        """A column that an aggregate of a list's rows will fill."""
        rows = self.rows.get(x.var) or self.whole[x.var]
        name = f"{x.var}#agg{len(rows.aggregates)}"
        rows.aggregates[name] = (e, empty)
        return F.coalesce(F.col(f"`{name}`"), empty)

    def size(self, x: Value) -> Value:
        if x.kind == "rows":
            return Value("int", self.aggregate(x, F.count(F.when(x.when, 1)), F.lit(0).cast("long")))
        if x.kind == "map":
            return Value("int", F.lit(len(x.fields)).cast("long"))
        return Value("int", (F.size(x.col) if x.kind == "list" else F.length(x.col["s"] if x.kind == "value" else x.col)).cast("long"))

    def contains(self, x: Value, what: Value) -> Value:
        if x.kind == "rows":
            return Value("bool", self.aggregate(x, F.count(F.when(x.when & self.operator("==", x.item, what).col, 1)) > 0, F.lit(False)))
        if x.kind == "list":
            return Value("bool", F.exists(x.col, lambda c: self.operator("==", self.element(x, c), what).col))
        if x.kind == "map":
            return Value("bool", what.col.isin(list(x.fields)))
        return Value("bool", F.contains(x.col["s"] if x.kind == "value" else x.col, what.col["s"] if what.kind == "value" else what.col))

    def folded(self, name: str, values: list[Value]) -> Value:
        x = values[0]
        if name in ("min", "max") and len(values) > 1:
            one = self.array(values)
            return Value(one.of, (F.array_min if name == "min" else F.array_max)(one.col))
        if x.kind == "rows":
            if name in ("sum", "avg"):
                some = F.when(x.when, _as_float(x.item))
                total = F.sum(some)
                return Value("double", self.aggregate(x, total if name == "sum" else total / F.nullif(F.count(some), F.lit(0)), F.lit(0.0 if name == "sum" else float("nan"))))
            kind = "double" if x.item.kind == "value" else x.item.kind
            c = number(x.item.col) if x.item.kind == "value" else x.item.col
            return Value(kind, self.aggregate(x, (F.min if name == "min" else F.max)(F.when(x.when, c)), F.lit(None).cast(_SPARK.get(kind, "string"))))
        if x.kind != "list":
            return x  # the least of one value
        if name in ("min", "max"):
            return Value(x.of, (F.array_min if name == "min" else F.array_max)(x.col))
        total = F.aggregate(F.transform(x.col, lambda c: _as_float(self.element(x, c))), F.lit(0.0), lambda a, b: a + b)
        return Value("double", total if name == "sum" else F.when(F.size(x.col) == 0, float("nan")).otherwise(total / F.nullif(F.size(x.col), F.lit(0))))

