"""A small log: two orders, an item, and six events."""

from trailweave.log import Log, related, related_objects

VALUE = "struct<kind:string,s:string,i:bigint,f:double,b:boolean,t:timestamp_ntz>"


def number(n):
    return ("integer", None, n, None, None, None)


def text(s):
    return ("string", s, None, None, None, None)


def small_log(spark) -> Log:
    from datetime import datetime as D

    frame = spark.createDataFrame
    event = frame([(f"e{i}", t, D(2024, 1, i)) for i, t in enumerate(("place", "place", "pay", "ship", "ship", "cancel"), 1)], "ev_id string, ev_type string, ev_time timestamp_ntz")
    obj = frame([("o1", "order"), ("o2", "order"), ("i1", "item")], "ob_id string, ob_type string")
    pairs = frame([("e1", "o1", "order"), ("e2", "o2", "order"), ("e3", "o1", "order"), ("e4", "o1", "order"), ("e4", "i1", "item"), ("e5", "o1", "order"), ("e6", "o2", "order")], "ev_id string, ob_id string, qualifier string")
    ea = frame([("e1", "amount", number(100)), ("e2", "amount", number(5))], f"ev_id string, name string, value {VALUE}")
    oa = frame([("o1", "state", D(2024, 1, 1), 0, text("new")), ("o1", "state", D(2024, 1, 4), 1, text("sent")), ("o1", "state", D(2024, 1, 4), 2, text("late"))], f"ob_id string, name string, ts timestamp_ntz, ordinal long, value {VALUE}")
    links = frame([("o1", "i1", "contains")], "src_id string, dst_id string, qualifier string")
    decl = frame([("event", "place", "amount", "integer"), *[("event", t, None, None) for t in ("pay", "ship", "cancel")], ("object", "order", "state", "string"), ("object", "item", None, None)], "scope string, type_name string, attr string, value_type string")
    return Log(event, obj, ea, oa, related(event, obj, pairs), related_objects(obj, links), decl)
