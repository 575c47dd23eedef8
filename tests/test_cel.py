"""The expression language: values, errors and durations."""

import pytest
from pyspark.sql import functions as F

from tests.fixtures import small_log
from trailweave.functions.cel import Cel, Expressions, Frame, declared_kinds, entities, microseconds, parse
from trailweave.plans.evaluate import evaluate
from trailweave.plans.tree import Box, from_json
from trailweave.queries.trees import o2e, tree


@pytest.fixture(scope="module")
def log(spark):
    return small_log(spark).persist()


def value(log, text):
    frame = Frame(log, declared_kinds(log), "t")
    x = Expressions(frame, {})
    v = x.compile(text)
    row = x.joined(log.spark.range(1)).select(v.col.alias("v")).first()
    return row["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-7 / 2", -3), ("7 % 3", 1), ("1.5 + 1", 2.5), ("2 > 1 ? 'a' : 'b'", "a"), ("'a' + \"b\\n\"", "ab\n"), ("r'\\d'", "\\d"), ("1 == 1.0", True), ("null == null", True), ("null == 1", False), ("1 != null", True), ("true || false && false", True), ("!(1 in [2, 3])", True), ("size([])", 0),
        ("[1, 2, 3].exists_one(x, x > 2)", True), ("[[1, 2], [3]].map(l, l.size()).sum()", 3.0), ("['1.5', 'x', '2'].sum()", 3.5), ("duration('1h') > duration('59m59s')", True), ("string(timestamp('2024-01-02T03:04:05.5Z'))", "2024-01-02T03:04:05.5+00:00"), ("timestamp('2024-01-02T03:00:00+02:00') == timestamp('2024-01-02T01:00:00Z')", True),
        ("string(timestamp('2024-01-02T00:00:00Z') - timestamp('2024-01-01T22:58:57.25Z'))", "1h1m2.75s"), ("{'k': {'m': 3}}.k.m", 3), ("int('12') + int(2.9)", 14), ("0.0 / 0.0 == 0.0", False), ("numEvents() * 10 + numObjects()", 63), ("events().map(e, e.id()).contains('e6')", True), ("objects().filter(o, o.type() == 'item').size()", 1), ("max(2, 5, 3)", 5), ("min(7)", 7), ("'abc'.contains('b') && 'abc'.startsWith('a') && 'abc'.endsWith('c') && 'abc'.matches('^a.c$')", True),
    ],
)
def test_values(log, text, want):
    assert value(log, text) == want


@pytest.mark.parametrize("text", ["1 +", "1 2", "nobody", "f(1)", "'a' < 1", "[1, 'a']", "@", "duration('x')", "(1", "{'a': 1}.b"])
def test_errors(log, text):
    with pytest.raises(ValueError):
        value(log, text)


def test_binding_strength():
    assert parse("a || b && c == 1 + 2 * -3") == ("||", ("name", "a"), ("&&", ("name", "b"), ("==", ("name", "c"), ("+", ("literal", 1), ("*", ("literal", 2), ("minus", ("literal", 3)))))))


def test_durations():
    assert microseconds("1h30m") == 5_400_000_000 and microseconds("-1.5s") == -1_500_000 and microseconds("2ms") == 2000


def test_a_predicate_is_a_yes_or_no(log):
    with pytest.raises(ValueError):
        evaluate(tree(Box(objects={"o1": ["order"]}, filters=[{"type": "BasicFilterCEL", "cel": "1 + 1"}])), log)


def test_attributes_of_unknown_kind(log):
    frame = Frame(log, {}, "t")
    x = Expressions(frame, entities(frame, {"e1": ["place"]}))
    p = x.predicate("e1.attr('amount') > 50 && e1.attr('amount') + 1 == 101.0")
    df = log.event.select(F.col("ev_id").alias("e1"), F.col("ev_time").alias("e1_time"))
    assert [r["e1"] for r in x.joined(df).filter(p).collect()] == ["e1"]


def test_wire_labels_and_hidden_variables(log):
    text = """{"nodes":[{"Box":[{"newEventVars":{},"newObjectVars":{"0":["order"]},"filters":[],"sizeFilters":[{"type":"AdvancedCEL","cel":"A.size() > 1"}],"constraints":[],
      "labels":[{"label":"n","cel":"A.filter(a, a.o1.id() != o1.id()).size()"}]},[1]]},{"Box":[{"newEventVars":{},"newObjectVars":{"0":["order","item"]},"filters":[],"sizeFilters":[],"constraints":[]},[]]}],"edgeNames":[[[0,1],"A"]]}"""
    assert sorted((r["o1"], r["n"]) for r in evaluate(from_json(text), log)[0].collect()) == [("o1", 2), ("o2", 2)]


def test_child_lists_of_no_rows(log):
    t = tree(Box(objects={"o1": ["order"]}, labels=[("n", Cel("A.size()")), ("s", Cel("A.map(a, 1).sum()")), ("m", Cel("max(A.map(a, a.e1.time()))"))], children=[1]), Box(events={"e1": ["pay"]}, filters=[o2e("o1", "e1")]), _0_1="A")
    assert {r["o1"]: (r["n"], r["s"], r["m"]) for r in evaluate(t, log)[0].collect()} == {"o1": (1, 1.0, "2024-01-03T00:00:00+00:00"), "o2": (0, 0.0, None)}
