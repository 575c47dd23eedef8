"""Evaluates a query tree as decorrelated DataFrame plans.

``evaluate(tree, log)`` returns one frame per node: a row per binding, with a
column per variable in scope (and ``{event}_time``), labels, and
``violated``: the index of the first constraint that the binding breaks, or null.

A node extends its parent's distinct bindings by joins, so no child runs per
parent binding.  Child results are aggregated by the parent's variables, which
are a key because bindings form a set; only aggregates that the parent asks for
are built.  Bindings that child-set filters drop take their descendants with them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cel import Cel, Expressions, Frame, Rows, Value, declared_kinds, entities, kind_of, label_column
from ..log import HIDDEN, Log
from ..log import hidden as hidden_column
from ..operators.pairs import paired
from ..operators.temporal import latest_at, range_join
from .predicates import holds, relation, tested, variables
from .tree import Box, Tree

LINKS = ("O2E", "O2O")


def _ends(f: dict[str, Any]) -> tuple[str, str]:
    return f["object"], f["event"] if f["type"] == "O2E" else f["other_object"]


def scan(log: Log, var: str, types: list[str]) -> DataFrame:
    if var[0] == "e":
        return (log.values or log).event.filter(F.col("ev_type").isin(types)).select(F.col("ev_id").alias(var), F.col("ev_time").alias(f"{var}_time"), *log.brought(var))
    return log.object.filter(F.col("ob_type").isin(types)).select(F.col("ob_id").alias(var))


def bind(log: Log, box: Box, df: DataFrame | None, bound: set[str], scope: dict[str, list[str]], watch: Callable[[str, DataFrame], None] | None = None) -> DataFrame | None:
    """The box's variables bound by joins along its relation filters, then its other filters; ``scope`` has the types of all variables."""
    types = {**box.objects, **box.events}
    waiting = [v for v in types if v not in bound]
    filters = list(box.filters)
    degree = lambda v: sum(v in _ends(f) for f in filters if f["type"] in LINKS)

    def apply(df: DataFrame, done: set[str]) -> DataFrame:
        """Filters whose variables are bound: predicates as they are, relations as semi joins."""
        for f in [f for f in filters if f["type"] in (*LINKS, "TimeBetweenEvents", "NotEqual") and variables(f) <= done]:
            filters.remove(f)
            if f["type"] in LINKS:
                df = df.join(relation(log, f, {}, scope).select(*_ends(f)), list(_ends(f)), "left_semi")
            else:
                df, p = tested(df, log, f, scope)
                df = df.filter(holds(p))
        return df

    def doubled(f: dict[str, Any], var: str, done: set[str]) -> bool:
        """Whether the relation has bound a variable like ``var`` before, so that pairs of those are formed."""
        side = _ends(f).index(var)
        return any(g is not f and (g["type"], g.get("qualifier"), _ends(g)[1 - side]) == (f["type"], f.get("qualifier"), _ends(f)[1 - side]) and _ends(g)[side] in done and set(scope[_ends(g)[side]]) & set(types[var]) for g in box.filters if g["type"] in LINKS)

    def linked_to(df: DataFrame | None, f: dict[str, Any], var: str, other: str) -> DataFrame:
        filters.remove(f)
        pairs = relation(log, f, {var: types[var]}, scope)
        if f"{other}_time" in pairs.columns and df is not None:
            pairs = pairs.drop(f"{other}_time")
        return pairs if df is None else df.join(pairs, other)

    done = set(bound)
    if df is not None:
        df = apply(df, done)
    while waiting:
        linked = [(f, v) for f in filters if f["type"] in LINKS for v in _ends(f) if v in waiting and (set(_ends(f)) - {v}) <= done and len(set(_ends(f))) == 2]
        new = []
        if linked and done:
            # pairs of like variables come last, after what hangs on either alone, so that they are never dealt again
            f, var = min(linked, key=lambda x: doubled(*x, done))
            other, = set(_ends(f)) - {var}
            if doubled(f, var, done):
                pairs = linked_to(None, f, var, other)
                for x in [v for v in waiting if v != var]:
                    ties = [g for g in filters if g["type"] in LINKS and x in _ends(g)]
                    if len(ties) == 1 and set(_ends(ties[0])) == {x, var}:
                        pairs = linked_to(pairs, ties[0], x, var)
                        new.append(x)
                pairs = pairs.drop(f"{other}_time")
                met = paired(df, pairs, other)
                df = df.join(pairs, other) if met is None else met
            else:
                df = linked_to(df, f, var, other)
        else:
            gaps = [f for f in filters if f["type"] == "TimeBetweenEvents" and len({f["from_event"], f["to_event"]} & done) == 1 and ({f["from_event"], f["to_event"]} - done) <= set(waiting) and f.get("min_seconds") is not None and f.get("max_seconds") is not None]
            if gaps and df is not None:
                f = gaps[0]
                filters.remove(f)
                var, = {f["from_event"], f["to_event"]} - done
                forward = var == f["to_event"]
                low, high = (f["min_seconds"], f["max_seconds"]) if forward else (-f["max_seconds"], -f["min_seconds"])
                anchor = f["from_event"] if forward else f["to_event"]
                df = range_join(df, scan(log, var, types[var]), f"{anchor}_time", f"{var}_time", low, high)
            else:
                var = max(waiting, key=lambda v: (degree(v), v))
                fresh = scan(log, var, types[var])
                # unrelated variables are a product by definition of the query
                df = fresh if df is None else df.crossJoin(fresh)
        new = [var, *new]
        waiting = [v for v in waiting if v not in new]
        done.update(new)
        df = apply(df, done)
        for v in new if watch else ():
            watch(v, df)
    if df is not None:
        df = with_attributes(df, log, box)
    for f in filters:
        if not variables(f) <= done:
            raise ValueError(f"filter {f['type']} looks at variables that are not bound: {sorted(variables(f) - done)}")
        names = df.columns
        df, p = tested(df, log, f, scope)
        df = df.filter(holds(p)).select(*names)
    return df


def with_attributes(df: DataFrame, log: Log, box: Box) -> DataFrame:
    """Attribute columns that the box declares for its expressions.

    Of an event's values the smallest counts, of an object's versions the first, or the
    one in force at the event named by ``at``.  Missing is null.
    """
    fields = {"string": "s", "integer": "i", "float": "f", "boolean": "b", "time": "t"}
    for a in box.attributes:
        var, name = a["var"], a.get("as", f"{a['var']}_{a['name']}")
        column = F.col("value")[fields[a["kind"]]]
        if (brought := hidden_column(var, a["name"], fields[a["kind"]])) in df.columns:
            # the event first, as after a join
            df = df.select(var, *[F.col(f"`{c}`") for c in df.columns if c != var], F.col(f"`{brought}`").alias(name))
            continue
        if var[0] == "e":
            values = log.event_attr.filter(F.col("name") == a["name"]).groupBy(F.col("ev_id").alias(var)).agg(F.min(column).alias(name))
        else:
            values = log.object_attr.filter(F.col("name") == a["name"])
            if a.get("at"):
                versions = values.withColumnRenamed("ob_id", var)
                values = latest_at(df, [a["at"]], versions, var, f"{a['at']}_time", F.struct(column.alias("v"))).select(var, a["at"], F.col("latest.v").alias(name))
            else:
                values = values.groupBy(F.col("ob_id").alias(var)).agg(F.min_by(column, "ordinal").alias(name))
        df = df.join(values, [c for c in values.columns if c != name], "left")
    return df


@dataclass
class Node:
    at: int
    frame: DataFrame
    keys: list[str]  #: variables in scope, which identify a row
    types: dict[str, list[str]]  #: of those variables


class Evaluation:
    def __init__(self, tree: Tree, log: Log, keep: Callable[[DataFrame], DataFrame] | None = None):
        tree.validate()
        self.tree, self.log = tree, log.naming(repr(tree.nodes))
        #: called on bindings that several plans read; persisted bindings stay until ``catalog.clearCache``
        self.keep = keep or (lambda df: df.persist())
        self.nodes: dict[int, Node] = {}
        self.steps: list[tuple[int, str, DataFrame]] = []  #: node, variable, bindings after it is bound

    def run(self) -> dict[int, DataFrame]:
        for root in self.tree.roots():
            self.node(root, None, [], {})
        return {i: n.frame.select(*[c for c in n.frame.columns if not c.startswith(HIDDEN)]) for i, n in sorted(self.nodes.items())}

    def node(self, at: int, parent: DataFrame | None, keys: list[str], types: dict[str, list[str]]) -> Node:
        box, log = self.tree.box(at), self.log
        # a variable that is bound again hides its parent's, which stays part of the key
        hidden = {v: f"{v}__{at}" for v in box.variables if v in keys}
        if parent is not None:
            for v, name in hidden.items():
                parent = parent.withColumnRenamed(v, name)
                if f"{v}_time" in parent.columns:
                    parent = parent.withColumnRenamed(f"{v}_time", f"{name}_time")
        above = [hidden.get(k, k) for k in keys]
        types = {**{hidden.get(k, k): t for k, t in types.items()}, **box.objects, **box.events}
        df = bind(log, box, parent, set(above), types, lambda var, df: self.steps.append((at, var, df)))
        if df is None:
            df = log.spark.range(1).select(F.lit(1).alias("_root"))
            above = ["_root"] if not above else above
        mine = [*above, *box.variables]
        if len(box.children) > 1:
            df = self.keep(df)
        scope = [c for c in df.columns if c in mine or (c.endswith("_time") and c[:-5] in mine)]
        children = {self.tree.name(at, c): self.node(c, df.select(*scope), mine, types) for c in box.children}
        plain = df.columns
        expressions = self.expressions(at, box, mine, types, children)
        labels: dict[str, tuple[Column, str | None]] = {}
        for label, text in box.labels:
            if isinstance(text, Cel):
                labels[label] = label_column(expressions.compile(text))
                expressions.names[label] = Value(labels[label][1], F.col(f"`{label}`"))
            else:
                labels[label] = (F.expr(text), None)
        tests = {f["cel"]: expressions.predicate(f["cel"]) for f in _tests(box) if f.get("cel")}
        df, left = self.semi_joined(df, box, mine, children)
        df = self.summarised(df, box, mine, children, expressions)
        if expressions:
            df = expressions.joined(df)
        for label, (column, _) in labels.items():
            df = df.withColumn(label, column)
        for f in left:
            df = df.filter(holds(self.size_test(f, children, tests)))
        df, violated = self.violations(df, box, children, types, tests)
        frame = df.withColumn("violated", violated).select(*dict.fromkeys([*plain, *labels]), "violated")
        self.nodes[at] = Node(at, frame, mine, types)
        if box.size_filters and box.children:
            numbers = {n: box.size_filters for n in children if all(f["type"] == "NumChilds" and f["child_name"] == n for f in box.size_filters)}
            self.prune(at, frame, mine, numbers if mine != ["_root"] else {})
        return self.nodes[at]

    def prune(self, at: int, frame: DataFrame, keys: list[str], numbers: dict[str, list[dict[str, Any]]] | None = None) -> None:
        """Descendants of dropped bindings go.

        ``numbers`` has the filters of a box that asks for nothing but the number of one child's bindings:
        those are counted where they are, so that the child is not evaluated once more to be counted.
        """
        for c in self.tree.nodes[at].children:
            node = self.nodes[c]
            names = list(_hidden(keys, node).values())
            if bounds := (numbers or {}).get(self.tree.name(at, c)):
                count, columns, p = f"#n{at}", node.frame.columns, F.lit(True)
                for f in bounds:
                    p = p & (F.col(f"`{count}`") >= f["min"]) if f.get("min") is not None else p
                    p = p & (F.col(f"`{count}`") <= f["max"]) if f.get("max") is not None else p
                node.frame = node.frame.withColumn(count, F.count(F.lit(1)).over(W.partitionBy(*names))).filter(p).select(*columns)
                self.prune(c, node.frame, node.keys)
                continue
            alive = frame.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
            node.frame = node.frame.join(alive, names, "left_semi").select(*node.frame.columns)
            self.prune(c, node.frame, node.keys)

    def expressions(self, at: int, box: Box, keys: list[str], types: dict[str, list[str]], children: dict[str, Node]) -> Expressions | None:
        """What the box's CEL texts compile against: its variables, and its children's bindings as lists."""
        if not any(isinstance(text, Cel) for _, text in box.labels) and not any(f.get("cel") for f in _tests(box)):
            return None
        visible = lambda names: [v for v in names if re.fullmatch(r"[eo]\d+", v)]
        declared, rows = declared_kinds(self.log), {}
        for n, child in children.items():
            inner = Frame(self.log, declared, f"c{at}_{len(rows)}_")
            own, above = _hidden(keys, child), visible(keys)
            fields = {**entities(inner, {v: child.types[v] for v in visible(child.keys)}), "satisfied": Value("bool", F.col("violated").isNull())}
            fields |= {x: Value(kind_of(child.frame.schema[x].dataType), F.col(f"`{x}`")) for x in _labels(child)}
            rows[n] = Rows(child.frame, inner, entities(inner, {v: types[v] for v in above}, {v: own[v] for v in above}), Value("map", fields=fields))
        frame = Frame(self.log, declared, f"n{at}_")
        return Expressions(frame, entities(frame, {v: types[v] for v in visible(keys)}), rows)

    def semi_joined(self, df: DataFrame, box: Box, keys: list[str], children: dict[str, Node]) -> tuple[DataFrame, list[dict[str, Any]]]:
        """Filters that ask for some or for no child binding, as semi and anti joins; and the filters that are left."""
        left = []
        for f in box.size_filters:
            how = {(1, None): "left_semi", (None, 0): "left_anti", (0, 0): "left_anti"}.get((f.get("min"), f.get("max"))) if f["type"] == "NumChilds" else None
            if how is None or f["child_name"] not in children:
                left.append(f)
                continue
            child = children[f["child_name"]]
            df = df.join(child.frame.select(*[F.col(c).alias(k) for k, c in _hidden(keys, child).items()]), keys, how)
        return df, left

    def summarised(self, df: DataFrame, box: Box, keys: list[str], children: dict[str, Node], expressions: Expressions | None) -> DataFrame:
        """``df`` with the aggregates of its children's bindings that the box uses."""
        texts = " ".join([text for _, text in box.labels if not isinstance(text, Cel)] + [f["sql"] for f in _tests(box) if f.get("sql")])
        used = {f.get("child_name") for f in _tests(box)} | {n for c in box.constraints for n in c.get("child_names", ())} | {n for f in _tests(box) for n in f.get("child_names", ())} | {n for f in _tests(box) for n, _ in f.get("child_name_with_var_name", ())}
        for n, child in children.items():
            c, hidden = child.frame, _hidden(keys, child)
            if expressions and expressions.rows[n].aggregates:
                df = df.join(expressions.rows[n].summary([F.col(hidden[k]).alias(k) for k in keys]), keys, "left")
            if n not in used and n not in texts:
                continue
            own = [k for k in child.keys if k not in hidden.values()]
            labels = _labels(child)
            whole = F.struct(*[F.col(x).alias(x) for x in [*child.keys, *labels]])
            wanted: dict[str, Column] = {f"{n}#n": F.count(F.lit(1)), f"{n}#bad": F.count("violated")}
            for f in _tests(box):
                if f["type"] == "NumChildsProj" and f["child_name"] == n:
                    wanted[f"{n}#distinct#{f['var_name']}"] = F.count_distinct(F.col(f["var_name"]))
                elif f["type"] == "BindingSetEqual" and n in f["child_names"]:
                    wanted[f"{n}#set"] = F.array_sort(F.collect_set(whole))
                elif f["type"] == "BindingSetProjectionEqual":
                    for name, var in f["child_name_with_var_name"]:
                        if name == n:
                            v = F.col(var) if var in c.columns else F.lit(None).cast("string")
                            wanted[f"{n}#set#{var}"] = F.array_sort(F.collect_set(F.struct(v.alias("v"))))
            if n in texts:
                times = [x for x in c.columns if x.endswith("_time")]
                item = F.struct(*[F.col(x) for x in dict.fromkeys([*own, *keys_in(c, child.keys), *times, *labels])], F.col("violated").isNull().alias("satisfied"))
                wanted[n] = F.array_sort(F.collect_list(item))
            summary = c.groupBy(*[F.col(hidden[k]).alias(k) for k in keys]).agg(*[e.alias(name) for name, e in wanted.items()])
            df = df.join(summary, keys, "left")
            for name in wanted:
                kind = summary.schema[name].dataType
                df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0) if "array" not in kind.simpleString() else F.from_json(F.lit("[]"), kind)))
        return df

    def size_test(self, f: dict[str, Any], children: dict[str, Node], tests: dict[str, Column]) -> Column:
        kind = f["type"]
        col = lambda name: F.col(f"`{name}`")

        def between(c: Column) -> Column:
            p = F.lit(True)
            p = p & (c >= f["min"]) if f.get("min") is not None else p
            return p & (c <= f["max"]) if f.get("max") is not None else p

        if kind in ("NumChilds", "NumChildsProj"):
            if f["child_name"] not in children:
                return F.lit(False)
            return between(col(f"{f['child_name']}#n" if kind == "NumChilds" else f"{f['child_name']}#distinct#{f['var_name']}"))
        if kind == "BindingSetEqual":
            names = f["child_names"]
            if not all(n in children for n in names):
                return F.lit(False)
            sets = [col(f"{n}#set") for n in names]
            alike = [children[names[0]].keys == children[n].keys for n in names[1:]]
        elif kind == "BindingSetProjectionEqual":
            pairs = f["child_name_with_var_name"]
            if not all(n in children for n, _ in pairs):
                return F.lit(False)
            sets, alike = [col(f"{n}#set#{v}") for n, v in pairs], [True] * (len(pairs) - 1)
        else:
            return F.expr(f["sql"]) if f.get("sql") else tests[f["cel"]]
        p = F.lit(True)
        for s, same in zip(sets[1:], alike, strict=True):
            # sets over different variables are equal only if both are empty
            p = p & ((sets[0] == s) if same else (F.size(sets[0]) == 0) & (F.size(s) == 0))
        return p

    def violations(self, df: DataFrame, box: Box, children: dict[str, Node], types: dict[str, list[str]], tests: dict[str, Column]) -> tuple[DataFrame, Column]:
        """The index of the first constraint that fails."""
        checks = []
        for i, c in enumerate(box.constraints):
            kind = c["type"]
            if kind == "Filter":
                df, p = tested(df, self.log, c["filter"], types)
                ok = holds(p)
            elif kind == "SizeFilter":
                ok = holds(self.size_test(c["filter"], children, tests))
            else:
                ok = self.quantified(kind, c["child_names"], children)
            checks.append(F.when(~ok, i))
        return df, (F.coalesce(*checks) if checks else F.lit(None)).cast("int")

    def quantified(self, kind: str, names: list[str], children: dict[str, Node]) -> Column:
        """SAT, ANY, NOT, OR and AND over named children; a name without a child counts as each kind defines."""
        good = lambda n: F.col(f"`{n}#n`") > F.col(f"`{n}#bad`")
        clean = lambda n: F.col(f"`{n}#bad`") == 0
        test, missing = {"SAT": (clean, False), "ANY": (good, False), "NOT": (good, True), "OR": (clean, True), "AND": (clean, True)}[kind]
        parts = [test(n) if n in children else F.lit(missing) for n in names]
        every, some = F.lit(True), F.lit(False)
        for p in parts:
            every, some = every & p, some | p
        return {"NOT": ~every, "OR": some}.get(kind, every)


def keys_in(df: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def _hidden(keys: list[str], child: Node) -> dict[str, str]:
    """The names under which a child's frame has its parent's variables."""
    return {k: f"{k}__{child.at}" if f"{k}__{child.at}" in child.keys else k for k in keys}


def _labels(node: Node) -> list[str]:
    return [x for x in node.frame.columns if x not in node.keys and x != "violated" and not x.endswith("_time") and not x.startswith(HIDDEN)]


def _tests(box: Box) -> list[dict[str, Any]]:
    """Child-set tests of a box, in filters and constraints."""
    return [*box.size_filters, *(c["filter"] for c in box.constraints if c["type"] == "SizeFilter")]


def evaluate(tree: Tree, log: Log, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, DataFrame]:
    return Evaluation(tree, log, keep).run()


def summary(frames: dict[int, DataFrame]) -> DataFrame:
    """(node, situations, violated) of each node."""
    out = None
    for node, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("situations"), F.count("violated").alias("violated")).select(F.lit(node).alias("node"), "situations", "violated")
        out = row if out is None else out.unionByName(row)
    return out


def page(frame: DataFrame, offset: int, limit: int, violated: bool | None = None) -> DataFrame:
    """Rows of a node in the order of their variables, at most 1000 at once."""
    if not 0 <= limit <= 1000 or offset < 0:
        raise ValueError("a page has an offset of 0 or more and at most 1000 rows")
    if violated is not None:
        frame = frame.filter(F.col("violated").isNotNull() if violated else F.col("violated").isNull())
    return frame.orderBy(*[c for c in frame.columns if c != "violated"]).offset(offset).limit(limit)


def profile(tree: Tree, log: Log) -> DataFrame:
    """(node, step, variable, rows): bindings after each variable of each box is bound."""
    evaluation, out, last = Evaluation(tree, log), None, {}
    evaluation.run()
    for node, var, df in evaluation.steps:
        last[node] = last.get(node, 0) + 1
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(node).alias("node"), F.lit(last[node]).alias("step"), F.lit(var).alias("variable"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def label_bindings(tree: Tree, log: Log, by: list[str], root: int = 0) -> DataFrame:
    """(by…, satisfied): whether no binding of the root under the same values of ``by`` is violated."""
    return evaluate(tree, log)[root].groupBy(*by).agg(F.bool_and(F.col("violated").isNull()).alias("satisfied"))


@dataclass
class Results:
    """Frames of one evaluation under a version, so that a page of an older one is refused."""

    frames: dict[int, DataFrame]
    version: str

    def summary(self) -> DataFrame:
        """(node, situations, violated, skipped, version); nothing is ever skipped."""
        return summary(self.frames).select("*", F.lit(False).alias("skipped"), F.lit(self.version).alias("version"))

    def page(self, version: str, node: int, offset: int, limit: int, violated: bool | None = None) -> DataFrame:
        if version != self.version:
            raise ValueError("the results have changed since")
        return page(self.frames[node], offset, limit, violated)


def results(tree: Tree, log: Log) -> Results:
    return Results(evaluate(tree, log), uuid.uuid4().hex)


__all__ = ["Evaluation", "Results", "evaluate", "label_bindings", "page", "profile", "results", "summary"]
