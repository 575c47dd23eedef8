"""Query trees: boxes of variables, filters, child-set filters, labels and constraints.

A tree is a list of nodes; a node is a ``Box`` with children, or a gate
(``Gate``) over children.  ``edges`` names the edge from a parent to a child.
``from_json`` reads the interchange format of such trees.  Expressions are CEL (``Cel``, or
``cel`` in a filter) or Spark SQL text over the columns in scope (``sql``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..functions.cel import Cel


@dataclass
class Box:
    events: dict[str, list[str]] = field(default_factory=dict)
    objects: dict[str, list[str]] = field(default_factory=dict)
    filters: list[dict[str, Any]] = field(default_factory=list)
    size_filters: list[dict[str, Any]] = field(default_factory=list)
    constraints: list[dict[str, Any]] = field(default_factory=list)
    labels: list[tuple[str, str]] = field(default_factory=list)
    attributes: list[dict[str, Any]] = field(default_factory=list)  #: {var, name, kind, as, at?}: columns for expressions
    marks: dict[str, str] = field(default_factory=dict)  #: variable: INCLUDED or EXCLUDED, for log filtering
    children: list[int] = field(default_factory=list)

    @property
    def variables(self) -> list[str]:
        return [*self.objects, *self.events]


@dataclass
class Gate:
    kind: str  #: OR, AND or NOT
    children: list[int]


@dataclass
class Tree:
    nodes: list[Box | Gate]
    edges: dict[tuple[int, int], str] = field(default_factory=dict)

    def name(self, parent: int, child: int) -> str:
        return self.edges.get((parent, child), f"UNNAMED - {child}")

    def box(self, at: int) -> Box:
        """The node as a box; a gate is a box without variables and one constraint."""
        node = self.nodes[at]
        if isinstance(node, Box):
            return node
        return Box(constraints=[{"type": node.kind, "child_names": [self.name(at, c) for c in node.children]}], children=node.children)

    def roots(self) -> list[int]:
        below = {c for n in self.nodes for c in n.children}
        return [i for i in range(len(self.nodes)) if i not in below]

    def validate(self) -> None:
        for i, node in enumerate(self.nodes):
            names = [self.name(i, c) for c in node.children]
            if len(set(names)) < len(names):
                raise ValueError(f"node {i} has two children under one name")
            if any(not 0 <= c < len(self.nodes) for c in node.children):
                raise ValueError(f"node {i} names a child that does not exist")
        parents: dict[int, int] = {}
        for i, node in enumerate(self.nodes):
            for c in node.children:
                if c in parents or c == i:
                    raise ValueError(f"node {c} has two parents")
                parents[c] = i
        if len(self.nodes) and not self.roots():
            raise ValueError("the tree has no root")


def _variable(tagged: dict[str, int]) -> str:
    (kind, n), = tagged.items()
    return f"{'e' if kind == 'Event' else 'o'}{n + 1}"


_EVENTS = {"event", "from_event", "to_event"}
_OBJECTS = {"object", "other_object"}


def _filter_in(f: dict[str, Any]) -> dict[str, Any]:
    out = dict(f)
    for key in f:
        if key in _EVENTS and f[key] is not None:
            out[key] = f"e{f[key] + 1}"
        elif key in _OBJECTS and f[key] is not None:
            out[key] = f"o{f[key] + 1}"
        elif key in ("var_1", "var_2", "var_name") and isinstance(f[key], dict):
            out[key] = _variable(f[key])
        elif key == "at_time" and isinstance(f[key], dict) and f[key].get("event") is not None:
            out[key] = {**f[key], "event": f"e{f[key]['event'] + 1}"}
        elif key == "child_name_with_var_name":
            out[key] = [[name, _variable(v)] for name, v in f[key]]
        elif key == "filter":
            out[key] = _filter_in(f[key])
    return out


def from_json(text: str | dict[str, Any]) -> Tree:
    """A tree from its interchange form (camelCase keys, tagged nodes and filters)."""
    raw = json.loads(text) if isinstance(text, str) else text
    nodes: list[Box | Gate] = []
    for node in raw["nodes"]:
        (kind, body), = node.items()
        if kind != "Box":
            nodes.append(Gate(kind, body if isinstance(body, list) else [body]))
            continue
        box, children = body
        nodes.append(
            Box(
                events={f"e{int(n) + 1}": sorted(t) for n, t in box.get("newEventVars", {}).items()},
                objects={f"o{int(n) + 1}": sorted(t) for n, t in box.get("newObjectVars", {}).items()},
                filters=[_filter_in(f) for f in box.get("filters", [])],
                size_filters=[_filter_in(f) for f in box.get("sizeFilters", [])],
                constraints=[_filter_in(c) for c in box.get("constraints", [])],
                labels=[(x["label"], Cel(x["cel"]) if "cel" in x else x["sql"]) for x in box.get("labels", [])],
                attributes=box.get("attributes", []),
                marks={f"{p}{int(n) + 1}": m for p, key in (("e", "evVarLabels"), ("o", "obVarLabels")) for n, m in box.get(key, {}).items() if m != "IGNORED"},
                children=list(children),
            )
        )
    tree = Tree(nodes, {(p, c): name for (p, c), name in raw.get("edgeNames", [])})
    tree.validate()
    return tree
