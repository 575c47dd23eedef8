"""Log filtering by a query tree's INCLUDED and EXCLUDED marks.

Without any variable marked INCLUDED everything starts included.  Kept is what is
included and not excluded; a relation is kept if both ends are, it is
included, and it is not excluded.  Gates carry no marks.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log
from ..plans.evaluate import evaluate
from ..plans.tree import Box, Tree


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return None if out is None else out.distinct()


def filter_log(tree: Tree, log: Log) -> Log:
    frames = evaluate(tree, log)
    # each marked frame is read once per mark: kept, so that its tree is evaluated once
    frames = {i: f.persist() if isinstance(tree.nodes[i], Box) and (tree.nodes[i].marks or any(x.get("filterLabel") in ("INCLUDED", "EXCLUDED") for x in tree.nodes[i].filters)) else f for i, f in frames.items()}
    marked: dict[tuple[str, str], list[DataFrame]] = {}
    relations: dict[tuple[str, str, bool], list[DataFrame]] = {}
    for i, node in enumerate(tree.nodes):
        if not isinstance(node, Box):
            continue
        for var, mark in node.marks.items():
            kind = "event" if var[0] == "e" else "object"
            marked.setdefault((kind, mark), []).append(frames[i].select(F.col(var).alias("ev_id" if kind == "event" else "ob_id")))
        for f in node.filters:
            mark = f.get("filterLabel")
            if f["type"] not in ("O2E", "O2O") or mark not in ("INCLUDED", "EXCLUDED"):
                continue
            kind = "e2o" if f["type"] == "O2E" else "o2o"
            ends = (f["event"], f["object"]) if kind == "e2o" else (f["object"], f["other_object"])
            names = ("ev_id", "ob_id") if kind == "e2o" else ("src_id", "dst_id")
            pairs = frames[i].select(*[F.col(v).alias(n) for v, n in zip(ends, names, strict=True)], F.lit(f.get("qualifier")).cast("string").alias("wanted"))
            relations.setdefault((kind, mark, f.get("qualifier") is not None), []).append(pairs)
    everything = not any(mark == "INCLUDED" for _, mark in marked)

    ids = {(kind, mark): _union(frames_) for (kind, mark), frames_ in marked.items()}

    def kept(df: DataFrame, kind: str, column: str) -> DataFrame:
        """Rows whose event or object stays; ends of relations exist, so their ids alone decide."""
        key = "ev_id" if kind == "event" else "ob_id"
        included, excluded = ids.get((kind, "INCLUDED")), ids.get((kind, "EXCLUDED"))
        if not everything:
            df = df.join(included.withColumnRenamed(key, column), column, "left_semi") if included is not None else df.filter(F.lit(False))
        return df.join(excluded.withColumnRenamed(key, column), column, "left_anti") if excluded is not None else df

    parts = {"event": [("event", "ev_id")], "event_attr": [("event", "ev_id")], "object": [("object", "ob_id")], "object_attr": [("object", "ob_id")], "e2o": [("event", "ev_id"), ("object", "ob_id")], "o2o": [("object", "src_id"), ("object", "dst_id")]}
    out = log
    for name, ends in parts.items():
        df = getattr(log, name)
        for kind, column in ends:
            df = kept(df, kind, column)
        out = replace(out, **{name: df.select(*getattr(log, name).columns)})
    for kind, (a, b) in (("e2o", ("ev_id", "ob_id")), ("o2o", ("src_id", "dst_id"))):
        df = getattr(out, kind)
        for mark, how in (("INCLUDED", "left_semi"), ("EXCLUDED", "left_anti")):
            plain, qualified = (_union(relations.get((kind, mark, q), [])) for q in (False, True))
            keys = {False: [a, b], True: [a, b, "qualifier"]}
            marks = {q: p.select(a, b, *([F.col("wanted").alias("qualifier")] if q else [])).distinct() for q, p in ((False, plain), (True, qualified)) if p is not None}
            if how == "left_anti" or len(marks) == 1:
                for q, p in marks.items():
                    df = df.join(p, keys[q], how)
                df = df.select(*getattr(log, kind).columns)
            elif marks:  # included by either: two equi-joins
                df = df.join(marks[False].withColumn("_any", F.lit(True)), keys[False], "left").join(marks[True].withColumn("_this", F.lit(True)), keys[True], "left").filter("_any or _this").select(*getattr(log, kind).columns)
            elif mark == "INCLUDED" and not everything:
                df = df.filter(F.lit(False))
        out = replace(out, **{kind: df})
    return out
