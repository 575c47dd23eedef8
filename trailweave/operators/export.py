"""Bindings of a query node as a flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log
from ..sources.files import text_of


def binding_table(frame: DataFrame, log: Log, attributes: dict[str, list[str]] | None = None, labels: list[str] | None = None, ids: bool = True, status: bool = True) -> DataFrame:
    """Object columns, then event columns, then labels, then ``Satisfied``.

    ``attributes`` names the attributes of each variable, which become columns ``{var}.{name}`` in
    alphabetical order; of an object's versions the earliest counts.
    """
    out, columns = frame, []
    variables = sorted((c for c in frame.columns if c[0] in "oe" and c[1:].isdigit()), key=lambda v: (v[0] != "o", int(v[1:])))
    for var in variables:
        if ids:
            columns.append(F.col(var))
        for name in sorted((attributes or {}).get(var, [])):
            column = f"{var}.{name}"
            if var[0] == "o":
                cell = log.object_attr.filter(F.col("name") == name).groupBy(F.col("ob_id").alias(var)).agg(F.min_by(text_of(), F.struct("ts", "ordinal")).alias(column))
            else:
                cell = log.event_attr.filter(F.col("name") == name).groupBy(F.col("ev_id").alias(var)).agg(F.min(text_of()).alias(column))
            out = out.join(cell, var, "left")
            columns.append(F.col(f"`{column}`"))
    for label in labels or []:
        columns.append(F.coalesce(F.col(label).cast("string"), F.lit("null")).alias(label))
    if status:
        columns.append(F.col("violated").isNull().alias("Satisfied"))
    return out.select(*columns)


def write_csv(table: DataFrame, path: str, header: bool = True) -> None:
    table.write.mode("errorifexists").csv(path, header=header, escape='"')


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").json(path)
