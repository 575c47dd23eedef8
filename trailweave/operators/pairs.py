"""Equi-joins that form many pairs to a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1000  #: rows of a key that meet as one
FEW = 50_000  #: keys that a plan may hold


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame | None:
    """``left`` joined with ``right`` by ``on`` where keys have more than ``BLOCK`` right rows; None where none has.

    A look at ``right`` counts the rows of its keys.  A key's right rows are dealt to blocks of about
    ``BLOCK``, and its left rows go to each of them: however few the keys are, no task gets all pairs
    of one, and what is dealt is a thousandth of the pairs.  A block is one row, which is taken apart
    where the pairs go on.
    """
    counted = right.filter(F.col(on).isNotNull()).groupBy(on).count().filter(F.col("count") > BLOCK).select(on, F.ceil(F.col("count") / BLOCK).alias("_parts"))
    found = counted.limit(FEW + 1).toArrow()
    if not found.num_rows:
        return None
    held = F.broadcast(left.sparkSession.createDataFrame(found)) if found.num_rows <= FEW else counted
    conf, sc = left.sparkSession.conf, left.sparkSession.sparkContext
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 16 * sc.defaultParallelism)
    names = lambda df: [f"`{c}`" for c in df.columns if c != on]
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(held, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = right.join(held, on, "left").withColumn("_part", F.pmod(F.xxhash64(on, *names(right)), parts))
    blocks = blocks.repartition(tasks, on, "_part").groupBy(on, "_part").agg(F.collect_list(F.struct(*names(right))).alias("_rows"))
    met = dealt.repartition(tasks, on, "_part").join(blocks, [on, "_part"])
    return met.select(on, *names(left), F.inline("_rows"))
