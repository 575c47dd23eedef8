"""Joins on time: bucketed range join and as-of lookup, as equi-joins that Spark can partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import seconds_between
from .pairs import paired

PARTS = 4  #: buckets to an interval; of more, fewer pairs are looked at in vain and a left row has more copies


def range_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, low: float, high: float) -> DataFrame:
    """Pairs with ``low <= right - left <= high`` seconds.

    Both sides get a bucket a quarter as wide as the interval; a left row goes to the buckets that
    its interval touches, so the join is an equi-join on the bucket.  Pairs may be far more than
    rows: buckets are dealt to a fixed number of tasks, which do not merge where rows are few, and
    full buckets are dealt in blocks; times become microseconds before they meet.
    """
    if high < low:
        return left.join(right, F.lit(False))
    edge = 2**61  # beyond every timestamp, and no sum overflows
    first, last = (int(max(-edge, min(edge, x))) for x in (low * 1e6 - 1, high * 1e6 + 1))
    width = max((last - first) // PARTS, 1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.call_function("div", c - F.pmod(c, F.lit(width).cast("long")), F.lit(width).cast("long"))
    conf, sc = left.sparkSession.conf, left.sparkSession.sparkContext
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)
    start, end = F.col("_start"), F.col("_end")
    dealt = left.withColumn("_start", micros(left_time)).withColumn("_bucket", F.explode(F.sequence(bucket(start + F.lit(first).cast("long")), bucket(start + F.lit(last).cast("long")))))
    met = right.withColumn("_end", micros(right_time)).withColumn("_bucket", bucket(end))
    out = paired(dealt, met, "_bucket")
    if out is None:
        out = dealt.repartition(tasks, "_bucket").join(met.repartition(tasks, "_bucket"), "_bucket")
    return out.filter(((end - start) / 1e6).between(low, high)).drop("_bucket", "_start", "_end")


def latest_at(df: DataFrame, keys: list[str], versions: DataFrame, on: str, time: str, fields: Column) -> DataFrame:
    """``df``'s distinct (keys, on, time) with the version (on, ts, ordinal) in force at ``time`` as ``latest``.

    Ties of ``ts`` go to the higher ordinal.  A row without a version is absent.  Versions and
    times of an object are sorted together, so no pairs are formed.
    """
    names = [*dict.fromkeys([*keys, on, time])]
    wanted = df.select(*names).distinct().filter(F.col(time).isNotNull())
    rows = wanted.select(F.col(on).alias("_on"), F.col(time).alias("_at"), F.lit(None).cast("long").alias("_nth"), F.struct(*names).alias("_row"), F.lit(None).alias("_version"))
    marks = versions.select(F.col(on).alias("_on"), F.col("ts").alias("_at"), F.col("ordinal").cast("long").alias("_nth"), F.lit(None).alias("_row"), F.struct(fields.alias("v")).alias("_version"))
    order = W.partitionBy("_on").orderBy("_at", F.asc_nulls_last("_nth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = marks.unionByName(rows).withColumn("_version", F.last("_version", ignorenulls=True).over(order))
    return found.filter("_row is not null and _version is not null").select("_row.*", F.col("_version.v").alias("latest"))
