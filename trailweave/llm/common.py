"""Helpers shared by the corpus operators: scratch tables, sizes, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trailweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared scratch folder that can be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back (cuts lineage)."""
    return Scratch(spark).keep(df)


def join_by_rank(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row per key with its number ``n`` of ``total`` rows in ``left``.

    Keys of a thousandth of the rows or more (at most a thousand keys) are joined by broadcast, so none of
    them meets in one task; the others by shuffle.
    """
    often = F.col("n") >= max(1000, total // 1000)
    hot = F.broadcast(right.filter(often).drop("n"))
    return left.join(hot, key).unionByName(left.join(F.broadcast(right.filter(often).select(key)), key, "left_anti").join(right.filter(~often).drop("n"), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with too few splits for the cores at hand (small tables in one row group), dealt out evenly; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``row`` (the other input columns as a struct), ``id``, ``body`` (UTF-8 bytes) and ``absent`` (null text).

    Keeping the input row in one struct lets operators add columns without name clashes.
    """
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        text_or_empty(text_col).cast("binary").alias("body"),
        F.col(text_col).isNull().alias("absent"),
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[bytes]], list[dict]]], fields: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """``row``, ``id``, ``absent`` and ``fields`` for each text; ``make()`` gives each task its worker for lists of UTF-8 bodies.

    No shuffle: rows stay in their partitions, and a worker sees about 4 MB of text at a time.
    """
    source = packed(df, id_col, text_col)
    found = T.StructType([T.StructField(n, t) for n, t, _ in fields])
    kind = pa.struct([(n, t) for n, _, t in fields])
    schema = T.StructType([source.schema["row"], source.schema["id"], source.schema["absent"], T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, "body"):
            out = pa.array(work(batch.column("body").to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("absent"), out], ["row", "id", "absent", "found"])

    return source.mapInArrow(run, schema).select("row", "id", "absent", "found.*")


def replaced_text(df: DataFrame, out: DataFrame, text_col: str, new_text: Column) -> DataFrame:
    """The input's columns, in order, with ``new_text`` as the text and ``n_chars`` (if it is a column) after it."""
    new = out.select("row", F.when(~F.col("absent"), new_text).alias("new_text"))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            columns.append(F.length("new_text").cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return new.select(*columns)
