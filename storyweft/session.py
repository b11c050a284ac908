"""Sessions, and the cut of a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", name: str = "storyweft") -> SparkSession:
    """A session for tests and single machines; on a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A session on one machine that
    names none, as in tests, gets one of its own; on a cluster there is no substitute."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: rows are worked out once, a checkpoint does so twice."""
    folder = scratch(df.sparkSession, "tables")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """df with consecutive numbers from 0 in the given order. Rows are sorted by ranges, numbered
    inside each, and moved on by the rows of the ranges before: no task sees all rows."""
    order = order or ("id",)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    size = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ahead = size.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_row", inside).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_row") - 1).drop("_part", "_row", "_ahead")


def with_running(df: DataFrame, order: tuple[str, ...], value: Column, name: str, including: bool = True) -> DataFrame:
    """df with a running sum, minimum or maximum (value: F.sum(..), F.min(..) or F.max(..)) in the
    given order, of all rows up to a row, itself included or not. Rows are dealt into ranges, run
    inside each, and joined with what the ranges before come to: no task sees all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = value._jc.toString().split("(")[0]
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    whole = placed.groupBy("_part").agg(value.alias("_all"))
    again = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ahead = whole.select("_part", again("_all").over(before).alias("_ahead"))
    here = value.over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if including else -1))
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[kind]
    rows = placed.withColumn("_here", here).join(F.broadcast(ahead), "_part")
    return rows.withColumn(name, both(F.col("_ahead"), F.col("_here"))).drop("_part", "_here", "_ahead")
