"""Tables between plans: written to the shared folder and read back, so that lineage is cut and executors can be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark is local, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridengine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder; its files go when the application ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


#: Rows that a task of a shuffle is meant to get.
ROWS_A_TASK = 400_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over a number of tasks that follows its rows. Spark would choose it by compressed bytes, of which a cell has
    few, and one task would sort millions; a number that is given stays."""
    return df.repartition(tasks, *keys)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the given order, nulls first, without one task that sorts everything.

    Rows are dealt by range and written with their part; parts are counted, and a row's number is what
    comes before its part and its place in the part. Rows that tie in all of ``order`` are numbered in any order.
    """
    part = "__part"
    tasks = tasks_for(df.count())
    dealt = written(df.repartitionByRange(tasks, *order).withColumn(part, F.spark_partition_id()), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = dealt.groupBy(part).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return spread(dealt.join(F.broadcast(parts), part), tasks, part).withColumn(name, F.col("__before") + place).drop(part, "__n", "__before")
