"""Workbooks as they arrive: a file stream that keeps the cell table of each book at its latest file.

Each micro-batch parses its new files; the partition of a book that comes again is replaced as a whole, so a batch that is
run twice leaves the same table. Which file a book's rows are from is kept beside them (``_versions``), so that an older file that arrives late
changes nothing; the rows of a book whose latest file has none are removed. A file stream reads a path once: a book's next version comes under
another path of the folder (``2026-02/plan.xlsx``) with the same file name.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.tables import written
from ..sources.xlsx import TABLES, _batch, workbook_tables


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(path, modificationTime, length, content) of workbooks as they are put in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


def parsed(files: DataFrame, table: str = "cells") -> DataFrame:
    """A table's rows of the files, of a stream or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield _batch(table, workbook_tables(unquote(posixpath.basename(path)), content, [table])[table])

    return files.select("path", "content").mapInArrow(run, TABLES[table])


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, table: str = "cells", trigger: dict | None = None) -> StreamingQuery:
    """Keeps the parquet table ``target``, partitioned by book, up to date with the folder."""

    def upsert(files: DataFrame, _: int) -> None:
        spark, jvm = files.sparkSession, files.sparkSession.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        there = path(f"{target}/_versions").getFileSystem(conf).exists(path(f"{target}/_versions"))
        of = F.struct("modificationTime", "path")
        latest = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.max_by(F.struct("path", "content"), of).alias("f"), F.max(of).alias("version"))
        if there:
            known = spark.read.parquet(f"{target}/_versions").groupBy("name").agg(F.max("version").alias("known"))
            latest = latest.join(known, "name", "left").where("known is null or version >= known")
        rows = written(parsed(latest.select("f.path", "f.content"), table), "ingest")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(target)
        versions = latest.select("name", "version").collect()  # at most the files of a batch
        full = {r.book for r in rows.select("book").distinct().collect()}
        for name in {unquote(v["name"]) for v in versions} - full:
            own = path(f"{target}/book={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}")
            own.getFileSystem(conf).delete(own, True)
        if versions:
            spark.createDataFrame(versions, latest.select("name", "version").schema).write.mode("append").parquet(f"{target}/_versions")

    stream = file_stream(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; a stream drops what comes later than ``late`` after the newest."""
    dated = events.withWatermark(time_col, late) if events.isStreaming else events
    return dated.groupBy(F.window(time_col, window).alias("w"), F.col(kind_col).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
