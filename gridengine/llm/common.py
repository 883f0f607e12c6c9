"""Shared pieces of the training-data operators: word splitting, the shared work folder, Arrow helpers.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; those separators are exactly the white space of
``bytes.split()``, so texts are split as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word, for Spark's own functions.
WORD = r"[^\x20\x09-\x0D]+"
#: DuckDB: the list of a text's words.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
REPO = str(Path(__file__).resolve().parents[2])


def session(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where the driver got it from a path of its own."""
    env = spark.sparkContext.environment
    if REPO not in (path := env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridengine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts lineage (a lost executor costs no recomputation of what came before). After a job of some length the JVM is
    asked to collect its garbage, so that the shuffle files behind ``df`` are removed early. The files go when the
    application ends, or by ``discard``.
    """
    spark, began = df.sparkSession, time.monotonic()
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    schema = df.schema
    del df
    if time.monotonic() - began > 4:
        gc.collect()
        jvm.System.gc()
    found = spark.read.schema(schema).parquet(at)
    found._stored_at = at
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_table(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under the names ``id`` and ``text``; so no other column can clash."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *(docs[c].alias(c) for c in more))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through ``f``. Python workers outlive their tasks, several to an executor, so each task ends by giving back what it freed."""
    session(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def ids64(words: list[bytes], seen: dict[bytes, int], limit: int = 200_000) -> np.ndarray:
    """A 64-bit id of each word's content. ``seen`` saves work and is emptied when it has ``limit`` entries."""
    from xxhash import xxh64_intdigest

    try:
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(seen) > limit:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = xxh64_intdigest(w, 7)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def sliding_sums(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each run of ``width`` entries of ``x``, by doubling."""
    out, done, rest, first = None, 0, width, True
    power, have, mult = x, 1, np.uint64(base)
    while rest:
        if rest & 1:
            if first:
                out, done, first = power, have, False
            else:
                n = len(x) - done - have + 1
                out = out[:n] * _power(base, have) + power[done : done + n]
                done += have
        rest >>= 1
        if rest:
            n = len(power) - have
            power = power[: max(n, 0)] * _power(base, have) + power[have : have + max(n, 0)]
            have *= 2
    return out


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit hashes, so that their order is random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
