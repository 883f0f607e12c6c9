"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's documents stand in a fixed order (size class, salt, size, id); each has an expected number of copies,
the prefix sums of which, moved by one random offset per source, cross integers: a document is emitted once per
integer crossed in its step. The prefix sum has two levels, so that a hot source is many window partitions:
rows of (class, salt) parts are added up over the few parts of a source, then counted within a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Weights of the sources, in code point order of their names (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Words of the whole mix, in percent of all words; a source's target stops at CAP times its words.
BUDGET_PERCENT, CAP = 150, 2
#: Parts of a size class; a class spans an eighth of a doubling of the size.
SALTS = 64
#: Bits behind the point of expected copies.
POINT = 24


def _hash32(x: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the budget by weight, none above ``cap``
    times the source's size, the excess reshared by weight until none is above.

    In order of size over weight the capped sources come first; the level is what is left over the weights
    left at the first source that it does not lift above its cap. The windows are over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("source_size") * float(cap) / F.col("weight"))
    left = F.sum("source_size").over(whole) * float(budget_percent) / F.lit(100.0) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(cap)
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rn", "level"))).over(whole)["level"]
    target = F.least(F.col("source_size") * float(cap), F.coalesce(level * F.col("weight"), F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", carry: bool = False, **how) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row of ``docs``; with ``carry`` also ``row``, all its columns.

    Size: words of the text (null: 0). Ties and repeated rows are told apart only by their place in the order,
    which gives equal rows the same copies in total. Null ids and the null source are values like any other. The same input gives the same result.
    """
    bits = F.length(F.bin("size"))
    klass = bits * 8 + F.expr("shiftright(shiftleft(size, 3), length(bin(size)) - 1)") - 8
    rows = docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else [])
    )
    rows = rows.withColumn("class", klass).withColumn("salt", F.pmod(_hash32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(SALTS)))
    rows = stored(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-rows")
    unit = 1 << POINT
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit)).otherwise(0)
    offset = F.shiftright(_hash32(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 32 - POINT)
    aims = targets(rows, **how).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", rate.cast("long").alias("rate"), offset.alias("offset")
    )
    before = F.sum("rows").over(Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("key", "class", "salt").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(before, F.lit(0)))
    parts = stored(parts.join(aims, "key"), "mix-parts")
    place = F.col("before") + F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("size", F.col("id").asc_nulls_last()))
    placed = rows.join(parts.hint("merge"), ["key", "class", "salt"]).withColumn("place", place)  # on the shuffle that the window needs anyway
    copies = F.expr(f"shiftright(offset + place * rate, {POINT}) - shiftright(offset + (place - 1) * rate, {POINT})")
    return placed.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))


def mixed_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every column of ``docs`` and ``copy`` (1, 2, ...), a row per copy; documents with no copy are not in it."""
    rows = with_copies(docs, carry=True, **how).where("copies > 0")
    name = "copy" if "copy" not in docs.columns else "copy_no"
    return rows.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))


def op4_systematic_mix(spark, sf_dir: str) -> DataFrame:
    rows = with_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = rf"""
WITH docs AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 8 + ((size << 3) >> (length(bin(size)) - 1)) - 8 AS class,
         ('0x' || substr(md5(coalesce(CAST(id AS VARCHAR), '')), 1, 8))::BIGINT % {SALTS} AS salt FROM docs
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals
), ratios AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed
), levels AS (
  SELECT *, row_number() OVER o AS rn,
         (sum(source_size) OVER ()::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE - coalesce(sum(source_size) OVER b, 0)::DOUBLE * 2.0::DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, source NULLS LAST), b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, coalesce((SELECT arg_min(level, rn) FROM levels WHERE level <= ratio) * weight, 'infinity'::DOUBLE)) AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {1 << POINT}) ELSE 0 END::BIGINT AS rate,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT >> {32 - POINT} AS start FROM aims
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, id NULLS LAST) AS place FROM classed
)
SELECT p.id AS doc_id, p.size, r.source_size, r.target,
       p.size * (((r.start + p.place * r.rate) >> {POINT}) - ((r.start + (p.place - 1) * r.rate) >> {POINT})) AS taken
FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source
"""
