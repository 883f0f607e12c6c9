"""The graph of regions: which refer to which, share names, headers or a sheet. All regions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diffuse import WEIGHTS
from .rangejoin import containing, overlapping

EDGE = ["book", "src", "dst", "type", "weight", "why"]


def _made(df: DataFrame, kind: str, why) -> DataFrame:
    return df.select("book", "src", "dst", F.lit(kind).alias("type"), F.lit(WEIGHTS[kind]).alias("weight"), why.alias("why"))


def formula_edges(ws) -> DataFrame:
    """From a region to another that its formulas refer to, with how many references do."""
    own = ws.regions.select("book", "sheet_lc", F.col("region_id").alias("src"), "r0", "c0", "r1", "c1")
    refs = containing(ws.targets.select("book", "sheet_lc", "row", "col", "t_sheet_lc", F.col("r0").alias("a_r0"), F.col("c0").alias("a_c0"), F.col("r1").alias("a_r1"), F.col("c1").alias("a_c1")), own)
    refs = refs.groupBy("book", "src", F.col("t_sheet_lc").alias("sheet_lc"), "a_r0", "a_c0", "a_r1", "a_c1").agg(F.count("*").alias("n"))
    into = ws.regions.select("book", "sheet_lc", F.col("region_id").alias("dst"), *(F.col(c).alias(f"b_{c}") for c in ("r0", "c0", "r1", "c1")))
    found = overlapping(refs, into).where("src <> dst").groupBy("book", "src", "dst").agg(F.sum("n").alias("n"))
    return _made(found, "formula", F.concat(F.col("n").cast("string"), F.lit(" reference(s)")))


def header_edges(ws, least: int = 2) -> DataFrame:
    """Regions of a book with at least ``least`` headers in common, each pair both ways: regions meet at a header."""
    h = ws.regions.where("headers is not null").select("book", "region_id", F.explode(F.array_distinct(F.transform("headers", lambda x: F.lower(F.trim(x))))).alias("h"))
    a, b = h.withColumnRenamed("region_id", "src"), h.withColumnRenamed("region_id", "dst")
    found = a.join(b, ["book", "h"]).where("src <> dst").groupBy("book", "src", "dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs"))
    return _made(found.where(F.col("n") >= least), "semantic", F.concat(F.lit("shares headers ("), F.array_join(F.slice("hs", 1, 4), ", "), F.lit(")")))


def sheet_edges(ws, gap: int = 3) -> DataFrame:
    """Regions of a sheet, adjacent if they are at most ``gap`` rows and columns apart."""
    side = lambda s: ws.regions.select("book", "sheet_lc", F.col("region_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("r0", "c0", "r1", "c1")))
    pairs = side("src").join(side("dst"), ["book", "sheet_lc"]).where("src <> dst")
    apart = lambda x: F.greatest(f"src_{x}0", f"dst_{x}0") - F.least(f"src_{x}1", f"dst_{x}1")
    near = (apart("r") <= gap) & (apart("c") <= gap)
    return _made(pairs.where(near), "spatial", F.lit("physically adjacent")).unionByName(_made(pairs.where(~near), "sheet", F.lit("on the same sheet")))


def name_edges(ws) -> DataFrame:
    """Regions of a book that a defined name's ranges meet, each pair both ways."""
    n = ws.names.where("r0 is not null and external is null").select("book", F.lower("sheet").alias("sheet_lc"), "name_lc", *(F.col(c).alias(f"a_{c}") for c in ("r0", "c0", "r1", "c1")))
    into = ws.regions.select("book", "sheet_lc", "region_id", *(F.col(c).alias(f"b_{c}") for c in ("r0", "c0", "r1", "c1")))
    met = overlapping(n, into).select("book", "name_lc", "region_id").distinct()
    pairs = met.withColumnRenamed("region_id", "src").join(met.withColumnRenamed("region_id", "dst"), ["book", "name_lc"]).where("src <> dst")
    return _made(pairs, "semantic", F.concat(F.lit('shares defined name "'), "name_lc", F.lit('"')))


def region_edges(ws) -> DataFrame:
    return formula_edges(ws).unionByName(header_edges(ws)).unionByName(sheet_edges(ws)).unionByName(name_edges(ws))
