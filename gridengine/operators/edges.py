"""The reference graph: a row per reference of a formula cell, names resolved, and what is wrong with references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import GRID_ROWS, MAX_ROWS, format_cell
from ..functions.formula import scan_udf

#: Cells of a range up to which it becomes single edges; larger ones stay intervals.
EXPAND = 512
#: Warnings of a book that are kept.
MAX_WARNINGS = 200


def row_limits(sheets: DataFrame) -> DataFrame:
    """(book, max_rows): rows that a book's addresses may name: a file's, or any if one of its sheets is longer than a file's can be."""
    return sheets.groupBy("book").agg(F.when(F.max("max_row") > MAX_ROWS, GRID_ROWS).otherwise(MAX_ROWS).alias("max_rows"))


def scans(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(sheet, formula, max_rows, x): each different formula of a sheet name, scanned once; dealt anew, as few bytes of formulas are much work."""
    different = cells.where("formula is not null").select("book", "sheet", "formula").join(F.broadcast(limits), "book").drop("book").distinct()
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return different.repartition(parts).withColumn("x", scan_udf("formula", "sheet", "max_rows"))


def edges(cells: DataFrame, limits: DataFrame, scanned: DataFrame) -> DataFrame:
    """(book, sheet, sheet_lc, row, col, ord, formula, ref_ord, kind, raw, name, external, t_sheet, t_sheet_lc, r0, c0, r1, c1, open)."""
    own = cells.where("formula is not null").select("book", "sheet", "sheet_lc", "row", "col", "ord", "formula")
    rows = own.join(F.broadcast(limits), "book").join(scanned, ["sheet", "formula", "max_rows"])
    out = rows.select("book", "sheet", "sheet_lc", "row", "col", "ord", "formula", F.explode("x.refs").alias("r"))
    target = F.col("r.sheet")
    return out.select(
        "book", "sheet", "sheet_lc", "row", "col", "ord", "formula", "r.ref_ord", "r.kind", "r.raw", "r.name", "r.external", target.alias("t_sheet"), F.lower(target).alias("t_sheet_lc"), "r.r0", "r.c0", "r.r1", "r.c1", "r.open"
    )


def targets(edges: DataFrame, names: DataFrame, sheets: DataFrame) -> DataFrame:
    """Local target ranges of references, a row each, names replaced by their ranges, open ends cut to the sheet's used extent.

    (the edge's book, sheet, sheet_lc, row, col, ord, ref_ord, raw, kind; t_ord; t_sheet_lc, r0, c0, r1, c1). A range on a sheet that
    the book does not have is left out; of names that repeat, the last definition holds.
    """
    key = ["book", "sheet", "sheet_lc", "row", "col", "ord", "ref_ord", "raw", "kind"]
    plain = edges.where("r0 is not null and external is null").select(*key, F.lit(0).alias("t_ord"), "t_sheet_lc", "r0", "c0", "r1", "c1", "open")
    known = _last_names(names).where("r0 is not null and external is null")
    known = known.select("book", F.col("name_lc").alias("k"), F.col("target_ord").alias("t_ord"), F.lower("sheet").alias("t_sheet_lc"), "r0", "c0", "r1", "c1", "open")
    named = edges.where("kind = 'name' and external is null").select(*key, F.lower("name").alias("k")).join(known, ["book", "k"]).drop("k")
    extent = sheets.select("book", F.col("sheet_lc").alias("t_sheet_lc"), "max_row", "max_col")
    out = plain.unionByName(named).join(extent, ["book", "t_sheet_lc"])
    cut = lambda end, most, start: F.when(F.col("open").isNotNull(), F.least(end, F.greatest(most, start))).otherwise(F.col(end))
    return out.withColumns({"r1": cut("r1", "max_row", "r0"), "c1": cut("c1", "max_col", "c0")}).drop("max_row", "max_col")


def _last_names(names: DataFrame) -> DataFrame:
    last = F.max("name_ord").over(Window.partitionBy("book", "name_lc"))
    return names.withColumn("__last", last).where("name_ord = __last").drop("__last")


def warnings(cells: DataFrame, sheets: DataFrame, names: DataFrame, parsed: DataFrame, edges: DataFrame, limits: DataFrame, scanned: DataFrame) -> DataFrame:
    """(book, w_ord, message): the reader's, then the references', one of each kind, at most ``MAX_WARNINGS`` a book.

    Parser warnings, names and sheets that do not exist with the place that is first in reading order, and other books.
    """
    idx = sheets.select("book", "sheet_lc", "sheet_idx")
    at = F.concat(F.format_string("%09d", "sheet_idx"), F.format_string("%015d", "ord"))
    cell = format_cell(F.col("row"), F.col("col"), F.col("sheet"))
    placed = cells.where("formula is not null").select("book", "sheet", "sheet_lc", "row", "col", "ord", "formula").join(idx, ["book", "sheet_lc"])
    said = placed.join(F.broadcast(limits), "book").join(scanned, ["sheet", "formula", "max_rows"]).select("book", at.alias("at"), cell.alias("cell"), F.explode("x.warnings").alias("w"))
    said = said.select("book", F.col("w").alias("key"), F.concat(F.lit("1"), "at").alias("at"), F.concat("cell", F.lit(": "), "w").alias("message"))
    refs = edges.join(idx, ["book", "sheet_lc"])
    lost = refs.where("kind = 'name'").withColumn("name_lc", F.lower("name")).join(names.select("book", "name_lc").distinct(), ["book", "name_lc"], "left_anti")
    lost = lost.select("book", F.concat(F.lit("undefined-name:"), "name_lc").alias("key"), F.concat(F.lit("1"), at).alias("at"), F.concat(F.lit('Formula(s) reference undefined name "'), "name", F.lit('" (first seen at '), cell, F.lit(")")).alias("message"))
    away = refs.where("external is null and t_sheet is not null").join(sheets.select("book", F.col("sheet_lc").alias("t_sheet_lc")), ["book", "t_sheet_lc"], "left_anti")
    away = away.select("book", F.concat(F.lit("missing-sheet:"), "t_sheet_lc").alias("key"), F.concat(F.lit("1"), at).alias("at"), F.concat(F.lit('Formula(s) reference missing sheet "'), "t_sheet", F.lit('" (first seen at '), cell, F.lit(")")).alias("message"))
    books = external_books(edges, sheets)
    other = books.select("book", F.lit("external-refs").alias("key"), F.lit("2").alias("at"), F.concat(F.lit("Workbook references "), F.size("externals"), F.lit(" external workbook(s): "), F.array_join("externals", ", "), F.lit(" — external values are not loaded")).alias("message"))
    first = parsed.select("book", "key", F.concat(F.lit("0"), F.format_string("%09d", "w_ord")).alias("at"), "message")
    rows = first.unionByName(said).unionByName(lost).unionByName(away).unionByName(other)
    once = rows.groupBy("book", "key").agg(F.min("at").alias("at"), F.min_by("message", "at").alias("message"))
    place = F.row_number().over(Window.partitionBy("book").orderBy("at", "key"))
    return once.withColumn("w_ord", place).where(F.col("w_ord") <= MAX_WARNINGS).select("book", "w_ord", "message")


def external_books(edges: DataFrame, sheets: DataFrame) -> DataFrame:
    """(book, externals): other books that a book's formulas name, in order of first use."""
    refs = edges.where("external is not null").join(sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"])
    first = refs.groupBy("book", "external").agg(F.min(F.struct("sheet_idx", "ord", "ref_ord")).alias("at"))
    return first.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "external"))), lambda x: x["external"]).alias("externals"))
