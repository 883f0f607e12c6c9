"""Looking at cells: sheets, search, inspection, overview and sheet maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import col_letter, format_cell, format_range
from ..plans.tables import written
from ..sources.schema import value_json, value_text
from . import graph
from .rangejoin import containing


def sheet_stats(ws) -> DataFrame:
    """A row per sheet: extent, counts and used range, which always starts at A1."""
    n = ws.cells.groupBy("book", "sheet_lc").agg(F.count("*").alias("cell_count"), F.count("formula").alias("formula_cell_count"))
    out = ws.sheets.join(n, ["book", "sheet_lc"], "left").fillna(0, ["cell_count", "formula_cell_count"])
    used = F.when(F.col("cell_count") > 0, F.concat(F.lit("A1:"), col_letter(F.col("max_col")), F.col("max_row").cast("string")))
    return out.select("book", "sheet", "sheet_idx", "hidden", F.col("max_row").alias("row_count"), F.col("max_col").alias("col_count"), "cell_count", "formula_cell_count", used.alias("used_range"))


def matches(query: str | int | float, regex: bool = False) -> Column:
    """Whether a cell's value matches: a text is part of it in any case, a number equals it, a pattern is found in it."""
    shown = F.coalesce(value_text(), F.lit(""))
    if regex:
        return shown.rlike(str(query))
    if isinstance(query, (int, float)) and not isinstance(query, bool):
        return (F.col("type") == "number") & (F.abs(F.col("num") - float(query)) < 1e-9)
    return F.contains(F.lower(shown), F.lit(str(query).lower()))


def find(ws, query: str | int | float, sheet: str | None = None, book: str | None = None, limit: int | None = 50, regex: bool = False) -> DataFrame:
    """(book, address, value, type, region_id) of matching cells in order of books, sheets and cells.

    The limit is the feature: the first hits in that order. Only hits meet the regions.
    """
    cells = ws.cells
    if book:
        cells = cells.where(F.lower("book") == book.lower())
    if sheet:
        cells = cells.where(F.col("sheet_lc") == sheet.lower())
    hits = cells.where(matches(query, regex)).join(ws.sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"]).join(ws.books.select("book", "book_ord"), "book")
    order = ["book_ord", "sheet_idx", "ord"]
    hits = hits.orderBy(*order).limit(limit) if limit is not None else hits
    ranges = ws.regions.select("book", "sheet_lc", "region_id", "r0", "c0", "r1", "c1")
    place = ["book", "sheet_lc", "row", "col"]
    own = containing(hits.select(*place), ranges).groupBy(*place).agg(F.min_by("region_id", F.struct("r0", "c0")).alias("region_id"))
    out = hits.join(own, place, "left").orderBy(*order)
    return out.select("book", format_cell(F.col("row"), F.col("col"), F.col("sheet")).alias("address"), value_json().alias("value"), "type", "region_id", *order)


def region_of(ws, points: DataFrame) -> DataFrame:
    """``points`` (book, sheet_lc, row, col, ...) with region_id of the first region that holds them, null for none."""
    place = ["book", "sheet_lc", "row", "col"]
    ranges = ws.regions.select("book", "sheet_lc", "region_id", "r0", "c0", "r1", "c1")
    own = containing(points.select(*place).distinct(), ranges).groupBy(*place).agg(F.min_by("region_id", F.struct("r0", "c0")).alias("region_id"))
    return points.join(own, place, "left")


def names_containing(ws, points: DataFrame) -> DataFrame:
    """(the point, names array): defined names any of whose ranges holds the point, in order of definition."""
    place = ["book", "sheet_lc", "row", "col"]
    ranges = ws.names.where("r0 is not null and external is null").select("book", F.lower("sheet").alias("sheet_lc"), "name", "name_ord", "r0", "c0", "r1", "c1")
    found = containing(points.select(*place).distinct(), ranges).select(*place, "name", "name_ord").distinct().groupBy(*place)
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("name_ord", "name"))), lambda x: x["name"]).alias("names"))


def inspect(ws, points: DataFrame, across: bool = False) -> DataFrame:
    """A row per point (book, sheet, sheet_lc, row, col): its cell if any, merge, region, precedents, first 20 readers, names.

    ``across``: and all readers in other books, as long as there are such.
    """
    place = ["book", "sheet_lc", "row", "col"]
    values = ws.cells.withColumn("value", value_json()).select(*place, "value", "type", "formula", "bold", "italic", "num_fmt", "fill", "hyperlink", F.lit(True).alias("exists"))
    out = points.join(values, place, "left").join(ws.sheets.select("book", "sheet_lc", "hidden"), ["book", "sheet_lc"], "left")
    inside = containing(points, ws.merges.select("book", "sheet_lc", "m_ord", "r0", "c0", "r1", "c1"))
    first = inside.groupBy(*place).agg(F.min_by(F.struct("r0", "c0", "r1", "c1"), "m_ord").alias("m"))
    master = ws.cells.withColumn("master_value", value_json()).select("book", "sheet_lc", F.col("row").alias("m_r"), F.col("col").alias("m_c"), "master_value")
    merged = first.withColumns({"m_r": F.col("m.r0"), "m_c": F.col("m.c0")}).join(master, ["book", "sheet_lc", "m_r", "m_c"], "left").drop("m_r", "m_c")
    out = region_of(ws, out.join(merged, place, "left")).join(names_containing(ws, points), place, "left")
    resolved = graph._last_names(ws.names).where("r0 is not null")
    told = format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), F.col("sheet"))
    resolved = resolved.groupBy("book", F.col("name_lc").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_ord", told.alias("t")))), lambda x: x["t"]), ", ").alias("by_name"))
    refs = ws.edges.join(points.select(*place), place, "left_semi").withColumn("k", F.when(F.col("kind") == "name", F.lower("name"))).join(resolved, ["book", "k"], "left")
    target = F.coalesce(F.when(F.col("r0").isNotNull(), format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), F.col("t_sheet"))), F.col("by_name"))
    refs = refs.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", F.struct("raw", "kind", target.alias("target"), "external").alias("p")))), lambda x: x["p"]).alias("precedents"))
    found = written(graph.readers(ws, points.select(*place).distinct(), across), "readers")
    reader = format_cell(F.col("d_row"), F.col("d_col"), F.col("d_sheet"))
    near = F.col("d_book") == F.col("book")
    listed = lambda by, a, name: F.transform(F.array_sort(F.collect_list(F.struct(by, a.alias("a")))), lambda x: x["a"]).alias(name)
    few = graph.foremost(found.where(near), 20).groupBy(*place).agg(listed("rank", reader, "dependents"))
    far = found.where(~near).groupBy(*place).agg(listed("first", F.concat(F.lit("["), "d_book", F.lit("]"), reader), "cross_dependents"))
    totals = found.where(near).groupBy(*place).agg(F.count("*").alias("dependents_total"))
    for part in (refs, few, totals, far):
        out = out.join(part, place, "left")
    return out.select(
        "book", format_cell(F.col("row"), F.col("col"), F.col("sheet")).alias("address"), F.coalesce("exists", F.lit(False)).alias("exists"), F.col("hidden").alias("sheet_hidden"), F.coalesce("value", F.lit("null")).alias("value"),
        F.coalesce("type", F.lit("empty")).alias("type"), "formula", "bold", "italic", "num_fmt", "fill", "hyperlink",
        F.when(F.col("m").isNotNull(), F.struct(
            format_range(F.col("m.r0"), F.col("m.c0"), F.col("m.r1"), F.col("m.c1"), F.col("sheet")).alias("range"), format_cell(F.col("m.r0"), F.col("m.c0"), F.col("sheet")).alias("master"), F.coalesce("master_value", F.lit("null")).alias("value"),
        )).alias("merged"), "region_id", "precedents", F.coalesce("dependents", F.array().cast("array<string>")).alias("dependents"), F.coalesce("dependents_total", F.lit(0)).alias("dependents_total"),
        F.coalesce("cross_dependents", F.array().cast("array<string>")).alias("cross_dependents"), F.coalesce("names", F.array().cast("array<string>")).alias("names"),
    )


BRIEF = ["region_id", "range_a1", "kind", "title", "row_count", "col_count", "confidence"]


def overview(ws) -> DataFrame:
    """A row per book: its sheets with their regions in order, names, totals, other books and warnings."""
    briefs = ws.regions.groupBy("book", "sheet_lc").agg(F.transform(F.array_sort(F.collect_list(F.struct("r0", "c0", F.struct(*BRIEF).alias("b")))), lambda x: x["b"]).alias("regions"))
    stats = sheet_stats(ws).withColumn("sheet_lc", F.lower("sheet")).join(briefs, ["book", "sheet_lc"], "left")
    fields = ["sheet_idx", "sheet", "hidden", "row_count", "col_count", "cell_count", "formula_cell_count", "used_range", "regions"]
    out = stats.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["sheet_idx"] - b["sheet_idx"]).alias("sheets"), F.sum("cell_count").alias("cells"), F.sum("formula_cell_count").alias("formula_cells"))
    names = ws.names.groupBy("book", "name_ord", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("target_ord", "target"))), lambda x: x["target"]).alias("ranges"))
    names = names.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("name_ord", F.struct("name", "ranges").alias("n")))), lambda x: x["n"]).alias("names"))
    from .edges import external_books

    said = ws.warnings.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("w_ord", "message"))), lambda x: x["message"]).alias("warnings"))
    return out.join(names, "book", "left").join(external_books(ws.edges, ws.sheets), "book", "left").join(said, "book", "left")


def sheet_map(ws) -> DataFrame:
    """A row per sheet: its regions at a glance, up to three purposes, and the lines of its notes."""
    from .regions import note_lines

    lines = note_lines(ws.regions, ws.cells).groupBy("book", "sheet_lc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("box", "lines"))), lambda x: x["lines"])).alias("notes"))
    groups = F.when(F.col("sections").isNotNull(), F.size(F.filter("sections", lambda s: s["kind"] == "group")))
    glance = F.struct(
        "r0", "c0", "region_id", "range_a1", "kind", "purpose", "title", F.slice("headers", 1, 10).alias("headers"), F.col("data_rows").alias("rows"), F.col("col_count").alias("cols"), groups.alias("sections"),
        (F.coalesce(F.size("notes"), F.lit(0)) > 0).alias("has_notes"), "confidence",
    )
    per = ws.regions.groupBy("book", "sheet_lc").agg(
        F.array_sort(F.collect_list(glance), lambda a, b: F.when(a["r0"] != b["r0"], a["r0"] - b["r0"]).otherwise(a["c0"] - b["c0"])).alias("regions")
    )
    useful = F.filter("regions", lambda r: (r["kind"] != "notes") & r["purpose"].isNotNull())
    purposes = F.slice(F.array_distinct(F.transform(useful, lambda r: r["purpose"])), 1, 3)
    out = sheet_stats(ws).withColumn("sheet_lc", F.lower("sheet")).join(per, ["book", "sheet_lc"], "left").join(lines, ["book", "sheet_lc"], "left")
    return out.select("book", "sheet", "sheet_idx", "hidden", "used_range", F.when(F.size(purposes) > 0, F.array_join(purposes, " · ")).alias("purpose"), "regions", "notes")
