"""Several books: links by formulas, shared names, columns that share values, and what the whole looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up
from ..plans.tables import written
from ..sources.schema import value_text
from .graph import links
from .rangejoin import containing


def shared_names(ws) -> DataFrame:
    """(name_lc, name, uses): defined names with two definitions or more, in any case, over all books, in order."""
    n = ws.names.join(ws.books.select("book", "book_ord"), "book")
    each = n.groupBy("name_lc", "book", "book_ord", "name_ord", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("target_ord", "target"))), lambda x: x["target"]).alias("ranges"))
    per = each.groupBy("name_lc").agg(
        F.min_by("name", F.struct("book_ord", "name_ord")).alias("name"),
        F.transform(F.array_sort(F.collect_list(F.struct("book_ord", "name_ord", F.struct("book", "ranges").alias("u")))), lambda x: x["u"]).alias("uses"),
        F.min(F.struct("book_ord", "name_ord")).alias("first"),
    )
    return per.where(F.size("uses") >= 2)


def column_values(ws) -> DataFrame:
    """(book, book_ord, sheet_lc, region_id, range_a1, col, column, value, first): different values of key and text columns, trimmed, in lower case.

    Columns with 2 to 1000 different texts, or that are their region's key. Subtotal rows count, as they do not hold keys of their own.
    """
    r = ws.regions.select("book", "sheet_lc", "box", "region_id", "range_a1", F.col("data_start_row").alias("r0"), F.col("data_end_row").alias("r1"), F.explode("columns").alias("c"))
    r = r.select("book", "sheet_lc", "box", "region_id", "range_a1", "r0", "r1", F.col("c.col").alias("c0"), F.col("c.col").alias("c1"), F.coalesce("c.header", "c.letter").alias("column"), F.col("c.is_key").alias("is_key"), F.col("c.type").alias("of"), F.col("c.distinct").alias("distinct"), F.col("c.non_empty").alias("non_empty"))
    text = F.when(F.col("type") == "date", F.date_format("ts", "yyyy-MM-dd")).otherwise(value_text())
    cells = ws.cells.withColumn("value", F.lower(F.trim(text))).where("value is not null").select("book", "sheet_lc", "row", "col", "value")
    found = containing(cells, r.where("is_key or (of = 'string' and distinct >= 2 and non_empty >= 2)"))
    return found.groupBy("book", "sheet_lc", "box", "region_id", "range_a1", "col", "column", "is_key", "distinct", "value").agg(F.min("row").alias("first"))


def data_links(ws, min_overlap: float = 0.5, max_distinct: int = 1000) -> DataFrame:
    """Pairs of columns on different sheets that share at least two values and cover enough of one of them.

    An inverted index: columns meet at a value. A value that very many columns hold gives a row per pair of them, as it must;
    columns are few (regions by columns), values are pre-aggregated per column.
    """
    values = column_values(ws).where(F.col("is_key") | (F.col("distinct") <= max_distinct))
    values = values.join(ws.books.select("book", "book_ord"), "book").join(ws.sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"])
    own = ["book", "book_ord", "sheet_lc", "sheet_idx", "box", "region_id", "range_a1", "col", "column"]
    values = written(values, "column-values")
    sizes = values.groupBy(*own).agg(F.count("*").alias("size")).where("size >= 2")
    place = F.struct("book_ord", "sheet_idx", "box", "col")
    kept = values.join(sizes, own).withColumn("place", place)
    side = lambda s: kept.select("value", *(F.col(c).alias(f"{s}_{c}") for c in [*own, "size", "first", "place"]))
    pairs = side("a").join(side("b"), "value").where("a_place < b_place and not (a_book = b_book and a_sheet_lc = b_sheet_lc)")
    keep = [f"{s}_{c}" for s in "ab" for c in ("book", "region_id", "range_a1", "column", "size", "place")]
    small = F.when(F.col("a_size") <= F.col("b_size"), F.col("a_first")).otherwise(F.col("b_first"))
    shared = pairs.groupBy(*keep).agg(F.count("*").alias("shared"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct(small.alias("at"), "value"))), lambda x: x["value"]), 1, 3).alias("sample"))
    cover = lambda s: F.col("shared") / F.col(f"{s}_size")
    out = shared.where((F.col("shared") >= 2) & (F.greatest(cover("a"), cover("b")) >= min_overlap))
    return out.select(*(f"{s}_{c}" for s in "ab" for c in ("book", "region_id", "range_a1", "column")), "shared", half_up(cover("a"), 2).alias("coverage_a"), half_up(cover("b"), 2).alias("coverage_b"), "sample", "a_place", "b_place")


def link_groups(ws) -> DataFrame:
    """Formula links by book and named book: how many, the first five cells and targets."""
    place = F.struct("book_ord", "sheet_idx", "ord", "ref_ord")
    rows = links(ws).withColumn("at", place).withColumn("cell", F.concat(F.lit("["), "from_book", F.lit("]"), "from_cell"))
    key = ["from_book", F.lower("external").alias("external_lc")]

    def five(column: str, name: str) -> DataFrame:
        few = rows.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.min("at").alias("at"))
        k = F.row_number().over(Window.partitionBy("from_book", "external_lc").orderBy("at"))
        few = few.withColumn("k", k).where("k <= 5").groupBy("from_book", "external_lc")
        return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", column))), lambda x: x[column]).alias(name))

    out = rows.groupBy(*key).agg(F.min_by("external", "at").alias("external"), F.min_by("to_book", "at").alias("to_book"), F.count("*").alias("ref_count"), F.min("at").alias("first"))
    return out.join(five("cell", "cells"), ["from_book", "external_lc"], "left").join(five("to_range", "targets"), ["from_book", "external_lc"], "left")


def unresolved(ws) -> DataFrame:
    """Books that formulas name but that are not loaded: how many references, from which books, the first three cells."""
    rows = links(ws).where("to_book is null").withColumn("at", F.struct("book_ord", "sheet_idx", "ord", "ref_ord")).withColumn("cell", F.concat(F.lit("["), "from_book", F.lit("]"), "from_cell"))
    key = F.lower("external").alias("external_lc")
    out = rows.groupBy(key).agg(F.min_by("external", "at").alias("external"), F.count("*").alias("ref_count"), F.min("at").alias("first"))
    books = rows.groupBy(key, "from_book").agg(F.min("at").alias("at")).groupBy("external_lc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "from_book"))), lambda x: x["from_book"]).alias("from_books"))
    place = F.row_number().over(Window.partitionBy("external_lc").orderBy("at"))
    cells = rows.groupBy(key, "cell").agg(F.min("at").alias("at")).withColumn("k", place).where("k <= 3").groupBy("external_lc").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cell"))), lambda x: x["cell"]).alias("cells"))
    return out.join(books, "external_lc").join(cells, "external_lc")


def book_stats(ws) -> DataFrame:
    """A row per book: sheets, hidden sheets, cells, formulas, regions."""
    from .search import sheet_stats

    s = sheet_stats(ws).groupBy("book").agg(F.count("*").alias("sheets"), F.count_if("hidden").alias("hidden_sheets"), F.sum("cell_count").alias("cells"), F.sum("formula_cell_count").alias("formula_cells"))
    r = ws.regions.groupBy("book").agg(F.count("*").alias("regions"))
    return ws.books.select("book", "book_ord").join(s, "book", "left").join(r, "book", "left").fillna(0)


def overview(ws) -> dict:
    """Everything about the links between books, as one answer."""
    rows = lambda df, *order: [r.asDict(True) for r in df.orderBy(*order).collect()]
    lost = rows(unresolved(ws), "first")
    return {
        "workbooks": rows(book_stats(ws), "book_ord"),
        "formulaLinks": rows(link_groups(ws), "first"),
        "sharedNames": rows(shared_names(ws), "first"),
        "dataLinks": rows(data_links(ws), F.desc("shared"), "a_place", "b_place"),
        "unresolved": lost,
        "warnings": [f'External workbook "{u["external"]}" is referenced {u["ref_count"]}× but not loaded into the collection' for u in lost],
    }
