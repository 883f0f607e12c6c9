"""Queries over whole example workbooks that are written as files to the shared folder and read back: merges, titles, totals, grouped headers, sections,
notes, hidden sheets, names, links between books. Their SQL states what the files are made of.
"""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..operators import collection, extract, graph
from ..sources import workbooks
from .queries import LAYOUTS, _workspace, query
from .tables import shared_dir
from .workspace import Workspace


def _cycle(at) -> None:
    """Cells that refer to one another, a shared formula, and a name."""
    s = workbooks.Sheet("S").put("A1", 1, "B1").put("B1", 1, "A1").row("D1", [1, 2]).put("D2", 2).put("D3", 3)
    s.put("E1", 2, "D1*2", shared=(0, "E1:E3")).put("E2", 4, shared=(0, None)).put("E3", 6, shared=(0, None))
    workbooks.write(at, [s], [("Base", "S!$D$1")])


def _books(spark: SparkSession, sf_dir: str) -> Workspace:
    files: dict[str, io.BytesIO] = {}
    target = lambda name: files.setdefault(name, io.BytesIO())
    workbooks.sample(target("sample.xlsx"))
    workbooks.zoom(target("zoom.xlsx"))
    workbooks.collection(target)
    _cycle(target("cycle.xlsx"))
    folder = f"{shared_dir(spark)}/workbooks-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    for name, data in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(data.getvalue())
        out.close()
    return Workspace.load(spark, [f"{folder}/{name}" for name in files])


LAYOUTS["books"] = _books


def _ws(spark: SparkSession, sf_dir: str) -> Workspace:
    return _workspace(spark, sf_dir, "books")


def _values(columns: str, *rows: tuple) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


@query(
    _values(
        "book, range_a1, kind, title, title_range, header_rows, totals_row, subtotal_rows, hidden_sheet",
        ("sample.xlsx", "Sales!A3:F35", "table", "ACME Q1 Sales", "Sales!A1:F1", "3", 35, None, False),
        ("sample.xlsx", "Sales!H3:I7", "table", None, None, "3", None, None, False),
        ("sample.xlsx", "Rates!A1:B5", "table", None, None, "1", None, None, True),
        ("sample.xlsx", "Summary!B2:C5", "keyValue", None, None, None, None, None, False),
        ("zoom.xlsx", "Spend!A3:E11", "table", "Department Spend", "Spend!A1:E1", "3,4", 11, "7,10", False),
        ("zoom.xlsx", "Spend!A13", "notes", None, None, None, None, None, False),
        ("zoom.xlsx", "RateMap!A1:B3", "table", None, None, "1", None, None, True),
        ("sales-2026.xlsx", "Sales!A1:D15", "table", None, None, "1", 15, None, False),
        ("targets.xlsx", "Targets!A1:B7", "table", None, None, "1", 7, None, False),
        ("summary-2026.xlsx", "Dash!B2:C5", "keyValue", None, None, None, None, None, False),
    )
)
def q_book_regions(spark, sf_dir) -> DataFrame:
    """Titles, detached totals, grouped headers, subtotals, notes and hidden sheets, of all regions of the books with tables."""
    told = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    r = _ws(spark, sf_dir).regions.where("book <> 'cycle.xlsx'")
    return r.select("book", "range_a1", "kind", "title", "title_range", told("header_rows"), "totals_row", told("subtotal_rows"), "hidden_sheet")


@query(_values("region_id, range_a1", ("rg_1hqooki", "Sales!A3:F35"), ("rg_b9u3gj", "Sales!H3:I7"), ("rg_1ayprhb", "Rates!A1:B5"), ("rg_l2zijg", "Summary!B2:C5"), ("rg_ddbqgc", "Sales!A1:D15"), ("rg_1qt9xpp", "Targets!A1:B7"), ("rg_n23its", "Dash!B2:C5")))
def q_book_region_ids(spark, sf_dir) -> DataFrame:
    return _ws(spark, sf_dir).regions.where("book not in ('cycle.xlsx', 'zoom.xlsx')").select("region_id", "range_a1")


_SALE = "SELECT 4 + i AS n, ((i * 7) % 50 + 5)::DOUBLE AS units, 9.99::DOUBLE + ((i % 4) * 5)::DOUBLE AS price FROM range(30) t(i)"


@query(
    f"WITH s AS ({_SALE}) SELECT 'D' || n AS cell, units AS num, NULL AS formula FROM s UNION ALL SELECT 'E' || n, price, NULL FROM s "
    "UNION ALL SELECT 'F' || n, units * price, 'D' || n || '*E' || n FROM s UNION ALL SELECT 'F35', sum(units * price ORDER BY n), 'SUM(F4:F33)' FROM s UNION ALL SELECT 'I' || (4 + i), (5000 + 250 * i)::DOUBLE, NULL FROM range(4) t(i)"
)
def q_book_numbers(spark, sf_dir) -> DataFrame:
    """All numbers of a sheet as read from its file, with their formulas."""
    c = _ws(spark, sf_dir).cells.where("book = 'sample.xlsx' and sheet = 'Sales' and type = 'number'")
    return c.select(A.format_cell(F.col("row"), F.col("col")).alias("cell"), "num", "formula")


@query("SELECT 'A' || (4 + i) AS cell, CAST(DATE '2026-01-01' + i::INTEGER AS VARCHAR) AS day FROM range(30) t(i)")
def q_book_dates(spark, sf_dir) -> DataFrame:
    """Serial numbers that their cells' number format makes dates."""
    c = _ws(spark, sf_dir).cells.where("type = 'date'")
    return c.select(A.format_cell(F.col("row"), F.col("col")).alias("cell"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(_values("cell, formula", ("A1", "B1"), ("B1", "A1"), ("E1", "D1*2"), ("E2", "D2*2"), ("E3", "D3*2")))
def q_book_shared_formulas(spark, sf_dir) -> DataFrame:
    """Cells that share a formula have it shifted to their place."""
    c = _ws(spark, sf_dir).cells.where("book = 'cycle.xlsx' and formula is not null")
    return c.select(A.format_cell(F.col("row"), F.col("col")).alias("cell"), "formula")


@query(
    _values(
        "book, sheet, hidden, place",
        ("sample.xlsx", "Sales", False, 0), ("sample.xlsx", "Rates", True, 1), ("sample.xlsx", "Summary", False, 2), ("zoom.xlsx", "Spend", False, 0), ("zoom.xlsx", "RateMap", True, 1),
        ("summary-2026.xlsx", "Dash", False, 0), ("sales-2026.xlsx", "Sales", False, 0), ("targets.xlsx", "Targets", False, 0), ("cycle.xlsx", "S", False, 0),
    )
)
def q_book_sheets(spark, sf_dir) -> DataFrame:
    return _ws(spark, sf_dir).sheets.select("book", "sheet", "hidden", F.col("sheet_idx").cast("int").alias("place"))


@query(_values("book, sheet, area", ("sample.xlsx", "Sales", "A1:F1"), ("zoom.xlsx", "Spend", "A1:E1"), ("zoom.xlsx", "Spend", "A3:B3"), ("zoom.xlsx", "Spend", "C3:E3")))
def q_book_merges(spark, sf_dir) -> DataFrame:
    w = _ws(spark, sf_dir)
    m = w.merges.join(w.sheets.select("book", "sheet_lc", "sheet"), ["book", "sheet_lc"]) if "sheet" not in w.merges.columns else w.merges
    return m.select("book", "sheet", A.format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")).alias("area"))


@query(_values("book, name, area", ("sample.xlsx", "TotalRevenue", "Sales!$F$35"), ("sales-2026.xlsx", "GrandTotal", "Sales!$D$15"), ("targets.xlsx", "GrandTotal", "Targets!$B$7"), ("cycle.xlsx", "Base", "S!$D$1")))
def q_book_names(spark, sf_dir) -> DataFrame:
    return _ws(spark, sf_dir).names.select("book", "name", F.col("target").alias("area"))


@query(_values("book, kind, label, start_row, end_row, subtotal_row", ("zoom.xlsx", "group", "Engineering", 5, 6, 7), ("zoom.xlsx", "group", "Sales", 8, 9, 10)))
def q_book_sections(spark, sf_dir) -> DataFrame:
    s = _ws(spark, sf_dir).regions.select("book", F.explode("sections").alias("s"))
    return s.select("book", "s.kind", "s.label", "s.start_row", "s.end_row", "s.subtotal_row")


@query(_values("book, range_a1, note", ("zoom.xlsx", "Spend!A3:E11", "Note: vendor costs exclude shared platform fees allocated elsewhere.")))
def q_book_notes(spark, sf_dir) -> DataFrame:
    return _ws(spark, sf_dir).regions.where("kind <> 'notes'").select("book", "range_a1", F.explode("notes").alias("note"))


@query(_values("header, role, total", ("Org · Dept", "category", None), ("Org · Month", "month", None), ("Amounts · Payroll", "measure", 380.0), ("Amounts · Vendor", "measure", 160.0), ("Amounts · Total", "computed", 540.0)))
def q_book_grouped_columns(spark, sf_dir) -> DataFrame:
    """Columns under a grouped header; subtotal and total rows are not in their sums."""
    c = _ws(spark, sf_dir).regions.where("book = 'zoom.xlsx' and sheet = 'Spend' and kind = 'table'").select(F.explode("columns").alias("c"))
    return c.select("c.header", "c.role", F.col("c.stats.sum").alias("total"))


@query(
    _values(
        'provenance, dept, "month", total',
        ("Spend!A5:E5", "Engineering", "2026-01", 150.0), ("Spend!A6:E6", "Engineering", "2026-02", 170.0), ("Spend!A8:E8", "Sales", "2026-01", 100.0), ("Spend!A9:E9", "Sales", "2026-02", 120.0),
    )
)
def q_book_extract(spark, sf_dir) -> DataFrame:
    """Rows of a table with subtotals, each once, with where it comes from."""
    w = _ws(spark, sf_dir)
    region = w.regions.where("book = 'zoom.xlsx' and sheet = 'Spend' and kind = 'table'").first()
    t = extract.extract(w, region).rows
    return t.select("provenance", F.col("`Org · Dept`").alias("dept"), F.col("`Org · Month`").alias("month"), F.col("`Amounts · Total`").alias("total"))


@query(
    _values(
        "from_book, from_cell, external, to_book, to_range",
        ("sample.xlsx", "Summary!C5", "Budget.xlsx", None, "FY26!B2"), ("summary-2026.xlsx", "Dash!C2", "sales-2026.xlsx", "sales-2026.xlsx", "Sales!D15"),
        ("summary-2026.xlsx", "Dash!C3", "targets.xlsx", "targets.xlsx", "Targets!A2:B5"), ("summary-2026.xlsx", "Dash!C4", "budget-2026.xlsx", None, "FY!B2"),
    )
)
def q_book_links(spark, sf_dir) -> DataFrame:
    """References to other books, loaded or not."""
    return graph.links(_ws(spark, sf_dir)).select("from_book", "from_cell", "external", "to_book", "to_range")


@query(_values("name, books", ("GrandTotal", "sales-2026.xlsx Sales!$D$15, targets.xlsx Targets!$B$7")))
def q_book_shared_names(spark, sf_dir) -> DataFrame:
    said = F.transform("uses", lambda u: F.concat(u["book"], F.lit(" "), F.array_join(u["ranges"], ";")))
    return collection.shared_names(_ws(spark, sf_dir)).select("name", F.array_join(said, ", ").alias("books"))


def _point(w: Workspace, book: str, sheet: str, row: int, col: int) -> DataFrame:
    return w.spark.createDataFrame([(book, sheet, sheet.lower(), row, col)], "book string, sheet string, sheet_lc string, row int, col int")


@query(_values("address, kind, depth", ("[summary-2026.xlsx]Dash!C5", "cell", 0), ("[summary-2026.xlsx]Dash!C2", "cell", 1), ("[sales-2026.xlsx]Sales!D15", "cell", 2), ("[sales-2026.xlsx]Sales!D2:D13", "range", 3)))
def q_book_cross_precedents(spark, sf_dir) -> DataFrame:
    """What a cell depends on, over books, with its ranges."""
    w = _ws(spark, sf_dir)
    t = graph.trace_precedents(w, _point(w, "summary-2026.xlsx", "Dash", 5, 3), 3, across=True, qualified=True)
    return t.select("address", "kind", F.size("pos").alias("depth"))


@query(_values("address, depth", ("[sales-2026.xlsx]Sales!D15", 0), ("[summary-2026.xlsx]Dash!C2", 1), ("[summary-2026.xlsx]Dash!C4", 2), ("[summary-2026.xlsx]Dash!C5", 2)))
def q_book_cross_dependents(spark, sf_dir) -> DataFrame:
    w = _ws(spark, sf_dir)
    t = graph.trace_dependents(w, _point(w, "sales-2026.xlsx", "Sales", 15, 4), 2, across=True, qualified=True)
    return t.select("address", F.size("pos").alias("depth"))


@query(_values("address, depth, cycle", ("S!A1", 0, False), ("S!B1", 1, False), ("S!A1", 2, True)))
def q_book_cycle(spark, sf_dir) -> DataFrame:
    """A trace stops where it comes back."""
    w = _ws(spark, sf_dir)
    t = graph.trace_precedents(w, _point(w, "cycle.xlsx", "S", 1, 1), 5)
    return t.select("address", F.size("pos").alias("depth"), F.coalesce("cycle", F.lit(False)).alias("cycle"))
