"""Typed rows of a region: cells turned back to columns, totals left out, each row with the range that it came from."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import col_letter, column, letters
from ..functions.text import plain_tokens
from ..sources.schema import value_json, value_text

_OWN = {"number": "num", "string": "str", "boolean": "bool", "date": "ts", "error": "str"}


def column_names(columns: list) -> list[str]:
    """Headers, or letters; one that repeats in any case gets its letter."""
    seen: set[str] = set()
    out = []
    for c in columns:
        name = c["header"] if c["header"] is not None else c["letter"]
        out.append(f"{name} ({c['letter']})" if name.lower() in seen else name)
        seen.add(name.lower())
    return out


def wanted(names: list[str], columns: list[str] | None) -> list[bool]:
    return [columns is None or any(w.lower() in n.lower() for w in columns) for n in names]


@dataclass
class Extracted:
    """Lazy ``rows`` (row, the columns, provenance) in sheet order, and what an answer says about them, computed when asked for."""

    region: object
    rows: DataFrame
    cells: DataFrame
    columns: list[dict]
    offset: int
    sections: list[dict] | None
    left_out: DataFrame | None
    warnings: list[str] = field(default_factory=list)
    book: str | None = None

    @cached_property
    def total_data_rows(self) -> int:
        return self.cells.select("row").distinct().count()

    @cached_property
    def excluded_subtotal_rows(self) -> list[int] | None:
        return None if self.left_out is None else self.region["subtotal_rows"]

    @cached_property
    def subtotals(self) -> list[dict] | None:
        return None if self.left_out is None else _echo(self.left_out, self.region, column_names(self.region["columns"]))

    def packed(self) -> dict:
        """All of it as JSON values, each cell's own; for what fits the driver, as pages do."""
        page = self.rows.select("row", "provenance")
        values: dict[int, dict[int, object]] = {}
        for r in self.cells.join(page, "row").select("row", "col", value_json().alias("v")).collect():
            values.setdefault(r.row, {})[r.col] = json.loads(r.v)
        order = sorted(page.collect())
        at = {c["name"]: column(c["letter"]) for c in self.columns}
        rows = [{n: values.get(r.row, {}).get(k) for n, k in at.items()} for r in order]
        out = {"regionId": self.region["region_id"]} | ({"workbook": self.book} if self.book else {})
        out |= {"sheet": self.region["sheet"], "rangeA1": self.region["range_a1"], "columns": self.columns, "rows": rows, "rowProvenance": [r.provenance for r in order]}
        for k, v in (("sections", self.sections), ("excludedSubtotalRows", self.excluded_subtotal_rows), ("subtotals", self.subtotals)):
            if v is not None:
                out[k] = v
        out |= {"totalDataRows": self.total_data_rows, "offset": self.offset, "returned": len(rows), "complete": self.offset == 0 and len(rows) == self.total_data_rows, "warnings": self.warnings}
        return out | {"tokens": plain_tokens(json.dumps({"columns": self.columns, "rows": rows}, ensure_ascii=False, separators=(",", ":")))}


def data_cells(ws, region) -> DataFrame:
    """Cells of a region's data rows, subtotal rows too."""
    c = ws.cells.where((F.col("book") == region["book"]) & (F.col("sheet_lc") == region["sheet_lc"]))
    return c.where(F.col("row").between(region["data_start_row"], region["data_end_row"]) & F.col("col").between(region["c0"], region["c1"]))


def _pivoted(cells: DataFrame, columns: list, names: list[str], keep: list[bool], text: bool) -> DataFrame:
    """A row per sheet row; the columns are known, so the pivot needs no job of its own. ``text``: values as they are shown."""
    out = []
    for c, name, k in zip(columns, names, keep):
        if k:
            own = None if text else _OWN.get(c["type"])
            shown = F.col(own) if own and own != "str" else value_text()
            out.append(F.max(F.when(F.col("col") == c["col"], shown)).alias(name))
    return cells.groupBy("row").agg(F.count("*").alias("__n"), *out).drop("__n")


def extract(ws, region, offset: int = 0, limit: int | None = None, columns: list[str] | None = None, include_subtotals: bool = False, qualified: bool = False) -> Extracted:
    """A region's rows by header names with their types; subtotal and total rows only if asked for.

    ``region`` is a row of ``ws.regions``. Columns of one type have it, mixed ones are texts; a value of another type in a typed
    column is null unless the column is mixed. Paging is over the surviving rows in sheet order.
    """
    names, warnings = column_names(region["columns"]), []
    subtotal = bool(region["subtotal_rows"])
    if include_subtotals and subtotal:
        warnings.append("subtotal rows are INCLUDED — beware of double counting")
    if region["header_row"] is None:
        warnings.append("no header row detected — columns are named by letter")
    keep = wanted(names, columns)
    if columns is not None and not any(keep):
        warnings.append(f"no columns matched filter [{', '.join(columns)}]")
    data, left_out = data_cells(ws, region), None
    if subtotal and not include_subtotals:
        closing = ws.regions.where((F.col("book") == region["book"]) & (F.col("region_id") == region["region_id"])).select(F.explode("subtotal_rows").alias("row"))
        data, left_out = data.join(closing, "row", "left_anti"), data.join(closing, "row", "left_semi")
    mixed = _typed_as_mixed(data, region)
    kinds = [c.asDict(True) | {"type": "mixed"} if c["col"] in mixed else c for c in region["columns"]]
    rows = _pivoted(data, kinds, names, keep, False)
    page = rows.orderBy("row").offset(max(0, offset))
    page = page if limit is None else page.limit(limit)
    span = F.concat(F.lit(f"{region['sheet']}!{letters(region['c0'])}"), F.col("row").cast("string"), F.lit(f":{letters(region['c1'])}"), F.col("row").cast("string"))
    span = F.concat(F.lit(f"[{region['book']}]"), span) if qualified else span
    meta = [{"name": n, "letter": c["letter"]} | ({"role": c["role"]} if c["role"] else {}) | {"type": c["type"]} for c, n, k in zip(region["columns"], names, keep) if k]
    groups = [{"label": s["label"], "rows": [s["start_row"], s["end_row"]]} for s in region["sections"] if s["kind"] == "group"] if region["sections"] else None
    return Extracted(region, page.withColumn("provenance", span), data, meta, max(0, offset), groups, left_out, warnings, region["book"] if qualified else None)


def _typed_as_mixed(data: DataFrame, region) -> set[int]:
    """Columns with a value that is not of the column's type, found by one aggregation."""
    kinds = {c["col"]: c["type"] for c in region["columns"] if c["type"] in _OWN}
    odd = [F.count_if((F.col("col") == k) & (F.col("type") != t) & (F.col("type") != "empty")).alias(str(k)) for k, t in kinds.items()]
    if not odd:
        return set()
    found = data.agg(*odd).first()
    return {k for k in kinds if found[str(k)]}


def _echo(cells: DataFrame, region, names: list[str]) -> list[dict]:
    """Subtotal rows as they stand, all columns, with their first text."""
    by: dict[int, dict[int, object]] = {}
    for r in cells.select("row", "col", value_json().alias("v")).collect():
        by.setdefault(r.row, {})[r.col] = json.loads(r.v)
    out = []
    for row in region["subtotal_rows"]:
        values = {n: by.get(row, {}).get(c["col"]) for c, n in zip(region["columns"], names)}
        label = next((v for v in values.values() if isinstance(v, str) and v.strip()), None)
        out.append({"row": row} | ({"label": label} if label is not None else {}) | {"values": values})
    return out


def provenance(ws) -> DataFrame:
    """(book, region_id, row, provenance) of every data row of every region, at once."""
    from .rangejoin import containing

    ranges = ws.regions.select("book", "sheet_lc", "region_id", F.col("sheet").alias("name"), F.col("c0").alias("from_col"), F.col("c1").alias("to_col"), F.coalesce("subtotal_rows", F.array().cast("array<int>")).alias("skip"), F.col("data_start_row").alias("r0"), F.col("data_end_row").alias("r1"), "c0", "c1")
    rows = containing(ws.cells.select("book", "sheet_lc", "row", "col"), ranges).where(~F.array_contains("skip", F.col("row")))
    rows = rows.select("book", "region_id", "name", "from_col", "to_col", "row").distinct()
    n = F.col("row").cast("string")
    return rows.select("book", "region_id", "row", F.concat("name", F.lit("!"), col_letter(F.col("from_col")), n, F.lit(":"), col_letter(F.col("to_col")), n).alias("provenance"))
