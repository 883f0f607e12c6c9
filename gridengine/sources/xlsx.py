"""Workbooks (.xlsx) as tables, parsed with the standard library, one task per workbook.

``read`` goes through Spark's ``binaryFile`` reader, so paths may be in any store that Spark reads; ``XlsxSource`` is
the same parser behind ``spark.read.format("xlsx_grid")`` for paths that executors can open.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.address import local_cell, parse_range
from ..functions.formula import shifted
from .lift import STRIDE
from .schema import CELLS, MERGES, NAMES, SHEETS, WARNINGS

TABLES = {"cells": CELLS, "sheets": SHEETS, "names": NAMES, "merges": MERGES, "warnings": WARNINGS}
#: Built-in number formats that show dates or times.
_DATE_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: Built-in number formats by id that are shown as a cell's format.
_FORMATS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
_WHITE = "FFFFFFFF"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(e, name: str):
    return [c for c in e if _local(c.tag) == name] if e is not None else []


def _child(e, name: str):
    return next(iter(_children(e, name)), None)


def _texts(e) -> str:
    """Text of plain or rich text: its ``t`` parts, without phonetic runs."""
    out = []
    for c in e:
        if _local(c.tag) == "t":
            out.append(c.text or "")
        elif _local(c.tag) == "r":
            out += [t.text or "" for t in _children(c, "t")]
    return "".join(out)


def _on(e) -> bool:
    return e is not None and e.get("val", "1") not in ("0", "false")


class Workbook:
    """The parts of one workbook as rows of the five tables."""

    def __init__(self, book: str, content: bytes):
        self.book = book
        self.rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        root = self._xml("xl/workbook.xml")
        self.epoch = datetime(1904, 1, 1) if _child(root, "workbookPr") is not None and _child(root, "workbookPr").get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        links = self._links("xl/workbook.xml")
        self.strings = [_texts(si) for si in _children(self._xml("xl/sharedStrings.xml"), "si")]
        self._styles()
        for k, s in enumerate(_children(_child(root, "sheets"), "sheet")):
            target = next((v for a, v in s.attrib.items() if _local(a) == "id"), None)
            if target in links:
                self._sheet(k, s.get("name"), s.get("state", "visible") != "visible", links[target][0])
        self._names(root)

    def warn(self, message: str) -> None:
        self.rows["warnings"].append({"book": self.book, "w_ord": len(self.rows["warnings"]), "key": message, "message": message})

    def _xml(self, path: str):
        try:
            return ElementTree.fromstring(self.zip.read(path))
        except KeyError:
            return None

    def _links(self, path: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(path)
        found = self._xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in found if found is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
            out[r.get("Id")] = (target, r.get("Type", ""))
        return out

    def _styles(self) -> None:
        root = self._xml("xl/styles.xml")
        formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _children(_child(root, "numFmts"), "numFmt")}
        fonts = [(_on(_child(f, "b")), _on(_child(f, "i"))) for f in _children(_child(root, "fonts"), "font")]
        fills = []
        for f in _children(_child(root, "fills"), "fill"):
            color = _child(_child(f, "patternFill"), "fgColor")
            rgb = color.get("rgb") if color is not None else None
            fills.append(rgb if rgb != _WHITE else None)
        self.styles = []
        for x in _children(_child(root, "cellXfs"), "xf"):
            number = int(x.get("numFmtId", 0))
            code = formats.get(number) or _FORMATS.get(number)
            at = lambda of, k: of[int(x.get(k, 0))] if int(x.get(k, 0)) < len(of) else None  # noqa: E731, B023
            bold, italic = at(fonts, "fontId") or (False, False)
            self.styles.append({"bold": bold or None, "italic": italic or None, "num_fmt": code, "fill": at(fills, "fillId"), "date": self._is_date(number, formats.get(number))})

    @staticmethod
    def _is_date(number: int, code: str | None) -> bool:
        if code is None:
            return number in _DATE_IDS
        bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", code.lower())
        return bool(re.search("[dmyhs]", bare)) and "general" not in bare

    def _value(self, cell, style: dict) -> dict:
        """type and value of a cell; empty for none."""
        kind, v = cell.get("t", "n"), _child(cell, "v")
        raw = v.text if v is not None and v.text is not None else None
        if kind == "inlineStr":
            own = _child(cell, "is")
            raw = _texts(own) if own is not None else ""
        elif kind == "s" and raw is not None:
            raw = self.strings[int(raw)]
        if raw is None or raw == "":
            return {"type": "empty"}
        if kind == "e":
            return {"type": "error", "str": raw}
        if kind == "b":
            return {"type": "boolean", "bool": raw.strip() == "1"}
        if kind == "d":
            return {"type": "date", "ts": datetime.fromisoformat(raw.replace("Z", ""))}
        if kind != "n":
            return {"type": "string", "str": raw}
        number = float(raw)
        if style.get("date"):
            return {"type": "date", "ts": self.epoch + timedelta(milliseconds=round(number * 86_400_000))}
        return {"type": "number", "num": number}

    def _sheet(self, index: int, name: str, hidden: bool, path: str) -> None:
        root, links = self._xml(path), self._links(path)
        same = {"book": self.book, "sheet": name, "sheet_lc": name.lower()}
        slaves = set()
        for k, m in enumerate(_children(_child(root, "mergeCells"), "mergeCell")):
            try:
                r = parse_range(m.get("ref", ""), name)
            except ValueError:
                self.warn(f'Sheet "{name}": could not parse merge range "{m.get("ref")}"')
                continue
            self.rows["merges"].append(same | {"m_ord": k, "r0": r.r0, "c0": r.c0, "r1": r.r1, "c1": r.c1})
            slaves.update(set(r.cells()) - {(r.r0, r.c0)})
        hyper = {}
        for h in _children(_child(root, "hyperlinks"), "hyperlink"):
            target = next((links[v][0] for a, v in h.attrib.items() if _local(a) == "id" and v in links), h.get("location"))
            if target and (at := local_cell(h.get("ref", ""))):
                hyper[at] = target
        masters: dict[str, tuple[int, int, str]] = {}
        cells: list[dict] = []
        row_no = 0
        for row in _children(_child(root, "sheetData"), "row"):
            row_no = int(row.get("r", row_no + 1))
            col_no = 0
            for c in _children(row, "c"):
                at = local_cell(c.get("r", "")) or (row_no, col_no + 1)
                col_no = at[1]
                if at in slaves:
                    continue
                style = self.styles[int(c.get("s"))] if c.get("s") and int(c.get("s")) < len(self.styles) else {}
                value = self._value(c, style)
                f, formula = _child(c, "f"), None
                if f is not None:
                    formula = (f.text or "").strip().removeprefix("=") or None
                    shared = f.get("si") if f.get("t") == "shared" else None
                    if shared is not None and formula:
                        masters.setdefault(shared, (*at, formula))
                    elif shared is not None:
                        if shared in masters:
                            r, k, text = masters[shared]
                            formula = shifted(text, name, at[0] - r, at[1] - k)
                        else:
                            self.warn(f'Sheet "{name}": shared formula master {shared} not found for row {at[0]}, col {at[1]}')
                if value["type"] == "empty" and formula is None:
                    continue
                cells.append(same | value | {"row": at[0], "col": at[1], "ord": at[0] * STRIDE + at[1], "formula": formula, "hyperlink": hyper.get(at)} | {k: style.get(k) for k in ("bold", "italic", "num_fmt", "fill")})
        self.rows["cells"] += cells
        most = lambda k: max((c[k] for c in cells), default=0)
        self.rows["sheets"].append(same | {"sheet_idx": index, "hidden": hidden, "max_row": most("row"), "max_col": most("col")})

    def _names(self, root) -> None:
        n = 0
        for d in _children(_child(root, "definedNames"), "definedName"):
            name = d.get("name", "")
            if name.startswith("_xlnm."):
                continue
            targets = re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", d.text or "")
            for k, target in enumerate(targets or [""]):
                row = {"book": self.book, "name": name, "name_lc": name.lower(), "name_ord": n, "target_ord": k, "target": target}
                try:
                    text = re.sub(r"^\[[^\]]*\]", "", target)
                    external = re.match(r"^'?\[([^\]]*)\]", target)
                    r = parse_range(text)
                    row |= {"sheet": r.sheet, "r0": r.r0, "c0": r.c0, "r1": r.r1, "c1": r.c1, "open": r.open, "external": external[1] if external else None}
                except ValueError:
                    self.warn(f'Defined name "{name}": unparsable target "{target}"')
                self.rows["names"].append(row)
            n += 1


def workbook_tables(book: str, content: bytes, tables) -> dict[str, list[dict]]:
    """Rows of the asked tables; a file that is no workbook gives one warning."""
    try:
        rows = Workbook(book, content).rows
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
        message = f"could not read workbook: {type(e).__name__}: {e}"
        rows = {t: [] for t in TABLES} | {"warnings": [{"book": book, "w_ord": 0, "key": message, "message": message}]}
    return {t: rows[t] for t in tables}


def _batch(table: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.TimestampType(): pa.timestamp("us", "UTC")}
    schema = pa.schema([(f.name, kinds[f.dataType]) for f in TABLES[table]])
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def read(spark: SparkSession, paths: str | list[str], table: str = "cells") -> DataFrame:
    """One of the tables of all workbooks that the paths or globs match; ``book`` is the file's name."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield _batch(table, workbook_tables(unquote(posixpath.basename(path)), content, [table])[table])

    return files.mapInArrow(run, TABLES[table])


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "cells")
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.sheet = options.get("sheet")

    def partitions(self):
        return [_Book(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path.removeprefix("file://"), "rb") as f:
            rows = workbook_tables(posixpath.basename(partition.path), f.read(), [self.table])[self.table]
        if self.sheet:
            rows = [r for r in rows if r.get("sheet_lc", self.sheet.lower()) == self.sheet.lower()]
        yield _batch(self.table, rows)


class XlsxSource(DataSource):
    """``spark.read.format("xlsx_grid").option("table", "cells").option("paths", "a.xlsx,b.xlsx")``; option ``sheet`` reads one sheet."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_grid"

    def schema(self):
        return TABLES[self.options.get("table", "cells")]

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def books(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(book, book_ord) in the order of the given paths."""
    rows = [(posixpath.basename(p), k) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, "book string, book_ord int").withColumn("book_lc", F.lower("book"))
