"""A set of workbooks, or of any tables lifted to sheets, as DataFrames: the entry to all operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import regions as R
from ..sources import xlsx
from ..sources.lift import sheets_of
from ..sources.schema import MERGES, NAMES, WARNINGS
from .tables import written


class Workspace:
    """Tables ``cells``, ``sheets``, ``names``, ``merges``, ``edges``, ``regions`` and more, each made once and kept.

    ``books`` orders the books as given; the first is the default for addresses without a book.
    """

    def __init__(self, spark: SparkSession, cells: DataFrame, sheets: DataFrame | None = None, names: DataFrame | None = None, merges: DataFrame | None = None, parsed: DataFrame | None = None, books: list[str] | None = None):
        self.spark, self.cells = spark, cells
        self.sheets = sheets_of(cells) if sheets is None else sheets
        empty = lambda schema: spark.createDataFrame([], schema)
        self.names = empty(NAMES) if names is None else names
        self.merges = empty(MERGES) if merges is None else merges
        self.parsed = empty(WARNINGS) if parsed is None else parsed
        self._order = books

    @classmethod
    def load(cls, spark: SparkSession, paths: str | list[str]) -> Workspace:
        """Workbooks by path; names of files are names of books and must differ, whatever their case."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        order = [p.rstrip("/").rpartition("/")[2] for p in paths]
        seen: set[str] = set()
        for b in order:
            if b.lower() in seen:
                raise ValueError(f'there is already a workbook named "{b}"')
            seen.add(b.lower())
        tables = {t: written(xlsx.read(spark, paths, t), t) for t in xlsx.TABLES}
        return cls(spark, tables["cells"], tables["sheets"], tables["names"], tables["merges"], tables["warnings"], None if any("*" in b for b in order) else order)

    @classmethod
    def lifted(cls, spark: SparkSession, *cells: DataFrame) -> Workspace:
        """Tables that ``sources.lift.lift`` made to cells."""
        whole = cells[0]
        for c in cells[1:]:
            whole = whole.unionByName(c)
        return cls(spark, written(whole, "cells"))

    def union(self, other: Workspace) -> Workspace:
        """Both sets of books as one, this one's first; names of books must differ, whatever their case."""
        if clash := {b.lower() for b in self.order} & {b.lower() for b in other.order}:
            raise ValueError(f"there is already a workbook named {', '.join(sorted(clash))}")
        both = lambda t: getattr(self, t).unionByName(getattr(other, t))
        return Workspace(self.spark, both("cells"), both("sheets"), both("names"), both("merges"), both("parsed"), self.order + other.order)

    @cached_property
    def order(self) -> list[str]:
        """Books in order; without a given one, by name."""
        return self._order or [r.book for r in self.sheets.select("book").distinct().orderBy("book").collect()]

    @cached_property
    def books(self) -> DataFrame:
        return self.spark.createDataFrame([(b, b.lower(), k) for k, b in enumerate(self.order)], "book string, book_lc string, book_ord int")

    @cached_property
    def row_limits(self) -> DataFrame:
        return written(E.row_limits(self.sheets), "row-limits")

    @cached_property
    def scanned(self) -> DataFrame:
        return written(E.scans(self.cells, self.row_limits), "scans")

    @cached_property
    def edges(self) -> DataFrame:
        return written(E.edges(self.cells, self.row_limits, self.scanned), "edges")

    @cached_property
    def targets(self) -> DataFrame:
        return written(E.targets(self.edges, self.names, self.sheets), "targets")

    @cached_property
    def regions(self) -> DataFrame:
        return written(R.detect(self.cells, self.sheets, self.merges, self.edges, self.row_limits), "regions")

    @cached_property
    def region_columns(self) -> DataFrame:
        return R.region_columns(self.regions)

    @cached_property
    def warnings(self) -> DataFrame:
        return E.warnings(self.cells, self.sheets, self.names, self.parsed, self.edges, self.row_limits, self.scanned)

    def views(self, prefix: str = "") -> None:
        """All tables as temporary views, so that SQL can ask them."""
        for t in ("cells", "sheets", "names", "merges", "edges", "targets", "regions", "region_columns", "warnings", "books"):
            getattr(self, t).createOrReplaceTempView(prefix + t)

    def of(self, table: str, book: str) -> DataFrame:
        return getattr(self, table).where(F.lower("book") == book.lower())
