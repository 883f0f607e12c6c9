import pytest
from pyspark.sql import functions as F

from gridengine.plans.tables import numbered
from gridengine.sources import xlsx
from gridengine.sources.lift import lift, sheets_of
from gridengine.sources.schema import value_json, value_text

from gridengine.sources import workbooks as made


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    return made.sample(tmp_path_factory.mktemp("x") / "sample.xlsx")


def test_workbook_tables(spark, book):
    sheets = {r.sheet: r for r in xlsx.read(spark, book, "sheets").collect()}
    assert [(s, r.hidden, r.max_row, r.max_col) for s, r in sorted(sheets.items(), key=lambda x: x[1].sheet_idx)] == [("Sales", False, 35, 9), ("Rates", True, 5, 2), ("Summary", False, 5, 3)]
    cells = xlsx.read(spark, book, "cells")
    at = {(r.sheet, r.row, r.col): r for r in cells.withColumn("text", value_text()).withColumn("json", value_json()).collect()}
    assert at["Sales", 4, 1].type == "date" and at["Sales", 4, 1].text == "2026-01-01" and at["Sales", 4, 1].json == '"2026-01-01"'
    assert at["Sales", 4, 6].formula == "D4*E4" and at["Sales", 3, 1].bold and at["Sales", 4, 4].text == "5" and at["Sales", 4, 4].json == "5"
    assert at["Sales", 35, 6].num == pytest.approx(15601.05) and ("Sales", 1, 2) not in at
    assert len([1 for k in at if k[0] == "Sales" and 3 <= k[1] <= 35 and k[2] <= 6]) == 188
    assert [(r.name, r.sheet, r.r0, r.c0) for r in xlsx.read(spark, book, "names").collect()] == [("TotalRevenue", "Sales", 35, 6)]
    assert [(r.sheet, r.r0, r.c0, r.r1, r.c1) for r in xlsx.read(spark, book, "merges").collect()] == [("Sales", 1, 1, 1, 6)]


def test_data_source(spark, book):
    xlsx.register(spark)
    d = spark.read.format("xlsx_grid").option("paths", book).option("sheet", "rates").load()
    assert d.count() == 10 and d.schema == xlsx.CELLS


def test_shared_formulas_and_odd_files(spark, tmp_path):
    s = made.Sheet("S").put("A1", 1).put("A2", 2).put("A3", True).put("B1", 2, "A1*2", shared=(0, "B1:B3")).put("B2", 4, shared=(0, None)).put("B3", 6, shared=(0, None)).put("C1", 0, shared=(7, None))
    made.write(tmp_path / "shared.xlsx", [s])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    cells = xlsx.read(spark, f"{tmp_path}/*.xlsx", "cells").where("formula is not null").orderBy("row").collect()
    assert [r.formula for r in cells] == ["A1*2", "A2*2", "A3*2"]
    assert xlsx.read(spark, f"{tmp_path}/*.xlsx", "warnings").count() == 2


def test_lift(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    cells = lift(nation, "Nation", ["n_nationkey"], at=(2, 3))
    got = {(r.row, r.col): (r.type, r.t) for r in cells.withColumn("t", value_text()).collect()}
    rows = nation.orderBy("n_nationkey").collect()
    assert got[2, 3] == ("string", "n_nationkey") and len(got) == 3 * 26
    assert all(got[3 + k, 3] == ("number", str(r.n_nationkey)) and got[3 + k, 4] == ("string", r.n_name) for k, r in enumerate(rows))
    assert [(r.max_row, r.max_col) for r in sheets_of(cells).collect()] == [(27, 5)]


def test_numbered_is_a_running_number(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    assert [(r.n, r.k) for r in numbered(d, ["k"], "n").orderBy("n").collect()] == list(enumerate(sorted(i * 7919 % 1009 for i in range(1000)), 1))
    assert numbered(d.limit(0), ["k"], "n").count() == 0
