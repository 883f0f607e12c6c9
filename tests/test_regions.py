import random

import pytest
from pyspark.sql import functions as F

from gridengine.operators import components as C
from gridengine.operators import rangejoin
from gridengine.operators.rangejoin import containing, overlapping
from gridengine.plans import tables
from gridengine.plans.workspace import Workspace
from gridengine.sources.lift import lift

from gridengine.sources import workbooks as made


def flood(cells):
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        rs, cs = [r for r, _ in own], [c for _, c in own]
        out.append([min(rs), max(rs), min(cs), max(cs)])
    again = True
    while again:
        again = False
        for i in range(len(out)):
            for j in range(i):
                a, b = out[i], out[j]
                if a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]:
                    out[j] = [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]
                    del out[i]
                    again = True
                    break
            if again:
                break
    return sorted(out, key=lambda b: (b[0], b[2]))


def test_components_are_those_of_a_flood_fill():
    r = random.Random(5)
    for _ in range(400):
        h, w = r.randint(1, 14), r.randint(1, 14)
        cells = {(i, j) for i in range(h) for j in range(w) if r.random() < r.choice([0.1, 0.3, 0.5])}
        assert C.components([[a, a, b, b] for a, b in cells]) == flood(cells)


def test_rectangles_cover_the_cells(spark):
    r = random.Random(2)
    cells = {(70_000 - 8 + i, j) for i in range(15) for j in range(9) if r.random() < 0.7}
    rows = [("b", "s", i, j, "string", "x", None, True) for i, j in cells]
    d = spark.createDataFrame(rows, "book string, sheet_lc string, row int, col int, type string, str string, formula string, direct boolean")
    rects = C.rectangles(d).collect()
    assert sorted((i, j) for x in rects for i in range(x.r0, x.r1 + 1) for j in range(x.c0, x.c1 + 1)) == sorted(cells)
    assert C.components([[x.r0, x.r1, x.c0, x.c1] for x in rects]) == flood(cells)


def test_range_joins(spark):
    r = random.Random(9)
    box = lambda: (lambda a, b, n, m: (a, b, a + n, b + m))(r.randint(1, 3000), r.randint(1, 30), r.choice([0, 1, 5, 700, 2500]), r.randint(0, 9))
    ranges = [("b", "s", k, *box()) for k in range(60)]
    points = [("b", "s", r.randint(1, 4000), r.randint(1, 35)) for _ in range(400)]
    a = spark.createDataFrame(ranges, "book string, sheet_lc string, k int, r0 int, c0 int, r1 int, c1 int")
    p = spark.createDataFrame(points, "book string, sheet_lc string, row int, col int")
    got = sorted((x.row, x.col, x.k) for x in containing(p, a).collect())
    assert got == sorted((x[2], x[3], g[2]) for x in points for g in ranges if g[3] <= x[2] <= g[5] and g[4] <= x[3] <= g[6])
    side = lambda n: a.select("book", "sheet_lc", F.col("k").alias(f"{n}_k"), *(F.col(c).alias(f"{n}_{c}") for c in ("r0", "c0", "r1", "c1")))
    got = sorted((x.a_k, x.b_k) for x in overlapping(side("a"), side("b")).collect())
    assert got == sorted((g[2], h[2]) for g in ranges for h in ranges if g[3] <= h[5] and h[3] <= g[5] and g[4] <= h[6] and h[4] <= g[6])


def test_sample_regions(sample):
    got = {r.range_a1: r for r in sample.regions.collect()}
    assert set(got) == {"Sales!A3:F35", "Sales!H3:I7", "Rates!A1:B5", "Summary!B2:C5"}
    assert {r.range_a1: r.region_id for r in got.values()} == {"Sales!A3:F35": "rg_1hqooki", "Summary!B2:C5": "rg_l2zijg", "Rates!A1:B5": "rg_1ayprhb", "Sales!H3:I7": "rg_b9u3gj"}
    main = got["Sales!A3:F35"]
    assert (main.kind, main.title, main.header_row, main.totals_row, main.data_rows, main.data_start_row, main.data_end_row) == ("table", "ACME Q1 Sales", 3, 35, 30, 4, 33)
    assert main.headers == ["Date", "Region", "Product", "Units", "Unit Price", "Revenue"] and (main.cell_count, main.formula_cell_count) == (188, 31)
    by = {c.header: c for c in main.columns}
    assert by["Date"].is_key and by["Date"].role == "key" and (by["Date"].date_range.min, by["Date"].date_range.max) == ("2026-01-01", "2026-01-30")
    assert by["Region"].role == "category" and by["Region"].samples == ["North", "South", "East"] and by["Region"].distinct == 4
    assert by["Revenue"].role == "computed" and by["Revenue"].formula_example == "=D4*E4" and by["Revenue"].formula_template == "R[0]C[-2]*R[0]C[-1]"
    assert by["Revenue"].stats.sum == pytest.approx(15601.05) and by["Units"].role == "measure"
    assert got["Summary!B2:C5"].kind == "keyValue" and got["Rates!A1:B5"].hidden_sheet and got["Sales!H3:I7"].kind == "table"
    assert main.confidence == 0.99 and main.title_range == "Sales!A1:F1"


def test_zoom_regions(zoom):
    got = {r.sheet: r for r in zoom.regions.where("kind <> 'notes'").collect()}
    s = got["Spend"]
    assert s.header_rows == [3, 4] and s.subtotal_rows == [7, 10] and s.totals_row == 11 and s.data_rows == 4
    assert s.headers == ["Org · Dept", "Org · Month", "Amounts · Payroll", "Amounts · Vendor", "Amounts · Total"]
    assert [(x.kind, x.label, x.start_row, x.end_row, x.subtotal_row) for x in s.sections] == [("group", "Engineering", 5, 6, 7), ("group", "Sales", 8, 9, 10)]
    by = {c.header.split(" · ")[1]: c for c in s.columns}
    assert by["Payroll"].stats.sum == 380 and {k: c.role for k, c in by.items()} == {"Dept": "category", "Month": "month", "Payroll": "measure", "Vendor": "measure", "Total": "computed"}
    assert s.notes == ["Note: vendor costs exclude shared platform fees allocated elsewhere."]
    assert [r.range_a1 for r in zoom.regions.where("kind = 'notes'").collect()] == ["Spend!A13"]
    assert got["RateMap"].hidden_sheet and s.title == "Department Spend"


def test_a_sentence_about_totals_is_no_subtotal(spark, tmp_path):
    s = made.Sheet("Assumptions").put("A1", "Assumption", bold=True).put("B1", "Value", bold=True)
    for k, (a, v) in enumerate([("Vendor totals include capex purchases", 1), ("Growth", 2), ("Rate", 3), ("Months", 4)], 2):
        s.row(f"A{k}", [a, v])
    w = Workspace.load(spark, made.write(tmp_path / "a.xlsx", [s]))
    r = w.regions.first()
    assert r.subtotal_rows is None and r.sections is None and r.purpose == "assumptions & policies" and r.data_rows == 4


def test_lifted_tables_have_regions(spark, sf):
    nation, region = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    w = Workspace.lifted(spark, lift(nation, "N", ["n_nationkey"]), lift(region, "N", ["r_regionkey"], at=(1, 6)), lift(region, "R", ["r_regionkey"]))
    got = {r.range_a1: r for r in w.regions.collect()}
    assert set(got) == {"N!A1:C26", "N!F1:G6", "R!A1:B6"}
    assert all(r.kind == "table" and r.header_row == 1 for r in got.values()) and got["N!A1:C26"].data_rows == 25


def test_no_cells(spark, tmp_path):
    w = Workspace.load(spark, made.write(tmp_path / "empty.xlsx", [made.Sheet("E")]))
    assert w.regions.count() == 0 and w.edges.count() == 0 and w.sheets.count() == 1 and w.warnings.count() == 0


@pytest.mark.parametrize("few", [0, 20_000])
def test_range_joins_with_many_ranges_build_nothing_on_the_driver(spark, monkeypatch, few):
    """Whatever Spark guesses of their size: only counted tiles are broadcast."""
    monkeypatch.setattr(rangejoin, "FEW", few)
    ranges = spark.range(300).select(F.lit("b").alias("book"), F.lit("s").alias("sheet_lc"), F.col("id").alias("k"), F.col("id").cast("int").alias("r0"), F.lit(1).alias("c0"), (F.col("id") + F.col("id") % 40).cast("int").alias("r1"), F.lit(2).alias("c1"))
    points = spark.range(300).select(F.lit("b").alias("book"), F.lit("s").alias("sheet_lc"), F.col("id").cast("int").alias("row"), F.lit(2).alias("col"))
    got = containing(points, ranges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (few > 0, few == 0)
    assert sorted((r.row, r.k) for r in got.collect()) == [(p, k) for p in range(300) for k in range(300) if k <= p <= k + k % 40]


def test_a_column_with_more_values_than_are_told_apart_is_no_category(spark):
    d = spark.range(30_000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("k"), F.col("id") % 9_999).alias("kind"))
    got = {c.header: (c.distinct, c.role) for c in Workspace.lifted(spark, lift(d, "S", ["id"])).region_columns.collect()}
    assert got == {"id": (10_000, "measure"), "name": (10_000, "text"), "kind": (9_999, "category")}


def test_cells_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """Not by bytes, of which Spark would put all of these into one task."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = [("b", "s", k, 1, "string", "x", None, True) for k in range(900)]
    d = spark.createDataFrame(rows, "book string, sheet_lc string, row int, col int, type string, str string, formula string, direct boolean")
    plan = C.rectangles(d, tables.tasks_for(900))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 9), REPARTITION_BY_NUM") == plan.count("Exchange ") == 2
