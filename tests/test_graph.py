import pytest
from pyspark.sql import functions as F

from gridengine.functions.address import parse_cell
from gridengine.operators import graph, search
from gridengine.plans.workspace import Workspace

from gridengine.sources import workbooks as made


def points(ws, *addresses, book=None):
    rows = []
    for a in addresses:
        r = parse_cell(a)
        rows.append((book or ws.order[0], r.sheet, r.sheet.lower(), r.r0, r.c0))
    return ws.spark.createDataFrame(rows, "book string, sheet string, sheet_lc string, row int, col int")


def readers(df):
    return [f"{r.d_sheet}!{r.d_row},{r.d_col}" for r in df.orderBy("rank").collect()]


def test_dependents(sample):
    at = lambda a: graph.dependents(sample, points(sample, a).select("book", "sheet_lc", "row", "col"))
    assert readers(at("Sales!F35")) == ["Summary!2,3"]
    assert readers(at("Sales!F4")) == ["Sales!35,6"] and readers(at("Sales!D4")) == ["Sales!4,6"]
    assert readers(at("Rates!B2")) == ["Summary!4,3"] and readers(at("Sales!A1")) == []


def test_precedents(sample):
    tree = graph.nested(graph.trace_precedents(sample, points(sample, "Summary!C3"), 4).collect())
    assert tree["address"] == "Summary!C3" and tree["formula"] == "C2*0.1"
    c2 = tree["children"][0]
    total = c2["children"][0]
    span = total["children"][0]
    assert c2["address"] == "Summary!C2" and total["address"] == "Sales!F35" and span["address"] == "Sales!F4:F33"
    assert span["cellCount"] == 30 and span["note"] == "30 cells, 30 formula(s); dominant pattern =D4*E4 (30×)" and span["children"][0]["address"] == "Sales!F4"
    deep = graph.nested(graph.trace_precedents(sample, points(sample, "Summary!C2"), 4).collect())
    rep = deep["children"][0]["children"][0]["children"][0]
    assert rep["address"] == "Sales!F4" and rep["note"] == "representative of 30 cell(s) with this pattern" and [c["address"] for c in rep["children"]] == ["Sales!D4", "Sales!E4"]
    shallow = graph.nested(graph.trace_precedents(sample, points(sample, "Summary!C3"), 0).collect())
    assert shallow["truncated"] and shallow["note"] == "1 reference(s) below depth limit"
    ext = graph.nested(graph.trace_precedents(sample, points(sample, "Summary!C5"), 2).collect())["children"][0]
    assert ext == {"address": "'[Budget.xlsx]FY26'!B2", "kind": "external", "children": [], "note": 'external workbook "Budget.xlsx" — not loaded'}
    two = graph.trace_precedents(sample, points(sample, "Summary!C3", "Summary!C4"), 2).collect()
    assert {n.root for n in two} == {"Summary!C3", "Summary!C4"} and graph.nested(two, "Summary!C4")["children"][0]["note"] == "8 value cell(s)"


def test_dependent_trace_and_cycles(spark, sample, tmp_path):
    tree = graph.nested(graph.trace_dependents(sample, points(sample, "Sales!D4"), 4).collect())
    path, at = [], tree
    while at["children"]:
        at = at["children"][0]
        path.append(at["address"])
    assert path == ["Sales!F4", "Sales!F35", "Summary!C2", "Summary!C3"]
    w = Workspace.load(spark, made.write(tmp_path / "cycle.xlsx", [made.Sheet("S").put("A1", 1, "B1").put("B1", 1, "A1+Rate+Table1[x]").put("D1", 1, "Nothing!A1")], [("Rate", "S!$C$1")]))
    up = graph.nested(graph.trace_precedents(w, points(w, "S!A1"), 3).collect())
    b1 = up["children"][0]
    assert b1["children"][0] == {"address": "S!A1", "kind": "cell", "children": [], "cycle": True}
    assert b1["children"][1]["note"] == "defined name → S!C1" and b1["children"][1]["children"][0]["address"] == "S!C1" and b1["children"][2]["note"] == "structured reference (not resolved)"
    down = graph.nested(graph.trace_dependents(w, points(w, "S!A1"), 3).collect())
    assert down["children"][0]["children"][0]["cycle"]
    assert [r.message for r in w.warnings.orderBy("w_ord").collect()] == ['S!B1: Structured reference "Table1[…]" recorded but not resolved to cells', 'Formula(s) reference missing sheet "Nothing" (first seen at S!D1)']


def test_many_readers(spark, tmp_path):
    s = made.Sheet("S").put("A1", 1)
    for k in range(40):
        s.put(f"C{k + 1}", k, "A1+1")
    s.put("E1", 1, "SUM(A1:A900)")
    w = Workspace.load(spark, made.write(tmp_path / "many.xlsx", [s]))
    tree = graph.nested(graph.trace_dependents(w, points(w, "S!A1"), 1).collect())
    assert len(tree["children"]) == 30 and tree["note"] == "11 more dependent(s) omitted" and tree["truncated"]
    d = graph.dependents(w, points(w, "S!A1").select("book", "sheet_lc", "row", "col"))
    assert readers(d)[-1] == "S!1,5" and d.count() == 41


def test_across_books(three):
    links = three_links(three)
    assert [(r.from_cell, r.external, r.to_book, r.to_range) for r in links] == [
        ("Dash!C2", "sales-2026.xlsx", "sales-2026.xlsx", "Sales!D15"), ("Dash!C3", "targets.xlsx", "targets.xlsx", "Targets!A2:B5"), ("Dash!C4", "budget-2026.xlsx", None, "FY!B2"),
    ]
    up = graph.nested(graph.trace_precedents(three, points(three, "Dash!C5"), 4, across=True, qualified=True).collect())
    total = up["children"][0]["children"][0]
    assert up["address"] == "[summary-2026.xlsx]Dash!C5" and total["address"] == "[sales-2026.xlsx]Sales!D15" and total["children"][0]["address"] == "[sales-2026.xlsx]Sales!D2:D13"
    down = graph.nested(graph.trace_dependents(three, points(three, "Sales!D15", book="sales-2026.xlsx"), 3, across=True, qualified=True).collect())
    assert [c["address"] for c in down["children"]] == ["[summary-2026.xlsx]Dash!C2"] and [c["address"] for c in down["children"][0]["children"]] == ["[summary-2026.xlsx]Dash!C4", "[summary-2026.xlsx]Dash!C5"]


def three_links(ws):
    return graph.links(ws).orderBy("book_ord", "sheet_idx", "ord", "ref_ord").collect()


def test_cross_book_cycle(spark, tmp_path):
    a = made.write(tmp_path / "a.xlsx", [made.Sheet("S").put("A1", 1, "[b.xlsx]S!A1")])
    b = made.write(tmp_path / "b.xlsx", [made.Sheet("S").put("A1", 1, "[a.xlsx]S!A1")])
    w = Workspace.load(spark, [a, b])
    tree = graph.nested(graph.trace_precedents(w, points(w, "S!A1"), 5, across=True, qualified=True).collect())
    assert tree["children"][0]["children"][0] == {"address": "[a.xlsx]S!A1", "kind": "cell", "children": [], "cycle": True}


def test_find(sample):
    hits = lambda *a, **k: [r.address for r in search.find(sample, *a, **k).collect()]
    assert hits("north", sheet="Sales", limit=3) == ["Sales!B4", "Sales!H4", "Sales!B8"]
    assert hits(5750) == ["Sales!I7"] and hits("^2026-01-0[12]$", regex=True) == ["Sales!A4", "Sales!A5"] and hits("nothing") == []
    assert {r.region_id for r in search.find(sample, "north", limit=None).collect()} == {"rg_1hqooki", "rg_b9u3gj", "rg_1ayprhb", "rg_l2zijg"}


def test_inspect(sample):
    got = {r.address: r for r in search.inspect(sample, points(sample, "Sales!F35", "Sales!C1", "Sales!Z99", "Rates!B2")).collect()}
    t = got["Sales!F35"]
    assert t.formula == "SUM(F4:F33)" and [(p.raw, p.kind, p.target) for p in t.precedents] == [("F4:F33", "range", "Sales!F4:F33")] and t.names == ["TotalRevenue"] and t.dependents == ["Summary!C2"] and t.region_id == "rg_1hqooki"
    m = got["Sales!C1"]
    assert not m.exists and (m.merged.range, m.merged.master, m.merged.value) == ("Sales!A1:F1", "Sales!A1", '"ACME Q1 Sales"')
    assert got["Sales!Z99"].type == "empty" and got["Sales!Z99"].region_id is None and got["Rates!B2"].sheet_hidden


def test_overview_and_map(sample):
    o = search.overview(sample).first()
    assert [(s.sheet, s.hidden, s.used_range, len(s.regions)) for s in o.sheets] == [("Sales", False, "A1:I35", 2), ("Rates", True, "A1:B5", 1), ("Summary", False, "A1:C5", 1)]
    assert o.externals == ["Budget.xlsx"] and [(n.name, n.ranges) for n in o.names] == [("TotalRevenue", ["Sales!$F$35"])] and o.formula_cells == 35 and "external workbook(s): Budget.xlsx" in o.warnings[0]
    m = {r.sheet: r for r in search.sheet_map(sample).collect()}
    assert m["Rates"].purpose == "reference mapping" and m["Sales"].regions[0].headers[0] == "Date" and m["Sales"].regions[0].rows == 30


def test_formulas_past_the_rows_of_a_file(spark):
    """Whether such addresses are cells depends on the book: one that has longer sheets than a file can is none."""
    rows = [("long", 1_200_000, 1, None), ("long", 1_200_000, 2, "A1200000*2"), ("short", 1, 1, "A1200000*2")]
    cells = spark.createDataFrame(rows, "book string, row int, col int, formula string")
    cells = cells.select("book", F.lit("S").alias("sheet"), F.lit("s").alias("sheet_lc"), "row", "col", (F.col("row").cast("long") * 16_384 + F.col("col")).alias("ord"), F.lit("number").alias("type"), F.lit(1.0).alias("num"), *(F.lit(None).cast(t).alias(n) for n, t in (("str", "string"), ("bool", "boolean"), ("ts", "timestamp"))), "formula", F.lit(None).cast("boolean").alias("bold"))
    w = Workspace(spark, cells)
    assert {(r.book, r.kind, r.r0) for r in w.edges.collect()} == {("long", "cell", 1_200_000), ("short", "name", None)}
    assert [(r.book, r.message) for r in w.warnings.collect()] == [("short", 'Formula(s) reference undefined name "A1200000" (first seen at S!A1)')]
