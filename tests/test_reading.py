import pytest
from pyspark.sql import functions as F

from gridengine.operators import extract, locate, summarise
from gridengine.plans.workspace import Workspace

from gridengine.sources import workbooks as made


def region(ws, a1):
    return ws.regions.where(F.col("range_a1") == a1).first()


def test_extract_leaves_subtotals_out(zoom):
    x = extract.extract(zoom, region(zoom, "Spend!A3:E11"))
    t = x.packed()
    assert [r["Org · Dept"] for r in t["rows"]] == ["Engineering", "Engineering", "Sales", "Sales"] and sum(r["Amounts · Payroll"] for r in t["rows"]) == 380
    assert t["rowProvenance"][0] == "Spend!A5:E5" and t["excludedSubtotalRows"] == [7, 10] and t["complete"]
    assert t["subtotals"][0]["label"] == "Engineering — Subtotal" and t["subtotals"][0]["values"]["Amounts · Total"] == 320
    assert t["sections"] == [{"label": "Engineering", "rows": [5, 6]}, {"label": "Sales", "rows": [8, 9]}]
    assert x.rows.agg(F.sum("`Amounts · Payroll`")).first()[0] == 380
    with_all = extract.extract(zoom, region(zoom, "Spend!A3:E11"), include_subtotals=True)
    assert with_all.packed()["returned"] == 6 and "INCLUDED" in with_all.warnings[0] and with_all.subtotals is None


def test_extract_pages_columns_and_types(sample):
    r = region(sample, "Sales!A3:F35")
    t = extract.extract(sample, r, offset=10, limit=5, columns=["rev", "region"])
    p = t.packed()
    assert [c["name"] for c in p["columns"]] == ["Region", "Revenue"] and p["returned"] == 5 and p["totalDataRows"] == 30 and not p["complete"] and p["offset"] == 10
    assert dict(extract.extract(sample, r).rows.dtypes) == {"row": "int", "Date": "timestamp", "Region": "string", "Product": "string", "Units": "double", "Unit Price": "double", "Revenue": "double", "provenance": "string"}
    assert extract.extract(sample, r).packed()["rows"][0] == {"Date": "2026-01-01", "Region": "North", "Product": "Widget", "Units": 5, "Unit Price": 9.99, "Revenue": pytest.approx(49.95)}
    none = extract.extract(sample, r, columns=["zzz"])
    assert "no columns matched" in none.warnings[0]
    assert extract.extract(sample, r, qualified=True, limit=1).packed()["rowProvenance"] == ["[sample.xlsx]Sales!A4:F4"]
    got = {(x.region_id, x.row): x.provenance for x in extract.provenance(sample).collect()}
    assert got["rg_1hqooki", 4] == "Sales!A4:F4" and len([k for k in got if k[0] == "rg_1hqooki"]) == 30


def test_locate(sample, zoom):
    hits = locate.locate(sample.regions, ["What are the rates by region? hidden lookup", "revenue by product", "zzzz"]).orderBy("question", "rank").collect()
    first = {q: next((h for h in hits if h.question == q), None) for q in {h.question for h in hits}}
    assert first["What are the rates by region? hidden lookup"].range_a1 == "Rates!A1:B5" and first["What are the rates by region? hidden lookup"].why.endswith("region is on a hidden sheet")
    assert first["revenue by product"].range_a1 == "Sales!A3:F35" and "zzzz" not in first
    z = locate.locate(zoom.regions, ["how much payroll does each department spend?"]).orderBy("rank").collect()
    assert z[0].range_a1 == "Spend!A3:E11" and z[0].matched[:2] == ["spend", "payroll"] and "“spend” in sheet" in z[0].why
    assert locate.locate(zoom.regions, ["moola"], synonyms=[["moola", "payroll"]]).count() == 1


def test_summary_levels(sample):
    r = region(sample, "Sales!A3:F35").asDict(True)
    cells = summarise.region_cells(sample, r, "audit")
    s = summarise.summary(r, cells)
    assert s["text"] == (
        "Table Sales!A3:F35 — “ACME Q1 Sales” · 30 data rows × 6 columns (Date, Region, Product, Units, Unit Price, Revenue) · key column: Date · Revenue is computed (=D4*E4)"
        " · Revenue: sum 15,601.05, range 49.95–1,349.46 · Date spans 2026-01-01 → 2026-01-30 · totals row at 35 (F35=15,601.05)"
    )
    e = summarise.summary(r, cells, "evidence")
    assert "- headers at Sales!A3:F3" in e["text"] and "- totals: Sales!F35 =SUM(F4:F33) → 15,601.05" in e["text"] and "- sample row 4: A4=2026-01-01, B4=North" in e["text"] and "Sales!F35" in e["sourceCells"]
    c = summarise.summary(r, cells, "cells")
    assert len(c["data"]["cells"]) == 188 and c["data"]["cells"][0] == {"a": "Sales!A3", "v": "Date", "t": "string"}
    f = summarise.summary(r, cells, "formulas")
    assert len(f["data"]["formulas"]) == 31 and f["data"]["formulas"][0]["refs"] == ["D4", "E4"] and f["data"]["templates"][0]["example"] == "=D4*E4"
    assert summarise.summary(r, cells, "audit")["data"]["cells"][0]["s"]["bold"]


def test_budgets(sample):
    r = region(sample, "Sales!A3:F35").asDict(True)
    cells = summarise.region_cells(sample, r, "audit")
    for mode in summarise.MODES:
        for budget in (60, 150, 400, 1500):
            s = summarise.summary(r, cells, mode, budget)
            assert s["tokens"] <= budget + 16 * ("data" in s)  # a note says that a list was dropped
    assert summarise.summary(r, cells, "cells", 600)["data"]["omitted"] > 0


def test_all_regions_at_once(sample, zoom):
    for ws in (sample, zoom):
        got = {r.region_id: r for r in summarise.summaries(ws, "evidence").collect()}
        for r in ws.regions.collect():
            d = r.asDict(True)
            s = summarise.summary(d, summarise.region_cells(ws, d, "evidence"), "evidence")
            assert (got[r.region_id].text, got[r.region_id].tokens, got[r.region_id].source_cells) == (s["text"], s["tokens"], s["sourceCells"])
