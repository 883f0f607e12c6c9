import pytest
from pyspark.sql import functions as F

from gridengine.operators import collection, diffuse
from gridengine.plans.workspace import Workspace

from gridengine.sources import workbooks as made


def test_packet(sample):
    p = diffuse.expand(sample, "Summary!C2")
    assert p["seed"] == "Summary!C2" and [r["regionId"] for r in p["regions"]][:2] == ["rg_l2zijg", "rg_1hqooki"]
    assert [(r["type"], r["weight"]) for r in p["relations"]][:2] == [("structural", 0.9), ("formula", 0.75)]
    assert {r["regionId"]: r["mode"] for r in p["regions"]} == {"rg_l2zijg": "compact", "rg_1hqooki": "compact", "rg_1ayprhb": "compact"}
    assert p["trace"]["precedents"]["children"][0]["address"] == "Sales!F35" and p["trace"]["dependents"]["children"][0]["address"] == "Summary!C3"
    assert p["tokens"] <= 2000 and not p["truncated"] and 'lives on hidden sheet "Rates"' in " ".join(p["warnings"])
    assert any("findValue" in a or "summariseRegion" in a for a in p["nextActions"])


def test_stop_rules(sample):
    tight = diffuse.expand(sample, "Summary!C2", token_budget=260)
    assert tight["truncated"] and len(tight["nextActions"]) == 6 and tight["tokens"] <= 260
    assert len(diffuse.expand(sample, "Summary!C2", max_regions=1)["regions"]) == 1
    zero = diffuse.expand(sample, "Summary!C2", depth=0)
    assert len(zero["regions"]) == 1 and zero["trace"] is None
    evidence = diffuse.expand(sample, "Summary!C2", mode="evidence", token_budget=4000)
    assert [r["mode"] for r in evidence["regions"]][:2] == ["evidence", "compact"]


def test_odd_seeds_and_questions(sample):
    empty = diffuse.expand(sample, "Sales!Z60")
    assert "Seed cell Sales!Z60 is empty" in empty["warnings"] and empty["relations"][0]["type"] == "spatial"
    assert "external workbook" in diffuse.expand(sample, "Summary!C5")["warnings"][0]
    asked = diffuse.expand(sample, "Sales!H4", question="which rates apply? hidden mapping")
    assert any(r["to"] == "rg_1ayprhb" and "question" in r["why"] for r in asked["relations"])
    for bad in ("Nowhere!A1", "A0", "[other.xlsx]S!A1"):
        with pytest.raises(ValueError):
            diffuse.expand(sample, bad)
    assert diffuse.resolve(sample, "f35") == ("sample.xlsx", "Sales", 35, 6)


def test_collection_overview(three):
    o = collection.overview(three)
    assert [w["book"] for w in o["workbooks"]] == ["summary-2026.xlsx", "sales-2026.xlsx", "targets.xlsx"] and [w["regions"] for w in o["workbooks"]] == [1, 1, 1]
    assert [(g["external"], g["to_book"], g["ref_count"]) for g in o["formulaLinks"]] == [("sales-2026.xlsx", "sales-2026.xlsx", 1), ("targets.xlsx", "targets.xlsx", 1), ("budget-2026.xlsx", None, 1)]
    assert [(u["external"], u["ref_count"], u["cells"]) for u in o["unresolved"]] == [("budget-2026.xlsx", 1, ["[summary-2026.xlsx]Dash!C4"])]
    assert [n["name"] for n in o["sharedNames"]] == ["GrandTotal"] and [u["book"] for u in o["sharedNames"][0]["uses"]] == ["sales-2026.xlsx", "targets.xlsx"]
    d = o["dataLinks"]
    assert [(x["a_book"], x["a_column"], x["b_book"], x["b_column"], x["shared"], x["coverage_a"], x["coverage_b"]) for x in d] == [("sales-2026.xlsx", "Region", "targets.xlsx", "Region", 4, 1.0, 1.0)]
    assert d[0]["sample"] == ["north", "south", "east"] and "budget-2026.xlsx" in o["warnings"][0]


def test_packet_across_books(three):
    p = diffuse.expand_across(three, "[summary-2026.xlsx]Dash!C2")
    assert p["seed"] == "[summary-2026.xlsx]Dash!C2" and [(r["workbook"], r["regionId"]) for r in p["regions"]] == [("summary-2026.xlsx", "rg_n23its"), ("sales-2026.xlsx", "rg_ddbqgc"), ("targets.xlsx", "rg_1qt9xpp")]
    assert p["trace"]["precedents"]["children"][0]["address"] == "[sales-2026.xlsx]Sales!D15" and len(p["crossLinks"]) == 3 and p["tokens"] <= 2500
    assert any("budget-2026.xlsx" in a for a in p["nextActions"])
    s = diffuse.expand_across(three, "[sales-2026.xlsx]Sales!D15")
    why = {r["to"]: r["why"] for r in s["relations"]}
    assert "depends on the seed" in why["[summary-2026.xlsx]rg_n23its"] and "GrandTotal" in why["[targets.xlsx]rg_1qt9xpp"]


def test_same_name_twice_is_refused(spark):
    with pytest.raises(ValueError):
        Workspace.load(spark, ["a/x.xlsx", "b/X.xlsx"])


def test_region_edges_and_union(spark, sample, three, tmp_path):
    from gridengine.operators import region_edges

    got = {(r.src, r.dst, r.type) for r in region_edges.region_edges(sample).collect()}
    assert ("rg_l2zijg", "rg_1hqooki", "formula") in got and ("rg_1hqooki", "rg_b9u3gj", "spatial") in got
    both = Workspace.load(spark, made.write(tmp_path / "other.xlsx", [made.Sheet("S").put("A1", 1, "[targets.xlsx]Targets!B7")])).union(three)
    assert both.order[0] == "other.xlsx" and [u["book"] for u in collection.overview(both)["sharedNames"][0]["uses"]] == ["sales-2026.xlsx", "targets.xlsx"]
    assert [(g["from_book"], g["to_book"]) for g in collection.overview(both)["formulaLinks"]][0] == ("other.xlsx", "targets.xlsx")
    with pytest.raises(ValueError):
        both.union(three)
