import json
import shutil

import pytest

from gridengine import cli
from gridengine.plans.workspace import Workspace
from gridengine.streaming import ingest

from gridengine.sources import workbooks as made


@pytest.fixture(autouse=True)
def loaded_once(monkeypatch, sample_file, sample, three_files, three):
    """The fixtures' books are read and their regions found once; other files are loaded as ever."""
    known, load = {sample_file: sample, tuple(three_files): three}, Workspace.load
    monkeypatch.setattr(cli.Workspace, "load", lambda spark, paths: known.get(paths[0] if len(paths) == 1 else tuple(paths)) or load(spark, paths))


@pytest.mark.parametrize(
    "argv, want",
    [
        (["load"], ["Sheets (3):", "[rg_1hqooki] Sales!A3:F35  table  33×6", "TotalRevenue → Sales!$F$35", "External workbooks referenced: Budget.xlsx"]),
        (["inspect", "Sales!F35"], ["=SUM(F4:F33)", "named ranges: TotalRevenue", "dependents: Summary!C2"]),
        (["region", "--list"], ["[rg_1ayprhb] Rates!A1:B5  table"]),
        (["region", "Sales!B7", "-m", "evidence"], ["key column: Date", "- totals: Sales!F35"]),
        (["context", "Summary!C2", "-b", "1500"], ["Seed Summary!C2", "Regions (3):", "Precedent trace:", "→(formula 0.75) rg_1hqooki"]),
        (["map", "Rates"], ["Sheet Rates (HIDDEN)", "reference mapping"]),
        (["extract", "rg_b9u3gj", "--limit", "2"], ["rows 1–2 of 4", "Sales!H4:I4", "North | 5000"]),
        (["precedents", "Summary!C3"], ["Summary!C3", "└─ Summary!C2", "dominant pattern =D4*E4 (30×)"]),
        (["dependents", "Sales!F35"], ["└─ Summary!C2"]),
        (["find", "5750"], ["Sales!I7  5750  [number]"]),
        (["find", "^north$", "--regex", "--limit", "1"], ["Sales!B4  North  [string]"]),
    ],
)
def test_commands(spark, sample_file, capsys, argv, want):
    assert cli.main([argv[0], sample_file, *argv[1:]], spark) == 0
    said = capsys.readouterr().out
    assert all(w in said for w in want), said


def test_locate_json_and_errors(spark, sample_file, capsys):
    assert cli.main(["locate", "which rates are hidden?", sample_file, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["range_a1"] == "Rates!A1:B5"
    assert cli.main(["inspect", sample_file, "Nowhere!A1"], spark) == 1 and 'sheet "Nowhere" not found' in capsys.readouterr().err
    assert cli.main(["load", "missing.xlsx"], spark) == 1 and "file not found" in capsys.readouterr().err


def test_collection(spark, three_files, capsys):
    files = three_files
    assert cli.main(["collection", *files, "--links"], spark) == 0
    said = capsys.readouterr().out
    assert "NOT LOADED" in said and "GrandTotal" in said and "4 shared" in said
    assert cli.main(["collection", *files, "--precedents", "[summary-2026.xlsx]Dash!C2"], spark) == 0
    assert "[sales-2026.xlsx]Sales!D15" in capsys.readouterr().out


def test_stream_keeps_the_latest_file(spark, sample_file, tmp_path):
    folder, target, state = tmp_path / "in", str(tmp_path / "cells"), str(tmp_path / "state")
    folder.mkdir()
    shutil.copy(sample_file, folder / "a.xlsx")
    ingest.ingest(spark, str(folder), target, state).awaitTermination(120)
    assert spark.read.parquet(target).where("book = 'a.xlsx'").count() > 200
    made.write(tmp_path / "new.xlsx", [made.Sheet("S").put("A1", 1)])
    (folder / "next").mkdir()
    shutil.copy(tmp_path / "new.xlsx", folder / "next" / "a.xlsx")
    made.write(folder / "b.xlsx", [made.Sheet("S").put("A1", "x").put("B1", "y")])
    ingest.ingest(spark, str(folder), target, state).awaitTermination(120)
    got = {r.book: r["count"] for r in spark.read.parquet(target).groupBy("book").count().collect()}
    assert got == {"a.xlsx": 1, "b.xlsx": 2}
    # An older file that arrives late changes nothing; a latest one without cells leaves none.
    import os

    made.write(tmp_path / "empty.xlsx", [made.Sheet("S")])
    for name, source, age in (("old", sample_file, 10**9), ("last", tmp_path / "empty.xlsx", None)):
        (folder / name).mkdir()
        book = "a.xlsx" if name == "old" else "b.xlsx"
        shutil.copy(source, folder / name / book)
        if age:
            os.utime(folder / name / book, (age, age))
    ingest.ingest(spark, str(folder), target, state).awaitTermination(120)
    got = {r.book: r["count"] for r in spark.read.parquet(target).groupBy("book").count().collect()}
    assert got == {"a.xlsx": 1}


def test_windowed_counts(spark, sf):
    n = ingest.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).agg({"n": "sum"}).first()[0]
    assert n == spark.read.parquet(f"{sf}/events.parquet").count()
