"""Workbooks from the command line: ``python -m gridengine.cli load book.xlsx``."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .operators import diffuse
from .operators.summarise import MODES
from .plans import answers as a
from .plans.workspace import Workspace


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("expected a non-negative integer")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridengine", description="Explore workbooks: regions, formulas, rows, and context within a token budget.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *more: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for m in more:
            c.add_argument(m.rstrip("?+"), nargs={"?": "?", "+": "+"}.get(m[-1]))
        c.add_argument("--json", action="store_true")
        return c

    command("load", "structure of a workbook", "file")
    command("inspect", "one cell", "file", "address")
    c = command("region", "list regions, or summarise one", "file", "target?")
    c.add_argument("--list", action="store_true")
    c.add_argument("-s", "--sheet")
    c.add_argument("-m", "--mode", choices=MODES, default="compact")
    c.add_argument("-b", "--budget", type=_count)
    c = command("context", "context around a cell", "file", "address")
    c.add_argument("-d", "--depth", type=_count, default=2)
    c.add_argument("-m", "--mode", choices=MODES, default="compact")
    c.add_argument("-b", "--budget", type=_count, default=2000)
    c.add_argument("--max-regions", type=_count, default=8)
    c.add_argument("--no-trace", action="store_true")
    c.add_argument("-q", "--question")
    command("map", "regions of sheets at a glance", "file", "sheet?")
    c = command("locate", "regions for a question", "question", "files+")
    c.add_argument("--top", type=_count, default=8)
    c = command("extract", "rows of a region", "file", "target")
    c.add_argument("--offset", type=_count, default=0)
    c.add_argument("--limit", type=_count)
    c.add_argument("--columns")
    c.add_argument("--include-subtotals", action="store_true")
    for name, depth in (("precedents", 3), ("dependents", 2)):
        command(name, f"{name} of a cell", "file", "address").add_argument("-d", "--depth", type=_count, default=depth)
    c = command("find", "search values", "file", "query")
    c.add_argument("-s", "--sheet")
    c.add_argument("--regex", action="store_true")
    c.add_argument("--limit", type=_count, default=50)
    c = command("collection", "several workbooks", "files+")
    c.add_argument("--links", action="store_true")
    for o in ("--inspect", "--context", "--precedents", "--dependents", "--find"):
        c.add_argument(o)
    c.add_argument("-d", "--depth", type=_count, default=3)
    c.add_argument("-m", "--mode", choices=MODES, default="compact")
    c.add_argument("-b", "--budget", type=_count, default=2500)
    return p


def _query(text: str, regex: bool):
    return f"(?i){text}" if regex else float(text) if re.fullmatch(r"-?\d+(\.\d+)?", text) else text


def _hits(hits: list[dict]) -> str:
    return "\n".join(f"{h['address']}  {h['value']}  [{h['type']}]" for h in hits) or "no matches"


def answer(ws: Workspace, o: argparse.Namespace) -> tuple[object, Callable[[], str]]:
    """The answer as data, and how it reads."""
    if o.command == "load":
        x = a.overview(ws)
        return x, lambda: a.overview_text(x)
    if o.command == "inspect":
        x = a.inspection(ws, o.address)
        return x, lambda: a.inspection_text(x)
    if o.command == "region":
        if o.list or o.target is None:
            x = a.regions(ws, o.sheet)
            return x, lambda: "\n".join(map(a.brief_text, x))
        x = a.summary(ws, o.target, o.mode, o.budget)
        return x, lambda: a.summary_text(x)
    if o.command == "context":
        x = diffuse.expand(ws, o.address, depth=o.depth, mode=o.mode, token_budget=o.budget, max_regions=o.max_regions, include_trace=not o.no_trace, question=o.question)
        return x, lambda: a.packet_text(x)
    if o.command == "map":
        x = a.maps(ws, o.sheet)
        return (x[0] if o.sheet else x), lambda: "\n\n".join(map(a.map_text, x))
    if o.command == "locate":
        x = a.located(ws, o.question, o.top)
        return x, lambda: a.hits_text(x, len(o.files) > 1)
    if o.command == "extract":
        columns = [c.strip() for c in o.columns.split(",")] if o.columns else None
        x = a.extracted(ws, o.target, offset=o.offset, limit=o.limit, columns=columns, include_subtotals=o.include_subtotals)
        return x, lambda: a.extract_text(x)
    if o.command in ("precedents", "dependents"):
        x = getattr(a, o.command)(ws, o.address, o.depth)
        return x, lambda: a.trace_text(x)
    if o.command == "find":
        x = a.found(ws, _query(o.query, o.regex), sheet=o.sheet, limit=o.limit, regex=o.regex)
        return x, lambda: _hits(x)
    return _collection(ws, o)


def _collection(ws: Workspace, o: argparse.Namespace) -> tuple[object, Callable[[], str]]:
    if o.inspect:
        x = a.inspection(ws, o.inspect, across=True)
        return x, lambda: a.inspection_text(x)
    if o.context:
        x = diffuse.expand_across(ws, o.context, depth=o.depth, mode=o.mode, token_budget=o.budget)
        return x, lambda: a.packet_text(x)
    for name in ("precedents", "dependents"):
        if address := getattr(o, name):
            x = getattr(a, name)(ws, address, o.depth, across=True)
            return x, lambda: a.trace_text(x)
    if o.find:
        x = a.found(ws, _query(o.find, False))
        return x, lambda: _hits([h | {"address": f"[{h['workbook']}]{h['address']}"} for h in x])
    x = a.linked(ws)
    if o.links:
        return {k: x[k] for k in ("formulaLinks", "sharedNames", "dataLinks", "unresolved")}, lambda: a.links_text(x)
    return x, lambda: a.collection_text(x)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    files = o.files if "files" in o else [o.file]
    try:
        for f in files:
            if "://" not in f and not os.path.exists(f):
                raise ValueError(f"file not found: {f}")
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        data, text = answer(Workspace.load(spark, files), o)
        print(json.dumps(data, indent=2, ensure_ascii=False, default=str) if o.json else text())
    except ValueError as e:
        print(f"gridengine: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
