"""Tables as answers: plain dicts for JSON, and texts for reading."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import collection, diffuse, extract, graph, locate, search, summarise
from .workspace import Workspace


def _value(x: str | None):
    return None if x is None else json.loads(x)


def _where(ws: Workspace, address: str):
    return diffuse.point(ws, *diffuse.resolve(ws, address))


def region_at(ws: Workspace, target: str):
    """A region by id or by an address inside it."""
    if target.startswith("rg_"):
        found = ws.regions.where(F.col("region_id") == target).first()
        if found is None:
            raise ValueError(f'region id "{target}" not found')
        return found
    book, sheet, row, col = diffuse.resolve(ws, target)
    at = ws.regions.where((F.col("book") == book) & (F.col("sheet_lc") == sheet.lower()) & F.lit(row).between(F.col("r0"), F.col("r1")) & F.lit(col).between(F.col("c0"), F.col("c1")))
    found = at.orderBy("r0", "c0").first()
    if found is None:
        raise ValueError(f'no region at "{target}": the cell is outside any')
    return found


def overview(ws: Workspace) -> dict:
    o = search.overview(ws).first()
    if o is None:
        return {"sheets": [], "definedNames": [], "totalCells": 0, "totalFormulaCells": 0, "externalRefs": [], "regionsBySheet": {}, "warnings": []}
    d = o.asDict(True)
    regions = {s["sheet"]: s.pop("regions") or [] for s in d["sheets"]}
    return {"sheets": d["sheets"], "definedNames": d["names"] or [], "totalCells": d["cells"], "totalFormulaCells": d["formula_cells"], "externalRefs": d["externals"] or [], "regionsBySheet": regions, "warnings": d["warnings"] or []}


def inspection(ws: Workspace, address: str, across: bool = False) -> dict:
    d = search.inspect(ws, _where(ws, address), across).first().asDict(True)
    d["value"] = _value(d["value"])
    if d["merged"]:
        d["merged"]["value"] = _value(d["merged"]["value"])
    if d["region_id"]:
        d["region"] = ws.regions.where((F.col("region_id") == d["region_id"]) & (F.col("book") == d["book"])).select(*search.BRIEF).first().asDict()
    return {k: v for k, v in d.items() if v is not None or k == "value"}


def regions(ws: Workspace, sheet: str | None = None) -> list[dict]:
    r = ws.regions if sheet is None else ws.regions.where(F.col("sheet_lc") == sheet.lower())
    r = r.join(ws.sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"])
    return [x.asDict() for x in r.orderBy("book", "sheet_idx", "r0", "c0").select(*search.BRIEF).collect()]


def summary(ws: Workspace, target: str, mode: str = "summary", budget: int | None = None) -> dict:
    r = region_at(ws, target).asDict(True)
    return summarise.summary(r, summarise.region_cells(ws, r, mode), mode, budget)


def maps(ws: Workspace, sheet: str | None = None) -> list[dict]:
    m = search.sheet_map(ws)
    m = m if sheet is None else m.where(F.lower("sheet") == sheet.lower())
    out = [x.asDict(True) for x in m.orderBy("book", "sheet_idx").collect()]
    if sheet is not None and not out:
        raise ValueError(f'sheet "{sheet}" not found')
    return out


def located(ws: Workspace, question: str, top: int = 8) -> list[dict]:
    return [x.asDict(True) for x in locate.locate(ws.regions, [question], top).orderBy("rank").collect()]


def extracted(ws: Workspace, target: str, **how) -> dict:
    return extract.extract(ws, region_at(ws, target), **how).packed()


def precedents(ws: Workspace, address: str, depth: int = 3, across: bool = False) -> dict:
    return graph.nested(graph.trace_precedents(ws, _where(ws, address), depth, across, across).collect())


def dependents(ws: Workspace, address: str, depth: int = 2, across: bool = False) -> dict:
    return graph.nested(graph.trace_dependents(ws, _where(ws, address), depth, across, across).collect())


def found(ws: Workspace, query, **how) -> list[dict]:
    out = [x.asDict() for x in search.find(ws, query, **how).collect()]
    return [{"workbook": d["book"], "address": d["address"], "value": _value(d["value"]), "type": d["type"], "region_id": d["region_id"]} for d in out]


# ---- texts: each is a report of parts; a part has a heading and rows, and rows of one part line up --------------


def _lines(rows, indent: str = "  ") -> list[str]:
    """Rows of one part: texts as they are, tuples in columns as wide as their widest entry, the last one free."""
    told = [r if isinstance(r, str) else tuple("" if x is None else str(x) for x in r) for r in rows]
    tuples = [r for r in told if isinstance(r, tuple)]
    wide = [max((len(r[k]) for r in tuples if k < len(r) - 1), default=0) for k in range(max(map(len, tuples), default=0))]
    out = [r if isinstance(r, str) else "  ".join([x.ljust(w) for x, w in zip(r[:-1], wide)] + [r[-1]]).rstrip() for r in told]
    return [indent + line for text in out for line in text.split("\n")]


def _report(*parts: tuple) -> str:
    """Parts (heading, rows) one below another. A part whose rows are an empty list is left out; None: a heading alone."""
    return "\n".join(line for heading, rows in parts if heading and (rows is None or rows) for line in (heading, *_lines(rows or ())))


def _shorter(rows: list, most: int, what: str) -> list:
    return rows if len(rows) <= most else [*rows[:most], f"… {len(rows) - most} more{what}"]


def _in(book: str | None, text: str) -> str:
    return f"[{book}]{text}" if book else text


def _titled(r: dict) -> str:
    return f"“{r['title']}”" if r["title"] else ""


def brief_text(r: dict) -> str:
    return "  ".join(x for x in (f"[{r['region_id']}] {r['range_a1']}", r["kind"], f"{r['row_count']}×{r['col_count']}", f"confidence {r['confidence']}", _titled(r)) if x)


def overview_text(o: dict) -> str:
    sheets = [("sheet", "", "used", "cells", "formulas")]
    sheets += [(s["sheet"], "hidden" if s["hidden"] else "", s["used_range"] or "(empty)", s["cell_count"], s["formula_cell_count"]) for s in o["sheets"]]
    return _report(
        (f"Sheets ({len(o['sheets'])}): {o['totalCells']} cells, {o['totalFormulaCells']} formulas", sheets),
        ("Regions:", [brief_text(r) for s in o["sheets"] for r in o["regionsBySheet"][s["sheet"]]]),
        (f"Named ranges ({len(o['definedNames'])}):", _shorter([f"{n['name']} → {', '.join(n['ranges'])}" for n in o["definedNames"]], 20, " names")),
        (f"External workbooks referenced: {', '.join(o['externalRefs'])}" if o["externalRefs"] else "", None),
        ("Warnings:", _shorter(o["warnings"], 8, " warnings")),
    )


def inspection_text(i: dict) -> str:
    style = [k for k in ("bold", "italic") if i.get(k)] + [f"{label} {i[k]}" for k, label in (("num_fmt", "format"), ("fill", "fill")) if k in i]
    m = i.get("merged")
    refs = [f"{p['raw']} → " + (f'external "{p["external"]}"' if p["external"] else p["target"] or "(unresolved)") for p in i.get("precedents") or ()]
    more = i["dependents_total"] - len(i["dependents"] or ())
    facts = {
        "value": f"{'(empty)' if i['value'] is None else i['value']} [{i['type']}]",
        "formula": f"={i['formula']}" if "formula" in i else "",
        "style": ", ".join(style),
        "link": i.get("hyperlink"),
        "merged": f"{m['range']}, shows {m['master']} = {m['value']}" if m else "",
        "region": brief_text(i["region"]) if "region" in i else "",
        "refers to": "; ".join(refs),
        "dependents": ", ".join(i["dependents"] or ()) + (f" and {more} more" if more else ""),
        "named ranges": ", ".join(i["names"] or ()),
        "in other workbooks": ", ".join(i.get("cross_dependents") or ()),
        "note": "" if i["exists"] else "nothing is stored in this cell",
    }
    return _report((i["address"] + (" (hidden sheet)" if i.get("sheet_hidden") else ""), [f"{k}: {v}" for k, v in facts.items() if v]))


def _node_text(n: dict) -> str:
    value = f" = {n['value']}" if n.get("value") is not None and n["kind"] != "range" else ""
    told = [f"={n['formula']}" if "formula" in n else "", f"{n['cellCount']} cells" if "cellCount" in n else "", "cycle" if n.get("cycle") else "", "cut here" if n.get("truncated") else "", n.get("note") or ""]
    return n["address"] + value + "".join(f"  · {t}" for t in told if t)


def _branches(n: dict) -> list[str]:
    """A node's line and its children's, theirs drawn below it."""
    out = [_node_text(n)]
    for left, child in zip(range(len(n["children"]) - 1, -1, -1), n["children"]):
        first, *rest = _branches(child)
        out += [("├─ " if left else "└─ ") + first, *(("│  " if left else "   ") + x for x in rest)]
    return out


def trace_text(node: dict) -> str:
    return "\n".join(_branches(node))


def summary_text(s: dict, place: int | None = None) -> str:
    head = f"[{s['regionId']}] {s['kind']} {_in(s.get('workbook'), s['rangeA1'])}: {s['mode']}, ~{s['tokens']} tokens" + (", shortened" if s["truncated"] else "")
    data = [json.dumps(s["data"], indent=2, ensure_ascii=False, default=str)] if "data" in s else []
    return _report((head if place is None else f"{place}. {head}", [s["text"], *data, f"from: {', '.join(s['sourceCells'])}"]))


def packet_text(p: dict) -> str:
    c, o = p["seedCell"], p["options"]
    seed = [f"value: {'(empty)' if c['value'] is None else c['value']} [{c['type']}]", *([f"formula: ={c['formula']}"] if "formula" in c else []), *([f"region: {c['regionId']}"] if "regionId" in c else [])]
    seed += [f"names: {', '.join(c['namedRanges'])}"] if c["namedRanges"] else []
    seed += [f"asked: depth {o['depth']}, {o['mode']}; ~{p['tokens']} of {o['token_budget']} tokens{', shortened' if p['truncated'] else ''}"]
    trace = p["trace"] or {}
    return _report(
        (f"Seed {p['seed']}", seed),
        (f"Regions ({len(p['regions'])}):", [summary_text(r, k) for k, r in enumerate(p["regions"], 1)]),
        *((f"{name} trace:", _branches(trace[k]) if trace.get(k) else []) for k, name in (("precedents", "Precedent"), ("dependents", "Dependent"))),
        ("Relations:", [f"{r['from']} →({r['type']} {r['weight']}) {r['to']}: {r['why']}" for r in p["relations"]]),
        ("Next actions:", [f"{k}. {x}" for k, x in enumerate(p["nextActions"], 1)]),
        ("Warnings:", p["warnings"]),
    )


def map_text(m: dict) -> str:
    rows = []
    for r in m["regions"] or ():
        told = [r["purpose"] or r["kind"], f"{r['sections']} sections" if r["sections"] else "", "has notes" if r["has_notes"] else "", f"confidence {r['confidence']}", _titled(r), f"headers {', '.join(r['headers'])}" if r["headers"] else ""]
        rows.append((f"[{r['region_id']}]", r["range_a1"], r["kind"], f"{r['rows']}×{r['cols']}", ", ".join(t for t in told if t)))
    head = f"Sheet {m['sheet']}" + (" (HIDDEN)" if m["hidden"] else "") + f", {m['used_range'] or 'empty'}" + (f": {m['purpose']}" if m["purpose"] else "")
    return _report((head, rows or None), ("Notes:", _shorter(m["notes"] or [], 6, " notes")))


def hits_text(hits: list[dict], books: bool) -> str:
    rows = [(f"{h['rank']}.", h["score"], f"[{h['region_id']}]", h["kind"], _in(h["book"] if books else None, h["range_a1"]) + (" (hidden sheet)" if h["hidden_sheet"] else ""), f"{h['purpose'] or ''} ({h['why']})".strip()) for h in hits]
    return "\n".join(_lines(rows, "")) or "no matching regions"


def extract_text(t: dict) -> str:
    names = [c["name"] for c in t["columns"]]
    rows = [(source, " | ".join("" if row[n] is None else str(row[n]) for n in names)) for row, source in zip(t["rows"], t["rowProvenance"])]
    sections = [f"{s['label'] or '(unlabelled)'}: rows {s['rows'][0]}–{s['rows'][1]}" for s in t.get("sections") or ()]
    return _report(
        (f"[{t['regionId']}] {_in(t.get('workbook'), t['rangeA1'])}, rows {t['offset'] + 1}–{t['offset'] + t['returned']} of {t['totalDataRows']}{', complete' if t['complete'] else ''}, ~{t['tokens']} tokens", None),
        ("columns: " + " | ".join(c["name"] + (f" ({c['role']})" if "role" in c else "") for c in t["columns"]), _shorter(rows, 12, " rows") or None),
        ("left out as subtotals: " + ", ".join(map(str, t["excludedSubtotalRows"])) if t.get("excludedSubtotalRows") else "", None),
        ("Sections:", sections),
        ("Warnings:", t["warnings"]),
    )


def links_text(o: dict) -> str:
    links = []
    for g in o["formulaLinks"]:
        links.append(f"{g['from_book']} → {g['to_book'] or g['external'] + ' (NOT LOADED)'}: {g['ref_count']} reference(s) from {', '.join(g['cells'])}" + (f" into {', '.join(g['targets'])}" if g["targets"] else ""))
    data = [f"{_in(d['a_book'], d['a_range_a1'])} ({d['a_column']}) ⋈ {_in(d['b_book'], d['b_range_a1'])} ({d['b_column']}): {d['shared']} shared, e.g. {', '.join(d['sample'])}" for d in o["dataLinks"]]
    return _report(
        (f"Formula links ({len(o['formulaLinks'])}):", links or ["(none)"]),
        (f"Shared defined names ({len(o['sharedNames'])}):", [f"{n['name']}: " + "; ".join(f"{u['book']} {', '.join(u['ranges'])}" for u in n["uses"]) for n in o["sharedNames"]]),
        (f"Regions with key values in common ({len(o['dataLinks'])}):", _shorter(data, 10, " links")),
        ("External workbooks that are not loaded:", [f"{u['external']}: {u['ref_count']} reference(s) from {', '.join(u['from_books'])}, e.g. {', '.join(u['cells'])}" for u in o["unresolved"]]),
    )


def collection_text(o: dict) -> str:
    rows = [("book", "sheets", "hidden", "cells", "formulas", "regions")] + [tuple(w[k] for k in ("book", "sheets", "hidden_sheets", "cells", "formula_cells", "regions")) for w in o["workbooks"]]
    return "\n".join(x for x in (_report((f"Workbooks ({len(o['workbooks'])}):", rows)), links_text(o), _report(("Warnings:", _shorter(o["warnings"], 8, " warnings")))) if x)


def linked(ws: Workspace) -> dict:
    return collection.overview(ws)
