"""Dependents and traces over the reference graph, for many cells at once.

A vertex is (book, sheet, row, col), so traces cross books without special cases. Traces are unrolled level by level: a level
is a few joins over a written frontier; nodes come out flat with their place in the tree and are nested only for one root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import format_cell, format_range, range_area
from ..functions.formula import relative_udf
from ..plans.tables import numbered, written
from ..sources.schema import value_json
from .edges import EXPAND, _last_names
from .rangejoin import containing

#: Places of a range that a trace looks at, formulas of it that it compares, and children of a node in a dependent trace.
SCAN, FORMULAS, CHILDREN = 2000, 500, 30
AT = ["book", "sheet_lc", "row", "col"]
NODE = "root string, pos array<int>, address string, kind string, value string, formula string, cell_count long, cycle boolean, truncated boolean, note string"


def links(ws) -> DataFrame:
    """Every reference to another book: (from_book, from_sheet, from_cell, row, col, ..., raw, external, to_book, to_range, r0, c0, r1, c1), in order.

    A book is found by its file name, with or without extension; numbers are not names. Open ends are cut to the target's used extent.
    """
    e = ws.edges.where("external is not null").join(ws.sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"])
    base = F.lower(F.element_at(F.split(F.replace("external", F.lit("\\"), F.lit("/")), "/"), -1))
    tries = F.array(base, F.concat(base, F.lit(".xlsx")), F.regexp_replace(base, r"\.(xlsx|xlsm|xls)$", ""))
    e = e.withColumn("link", F.struct("book", "sheet_idx", "ord", "ref_ord"))
    tried = e.select("link", F.posexplode(F.when(~base.rlike(r"^\d+$"), tries)).alias("k", "book_lc")).join(ws.books.select("book_lc", F.col("book").alias("to_book")), "book_lc")
    to = tried.groupBy("link").agg(F.min_by("to_book", "k").alias("to_book"))
    extent = ws.sheets.select(F.col("book").alias("to_book"), F.col("sheet_lc").alias("t_sheet_lc"), "max_row", "max_col", F.col("sheet").alias("t_name"))
    out = e.join(to, "link", "left").join(extent, ["to_book", "t_sheet_lc"], "left")
    cut = lambda end, most, start: F.when(F.col("open").isNotNull() & F.col(most).isNotNull(), F.least(end, F.greatest(most, start))).otherwise(F.col(end))
    out = out.withColumns({"r1": cut("r1", "max_row", "r0"), "c1": cut("c1", "max_col", "c0")})
    out = out.join(ws.books.select("book", "book_ord"), "book")
    return out.select(
        F.col("book").alias("from_book"), "book_ord", "sheet_idx", "ord", "ref_ord", F.col("sheet").alias("from_sheet"), F.col("sheet_lc").alias("from_sheet_lc"), "row", "col",
        format_cell(F.col("row"), F.col("col"), F.col("sheet")).alias("from_cell"), "raw", "external", "to_book",
        F.when(F.col("r0").isNotNull(), format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), F.col("t_sheet"))).alias("to_range"), "t_sheet", "t_sheet_lc", "r0", "c0", "r1", "c1", "open",
    )


def reverse(ws) -> tuple[DataFrame, DataFrame]:
    """Who reads a cell: single edges of small ranges, and large ranges as intervals; both with the reader and an order."""
    t = ws.targets.join(ws.sheets.select("book", "sheet_lc", "sheet_idx"), ["book", "sheet_lc"])
    order = F.struct("sheet_idx", "ord", "ref_ord", "t_ord").alias("place")
    dep = [F.col("sheet").alias("d_sheet"), F.col("sheet_lc").alias("d_sheet_lc"), F.col("row").alias("d_row"), F.col("col").alias("d_col"), F.col("book").alias("d_book"), order]
    t = t.select("book", *dep, F.col("t_sheet_lc").alias("sheet_lc"), "r0", "c0", "r1", "c1")
    small = range_area(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")) <= EXPAND
    single = t.where(small).withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return single.drop("r0", "c0", "r1", "c1"), t.where(~small)


def readers(ws, points: DataFrame, across: bool = False) -> DataFrame:
    """(the point's columns, d_book, d_sheet, d_sheet_lc, d_row, d_col, first) of each different reader of each point.

    ``points``: (book, sheet_lc, row, col, ...), each once. By ``first`` readers by single edges come before those by intervals, then, ``across``,
    those in other books; each in order of sheets, cells and references.
    """
    single, large = reverse(ws)
    found = points.join(single, AT).withColumn("tier", F.lit(0)).unionByName(containing(points, large).drop("r0", "c0", "r1", "c1").withColumn("tier", F.lit(1)))
    if across:
        far = links(ws).where("to_book is not null and r0 is not null")
        far = far.select(
            F.col("to_book").alias("book"), F.col("t_sheet_lc").alias("sheet_lc"), "r0", "c0", "r1", "c1", F.col("from_book").alias("d_book"), F.col("from_sheet").alias("d_sheet"), F.col("from_sheet_lc").alias("d_sheet_lc"),
            F.col("row").alias("d_row"), F.col("col").alias("d_col"), F.struct("sheet_idx", "ord", "ref_ord", F.lit(0).alias("t_ord")).alias("place"), (F.col("book_ord") + 2).alias("tier"),
        )
        found = found.unionByName(containing(points, far).drop("r0", "c0", "r1", "c1").select(*found.columns))
    return found.groupBy(*points.columns, "d_book", "d_sheet", "d_sheet_lc", "d_row", "d_col").agg(F.min(F.struct("tier", "place")).alias("first"))


def foremost(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each point's ``readers``, with their ``rank``; each task leaves only so many of a point before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*AT).orderBy("first"))).where(F.col("rank") <= most)


def dependents(ws, points: DataFrame, across: bool = False, most: int | None = None) -> DataFrame:
    """(book, sheet_lc, row, col, d_book, d_sheet, d_sheet_lc, d_row, d_col, rank, total) of the first ``most`` readers of each point, or of all.

    ``total`` counts all. All of a point's readers are ranked by ranges of their order, not in one task.
    """
    found = written(readers(ws, points.select(*AT), across), "readers")
    if most is not None:
        return foremost(found, most).drop("first").join(found.groupBy(*AT).agg(F.count("*").alias("total")), AT)
    every = written(numbered(found, [*AT, "first"], "place"), "ranked")
    per = every.groupBy(*AT).agg(F.min("place").alias("start"), F.count("*").alias("total"))
    return every.join(per, AT).withColumn("rank", F.col("place") - F.col("start") + 1).drop("first", "place", "start")


def _address(book: Column, local: Column, qualified: bool) -> Column:
    return F.concat(F.lit("["), book, F.lit("]"), local) if qualified else local


def _key() -> Column:
    return F.concat_ws("|", F.lower("book"), "sheet_lc", "row", "col")


def _nodes(df: DataFrame, **values) -> DataFrame:
    """``df`` as nodes of the flat tree; what isn't given is null."""
    out = []
    for part in NODE.split(", "):
        name, kind = part.split(" ", 1)
        c = values.get(name, F.col(name) if name in ("root", "pos") else F.lit(None))
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def _with_cells(ws, frontier: DataFrame) -> DataFrame:
    values = ws.cells.withColumn("value", value_json()).select(*AT, "value", "formula")
    return frontier.join(values, AT, "left").withColumn("value", F.coalesce("value", F.lit("null")))


def roots(ws, cells: DataFrame, qualified: bool = False) -> DataFrame:
    """Frontier of a trace from (book, sheet, sheet_lc, row, col)."""
    return cells.select(*AT, "sheet", _address(F.col("book"), format_cell(F.col("row"), F.col("col"), F.col("sheet")), qualified).alias("root"), F.array().cast("array<int>").alias("pos"), F.array(_key()).alias("path"))


def trace_dependents(ws, cells: DataFrame, depth: int = 2, across: bool = False, qualified: bool = False) -> DataFrame:
    """Flat nodes of who depends on each of ``cells`` (book, sheet, sheet_lc, row, col), up to ``depth`` steps away."""
    frontier, out = roots(ws, cells, qualified), []
    for left in range(depth, -1, -1):
        frontier = written(_with_cells(ws, frontier), "frontier")
        points = frontier.select(*AT).distinct()
        deps = written(dependents(ws, points, across, CHILDREN), "dependents")
        counts = deps.groupBy(*AT).agg(F.max("total").alias("total"))
        here = frontier.join(counts, AT, "left").withColumn("total", F.coalesce("total", F.lit(0)))
        more = F.col("total") > (CHILDREN if left else 0)
        note = F.when(more, F.concat((F.col("total") - (CHILDREN if left else 0)).cast("string"), F.lit(" more dependent(s) omitted" if left else " dependent(s) below depth limit")))
        address = _address(F.col("book"), format_cell(F.col("row"), F.col("col"), F.col("sheet")), qualified)
        out.append(_nodes(here, address=address, kind=F.lit("cell"), value=F.col("value"), formula=F.col("formula"), truncated=F.when(more, F.lit(True)), note=note))
        if not left:
            break
        step = frontier.join(deps, AT).select(
            "root", F.concat("pos", F.array((F.col("rank") - 1).cast("int"))).alias("pos"), "path", F.col("d_book").alias("book"), F.col("d_sheet").alias("sheet"), F.col("d_sheet_lc").alias("sheet_lc"), F.col("d_row").alias("row"), F.col("d_col").alias("col")
        )
        step = written(step.withColumn("cycle", F.array_contains("path", _key())), "step")
        out.append(_nodes(step.where("cycle"), address=address, kind=F.lit("cell"), cycle=F.lit(True)))
        frontier = step.where("not cycle").withColumn("path", F.concat("path", F.array(_key()))).drop("cycle")
        if frontier.isEmpty():
            break
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trace_precedents(ws, cells: DataFrame, depth: int = 2, across: bool = False, qualified: bool = False) -> DataFrame:
    """Flat nodes of what each of ``cells`` depends on.

    A range of several cells is one node with counts, its dominant formula pattern and one cell that stands for it. ``across``: references to
    other books of the workspace are followed.
    """
    frontier = roots(ws, cells, qualified).withColumns({"left": F.lit(depth), "note": F.lit(None).cast("string")})
    far = links(ws).select(F.col("from_book").alias("book"), F.col("from_sheet_lc").alias("sheet_lc"), "row", "col", "ref_ord", "to_book") if across else None
    names = _last_names(ws.names).where("r0 is not null")
    named = names.groupBy("book", F.col("name_lc").alias("k")).agg(F.array_sort(F.collect_list(F.struct("target_ord", "sheet", "r0", "c0", "r1", "c1", "open"))).alias("ranges"))
    extent = ws.sheets.select("book", F.col("sheet_lc").alias("t_sheet_lc"), F.col("sheet").alias("real"), "max_row", "max_col")
    show = lambda: _address(F.col("book"), format_cell(F.col("row"), F.col("col"), F.col("sheet")), qualified)
    out = []
    for _ in range(depth + 1):
        frontier = written(_with_cells(ws, frontier), "frontier")
        refs = ws.edges.select(*AT, "ref_ord", "kind", "raw", "name", "external", "t_sheet", "r0", "c0", "r1", "c1", "open")
        counts = refs.groupBy(*AT).agg(F.count("*").alias("n"))
        here = frontier.join(counts, AT, "left")
        cut = (F.col("n") > 0) & (F.col("left") <= 0)
        below = F.concat(F.col("n").cast("string"), F.lit(" reference(s) below depth limit"))
        out.append(_nodes(here, address=show(), kind=F.lit("cell"), value=F.col("value"), formula=F.col("formula"), truncated=F.when(cut, F.lit(True)), note=F.coalesce("note", F.when(cut, below))))
        step = frontier.where("left > 0").select(*AT, "root", "pos", "path", "left").join(refs, AT)
        if far is not None:
            step = step.join(far, [*AT, "ref_ord"], "left")
        else:
            step = step.withColumn("to_book", F.lit(None).cast("string"))
        step = step.withColumn("pos", F.concat("pos", F.array("ref_ord"))).withColumn("left", F.col("left") - 1).withColumn("k", F.lower("name"))
        step = written(step.join(named, ["book", "k"], "left"), "step")
        away, followed = F.col("external").isNotNull(), F.col("to_book").isNotNull() & F.col("r0").isNotNull()
        stub = step.where(away & ~followed)
        out.append(_nodes(stub, address=F.col("raw"), kind=F.lit("external"), note=F.concat(F.lit('external workbook "'), "external", F.lit('" — not loaded'))))
        own = step.where(~away)
        out.append(_nodes(own.where("kind = 'structured'"), address=F.col("raw"), kind=F.lit("name"), note=F.lit("structured reference (not resolved)")))
        by_name = own.where("kind = 'name'")
        texts = F.transform("ranges", lambda r: _address(F.col("book"), format_range(r["r0"], r["c0"], r["r1"], r["c1"], r["sheet"]), qualified))
        told = F.when(F.size("ranges") > 0, F.concat(F.lit("defined name → "), F.array_join(texts, ", "))).otherwise("undefined name")
        out.append(_nodes(by_name, address=F.col("name"), kind=F.lit("name"), note=told))
        fields = ["root", "pos", "path", "left", "book", "t_sheet", "r0", "c0", "r1", "c1", "open"]
        ranges = step.where(F.col("r0").isNotNull() & (~away | followed)).withColumn("book", F.coalesce("to_book", "book")).select(*fields)
        inner = by_name.select("root", "pos", "path", "left", "book", F.posexplode("ranges").alias("i", "r"))
        inner = inner.select("root", F.concat("pos", F.array("i")).alias("pos"), "path", "left", "book", F.col("r.sheet").alias("t_sheet"), "r.r0", "r.c0", "r.r1", "r.c1", "r.open")
        ranges = ranges.unionByName(inner).withColumn("t_sheet_lc", F.lower("t_sheet")).join(extent, ["book", "t_sheet_lc"], "left")
        clip = lambda end, most, start: F.when(F.col("open").isNotNull() & F.col(most).isNotNull(), F.least(end, F.greatest(most, start))).otherwise(F.col(end))
        ranges = ranges.withColumns({"r1": clip("r1", "max_row", "r0"), "c1": clip("c1", "max_col", "c0"), "sheet": F.coalesce("real", "t_sheet"), "sheet_lc": F.col("t_sheet_lc")})
        ranges = written(ranges.withColumn("area", range_area(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))), "ranges")
        one = ranges.where("area = 1").withColumns({"row": F.col("r0"), "col": F.col("c0")}).withColumn("cycle", F.array_contains("path", _key()))
        out.append(_nodes(one.where("cycle"), address=show(), kind=F.lit("cell"), cycle=F.lit(True)))
        follow = [one.where("not cycle").withColumn("note", F.lit(None).cast("string"))]
        many = _range_nodes(ws, ranges.where("area > 1")).withColumns({"row": F.col("rep.row"), "col": F.col("rep.col")})
        many = written(many, "range-nodes")
        seen = F.array_contains("path", _key())
        where = _address(F.col("book"), format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), F.col("t_sheet")), qualified)
        out.append(_nodes(many, address=where, kind=F.lit("range"), cell_count=F.col("area"), truncated=F.when(F.col("rep").isNotNull() & (F.col("left") <= 0), F.lit(True)), note=F.col("about")))
        reps = many.where(F.col("rep").isNotNull() & (F.col("left") > 0) & ~seen)
        stands = F.concat(F.lit("representative of "), F.col("rep.n").cast("string"), F.lit(" cell(s) with this pattern"))
        reps = reps.withColumns({"pos": F.concat("pos", F.array(F.lit(0))), "left": F.col("left") - 1, "note": stands})
        follow.append(reps)
        frontier = _union([f.select(*AT, "sheet", "root", "pos", F.concat("path", F.array(_key())).alias("path"), "left", "note") for f in follow])
        frontier = written(frontier, "next")
        if frontier.isEmpty():
            break
    return _union(out)


def _range_nodes(ws, ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``about``, the node's note, and ``rep``: (n, row, col) of the first cell with the dominant pattern.

    Each different range is profiled once, over its first places row by row.
    """
    key = ["book", "sheet_lc", "r0", "c0", "r1", "c1"]
    width = F.col("c1") - F.col("c0") + 1
    distinct = ranges.select(*key).distinct()
    first = distinct.withColumns({"last": F.col("r1"), "r1": F.least("r1", F.col("r0") + F.ceil(F.lit(SCAN) / width).cast("int") - 1)})
    # the range's own columns under other names, as the join needs r0 to c1
    first = first.withColumns({"a0": F.col("r0"), "b0": F.col("c0"), "b1": F.col("c1")})
    place = (F.col("row") - F.col("a0")).cast("long") * (F.col("b1") - F.col("b0") + 1) + F.col("col") - F.col("b0")
    inside = containing(ws.cells.select(*AT, "sheet", "formula"), first).withColumn("place", place).where(F.col("place") < SCAN)
    own = ["book", "sheet_lc", "a0", "b0", "last", "b1"]
    counts = inside.groupBy(*own).agg(F.count("*").alias("n"), F.count("formula").alias("n_formula"))
    by_place = Window.partitionBy(*own).orderBy("place")
    some = inside.where("formula is not null").withColumn("k", F.row_number().over(by_place)).where(F.col("k") <= FORMULAS)
    forms = some.join(F.broadcast(ws.row_limits), "book").withColumn("form", relative_udf("formula", "sheet", "row", "col", "max_rows")).groupBy(*own, "form").agg(F.count("*").alias("n"), F.min(F.struct("place", "row", "col", "formula")).alias("first"))
    top = forms.groupBy(*own).agg(F.max(F.struct("n", (-F.col("first.place")).alias("at"), F.col("first.row").alias("row"), F.col("first.col").alias("col"), F.col("first.formula").alias("formula"))).alias("rep"))
    told = counts.join(top, own, "left").select("book", "sheet_lc", *(F.col(a).alias(b) for a, b in zip(own[2:], ("r0", "c0", "r1", "c1"))), "n", "n_formula", "rep")
    out = ranges.join(told, key, "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    pattern = F.concat(n, F.lit(" cells, "), F.col("n_formula").cast("string"), F.lit(" formula(s); dominant pattern ="), "rep.formula", F.lit(" ("), F.col("rep.n").cast("string"), F.lit("×)"))
    about = F.when(F.col("real").isNull(), F.concat(F.lit('sheet "'), "t_sheet", F.lit('" not found'))).when(F.col("rep").isNull(), F.concat(n, F.lit(" value cell(s)"))).otherwise(pattern)
    return out.withColumn("about", about).drop("n", "n_formula")


def nested(nodes: list, root: str | None = None) -> dict | None:
    """One root's flat nodes as a tree of dicts with ``children``."""
    import json

    mine = sorted((n for n in nodes if root is None or n["root"] == root), key=lambda n: n["pos"])
    by: dict[tuple, dict] = {}
    for n in mine:
        made = {"address": n["address"], "kind": n["kind"]}
        if n["kind"] == "cell" and not n["cycle"]:
            made["value"] = json.loads(n["value"]) if n["value"] is not None else None
        if n["formula"] is not None:
            made["formula"] = n["formula"]
        if n["cell_count"] is not None:
            made["cellCount"] = n["cell_count"]
        made["children"] = []
        for k in ("cycle", "truncated", "note"):
            if n[k]:
                made[k] = n[k]
        by[tuple(n["pos"])] = made
        if n["pos"]:
            by[tuple(n["pos"][:-1])]["children"].append(made)
    return by.get(())
