"""Regions: tables and blocks of a sheet with headers, sections, subtotals, column profiles, kind, purpose and confidence.

Boxes come from ``components``; everything else is aggregation: cells to rows of a box, rows to the box, cells to
columns. What depends on order carries the row or column that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import col_letter, format_cell, format_range
from ..functions.formula import relative_udf
from ..functions.text import date_text, half_up, hash36, number_text
from ..plans.tables import spread, tasks_for, written
from ..sources.schema import value_text
from . import components
from .rangejoin import containing

BOX = ["book", "sheet_lc", "box"]
_SUM = r"(?i)^(SUM|SUBTOTAL)\("
_TOTAL_START = r"(?i)^\s*(grand\s+)?(sub)?total"
_TOTAL_END = r"(?i)(^|\s|—|–|-)(grand\s*)?(sub)?totals?\s*$"
_TOTAL_TAIL = r"(?i)\s*[—–-]*\s*(grand\s*)?(sub)?\s*totals?\s*$"

#: Different values of a column that are told apart; a column that has as many may have any number more, so it is no category.
MOST_DISTINCT = 10_000

# Purposes by the first pattern that a sheet's, title's and headers' text holds.
PURPOSES = [
    ("executive|kpi|key figures", "summary / KPIs"),
    ("payment|receipt|collect|remittance", "payments / cash receipts"),
    ("invoice", "invoice register"),
    ("credit|adjustment", "credits & adjustments"),
    ("aging|ageing|overdue", "receivables aging"),
    ("deferred|recognition", "deferred revenue"),
    ("contract", "customer contracts"),
    ("assumption|policy|basis", "assumptions & policies"),
    ("payroll|salar|wage|headcount|compensation", "payroll"),
    ("vendor|supplier", "vendor spend"),
    ("capex|capital", "capital expenditure"),
    ("alloc", "cost allocations"),
    ("forecast|projection", "forecast"),
    (r"cost\s*cent", "cost-center spend"),
    ("department|dept", "department spend"),
    ("map|rate", "reference mapping"),
]


def in_boxes(seen: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with their box's columns; a cell belongs to the box whose region holds it."""
    ranges = boxes.withColumns({"r0": F.col("top"), "r1": F.col("bottom"), "c0": F.col("left"), "c1": F.col("right")}).drop("sheet", "hidden")
    return containing(seen, ranges).drop("r0", "r1", "c0", "c1")


def _rows(inside: DataFrame, sums: DataFrame, tasks: int) -> DataFrame:
    """A row per row of a box's connected cells: what is present, the first text, and SUMs of a cell's own column."""
    said = F.lower(F.trim("str"))
    near_top = F.col("row") <= F.col("top") + 1
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("col")))
    rows = spread(inside.where("row <= comp_bottom"), tasks, *BOX, "row").groupBy(*BOX, "row")
    rows = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("type") == "string").alias("n_str"),
        F.size(F.collect_set(F.when(near_top & (F.col("type") == "string"), said))).alias("n_words"),
        F.count_if(F.coalesce("bold", F.lit(False))).alias("n_bold"),
        first("str", F.col("str").isNotNull()).alias("label"),
        first("str", F.trim("str") != "").alias("named"),
    )
    return rows.join(sums, [*BOX, "row"], "left")


def _sum_rows(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """(box, row, sums array of (r0, r1)): ranges in a cell's own column that SUM or SUBTOTAL formulas of the row take."""
    refs = edges.where(F.col("formula").rlike(_SUM) & (F.col("c0") == F.col("col")) & (F.col("c1") == F.col("col")))
    refs = refs.select("book", "sheet_lc", "row", "col", F.struct("r0", "r1").alias("s"))
    cells = inside.where(F.col("direct") & F.col("formula").rlike(_SUM)).select(*BOX, "row", "col")
    return cells.join(refs, ["book", "sheet_lc", "row", "col"]).groupBy(*BOX, "row").agg(F.collect_list("s").alias("sums"))


def _is_header(h: str, below: str, at: Column) -> Column:
    """Texts over most columns, all different, above a row of other types, or bold above a row that isn't."""
    g = lambda s, f: F.col(f"{s}.{f}")
    width = F.col("right") - F.col("left") + 1
    bold = (g(h, "n_bold") == g(h, "n")) & (g(below, "n_bold") < g(below, "n"))
    ok = (
        (width >= 2) & (at < F.col("comp_bottom")) & (g(h, "n") / width >= 0.6) & (g(h, "n_str") / g(h, "n") >= 0.8) & (g(h, "n_words") == g(h, "n_str"))
        & (((g(below, "n") - g(below, "n_str")) / g(below, "n") >= 0.4) | bold)
    )
    return F.coalesce(ok, F.lit(False))


def _headed(boxes: DataFrame, rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Boxes with header_row, group_row (of a two-row header) and the facts of their last row."""
    width2 = [F.min(F.when(F.col("row") > F.col("top") + k, F.col("row"))).alias(f"next{k}") for k in (0, 1)]
    keyed = rows.join(boxes.select(*BOX, "top", "comp_bottom"), BOX)
    following = keyed.groupBy(*BOX).agg(*width2)
    keyed = keyed.join(following, BOX).where("row in (top, top + 1, next0, next1, comp_bottom)")
    facts = F.struct("n", "n_str", "n_words", "n_bold", "label", "sums")
    pick = lambda at, name: F.max_by(facts, F.when(F.col("row") == at, F.lit(1))).alias(name)
    picked = keyed.groupBy(*BOX).agg(pick(F.col("top"), "f0"), pick(F.col("top") + 1, "f1"), pick(F.col("next0"), "g0"), pick(F.col("next1"), "g1"), pick(F.col("comp_bottom"), "last"))
    flat = merges.where("r0 = r1 and c1 > c0").select("book", "sheet_lc", F.col("r0").alias("top"), F.col("c0").alias("m0"), F.col("c1").alias("m1"))
    wide = boxes.join(flat, ["book", "sheet_lc", "top"]).where("m0 >= left and m1 <= right").select(*BOX, F.lit(True).alias("merged_top")).distinct()
    out = boxes.join(picked, BOX).join(wide, BOX, "left")
    one = _is_header("f0", "g0", F.col("top"))
    two = ~one & (F.col("comp_bottom") - F.col("top") >= 2) & F.coalesce("merged_top", F.lit(False)) & (F.col("f0.n") == F.col("f0.n_str")) & _is_header("f1", "g1", F.col("top") + 1)
    out = out.withColumn("header_row", F.when(one, F.col("top")).when(two, F.col("top") + 1)).withColumn("group_row", F.when(two, F.col("top")))
    out = out.withColumn("data_start", F.coalesce(F.col("header_row") + 1, "top")).withColumn("data_end", F.col("comp_bottom"))
    span = F.greatest(F.lit(2.0), (F.col("data_end") - F.col("data_start")) / 2.0)
    sums_all = F.exists(F.coalesce("last.sums", F.array().cast("array<struct<r0:int,r1:int>>")), lambda s: s["r1"] - s["r0"] + 1 >= span)
    own = F.col("totals_top").isNull() & (F.col("comp_bottom") - F.col("top") >= 2) & (F.col("data_end") > F.col("data_start"))
    own = own & (F.coalesce(F.col("last.label").rlike(_TOTAL_START), F.lit(False)) | sums_all)
    out = out.withColumn("totals_row", F.when(own, F.col("data_end")).otherwise(F.col("totals_top"))).withColumn("data_end", F.col("data_end") - own.cast("int"))
    return out.drop("f0", "f1", "g0", "g1", "last", "merged_top")


def _subtotals(headed: DataFrame, rows: DataFrame) -> DataFrame:
    """(box, row, grand, label) of subtotal rows among the data: a label that ends in total, or a SUM that ends just above."""
    spans = headed.where("data_end - data_start >= 2").select(*BOX, "data_start", "data_end")
    inside = rows.join(spans, BOX).where("row between data_start and data_end")
    by_label = F.coalesce(F.trim("named").rlike(_TOTAL_END), F.lit(False))
    none = F.array().cast("array<struct<r0:int,r1:int>>")
    by_sum = F.exists(F.coalesce("sums", none), lambda s: (s["r1"] == F.col("row") - 1) & (s["r0"] >= F.col("data_start")) & (s["r1"] > s["r0"]))
    cleaned = F.trim(F.regexp_replace("named", _TOTAL_TAIL, ""))
    label = F.when(cleaned != "", cleaned).otherwise(F.trim("named"))
    return inside.where(by_label | by_sum).select(*BOX, "row", F.coalesce(F.col("named").rlike("(?i)grand"), F.lit(False)).alias("grand"), label.alias("label"))


def _sections(headed: DataFrame, subtotals: DataFrame) -> DataFrame:
    """(box, sections, subtotal_rows): each subtotal row closes the group above it; what follows the last is a group without label."""
    spans = headed.select(*BOX, "data_start", "data_end")
    by_row = Window.partitionBy(*BOX).orderBy("row")
    rows = subtotals.join(spans, BOX).withColumn("begin", F.coalesce(F.lag("row").over(by_row) + 1, "data_start"))
    kind = F.when(F.col("grand"), "grandTotal").when(F.col("row") > F.col("begin"), "group").otherwise("subtotal")
    group = kind == "group"
    made = F.struct(
        kind.alias("kind"), F.col("label").alias("label"), F.when(group, F.col("begin")).otherwise(F.col("row")).alias("start_row"),
        F.when(group, F.col("row") - 1).otherwise(F.col("row")).alias("end_row"), F.col("row").alias("subtotal_row"),
    )
    per = rows.select(*BOX, "row", "data_end", made.alias("s")).groupBy(*BOX).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "s"))), lambda x: x["s"]).alias("sections"), F.array_sort(F.collect_list("row")).alias("subtotal_rows"), F.max("row").alias("last"), F.first("data_end").alias("data_end")
    )
    rest = F.struct(F.lit("group").alias("kind"), F.lit(None).cast("string").alias("label"), (F.col("last") + 1).alias("start_row"), F.col("data_end").alias("end_row"), F.lit(None).cast("int").alias("subtotal_row"))
    return per.select(*BOX, F.when(F.col("last") < F.col("data_end"), F.concat("sections", F.array(rest))).otherwise(F.col("sections")).alias("sections"), "subtotal_rows")


def _headers(headed: DataFrame, inside: DataFrame) -> DataFrame:
    """(box, headers): the header row's texts, or letters; below a group row, ``Group · Text``."""
    spans = headed.where("header_row is not null").select(*BOX, "header_row", "group_row")
    texts = inside.select(*BOX, "row", "col", F.trim(F.coalesce(value_text(), F.lit(""))).alias("t")).join(spans, BOX)
    at = lambda ok: F.map_from_entries(F.collect_list(F.when(ok, F.struct("col", "t"))))
    maps = texts.where("row in (header_row, coalesce(group_row, header_row))").groupBy(*BOX).agg(at(F.col("row") == F.col("header_row")).alias("sub"), at(F.col("row") == F.col("group_row")).alias("grp"))

    def name(c: Column) -> Column:
        sub = F.coalesce(F.try_element_at("sub", c), F.lit(""))
        text = F.when(sub != "", sub).otherwise(col_letter(c))
        group = F.coalesce(F.try_element_at("grp", c), F.lit(""))
        return F.when((group != "") & (F.lower(group) != F.lower(sub)), F.concat(group, F.lit(" · "), text)).otherwise(text)

    return headed.select(*BOX, "left", "right").join(maps, BOX).select(*BOX, F.transform(F.sequence("left", "right"), name).alias("headers"))


def profiles(headed: DataFrame, inside: DataFrame, subtotals: DataFrame, limits: DataFrame, tasks: int) -> DataFrame:
    """A row per column of a box: types, distinct values, samples, statistics, formula pattern. Stored data cells only."""
    spans = headed.select(*BOX, "data_start", "data_end")
    data = inside.where("direct").join(spans, BOX).where("row between data_start and data_end").join(subtotals.select(*BOX, "row"), [*BOX, "row"], "left_anti")
    data = data.withColumn("shown", F.coalesce(value_text(), F.lit("null"))).withColumn("slice", F.shiftright("row", components.TILE))
    data = spread(data, tasks, "book", "sheet_lc", "slice")
    key = [*BOX, "col"]
    number = F.when(F.col("type") == "number", F.col("num"))
    day = F.when(F.col("type") == "date", F.col("ts"))
    kinds = ("number", "string", "boolean", "date", "error", "empty")
    tally = lambda k: F.struct(F.count_if(F.col("type") == k).alias("n"), (-F.min(F.when(F.col("type") == k, F.col("row")))).alias("first"), F.lit(k).alias("type"))
    stats = data.groupBy(*key).agg(
        F.count("*").alias("non_empty"),
        F.array_max(F.array(*map(tally, kinds))).alias("most"),
        F.count_if(F.col("str").rlike(r"^\s*\d{4}-\d{2}\s*$") & (F.col("type") == "string")).alias("monthish"),
        F.sum(number).alias("s"),
        F.count(number).alias("n_num"),
        F.min(F.when(number.isNotNull(), F.struct(number.alias("v"), F.col("row").alias("row")))).alias("lo"),
        F.max(F.when(number.isNotNull(), F.struct(number.alias("v"), (-F.col("row")).alias("row")))).alias("hi"),
        F.min(day).alias("d0"),
        F.max(day).alias("d1"),
        F.count("formula").alias("n_formula"),
    )
    values = data.groupBy(*key, "shown", "slice").agg(F.min("row").alias("first"))  # a slice stays where it is
    values = spread(values, tasks, *key, "shown").groupBy(*key, "shown").agg(F.min("first").alias("first"))
    by_first = Window.partitionBy(*key).orderBy("first")
    few = values.withColumn("k", F.row_number().over(by_first)).where("k <= 3").groupBy(*key)
    few = few.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "shown"))), lambda x: x["shown"]).alias("samples"))
    different = values.groupBy(*key).agg(F.least(F.count("*"), F.lit(MOST_DISTINCT)).alias("distinct"))
    forms = data.where("formula is not null").join(F.broadcast(limits), "book").withColumn("form", relative_udf("formula", "sheet", "row", "col", "max_rows")).groupBy(*key, "form")
    forms = forms.agg(F.count("*").alias("n"), F.min(F.struct("row", "formula")).alias("first")).groupBy(*key)
    forms = forms.agg(F.max(F.struct("n", (-F.col("first.row")).alias("at"), "form", F.col("first.formula").alias("example"))).alias("top"))
    every = headed.select(*BOX, "sheet", "left", "header_row", F.explode(F.sequence("left", "right")).alias("col"))
    out = every.join(stats, key, "left").join(few, key, "left").join(different, key, "left").join(forms, key, "left")
    at = lambda side, sign: format_cell(F.col(f"{side}.row") * sign, F.col("col"), F.col("sheet"))
    total = half_up(F.col("s"), 4)
    patterned = (F.col("n_formula") >= 2) & (F.col("top.n") / F.col("n_formula") >= 0.6)
    none = F.coalesce("non_empty", F.lit(0))
    return out.select(
        *key,
        col_letter(F.col("col")).alias("letter"),
        F.when(none == 0, "empty").when(F.col("most.n") / none < 0.7, "mixed").otherwise(F.col("most.type")).alias("type"),
        none.cast("long").alias("non_empty"),
        F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
        F.when(
            F.col("n_num") > 0,
            F.struct(total.alias("sum"), F.col("lo.v").alias("min"), F.col("hi.v").alias("max"), (total / F.col("n_num")).alias("mean"), at("hi", -1).alias("max_at"), at("lo", 1).alias("min_at")),
        ).alias("stats"),
        F.when(patterned, F.col("top.form")).alias("formula_template"),
        F.when(patterned, F.concat(F.lit("="), F.col("top.example"))).alias("formula_example"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        F.when(F.col("d0").isNotNull(), F.struct(date_text(F.col("d0")).alias("min"), date_text(F.col("d1")).alias("max"))).alias("date_range"),
        F.coalesce("monthish", F.lit(0)).alias("monthish"),
    )


def _role(header: Column) -> Column:
    n = F.col("non_empty")
    named_id = header.rlike(r"(?i)(^|\s)(id|code|ref)\b|\bid$") & (F.col("distinct") == n)
    texts = F.col("type").isin("string", "mixed")
    return (
        F.when(n == 0, F.lit(None)).when(F.col("is_key"), "key").when(F.col("formula_template").isNotNull(), "computed").when(F.col("type") == "date", "date")
        .when(F.col("monthish") / n >= 0.6, "month").when(F.col("type") == "number", "measure").when(texts & F.coalesce(named_id, F.lit(False)), "id")
        .when(texts & (F.col("distinct") < MOST_DISTINCT) & (F.col("distinct") <= F.greatest(F.lit(12), F.ceil(n / 3))), "category").when(texts, "text")
    )


def _counts(headed: DataFrame, inside: DataFrame) -> DataFrame:
    """What decides on a box's kind."""
    spans = headed.select(*BOX, "data_start", "data_end")
    cells = inside.join(spans, BOX)
    data = F.col("row").between(F.col("data_start"), F.col("data_end"))
    plain = F.col("direct") & (F.col("type") == "string") & F.col("formula").isNull()
    first, inner = data & (F.col("col") == F.col("left")), data & (F.col("col") > F.col("left")) & F.col("direct")
    return cells.groupBy(*BOX).agg(
        F.count_if("direct").alias("cell_count"),
        F.count_if(F.col("direct") & F.col("formula").isNotNull()).alias("formula_cell_count"),
        F.count_if(plain).alias("n_plain"),
        F.count_if(plain & F.coalesce("italic", F.lit(False))).alias("n_italic"),
        F.sum(F.when(plain, F.length("str"))).alias("chars"),
        F.count_if(first).alias("n_first"),
        F.count_if(first & (F.col("type") == "string")).alias("n_first_str"),
        F.count_if(inner).alias("n_inner"),
        F.count_if(inner & (F.col("type") == "number")).alias("n_inner_num"),
    )


def detect(cells: DataFrame, sheets: DataFrame, merges: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """A row per region of every sheet of every book, columns, sections and notes nested."""
    tasks = tasks_for(cells.count())
    seen = components.seen_cells(cells, merges)
    found = components.boxes(components.rectangles(seen, tasks)).join(sheets.select("book", "sheet_lc", "sheet", "hidden"), ["book", "sheet_lc"])
    found = written(found, "boxes")
    inside = written(in_boxes(seen, found.select(*BOX, "top", "bottom", "left", "right", "comp_bottom")).drop("ord"), "inside")
    rows = written(_rows(inside, _sum_rows(inside, edges), tasks), "box-rows")
    headed = written(_headed(found, rows, merges), "headed")
    subtotals = written(_subtotals(headed, rows), "subtotals")
    described = (
        headed.join(_headers(headed, inside), BOX, "left").join(_sections(headed, subtotals), BOX, "left").join(_counts(headed, inside), BOX, "left")
        .withColumn("data_rows", F.greatest(F.lit(0), F.col("data_end") - F.col("data_start") + 1 - F.coalesce(F.size("subtotal_rows"), F.lit(0))))
    )
    width = F.col("right") - F.col("left") + 1
    columns = profiles(headed, inside, subtotals, limits, tasks).join(described.select(*BOX, "left", "headers", "data_rows"), BOX)
    header = F.try_element_at("headers", F.col("col") - F.col("left") + 1)
    can_key = (F.col("data_rows") >= 2) & (F.col("non_empty") == F.col("data_rows")) & (F.col("distinct") == F.col("non_empty")) & ~F.col("type").isin("empty", "number")
    leftmost = F.min(F.when(can_key, F.col("col"))).over(Window.partitionBy(*BOX))
    columns = columns.withColumn("is_key", F.coalesce(F.col("col") == leftmost, F.lit(False))).withColumn("header", header)
    columns = columns.withColumn("role", _role(F.col("header")))
    profile = F.struct("col", "letter", "header", "type", "non_empty", "distinct", "stats", "formula_template", "formula_example", "is_key", "samples", "date_range", "role")
    nested = columns.groupBy(*BOX).agg(F.array_sort(F.collect_list(profile), lambda a, b: a["col"] - b["col"]).alias("columns"))
    title = _titles(found, cells)
    all_plain = (F.col("cell_count") > 0) & (F.col("n_plain") == F.col("cell_count"))
    headless, height = F.col("header_row").isNull(), F.col("bottom") - F.col("top") + 1
    noted = headless & all_plain & (width <= 2) & (height <= 4) & ((F.col("chars") / F.col("cell_count") >= 35) | (F.col("n_italic") == F.col("cell_count")))
    c = lambda k, f: F.try_element_at("columns", F.lit(k))[f]
    paired = (width == 2) & (c(1, "type") == "string") & (c(2, "non_empty") > 0) & (c(2, "type") != "string")
    crossed = (F.col("n_first_str") / F.col("n_first") >= 0.8) & (F.col("n_inner_num") / F.col("n_inner") >= 0.6)
    tall = F.col("comp_bottom") - F.col("top") >= 1
    kind = F.when(noted, "notes").when(width == 1, "list").when(~headless, "table").when(paired, "keyValue").when((width >= 2) & tall & F.coalesce(crossed, F.lit(False)), "matrix").otherwise("block")
    out = described.join(nested, BOX).join(title, BOX, "left").withColumn("kind", kind)
    density = F.col("cell_count") / (height * width)
    full = F.filter("columns", lambda x: x["non_empty"] > 0)
    steady = F.aggregate(full, F.lit(0.0), lambda a, x: a + F.when(x["type"] == "mixed", 0.4).otherwise(1.0)) / F.size(full)
    point = lambda ok, p: F.when(ok, F.lit(p)).otherwise(0.0)
    score = (
        F.lit(0.3) + point(~headless, 0.2) + point(density >= 0.5, 0.1) + point(F.col("data_rows") >= 3, 0.1) + 0.2 * F.coalesce(steady, F.lit(0.0))
        + point(F.col("title") != "", 0.05) + point(F.col("kind") != "block", 0.05) + point(F.size("sections") > 0, 0.05) - point(F.col("cell_count") == 1, 0.35)
    )
    months = F.size(F.filter("headers", lambda h: h.rlike(r"^\d{4}-\d{2}$")))
    named = F.when(F.col("kind").isin("keyValue", "notes", "list"), F.array_join(c(1, "samples"), " ")).otherwise("")
    hay = F.lower(F.concat_ws(" ", "sheet", F.coalesce("title", F.lit("")), F.coalesce(F.array_join("headers", " "), F.lit("")), F.coalesce(named, F.lit(""))))
    purpose = F.coalesce(*(F.when(hay.rlike(p), F.lit(label)) for p, label in PURPOSES))
    purpose = F.when(F.col("kind") == "notes", "notes").when(months >= 3, F.concat(purpose, F.lit(" (by month)"))).otherwise(purpose)
    r1 = format_range(F.col("top"), F.col("left"), F.col("bottom"), F.col("right"), F.col("sheet"))
    out = out.withColumn("range_a1", r1).withColumn("purpose", purpose)
    out = out.select(
        "book",
        F.concat(F.lit("rg_"), hash36(F.concat(F.lower("sheet"), F.lit("|"), F.col("range_a1")))).alias("region_id"),
        "sheet", "sheet_lc", "box",
        F.col("top").alias("r0"), F.col("left").alias("c0"), F.col("bottom").alias("r1"), F.col("right").alias("c1"),
        "range_a1", "kind", F.when(F.col("title") != "", F.col("title")).alias("title"),
        F.when(F.col("t_top").isNotNull(), format_range(F.col("t_top"), F.col("t_left"), F.col("t_bottom"), F.col("t_right"), F.col("sheet"))).alias("title_range"),
        "header_row", F.when(F.col("group_row").isNotNull(), F.array("group_row", "header_row")).when(F.col("header_row").isNotNull(), F.array("header_row")).alias("header_rows"),
        "headers", "columns", height.alias("row_count"), width.alias("col_count"), "data_rows",
        F.col("data_start").alias("data_start_row"), F.col("data_end").alias("data_end_row"), "totals_row",
        F.col("hidden").alias("hidden_sheet"), half_up(density, 2).alias("density"), "cell_count", "formula_cell_count",
        half_up(F.greatest(F.lit(0.05), F.least(F.lit(0.99), score)), 2).alias("confidence"),
        "subtotal_rows", "sections", "purpose",
    )
    out = written(out, "regions")
    return out.join(_notes(out, cells), BOX, "left")


def _titles(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(box, title): the title cells' texts from left to right."""
    ranges = found.where("t_top is not null").select(*BOX, F.col("t_top").alias("r0"), F.col("t_left").alias("c0"), F.col("t_bottom").alias("r1"), F.col("t_right").alias("c1"))
    own = containing(cells, ranges).where(F.trim("str") != "").groupBy(*BOX)
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("str").alias("t")))), lambda x: x["t"]), " ").alias("title"))


def note_lines(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """(box, lines) of notes regions: their texts in order of reading."""
    notes = regions.where("kind = 'notes'").select(*BOX, "r0", "c0", "r1", "c1")
    texts = containing(cells.where("str is not null"), notes).groupBy(*BOX)
    return texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "str"))), lambda x: x["str"]).alias("lines"))


def _notes(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """(box, notes): lines of notes regions, given to the nearest region that ends at most four rows above in a shared column."""
    notes = regions.where("kind = 'notes'").select("book", "sheet_lc", F.col("box").alias("note"), F.col("r0").alias("n_r0"), F.col("c0").alias("n_c0"), F.col("c1").alias("n_c1"))
    near = notes.withColumn("ends", F.explode(F.sequence(F.col("n_r0") - 4, F.col("n_r0") - 1)))
    hosts = regions.where("kind <> 'notes'").select("book", "sheet_lc", "box", F.col("r1").alias("ends"), "c0", "c1")
    pairs = near.join(hosts, ["book", "sheet_lc", "ends"]).where("c0 <= n_c1 and n_c0 <= c1")
    last = Window.partitionBy("book", "sheet_lc", "note").orderBy(F.desc("ends"), "box")
    chosen = pairs.withColumn("k", F.row_number().over(last)).where("k = 1").select("book", "sheet_lc", "note", "box")
    lines = note_lines(regions, cells).withColumnRenamed("box", "note")
    per = chosen.join(lines, ["book", "sheet_lc", "note"]).groupBy(*BOX)
    return per.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("note", "lines"))), lambda x: x["lines"])).alias("notes"))


def region_columns(regions: DataFrame) -> DataFrame:
    """A row per column of a region."""
    return regions.select("book", "region_id", "sheet", F.explode("columns").alias("c")).select("book", "region_id", "sheet", "c.*")
