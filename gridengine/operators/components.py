"""Boxes of connected cells, their titles and totals rows.

Cells become runs within a row, equal runs in successive rows become rectangles (both by windows, cut into tiles so
that a dense table of any length is dealt over many tasks), and only rectangles, of which a table has few, are
joined to components sheet by sheet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import spread

#: Where a host's satellites may stand: of what sort, rows off which edge. A totals row has a blank row above it, a title one or two below.
PLACES = (("totals", "r1", 2), ("title", "r0", -2), ("title", "r0", -3))
#: Rows of a tile of rectangles, as bits.
TILE = 16
_BOX = "book string, sheet_lc string, box int, top int, left int, comp_bottom int, bottom int, right int, totals_top int, t_top int, t_left int, t_bottom int, t_right int"


def seen_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells, and what a merge shows at its other places: its master's value. ``direct``: stored there."""
    area = merges.select(
        "book", "sheet_lc", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("__r"), F.sequence("c0", "c1").alias("__cs")
    ).select("book", "sheet_lc", "r0", "c0", "__r", F.explode("__cs").alias("__c"))
    area = area.where("__r <> r0 or __c <> c0").dropDuplicates(["book", "sheet_lc", "__r", "__c"])
    master = cells.select(*cells.columns).withColumnsRenamed({"row": "r0", "col": "c0"})
    shadows = area.join(master, ["book", "sheet_lc", "r0", "c0"]).select(*(F.col({"row": "__r", "col": "__c"}.get(c, c)).alias(c) for c in cells.columns))
    shadows = shadows.join(cells.select("book", "sheet_lc", "row", "col"), ["book", "sheet_lc", "row", "col"], "left_anti")
    return cells.withColumn("direct", F.lit(True)).unionByName(shadows.select(*cells.columns).withColumn("direct", F.lit(False)))


def rectangles(seen: DataFrame, tasks: int = 1) -> DataFrame:
    """(book, sheet_lc, r0, r1, c0, c1, n, n_formula, n_plain, label): filled rectangles; what the last four say holds for one row.

    n: stored cells; n_plain: those that are texts without formula; label: the first text. ``tasks``: for as many cells as there are.
    """
    in_row = Window.partitionBy("book", "sheet_lc", "row").orderBy("col")
    text = F.when(F.col("direct"), F.col("str"))
    runs = (
        spread(seen, tasks, "book", "sheet_lc", "row")
        .withColumn("run", F.col("col") - F.row_number().over(in_row))
        .groupBy("book", "sheet_lc", "row", "run")
        .agg(
            F.min("col").alias("c0"),
            F.max("col").alias("c1"),
            F.count_if("direct").alias("n"),
            F.count_if(F.col("direct") & F.col("formula").isNotNull()).alias("n_formula"),
            F.count_if(F.col("direct") & (F.col("type") == "string") & F.col("formula").isNull()).alias("n_plain"),
            F.min_by(text, F.when(text.isNotNull(), F.col("col"))).alias("label"),
        )
    )
    down = Window.partitionBy("book", "sheet_lc", "c0", "c1", "tile").orderBy("row")
    return (
        spread(runs.withColumn("tile", F.shiftright("row", TILE)), tasks, "book", "sheet_lc", "c0", "c1", "tile")
        .withColumn("pile", F.col("row") - F.row_number().over(down))
        .groupBy("book", "sheet_lc", "c0", "c1", "tile", "pile")
        .agg(F.min("row").alias("r0"), F.max("row").alias("r1"), *(F.max(c).alias(c) for c in ("n", "n_formula", "n_plain", "label")))
        .drop("tile", "pile")
    )


def _joined(boxes: list[list[int]], gap: int) -> list[list[int]]:
    """Boxes (r0, r1, c0, c1) that lie within ``gap`` of each other on both axes become one; a sweep by rows."""
    order = sorted(range(len(boxes)), key=lambda k: boxes[k][0])
    parent = list(range(len(boxes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    live: list[int] = []
    for k in order:
        r0, _, c0, c1 = boxes[k]
        live = [j for j in live if boxes[j][1] + gap >= r0]
        for j in live:
            if boxes[j][2] - gap <= c1 and c0 <= boxes[j][3] + gap:
                parent[root(j)] = root(k)
        live.append(k)
    out: dict[int, list[int]] = {}
    for k, b in enumerate(boxes):
        o = out.setdefault(root(k), list(b))
        o[0], o[1], o[2], o[3] = min(o[0], b[0]), max(o[1], b[1]), min(o[2], b[2]), max(o[3], b[3])
    return list(out.values())


def components(rects: list[list[int]]) -> list[list[int]]:
    """Bounding boxes of rectangles that touch, also at corners; boxes that overlap are merged until none does."""
    boxes = _joined(rects, 1)
    while len(merged := _joined(boxes, 0)) < len(boxes):
        boxes = merged
    return sorted(boxes, key=lambda b: (b[0], b[2]))


def _claims(flat: pd.DataFrame, tall: pd.DataFrame) -> pd.DataFrame:
    """(host, step, fragment, ...): which boxes of one row stand where a host's satellites may (``PLACES``), within a column of its columns."""
    found = []
    for step, (sort, edge, off) in enumerate(PLACES):
        met = tall.assign(row=tall[edge] + off).merge(flat, on="row")
        near = (met.f_c0 >= met.c0 - 1) & (met.f_c1 <= met.c1 + 1)
        above = (met.f_c1 >= met.c0) & (met.f_c0 <= met.c1)
        found.append(met[near & above if sort == "title" else near].assign(step=step, sort=sort))
    return pd.concat(found).sort_values(["host", "step", "fragment"])


def _is_total(own: pd.DataFrame) -> bool:
    label = next(iter(own.label.dropna()), "").lower()
    under = own.f_c1.max() >= own.c0.iat[0] and own.f_c0.min() <= own.c1.iat[0]
    return bool(under and (own.n_formula.any() or any(w in label for w in ("total", "sum", "grand"))))


def _is_title(own: pd.DataFrame) -> bool:
    return bool(0 < own.n.sum() <= 4 and own.n.sum() == own.n_plain.sum())


def _with_satellites(found: list[list[int]], facts: pd.DataFrame) -> pd.DataFrame:
    """A row for each box that is no satellite, with its totals row and title. A box of one row goes to the first host, in page order, that
    takes it; ``facts`` says of each such box what is in it."""
    every = pd.DataFrame(found, columns=["r0", "r1", "c0", "c1"]).rename_axis("host").reset_index()
    flat = every[every.r0 == every.r1].merge(facts, on=["r0", "c0"]).rename(columns={"host": "fragment", "r0": "row", "c0": "f_c0", "c1": "f_c1"}).drop(columns="r1")
    taken: dict[tuple[int, str], tuple[int, int, int]] = {}
    used: set[int] = set()
    for (host, step), own in _claims(flat, every[every.r0 < every.r1]).groupby(["host", "step"]):
        sort = PLACES[step][0]
        own = own[~own.fragment.isin(used)]
        if len(own) and (host, sort) not in taken and (_is_total if sort == "totals" else _is_title)(own):
            taken[host, sort] = int(own.row.iat[0]), int(own.f_c0.min()), int(own.f_c1.max())
            used.update(own.fragment)
    out = every[~every.host.isin(used)].rename(columns={"r0": "top", "r1": "comp_bottom", "c0": "left", "c1": "right"})
    of = lambda sort, k: out.host.map({h: x[k] for (h, s), x in taken.items() if s == sort}).astype("Int32")
    total = [of("totals", k) for k in range(3)]
    out = out.assign(totals_top=total[0], bottom=total[0].fillna(out.comp_bottom), t_top=of("title", 0), t_left=of("title", 1), t_bottom=of("title", 0), t_right=of("title", 2))
    return out.assign(left=pd.concat([out.left.astype("Int32"), total[1]], axis=1).min(axis=1), right=pd.concat([out.right.astype("Int32"), total[2]], axis=1).max(axis=1))


def boxes(rects: DataFrame) -> DataFrame:
    """(book, sheet_lc, box, top, left, comp_bottom, bottom, right, totals_top, t_top, ...): a row per region.

    ``comp_bottom`` is where the connected cells end, ``bottom`` takes a detached totals row in. A sheet's rectangles
    are held by one task; a dense table of any length is one rectangle per ``2 ** TILE`` rows.
    """

    def of_sheet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        facts = pdf.loc[pdf.r0 == pdf.r1, ["r0", "c0", "n", "n_formula", "n_plain", "label"]]
        out = _with_satellites(components(pdf[["r0", "r1", "c0", "c1"]].to_numpy().tolist()), facts)
        out = out.assign(book=key[0], sheet_lc=key[1]).sort_values(["top", "left"])
        out["box"] = range(len(out))
        names = [c.split()[0] for c in _BOX.split(", ")]
        return out[names].astype({c: "Int32" for c in names[2:]})

    return rects.groupBy("book", "sheet_lc").applyInPandas(of_sheet, _BOX)
