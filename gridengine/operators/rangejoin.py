"""Joins on rectangles as equality joins on tiles.

An interval predicate alone is planned as a nested loop. Here each range is cut into at most six row tiles of a power of two that
fits its height; points take part once per tile size in use, of which there are at most 31. What remains is checked exactly.

Spark guesses a table's size from its files and does not see that a range becomes several tiles, so tiles are counted here: few are
sent to every task, more are dealt by tile, and neither side meets on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("book", "sheet_lc")
#: Tiles of ranges up to which they are broadcast.
FEW = 20_000


def _level() -> Column:
    """Bits of a tile's height: a quarter of the range's height, rounded up to a power of two."""
    span = (F.col("r1") - F.col("r0") + 1).cast("long")
    return F.greatest(F.lit(0), F.length(F.bin(span - 1)) - 2).cast("int")


def containing(points: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of a point (``keys``, row, col) and a range (``keys``, r0, c0, r1, c1) that holds it; all other columns
    of both sides are kept and must have different names. Null ends hold nothing."""
    tiled = ranges.where("r0 is not null").withColumn("__level", _level())
    at = lambda c: F.expr(f"shiftright({c}, __level)")
    tiles = {r[0]: r[1] for r in tiled.groupBy("__level").agg(F.sum(at("r1") - at("r0") + 1)).collect()}  # at most 31 rows
    levels = list(tiles) or [0]
    tiled = tiled.withColumn("__tile", F.explode(F.sequence(at("r0"), at("r1"))))
    tiled = F.broadcast(tiled) if sum(tiles.values()) <= FEW else tiled.hint("merge")
    dealt = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__tile", at("row"))
    found = dealt.join(tiled, [*keys, "__level", "__tile"])
    return found.where("row between r0 and r1 and col between c0 and c1").drop("__level", "__tile")


def overlapping(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of ranges that share a cell: of ``a`` (``keys``, a_r0, a_c0, a_r1, a_c1) and ``b`` (``keys``, b_r0, ...).

    Row intervals meet if and only if one's first row lies in the other: pairs in which b begins no later, then
    pairs in which b begins later.
    """
    whole = {"r0": "r0", "r1": "r1"}

    def side(starts: DataFrame, s: str, ranges: DataFrame, r: str) -> DataFrame:
        points = starts.withColumns({"row": F.col(f"{s}_r0"), "col": F.lit(1)})
        wide = ranges.withColumns({k: F.col(f"{r}_{v}") for k, v in whole.items()} | {"c0": F.lit(1), "c1": F.lit(1)})
        return containing(points, wide, keys).drop("row", "col", "r0", "r1", "c0", "c1")

    first = side(a, "a", b, "b")
    second = side(b, "b", a, "a").where("b_r0 > a_r0")
    return first.unionByName(second).where("a_c0 <= b_c1 and b_c0 <= a_c1")
