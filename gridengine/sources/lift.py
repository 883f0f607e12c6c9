"""Any DataFrame as a sheet: headers in row 1, values below, so that every operator works on any Spark source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import numbered

STRIDE = 16_384


def _tagged(name: str, kind: T.DataType, at: int):
    """A struct of the cell's typed values. Nulls stay out later; an empty string is no cell."""
    c = F.col(f"`{name}`")
    none = {"num": "double", "str": "string", "bool": "boolean", "ts": "timestamp"}
    if isinstance(kind, T.NumericType):
        tag, own = "number", {"num": c.cast("double")}
    elif isinstance(kind, T.BooleanType):
        tag, own = "boolean", {"bool": c}
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        tag, own = "date", {"ts": c.cast("timestamp")}
    elif isinstance(kind, T.StringType):
        tag, own = "string", {"str": F.when(c != "", c)}
    else:
        tag, own = "string", {"str": F.to_json(F.struct(c.alias("v")))}
    values = [own.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in none.items()]
    there = F.coalesce(*(v for v in own.values())).isNotNull()
    return F.struct(F.lit(at).alias("col"), F.when(there, F.lit(tag)).alias("type"), *values)


def lift(df: DataFrame, sheet: str, order: list[str] | None = None, book: str = "lifted", columns: list[str] | None = None, at: tuple[int, int] = (1, 1), bold_headers: bool = True) -> DataFrame:
    """``df`` as cells of one sheet, its rows in the given order (by default by all columns), from the top left cell ``at``.

    Columns that aren't asked for are pruned before anything is dealt. Nulls and empty texts are no cells;
    nested values become JSON texts.
    """
    columns = columns or df.columns
    top, left = at
    order = order or df.columns
    rows = numbered(df.select(*dict.fromkeys([*columns, *order])), order, "__row")
    kinds = {f.name: f.dataType for f in df.schema}
    cells = rows.select((F.col("__row") + top).cast("int").alias("row"), F.explode(F.array(*(_tagged(n, kinds[n], left + k) for k, n in enumerate(columns)))).alias("c"))
    cells = cells.select("row", "c.*").where("type is not null").withColumn("bold", F.lit(None).cast("boolean"))
    heads = ", ".join(f"named_struct('col', {left + k}, 'str', '{n.replace(chr(39), chr(92) + chr(39))}')" for k, n in enumerate(columns))
    head = df.sparkSession.sql(f"SELECT explode(array({heads})) AS h").select(
        F.lit(top).alias("row"), F.col("h.col").alias("col"), F.lit("string").alias("type"), F.lit(None).cast("double").alias("num"), F.col("h.str").alias("str"),
        F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("timestamp").alias("ts"), F.lit(bold_headers or None).cast("boolean").alias("bold"),
    )
    return placed(head.unionByName(cells), book, sheet)


def placed(cells: DataFrame, book: str, sheet: str) -> DataFrame:
    """Cells with the columns that are the same for the whole sheet, in the order of the schema."""
    from .schema import CELLS

    out = cells.withColumns({"book": F.lit(book), "sheet": F.lit(sheet), "sheet_lc": F.lit(sheet.lower()), "ord": F.col("row").cast("long") * STRIDE + F.col("col")})
    return out.select(*((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CELLS))


def sheets_of(cells: DataFrame) -> DataFrame:
    """A ``sheets`` table for cells that came without one: visible, in the order of their names."""
    from pyspark.sql import Window

    found = cells.groupBy("book", "sheet", "sheet_lc").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))
    place = F.row_number().over(Window.partitionBy("book").orderBy("sheet")) - 1
    return found.select("book", "sheet", "sheet_lc", place.cast("int").alias("sheet_idx"), F.lit(False).alias("hidden"), "max_row", "max_col")
