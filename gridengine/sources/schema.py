"""The tables that a set of workbooks becomes.

``cells`` is the fact table: a row per stored cell, its value in the column of its type. ``ord`` is the order in
which a sheet is read, row by row. ``sheet_lc`` joins, ``sheet`` is shown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import date_text, number_text


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CELLS = _schema("book:s sheet:s sheet_lc:s row:i col:i ord:l type:s num:d str:s bool:b ts:t formula:s bold:b italic:b num_fmt:s fill:s hyperlink:s")
SHEETS = _schema("book:s sheet:s sheet_lc:s sheet_idx:i hidden:b max_row:i max_col:i")
NAMES = _schema("book:s name:s name_lc:s name_ord:i target_ord:i target:s sheet:s r0:i c0:i r1:i c1:i open:s external:s")
MERGES = _schema("book:s sheet:s sheet_lc:s m_ord:i r0:i c0:i r1:i c1:i")
WARNINGS = _schema("book:s w_ord:i key:s message:s")


def value_text(prefix: str = "") -> Column:
    """A cell's value as it is shown and compared as text."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("str"), number_text(c("num")), c("bool").cast("string"), date_text(c("ts")))


def value_json(prefix: str = "") -> Column:
    """A cell's value as JSON text; null for no value."""
    c = lambda n: F.col(prefix + n)
    text = F.coalesce(c("str"), date_text(c("ts")))
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.coalesce(F.when(text.isNotNull(), quoted), number_text(c("num")), c("bool").cast("string"), F.lit("null"))
