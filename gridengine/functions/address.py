"""A1 addresses and ranges: column expressions for tables, and plain helpers for single addresses."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLS = 1_048_576, 16_384
#: Rows of a sheet that no file has to hold, as a lifted table: what an int numbers.
GRID_ROWS = 2**31 - 1
_PLAIN_SHEET = "^[A-Za-z_][A-Za-z0-9_]*$"

# ---- column expressions -----------------------------------------------------------------------------------


def col_letter(c: Column) -> Column:
    """Letters of a 1-based column; null outside 1 to 16384. Three base-26 places with digits 1 to 26."""
    c = c.cast("int")
    letter = lambda x: F.char(x + 65)
    last = F.pmod(c - 1, F.lit(26))
    second = F.floor((c - 1) / 26).cast("int")
    third = F.floor((second - 1) / 26).cast("int")
    text = F.concat(
        F.when(c > 702, letter(third - 1)).otherwise(""),
        F.when(c > 26, letter(F.pmod(second - 1, F.lit(26)))).otherwise(""),
        letter(last),
    )
    return F.when(c.between(1, MAX_COLS), text)


def letter_col(s: Column) -> Column:
    """1-based column of letters, in either case; null for anything else."""
    chars = F.split(F.upper(s), "")
    n = F.aggregate(chars, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    return F.when(s.rlike("^[A-Za-z]{1,3}$"), n)


def quote_sheet(s: Column) -> Column:
    return F.when(s.rlike(_PLAIN_SHEET), s).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def format_cell(row: Column, col: Column, sheet: Column | None = None) -> Column:
    local = F.concat(col_letter(col), row.cast("int").cast("string"))
    return local if sheet is None else F.concat(quote_sheet(sheet), F.lit("!"), local)


def format_range(r0: Column, c0: Column, r1: Column, c1: Column, sheet: Column | None = None) -> Column:
    """A single cell is printed once."""
    one = (r0 == r1) & (c0 == c1)
    local = F.when(one, format_cell(r0, c0)).otherwise(F.concat(format_cell(r0, c0), F.lit(":"), format_cell(r1, c1)))
    return local if sheet is None else F.concat(quote_sheet(sheet), F.lit("!"), local)


def parse_local(text: Column, max_rows: int = MAX_ROWS) -> Column:
    """``B4``, ``$B$4:C9``, ``A:C`` or ``2:5`` to a struct (r0, c0, r1, c1, open), ends in order; null if none of them.

    ``max_rows``: a file's, or ``GRID_ROWS``.
    """
    n = f"{{1,{len(str(max_rows))}}}"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    cell = rf"^\$?([A-Za-z]{{1,3}})\$?(\d{n})$"
    pair = rf"^\$?([A-Za-z]{{1,3}})\$?(\d{n}):\$?([A-Za-z]{{1,3}})\$?(\d{n})$"
    cols = r"^\$?([A-Za-z]{1,3}):\$?([A-Za-z]{1,3})$"
    rows = rf"^\$?(\d{n}):\$?(\d{n})$"
    num = lambda pattern, k: part(pattern, k).try_cast("int")
    let = lambda pattern, k: letter_col(part(pattern, k))

    def made(r0, c0, r1, c1, kind):
        return F.struct(
            F.least(r0, r1).cast("int").alias("r0"), F.least(c0, c1).cast("int").alias("c0"), F.greatest(r0, r1).cast("int").alias("r1"), F.greatest(c0, c1).cast("int").alias("c1"), F.lit(kind).cast("string").alias("open")
        )

    def fits(r, c):
        return r.between(1, max_rows) & c.between(1, MAX_COLS)

    one = F.when(text.rlike(cell) & fits(num(cell, 2), let(cell, 1)), made(num(cell, 2), let(cell, 1), num(cell, 2), let(cell, 1), None))
    two = F.when(text.rlike(pair) & fits(num(pair, 2), let(pair, 1)) & fits(num(pair, 4), let(pair, 3)), made(num(pair, 2), let(pair, 1), num(pair, 4), let(pair, 3), None))
    columns = F.when(text.rlike(cols), made(F.lit(1), let(cols, 1), F.lit(max_rows), let(cols, 2), "columns"))
    lines = F.when(text.rlike(rows), made(num(rows, 1), F.lit(1), num(rows, 2), F.lit(MAX_COLS), "rows"))
    return F.coalesce(one, two, columns, lines)


def range_area(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return (r1 - r0 + 1).cast("long") * (c1 - c0 + 1).cast("long")


def contains(r0, c0, r1, c1, row, col) -> Column:
    return row.between(r0, r1) & col.between(c0, c1)


def overlaps(a: str, b: str) -> Column:
    """Of two sets of columns (r0, c0, r1, c1) with prefixes."""
    at = F.col
    return (at(f"{a}r0") <= at(f"{b}r1")) & (at(f"{b}r0") <= at(f"{a}r1")) & (at(f"{a}c0") <= at(f"{b}c1")) & (at(f"{b}c0") <= at(f"{a}c1"))


# ---- plain helpers --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    sheet: str | None
    r0: int
    c0: int
    r1: int
    c1: int
    open: str | None = None
    external: str | None = None

    @property
    def area(self) -> int:
        return (self.r1 - self.r0 + 1) * (self.c1 - self.c0 + 1)

    def ordered(self) -> Range:
        return replace(self, r0=min(self.r0, self.r1), r1=max(self.r0, self.r1), c0=min(self.c0, self.c1), c1=max(self.c0, self.c1))

    def has(self, sheet: str, row: int, col: int) -> bool:
        return same_sheet(self.sheet, sheet) and self.r0 <= row <= self.r1 and self.c0 <= col <= self.c1

    def meets(self, other: Range) -> bool:
        return same_sheet(self.sheet, other.sheet) and self.r0 <= other.r1 and other.r0 <= self.r1 and self.c0 <= other.c1 and other.c0 <= self.c1

    def clamped(self, max_row: int, max_col: int) -> Range:
        """Ends cut to a used extent, never before the starts."""
        return replace(self, r1=min(self.r1, max(max_row, self.r0)), c1=min(self.c1, max(max_col, self.c0)))

    def cells(self, cap: int | None = None):
        n = 0
        for r in range(self.r0, self.r1 + 1):
            for c in range(self.c0, self.c1 + 1):
                if cap is not None and n >= cap:
                    return
                n += 1
                yield r, c

    def text(self, with_sheet: bool = True) -> str:
        a, b = f"{letters(self.c0)}{self.r0}", f"{letters(self.c1)}{self.r1}"
        local = a if a == b else f"{a}:{b}"
        return f"{quoted(self.sheet)}!{local}" if with_sheet else local


def letters(col: int) -> str:
    if col < 1:
        raise ValueError(f"column must be a positive integer, got {col}")
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def column(text: str) -> int:
    if not re.fullmatch("[A-Za-z]+", text):
        raise ValueError(f'invalid column letters: "{text}"')
    n = 0
    for ch in text.upper():
        n = n * 26 + ord(ch) - 64
    return n


def quoted(sheet: str) -> str:
    return sheet if re.fullmatch(_PLAIN_SHEET, sheet) else "'" + sheet.replace("'", "''") + "'"


def same_sheet(a: str | None, b: str | None) -> bool:
    return (a or "").lower() == (b or "").lower()


def local_cell(text: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})", text)
    if not m:
        return None
    row, col = int(m[2]), column(m[1])
    return (row, col) if 1 <= row <= MAX_ROWS and col <= MAX_COLS else None


def split_sheet(address: str) -> tuple[str | None, str]:
    if address.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'!", address)
        if not m:
            raise ValueError(f'malformed quoted sheet reference: "{address}"')
        return m[1].replace("''", "'"), address[m.end() :]
    sheet, bang, rest = address.partition("!")
    return (sheet, rest) if bang else (None, address)


def parse_cell(address: str, default: str | None = None) -> Range:
    sheet, rest = split_sheet(address.strip())
    at = local_cell(rest)
    if not at:
        raise ValueError(f'invalid cell address: "{address}"')
    if not (sheet := sheet if sheet is not None else default):
        raise ValueError(f'address "{address}" has no sheet; qualify it like Sheet1!{rest.upper()}')
    return Range(sheet, at[0], at[1], at[0], at[1])


def parse_range(text: str, default: str | None = None) -> Range:
    sheet, rest = split_sheet(text.strip())
    sheet = sheet if sheet is not None else default
    if not sheet:
        raise ValueError(f'range "{text}" has no sheet; qualify it like Sheet1!{rest}')
    ends = rest.split(":")
    cells = [local_cell(e) for e in ends]
    if len(ends) <= 2 and all(cells):
        (r0, c0), (r1, c1) = cells[0], cells[-1]
        return Range(sheet, r0, c0, r1, c1).ordered()
    if len(ends) == 2:
        if all(cols := [re.fullmatch(r"\$?([A-Za-z]{1,3})", e) for e in ends]):
            return Range(sheet, 1, column(cols[0][1]), MAX_ROWS, column(cols[1][1]), "columns").ordered()
        if all(rows := [re.fullmatch(r"\$?([0-9]{1,7})", e) for e in ends]):
            return Range(sheet, int(rows[0][1]), 1, int(rows[1][1]), MAX_COLS, "rows").ordered()
    raise ValueError(f'invalid range: "{text}"')
