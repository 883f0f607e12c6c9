"""Number, date, hash and token texts as column expressions, with plain twins for single values."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash36(s: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, in base 36."""
    return F.lower(F.conv(fnv1a(s).cast("string"), 10, 36))


def fnv1a(s: Column) -> Column:
    units = F.hex(F.encode(s, "UTF-16BE"))
    n = (F.length(units) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda k: F.conv(F.substring(units, k * 4 + 1, F.lit(4)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, k: (h.bitwiseXOR(unit(k)) * 16777619).bitwiseAND(F.lit(4294967295)))


def plain_hash36(s: str) -> str:
    h, raw = 2166136261, s.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h ^ (raw[k] << 8 | raw[k + 1])) * 16777619 & 0xFFFFFFFF
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def number_text(x: Column) -> Column:
    """A double as its shortest decimal text, without a trailing ``.0``."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    fraction = F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    plain = F.when(F.abs(x).between(1e-6, 1e15), fraction).otherwise(x.cast("string"))
    return F.when(F.isnan(x), "NaN").when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(plain)


def plain_number(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    s = repr(float(x))
    if "e" in s and 1e-7 <= abs(x) < 1e21:
        s = f"{x:.20f}".rstrip("0")
    return s


def grouped_number(x: Column) -> Column:
    """Two decimals from 100 up, else four; halves go up; zeros at the end go; thousands in groups."""
    x = x.cast("double")
    units = F.when(F.abs(x) >= 100, F.floor(x * 100 + 0.5) * 100).otherwise(F.floor(x * 10000 + 0.5)).cast("decimal(38,0)")
    size = F.abs(units)
    whole = F.floor(size / F.lit(10000).cast("decimal(5,0)")).cast("decimal(38,0)")
    rest = F.regexp_replace(F.lpad((size - whole * 10000).cast("decimal(38,0)").cast("string"), 4, "0"), "0+$", "")
    digits = F.regexp_replace(whole.cast("string"), r"\B(?=(\d{3})+(?!\d))", ",")
    return F.concat(F.when(units < 0, "-").otherwise(""), digits, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))


def plain_grouped(x: float) -> str:
    if not math.isfinite(x):
        return plain_number(x)
    r = math.floor(x * 100 + 0.5) / 100 if abs(x) >= 100 else math.floor(x * 10000 + 0.5) / 10000
    whole, _, rest = plain_number(abs(r)).partition(".")
    return ("-" if r < 0 else "") + f"{int(whole):,}" + (f".{rest}" if rest else "")


def date_text(ts: Column) -> Column:
    """A date where it is midnight (UTC session), else date and time with Z; milliseconds only if there are any."""
    day = F.date_format(ts, "yyyy-MM-dd")
    clock = F.date_format(ts, "HH:mm:ss")
    ms = F.date_format(ts, "SSS")
    return F.when((clock == "00:00:00") & (ms == "000"), day).otherwise(F.concat(day, F.lit("T"), clock, F.when(ms != "000", F.concat(F.lit("."), ms)).otherwise(""), F.lit("Z")))


def plain_date(d: datetime) -> str:
    if (d.hour, d.minute, d.second, d.microsecond // 1000) == (0, 0, 0, 0):
        return d.strftime("%Y-%m-%d")
    ms = d.microsecond // 1000
    return d.strftime("%Y-%m-%dT%H:%M:%S") + (f".{ms:03d}" if ms else "") + "Z"


def tokens(s: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; null counts 0."""
    units = F.octet_length(F.encode(s, "UTF-16BE")) / 2
    return F.coalesce(F.ceil(units / 4), F.lit(0)).cast("long")


def plain_tokens(s: str | None) -> int:
    return 0 if s is None else -(-(len(s.encode("utf-16-be", "surrogatepass")) // 2) // 4)


def half_up(x: Column, places: int) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x * 10**places + 0.5) / float(10**places)
