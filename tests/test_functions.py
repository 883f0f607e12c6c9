import pytest
from pyspark.sql import functions as F

from gridengine.functions import address as A
from gridengine.functions import formula as P
from gridengine.functions import text as X


def test_letters_round_trip(spark):
    rows = spark.range(1, 16385).select(F.col("id"), A.col_letter(F.col("id")).alias("l")).withColumn("back", A.letter_col(F.col("l"))).collect()
    assert all(r.l == A.letters(r.id) and r.back == r.id == A.column(r.l) for r in rows)
    assert (A.letters(1), A.letters(26), A.letters(27), A.letters(16384)) == ("A", "Z", "AA", "XFD")


def test_addresses():
    assert A.parse_cell("'My Sheet'!$B$4") == A.Range("My Sheet", 4, 2, 4, 2)
    assert A.parse_cell("'It''s'!A1").text() == "'It''s'!A1"
    assert A.parse_range("B10:A1", "S").text() == "S!A1:B10"
    assert A.parse_range("S!A:C").open == "columns" and A.parse_range("5:2", "S").r0 == 2
    assert A.parse_range("A:A", "S").clamped(9, 3) == A.Range("S", 1, 1, 9, 1, "columns")
    for bad in ("A0", "ZZZZ1", "XFE1", "A1:B2:C3", "'x!A1"):
        with pytest.raises(ValueError):
            A.parse_range(bad, "S")
    with pytest.raises(ValueError):
        A.parse_cell("B4")


def test_column_expressions(spark):
    d = spark.createDataFrame([("B4",), ("$C$9:a2",), ("B:A",), ("7:5",), ("nope1x",), (None,)], "t string").select("t", A.parse_local(F.col("t")).alias("p"))
    got = {r.t: r.p and tuple(r.p) for r in d.collect()}
    assert got == {"B4": (4, 2, 4, 2, None), "$C$9:a2": (2, 1, 9, 3, None), "B:A": (1, 1, A.MAX_ROWS, 2, "columns"), "7:5": (5, 1, 7, A.MAX_COLS, "rows"), "nope1x": None, None: None}
    d = spark.createDataFrame([("Sales", 3, 1, 35, 6), ("It's", 1, 1, 1, 1)], "s string, r0 int, c0 int, r1 int, c1 int")
    assert [r[0] for r in d.select(A.format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), F.col("s"))).collect()] == ["Sales!A3:F35", "'It''s'!A1"]


@pytest.mark.parametrize("text, want", [("sales|Sales!A3:F35", "1hqooki"), ("summary|Summary!B2:C5", "l2zijg"), ("rates|Rates!A1:B5", "1ayprhb")])
def test_region_hash(spark, text, want):
    assert X.plain_hash36(text) == want
    assert spark.range(1).select(X.hash36(F.lit(text))).first()[0] == want


def test_numbers_dates_tokens(spark):
    values = [0.0, 1.5, -2.5, 1234.565, 999.995, 100.0, 99.99995, -1234567.891, 0.00005, 12345678901.0, 1e-5, 3.0, 0.1, 1e7 + 0.5]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.grouped_number(F.col("v")).alias("g"), X.number_text(F.col("v")).alias("n"))
    for r in d.collect():
        assert r.g == X.plain_grouped(r.v) and r.n == X.plain_number(r.v)
    assert X.plain_grouped(1234.565) == "1,234.57" and X.plain_grouped(-2.5) == "-2.5" and X.plain_number(1e7 + 0.5) == "10000000.5"
    got = spark.sql("select timestamp'2026-01-02 00:00:00' a, timestamp'2026-01-02 03:04:05.670' b, timestamp'2026-01-02 03:04:05' c")
    assert list(got.select(*(X.date_text(F.col(c)) for c in "abc")).first()) == ["2026-01-02", "2026-01-02T03:04:05.670Z", "2026-01-02T03:04:05Z"]
    assert spark.createDataFrame([("abcde",), (None,), ("😀😀😀",)], "s string").select(X.tokens(F.col("s"))).collect() == [(2,), (0,), (2,)]
    assert X.plain_tokens("😀😀😀") == 2


def refs(f, sheet="S"):
    return [(r.kind, r.raw, r.range.text() if r.range else r.name, r.external) for r in P.scan(f, sheet).refs]


@pytest.mark.parametrize(
    "formula, want",
    [
        ("B4*$C$5", [("cell", "B4", "S!B4", None), ("cell", "$C$5", "S!C5", None)]),
        ("SUM(A1:B10)+Other!C3", [("range", "A1:B10", "S!A1:B10", None), ("cell", "Other!C3", "Other!C3", None)]),
        ("'My Sheet'!A1+'It''s'!B2", [("cell", "'My Sheet'!A1", "'My Sheet'!A1", None), ("cell", "'It''s'!B2", "'It''s'!B2", None)]),
        ('"A1 ""B2"" "&C3', [("cell", "C3", "S!C3", None)]),
        ("LOG10(A1)+LOG10 (B1)", [("cell", "A1", "S!A1", None), ("cell", "B1", "S!B1", None)]),
        ("SUM(A:C)+SUM(2:5)+SUM($2:$5)", [("range", "A:C", "S!A1:C1048576", None), ("range", "2:5", "S!A2:XFD5", None), ("range", "$2:$5", "S!A2:XFD5", None)]),
        ("'[Budget.xlsx]FY26'!B2+[Plan.xlsx]Q1!A1+[1]Sheet1!A1", [("cell", "'[Budget.xlsx]FY26'!B2", "FY26!B2", "Budget.xlsx"), ("cell", "[Plan.xlsx]Q1!A1", "Q1!A1", "Plan.xlsx"), ("cell", "[1]Sheet1!A1", "Sheet1!A1", "1")]),
        (r"'C:\x\[B.xlsx]S 1'!A1", [("cell", r"'C:\x\[B.xlsx]S 1'!A1", "'S 1'!A1", r"C:\x\B.xlsx")]),
        ("Table1[[#All],[Qty]]*2", [("structured", "Table1[[#All],[Qty]]", "Table1", None)]),
        ("Sheet1:Sheet3!A1+'Jan:Mar'!B2", [("cell", "Sheet1:Sheet3!A1", "Sheet1!A1", None), ("cell", "'Jan:Mar'!B2", "Jan!B2", None)]),
        ("TaxRate*1.5E+3+TRUE+FALSE()", [("name", "TaxRate", "TaxRate", None)]),
        ("IF(A1>2.5,3,4e5)", [("cell", "A1", "S!A1", None)]),
        ("$5+XFE1", [("name", "XFE1", "XFE1", None)]),
        ("", []),
    ],
)
def test_scan(formula, want):
    assert refs(formula) == want


def test_scan_warnings():
    assert len(P.scan("Table1[x]+First:Third!A1+'A:B'!C1", "S").warnings) == 3


def test_shift_and_relative_form():
    assert P.shifted("A1*$B$2+SUM(C$1:$D4)+Name&\"A1\"", "S", 2, 1) == 'B3*$B$2+SUM(D$1:$D6)+Name&"A1"'
    assert P.shifted("A1+S!B2:C3", "S", -5, -5) == "A1+S!A1:A1"
    assert P.shifted("SUM(A:B)+SUM(2:$3)", "S", 1, 1) == "SUM(B:C)+SUM(3:$3)"
    assert P.relative_form("D4*E4", "S", 4, 6) == "R[0]C[-2]*R[0]C[-1]" == P.relative_form("D9*E9", "S", 9, 6)
    assert P.relative_form("sum($A$1:b2)", "S", 1, 1) == "SUM(R1C1:R[1]C[1])"


def test_udfs(spark):
    d = spark.createDataFrame([("A1+B2", 3, 3), (None, 1, 1)], "f string, r int, c int")
    rows = d.select(P.scan_udf("f", F.lit("S")).alias("x"), P.shifted_udf("f", F.lit("S"), "r", "c").alias("s"), P.relative_udf("f", F.lit("S"), "r", "c").alias("t")).collect()
    assert [r.raw for r in rows[0].x.refs] == ["A1", "B2"] and rows[0].s == "D4+E5" and rows[0].t == "R[-2]C[-2]+R[-1]C[-1]"
    assert rows[1].s is None and rows[1].t is None and rows[1].x.refs == []


def test_rows_past_those_of_a_file(spark):
    """A file ends at 1,048,576 rows, a lifted table does not."""
    f = "SUM(D1048577:F12345678)+C1048577*$A$1048577"
    assert [r.kind for r in P.scan(f, "S").refs] == ["name"] * 4
    assert [(r.kind, r.range.text()) for r in P.scan(f, "S", A.GRID_ROWS).refs] == [("range", "S!D1048577:F12345678"), ("cell", "S!C1048577"), ("cell", "S!A1048577")]
    assert P.scan("SUM(A:A)", "S", A.GRID_ROWS).refs[0].range.r1 == A.GRID_ROWS and P.scan("A2147483648", "S", A.GRID_ROWS).refs[0].kind == "name"
    assert P.scan("S!9999999999:9999999999", "S", A.GRID_ROWS).refs == []
    d = spark.createDataFrame([("AG$1007283:$BH12345678",)], "t string")
    assert d.select(A.parse_local(F.col("t"))).first()[0] is None
    assert tuple(d.select(A.parse_local(F.col("t"), A.GRID_ROWS)).first()[0]) == (1007283, 33, 12345678, 60, None)
    d = d.select(F.lit(f).alias("f"))
    got = d.select(P.scan_udf("f", F.lit("S"), A.GRID_ROWS)["refs"]["kind"], P.shifted_udf("f", F.lit("S"), F.lit(2), F.lit(1), A.GRID_ROWS), P.relative_udf("f", F.lit("S"), F.lit(1048577), F.lit(7), A.GRID_ROWS)).first()
    assert list(got) == [["range", "cell", "cell"], "SUM(E1048579:G12345680)+D1048579*$A$1048577", "SUM(R[0]C[-3]:R[11297101]C[-1])+R[0]C[-4]*R1048577C1"]
