"""The registered queries: every operator over whole tables, each with the SQL that DuckDB runs on the same files.

Tables are lifted to sheets; a workspace is made once per session, folder and layout, and queries share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import text as X
from ..functions.formula import relative_udf, scan_udf, shifted_udf
from ..operators import cashflow, collection, extract, graph, locate, rangejoin, region_edges, search, summarise
from ..sources.lift import lift, placed, sheets_of
from ..sources.schema import NAMES, value_text
from .tables import written
from .workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_made: dict[tuple, Workspace] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lifted(spark: SparkSession, sf_dir: str, name: str, sheet: str | None = None, at: tuple[int, int] = (1, 1), book: str = "lifted") -> DataFrame:
    return lift(_table(spark, sf_dir, name), sheet or name, [KEYS[name]], book, COLUMNS[name], at)


def _workspace(spark: SparkSession, sf_dir: str, layout: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _made:
        _made[key] = LAYOUTS[layout](spark, sf_dir)
    return _made[key]


def _tables(*names: str):
    return lambda spark, sf_dir: Workspace.lifted(spark, *(_lifted(spark, sf_dir, n) for n in names))


def _side_by_side(spark: SparkSession, sf_dir: str) -> Workspace:
    """Three tables on one sheet, two of them next to each other, one below after a gap."""
    parts = [_lifted(spark, sf_dir, "nation", "layout"), _lifted(spark, sf_dir, "region", "layout", (1, 6)), _lifted(spark, sf_dir, "supplier", "layout", (30, 1))]
    return Workspace.lifted(spark, *parts)


def _with_subtotals(spark: SparkSession, sf_dir: str) -> Workspace:
    """Orders by priority, each group closed by a row with its sum."""
    o = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    sums = o.groupBy("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("Total"))
    rows = o.select(F.col("o_orderpriority").alias("g"), F.lit(0).alias("last"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("Priority"), F.col("o_orderkey").alias("Order"), F.col("o_totalprice").alias("Total"))
    closing = sums.select(F.col("o_orderpriority").alias("g"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("k"), F.concat("o_orderpriority", F.lit(" Subtotal")).alias("Priority"), F.lit(None).cast("long").alias("Order"), "Total")
    return Workspace.lifted(spark, lift(rows.unionByName(closing), "sales", ["g", "last", "k"], columns=["Priority", "Order", "Total"]))


def _formulas(spark: SparkSession, sf_dir: str) -> Workspace:
    """Parts with a computed price, and a sheet of formulas over the suppliers: one cell, a short range, a long range, another book."""
    part = _lifted(spark, sf_dir, "part")
    r = F.col("row").cast("string")
    part = part.withColumn("formula", F.when((F.col("col") == 6) & (F.col("row") > 1), F.concat(F.lit("E"), r, F.lit("*2+$B$1"))))
    nation = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("row"), F.col("n_regionkey").alias("k"))
    n = F.col("row").cast("string")
    formula = F.concat(F.lit("supplier!D"), n, F.lit("+SUM(supplier!A2:A"), (F.col("row") + 3).cast("string"), F.lit(")"))
    first = nation.select("row", F.lit(1).alias("col"), F.lit("number").alias("type"), F.col("k").cast("double").alias("num"), formula.alias("formula"))
    chain = F.when(F.col("row") == 1, F.lit("A1")).otherwise(F.concat(F.lit("B"), (F.col("row") - 1).cast("string"), F.lit("+A"), n))
    second = nation.select("row", F.lit(2).alias("col"), F.lit("number").alias("type"), F.col("k").cast("double").alias("num"), chain.alias("formula"))
    far = nation.select("row", F.lit(3).alias("col"), F.lit("number").alias("type"), F.lit(0.0).alias("num"), F.concat(F.lit("'[plan"), F.col("k").cast("string"), F.lit(".xlsx]S'!B"), n, F.lit("+SUM(part!A1:F5000)")).alias("formula"))
    calc = placed(first.unionByName(second).unionByName(far), "lifted", "calc")
    cells = part.unionByName(_lifted(spark, sf_dir, "supplier")).unionByName(calc)
    names = spark.createDataFrame(
        [("lifted", "Balances", "balances", 0, 0, "supplier!D2:D9", "supplier", 2, 4, 9, 4, None, None), ("lifted", "Keys", "keys", 1, 0, "supplier!A:A", "supplier", 1, 1, A.MAX_ROWS, 1, "columns", None), ("lifted", "Prices", "prices", 2, 0, "part!F2:F40", "part", 2, 6, 40, 6, None, None)],
        NAMES,
    )
    cells = written(cells, "cells")
    return Workspace(spark, cells, sheets_of(cells), names)


def _two_books(spark: SparkSession, sf_dir: str) -> Workspace:
    """Nations in one book; in another, suppliers with their nation's name."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "s_name", F.col("n_name").alias("nation"))
    return Workspace.lifted(spark, _lifted(spark, sf_dir, "nation", "nations", book="dims"), lift(named, "sellers", ["s_suppkey"], "facts"))


LAYOUTS = {
    "dims": _tables("region", "nation", "supplier"),
    "customer": _tables("customer"),
    "orders": _tables("orders"),
    "part": _tables("part"),
    "side_by_side": _side_by_side,
    "subtotals": _with_subtotals,
    "formulas": _formulas,
    "two_books": _two_books,
}


def _plain(expr: str) -> str:
    """DuckDB: a double as text without a trailing .0."""
    return f"regexp_replace(CAST(CAST({expr} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


def _letter(expr: str) -> str:
    return f"(CASE WHEN {expr} > 702 THEN chr(CAST(65 + ((({expr} - 1) // 26 - 1) // 26 - 1) AS INTEGER)) ELSE '' END || CASE WHEN {expr} > 26 THEN chr(CAST(65 + ((({expr} - 1) // 26) - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + ({expr} - 1) % 26 AS INTEGER)))"


def _unpivoted(name: str, numeric: set[str]) -> str:
    """DuckDB: a lifted table's cells."""
    key = KEYS[name]
    parts = [f"SELECT 1::BIGINT AS \"row\", {k}::BIGINT AS col, 'string' AS type, '{c}' AS value" for k, c in enumerate(COLUMNS[name], 1)]
    for k, c in enumerate(COLUMNS[name], 1):
        value, kind = (_plain(c), "number") if c in numeric else (c, "string")
        parts.append(f"SELECT row_number() OVER (ORDER BY {key}) + 1 AS \"row\", {k}::BIGINT AS col, '{kind}' AS type, {value} AS value FROM {name}")
    return " UNION ALL ".join(parts)


CUSTOMER_NUMBERS = {"c_custkey", "c_nationkey", "c_acctbal"}
CUSTOMER_CELLS = _unpivoted("customer", CUSTOMER_NUMBERS)

# ---- sources ------------------------------------------------------------------------------------------------


@query(CUSTOMER_CELLS)
def q_lift_cells(spark, sf_dir):
    cells = _workspace(spark, sf_dir, "customer").cells
    return cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "type", value_text().alias("value"))


@query(
    "SELECT * FROM (SELECT 'region' AS sheet, count(*) + 1 AS row_count, 2::BIGINT AS col_count, 2 * (count(*) + 1) AS cell_count, 'A1:B' || (count(*) + 1) AS used_range FROM region "
    "UNION ALL SELECT 'nation', count(*) + 1, 3, 3 * (count(*) + 1), 'A1:C' || (count(*) + 1) FROM nation UNION ALL SELECT 'supplier', count(*) + 1, 4, 4 * (count(*) + 1), 'A1:D' || (count(*) + 1) FROM supplier)"
)
def q_sheet_stats(spark, sf_dir):
    s = search.sheet_stats(_workspace(spark, sf_dir, "dims"))
    return s.select("sheet", F.col("row_count").cast("long").alias("row_count"), F.col("col_count").cast("long").alias("col_count"), "cell_count", "used_range")


# ---- addresses and texts -------------------------------------------------------------------------------------


@query(f"SELECT n, {_letter('n')} AS letters, n AS back FROM (SELECT unnest(range(1, 16385)) AS n)")
def q_col_letter(spark, sf_dir):
    d = spark.range(1, 16385).select(F.col("id").alias("n"), A.col_letter(F.col("id")).alias("letters"))
    return d.withColumn("back", A.letter_col(F.col("letters")).cast("long"))


@query(
    "SELECT o_orderkey, least(o_orderkey, o_custkey) + 1 AS r0, 1 + o_custkey % 50 AS c0, greatest(o_orderkey, o_custkey) + 1 AS r1, 60::BIGINT AS c1, "
    f"{_letter('(1 + o_custkey % 50)')} || (least(o_orderkey, o_custkey) + 1) || ':BH' || (greatest(o_orderkey, o_custkey) + 1) AS shown FROM orders"
)
def q_parse_a1(spark, sf_dir):
    """Ranges written from order and customer keys, with their ends in any order, read back and written again."""
    o = _table(spark, sf_dir, "orders")
    text = F.concat(A.col_letter(F.col("o_custkey") % 50 + 1), F.lit("$"), (F.col("o_orderkey") + 1).cast("string"), F.lit(":$BH"), (F.col("o_custkey") + 1).cast("string"))
    p = o.select("o_orderkey", A.parse_local(text, A.GRID_ROWS).alias("p"))
    shown = A.format_range(F.col("p.r0"), F.col("p.c0"), F.col("p.r1"), F.col("p.c1"))
    return p.select("o_orderkey", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("r0", "c0", "r1", "c1")), shown.alias("shown"))


@query(
    "SELECT n_name, CASE WHEN regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*') THEN n_name ELSE '''' || replace(n_name, '''', '''''') || '''' END || '!A' || (n_nationkey + 1) AS address FROM nation "
    "UNION ALL SELECT 'it''s ' || r_name, '''it''''s ' || r_name || '''!A' || (r_regionkey + 1) FROM region"
)
def q_quote_sheet(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    r = _table(spark, sf_dir, "region").select(F.concat(F.lit("it's "), "r_name").alias("n_name"), F.col("r_regionkey").alias("k"))
    return n.unionByName(r).select("n_name", A.format_cell(F.col("k") + 1, F.lit(1), F.col("n_name")).alias("address"))


@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM part")
def q_hash36(spark, sf_dir):
    """The integer behind a region's id; the base 36 text is read back."""
    h = F.conv(X.hash36(F.col("p_name")), 36, 10).cast("long")
    return _table(spark, sf_dir, "part").select("p_partkey", h.alias("h"))


@query(
    "WITH t AS (SELECT o_custkey, floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE * 100 + 0.5) AS u FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) >= 100) "
    "SELECT o_custkey, regexp_replace(regexp_replace(format('{:,.2f}', u / 100), '0+$', ''), '\\.$', '') AS shown FROM t"
)
def q_fmt_number(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("t")).where("t >= 100")
    return t.select("o_custkey", X.grouped_number(F.col("t")).alias("shown"))


@query("SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
def q_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


# ---- formulas ------------------------------------------------------------------------------------------------


def _order_formulas(spark, sf_dir) -> DataFrame:
    r = (F.col("o_orderkey") + 1).cast("string")
    f = F.concat(F.lit("SUM(D"), r, F.lit(":F"), r, F.lit(')*Rates!$B$2&"A1"+LOG10(C'), r, F.lit(")-'[b.xlsx]My S'!A1+Tax"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # keys are few bytes, scanning is much work
    return orders.select("o_orderkey", f.alias("f"))


_REFS = """
WITH o AS (SELECT o_orderkey, o_orderkey + 1 AS r FROM orders)
SELECT o_orderkey, 0::BIGINT AS ref_ord, 'range' AS kind, 'D' || r || ':F' || r AS raw, NULL AS external, 'S' AS sheet, r AS r0, 4::BIGINT AS c0, r AS r1, 6::BIGINT AS c1 FROM o
UNION ALL SELECT o_orderkey, 1, 'cell', 'Rates!$B$2', NULL, 'Rates', 2, 2, 2, 2 FROM o
UNION ALL SELECT o_orderkey, 2, 'cell', 'C' || r, NULL, 'S', r, 3, r, 3 FROM o
UNION ALL SELECT o_orderkey, 3, 'cell', '''[b.xlsx]My S''!A1', 'b.xlsx', 'My S', 1, 1, 1, 1 FROM o
UNION ALL SELECT o_orderkey, 4, 'name', 'Tax', NULL, NULL, NULL, NULL, NULL, NULL FROM o
"""


@query(_REFS)
def q_extract_refs(spark, sf_dir):
    d = _order_formulas(spark, sf_dir).select("o_orderkey", F.explode(scan_udf("f", F.lit("S"), A.GRID_ROWS)["refs"]).alias("r"))
    return d.select("o_orderkey", F.col("r.ref_ord").cast("long").alias("ref_ord"), "r.kind", "r.raw", "r.external", "r.sheet", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("r0", "c0", "r1", "c1")))


@query("SELECT o_orderkey, 'SUM(E' || (o_orderkey + 3) || ':G' || (o_orderkey + 3) || ')*Rates!$B$2&\"A1\"+LOG10(D' || (o_orderkey + 3) || ')-''[b.xlsx]My S''!B3+Tax' AS shifted FROM orders")
def q_offset_formula(spark, sf_dir):
    return _order_formulas(spark, sf_dir).select("o_orderkey", shifted_udf("f", F.lit("S"), F.lit(2), F.lit(1), A.GRID_ROWS).alias("shifted"))


@query("SELECT 'SUM(R[0]C[-3]:R[0]C[-1])*RATES!R2C2&\"A1\"+LOG10(R[0]C[-4])-''[B.XLSX]MY S''!R[' || (0 - o_orderkey) || ']C[-6]+TAX' AS form, count(*) AS n FROM orders GROUP BY 1")
def q_canonical_formula(spark, sf_dir):
    d = _order_formulas(spark, sf_dir).select(relative_udf("f", F.lit("S"), (F.col("o_orderkey") + 1).cast("int"), F.lit(7), A.GRID_ROWS).alias("form"))
    return d.groupBy("form").agg(F.count("*").alias("n"))


# ---- search and inspection ------------------------------------------------------------------------------------

_PLACES = " || ".join(["'customer!'", _letter("col"), '"row"'])


@query(f"SELECT {_PLACES} AS address, CASE WHEN type = 'string' THEN '\"' || value || '\"' ELSE value END AS value, type FROM ({CUSTOMER_CELLS}) WHERE contains(lower(value), 'building')")
def q_find_text(spark, sf_dir):
    return search.find(_workspace(spark, sf_dir, "customer"), "BUILDing", limit=None).select("address", "value", "type")


@query(f"SELECT {_PLACES} AS address, value, type FROM ({CUSTOMER_CELLS}) WHERE type = 'number' AND abs(CAST(value AS DOUBLE) - 7) < 1e-9")
def q_find_number(spark, sf_dir):
    return search.find(_workspace(spark, sf_dir, "customer"), 7, limit=None).select("address", "value", "type")


@query(f"SELECT {_PLACES} AS address, type FROM ({CUSTOMER_CELLS}) WHERE regexp_matches(value, '^[0-9]+5$|^AUTO')")
def q_find_regex(spark, sf_dir):
    return search.find(_workspace(spark, sf_dir, "customer"), "^[0-9]+5$|^AUTO", limit=None, regex=True).select("address", "type")


@query(f"SELECT {_PLACES} AS address, row_number() OVER (ORDER BY \"row\", col) AS place FROM ({CUSTOMER_CELLS}) WHERE contains(lower(value), '1') ORDER BY \"row\", col LIMIT 50")
def q_find_first(spark, sf_dir):
    """The first hits in reading order: a limit that is the feature."""
    from pyspark.sql import Window

    hits = search.find(_workspace(spark, sf_dir, "customer"), "1")
    return hits.select("address", F.row_number().over(Window.orderBy("book_ord", "sheet_idx", "ord")).cast("long").alias("place"))


@query("SELECT 'nation!B' || (n_nationkey + 2) AS address, '\"' || n_name || '\"' AS value, 'string' AS type, true AS in_region, 0::BIGINT AS dependents FROM nation UNION ALL SELECT 'nation!Z9', 'null', 'empty', false, 0")
def q_inspect_cells(spark, sf_dir):
    w = _workspace(spark, sf_dir, "dims")
    at = w.cells.where("sheet_lc = 'nation' and col = 2 and row > 1").select("book", "sheet", "sheet_lc", "row", "col")
    empty = w.cells.where("sheet_lc = 'nation' and col = 2 and row = 2").select("book", "sheet", "sheet_lc", F.lit(9).alias("row"), F.lit(26).alias("col"))
    got = search.inspect(w, at.unionByName(empty))
    return got.select("address", "value", "type", F.col("region_id").isNotNull().alias("in_region"), F.col("dependents_total").cast("long").alias("dependents"))


@query("SELECT 'lifted' AS book, 3::BIGINT AS sheets, (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM nation) * 3 + (SELECT count(*) FROM supplier) * 4 + 9 AS cells, 0::BIGINT AS formula_cells, 3::BIGINT AS regions")
def q_overview(spark, sf_dir):
    o = search.overview(_workspace(spark, sf_dir, "dims"))
    n = F.aggregate("sheets", F.lit(0), lambda a, s: a + F.size(s["regions"]))
    return o.select("book", F.size("sheets").cast("long").alias("sheets"), "cells", "formula_cells", n.cast("long").alias("regions"))


@query("SELECT * FROM (VALUES ('nation', 'nation!A1:C' || (SELECT count(*) + 1 FROM nation), NULL), ('region', 'region!A1:B' || (SELECT count(*) + 1 FROM region), NULL), ('supplier', 'supplier!A1:D' || (SELECT count(*) + 1 FROM supplier), 'vendor spend')) t(sheet, range_a1, purpose)")
def q_sheet_map(spark, sf_dir):
    m = search.sheet_map(_workspace(spark, sf_dir, "dims"))
    return m.select("sheet", F.col("regions")[0]["range_a1"].alias("range_a1"), "purpose")


# ---- regions and profiles --------------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b, (SELECT count(*) FROM supplier) AS c) "
    "SELECT 'layout!A1:C' || (a + 1) AS range_a1, 'table' AS kind, 1::BIGINT AS header_row, a AS data_rows, a * 3 + 3 AS cell_count FROM n UNION ALL "
    "SELECT 'layout!F1:G' || (b + 1), 'table', 1, b, b * 2 + 2 FROM n UNION ALL SELECT 'layout!A30:D' || (c + 30), 'table', 30, c, c * 4 + 4 FROM n"
)
def q_regions(spark, sf_dir):
    r = _workspace(spark, sf_dir, "side_by_side").regions
    return r.select("range_a1", "kind", *(F.col(c).cast("long").alias(c) for c in ("header_row", "data_rows", "cell_count")))


@query(
    "SELECT * FROM (VALUES ('region', 'table', 'r_regionkey,r_name', 0.95::DOUBLE, NULL), ('nation', 'table', 'n_nationkey,n_name,n_regionkey', 0.95, NULL), ('supplier', 'table', 's_suppkey,s_name,s_nationkey,s_acctbal', 0.95, 'vendor spend')) t(sheet, kind, headers, confidence, purpose)"
)
def q_header_kind_purpose(spark, sf_dir):
    r = _workspace(spark, sf_dir, "dims").regions
    return r.select("sheet", "kind", F.array_join("headers", ",").alias("headers"), "confidence", "purpose")


_GROUPS = "WITH g AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT p, n, sum(n + 1) OVER (ORDER BY p) + 1 AS last FROM g) "


@query(_GROUPS + "SELECT CAST(last AS BIGINT) AS \"row\", p AS label FROM s")
def q_subtotal_rows(spark, sf_dir):
    r = _workspace(spark, sf_dir, "subtotals").regions
    return r.select(F.explode("sections").alias("s")).select(F.col("s.subtotal_row").cast("long").alias("row"), F.col("s.label").alias("label"))


@query(_GROUPS + "SELECT 'group' AS kind, p AS label, CAST(last - n AS BIGINT) AS start_row, CAST(last - 1 AS BIGINT) AS end_row FROM s")
def q_sections(spark, sf_dir):
    r = _workspace(spark, sf_dir, "subtotals").regions
    return r.select(F.explode("sections").alias("s")).select("s.kind", "s.label", F.col("s.start_row").cast("long").alias("start_row"), F.col("s.end_row").cast("long").alias("end_row"))


def _only(ws: Workspace, sheet: str):
    return ws.regions.where(F.col("sheet_lc") == sheet).first()


@query("SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def q_extract_without_double_counting(spark, sf_dir):
    w = _workspace(spark, sf_dir, "subtotals")
    rows = extract.extract(w, _only(w, "sales")).rows
    return rows.groupBy(F.col("Priority").alias("priority")).agg(F.count("*").alias("n"), F.sum(F.col("Total").cast("decimal(18,2)")).cast("double").alias("total"))


_STATS = "SELECT '{t}' AS sheet, '{c}' AS header, count({c}) AS non_empty, round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {t}"
_NUMERIC = [("customer", c) for c in ("c_custkey", "c_nationkey", "c_acctbal")]


@query(" UNION ALL ".join(_STATS.format(t=t, c=c) for t, c in _NUMERIC))
def q_profile_numeric(spark, sf_dir):
    c = _workspace(spark, sf_dir, "customer").region_columns.where("stats is not null")
    return c.select("sheet", "header", "non_empty", F.round("stats.sum", 2).alias("total"), F.col("stats.min").alias("lo"), F.col("stats.max").alias("hi"))


@query(
    "WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS n, c_acctbal AS v FROM customer) SELECT 'customer!D' || arg_min(n, (v, n)) AS min_at, 'customer!D' || arg_min(n, (-v, n)) AS max_at FROM r"
)
def q_profile_argminmax(spark, sf_dir):
    c = _workspace(spark, sf_dir, "customer").region_columns.where("header = 'c_acctbal'")
    return c.select("stats.min_at", "stats.max_at")


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*) AS n FROM orders")
def q_profile_dates(spark, sf_dir):
    c = _workspace(spark, sf_dir, "orders").region_columns.where("header = 'o_orderdate'")
    return c.select(F.substring("date_range.min", 1, 10).alias("first"), F.substring("date_range.max", 1, 10).alias("last"), F.col("non_empty").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS header, least(count(DISTINCT {c}), 10000) AS \"distinct\" FROM orders" for c in COLUMNS["orders"]))
def q_profile_distinct(spark, sf_dir):
    return _workspace(spark, sf_dir, "orders").region_columns.select("header", "distinct")


def _sample_sql(c: str) -> str:
    return f"SELECT '{c}' AS header, (SELECT string_agg(v, ',' ORDER BY k) FROM (SELECT {c} AS v, min(c_custkey) AS k FROM customer GROUP BY 1 ORDER BY 2 LIMIT 3)) AS samples"


@query(" UNION ALL ".join(map(_sample_sql, ("c_name", "c_mktsegment"))))
def q_profile_samples(spark, sf_dir):
    c = _workspace(spark, sf_dir, "customer").region_columns.where("type = 'string'")
    return c.select("header", F.array_join("samples", ",").alias("samples"))


_ROLES = """
SELECT 'customer' AS sheet, h.header, CASE WHEN h.header = 'c_name' AND n <= 10000 THEN 'key' WHEN h.header = 'c_name' THEN 'text' WHEN h.header = 'c_mktsegment' THEN 'category' ELSE 'measure' END AS role
FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS header) h, (SELECT count(*) AS n FROM customer)
"""


@query(_ROLES)
def q_roles_and_key(spark, sf_dir):
    return _workspace(spark, sf_dir, "customer").region_columns.select("sheet", "header", "role")


@query("SELECT 'p_retailprice' AS header, 'R[0]C[-1]*2+R1C2' AS formula_template, '=E2*2+$B$1' AS formula_example, 'computed' AS role, count(*) AS n FROM part")
def q_formula_template(spark, sf_dir):
    c = _workspace(spark, sf_dir, "formulas").region_columns.where("formula_template is not null and sheet = 'part'")
    return c.select("header", "formula_template", "formula_example", "role", F.col("non_empty").alias("n"))


# ---- extraction -----------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal, 'supplier!A' || n || ':D' || n AS provenance FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) + 1 AS n FROM supplier)")
def q_extract_full(spark, sf_dir):
    w = _workspace(spark, sf_dir, "dims")
    return extract.extract(w, _only(w, "supplier")).rows.drop("row")


@query("SELECT o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 700")
def q_extract_page(spark, sf_dir):
    """A page of two columns: offset and limit are the feature."""
    w = _workspace(spark, sf_dir, "orders")
    return extract.extract(w, _only(w, "orders"), offset=700, limit=500, columns=["status", "totalprice"]).rows.drop("row", "provenance")


@query("SELECT t || '!A' || n || ':' || e || n AS provenance FROM (SELECT 'region' AS t, 'B' AS e, row_number() OVER () + 1 AS n FROM region UNION ALL SELECT 'nation', 'C', row_number() OVER () + 1 FROM nation UNION ALL SELECT 'supplier', 'D', row_number() OVER () + 1 FROM supplier)")
def q_provenance(spark, sf_dir):
    return extract.provenance(_workspace(spark, sf_dir, "dims")).select("provenance")


# ---- graph -----------------------------------------------------------------------------------------------------

_SUPPLIER_ROWS = "(SELECT row_number() OVER (ORDER BY s_suppkey) + 1 AS n FROM supplier)"
_NATION_ROWS = "(SELECT n_nationkey + 1 AS k FROM nation)"


@query(
    f"SELECT 'A' || n AS cell, count(*) AS readers FROM {_SUPPLIER_ROWS}, {_NATION_ROWS} WHERE n <= k + 3 GROUP BY 1 UNION ALL SELECT 'D' || n, count(*) FROM {_SUPPLIER_ROWS}, {_NATION_ROWS} WHERE n = k GROUP BY 1"
)
def q_dependents(spark, sf_dir):
    """Readers of every supplier cell, by single cells and short ranges."""
    w = _workspace(spark, sf_dir, "formulas")
    points = w.cells.where("sheet_lc = 'supplier' and row > 1").select("book", "sheet_lc", "row", "col")
    d = graph.readers(w, points)
    return d.groupBy(A.format_cell(F.col("row"), F.col("col")).alias("cell")).agg(F.count("*").alias("readers"))


@query(f"SELECT count(*) AS cells, 25 * count(*) AS pairs FROM (SELECT n, c FROM (SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS n FROM part UNION ALL SELECT 1), (SELECT unnest([1,2,3,4,5,6]) AS c) WHERE n <= 5000)")
def q_dependents_range(spark, sf_dir):
    """Readers through a range that is kept as an interval; the part sheet has texts and numbers in it."""
    w = _workspace(spark, sf_dir, "formulas")
    points = w.cells.where("sheet_lc = 'part'").select("book", "sheet_lc", "row", "col")
    d = graph.readers(w, points).where("d_sheet_lc = 'calc'")
    return d.groupBy().agg(F.countDistinct("row", "col").alias("cells"), F.count("*").alias("pairs"))


_CHAIN = """
WITH RECURSIVE t(root, node, depth) AS (
  SELECT 'calc!B' || (n_nationkey + 1), n_nationkey + 1, 0 FROM nation
  UNION ALL SELECT root, node - 1, depth + 1 FROM t WHERE depth < 3 AND node > 1
)
SELECT root, 'calc!B' || node AS address, depth::BIGINT AS depth FROM t
"""


@query(_CHAIN)
def q_trace_precedents(spark, sf_dir):
    """The chain B, B above, ... of every formula, three steps up."""
    w = _workspace(spark, sf_dir, "formulas")
    cells = w.cells.where("sheet_lc = 'calc' and col = 2").select("book", "sheet", "sheet_lc", "row", "col")
    t = graph.trace_precedents(w, cells, 3)
    return t.where("kind = 'cell' and address like 'calc!B%'").select("root", "address", F.size("pos").cast("long").alias("depth"))


_READERS = """
WITH RECURSIVE t(root, node, depth) AS (
  SELECT 'calc!B' || (n_nationkey + 1), n_nationkey + 1, 0 FROM nation
  UNION ALL SELECT root, node + 1, depth + 1 FROM t WHERE depth < 3 AND node < 25
)
SELECT root, 'calc!B' || node AS address, depth::BIGINT AS depth FROM t
"""


@query(_READERS)
def q_trace_dependents(spark, sf_dir):
    w = _workspace(spark, sf_dir, "formulas")
    cells = w.cells.where("sheet_lc = 'calc' and col = 2").select("book", "sheet", "sheet_lc", "row", "col")
    return graph.trace_dependents(w, cells, 3).select("root", "address", F.size("pos").cast("long").alias("depth"))


@query(f"SELECT 'D' || n AS cell, 'Balances' AS names FROM {_SUPPLIER_ROWS} WHERE n BETWEEN 2 AND 9 UNION ALL SELECT 'A' || n, 'Keys' FROM {_SUPPLIER_ROWS}")
def q_names_containing(spark, sf_dir):
    w = _workspace(spark, sf_dir, "formulas")
    points = w.cells.where("sheet_lc = 'supplier' and row > 1").select("book", "sheet_lc", "row", "col")
    return search.names_containing(w, points).select(A.format_cell(F.col("row"), F.col("col")).alias("cell"), F.array_join("names", ",").alias("names"))


_BOXES = "(SELECT p_partkey AS k, p_partkey * 3 AS r0, 1 + p_size AS c0, p_partkey * 3 + p_size * 2 AS r1, 3 + p_size AS c1 FROM part)"


@query(f"SELECT a.k AS a, b.k AS b FROM {_BOXES} a JOIN {_BOXES} b ON a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1 WHERE a.k < b.k")
def q_overlap_join(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.lit("b").alias("book"), F.lit("s").alias("sheet_lc"), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 3).cast("int").alias("r0"), (F.col("p_size") + 1).alias("c0"), (F.col("p_partkey") * 3 + F.col("p_size") * 2).cast("int").alias("r1"), (F.col("p_size") + 3).alias("c1"))
    side = lambda s: p.select("book", "sheet_lc", *(F.col(c).alias(f"{s}_{c}") for c in ("k", "r0", "c0", "r1", "c1")))
    return rangejoin.overlapping(side("a"), side("b")).where("a_k < b_k").select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))


@query(f"SELECT o_orderkey, k FROM (SELECT o_orderkey, o_custkey AS r, 1 + o_orderkey % 40 AS c FROM orders) JOIN {_BOXES} ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def q_contains_join(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.lit("b").alias("book"), F.lit("s").alias("sheet_lc"), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 3).cast("int").alias("r0"), (F.col("p_size") + 1).alias("c0"), (F.col("p_partkey") * 3 + F.col("p_size") * 2).cast("int").alias("r1"), (F.col("p_size") + 3).alias("c1"))
    o = _table(spark, sf_dir, "orders").select(F.lit("b").alias("book"), F.lit("s").alias("sheet_lc"), "o_orderkey", F.col("o_custkey").cast("int").alias("row"), (F.col("o_orderkey") % 40 + 1).cast("int").alias("col"))
    return rangejoin.containing(o, p).select("o_orderkey", "k")


# ---- several books ----------------------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT DISTINCT lower(n_name) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT DISTINCT lower(n_name) AS v FROM nation) "
    "SELECT 'n_name' AS a_column, 'nation' AS b_column, count(*) AS shared, floor(count(*) / (SELECT count(*) FROM n)::DOUBLE * 100 + 0.5) / 100 AS coverage_a, floor(count(*) / (SELECT count(*) FROM s)::DOUBLE * 100 + 0.5) / 100 AS coverage_b FROM s JOIN n USING (v) HAVING count(*) >= 2"
)
def q_data_links(spark, sf_dir):
    d = collection.data_links(Workspace(spark, (w := _workspace(spark, sf_dir, "two_books")).cells, w.sheets, books=["dims", "facts"]))
    return d.select("a_column", "b_column", "shared", "coverage_a", "coverage_b")


@query("SELECT 'plan' || n_regionkey || '.xlsx' AS external, count(*) AS ref_count, 'S!B' || min(n_nationkey + 1) AS first_target FROM nation GROUP BY n_regionkey")
def q_link_groups(spark, sf_dir):
    g = collection.link_groups(_workspace(spark, sf_dir, "formulas"))
    return g.select("external", "ref_count", F.col("targets")[0].alias("first_target"))


@query("SELECT 'plan' || n_regionkey || '.xlsx' AS external, count(*) AS ref_count, '[lifted]calc!C' || min(n_nationkey + 1) AS first_cell FROM nation GROUP BY n_regionkey")
def q_unresolved_externals(spark, sf_dir):
    u = collection.unresolved(_workspace(spark, sf_dir, "formulas"))
    return u.select("external", "ref_count", F.col("cells")[0].alias("first_cell"))


@query("SELECT * FROM (VALUES ('dims', 1::BIGINT, (SELECT 3 * (count(*) + 1) FROM nation), 1::BIGINT), ('facts', 1, (SELECT 3 * (count(*) + 1) FROM supplier), 1)) t(book, sheets, cells, regions)")
def q_book_stats(spark, sf_dir):
    b = collection.book_stats(_workspace(spark, sf_dir, "two_books"))
    return b.select("book", F.col("sheets").cast("long").alias("sheets"), F.col("cells").cast("long").alias("cells"), F.col("regions").cast("long").alias("regions"))


def _named_edges(ws: Workspace, edges: DataFrame) -> DataFrame:
    names = ws.regions.select("book", "region_id", "range_a1")
    for end in ("src", "dst"):
        edges = edges.join(names.select("book", F.col("region_id").alias(end), F.col("range_a1").alias(f"{end}_a1")), ["book", end])
    return edges.select(F.col("src_a1").alias("src"), F.col("dst_a1").alias("dst"), "type", "weight")


@query(
    "WITH n AS (SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b, (SELECT count(*) FROM supplier) AS c), "
    "r AS (SELECT 'layout!A1:C' || (a + 1) AS x, 1 AS r0, a + 1 AS r1, 1 AS c0, 3 AS c1 FROM n UNION ALL SELECT 'layout!F1:G' || (b + 1), 1, b + 1, 6, 7 FROM n UNION ALL SELECT 'layout!A30:D' || (c + 30), 30, c + 30, 1, 4 FROM n) "
    "SELECT p.x AS src, q.x AS dst, CASE WHEN greatest(p.r0, q.r0) - least(p.r1, q.r1) <= 3 AND greatest(p.c0, q.c0) - least(p.c1, q.c1) <= 3 THEN 'spatial' ELSE 'sheet' END AS type, "
    "CASE WHEN greatest(p.r0, q.r0) - least(p.r1, q.r1) <= 3 AND greatest(p.c0, q.c0) - least(p.c1, q.c1) <= 3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM r p, r q WHERE p.x <> q.x"
)
def q_adjacency(spark, sf_dir):
    w = _workspace(spark, sf_dir, "side_by_side")
    return _named_edges(w, region_edges.sheet_edges(w))


def _shared_layout(spark: SparkSession, sf_dir: str) -> Workspace:
    """Customers by segment on two sheets, and nations: two tables with the same headers and one without."""
    c = _table(spark, sf_dir, "customer")
    part = lambda sheet, low: lift(c.where((F.col("c_acctbal") < 0) == F.lit(low)), sheet, ["c_custkey"], columns=COLUMNS["customer"])
    return Workspace.lifted(spark, part("owing", True), part("owed", False), _lifted(spark, sf_dir, "nation"))


LAYOUTS["shared_headers"] = _shared_layout


@query(
    "WITH n AS (SELECT 'owing!A1:E' || (count(*) FILTER (c_acctbal < 0) + 1) AS a, 'owed!A1:E' || (count(*) FILTER (c_acctbal >= 0) + 1) AS b FROM customer) "
    "SELECT a AS src, b AS dst, 'semantic' AS type, 0.6::DOUBLE AS weight FROM n UNION ALL SELECT b, a, 'semantic', 0.6 FROM n"
)
def q_shared_headers(spark, sf_dir):
    w = _workspace(spark, sf_dir, "shared_headers")
    return _named_edges(w, region_edges.header_edges(w))


@query("SELECT 'calc' AS src, unnest(['supplier', 'part']) AS dst, unnest([(SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_nationkey <= (SELECT count(*) FROM supplier)), (SELECT count(*) FROM nation)]) AS n")
def q_region_formula_edges(spark, sf_dir):
    """How many references of the calc sheet's region go into each table's region."""
    w = _workspace(spark, sf_dir, "formulas")
    e = region_edges.formula_edges(w).withColumn("n", F.regexp_extract("why", r"^(\d+)", 1).cast("long"))
    names = w.regions.select("book", "region_id", "sheet")
    for end in ("src", "dst"):
        e = e.join(names.select("book", F.col("region_id").alias(end), F.col("sheet").alias(f"{end}_sheet")), ["book", end])
    return e.select(F.col("src_sheet").alias("src"), F.col("dst_sheet").alias("dst"), "n")


# ---- questions, texts ---------------------------------------------------------------------------------------------


@query(
    "WITH x AS (SELECT (SELECT string_agg(lower(r_name), ' ' ORDER BY r_regionkey) FROM region WHERE r_regionkey < 3) AS a, (SELECT string_agg(lower(n_name), ' ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3) AS b, (SELECT string_agg(lower(s_name), ' ') FROM (SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 3)) AS c), "
    "r AS (SELECT 'region' AS sheet, '' AS purpose, 'r_regionkey r_name' AS headers, a AS extras FROM x UNION ALL SELECT 'nation', '', 'n_nationkey n_name n_regionkey', b FROM x UNION ALL SELECT 'supplier', 'vendor spend', 's_suppkey s_name s_nationkey s_acctbal', c FROM x), "
    "g(k, of_list, words) AS (VALUES (0, true, ['outflow', 'outflows', 'spend', 'spending', 'cost', 'costs', 'expense', 'expenses', 'cash out']), (1, true, ['vendor', 'vendors', 'supplier', 'suppliers']), (2, false, ['nation'])), "
    "f AS (SELECT sheet, CASE WHEN of_list THEN 3 ELSE 2 END AS hi, CASE WHEN of_list THEN 2 ELSE 1 END AS lo, len(list_filter(words, lambda w: contains(r.sheet, w))) > 0 AS a, len(list_filter(words, lambda w: contains(r.purpose, w))) > 0 AS b, len(list_filter(words, lambda w: contains(r.headers, w))) > 0 AS c, len(list_filter(words, lambda w: contains(r.extras, w))) > 0 AS d FROM r, g), "
    "s AS (SELECT sheet, sum(CASE WHEN a THEN hi ELSE 0 END + CASE WHEN b THEN hi ELSE 0 END + CASE WHEN c THEN lo ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END) AS score FROM f GROUP BY sheet) "
    "SELECT CAST(row_number() OVER (ORDER BY score DESC, sheet) AS BIGINT) AS rank, sheet, CAST(score AS BIGINT) AS score FROM s WHERE score >= 3"
)
def q_locate(spark, sf_dir):
    hits = locate.locate(_workspace(spark, sf_dir, "dims").regions, ["how much do we spend by supplier and nation?"])
    return hits.select(F.col("rank").cast("long").alias("rank"), "sheet", F.col("score").cast("long").alias("score"))


@query(
    "SELECT 'region' AS sheet, 'Table region!A1:B' || (count(*) + 1) || ' · ' || count(*) || ' data rows × 2 columns (r_regionkey, r_name) · key column: r_name · r_regionkey: sum 10, range 0–4' AS text FROM region"
)
def q_summary_text(spark, sf_dir):
    w = _workspace(spark, sf_dir, "dims")
    s = summarise.summaries(w, "summary")
    return s.join(w.regions.select("book", "region_id", "sheet"), ["book", "region_id"]).where("sheet = 'region'").select("sheet", "text")


@query()
def q_summaries_in_budget(spark, sf_dir):
    """Evidence of every region in 120 tokens; no SQL for the budget's ladder, tests check it."""
    return summarise.summaries(_workspace(spark, sf_dir, "dims"), "evidence", 120).select("region_id", "text", "tokens", "truncated")


@query()
def q_context_packet(spark, sf_dir):
    """The regions of a context packet; a search that SQL cannot express, tests check it."""
    from ..operators import diffuse

    p = diffuse.expand(_workspace(spark, sf_dir, "formulas"), "calc!B3")
    rows = [(k, r["to"], r["type"], float(r["weight"]), r["why"]) for k, r in enumerate(p["relations"])]
    return spark.createDataFrame(rows, "place int, region_id string, type string, weight double, why string")


# ---- cash flow ------------------------------------------------------------------------------------------------------

#: DuckDB: the registers.
_REGISTERS = """
WITH payments AS (SELECT o_orderkey AS invoiceId, o_custkey AS customerId, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 7 <> 0),
credits AS (SELECT o_orderkey AS invoiceId, o_custkey AS customerId, strftime(o_orderdate, '%Y-%m') AS month, CAST(floor(o_totalprice) AS DECIMAL(18,2)) / 10 AS amount FROM orders WHERE o_orderkey % 11 = 0),
invoices AS (SELECT o_orderkey AS id, o_orderpriority AS category, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
vendors AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'SHARED' ELSE r_name END AS dept, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE n_name END AS costCenter FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
spend AS (SELECT l_suppkey AS vendorId, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem),
payroll AS (SELECT r_name AS dept, '1995-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') AS month, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
capex AS (SELECT 1 + p_partkey % (SELECT count(*) FROM supplier) AS vendorId, r_name AS dept, n_name AS costCenter, '1996-' || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') AS month, CAST(p_retailprice AS DECIMAL(18,2)) AS amount FROM part JOIN nation ON p_size % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey),
shared AS (SELECT month, floor(sum(amount)::DOUBLE * 100 + 0.5) / 100 AS shared FROM spend JOIN vendors ON vendorId = id WHERE dept = 'SHARED' GROUP BY month)
"""


def _r2(x: str) -> str:
    return f"floor(({x})::DOUBLE * 100 + 0.5) / 100"


def _registers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables as a company's books: orders are billed and mostly paid, line items are vendors' bills."""
    t = {n: _table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "supplier", "nation", "region", "part")}
    month = lambda c: F.date_format(c, "yyyy-MM")
    money = lambda c: c.cast("decimal(18,2)").alias("amount")
    o = t["orders"].select(F.col("o_orderkey").alias("invoiceId"), F.col("o_custkey").alias("customerId"), month("o_orderdate").alias("month"), "o_totalprice", "o_orderpriority")
    places = t["nation"].join(t["region"], t["nation"]["n_regionkey"] == t["region"]["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    shared = F.col("s_suppkey") % 4 == 0
    n = t["supplier"].count()
    two = lambda c: F.lpad((c + 1).cast("string"), 2, "0")
    out = {
        "payments": o.where("invoiceId % 7 <> 0").select("invoiceId", "customerId", "month", money(F.col("o_totalprice"))),
        "credits": o.where("invoiceId % 11 = 0").select("invoiceId", "customerId", "month", (F.floor("o_totalprice").cast("decimal(18,2)") / 10).cast("decimal(18,2)").alias("amount")),
        "invoices": o.select(F.col("invoiceId").alias("id"), F.col("o_orderpriority").alias("category"), money(F.col("o_totalprice"))),
        "customers": t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "billingCategories": t["orders"].select(F.col("o_orderpriority").alias("name")).distinct(),
        "vendors": t["supplier"].join(places, t["supplier"]["s_nationkey"] == places["n_nationkey"]).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(shared, "SHARED").otherwise(F.col("r_name")).alias("dept"), F.when(~shared, F.col("n_name")).alias("costCenter"), F.lit("all").alias("category")),
        "vendorSpend": t["lineitem"].select(F.col("l_suppkey").alias("vendorId"), month("l_shipdate").alias("month"), money(F.col("l_extendedprice"))),
        "payroll": t["customer"].join(places, t["customer"]["c_nationkey"] == places["n_nationkey"]).select(F.col("r_name").alias("dept"), F.concat(F.lit("1995-"), two(F.col("c_custkey") % 12)).alias("month"), money(F.abs("c_acctbal"))),
        "departments": t["region"].select(F.col("r_name").alias("code"), F.col("r_name").alias("name")),
        "costCenters": places.select(F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("dept"), F.lit(0.2).alias("payrollShare")),
        "allocShares": t["region"].select(F.col("r_name").alias("dept"), F.lit(0.2).alias("share")),
    }
    bought = t["part"].join(places, F.pmod(t["part"]["p_size"], F.lit(25)) == places["n_nationkey"])
    out["capex"] = bought.select((F.col("p_partkey") % n + 1).alias("vendorId"), F.col("r_name").alias("dept"), F.col("n_name").alias("costCenter"), F.concat(F.lit("1996-"), two(F.col("p_size") % 12)).alias("month"), money(F.col("p_retailprice")))
    return out


_INFLOW = "SELECT month, customerId, invoiceId, amount FROM payments UNION ALL SELECT month, customerId, invoiceId, -amount FROM credits"
_OUTFLOW = "SELECT month, amount FROM payroll UNION ALL SELECT month, amount FROM spend UNION ALL SELECT month, amount FROM capex"


@query(f"{_REGISTERS} SELECT month, {_r2('sum(amount)')} AS inflow FROM ({_INFLOW}) GROUP BY month")
def q_inflows_by_month(spark, sf_dir):
    return cashflow.inflows_by_month(_registers(spark, sf_dir))


@query(f"{_REGISTERS} SELECT month, {_r2('sum(amount)')} AS outflow FROM ({_OUTFLOW}) GROUP BY month")
def q_outflows_by_month(spark, sf_dir):
    return cashflow.outflows_by_month(_registers(spark, sf_dir))


@query(
    f"{_REGISTERS}, i AS (SELECT month, {_r2('sum(amount)')} AS inflow FROM ({_INFLOW}) GROUP BY month), o AS (SELECT month, {_r2('sum(amount)')} AS outflow FROM ({_OUTFLOW}) GROUP BY month) "
    f"SELECT coalesce(i.month, o.month) AS month, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, {_r2('coalesce(inflow, 0) - coalesce(outflow, 0)')} AS net FROM i FULL JOIN o ON i.month = o.month"
)
def q_net_by_month(spark, sf_dir):
    return cashflow.net_by_month(_registers(spark, sf_dir))


@query(f"{_REGISTERS} SELECT c_name AS name, {_r2('coalesce(sum(amount), 0)')} AS inflow FROM customer LEFT JOIN ({_INFLOW}) ON c_custkey = customerId GROUP BY c_custkey, c_name")
def q_inflows_by_customer(spark, sf_dir):
    return cashflow.inflows_by_customer(_registers(spark, sf_dir))


@query(f"{_REGISTERS} SELECT category, {_r2('sum(p.amount)')} AS inflow FROM ({_INFLOW}) p JOIN invoices ON id = invoiceId GROUP BY category")
def q_inflows_by_category(spark, sf_dir):
    return cashflow.inflows_by_category(_registers(spark, sf_dir))


_DEPT = f"""{_REGISTERS}, parts AS (
SELECT dept, sum(amount)::DOUBLE AS a FROM payroll GROUP BY dept UNION ALL SELECT dept, sum(amount)::DOUBLE FROM spend JOIN vendors ON vendorId = id GROUP BY dept
UNION ALL SELECT r_name, sum(CAST({_r2('shared * 0.2::DOUBLE')} AS DECIMAL(18,2)))::DOUBLE FROM shared, region GROUP BY r_name UNION ALL SELECT dept, sum(amount)::DOUBLE FROM capex GROUP BY dept)
SELECT r_name AS name, {_r2('coalesce(sum(a), 0)')} AS outflow FROM region LEFT JOIN parts ON dept = r_name GROUP BY r_name"""


@query(_DEPT)
def q_outflows_by_department(spark, sf_dir):
    return cashflow.outflows_by_department(_registers(spark, sf_dir))


_CENTER = f"""{_REGISTERS}, pay AS (SELECT dept, month, sum(amount)::DOUBLE AS p FROM payroll GROUP BY dept, month), place AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), parts AS (
SELECT n_name AS code, sum({_r2('p * 0.2::DOUBLE')}) AS a FROM pay JOIN place ON dept = r_name GROUP BY n_name
UNION ALL SELECT n_name, sum({_r2('shared * 0.2::DOUBLE * 0.2::DOUBLE')}) FROM shared, place GROUP BY n_name
UNION ALL SELECT costCenter, sum(amount)::DOUBLE FROM spend JOIN vendors ON vendorId = id WHERE costCenter IS NOT NULL GROUP BY costCenter
UNION ALL SELECT costCenter, sum(amount)::DOUBLE FROM capex GROUP BY costCenter)
SELECT n_name AS code, {_r2('coalesce(sum(a), 0)')} AS outflow FROM nation LEFT JOIN parts ON code = n_name GROUP BY n_name"""


@query(_CENTER)
def q_outflows_by_cost_center(spark, sf_dir):
    return cashflow.outflows_by_cost_center(_registers(spark, sf_dir))


@query(f"{_REGISTERS}, paid AS (SELECT vendorId, amount FROM spend UNION ALL SELECT vendorId, amount FROM capex) SELECT s_name AS name, {_r2('coalesce(sum(amount), 0)')} AS outflow FROM supplier LEFT JOIN paid ON s_suppkey = vendorId GROUP BY s_suppkey, s_name")
def q_outflows_by_vendor(spark, sf_dir):
    return cashflow.outflows_by_vendor(_registers(spark, sf_dir))


@query(
    f"{_REGISTERS}, m AS (SELECT DISTINCT month FROM (SELECT month FROM payments UNION ALL SELECT month FROM credits UNION ALL {_OUTFLOW.replace(', amount', '')})), "
    "v AS (SELECT id, name, m.month, coalesce(sum(amount), 0)::DOUBLE AS amount FROM vendors CROSS JOIN m LEFT JOIN spend ON vendorId = id AND spend.month = m.month GROUP BY id, name, m.month), "
    "w AS (SELECT id, list_sort(list(amount))[count(*) // 2 + 1] AS median FROM v GROUP BY id) SELECT name, month, amount, median FROM v JOIN w USING (id) WHERE median > 0 AND amount > 1.8 * median"
)
def q_vendor_spikes(spark, sf_dir):
    t = _registers(spark, sf_dir)
    s = cashflow.vendor_spikes(t)
    return s.select("name", "month", F.col("amount").cast("double").alias("amount"), F.col("median").cast("double").alias("median"))


def _of(name: str) -> str:
    """Another query's SQL as a table."""
    return f"({ORACLE_SQL[name]})"


@query(
    f"SELECT 'NEGATIVE_NET:' || month AS flag FROM {_of('q_net_by_month')} WHERE net < 0 "
    f"UNION ALL SELECT 'CUSTOMER_CONCENTRATION:' || name FROM {_of('q_inflows_by_customer')} WHERE inflow > 0.3 * (SELECT sum(inflow) FROM {_of('q_inflows_by_month')}) "
    f"UNION ALL SELECT 'VENDOR_SPIKE:' || name || ':' || month FROM {_of('q_vendor_spikes')} "
    f"UNION ALL SELECT 'OPEN_AR_HIGH' FROM (SELECT (SELECT sum(o_totalprice) FROM orders) AS b, (SELECT sum(o_totalprice) FROM orders WHERE o_orderkey % 7 <> 0) AS p) WHERE b - p > 0.1 * b"
)
def q_risk_flags(spark, sf_dir):
    return cashflow.risk_flags(_registers(spark, sf_dir)).select("flag")


def _check(name: str, a: str, b: str) -> str:
    return f"SELECT '{name}' AS name, abs(a - b) <= greatest(0.05, 0.002 * abs(a)) AS ok FROM (SELECT ({a}) AS a, ({b}) AS b)"


def _sum(column: str, name: str) -> str:
    return f"SELECT sum({column}) FROM {_of(name)}"


@query(
    " UNION ALL ".join(
        [
            _check("Total inflows equals sum of customer inflows", _sum("inflow", "q_inflows_by_month"), _sum("inflow", "q_inflows_by_customer")),
            _check("Total inflows equals sum of category inflows", _sum("inflow", "q_inflows_by_month"), _sum("inflow", "q_inflows_by_category")),
            _check("Total outflows equals sum of department outflows", _sum("outflow", "q_outflows_by_month"), _sum("outflow", "q_outflows_by_department")),
            _check("Total outflows equals sum of cost-center outflows", _sum("outflow", "q_outflows_by_month"), _sum("outflow", "q_outflows_by_cost_center")),
            _check("Total outflows equals payroll plus vendor outflows", _sum("outflow", "q_outflows_by_month"), f"({_sum('outflow', 'q_outflows_by_vendor')}) + (SELECT sum(abs(c_acctbal)) FROM customer)"),
        ]
    )
)
def q_reconciliation(spark, sf_dir):
    return cashflow.reconciliation(_registers(spark, sf_dir)).select("name", "ok")


_EVENT_MONTHS = ["01", "02", "03", "04", "05", "06"]


@query("SELECT event_type, " + ", ".join(f"coalesce(floor(sum(CASE WHEN strftime(ts, '%m') = '{m}' THEN CAST(value AS DECIMAL(18,4)) END)::DOUBLE * 100 + 0.5) / 100, 0) AS m{m}" for m in _EVENT_MONTHS) + " FROM events GROUP BY event_type")
def q_pivot_matrix(spark, sf_dir):
    """Event types by month as a matrix."""
    e = _table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "MM").alias("m"), F.col("value").cast("decimal(18,4)").alias("v"))
    p = e.groupBy("event_type").pivot("m", _EVENT_MONTHS).agg(X.half_up(F.sum("v").cast("double"), 2))
    return p.select("event_type", *(F.coalesce(F.col(m), F.lit(0.0)).alias(f"m{m}") for m in _EVENT_MONTHS))


@query("SELECT sheet, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'part' AS sheet FROM part UNION ALL SELECT 'calc' FROM nation UNION ALL SELECT 'calc' FROM nation UNION ALL SELECT 'calc' FROM nation) GROUP BY sheet")
def q_formula_cells(spark, sf_dir):
    return _workspace(spark, sf_dir, "formulas").cells.where("formula is not null").groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT 1::BIGINT AS w_ord, 'Workbook references ' || count(DISTINCT n_regionkey) || ' external workbook(s): ' || string_agg(DISTINCT 'plan' || n_regionkey || '.xlsx', ', ' ORDER BY 'plan' || n_regionkey || '.xlsx') || ' — external values are not loaded' AS message FROM nation")
def q_warnings(spark, sf_dir):
    w = _workspace(spark, sf_dir, "formulas").warnings
    sorted_books = F.regexp_extract("message", r"^(.*workbook\(s\): )", 1)
    names = F.array_join(F.array_sort(F.split(F.regexp_extract("message", r"workbook\(s\): (.*) — ", 1), ", ")), ", ")
    return w.select(F.col("w_ord").cast("long").alias("w_ord"), F.concat(sorted_books, names, F.lit(" — external values are not loaded")).alias("message"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sheet with subtotal rows: sections found, rows extracted without them, totals by priority."""
    return q_extract_without_double_counting(spark, sf_dir)
