"""Cash in and out of a company's registers: totals by month and by any dimension, shared costs, risks, checks.

Registers are DataFrames by name (see ``TABLES``). Amounts are rounded half up to cents where the books round them,
which for allocated amounts is before they are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up

TABLES = {
    "customers": "id string, name string",
    "billingCategories": "name string",
    "invoices": "id string, customerId string, issueMonth string, dueMonth string, category string, amount double, status string",
    "payments": "id string, invoiceId string, customerId string, month string, amount double",
    "credits": "id string, customerId string, invoiceId string, month string, amount double",
    "departments": "code string, name string",
    "costCenters": "code string, name string, dept string, payrollShare double",
    "vendors": "id string, name string, dept string, costCenter string, category string",
    "vendorSpend": "vendorId string, month string, amount double",
    "payroll": "dept string, month string, amount double",
    "capex": "id string, vendorId string, dept string, costCenter string, month string, amount double",
    "allocShares": "dept string, share double",
}
SHARED = "SHARED"
#: A customer's share of inflows, a month's multiple of a vendor's median, and open receivables that are flagged.
CONCENTRATION, SPIKE, OPEN_AR = 0.3, 1.8, 0.1


def cents(x: Column) -> Column:
    return half_up(x, 2)


def _signed(t: dict[str, DataFrame], *columns: str) -> DataFrame:
    """Payments, and credits below zero."""
    paid = t["payments"].select(*columns, F.col("amount").alias("a"))
    return paid.unionByName(t["credits"].select(*columns, (-F.col("amount")).alias("a")))


def _sum(df: DataFrame, key: str, name: str = "amount") -> DataFrame:
    return df.groupBy(key).agg(cents(F.sum("a")).alias(name))


def inflows_by_month(t: dict[str, DataFrame]) -> DataFrame:
    return _sum(_signed(t, "month"), "month", "inflow")


def outflows_by_month(t: dict[str, DataFrame]) -> DataFrame:
    parts = [t[n].select("month", F.col("amount").alias("a")) for n in ("payroll", "vendorSpend", "capex")]
    return _sum(parts[0].unionByName(parts[1]).unionByName(parts[2]), "month", "outflow")


def net_by_month(t: dict[str, DataFrame]) -> DataFrame:
    both = inflows_by_month(t).join(outflows_by_month(t), "month", "full").fillna(0.0)
    return both.withColumn("net", cents(F.col("inflow") - F.col("outflow")))


def inflows_by_customer(t: dict[str, DataFrame]) -> DataFrame:
    """Every customer, also one without payments."""
    own = _signed(t, "customerId").groupBy(F.col("customerId").alias("id")).agg(F.sum("a").alias("a"))
    return t["customers"].join(own, "id", "left").select("name", cents(F.coalesce("a", F.lit(0.0))).alias("inflow"))


def inflows_by_category(t: dict[str, DataFrame]) -> DataFrame:
    of = t["invoices"].select(F.col("id").alias("invoiceId"), "category")
    own = _signed(t, "invoiceId").join(of, "invoiceId").groupBy("category").agg(F.sum("a").alias("a"))
    return t["billingCategories"].withColumnRenamed("name", "category").join(own, "category", "left").select("category", cents(F.coalesce("a", F.lit(0.0))).alias("inflow"))


def months(t: dict[str, DataFrame]) -> DataFrame:
    parts = [t[n].select("month") for n in ("payments", "credits", "payroll", "vendorSpend", "capex")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _spend(t: dict[str, DataFrame]) -> DataFrame:
    return t["vendorSpend"].join(t["vendors"].withColumnRenamed("id", "vendorId").select("vendorId", "dept", "costCenter", F.col("name").alias("vendor")), "vendorId")


def shared_by_month(t: dict[str, DataFrame]) -> DataFrame:
    """Costs of vendors that serve all departments, rounded by month."""
    return _spend(t).where(F.col("dept") == SHARED).groupBy("month").agg(cents(F.sum("amount")).alias("shared"))


def shared_allocation(t: dict[str, DataFrame]) -> DataFrame:
    """(month, dept, amount): each department's share of a month's shared costs, rounded."""
    return _by_share(shared_by_month(t), t).withColumnRenamed("a", "amount")


def _by_share(shared: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Months meet departments on a constant: a department list is a dimension of a few rows, months another."""
    shares = t["allocShares"].groupBy().agg(F.collect_list(F.struct("dept", "share")).alias("all"))
    return shared.join(shares, F.lit(True)).select("month", F.explode("all").alias("s"), "shared").select("month", "s.dept", cents(F.col("shared") * F.col("s.share")).alias("a"))


def outflows_by_department(t: dict[str, DataFrame]) -> DataFrame:
    a = F.col("amount").alias("a")
    parts = [t["payroll"].select("dept", a), _spend(t).select("dept", a), _by_share(shared_by_month(t), t).select("dept", "a"), t["capex"].select("dept", a)]
    own = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("dept").agg(F.sum("a").alias("a"))
    return t["departments"].withColumnRenamed("code", "dept").join(own, "dept", "left").select("name", cents(F.coalesce("a", F.lit(0.0))).alias("outflow"))


def outflows_by_cost_center(t: dict[str, DataFrame]) -> DataFrame:
    """Payroll and shared costs by the center's share of its department, each month rounded; its vendors' and its own purchases."""
    a = F.col("amount").alias("a")
    centers = t["costCenters"].select("code", "dept", "payrollShare")
    shares = t["allocShares"]
    pay = t["payroll"].groupBy("dept", "month").agg(F.sum("amount").alias("p")).join(centers, "dept").select("code", cents(F.col("p") * F.col("payrollShare")).alias("a"))
    every = centers.join(shares, "dept").groupBy().agg(F.collect_list(F.struct("code", (F.col("share")).alias("share"), "payrollShare")).alias("all"))
    common = shared_by_month(t).join(every, F.lit(True)).select("shared", F.explode("all").alias("s")).select("s.code", cents(F.col("shared") * F.col("s.share") * F.col("s.payrollShare")).alias("a"))
    direct = _spend(t).where("costCenter is not null").select(F.col("costCenter").alias("code"), a)
    bought = t["capex"].select(F.col("costCenter").alias("code"), a)
    own = pay.unionByName(common).unionByName(direct).unionByName(bought).groupBy("code").agg(F.sum("a").alias("a"))
    return centers.join(own, "code", "left").select("code", cents(F.coalesce("a", F.lit(0.0))).alias("outflow"))


def outflows_by_vendor(t: dict[str, DataFrame]) -> DataFrame:
    a = F.col("amount").alias("a")
    own = t["vendorSpend"].select("vendorId", a).unionByName(t["capex"].select("vendorId", a)).groupBy(F.col("vendorId").alias("id")).agg(F.sum("a").alias("a"))
    return t["vendors"].join(own, "id", "left").select("name", cents(F.coalesce("a", F.lit(0.0))).alias("outflow"))


def vendor_spikes(t: dict[str, DataFrame], factor: float = SPIKE) -> DataFrame:
    """(name, month, amount, median): months above ``factor`` times the vendor's upper median over all months, months without spend as 0."""
    month_list = months(t).groupBy().agg(F.collect_list("month").alias("all"))
    grid = t["vendors"].select("id", "name").join(month_list, F.lit(True)).select("id", "name", F.explode("all").alias("month"))
    spent = t["vendorSpend"].groupBy(F.col("vendorId").alias("id"), "month").agg(F.sum("amount").alias("amount"))
    rows = grid.join(spent, ["id", "month"], "left").fillna(0.0, ["amount"])
    whole = Window.partitionBy("id")
    ordered = F.array_sort(F.collect_list("amount").over(whole))  # one entry a month
    rows = rows.withColumn("median", F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")))
    return rows.where((F.col("median") > 0) & (F.col("amount") > factor * F.col("median"))).select("name", "month", "amount", "median")


def risk_flags(t: dict[str, DataFrame]) -> DataFrame:
    """(flag): months with a negative net, customers above their share, vendors' spikes, receivables open."""
    negative = net_by_month(t).where("net < 0").select(F.concat(F.lit("NEGATIVE_NET:"), "month").alias("flag"))
    total = inflows_by_month(t).agg(cents(F.sum("inflow")).alias("total"))
    large = inflows_by_customer(t).join(total, F.lit(True)).where(F.col("inflow") / F.col("total") > CONCENTRATION).select(F.concat(F.lit("CUSTOMER_CONCENTRATION:"), "name").alias("flag"))
    spikes = vendor_spikes(t).select(F.concat(F.lit("VENDOR_SPIKE:"), "name", F.lit(":"), "month").alias("flag"))
    billed, paid = t["invoices"].agg(cents(F.sum("amount")).alias("b")), t["payments"].agg(cents(F.sum("amount")).alias("p"))
    receivable = billed.join(paid, F.lit(True)).where(F.col("b") - F.col("p") > OPEN_AR * F.col("b")).select(F.lit("OPEN_AR_HIGH").alias("flag"))
    return negative.union(large).union(spikes).union(receivable)


def reconciliation(t: dict[str, DataFrame], tolerance: float = 0.05) -> DataFrame:
    """(name, a, b, ok): totals that must agree."""
    total = lambda df, c: df.agg(cents(F.sum(c)).alias("x"))
    into, out = total(inflows_by_month(t), "inflow"), total(outflows_by_month(t), "outflow")
    vendors = outflows_by_vendor(t).select(F.col("outflow").alias("x")).union(t["payroll"].select("amount"))
    pairs = [
        ("Total inflows equals sum of customer inflows", into, total(inflows_by_customer(t), "inflow")),
        ("Total inflows equals sum of category inflows", into, total(inflows_by_category(t), "inflow")),
        ("Total outflows equals sum of department outflows", out, total(outflows_by_department(t), "outflow")),
        ("Total outflows equals sum of cost-center outflows", out, total(outflows_by_cost_center(t), "outflow")),
        ("Total outflows equals payroll plus vendor outflows", out, total(vendors, "x")),
    ]
    rows = None
    for name, a, b in pairs:
        row = a.withColumnRenamed("x", "a").join(b.withColumnRenamed("x", "b"), F.lit(True)).select(F.lit(name).alias("name"), "a", "b", agrees(F.col("a"), F.col("b"), tolerance).alias("ok"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def agrees(a: Column, b: Column, tolerance: float = 0.05, share: float = 0.002) -> Column:
    """Within a few cents, or a share of the size."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), share * F.abs(a))


def score(gold: DataFrame, answer: DataFrame, key: str, value: str) -> DataFrame:
    """(rows, matched, extra): how many keys of ``gold`` the answer has with a value that agrees, and how many it has besides."""
    g, a = gold.select(F.col(key), F.col(value).alias("g")), answer.select(F.col(key), F.col(value).alias("x"))
    both = g.join(a, key, "full")
    return both.agg(F.count("g").alias("rows"), F.count_if(agrees(F.col("g"), F.col("x"))).alias("matched"), F.count_if(F.col("g").isNull()).alias("extra"))


def aging(t: dict[str, DataFrame], as_of: str) -> DataFrame:
    """(customerId, bucket, amount): open invoice amounts by months since they were due."""
    paid = t["payments"].groupBy(F.col("invoiceId").alias("id")).agg(F.sum("amount").alias("p"))
    open_ = t["invoices"].join(paid, "id", "left").withColumn("open", cents(F.col("amount") - F.coalesce("p", F.lit(0.0)))).where("open > 0")
    late = F.months_between(F.to_date(F.lit(f"{as_of}-01")), F.to_date(F.concat("dueMonth", F.lit("-01")))).cast("int")
    bucket = F.when(late <= 0, "current").when(late == 1, "1 month").when(late == 2, "2 months").otherwise("3+ months")
    return open_.withColumn("bucket", bucket).groupBy("customerId", "bucket").agg(cents(F.sum("open")).alias("amount"))


def department_matrix(t: dict[str, DataFrame], month_list: list[str]) -> DataFrame:
    """Departments by months: payroll, own vendors and purchases."""
    a = F.col("amount").alias("a")
    rows = t["payroll"].select("dept", "month", a).unionByName(_spend(t).where(F.col("dept") != SHARED).select("dept", "month", a)).unionByName(t["capex"].select("dept", "month", a))
    return rows.groupBy("dept").pivot("month", month_list).agg(cents(F.sum("a"))).fillna(0.0)


def spend_matrix(t: dict[str, DataFrame], month_list: list[str]) -> DataFrame:
    """Vendor categories by months."""
    rows = t["vendorSpend"].join(t["vendors"].select(F.col("id").alias("vendorId"), "category"), "vendorId")
    return rows.groupBy("category").pivot("month", month_list).agg(cents(F.sum("amount"))).fillna(0.0)


#: Where each figure comes from: sheets of the two books.
PROVENANCE = {
    "inflows_by_month": ["Payments", "Adjustments & Credits"],
    "inflows_by_customer": ["Payments", "Adjustments & Credits"],
    "inflows_by_category": ["Invoices", "Payments"],
    "outflows_by_month": ["Payroll", "Vendor Spend", "Capex"],
    "outflows_by_department": ["Department Spend", "AllocMap"],
    "outflows_by_cost_center": ["Cost Center Detail"],
    "outflows_by_vendor": ["Vendor Spend", "Capex"],
}


def provenance(ws) -> DataFrame:
    """(metric, source): the ranges of the regions that figures come from, with their books."""
    rows = [(m, k, s) for m, sheets in PROVENANCE.items() for k, s in enumerate(sheets)]
    wanted = ws.spark.createDataFrame(rows, "metric string, k int, sheet string").withColumn("sheet_lc", F.lower("sheet")).drop("sheet")
    found = ws.regions.where("kind in ('table', 'matrix')").select("book", "sheet_lc", "range_a1", "cell_count")
    best = F.row_number().over(Window.partitionBy("metric", "k").orderBy(F.desc("cell_count")))
    return wanted.join(found, "sheet_lc").withColumn("n", best).where("n = 1").select("metric", F.concat(F.lit("["), "book", F.lit("]"), "range_a1").alias("source"))


def solve(ws, questions: dict[str, tuple[str, dict[str, list[str]]]]) -> dict[str, DataFrame]:
    """Registers found by question: each is located, its region extracted, and its columns renamed by their headers.

    ``questions``: register -> (question, {column: words of its header}); an exact header beats one that holds the word.
    """
    from . import extract, locate

    asked = {q: name for name, (q, _) in questions.items()}
    hits = locate.locate(ws.regions, list(asked), top=12, min_score=1).orderBy("question", "rank").collect()
    out = {}
    for q, name in asked.items():
        for h in (h for h in hits if h.question == q):
            region = ws.regions.where((F.col("region_id") == h.region_id) & (F.col("book") == h.book)).first()
            columns = _matched(extract.column_names(region["columns"]), questions[name][1])
            if columns is not None:
                rows = extract.extract(ws, region).rows
                out[name] = rows.select(*(F.col(f"`{src}`").alias(c) for c, src in columns.items()))
                break
        else:
            raise ValueError(f'no region answers "{q}" with columns {list(questions[name][1])}')
    return out


def _matched(headers: list[str], wanted: dict[str, list[str]]) -> dict[str, str] | None:
    out = {}
    for column, words in wanted.items():
        exact = next((h for w in words for h in headers if h.lower() == w.lower()), None)
        found = exact or next((h for w in words for h in headers if w.lower() in h.lower()), None)
        if found is None:
            return None
        out[column] = found
    return out
