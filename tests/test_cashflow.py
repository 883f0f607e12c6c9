import math
import random

import pytest
from pyspark.sql import functions as F

from gridengine.operators import cashflow as cf
from gridengine.plans.workspace import Workspace
from gridengine.sources.lift import lift

MONTHS = [f"2026-0{k}" for k in range(1, 7)]


def r2(x):
    return math.floor(x * 100 + 0.5) / 100


def dataset(seed):
    r = random.Random(seed)
    amount = lambda lo, hi: r2(r.uniform(lo, hi))
    d = {
        "customers": [(f"C{k}", f"Customer {k}") for k in range(8)],
        "billingCategories": [(c,) for c in ("Software", "Services", "Support", "Training", "Other")],
        "departments": [("ENG", "Engineering"), ("SAL", "Sales"), ("OPS", "Operations")],
        "costCenters": [("E1", "Platform", "ENG", 0.6), ("E2", "Apps", "ENG", 0.4), ("S1", "Field", "SAL", 1.0), ("O1", "Plant", "OPS", 0.7), ("O2", "Office", "OPS", 0.3)],
        "allocShares": [("ENG", 0.5), ("SAL", 0.3), ("OPS", 0.2)],
    }
    cc = {"ENG": ["E1", "E2"], "SAL": ["S1"], "OPS": ["O1", "O2"]}
    d["vendors"] = [(f"V{k}", f"Vendor {k}", dept, r.choice(cc[dept]) if dept in cc else None, r.choice(["Cloud", "Tools"])) for k, dept in enumerate(["ENG", "SAL", "OPS", "SHARED", "SHARED", "ENG"])]
    d["invoices"], d["payments"] = [], []
    for k in range(60):
        c, m, a = f"C{r.randint(0, 6)}", r.randrange(6), amount(500, 20000)
        d["invoices"].append((f"I{k}", c, MONTHS[m], MONTHS[min(5, m + 1)], r.choice(["Software", "Services", "Support", "Training"]), a, "Open"))
        if r.random() < 0.8:
            d["payments"].append((f"P{k}", f"I{k}", c, MONTHS[min(5, m + r.randint(0, 2))], r2(a * r.choice([1, 0.5]))))
    d["credits"] = [(f"K{k}", i[1], i[0], r.choice(MONTHS), amount(10, 300)) for k, i in enumerate(r.sample(d["invoices"], 6))]
    d["vendorSpend"] = [(v[0], m, amount(100, 900) * (3 if r.random() < 0.1 else 1)) for v in d["vendors"] for m in MONTHS if r.random() < 0.95]
    d["payroll"] = [(dept, m, amount(9000, 30000)) for dept, _ in d["departments"] for m in MONTHS]
    d["capex"] = [(f"X{k}", r.choice(d["vendors"])[0], dept, r.choice(cc[dept]), r.choice(MONTHS), amount(1000, 9000)) for k, dept in enumerate(["ENG", "OPS", "SAL"])]
    return d


def gold(d):
    by = lambda rows, k, v: lambda x: sum(r[v] for r in rows if r[k] == x)
    pay, cred = d["payments"], d["credits"]
    vend = {v[0]: v for v in d["vendors"]}
    inv = {i[0]: i for i in d["invoices"]}
    g = {"in_month": {m: r2(by(pay, 3, 4)(m) - by(cred, 3, 4)(m)) for m in MONTHS}}
    g["out_month"] = {m: r2(by(d["payroll"], 1, 2)(m) + by(d["vendorSpend"], 1, 2)(m) + by(d["capex"], 4, 5)(m)) for m in MONTHS}
    g["in_customer"] = {n: r2(by(pay, 2, 4)(c) - by(cred, 1, 4)(c)) for c, n in d["customers"]}
    g["in_category"] = {c: r2(sum(p[4] for p in pay if inv[p[1]][4] == c) - sum(k[4] for k in cred if inv[k[2]][4] == c)) for (c,) in d["billingCategories"]}
    shared = {m: r2(sum(s[2] for s in d["vendorSpend"] if s[1] == m and vend[s[0]][2] == "SHARED")) for m in MONTHS}
    share = dict(d["allocShares"])
    g["dept"], g["cc"] = {}, {}
    for code, name in d["departments"]:
        g["dept"][name] = r2(sum(p[2] for p in d["payroll"] if p[0] == code) + sum(s[2] for s in d["vendorSpend"] if vend[s[0]][2] == code) + sum(r2(shared[m] * share[code]) for m in MONTHS) + by(d["capex"], 2, 5)(code))
    for code, _, dept, part in d["costCenters"]:
        g["cc"][code] = r2(
            sum(r2(sum(p[2] for p in d["payroll"] if p[0] == dept and p[1] == m) * part) + r2(shared[m] * share[dept] * part) for m in MONTHS) + sum(s[2] for s in d["vendorSpend"] if vend[s[0]][3] == code) + by(d["capex"], 3, 5)(code)
        )
    g["vendor"] = {v[1]: r2(by(d["vendorSpend"], 0, 2)(v[0]) + by(d["capex"], 1, 5)(v[0])) for v in d["vendors"]}
    flags = {f"NEGATIVE_NET:{m}" for m in MONTHS if r2(g["in_month"][m] - g["out_month"][m]) < 0}
    total = sum(g["in_month"].values())
    flags |= {f"CUSTOMER_CONCENTRATION:{n}" for n, a in g["in_customer"].items() if a / total > 0.3}
    for v in d["vendors"]:
        spent = [sum(s[2] for s in d["vendorSpend"] if s[0] == v[0] and s[1] == m) for m in MONTHS]
        median = sorted(spent)[len(spent) // 2]
        flags |= {f"VENDOR_SPIKE:{v[1]}:{m}" for m, a in zip(MONTHS, spent) if median > 0 and a > 1.8 * median}
    if sum(i[5] for i in d["invoices"]) - sum(p[4] for p in pay) > 0.1 * sum(i[5] for i in d["invoices"]):
        flags.add("OPEN_AR_HIGH")
    return g, flags


@pytest.mark.parametrize("seed", [42, 7, 1337])
def test_figures(spark, seed):
    d = dataset(seed)
    t = {n: spark.createDataFrame(d[n], s).coalesce(1) for n, s in cf.TABLES.items()}
    g, flags = gold(d)
    got = lambda df: {r[0]: r[1] for r in df.collect()}
    same = lambda df, want: got(df) == pytest.approx(want, abs=0.011)
    assert same(cf.inflows_by_month(t), g["in_month"]) and same(cf.outflows_by_month(t), g["out_month"])
    assert same(cf.inflows_by_customer(t), g["in_customer"]) and same(cf.inflows_by_category(t), g["in_category"])
    assert same(cf.outflows_by_department(t), g["dept"]) and same(cf.outflows_by_cost_center(t), g["cc"]) and same(cf.outflows_by_vendor(t), g["vendor"])
    assert {r.flag for r in cf.risk_flags(t).collect()} == flags
    if seed == 42:
        assert all(r.ok for r in cf.reconciliation(t, 0.2).collect())
        s = cf.score(spark.createDataFrame(list(g["vendor"].items()), "name string, outflow double"), cf.outflows_by_vendor(t), "name", "outflow").first()
        assert (s.rows, s.matched, s.extra) == (6, 6, 0)
        assert cf.aging(t, "2026-06").agg(F.sum("amount")).first()[0] > 0 and cf.department_matrix(t, MONTHS).count() == 3 and cf.spend_matrix(t, MONTHS).columns == ["category", *MONTHS]


def test_registers_are_found_by_question(spark):
    d = dataset(42)
    t = {n: spark.createDataFrame(d[n], s).coalesce(1) for n, s in cf.TABLES.items()}
    pay = t["payments"].select(F.col("id").alias("Payment ID"), F.col("invoiceId").alias("Invoice"), F.col("customerId").alias("Customer"), F.col("month").alias("Month"), F.col("amount").alias("Amount"))
    spend = t["vendorSpend"].select(F.col("vendorId").alias("Vendor"), F.col("month").alias("Month"), F.col("amount").alias("Amount"))
    ws = Workspace.lifted(spark, lift(pay, "Payments", ["Payment ID"], book="billing"), lift(spend, "Vendor Spend", ["Vendor", "Month"], book="costs"))
    found = cf.solve(ws, {"payments": ("payments received by customer", {"month": ["month"], "a": ["amount"]}), "spend": ("vendor spend by month", {"vendor": ["vendor"], "a": ["amount"]})})
    by = {r.month: r.a for r in found["payments"].groupBy("month").agg(F.sum("a").alias("a")).collect()}
    assert by == pytest.approx({m: sum(p[4] for p in d["payments"] if p[3] == m) for m in {p[3] for p in d["payments"]}})
    assert found["spend"].agg(F.sum("a")).first()[0] == pytest.approx(sum(s[2] for s in d["vendorSpend"]))
    assert {r.source.split("!")[0] for r in cf.provenance(ws).where("metric = 'inflows_by_month'").collect()} == {"[billing]Payments"}
