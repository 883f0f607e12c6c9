"""Questions to regions: a word list and the regions' own texts give scores; no model, no chance.

Regions and words of the question meet in one table of hits, region by word group, from which scores, reasons and
ranks are aggregates; many questions are ranked at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups of words that mean the same here.
SYNONYMS = [
    ["inflow", "inflows", "receipt", "receipts", "payment", "payments", "collected", "collections", "cash in", "received", "remittance"],
    ["outflow", "outflows", "spend", "spending", "cost", "costs", "expense", "expenses", "cash out"],
    ["vendor", "vendors", "supplier", "suppliers"],
    ["payroll", "salary", "salaries", "wages", "compensation", "headcount"],
    ["department", "departments", "dept", "division"],
    ["cost center", "cost centre", "cost centers", "cost-center", "costcenter"],
    ["customer", "customers", "client", "clients"],
    ["assumption", "assumptions", "policy", "policies", "basis", "rules"],
    ["allocation", "allocations", "allocated", "share", "shares", "split"],
    ["capex", "capital", "investment"],
    ["deferred", "prepaid", "recognition"],
    ["invoice", "invoices", "billed", "billing"],
    ["credit", "credits", "adjustment", "adjustments"],
    ["aging", "ageing", "overdue", "receivable", "receivables"],
    ["forecast", "projection", "budget"],
    ["month", "monthly", "months"],
    ["risk", "risks", "anomaly", "anomalies", "spike"],
    ["liquidity", "net cash", "cash position"],
    ["revenue", "income", "sales"],
    ["mapping", "rates", "lookup", "reference"],
    ["hidden"],
]
# Words of a question that tell nothing.
STOP = frozenset(
    "what which where when how much many does do is are the a an of by for to in on and or with from that this each per show find list give tell their there into out about expected come going".split()
)
#: What a word is worth in each of a region's texts: for a group of the list, and for a word of the question itself.
FIELDS = {"sheet": (3, 2), "title": (3, 2), "purpose": (3, 2), "headers": (2, 1), "extras": (1, 1)}
KINDS = ["table", "matrix", "keyValue", "list", "block", "notes"]


def question_words(question: str, synonyms: list[list[str]] | None = None) -> list[tuple[int, bool, list[str]]]:
    """(order, whether of the list, words) of the groups that a question touches and of its other words of over three letters."""
    q = f" {question.lower()} "
    groups = [g for g in [*SYNONYMS, *(synonyms or [])] if any(w in q for w in g)]
    known = {w for g in groups for w in g}
    single = dict.fromkeys(t for t in re.split(r"[^a-z0-9-]+", question.lower()) if len(t) > 3 and t not in STOP and t not in known)
    return [(k, k < len(groups), w) for k, w in enumerate([*groups, *([t] for t in single)])]


def haystacks(regions: DataFrame) -> DataFrame:
    """(book, region_id, texts): the texts of a region that words are looked for in."""
    whole = F.col("kind").isin("keyValue", "notes", "list")
    told = F.filter("columns", lambda c: c["role"].isin("category", "key", "id") | whole)
    samples = F.array_join(F.flatten(F.transform(told, lambda c: c["samples"])), " ")
    labels = F.coalesce(F.array_join(F.transform("sections", lambda s: F.coalesce(s["label"], F.lit(""))), " "), F.lit(""))
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    extras = F.concat_ws(" ", labels, F.coalesce(samples, F.lit("")), F.coalesce(F.array_join("notes", " "), F.lit("")))
    return regions.withColumns({"h_sheet": text(F.col("sheet")), "h_title": text(F.col("title")), "h_purpose": text(F.col("purpose")), "h_headers": text(F.array_join("headers", " ")), "h_extras": F.lower(extras)})


def locate(regions: DataFrame, questions: list[str], top: int = 8, min_score: int = 3, synonyms: list[list[str]] | None = None) -> DataFrame:
    """(question, rank, book, region_id, sheet, range_a1, kind, purpose, title, hidden_sheet, score, matched, why), the best ``top`` a question.

    Equal scores: kinds with data first, then the range's name by its collation. The words of the questions are a list of
    constants, so nothing is joined: every region is read once and gives a row per word group that hits.
    """
    hay = haystacks(regions)
    asked = [(q, question_words(q, synonyms)) for q in questions]
    out = None
    for q, groups in asked:
        found = _scored(hay, q, groups).where(F.col("score") >= min_score)
        out = found if out is None else out.unionByName(found)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), kind, F.expr("range_a1 COLLATE UNICODE"), "book")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = ["question", "rank", "book", "region_id", "sheet", "range_a1", "kind", "purpose", "title", "hidden_sheet", "score", "matched", "why"]
    return ranked.select(*names)


def _scored(hay: DataFrame, question: str, groups: list[tuple[int, bool, list[str]]]) -> DataFrame:
    """All in expressions: per group the fields that hold a word, the first word that hits, and the points."""
    hits = []
    for _, of_list, words in groups:
        at = 0 if of_list else 1
        held = {f: _any(f, words) for f in FIELDS}
        points = sum((F.when(held[f], w[at]).otherwise(0) for f, w in FIELDS.items()), F.lit(0))
        first = F.coalesce(*(F.when(_any_field(w), F.lit(w)) for w in words))
        # fields in the order in which the words hit them
        order = F.array_distinct(F.flatten(F.array(*(F.filter(F.array(*(F.when(F.contains(F.col(f"h_{f}"), F.lit(w)), F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull()) for w in words))))
        hits.append(F.struct(points.alias("points"), first.alias("word"), order.alias("fields")))
    none = F.array().cast("array<struct<points:int,word:string,fields:array<string>>>")
    all_hits = F.array(*hits) if hits else none
    hidden = F.lit("hidden" in question.lower()) & F.col("hidden_sheet")
    out = hay.withColumn("hits", F.filter(all_hits, lambda h: h["word"].isNotNull())).withColumn("question", F.lit(question))
    reasons = F.transform("hits", lambda h: F.concat(F.lit("“"), h["word"], F.lit("” in "), F.array_join(h["fields"], "/")))
    reasons = F.concat(reasons, F.when(hidden, F.array(F.lit("region is on a hidden sheet"))).otherwise(F.array().cast("array<string>")))
    score = F.aggregate("hits", F.lit(0), lambda a, h: a + h["points"]) + F.when(hidden, 3).otherwise(0)
    return out.withColumns({"score": score, "matched": F.array_distinct(F.transform("hits", lambda h: h["word"])), "why": F.array_join(F.slice(reasons, 1, 4), "; ")}).where("score > 0")


def _any(field: str, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(f"h_{field}"), w))


def _any_field(word: str) -> Column:
    return F.contains(F.concat_ws("\x00", *(F.col(f"h_{f}") for f in FIELDS)), F.lit(word))
