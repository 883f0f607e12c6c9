import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridengine.llm import fmindex as fm


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= own
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_search_and_locate(text, phrase):
    index = fm.FMIndex(np.array(text), 5, sample=3)
    who, lo, hi = index.search(np.array([phrase]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(who) else []
    assert got == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


def test_suffix_order():
    for codes in ([1] * 50, [1, 2] * 30 + [3], [5, 4, 3, 2, 1]):
        codes = np.append(codes, 0)
        assert fm.suffix_order(codes, 3).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())


def test_whole_table_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in fm.op9_fm_decontamination(spark, sf).collect()}
    assert got == brute(docs, items)
    assert any(x[-1] for x in got.values())


def test_cases(spark):
    ten = "Alpha beta-gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, ten), (12, ten), (3, "Kurz und  gut"), (4, None), (5, "..."), (None, "nobody owns this")]
    docs = [(1, f"x {ten.lower()} y"), (2, None), (3, ""), (4, "kurz, und gut; kurz und gut"), (5, "nobody owns this"), (6, "ab " * 5000 + ten), (7, ten + " " + ten)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("c")).withColumn("n_words", F.lit("c"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for shard in (fm.SHARD, 16):
        got = {r.id: (r.n_words, r.n_hit, r.items) for r in fm.contamination(d, b, shard=shard).collect()}
        assert got == {1: (12, 10, ["1", "12"]), 2: (0, 0, []), 3: (0, 0, []), 4: (6, 6, ["3"]), 5: (3, 3, []), 6: (5010, 10, ["1", "12"]), 7: (20, 20, ["1", "12"])}
    clean = fm.decontaminated(d, b)
    assert clean.columns == d.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] == "x y" and texts[2] is None and texts[3] == "" and texts[5] == "" and texts[7] == ""
    again = fm.decontaminated(d.union(d), b)
    assert again.count() == 14 and {tuple(r) for r in again.select("doc_id", "text").collect()} == {tuple(r) for r in clean.select("doc_id", "text").collect()}
    # A benchmark in many parts, under another name of its column: the same, one pass for each part.
    other = b.withColumnsRenamed({"text": "body", "item_id": "item"})
    how = {"item_text_col": "body", "item_col": "item", "part": 40}
    assert {r.id: (r.n_words, r.n_hit, r.items) for r in fm.contamination(d.withColumnRenamed("text", "page"), other, text_col="page", **how).collect()} == got
    assert {r.doc_id: r.text for r in fm.decontaminated(d, other, **how).collect()} == texts
    assert fm.contamination(d.limit(0), b).count() == 0
    assert fm.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
