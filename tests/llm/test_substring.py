import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridengine.llm import substring as sub


def brute(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), " ".join(kept))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.sampled_from("abc"), max_size=14))
def test_automaton(texts, text):
    a = sub.Automaton()
    for t in texts:
        a.add(t)
    own = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in own)) for k in range(len(text))]
    assert a.matches(text) == want
    assert len(a.next) <= max(1, 2 * sum(map(len, texts)) + 1)


def made(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randint(15, 70))] for _ in range(12)]
    docs = []
    for k in range(n):
        t = [r.choice(words) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            t += p[a:] + [r.choice(words) for _ in range(r.randint(0, 5))]
        if r.random() < 0.1:
            t += ["la"] * r.randint(15, 60)
        if r.random() < 0.1 and docs and docs[-1][1]:
            t = docs[-1][1].split()
        docs.append((k * 3, " ".join(t)))
    return docs


@pytest.mark.parametrize("seed, most", [(1, 2048), (2, 3), (3, 1)])
def test_made_corpora(spark, seed, most):
    docs = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_words, r.n_removed, r.text) for r in sub.without_repeats(d, max_stretches=most).collect()}
    want = brute(docs)
    assert got == want and sum(x[1] for x in want.values()) > 500


@pytest.mark.parametrize("window", [7, 50, 70])
def test_other_windows(spark, window):
    docs = made(5, vocabulary=60)
    docs += [(1000 + k, " ".join(docs[k][1].split() * 3)) for k in range(0, 40, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, window)
    for most in (2048, 1):
        assert {r.id: (r.n_words, r.n_removed, r.text) for r in sub.without_repeats(d, window=window, max_stretches=most).collect()} == want
    assert sum(x[1] for x in want.values()) > 100


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub.op6_suffix_automata(spark, sf).collect()}
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(docs).items()}
    assert got == want


def test_cases(spark):
    p = " ".join(f"p{k}" for k in range(25))
    docs = [(1, None), (2, ""), (3, p), (None, "x " + p), (4, p + " " + p), (5, "short"), (6, "é\t" + p.replace(" ", "\n") + " tail"), (7, "one " * 100), (8, "one " * 19)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("c")).withColumn("found", F.lit("c"))
    got = {r.id: (r.n_words, r.n_removed, r.text) for r in sub.without_repeats(d).collect()}
    assert got == brute(docs)
    twice = spark.createDataFrame([(1, p), (1, p)], "doc_id long, text string")
    assert [r.n_removed for r in sub.without_repeats(twice).collect()] == [0, 0]
    assert sub.without_repeats(d.limit(0)).count() == 0


def test_reference(spark):
    p = " ".join(f"p{k}" for k in range(60))
    ref = spark.createDataFrame([("zzz " + p,), (None,), ("q " * 30,)], "text string")
    docs = spark.createDataFrame([(1, "a " + p[: p.index("p30")] + "b"), (2, "a " + p[: p.index("p15")] + "b"), (3, None), (4, "q " * 50)], "doc_id long, text string")
    odd = docs.union(docs).withColumn("id", F.lit("c")).withColumn("gone", F.lit("c")).withColumn("n_words", F.lit("c"))
    for words, at_once in ((10, 40), (10, 10**9), (sub.SHARD_WORDS, 1), (sub.SHARD_WORDS, sub.PASS_WORDS)):  # several passes, one
        rows = sub.without_reference(odd, ref.union(ref), shard_words=words, pass_words=at_once).collect()
        assert len(rows) == 8
        assert {r.id: (r.n_words, r.n_removed) for r in rows} == {1: (32, 30), 2: (17, 0), 3: (0, 0), 4: (50, 50)}
    assert sub.without_reference(docs, ref.limit(0)).agg(F.sum("n_removed")).first()[0] == 0


def test_window_hash_is_of_content():
    words = np.arange(1, 400, dtype=np.uint64) % 37
    _, start, n, g, s = sub.segments(words, np.array([0, 399]))
    assert n.sum() == 380 and (np.diff(start) == n[:-1]).all()
