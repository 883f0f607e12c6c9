from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridengine.llm import mixing, pii

from .test_fmindex import words
from .test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert docs.columns[:5] == COLUMNS
    assert [n for n, _ in cp.STAGES] == list(kept)
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r for r in kept["quality_classifier"]}
    assert all(before[i] == r for i, r in good.items())
    ids = sorted(good)
    comp = brute_components([brute_fingerprint(good[i].text) for i in ids])
    linked = {i for k, i in enumerate(ids) if comp[k] != k}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids for w in [good[i].text.lower().split()]}
    single = {r.doc_id for r in kept["simhash_near_dedup"]}
    assert not linked & single
    for i in set(ids) - linked - single:  # what else went is like one that was there
        assert any(len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in ids if j < i)
    alike = [(i, j) for i in single for j in single if j < i and len(shingles[i] & shingles[j]) >= 0.85 * len(shingles[i] | shingles[j])]
    assert len(alike) <= 2
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(len(w) - 9)}
    clean = {r.doc_id: r for r in kept["benchmark_decontamination"]}
    for r in kept["simhash_near_dedup"]:
        w = words(r.text)
        hit = {k + j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in grams for j in range(10)}
        assert words(clean[r.doc_id].text) == [x for k, x in enumerate(w) if k not in hit]
        assert hit or clean[r.doc_id].text == r.text
    for r in kept["pii"]:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == clean[r.doc_id].text or pii.candidates(clean[r.doc_id].text)  # base spans, or what the method adds, as secrets
    mix = kept["source_mix"]
    copies = {r.id: r.copies for r in mixing.with_copies(spark.read.parquet(f"{tmp_path}/pii")).collect()}
    assert len(mix) == sum(copies.values()) and all(r.copy <= copies[r.doc_id] for r in mix)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == [*COLUMNS, "copy"] and out.count() > 50


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(None, "a text without an id", "en", "src1", 20), (9001, None, None, None, None), (9002, "", "", "", 0), (9003, "word " * 40000, "en", "src1", 200000), (9004, "x@y.example.com twice", None, "src2", 5), (9004, "x@y.example.com twice", None, "src2", 5)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    clash = ["id", "fp", "words", "component", "node", "count", "good", "view", "size", "key", "class", "salt", "place", "copies", "copy", "row", "rows", "found", "spans", "start", "n_words", "sketch", "u", "v", "g", "keep", "score"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in clash})
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(columns)] == columns, name
        docs = spark.createDataFrame(out.select(*columns).collect(), docs.schema)
        assert {tuple(r) for r in docs.select(*clash).distinct().collect()} <= {tuple(f"own {c}" for c in clash)}, name
        assert docs.where("doc_id = 9004").count() <= (2 if name in ("quality_classifier", "source_mix") else 1)
    assert docs.count() > 0
