import numpy as np
from pyspark.sql import functions as F

from gridengine.llm import cotrain


def test_held_out_accuracy(spark):
    """A third of the labels is hidden; documents behind them must be told apart."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0)
    rows = cotrain.scored(docs, labels.join(hidden, "doc_id", "left_anti")).join(hidden, F.col("id") == F.col("doc_id")).collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in rows if r.quality == 0]
    toxic = [r.keep for r in rows if r.quality == 1 and r.toxic == 1]
    print(np.mean(clean), np.mean(junk), np.mean(toxic), len(rows))
    assert len(rows) > 1000 and np.mean(clean) > 0.98 and np.mean(junk) < 0.15 and np.mean(toxic) < 0.25


def test_views_agree_on_made_documents(spark):
    rows = [(i, ("good words here %d " % i + "fine " * 9) if i % 2 else "BAD!!! %d " % i + "junk# " * 9, "en", "clean.org" if i % 2 else "spam.biz", 60) for i in range(400)]
    rows += [(500, None, None, None, None), (501, "", "", "", 0), (None, "fine", "en", "clean.org", 4), (7, rows[7][1], "en", "clean.org", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("c")).withColumn("good", F.lit(1)).withColumn("view", F.lit(1)).withColumn("score", F.lit("c"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 1, None), (None, 1, 0), (9, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    found = cotrain.scored(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(r.keep == bool(r.id % 2) and (r.text_score > 0.5) == (r.meta_score > 0.5) == r.keep for r in found if r.id is not None and r.id < 400)
    kept = cotrain.accepted(docs, labels)
    assert kept.columns == docs.columns and 200 <= kept.count() <= 204
    again = cotrain.scored(docs.repartition(5), labels).collect()
    key = lambda r: str((r.id, round(r.score, 9)))
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_both_views_label_and_the_exchange_decides(spark):
    """120 labels are too few for the text's view alone; it learns from the metadata's, and then teaches it back."""
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for i in range(4000):
        good = int(rng.random() < 0.5)
        source = rng.integers(0, 3) + (3 if (good if rng.random() < 0.93 else 1 - good) else 0)
        text = [f"n{k}" for k in rng.integers(0, 300, 20)] + [f"{'g' if good else 'b'}{k}" for k in rng.integers(0, 25, 2)]
        rows.append((i, " ".join(text), "en", f"src{source}", 100))
        truth[i] = good
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(120)], "doc_id long, quality int, toxic int")

    def held_out(rounds):
        return np.mean([r.keep == bool(truth[r.id]) for r in cotrain.scored(docs, labels, rounds=rounds).collect() if r.id >= 120])

    assert held_out(0) < 0.85 and held_out(2) > 0.97
    history = []
    cotrain.train(cotrain.featured(docs), labels, history=history)
    given = [sum((e.view == v).sum() for e in history) for v in (0, 1)]
    assert min(given) > 200
    for e in history:
        assert len(set(zip(e.view.tolist(), e.id.tolist()))) == len(e.id)
        sure = [(p > 0.5) == bool(truth[i]) for i, p in zip(e.id.tolist(), e.good.tolist())]
        assert np.mean(sure) > 0.85


def test_very_long_texts_and_many_rows_of_a_labelled_id(spark):
    rows = [(i, ("fine words " if i % 2 else "junk# BAD ") * (60_000 if i < 4 else 5), "en", "a", 1) for i in range(200)] + [(5, "fine words again", "en", "a", 1)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4, 80)], "doc_id long, quality int, toxic int")
    features = cotrain.featured(docs)
    assert cotrain.examples(features, cotrain.labelled(labels)).count() == 76
    assert all(r.keep == bool(r.id % 2) for r in cotrain.scored(docs, labels).collect())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)], [(7, 0, 0), (8, 1, 0)]):
        l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert [r.keep for r in cotrain.scored(docs, l).collect()] == [True, True]
        assert cotrain.accepted(docs, l).count() == 2
    l = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.scored(docs, l).count() == 2
    assert cotrain.scored(docs.limit(0), l).count() == 0 and cotrain.accepted(docs.limit(0), l).count() == 0
