from pyspark.sql import functions as F

from gridengine.llm import mixing

from .oracle import same


def test_against_sql(spark, sf):
    same(mixing.op4_systematic_mix(spark, sf), sf, mixing.OP4_SQL)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_words_come_near_their_target(spark, sf):
    rows = mixing.op4_systematic_mix(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    want = brute_targets({r.source: r.source_size for r in rows})
    taken, most = {}, {}
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= 1.5 * most[s] for s in want)


def test_hot_source_and_cases(spark):
    docs = [(i, "w " * (i % 50 + 1), "hot") for i in range(3000)] + [(i, "w " * 30, f"s{i % 4}") for i in range(3000, 3200)] + [(4000, None, None), (None, "a b", None), (4001, "x", None), (4001, "x", None), (4002, "", "empty")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("id", F.lit(1)).withColumn("size", F.lit(1)).withColumn("key", F.lit("k")).withColumn("copy", F.lit("k"))
    rows = mixing.with_copies(d).collect()
    assert len(rows) == len(docs)
    want = brute_targets({r.source: r.source_size for r in rows})
    for s, t in want.items():
        assert abs(sum(r.copies * r.size for r in rows if r.source == s) - t) <= 60
    assert all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.with_copies(d.repartition(3)).collect()))
    mix = mixing.mixed_sources(d)
    assert mix.columns == [*d.columns, "copy_no"] and mix.count() == sum(r.copies for r in rows)
    assert mixing.with_copies(d.limit(0)).count() == 0 and mixing.mixed_sources(d.limit(0)).count() == 0
