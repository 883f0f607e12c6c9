import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridengine.llm import simhash

DOCS = "id long, text string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps)
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, comp)}
    assert {tuple(r)[:3] for r in simhash.op1_simhash(spark, sf).collect()} == want


def test_cases(spark):
    docs = spark.createDataFrame([(5, None), (3, ""), (9, " \t "), (4, "One two"), (7, "one TWO"), (8, "x"), (8, "x"), (None, "x"), (2, "Ä b c d e " * 3000)], DOCS)
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1)).withColumnRenamed("id", "doc_id")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("id", "component").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (7, 4), (8, 8), (8, 8), (None, 8), (2, 2)], key=str)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 8, 2, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [7, 4096])
def test_links_lose_no_component(spark, chunk):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, k)) for c in centres for k in rng.integers(0, 4, 60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    got = dict(tuple(r) for r in simhash.components(simhash.links(nodes, chunk=chunk)).collect())
    want = brute_components(fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_nearest_forest_is_a_minimum_spanning_forest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 4)
        fps = np.array([int(b) ^ sum(1 << int(x) for x in rng.integers(0, 62, rng.integers(0, 6))) for b in base for _ in range(8)], np.uint64)
        u, v = simhash.nearest_forest(fps, np.arange(len(fps)), 6)
        d = lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count()
        parent, total, n = list(range(len(fps))), 0, 0

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in sorted(((a, b) for b in range(len(fps)) for a in range(b)), key=lambda p: d(*p)):
            if d(a, b) <= 6 and root(a) != root(b):
                parent[root(a)] = root(b)
                total, n = total + d(a, b), n + 1
        assert (len(u), sum(d(int(a), int(b)) for a, b in zip(u, v))) == (n, total)


def test_similar_texts_are_found_and_others_left(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: [words[k] for k in rng.integers(0, 4000, n)]
    docs, source = [], {}
    for k in range(40):
        base = text(300)
        docs.append((100 * k, " ".join(base)))
        for j in range(1, 6):
            own = list(base)
            for at in rng.integers(0, 300, 4):
                own[at] = words[rng.integers(0, 4000)]
            source[100 * k + j] = 100 * k
            docs.append((100 * k + j, " ".join(own)))
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in docs}
    alike = {i for i, s in source.items() if len(shingles[i] & shingles[s]) / len(shingles[i] | shingles[s]) >= 0.8}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(d).collect()}
    assert all(100 * k in kept for k in range(40))
    assert len(alike) > 150 and len(alike & kept) <= 0.06 * len(alike)
    for i, t in docs[:20]:
        whole = simhash.sketch(t.encode())
        assert len(whole) == len(shingles[i])
    a, b = docs[0], docs[1]
    assert abs(simhash.resemblance(simhash.sketch(a[1].encode()), simhash.sketch(b[1].encode())) - len(shingles[a[0]] & shingles[b[0]]) / len(shingles[a[0]] | shingles[b[0]])) < 1e-9
    long = " ".join(text(6000))
    assert abs(simhash.resemblance(simhash.sketch(long.encode()), simhash.sketch((long + " " + " ".join(text(1500))).encode())) - 0.8) < 0.06


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(400, 401)], "u long, v long")
    got = dict(tuple(r) for r in simhash.components(edges).collect())
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 401: 400}


def test_long_chains_are_not_left_unfinished(spark):
    rng = np.random.default_rng(2)
    order = rng.permutation(3000).tolist()
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "u long, v long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_keys_of_more_blocks_find_the_same(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)})
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    found = [{tuple(r) for r in simhash.components(simhash.links(nodes, blocks=n)).collect()} for n in (6, 7, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def prose(rng, n):
    return [f"w{k}" for k in rng.integers(0, 4000, n)]


def replaced(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"x{rng.integers(0, 1 << 40)}"
    return out


def true_groups(docs):
    """Smallest id of each text's group: 0.8 of the five-word shingles, or 4 bits; all pairs."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in docs]
    fps = [simhash.fingerprint(t.encode()) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 or (c := len(sets[i] & sets[j])) / (len(sets[i]) + len(sets[j]) - c) >= 0.8:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: docs[root(k)][0] for k, (i, _) in enumerate(docs)}


def found_groups(spark, docs):
    return {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_added_blocks_are_found_at_any_similarity(spark):
    rng = np.random.default_rng(11)
    docs = []
    for k in range(60):
        base, more = prose(rng, 300), prose(rng, 30 + k % 40)
        at = int(rng.integers(0, 2)) * 300
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:at] + more + base[at:]))]
    want = true_groups(docs)
    assert all(want[2 * k + 1] == 2 * k for k in range(60))
    assert found_groups(spark, docs) == want


def test_chains_of_revisions_are_one_group(spark):
    rng = np.random.default_rng(12)
    docs = []
    for k in range(25):
        own = prose(rng, 300)
        for j in range(6):
            docs.append((10 * k + j, " ".join(own)))
            own = replaced(rng, own, 5)
    assert found_groups(spark, docs) == true_groups(docs)


def test_large_groups_of_copies_lose_none(spark):
    rng = np.random.default_rng(13)
    base = prose(rng, 300)
    docs = [(0, " ".join(base))] + [(k, " ".join(replaced(rng, base, 6))) for k in range(1, 301)]
    assert found_groups(spark, docs) == true_groups(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = d.select(F.xxhash64("text").alias("own")).withColumn("comp", F.col("own"))
    one = None
    for listed, chunk in ((10_000, 512), (3, 11), (64, 512)):
        found = dict(tuple(r) for r in simhash.components(simhash.similar_links(d, known, 0.8, listed=listed, chunk=chunk)).collect())
        assert one in (None, found)
        one = found


def test_long_texts_are_decided_exactly(spark):
    rng = np.random.default_rng(14)
    docs, want = [], {}
    for k in range(12):
        base = [f"d{k}w{j}" for j in range(3004)]  # 3,000 shingles
        more = 750 if k % 2 else 751  # 0.8 and just below
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"x{rng.integers(0, 1 << 40)}" for _ in range(more)]))]
        want[2 * k + 1] = simhash.resemblance(*(simhash.sketch(t.encode()) for _, t in docs[-2:])) >= 0.8
    assert [want[2 * k + 1] for k in range(12)] == [bool(k % 2) for k in range(12)]
    assert found_groups(spark, docs) == true_groups(docs)


def test_another_text_of_a_removed_id_stays(spark):
    rng = np.random.default_rng(15)
    a, b = " ".join(prose(rng, 50)), " ".join(prose(rng, 50))
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (None, a)], "doc_id long, text string")
    for similarity in (0.8, None):
        assert sorted(map(tuple, simhash.deduplicated(d, similarity=similarity).collect()), key=str) == sorted([(1, a), (5, b), (None, a)], key=str)


def test_rows_of_one_id_and_group_leave_the_same_one(spark):
    rng = np.random.default_rng(16)
    a, b = prose(rng, 60), " ".join(prose(rng, 50))
    near = " ".join(a[:-1] + ["other"])
    a = " ".join(a)
    rows = [(1, a, "x"), (1, near, "y"), (1, a, "w"), (1, b, "z"), (1, b, "z"), (2, a, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, place string")
    kept = [sorted(tuple(r) for r in simhash.deduplicated(d.repartition(n)).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2 and (1, b, "z") in kept[0]


def test_recall_on_a_whole_table(spark):
    """All pairs with 0.8 of their five-word shingles in common, by brute force over an inverted index: none is left apart."""
    from collections import Counter, defaultdict

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows for w in [r.text.lower().split()]}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter()
    for ids in by.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                common[min(i, j), max(i, j)] += 1
    alike = [(i, j) for (i, j), c in common.items() if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    comp = {r.id: r.component for r in simhash.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(alike) > 30 and all(comp[i] == comp[j] for i, j in alike)


def test_crowded_shingles_take_disk_for_what_can_be_similar_only(spark, monkeypatch):
    """Texts put together from passages that many have: all shingles are crowded, few texts are alike."""
    rng = np.random.default_rng(17)
    passages = [" ".join(prose(rng, 40)) for _ in range(20)]
    docs = []
    for k in range(500):
        own = [passages[j] for j in rng.choice(20, 5, replace=False)]
        docs.append((2 * k, " ".join(own)))
        if k % 50 == 0:
            docs.append((2 * k + 1, " ".join([*own, *prose(rng, 15)])))  # alike
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    hashed = d.select("doc_id", F.xxhash64("text").alias("own"))
    known = hashed.select("own").distinct().withColumn("comp", F.col("own"))
    whole = {r.own: simhash.sketch(r.text.encode()) for r in d.select(F.xxhash64("text").alias("own"), "text").collect()}
    own = sorted(whole)
    alike = {(u, v) for k, v in enumerate(own) for u in own[:k] if simhash.resemblance(whole[u], whole[v]) >= 0.8}
    stored, written = simhash.stored, []

    def counted(df, name, *more):
        out = stored(df, name, *more)
        if name == "simhash-sketches":
            written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    found = {tuple(r) for r in simhash.similar_links(d, known, 0.8).collect()}
    assert len(alike) >= 10 and found <= alike
    assert connected(found, own) == connected(alike, own)
    assert 0 < sum(written) < len(own) / 4  # whole sets


def connected(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_histograms_refuse_no_similar_pair():
    rng = np.random.default_rng(18)
    taken = refused = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[: int(n * rng.uniform(0.4, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.4))).astype(np.uint64) * np.uint64(2)])
        a, b = np.unique(a), np.unique(b)
        if not len(b):
            continue
        ok = bool(simhash.possible(*(np.frombuffer(simhash.histogram(x), np.uint8)[None] for x in (a, b)), np.array([len(a) + len(b)]), 0.8)[0])
        alike = simhash.resemblance(a, b) >= 0.8
        assert ok or not alike
        taken, refused = taken + alike, refused + (not ok)
    assert taken > 20 and refused > 100
