import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridengine.llm import repetition as rep


def brute(words, least=8):
    grams = Counter(tuple(words[i : i + least]) for i in range(len(words) - least + 1))
    cover = {k for i in range(len(words) - least + 1) if grams[tuple(words[i : i + least])] > 1 for k in range(i, i + least)}
    longest = 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[j + n] == words[i + n]:
                n += 1
            longest = max(longest, n)
    return len(cover), longest if longest >= least else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=5), st.integers(1, 8))
def test_repeats(texts, least):
    covered, longest, _ = rep.repeats(texts, least)
    assert list(zip(covered.tolist(), longest.tolist())) == [brute(t, least) for t in texts]


def test_many_words_and_long_runs():
    texts = [[b"w%d" % (i % 5000) for i in range(12000)], [b"x"] * 3000, [b"u%d" % i for i in range(9)], []]
    covered, longest, _ = rep.repeats(texts)
    assert covered.tolist() == [12000, 3000, 0, 0] and longest.tolist() == [7000, 2999, 0, 0]


def test_whole_table_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in rep.op2_suffix_repetition(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        g = got.pop(r.doc_id)
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)))
        if len(words) < 1500:
            covered, longest = brute(words)
            assert g.n_repeat_words == covered and g.kept == (not g.base_failed and (longest <= 32 or 5 * longest <= len(words)))
        assert g.base_failed == (len(words) < 20 or 100 * g.n_repeat_words > 30 * len(words))
        assert not (g.base_failed and g.kept)
    assert not got


def test_cases(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    docs = [(1, None), (2, ""), (3, clean), (3, clean), (4, clean + "\n" + clean), (5, "a\nb\na\n\n\n b\nb"), (None, clean + " é€")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("c")).withColumn("kept", F.lit("c"))
    got = sorted((str(r.id), r.n_words, r.n_dup_lines, r.n_repeat_words, r.kept) for r in rep.repetition_rules(d).collect())
    assert got == [("1", 0, 0, 0, False), ("2", 0, 0, 0, False), ("3", 100, 0, 0, True), ("3", 100, 0, 0, True), ("4", 200, 1, 200, False), ("5", 5, 2, 0, False), ("None", 101, 0, 0, True)]
    assert rep.repetition_rules(d.limit(0)).count() == 0
