import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridengine.llm import chat
from gridengine.llm import tokens as T

counter = T.Counter()
alphabet = st.text(st.sampled_from("ab é'slltve01.,  \n\t<中😀"), max_size=40)
whole = lambda s: len(T.encoding(T.TOKENIZER).encode_ordinary(s))


@settings(max_examples=1500, deadline=None)
@given(alphabet, st.lists(st.tuples(st.integers(0, 45), st.integers(0, 12), alphabet), max_size=5), st.integers(1, 3))
def test_edits_count_as_encoding_anew(text, edits, width):
    old, T.Tree.WIDTH = T.Tree.WIDTH, width
    try:
        d = T.Document(text, counter)
        assert d.tokens == whole(text)
        for start, n, new in edits:
            d.edit(start, start + n, new)
            s = min(start, len(text))
            text = text[:s] + new + text[min(s + n, len(text)) :]
            assert d.text == text and d.tree.length == len(text)
            assert d.tokens == whole(text)
    finally:
        T.Tree.WIDTH = old


def test_only_the_edited_region_is_encoded():
    text = "Some words here, and it's 2024.\n" * 5000
    d = T.Document(text, counter)
    d.edit(80_000, 80_010, "new words")
    assert d.encoded < 100 and d.tokens == whole(text[:80_000] + "new words" + text[80_010:])


@settings(max_examples=300, deadline=None)
@given(alphabet, st.lists(st.tuples(st.integers(0, 45), st.integers(0, 12), alphabet), max_size=4), st.integers(1, 3))
def test_kept_trees_are_the_same_trees(text, edits, width):
    old, T.Tree.WIDTH = T.Tree.WIDTH, width
    try:
        d = T.Document(text, counter)
        for start, n, new in edits:
            d.tree = T.Tree.of(d.tree.kept())
            d.edit(start, start + n, new)
            assert d.tokens == whole(d.text) and d.tree.length == len(d.text)
        again = T.Tree.of(d.tree.kept())
        assert (again.blocks, again.chars, again.tokens, again.size) == (d.tree.blocks, d.tree.chars, d.tree.tokens, d.tree.size)
    finally:
        T.Tree.WIDTH = old


def test_edits_go_on_from_kept_trees(spark, tmp_path, monkeypatch):
    long = "Some words here, and it's 2024.\n" * 30_000
    docs = spark.createDataFrame([(1, "ab cd ef"), (1, "ab cd ef"), (2, None), (None, "x y"), (3, long)], "doc_id long, text string").withColumn("tree", F.lit(1))
    first = [(1, 0, 0, 2, "new"), (2, 0, 0, 0, "some text"), (3, 0, 500_000, 500_010, "other")]
    second = [(1, 0, 3, 3, "er"), (1, 1, 0, 1, ""), (3, 0, 10, 20, "x")]
    table = lambda rows: spark.createDataFrame(rows, "id long, seq int, start int, end int, text string")
    monkeypatch.setattr(T, "BATCH_LEAVES", 3)
    T.token_trees(docs).write.parquet(f"{tmp_path}/0")
    for k, edits in enumerate((first, second)):
        T.edited_trees(T.with_edits(spark.read.parquet(f"{tmp_path}/{k}"), table(edits))).write.parquet(f"{tmp_path}/{k + 1}")
    got = sorted((str(r.id), r.text, r.tokens_after, r.chars_encoded) for r in spark.read.parquet(f"{tmp_path}/2").collect())
    changed = long[:500_000] + "other" + long[500_010:]
    changed = changed[:10] + "x" + changed[20:]
    assert [r[:3] for r in got] == [(i, t, whole(t)) for i, t in (("1", "ewer cd ef"), ("1", "ewer cd ef"), ("2", "some text"), ("3", changed), ("None", "x y"))]
    assert got[3][3] < 100 and got[4][3] == 0
    assert T.token_trees(docs.limit(0)).count() == 0


def test_edited_counts_on_tables(spark, sf):
    got = {r.doc_id: r for r in T.op8_edit_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t, n = r.text, len(r.text)
        for a, b, new in ((n // 4, n // 4, " [inserted 42] "), (n // 2, n // 2 + 25, ""), (3 * n // 4, 3 * n // 4 + 10, "l'été\n\n  it's")):
            t = t[:a] + new + t[b:]
        g = got.pop(r.doc_id)
        assert (g.tokens_before, g.tokens_after, g.chars_after) == (whole(r.text), whole(t), len(t))
    assert not got
    docs = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (2, None), (None, "x"), (3, "")], "doc_id long, text string").withColumn("edits", F.lit(1))
    edits = spark.createDataFrame([(1, 2, 0, 2, None), (1, 1, 5, 99, " ef"), (2, 0, None, None, "new"), (9, 0, 0, 0, "x")], "id long, seq int, start int, end int, text string")
    rows = sorted((str(r.id), r.tokens_before, r.tokens_after, r.n_edits, r.chars_after) for r in T.edited_counts(docs, edits).collect())
    assert rows == [("1", whole("ab cd"), whole(" cd ef"), 2, 6)] * 2 + [("2", 0, 1, 1, 3), ("3", 0, 0, 0, 0), ("None", 1, 1, 0, 1)]
    assert T.edited_counts(docs.limit(0), edits).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a>\\<b", ""]), st.text(st.sampled_from("\\</turn> ab\n#é"), max_size=30)), min_size=1, max_size=12), st.integers(5, 80), st.integers(0, 40))
def test_windows_read_back(turns, budget, history):
    w = chat.Windows(whole, budget, history)
    out = [x for r, t in turns for x in w.add(r, t)] + [w.window()]
    got = [x for _, text, _, repeated, *_ in out for x in chat.read(text)[repeated:]]
    assert got == turns
    loss = "".join(chat.unescaped(text[s["start"] : s["end"]]) for _, text, _, _, spans, _ in out for s in spans)
    assert loss == "".join(t for r, t in turns if r == "assistant")
    for k, (_, text, tokens, repeated, _, over) in enumerate(out):
        own = chat.read(text)
        assert over == (tokens > budget) and (not over or len(own) - repeated == 1)
        if k and turns[0][0] == "system":
            assert own[0] == turns[0] and repeated >= 1


def test_query_against_the_table(spark, sf):
    said = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(conv, []).append((role, text or ""))
    got = {r.conv_id: r for r in chat.op7_chat_windows(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in want.items():
        g, loss = got.pop(conv), "".join(t for r, t in turns if r == "assistant")
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert not got


def test_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, None, "x"), (2, None, "assistant", "long " * 5000), (2, 1, "user", "u")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("c"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.training_windows(d)).collect()}
    assert got == {1: (3, 0), None: (1, 0), 2: (2, 25000)}
    assert chat.training_windows(d.limit(0)).count() == 0
