"""Substring dedup by suffix automata of reference shards.

Against a given reference, its shards' automata are broadcast and every document streams through them; its matching
statistics give the maximal spans to remove. Within a corpus the reference is the corpus itself and grows with it, so its
shards are not broadcast but routed: every window of ``WINDOW`` words goes, with its neighbours, to the shard of its smallest gram's hash, where
all windows with the same words meet. Stretches that hold no recurring gram are left out, copies of a stretch
are pre-aggregated to the first, and a shard's automaton takes the different stretches in order of their first place: each streams through
what came before it, then extends it. A gram with very many different stretches is cut finer: its stretches are parted into windows, and a
shard is what also agrees on the window's hash, so no automaton is unbounded and no gram stays in one task.

A word is known by a 64-bit hash, and copies of a stretch by another of these; texts are exact up to equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_WORDS, discard, ids64, mapped, mixed, session, sliding_sums, stored, text_table

#: Words of a window; words of the grams whose smallest hash routes a window.
WINDOW, GRAM = 20, 6
#: Different stretches of a gram from which its shard is cut finer.
MAX_STRETCHES = 256
#: Words of a broadcast shard, and of those that are broadcast at a time.
SHARD_WORDS, PASS_WORDS = 200_000, 2_000_000
#: Words that are cut into stretches at a time.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = -(1 << 63)


class Automaton:
    """A generalised suffix automaton over words of any hashable kind."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                    continue
                new_link = new
            else:
                p, new_link = last, None
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            if new_link is None:
                last = clone
            else:
                link[new_link] = clone

    def matches(self, words) -> list[int]:
        """For each place the length of the longest substring ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        at = n = 0
        out = []
        for w in words:
            q = nxt[at].get(w)
            while q is None and at:
                at = link[at]
                n = length[at]
                q = nxt[at].get(w)
            if q is None:
                n = 0
            else:
                at, n = q, n + 1
            out.append(n)
        return out


def segments(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Cuts the windows of concatenated texts (text k: ``bounds[k]`` to ``bounds[k + 1]``) into runs that share the place of their smallest gram.

    (text, start in the text, windows, hash of the gram, hash of the run's words and of the gram's place in it). A run has at most
    ``window - gram + 1`` windows, of which 62 have a bit in a mask.
    """
    gram = max(gram, window - 61)
    n = len(ids) - window + 1
    none = (np.zeros(0, np.int64),) * 5
    if n <= 0:
        return none
    with np.errstate(over="ignore"):
        g = mixed(sliding_sums(ids, gram, _BASE))
        wide = window - gram + 1
        least, have = g, 1
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        place = np.zeros(n, np.int64)
        for o in range(wide - 1, -1, -1):  # the leftmost of equal ones
            place = np.where(g[o : o + n] == least, o, place)
        at = np.arange(n)
        text = np.searchsorted(bounds, at, "right") - 1
        ok = at + window <= bounds[text + 1]
        place += at
        new = ok & np.concatenate([[True], (place[1:] != place[:-1]) | ~ok[:-1] | (text[1:] != text[:-1])])
        begin = np.flatnonzero(new)
        if not len(begin):
            return none
        run = np.cumsum(new)
        size = np.bincount(run[ok], minlength=run[-1] + 1)[1:]
        end = begin + size + window - 1
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), _BASE, np.uint64)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), _INVERSE, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(ids * powers[:-1])])
        whole = mixed((total[end] - total[begin]) * inverse[begin] + np.uint64(0x51ED270B) * (place[begin] - begin).astype(np.uint64) + size.astype(np.uint64))
    return text[begin], begin - bounds[text[begin]], size, g[place[begin]].view(np.int64), whole.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], seen: dict[bytes, int], more: tuple[str, ...] = ()):
    """(ids of texts, word ids one after another, bounds, other columns) of some texts at a time."""
    own: list[list] = [[] for _ in range(2 + len(more))]
    size = 0

    def out():
        flat = [w for words in own[1] for w in words]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in own[1]])])
        return own[0], ids64(flat, seen), bounds, own[2:]

    for b in batches:
        for k, t in enumerate(b.column("text").cast(pa.binary())):
            words = (t.as_py() or b"").split()
            own[0].append(b.column("id")[k].as_py())
            own[1].append(words)
            for c, name in enumerate(more):
                own[2 + c].append(b.column(name)[k].as_py())
            size += len(words)
            if size >= BLOCK:
                yield out()
                own, size = [[] for _ in range(2 + len(more))], 0
    if own[0]:
        yield out()


def stretches(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, start, n, g, s): the runs of windows of all texts, without their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds, _ in _blocks(batches, {}):
            text, start, n, g, s = segments(words, bounds, window, gram)
            columns = [np.array(ids, np.int64)[text], start.astype(np.int32), n.astype(np.int32), g, s]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "start", "n", "g", "s"])

    return mapped(rows, run, "id long, start int, n int, g long, s long")


def _with_words(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, s, id, start, n, hot, words): the stretches that ``wanted`` (array of (s, hot)) of each row names, with their words' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds, (wanted,) in _blocks(batches, {}, ("wanted",)):
            text, start, n, g, s = segments(words, bounds, window, gram)
            hot = [{(x["start"], x["s"]): x["hot"] for x in w} for w in wanted]
            found = [(k, hot[t].get((a, h))) for k, (t, a, h) in enumerate(zip(text.tolist(), start.tolist(), s.tolist()))]
            found = [(k, h) for k, h in found if h is not None]
            pick = np.array([k for k, _ in found], np.int64)
            at = (bounds[text[pick]] + start[pick]).tolist()
            raw = [words[a : a + m + window - 1].tobytes() for a, m in zip(at, n[pick].tolist())]
            columns = [pa.array(x) for x in (g[pick], s[pick], np.array(ids, np.int64)[text[pick]], start[pick].astype(np.int32), n[pick].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([h for _, h in found], pa.bool_()), pa.array(raw, pa.binary())], ["g", "s", "id", "start", "n", "hot", "words"])

    return mapped(rows, run, "g long, s long, id long, start int, n int, hot boolean, words binary")


def _automata(window: int):
    """Of stretches sorted by gram, then place: which windows an earlier stretch of the gram holds, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for b in batches:
            masks = []
            for g, n, raw in zip(b.column("g").to_pylist(), b.column("n").to_pylist(), b.column("words").to_pylist()):
                words = np.frombuffer(raw, np.uint64).tolist()
                if g != now:
                    now, automaton = g, Automaton()
                    masks.append(0)
                else:
                    masks.append(sum(1 << k for k, m in enumerate(automaton.matches(words)[window - 1 :]) if m >= window))
                automaton.add(words)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("s"), pa.array(masks, pa.int64())], ["g", "s", "mask"])

    return run


def _windows(window: int):
    """(g, s, id, start, o, a, words): each window of a stretch, its place in it and the hash that it is routed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            words = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            with np.errstate(over="ignore"):
                hashes = mixed(np.concatenate([sliding_sums(w, window, 0xD1B54A32D192ED03) for w in words] or [np.zeros(0, np.uint64)])).view(np.int64)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            raw = [w[k : k + window].tobytes() for w, m in zip(words, n.tolist()) for k in range(m)]
            columns = [np.repeat(batch.column(c).to_numpy(), n) for c in ("g", "s", "id", "start")] + [offset.astype(np.int32), hashes]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(raw, pa.binary())], ["g", "s", "id", "start", "o", "a", "words"])

    return run


def _same(window: int):
    """Of pairs of windows that were routed to one shard, the later one's bit where the earlier one's automaton holds it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for b in batches:
            held = []
            for first, own in zip(b.column("first").to_pylist(), b.column("words").to_pylist()):
                if first != now:
                    now, automaton = first, Automaton()
                    automaton.add(np.frombuffer(first, np.uint64).tolist())
                held.append(automaton.matches(np.frombuffer(own, np.uint64).tolist())[-1] >= window)
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("g", "s", "o")], ["g", "s", "o"]).filter(keep)

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_stretches: int = MAX_STRETCHES) -> DataFrame:
    """(id, found array of (start, mask)): bit k of a mask says that the window at start + k also starts earlier.

    Earlier: a smaller id, or the same id and an earlier start; null is the smallest id, given as the least long.
    """
    rows = text_table(docs, id_col, text_col).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NONE)))
    everything = stored(stretches(rows, window, gram), "substring-all")
    recurring = stored(everything.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "substring-grams")
    held = stored(everything.join(recurring, "g", "left_semi"), "substring-held")
    discard(everything)
    discard(recurring)
    first = stored(held.groupBy("g", "s").agg(F.min(F.struct("id", "start")).alias("at")).select("g", "s", "at.id", "at.start"), "substring-first")
    several = stored(first.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "substring-several")
    unsure = first.join(several, "g").select("id", F.struct("start", "s", (F.col("k") > max_stretches).alias("hot")).alias("w"))
    wanted = unsure.groupBy("id").agg(F.collect_list("w").alias("wanted"))  # of one document
    words = stored(_with_words(rows.join(wanted, "id"), window, gram), "substring-words")
    discard(several)
    sorted_words = words.where("not hot").dropDuplicates(["g", "s"]).repartition("g").sortWithinPartitions("g", "id", "start").select("g", "s", "n", "words")
    masks = mapped(sorted_words, _automata(window), "g long, s long, mask long")
    each = stored(mapped(words.where("hot"), _windows(window), "g long, s long, id long, start int, o int, a long, words binary"), "substring-windows")
    place = F.struct("id", (F.col("start") + F.col("o")).alias("place"))
    earliest = stored(each.groupBy("g", "a").agg(F.min(F.struct(place.alias("at"), F.col("words").alias("first"))).alias("x")).select("g", "a", "x.at", "x.first"), "substring-earliest")
    later = each.join(earliest, ["g", "a"]).where(F.col("at") < place).select("g", "s", "o", "first", "words")
    bits = mapped(later, _same(window), "g long, s long, o int").select("g", "s", F.expr("shiftleft(1L, o)").alias("bit"))
    hot_masks = bits.groupBy("g", "s").agg(F.expr("bit_or(bit)").alias("mask"))
    known = stored(first.join(masks.union(hot_masks), ["g", "s"], "left").select("g", "s", F.col("id").alias("first_id"), F.col("start").alias("first_start"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "substring-known")
    for x in (words, each, earliest, first):
        discard(x)
    own = (F.col("id") == F.col("first_id")) & (F.col("start") == F.col("first_start"))
    found = held.join(known, ["g", "s"]).select("id", "start", F.when(own, F.col("mask")).otherwise(F.expr("shiftleft(1L, n) - 1")).alias("mask")).where("mask <> 0")
    return found.groupBy("id").agg(F.collect_list(F.struct("start", "mask")).alias("found"))


def covered(n: int, found: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words stand in one of the found windows."""
    edge = np.zeros(n + window + 1, np.int64)
    start = np.array([x["start"] for x in found or ()], np.int64)
    mask = np.array([x["mask"] for x in found or ()], np.int64)
    for k in range(int(mask.max()).bit_length() if len(mask) else 0):
        at = start[mask >> k & 1 == 1] + k
        at = at[at + window <= n]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """(id, n_words, n_removed, text) of every row of ``docs``: the words, joined by one space, that no window covers whose
    words also start earlier in the corpus. Windows are judged on the texts as they came.

    Null and empty texts have no words. Rows that share an id are one document: none of them is earlier than another at the same
    start, and each loses the words at the places found in any. A null id is the smallest. Texts shorter than a window stay whole. Other columns are not read.
    """
    rows = text_table(docs, id_col, text_col).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NONE)))
    found = repeated_windows(docs, id_col, text_col, window, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, at in zip(b.column("text").cast(pa.binary()), b.column("found").to_pylist()):
                words = (t.as_py() or b"").split()
                n.append(len(words))
                if at:
                    drop = covered(len(words), at, window)
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "text"])

    out = mapped(rows.join(found, "id", "left").select("id", "text", "found"), run, "id long, n_words long, n_removed long, text string")
    return out.withColumn("id", F.when(F.col("id") != _NONE, F.col("id")))


def without_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """(id, n_words, n_removed, text) of every row of ``docs``, without the maximal spans of at least ``window`` words that occur in a
    text of ``reference``.

    Shards of the reference are made to automata and broadcast; a reference of any size takes one pass over ``docs`` for each
    ``pass_words`` words (a text is never cut, so a shard can be longer than ``shard_words`` by one). Nulls and empty texts on either side
    have no words. Rows that repeat, on either side, each count and each get a row; other columns are not read.
    """
    sc = session(docs.sparkSession).sparkContext
    rows = text_table(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text", F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("gone"))

    def searched(rows: DataFrame, shards: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, int] = {}
            for b in batches:
                out = []
                for t, gone in zip(b.column("text").cast(pa.binary()), b.column("gone").to_pylist()):
                    ids = ids64((t.as_py() or b"").split(), seen).tolist()
                    found = list(gone)
                    for shard in shards:
                        m = shard.value.matches(ids)
                        # A span is maximal where the next place does not go on with it.
                        found += [{"start": k + 1 - n, "end": k + 1} for k, n in enumerate(m) if n >= window and (k + 1 == len(m) or m[k + 1] != n + 1)]
                    out.append(found)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(out, b.column("gone").type)], ["id", "text", "gone"])

        return mapped(rows, run, rows.schema)

    shards, own, n, total = [], Automaton(), 0, 0
    for (t,) in reference.select(F.col(text_col).cast("string")).toLocalIterator():
        words = ids64((t or "").encode().split(), {}).tolist()
        own.add(words)
        n, total = n + len(words), total + len(words)
        if n >= shard_words:
            shards.append(sc.broadcast(own))
            own, n = Automaton(), 0
        if total >= pass_words:
            rows = stored(searched(rows, shards + ([sc.broadcast(own)] if n else [])), "substring-pass")
            shards, own, n, total = [], Automaton(), 0, 0
    if n:
        shards.append(sc.broadcast(own))
    rows = searched(rows, shards) if shards else rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, spans in zip(b.column("text").cast(pa.binary()), b.column("gone").to_pylist()):
                words = (t.as_py() or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for x in spans:
                    edge[x["start"]] += 1
                    edge[x["end"]] -= 1
                left = [w for w, d in zip(words, np.cumsum(edge).tolist()) if not d]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "text"])

    return mapped(rows, cut, "id long, n_words long, n_removed long, text string")


def op6_suffix_automata(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 18))) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
