"""Quality rules on repetition within a text, from suffix arrays.

The suffixes of many texts are sorted together (none runs into the next); the longest common prefix of
neighbours in that order gives, for every position, the longest substring that the same text holds elsewhere. Those substrings, the
maximal repeats, cover spans whose union and longest member are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_WORDS, mapped, text_table

#: Words of the shortest repeat that counts.
MIN_REPEAT = 8
#: Words that are sorted together; a longer text is sorted alone.
BATCH = 1 << 18
#: Rules: least words, most percent of words in repeats, and the longest repeat in percent of the words.
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LONGEST_PERCENT = 20, 30, 20
#: A repeat of no more words than this is never too long.
LONGEST_FREE = 32
SYMBOLS = b"#*$%&|<>"


def suffix_array(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order of the suffixes within each text, texts one after another, and (depth, rank by the first
    ``depth`` symbols) of each round. ``codes`` are at least 1; each text ends with one 0, and ``text`` is its number."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    depth = max(1, (62 - int(text[-1] + 1).bit_length()) // bits)
    key = text.astype(np.int64)
    for j in range(depth):
        key = key << bits
        key[: max(n - j, 0)] |= codes[j:]  # what follows a text's 0 cannot matter: its 0 is in no two suffixes' common prefix
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(at, size)
    levels = [(depth, rank.copy())]
    while True:
        places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(places):
            return order, levels
        who = order[places]
        nxt = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)], -1)
        by = np.lexsort((nxt, rank[who]))
        who, nxt = who[by], nxt[by]
        order[places] = who
        start = np.zeros(n, bool)
        start[at] = True
        start[places] |= np.concatenate([[True], (np.diff(rank[who]) != 0) | (np.diff(nxt) != 0)])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, n))
        rank[who] = np.repeat(at, size)[places]
        depth *= 2
        levels.append((depth, rank.copy()))


def common_prefixes(codes: np.ndarray, text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before it, within a text."""
    n = len(codes)
    out = np.zeros(n, np.int64)
    who = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
    a, b = order[who - 1], order[who]
    same = codes[a] == codes[b]
    who, a, b = who[same], a[same], b[same]
    for depth, rank in reversed(levels):
        while len(who):
            inside = np.maximum(a, b) < n
            same = np.zeros(len(who), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            if not same.any():
                break
            out[who[same]] += depth
            a, b = a + depth * same, b + depth * same
            if depth != levels[0][0]:
                break
    left = np.arange(len(who))
    while len(left):  # fewer than the first depth
        x, y = a[left], b[left]
        same = (np.maximum(x, y) < n) & (codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)]) & (codes[np.minimum(x, n - 1)] > 0)
        left = left[same]
        out[who[left]] += 1
        a[left] += 1
        b[left] += 1
    return out


def repeats(texts: list[list[bytes]], least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in repeats of at least ``least`` words, the longest repeat (0 if shorter than
    ``least``), and for all texts, one after another and each followed by False, whether a word is covered."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    codes = np.array([c for words in texts for c in (*[put(w, len(seen) + 1) for w in words], 0)], np.int64)
    sizes = np.array([len(x) + 1 for x in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    order, levels = suffix_array(codes, text)
    lcp = common_prefixes(codes, text, order, levels)
    best = np.zeros(len(codes), np.int64)  # of a suffix with either neighbour
    best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    long = np.flatnonzero(best >= least)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + best[long], -1)
    covered = np.cumsum(edge)[:-1] > 0
    begin = np.cumsum(sizes) - sizes
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text[long], best[long])
    return np.add.reduceat(covered, begin, dtype=np.int64), longest, covered


def _line_repeats(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_longest_percent: int = MAX_LONGEST_PERCENT, longest_free: int = LONGEST_FREE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept), a row for each row.

    ``n_repeat_words``: words in windows of ``min_repeat`` words that the text holds twice or more, which are
    the union of its maximal repeats of at least that length. ``base_failed``: too few words or too large a
    covered fraction. ``kept``: not ``base_failed``, and the longest repeat is at most ``longest_free`` words or
    ``max_longest_percent`` of the words. Null and empty texts have no words and fail. Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            covered, longest, _ = repeats([w for _, w, *_ in held], min_repeat)
            columns = [(i, len(w), c, s, d, int(r), int(m)) for (i, w, c, s, d), r, m in zip(held, covered, longest)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*columns)], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary())):
                t = t.as_py() or b""
                words = t.split()
                chars = len(b"".join(words).decode())
                held.append((i, words, chars, len(t) - len(t.translate(None, SYMBOLS)), _line_repeats(t)))
                size += len(words)
                if size >= BATCH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = mapped(text_table(docs, id_col, text_col), run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    short = (F.col("longest_repeat") <= longest_free) | (100 * F.col("longest_repeat") <= max_longest_percent * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & short)


def op2_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    found = repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id").drop("longest_repeat")


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {SQL_WORDS} AS w FROM documents),
eight AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM d)),
twice AS (SELECT k, i FROM eight QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
long33 AS (SELECT DISTINCT k FROM (SELECT k, array_to_string(w[i:i + 32], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - 31))) AS i FROM d)) GROUP BY k, s HAVING count(*) > 1),
longest AS (SELECT DISTINCT k FROM (SELECT k, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT k, w, greatest(33, len(w) // 5 + 1) AS m, unnest(range(1, greatest(1, len(w) - greatest(33, len(w) // 5 + 1) + 2))) AS i FROM d JOIN long33 USING (k))) GROUP BY k, s HAVING count(*) > 1),
measured AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, longest.k IS NOT NULL AS too_long
  FROM d LEFT JOIN covered USING (k) LEFT JOIN lines USING (k) LEFT JOIN longest USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT too_long AS kept
FROM measured
"""
