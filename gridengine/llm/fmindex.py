"""Benchmark decontamination by an FM-index per training shard.

A task cuts its documents into shards of bounded length and maps words to the benchmark's vocabulary; a run of other words is one
symbol that no window holds, so the index is over every word of the shard that a window could have. It sorts the shard's suffixes
and keeps the Burrows-Wheeler transform in a wavelet matrix. Benchmark windows are searched backwards, all at once; occurrences are
located by walking to sampled suffix positions, and their spans are merged per document. Nothing is shuffled. A benchmark is broadcast
in parts of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, session, stored, text_table

#: Words of an item that make a window.
WINDOW = 10
#: Words of a shard: a task holds one at a time. Longer documents are cut, with an overlap of a window.
SHARD = 1 << 20
#: Every so many suffix positions are kept.
SAMPLE = 16
#: Bytes of benchmark texts that are broadcast at a time; a larger benchmark takes more passes.
PART = 4 << 20
#: Lower-cases A-Z; every other ASCII character that is not a digit or a letter becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
OTHER = 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


@dataclass
class Phrases:
    """Distinct windows of the benchmark by length, and the items that have each."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]  # length -> codes (windows, length)
    first: dict[int, int]  # length -> number of its first window
    items: list[list[str]]  # window -> ids

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)

    @property
    def longest(self) -> int:
        return max(self.by_length, default=0)


def phrases(items: list[tuple[object, bytes]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item_id, text in items:
        codes = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)]
        if not codes:
            continue
        size = min(window, len(codes))
        for i in range(len(codes) - size + 1):
            ids = found.setdefault(size, {}).setdefault(tuple(codes[i : i + size]), set())
            if item_id is not None:
                ids.add(str(item_id))
    by_length, first, owners = {}, {}, []
    for size, own in sorted(found.items()):
        by_length[size], first[size] = np.array(list(own), np.int32), len(owners)
        owners += [sorted(x) for x in own.values()]
    return Phrases(vocabulary, by_length, first, owners)


def suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the sorted suffixes of ``codes``, whose last entry is the only 0. Prefix doubling; a round
    sorts only suffixes that still tie."""
    n, depth = len(codes), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[: max(n - j, 0)] |= codes[j:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    at = np.flatnonzero(new)
    group = np.repeat(at, np.diff(np.append(at, n)))
    rank[order] = group
    while True:
        size = np.diff(np.append(at, n))
        tied = np.repeat(size > 1, size)  # by place in the order
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        who = order[places]
        nxt = np.zeros(len(who), np.int64)
        inside = who + depth < n
        nxt[inside] = rank[who[inside] + depth] + 1
        by = np.lexsort((nxt, rank[who]))
        who, nxt = who[by], nxt[by]
        order[places] = who
        start = np.zeros(n, bool)
        start[at] = True
        start[places] |= np.concatenate([[True], (np.diff(rank[who]) != 0) | (np.diff(nxt) != 0)])
        at = np.flatnonzero(start)
        group = np.repeat(at, np.diff(np.append(at, n)))
        rank[who] = group[places]
        depth *= 2


class Wavelet:
    """Wavelet matrix: symbol at a place, and how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.blocks, self.zeros = bits, [], [], []
        seq = symbols
        n = len(seq)
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.zeros((n >> 6) + 1 << 3, np.uint8)
            row = np.packbits(bit, bitorder="little")
            packed[: len(row)] = row
            packed = packed.view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            ones = bit.astype(bool)
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[k][at >> 6] + np.bitwise_count(self.words[k][at >> 6] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        symbol, lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            one = self._ones(k, hi + 1) > b
            symbol = symbol << 1 | one
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    def __init__(self, codes: np.ndarray, sigma: int, sample: int = SAMPLE):
        """``codes``: symbols 1 to ``sigma`` - 1."""
        codes = np.append(codes, 0).astype(np.int64)
        self.n, self.bits = len(codes), max(1, int(sigma - 1).bit_length())
        order = suffix_order(codes, self.bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        self.wavelet = Wavelet(codes[order - 1], self.bits)
        kept = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept].astype(np.int32)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and their rows' ranges in the suffix order."""
        who = np.arange(len(windows))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[who, j].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]
            alive = hi > lo
            who, lo, hi = who[alive], lo[alive], hi[alive]
            if not len(who):
                break
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix order: backward steps up to a sampled position."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            kept = self.marks[at + 1] > self.marks[at]
            out[left[kept]] = self.positions[self.marks[at[kept]]] + steps
            left, at = left[~kept], at[~kept]
            if len(left):
                symbol, rank = self.wavelet.symbol_rank(at)
                at, steps = self.below[symbol] + rank, steps + 1
        return out


def occurrences(codes: np.ndarray, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, window numbers, positions) of all windows in ``codes``, by an index over all of it; runs of foreign words are one symbol."""
    own = np.concatenate([[False], codes > OTHER, [False]])
    edge = np.flatnonzero(own[1:] != own[:-1])
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return
    size = ends - begins + 1  # a separator after each
    offset = np.cumsum(size) - size
    places = np.arange(int(size.sum())) - np.repeat(offset - begins, size)
    text = codes[np.minimum(places, len(codes) - 1)].copy()
    text[offset + size - 1] = OTHER
    index = FMIndex(text, len(p.vocabulary) + 2)
    for length, windows in p.by_length.items():
        who, lo, hi = index.search(windows)
        if len(who):
            count = hi - lo
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)
            yield length, np.repeat(who + p.first[length], count), places[index.locate(rows)]


def _encode(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, OTHER) for w in words], np.int32)


class Shard:
    """Documents' codes until they are enough for an index; then (spans, items) of each document."""

    def __init__(self, p: Phrases, limit: int = SHARD):
        self.p, self.limit, self.parts, self.size = p, limit, [], 0

    def add(self, words: list[bytes]) -> bool:
        self.parts.append(_encode(words, self.p.vocabulary))
        self.size += len(words) + 1
        return self.size >= self.limit

    def results(self) -> list[tuple[list[tuple[int, int]], list[str]]]:
        p, parts = self.p, self.parts
        begin = np.cumsum([0] + [len(x) + 1 for x in parts])
        codes = np.full(int(begin[-1]), OTHER, np.int32)
        for b, x in zip(begin, parts):
            codes[b : b + len(x)] = x
        self.parts, self.size = [], 0
        edge = np.zeros(len(codes) + 1, np.int32)
        pairs = set()
        step = self.limit
        for at in range(0, len(codes) if p.by_length else 0, step):  # more than one only if a document is very long
            piece = codes[at : at + step + p.longest - 1]
            for length, which, where in occurrences(piece, p):
                where = where + at
                np.add.at(edge, where, 1)
                np.add.at(edge, where + length, -1)
                doc = np.searchsorted(begin, where, "right") - 1
                pairs.update(map(tuple, np.unique(np.stack([doc, which], 1), axis=0).tolist()))
        items: dict[int, set[str]] = {}
        for doc, which in pairs:
            items.setdefault(doc, set()).update(p.items[which])
        covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        change = np.flatnonzero(covered[1:] != covered[:-1])
        spans: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
            doc = int(np.searchsorted(begin, a, "right")) - 1
            spans.setdefault(doc, []).append((a - int(begin[doc]), b - int(begin[doc])))
        return [(spans.get(k, []), sorted(items.get(k, ()))) for k in range(len(begin) - 1)]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, part: int) -> list:
    """The benchmark's windows, broadcast in parts of about ``part`` bytes of text, dealt by a hash of the item."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // part))
    sc = session(benchmark.sparkSession).sparkContext
    out = []
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        out.append(sc.broadcast(phrases([(r["item"], (r["text"] or "").encode()) for r in own.collect()], window)))
    return out


_FOUND = "array<struct<start: long, end: long>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _searched(batches: Iterator[pa.RecordBatch], p: Phrases, text_col: str, shard: int, before: tuple[str, str] | None):
    """(batch, texts, spans and items of each row) of some rows at a time, with what earlier passes found."""
    index, held = Shard(p, shard), []

    def out():
        found = iter(index.results())
        for b, values, sizes in held:
            own = [next(found) for _ in values]
            if before:
                earlier = zip(*(b.column(c).to_pylist() for c in before))
                own = [(_joined(s, [(x["start"], x["end"]) for x in es]), sorted({*i, *ei})) for (s, i), (es, ei) in zip(own, earlier)]
            yield b, values, sizes, own

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            values, sizes, full = b.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist(), [], False
            for v in values:
                words = words_of(v or b"")
                sizes.append(len(words))
                full = index.add(words) or full
            held.append((b, values, sizes))
            if full:
                yield from out()
                held = []
    if held:
        yield from out()


def _passes(docs: DataFrame, parts: list, text_col: str, shard: int) -> tuple[DataFrame, tuple[str, str] | None]:
    """``docs`` after a pass for each part of the benchmark but the last, with two columns for what these found, if there are any."""
    if len(parts) == 1:
        return docs, None
    extra = "__fm_spans", "__fm_items"
    names = docs.columns
    docs = docs.withColumns({extra[0]: F.expr(f"cast(array() as {_FOUND})"), extra[1]: F.expr("cast(array() as array<string>)")})
    for given in parts[:-1]:

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for b, _, _, own in _searched(batches, given.value, text_col, shard, extra):
                spans = pa.array([[{"start": x, "end": y} for x, y in s] for s, _ in own], _FOUND_TYPE)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), spans, pa.array([i for _, i in own], pa.list_(pa.string()))], [*names, *extra])

        docs = stored(mapped(docs, run, docs.schema), "fm-pass")
    return docs, extra


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard: int = SHARD, part: int = PART
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row of ``docs``: merged spans [start, end) in words of all
    occurrences of benchmark windows, and the sorted ids of the items they come from.

    Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. An item of fewer words than
    ``window`` is one window; one without words is none. Null texts have no words. An item with a null id
    marks words but is not listed. Items that share an id count once. Rows that repeat each get a row. Empty tables give no rows or no hits.
    Other columns are not read.
    """
    parts = _parts(benchmark, item_col, item_text_col, window, part)
    rows, before = _passes(text_table(docs, id_col, text_col), parts, "text", shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, sizes, own in _searched(batches, parts[-1].value, "text", shard, before):
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([sum(y - x for x, y in s) for s, _ in own], pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in s] for s, _ in own], _FOUND_TYPE),
                    pa.array([i for _, i in own], pa.list_(pa.string())),
                ],
                ["id", "n_words", "n_hit", "spans", "items"],
            )

    return mapped(rows, run, f"id long, n_words long, n_hit long, spans {_FOUND}, items array<string>")


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """``raw`` without the words of the spans, from the first one's start to the last one's end; a space stays between what a cut parted."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]].rstrip(b" "))
        last = at[b - 1][1]
    out.append(raw[last:].lstrip(b" "))
    return b" ".join(x for x in out if x).decode()


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard: int = SHARD, part: int = PART
) -> DataFrame:
    """``docs`` with every word that lies in an occurrence of a benchmark window cut out of its text. All rows and columns stay, repeated
    rows and null texts too; an empty benchmark changes nothing."""
    parts = _parts(benchmark, item_col, item_text_col, window, part)
    names = docs.columns
    rows, before = _passes(docs, parts, text_col, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values, _, own in _searched(batches, parts[-1].value, text_col, shard, before):
            new = pa.array([None if v is None else _cut(v, s) if s else v.decode() for v, (s, _) in zip(values, own)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in names], names)

    return mapped(rows, run, docs.schema)


def op9_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrases USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
