"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is cut into more blocks than ``distance``; two fingerprints within ``distance`` bits agree on all
blocks but that many, so every close pair meets under at least one key (block numbers and their bits).
Only distinct fingerprints are joined. A key's group is cut into chunks of at most ``CHUNK`` rows, and each pair of chunks is one
group of at most twice that, whatever the key's share of the data; a group gives a spanning forest of its
close pairs, never all of them. Components come from alternating star contractions on written tables.

A few bits of the shingles' fingerprint tell copies with few edits. For a similarity of shingles (0.8 of five words), all
different texts meet again by a prefix filter: with shingles in one order for all texts, the rarest first, two sets that are
alike share one of their first shingles, so no pair is missed. What meets is told apart by counts of shingles in ranges of their
hashes, which bound what two sets can have in common and are a small part of them; what is left is compared on the whole sets, in
passes, so that their copies take disk in proportion to the texts however many pairs there are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, discard, ids64, mapped, mixed, popcount, session, sliding_sums, stored, text_table, texts

#: Rows of a chunk of a key's group.
CHUNK = 4096
#: Rows that may meet under a key by chance, before keys are made longer.
MEET = 256
#: Most texts under one shingle whose pairs are all listed, and rows of a chunk where there are more.
LISTED, SET_CHUNK = 64, 512
#: Rows of a chunk where only histograms are compared, for one of ``SET_CHUNK``. Words of 64 bits that mark texts to read again.
WIDER, MARKS = 8, 1 << 17
#: Shingles that are counted at a time, and most frequent ones that are broadcast; they only order the others.
COUNTED, FREQUENT = 1 << 21, 1 << 17


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is set if it is set in over half the XXH64 (seed 42) of the lower-cased word shingles.

    Fewer words than ``shingle``: their whole sequence is one shingle. No words: 0.
    """
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # long texts in pieces
        stop = min(n, at + (1 << 15))
        pairs = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def sketch(text: bytes, shingle: int = 5, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """Hashes of the different shingles of the whole text, sorted. Fewer words than ``shingle``: they are one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(mixed(sliding_sums(ids64(words, {} if seen is None else seen), min(shingle, len(words)), 0x9E3779B97F4A7C15)))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles. Two texts without words are the same."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def histogram(sketch: np.ndarray) -> bytes:
    """How many of the sorted hashes are in each of 2^k equal ranges, two to four on average; nothing if a count is over 255."""
    bits = max(0, len(sketch).bit_length() - 2)
    counts = np.bincount((sketch >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(sketch)])
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Histograms (rows) of fewer ranges."""
    return counts.reshape(len(counts), width, -1).sum(2, dtype=np.uint16) if counts.shape[1] > width else counts


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """For rows of histograms, and the sizes of both sets together: false where the sets can't have ``similarity`` in common."""
    if not a.shape[1] or not b.shape[1]:
        return np.ones(max(len(a), len(b)), bool)
    width = min(a.shape[1], b.shape[1])
    common = np.minimum(folded(a, width), folded(b, width)).sum(1, dtype=np.int64)
    return common >= similarity * (n - common) - 1e-6


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, own: bool = False) -> DataFrame:
    """(id long, fp long): the fingerprint's 64 bits as a signed long; ``own``, the text's XXH64, if asked for. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array(np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), fps, *([b.column("own")] if own else [])], ["id", "fp", "own"][: 2 + own])

    rows = text_table(docs, id_col, text_col)
    return mapped(rows.withColumn("own", F.xxhash64("text")) if own else rows, run, "id long, fp long" + ", own long" * own)


def forest(fps: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smaller, larger node) of a spanning forest of the graph of fingerprints within ``distance``."""
    a, b = [], []
    left = np.arange(len(fps))
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        if not len(left):
            break
        near = popcount(fps[left] ^ fps[at]) <= distance
        if near.any():
            hit = left[near]
            left = left[~near]
            queue.extend(hit.tolist())
            a.append(np.minimum(nodes[hit], nodes[at]))
            b.append(np.maximum(nodes[hit], nodes[at]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def nearest_forest(fps: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, with the shortest edges: each node hangs on the nearest of those before it (Prim)."""
    n = len(fps)
    far, parent, left = np.full(n, 255, np.uint8), np.full(n, -1), np.ones(n, bool)
    a, b = [], []
    at = 0
    for _ in range(n):
        left[at] = False
        if far[at] <= distance:
            a.append(nodes[parent[at]])
            b.append(nodes[at])
        d = popcount(fps ^ fps[at])
        closer = left & (d < far)
        far[closer], parent[closer] = d[closer], at
        rest = np.where(left, far, 255)
        at = int(rest.argmin()) if left.any() else at
        if not left[at]:
            at = int(left.argmax())
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _group_edges(distance: int):
    """Edges within runs of equal keys of partitions sorted by key; one run at a time is held."""

    def small(key: np.ndarray, fps: np.ndarray, nodes: np.ndarray, begins: np.ndarray, size: np.ndarray):
        """Groups of 2 to 8 rows, all at once: row against the row ``lag`` before it."""
        for lag in range(1, 8):
            ok = np.flatnonzero(key[lag:] == key[:-lag])
            ok = ok[popcount(fps[ok + lag] ^ fps[ok]) <= distance]
            ok = ok[size[ok] <= 8]
            if len(ok):
                yield np.minimum(nodes[ok], nodes[ok + lag]), np.maximum(nodes[ok], nodes[ok + lag])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(parts: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            g, ci, cj = (t.column(c).to_numpy() for c in ("g", "ci", "cj"))
            fps, nodes = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])])
            begins = np.flatnonzero(new)
            if not last:  # the last group may go on in the next batch
                held[:] = [t.slice(int(begins[-1])).to_batches()[0]]
                n = int(begins[-1])
                new, fps, nodes, begins = new[:n], fps[:n], nodes[:n], begins[:-1]
                if not n:
                    return
            else:
                held.clear()
            key = np.cumsum(new)
            sizes = np.diff(np.append(begins, len(fps)))
            size = np.repeat(sizes, sizes)
            edges = list(small(key, fps, nodes, begins, size))
            for k in np.flatnonzero(sizes > 8):
                s = slice(begins[k], begins[k] + sizes[k])
                edges.append(forest(fps[s], nodes[s], distance))
            a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= 20_000:
                    yield from out(list(held), False)
        if held:
            yield from out(list(held), True)

    return run


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(u, v): enough of the pairs within ``distance`` of the table (node long, fp long) to connect all that are
    connected by such pairs.

    Of ``blocks`` all but ``distance`` make a key. By default there are two more than ``distance``, and more for very many rows: more blocks
    give more and longer keys, so that few rows meet under one by chance (``MEET``).
    """
    if blocks is None:
        n, blocks = nodes.count(), distance + 2
        while n >> (64 * (blocks - distance) // blocks) > MEET and blocks < distance + 6:
            blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [(edges[k], edges[k + 1] - edges[k]) for k in range(blocks)]

    def bits(k: int):
        at, width = cut[k]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, cut[k][1]).bitwiseOR(bits(k))
        keys.append(key)
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("g"))
    # Only keys of very many rows are counted out; all rows are dealt, as many whatever the keys have in common.
    hot = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = stored(hot.select("g", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts")), "simhash-hot")
    dealt = (
        rows.join(hot, "g", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .select("g", "node", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("g", "node", "fp", F.least("c", "other").alias("ci"), F.greatest("c", "other").alias("cj"))
    )
    together = dealt.repartition("g", "ci", "cj").sortWithinPartitions("g", "ci", "cj", "node")
    return mapped(together, _group_edges(distance), "u long, v long").distinct()


def _instead(df: DataFrame, name: str, *old: DataFrame) -> DataFrame:
    """``df`` as a table, and the tables that it came from removed."""
    new = stored(df, name)
    for x in old:
        discard(x)
    return new


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u < v) reaches, by alternating
    large and small star contractions. Minima are aggregated before the shuffle and joined from a written
    table, so that a node with very many links is split. Goes on until a round changes nothing."""
    edges = stored(edges.select("u", "v"), "star")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        edges = _instead(large, "star-large", edges, least)
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from each node to its smaller ones
        least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "star-min")
        small = down.join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        edges = _instead(small, "star-small", edges, least)
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select("u", "u").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component) of every row of ``docs``: the smallest id reachable by links of at most
    ``distance`` differing bits.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with the same id and
    different texts each get a row; a null id gets a row and links its fingerprint to nothing. An empty
    table gives an empty table. Other columns of ``docs`` are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    nodes = stored(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    found = components(links(nodes, distance))
    known = stored(nodes.join(found, "node", "left").select(F.col("fp"), F.coalesce("component", "node").alias("component")), "simhash-components")
    return fps.join(known, "fp", "left").select("id", "fp", "component")


def frequent(own: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles of (own, text) and about how many texts have each, to put rare ones first.

    Correct whatever it finds: the order is only the same for all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

        for b in batches:
            for t in texts(b):
                held.append(sketch(t, shingle, seen))
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    size = 0
        if held:
            yield out()

    counts = mapped(own, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(own: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(own, n, prefix, counts) of the different texts of (own, text) that have words: the number of shingles, and of these, the rarest first,
    as many as two sets of which ``similarity`` is common can't both have without sharing one: all but ``similarity`` of them, and one;
    and the ``histogram`` of all."""
    given = session(own.sparkSession).sparkContext.broadcast(frequent(own, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        known, counts = given.value
        for b in batches:
            sizes, firsts, counted = [], [], []
            for t in texts(b):
                s = sketch(t, shingle, seen)
                counted.append(histogram(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                sizes.append(len(s))
                firsts.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary()), pa.array(counted, pa.binary())], ["own", "n", "prefix", "counts"])

    return mapped(own, run, "own long, n int, prefix binary, counts binary").where("n > 0").dropDuplicates(["own"])


def _listed(similarity: float):
    """Pairs (u < v) of different components within runs of equal ``g`` of sorted partitions that can be similar by their sizes and by
    what is left of both after the shingle, if that is their first common one."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        g, node, comp, n, at = (t.column(c).to_numpy() for c in ("g", "node", "comp", "n", "at"))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ok = np.arange(len(g))
        for lag in range(1, len(g)):
            ok = ok[ok + lag < len(g)]
            ok = ok[g[ok + lag] == g[ok]]
            if not len(ok):
                break
            i, j = ok, ok + lag
            most = np.minimum(n[i] - at[i], n[j] - at[j])
            near = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            near &= most >= similarity / (1 + similarity) * (n[i].astype(np.int64) + n[j]) - 1e-6
            u.append(np.minimum(node[i[near]], node[j[near]]))
            v.append(np.maximum(node[i[near]], node[j[near]]))
        found = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("g").to_numpy()
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                held = t.slice(last).to_batches()
                yield pairs(t.slice(0, last))
        if sum(x.num_rows for x in held):
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def similar_forest(sets: list[np.ndarray], nodes: np.ndarray, comps: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Edges (smaller, larger node) that, with the known components, connect all that pairs of ``similarity`` connect: each node is
    compared with all that aren't yet connected to those before it, and only a pair that is similar is an edge."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(n) - n
    left = np.ones(len(sets), bool)
    u, v, queue = [], [], []
    rest_owner, rest_code = owner, code
    while left.any() or queue:
        if not queue:
            start = left & (comps == comps[int(left.argmax())])
            left &= ~start
            queue = np.flatnonzero(start).tolist()
        if not left.any():
            break
        at = queue.pop()
        if len(rest_owner) > 2 * n[left].sum():
            keep = left[rest_owner]
            rest_owner, rest_code = rest_owner[keep], rest_code[keep]
        marked = np.zeros(len(kinds), bool)
        marked[code[begins[at] : begins[at] + n[at]]] = True
        common = np.bincount(rest_owner[marked[rest_code]], minlength=len(sets))
        hit = left & (common / (n + n[at] - common) >= similarity)
        if hit.any():
            for k in np.flatnonzero(hit).tolist():
                u.append(min(int(nodes[k]), int(nodes[at])))
                v.append(max(int(nodes[k]), int(nodes[at])))
            more = left & np.isin(comps, comps[hit])
            left &= ~more
            queue += np.flatnonzero(more).tolist()
    return u, v


def possible_forest(rows: list[tuple], similarity: float) -> tuple[list[int], list[int]]:
    """Edges (smaller, larger node) between different components of rows (node, comp, n, at, counts) that are ``possible``, enough to
    connect all that such pairs connect."""
    near = _Possible(rows, similarity)
    left = np.ones(len(rows), bool)
    u, v, queue = [], [], []
    while left.any() or queue:
        if not queue:
            start = left & (near.comp == near.comp[int(left.argmax())])
            left &= ~start
            queue = np.flatnonzero(start).tolist()
        if not left.any():
            break
        at = queue.pop()
        hit = near.of(at, left)
        if len(hit):
            u += np.minimum(near.node[hit], near.node[at]).tolist()
            v += np.maximum(near.node[hit], near.node[at]).tolist()
            more = left & np.isin(near.comp, near.comp[hit])
            left &= ~more
            queue += np.flatnonzero(more).tolist()
    return u, v


def possible_rows(rows: list[tuple], similarity: float) -> list[int]:
    """The nodes of the rows that make a ``possible`` pair with one of another component."""
    near = _Possible(rows, similarity)
    some = np.zeros(len(rows), bool)
    after = np.ones(len(rows), bool)
    for at in range(len(rows)):
        after[at] = False
        hit = near.of(at, after & ~some if some[at] else after)
        some[hit] = True
        some[at] |= len(hit) > 0
    return near.node[some].tolist()


class _Possible:
    """Rows (node, comp, n, at, counts) that have a shingle in common, histograms of one width together."""

    def __init__(self, rows: list[tuple], similarity: float):
        self.node, self.comp, self.n, self.at = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        self.similarity = similarity
        self.width = np.array([len(r[4]) for r in rows])
        self.place = np.zeros(len(rows), np.int64)
        self.counts: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.counts[w] = np.frombuffer(b"".join(rows[k][4] for k in own), np.uint8).reshape(len(own), w)

    def of(self, at: int, among: np.ndarray) -> np.ndarray:
        """Which of the rows ``among`` make a possible pair with row ``at``, by sizes, by what follows the common shingle if it is
        the first one, and by histograms."""
        n, s = self.n + self.n[at], self.similarity
        ok = among & (self.comp != self.comp[at]) & (np.minimum(self.n, self.n[at]) >= s * np.maximum(self.n, self.n[at]) - 1e-9)
        ok &= np.minimum(self.n - self.at, self.n[at] - self.at[at]) >= s / (1 + s) * n - 1e-6
        ok = np.flatnonzero(ok)
        hit = [np.zeros(0, np.int64)]
        own = self.counts[int(self.width[at])][self.place[at]][None]
        for w in np.unique(self.width[ok]).tolist():
            k = ok[self.width[ok] == w]
            hit.append(k[possible(self.counts[w][self.place[k]], own, n[k], s)])
        return np.concatenate(hit)


def _runs(columns: tuple[str, ...], f: Callable[[tuple, list[tuple]], pa.RecordBatch]):
    """``f`` of the rows (``columns``) of each run of equal (g, ci, cj) of sorted partitions; one run at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for b in batches:
            for g, ci, cj, *row in zip(*(b.column(c).to_pylist() for c in ("g", "ci", "cj", *columns))):
                if (key := (g, ci, cj)) != own and rows:
                    yield f(own, rows)
                    rows = []
                own = key
                rows.append(row)
        if rows:
            yield f(own, rows)

    return run


def _dealt(rows: DataFrame, chunk: int, *columns: str) -> DataFrame:
    """(g, ci, cj, node, ``columns``): each two chunks of at most about ``chunk`` rows of a g are a group, for rows that tell the number ``m`` of their g's."""
    parts = F.ceil(F.col("m") / F.lit(chunk)).cast("int")
    return (
        rows.withColumn("c", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .select("g", "node", *columns, "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("g", "node", *columns, F.least("c", "other").alias("ci"), F.greatest("c", "other").alias("cj"))
    )


def _sketches(own: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(own, sketch) of the texts of (own, text) that ``ids`` names. Marks of a fixed size go to the texts, which are not dealt out."""
    found = ids.groupBy(F.expr("shiftrightunsigned(own, 47)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(own & 63 AS int)))").alias("bits")).toArrow()
    marks = np.zeros(MARKS, np.uint64)
    marks[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    given = session(own.sparkSession).sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            x = b.column("own").to_numpy().view(np.uint64)
            b = b.filter(pa.array((given.value[x >> np.uint64(47)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)))
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array([sketch(t, shingle, seen).tobytes() for t in texts(b)], pa.binary())], ["own", "sketch"])

    return mapped(own, run, "own long, sketch binary").dropDuplicates(["own"]).join(ids, "own", "left_semi")


def _in_passes(rows: DataFrame, key: list[str], size: str, most: int, one: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Written results of ``one`` for parts of ``rows``, by a hash of ``key``, with at most about ``most`` shingles (the sum of ``size``) each."""
    total = rows.agg(F.expr(f"sum({size})")).first()[0] or 0
    passes = math.ceil(total / most) if most else 0
    return [one(rows.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == k) if passes > 1 else rows) for k in range(passes if total else 0)]


def _joined(tables: list[DataFrame], like: DataFrame) -> DataFrame:
    for t in tables:
        like = like.union(t)
    return like


def similar_links(docs: DataFrame, known: DataFrame, similarity: float, text_col: str = "text", shingle: int = 5, listed: int = LISTED, chunk: int = SET_CHUNK, most: int | None = None) -> DataFrame:
    """(u, v): pairs of texts (their ``own``) of which ``similarity`` of the shingles are common, enough to connect, with the components
    of ``known`` (own, comp), all that are connected by such pairs. Exact but for equal 64-bit hashes.

    Whole sets of at most about ``most`` shingles are on disk at once, copies for pairs and groups included; by default a quarter of those of all texts.
    """
    own = text_table(docs, text_col, text_col).select(F.xxhash64("text").alias("own"), "text")
    first = stored(prefixes(own, similarity, shingle).join(known, "own"), "simhash-prefixes")
    if most is None:
        most = max(1 << 20, (first.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // 4)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            if not sizes.sum():
                continue
            columns = [np.repeat(b.column(c).to_numpy(), sizes) for c in ("own", "comp", "n")]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(parts), *columns, at.astype(np.int32))], ["g", "node", "comp", "n", "at"])

    rows = mapped(first.select("own", "comp", "n", "prefix"), exploded, "g long, node long, comp long, n int, at int")
    many = stored(rows.groupBy("g").agg(F.count("*").alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b")).where(F.col("m") > listed), "simhash-many")
    few = rows.join(many.select("g"), "g", "left_anti").repartition("g").sortWithinPartitions("g")
    pairs = stored(mapped(few, _listed(similarity), "u long, v long").distinct(), "simhash-pairs")
    crowd = stored(rows.join(many.where("a <> b").select("g", "m"), "g").select("g", "m", "node", "comp", "n", "at"), "simhash-crowd")
    told = lambda s: first.select(F.col("own").alias(s), F.col("n").alias(f"{s}_n"), F.col("counts").alias(f"{s}_counts"))

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("u_n").to_numpy().astype(np.int64) + b.column("v_n").to_numpy()
            sides = ([np.frombuffer(x, np.uint8)[None] for x in b.column(f"{s}_counts").to_pylist()] for s in "uv")
            ok = pa.array([bool(possible(x, y, k, similarity)[0]) for x, y, k in zip(*sides, n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(n)], ["u", "v", "n"]).filter(ok)

    def weighed(links: DataFrame) -> DataFrame:
        return mapped(links.join(told("u"), "u").join(told("v"), "v"), told_apart, "u long, v long, n long")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = ([np.frombuffer(x, np.uint64) for x in b.column(f"{s}_sketch").to_pylist()] for s in "uv")
            same = pa.array([resemblance(x, y) >= similarity for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(same)

    def verified(links: DataFrame) -> DataFrame:
        ids = stored(links.select(F.col("u").alias("own")).union(links.select("v")).distinct(), "simhash-ids")
        sets = stored(_sketches(own, ids, shingle), "simhash-sketches")
        side = lambda s: sets.select(F.col("own").alias(s), F.col("sketch").alias(f"{s}_sketch"))
        return _instead(mapped(links.select("u", "v").join(side("u"), "u").join(side("v"), "v"), compared, "u long, v long"), "simhash-found", sets, ids)

    def hints(_: tuple, rows: list[tuple]) -> pa.RecordBatch:
        u, v = possible_forest(rows, similarity)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def some(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        found = possible_rows(rows, similarity)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["g", "node"])

    def forests(_: tuple, rows: list[tuple]) -> pa.RecordBatch:
        u, v = similar_forest([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), similarity)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("g", "ci", "cj").sortWithinPartitions("g", "ci", "cj")

    def grouped(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
        """``f`` of the crowded groups, by histograms."""
        wide = _dealt(rows, chunk * WIDER, "comp", "n", "at").join(first.select(F.col("own").alias("node"), "counts"), "node")
        return mapped(together(wide), _runs(("node", "comp", "n", "at", "counts"), f), schema).distinct()

    # A crowded group's likely links join the listed pairs; what they connect needs no more comparing, as a rule almost all.
    links = weighed(pairs)
    crowded = not crowd.isEmpty()
    if crowded:
        links = links.union(weighed(stored(grouped(crowd, hints, "u long, v long"), "simhash-hints"))).distinct()
    links = _instead(links, "simhash-possible", pairs)
    found = _in_passes(links, ["u", "v"], "2 * n", most, verified)
    none = docs.sparkSession.createDataFrame([], "u long, v long")
    if not crowded:
        discard(first)
        return _joined(found, none).distinct()
    comp = lambda s, c: known.select(F.col("own").alias(s), F.col("comp").alias(c))
    edges = _joined(found, none).join(comp("u", "a"), "u").join(comp("v", "b"), "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    merged = components(edges).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
    crowd = _instead(crowd.join(merged, "comp", "left").select("g", "m", "node", F.coalesce("whole", "comp").alias("comp"), "n", "at"), "simhash-crowd", crowd)
    open_ = crowd.groupBy("g").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("g")
    rest = stored(grouped(crowd.join(open_, "g", "left_semi"), some, "g long, node long"), "simhash-some")
    m = rest.groupBy("g").agg(F.count("*").alias("m"))
    rest = _instead(_dealt(crowd.drop("m").join(rest, ["g", "node"]).join(m, "g"), chunk, "comp", "n"), "simhash-rest", rest, crowd, first)

    def whole(rows: DataFrame) -> DataFrame:
        ids = stored(rows.select(F.col("node").alias("own")).distinct(), "simhash-ids")
        sets = stored(_sketches(own, ids, shingle), "simhash-sketches")
        wide = rows.join(sets.withColumnRenamed("own", "node"), "node")
        return _instead(mapped(together(wide), _runs(("node", "comp", "sketch"), forests), "u long, v long"), "simhash-found", sets, ids)

    return _joined(found + _in_passes(rest, ["g", "ci", "cj"], "n", most, whole), none).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float | None) -> DataFrame:
    """(id, fp, own, grp, component) of every row; ``own`` is the text's XXH64, ``grp`` its group's number. Nodes are the different texts."""
    fps = stored(fingerprints(docs, id_col, text_col, 4, own=True), "simhash-fps")
    different = stored(fps.where("id is not null").groupBy("own").agg(F.min("fp").alias("fp"), F.min("id").alias("id")), "simhash-texts")
    nodes = stored(different.groupBy("fp").agg(F.min("own").alias("node")), "simhash-nodes")
    close = nodes.join(components(links(nodes)), "node", "left").select("fp", F.coalesce("component", "node").alias("comp"))
    known = stored(different.join(close, "fp"), "simhash-close")
    if similarity is not None:
        pairs = stored(similar_links(docs, known.select("own", "comp"), similarity, text_col, shingle), "simhash-similar")
        comp = lambda s, c: known.select(F.col("own").alias(s), F.col("comp").alias(c))
        edges = pairs.join(comp("u", "a"), "u").join(comp("v", "b"), "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        merged = components(edges).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
        known = stored(known.join(merged, "comp", "left").select("own", "fp", "id", F.coalesce("whole", "comp").alias("comp")), "simhash-known")
    least = known.groupBy("comp").agg(F.min("id").alias("component"))
    named = stored(known.select("fp", "comp").distinct().join(least, "comp").select("fp", F.col("comp").alias("grp"), "component"), "simhash-named")
    return fps.join(named, "fp", "left").select("id", "fp", "own", "grp", "component")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, fp, component) as ``near_duplicates``, with links also between all texts that share at least ``similarity`` of their
    shingles of ``shingle`` words."""
    return _groups(docs, id_col, text_col, shingle, similarity).select("id", "fp", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their text's group (``similar_groups``; without ``similarity``, SimHash
    links only). Of a group's rows that share that id one stays: the first by its text's hash, then by the other columns as JSON.

    Rows with a null id stay. All columns are kept.
    """
    groups = stored(_groups(docs, id_col, text_col, 5, similarity), "simhash-groups")
    own = F.xxhash64(docs[text_col].cast("string"))
    gone = groups.where("id <> component").select(F.col("id").alias("gone_id"), F.col("own").alias("gone_own")).distinct()
    kept = docs.join(gone, (docs[id_col] == gone["gone_id"]) & (own == gone["gone_own"]), "left_anti").select(*docs.columns)
    again = groups.where("id = component").groupBy(F.col("id").alias("again_id"), "grp").agg(F.count("*").alias("again_n"), F.collect_set("own").alias("again_own")).where("again_n > 1")
    again = stored(again.select("again_id", F.col("grp").alias("again_grp"), F.explode("again_own").alias("again_own")), "simhash-again")
    if again.isEmpty():
        return kept
    same = (kept[id_col] == again["again_id"]) & (F.xxhash64(kept[text_col].cast("string")) == again["again_own"])
    names = [F.col(f"row.{c}") if "." not in c else F.col(f"row.`{c}`") for c in docs.columns]
    whole = F.struct(*(kept[c] for c in docs.columns)).alias("row")
    few = kept.join(again, same).select("again_id", "again_grp", "again_own", whole)
    place = Window.partitionBy("again_id", "again_grp").orderBy("again_own", F.to_json("row"))
    once = few.withColumn("place", F.row_number().over(place)).where("place = 1").select(*names)
    return kept.join(again, same, "left_anti").select(*docs.columns).union(once)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
