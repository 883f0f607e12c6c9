"""Quality classifier by co-training.

Two views of a document, its text and its page metadata (language, source), each have a logistic model over hashed features.
Over a few rounds each view hands the other the documents that it is surest of, with its calibrated probability as a soft
label, and a bounded sample of them trains the other view. How sure is sure enough is the view's own: the outer shares of its
calibrated scores on held-out labels. So a weaker view hands over too, with soft labels that say how weak it is; one whose
scores tell nothing hands over none.
Both views are calibrated on held-out labels and their log-odds combined. A document is good if its quality is 1 and
it isn't toxic. Features are made once and written; fits are on bounded samples (``MAX_LABELLED``, ``MAX_PSEUDO``); every
document is a candidate in each round and is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import discard, mapped, session, stored
from .fmindex import PLAIN

#: Labelled rows that are used at most (the smallest by a hash of the id), and pseudo-labels of a class, view and round.
MAX_LABELLED, MAX_PSEUDO = 20_000, 1_000
#: Rounds of exchange, and the share of held-out scores at either end beyond which a view is sure.
ROUNDS, SURE = 2, 0.1
#: How far apart the two ends of a view must be; one that tells nothing is sure of nothing.
APART = 0.05
#: Weight of a pseudo-label next to a label's.
PSEUDO_WEIGHT = 0.5
#: Buckets of the text's words and of the metadata.
WORDS, META = 1 << 17, 1 << 12
STEPS = 120
#: Standard errors by which a feature must tell the classes apart.
SIGNIFICANT = 2.5
#: Least probability of being good with which a document stays.
KEEP = 0.5

_UPPER, _MARKS, _SYMBOLS, _DIGITS = bytes(range(65, 91)), b"!?", b"#*$%&|<>@^~=_{}[]\\/", b"0123456789"
_STAT = 16  # bins of a statistic


def text_features(text: bytes, seen: dict[bytes, int]) -> np.ndarray:
    """Hashed words that occur, and bins of the text's statistics."""
    words = text.translate(PLAIN).split()
    if len(seen) > 300_000:
        seen.clear()
    different = set(words)
    for w in [w for w in different if w not in seen]:
        seen[w] = xxh32_intdigest(w, 3) % WORDS
    n, chars = len(words), max(1, len(text))
    own = lambda some: chars - len(text.translate(None, some)) if text else 0
    stats = [
        min(_STAT - 1, n.bit_length()),
        min(_STAT - 1, int(own(_UPPER) / chars * 40)),
        min(_STAT - 1, int(own(_MARKS) / chars * 200)),
        min(_STAT - 1, int(own(_SYMBOLS) / chars * 200)),
        min(_STAT - 1, int(own(_DIGITS) / chars * 40)),
        min(_STAT - 1, int(len(different) / max(1, n) * _STAT)),
        min(_STAT - 1, int(chars / max(1, n))),
    ]
    at = [WORDS + k * _STAT + s for k, s in enumerate(stats)]
    return np.array([*{seen[w] for w in different}, *at], np.int32)


N_TEXT = WORDS + 7 * _STAT


def meta_features(lang: str | None, source: str | None) -> np.ndarray:
    told = {f"l{lang}", f"s{source}", f"l{lang}s{source}"}
    return np.array(sorted({xxh32_intdigest(x, 3) % META for x in told}), np.int32)


class Rows:
    """Sparse binary rows, none of them empty; products go by blocks of rows, so that little is held beside them."""

    BLOCK = 2000

    def __init__(self, rows: list[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int32)

    def _blocks(self):
        for k in range(0, len(self.at) - 1, self.BLOCK):
            at = self.at[k : k + self.BLOCK + 1]
            yield slice(k, k + len(at) - 1), at - at[0], self.columns[at[0] : at[-1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        parts = [np.add.reduceat(w[columns].astype(np.float64), at[:-1]) for _, at, columns in self._blocks()]
        return np.concatenate(parts) if parts else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for rows, at, columns in self._blocks():
            out += np.bincount(columns, np.repeat(g[rows], np.diff(at)), size)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int, steps: int = STEPS, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic model (the last is the constant); classes weigh alike. ``y``: labels, or probabilities that count for both.

    A feature's scale is its smoothed log ratio between the classes, 0 where that is within ``SIGNIFICANT``
    standard errors of none; then Adagrad on the scaled features.
    """
    share = weight * (1 - y), weight * y
    total = [max(s.sum(), 1e-9) for s in share]
    seen = np.stack([rows.back(s, size) for s in share])
    least = 0.5
    ratio = np.log((seen[1] + least) / (total[1] + 1)) - np.log((seen[0] + least) / (total[0] + 1))
    error = np.sqrt(1 / (seen[0] + least) + 1 / (seen[1] + least))
    scale = np.where((np.abs(ratio) > SIGNIFICANT * error) & (seen.sum(0) > 0), ratio, 0.0)
    bad, good = (s / t / 2 for s, t in zip(share, total))
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-10), 1e-10
    for _ in range(steps):
        p = sigmoid(rows.dot(w * scale) + b)
        g = bad * p - good * (1 - p)
        d, e = rows.back(g, size) * scale + decay * w, g.sum()
        gw, gb = gw + d * d, gb + e * e
        w, b = w - 0.15 * d / np.sqrt(gw), b - 0.15 * e / np.sqrt(gb)
    return np.append(w * scale, b)


def fit_dense(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps for a small logistic model with a constant and a light penalty."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -5, 5)
    return w


def fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``fit_dense``, but no column may count against its own direction: columns with negative weights are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(used, True)] = fit_dense(x[:, used], y)
        if (w[:-1] >= 0).all():
            return w
        used &= w[:-1] >= 0


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray
    #: Of each view, the probabilities at or below and at or above which it is sure.
    sure: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 1.0), (0.0, 1.0))

    def scores(self, text_rows: Rows, meta_rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of either view, and of both."""
        t = text_rows.dot(self.text[:-1]) + self.text[-1]
        m = meta_rows.dot(self.meta[:-1]) + self.meta[-1]
        t, m = (a[0] * x + a[1] for a, x in zip(self.calibration, (t, m)))
        both = self.combination[0] * t + self.combination[1] * m + self.combination[2]
        return sigmoid(t), sigmoid(m), sigmoid(both)


def _features(text: list, lang: list, source: list, seen: dict[bytes, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [text_features(t or b"", seen) for t in text], [meta_features(*x) for x in zip(lang, source)]


def _read(b: pa.RecordBatch, c: str) -> list:
    if c not in b.schema.names:
        return [None] * b.num_rows
    return b.column(c).cast(pa.string()).cast(pa.binary() if c == "text" else pa.string()).to_pylist()


def featured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, meta) of every row: its features, 4 bytes each; made once for all rounds. Columns that are missing are read as null."""
    pick = lambda c: (docs[c] if c in docs.columns else F.lit(None)).cast("string").alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            text, meta = _features(*(_read(b, c) for c in ("text", "lang", "source")), seen)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (text, meta))], ["id", "text", "meta"])

    return mapped(docs.select(docs[id_col].cast("long").alias("id"), pick("text"), pick("lang"), pick("source")), run, "id long, text binary, meta binary")


def _rows(b: pa.RecordBatch, c: str) -> Rows:
    return Rows([np.frombuffer(x, np.int32) for x in b.column(c).to_pylist()])


def examples(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for each (id, view) of ``chosen`` (id, good, view; at most a few times ``MAX_LABELLED`` rows) that ``features`` has: of rows that
    share an id the one with the least content."""
    found = features.join(F.broadcast(chosen), "id").groupBy("id", "view").agg(F.first("good").alias("good"), F.min(F.struct("text", "meta")).alias("x"))
    return found.select("id", "view", "good", "x.text", "x.meta")


def labelled(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, good, view 0) of at most ``limit`` labels. Of an id's several labels the worst holds; null ones are left out."""
    each = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    good = (F.min("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    return each.agg(good.cast("double").alias("good"), F.lit(0).alias("view")).orderBy(F.xxhash64("id"), "id").limit(limit)


def confident(features: DataFrame, model: Model, round_no: int, limit: int = MAX_PSEUDO) -> DataFrame:
    """(id, good, view) of the documents, out of all, that a view is sure of, ``good`` being its probability: at most ``limit`` a class
    and view, the smallest by a hash of round and id. A task sends on only its own smallest."""
    given = session(features.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for b in batches:
            by_view = given.value.scores(_rows(b, "text"), _rows(b, "meta"))[:2]
            ids = b.column("id").to_pylist()
            for view, p in enumerate(by_view):
                low, high = given.value.sure[view]
                for side, which in enumerate((p <= low, p >= high)):
                    own = best.setdefault((view, side), [])
                    own += [(xxh32_intdigest(f"{round_no}:{ids[k]}", 9), ids[k], float(p[k])) for k in np.flatnonzero(which).tolist() if ids[k] is not None]
                    if len(own) > 2 * limit:
                        best[view, side] = sorted(set(own))[:limit]
        for (view, side), rows in sorted(best.items()):
            rows = sorted(set(rows))[:limit]
            columns = [r[1] for r in rows], [r[2] for r in rows], [view] * len(rows), [side] * len(rows), [r[0] for r in rows]
            types = pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "good", "view", "side", "place"])

    found = mapped(features, run, "id long, good double, view int, side int, place long")
    found = found.groupBy("id", "view", "side", "place").agg(F.min("good").alias("good"))
    order = Window.partitionBy("view", "side").orderBy("place", "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).groupBy("id", "view").agg(F.min("good").alias("good")).select("id", "good", "view")


class Examples:
    """At most a few times ``MAX_LABELLED`` rows, on the driver."""

    def __init__(self, df: DataFrame):
        t = df.orderBy("view", "id").toArrow()
        unpack = lambda c: [np.frombuffer(x, np.int32) for x in t.column(c).to_pylist()]
        self.text, self.meta = unpack("text"), unpack("meta")
        self.id, self.view, self.good = (t.column(c).to_numpy() for c in ("id", "view", "good"))

    def some(self, which: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        return [self.text[k] for k in np.flatnonzero(which)], [self.meta[k] for k in np.flatnonzero(which)], self.good[which]


def _model(own: Examples, more: list[Examples], sure: float = SURE) -> Model:
    """Fits on the labels that aren't held out and on pseudo-labels, each view on the other's; calibration on the held-out ones."""
    held = np.array([xxh32_intdigest(str(i), 1) % 4 == 0 for i in own.id], bool)
    if any(len(set(own.good[x])) < 2 for x in (held, ~held)):  # too few to hold any out
        held = np.ones(len(own.id), bool)
        fit_on = held
    else:
        fit_on = ~held
    text, meta, y = own.some(fit_on)
    given = {0: (list(text), list(y)), 1: (list(meta), list(y))}
    for e in more:
        t, m, g = e.some(e.view == 1)  # from the metadata's view to the text's
        given[0][0].extend(t), given[0][1].extend(g)
        t, m, g = e.some(e.view == 0)
        given[1][0].extend(m), given[1][1].extend(g)
    weigh = lambda n: np.concatenate([np.ones(len(y)), np.full(n - len(y), PSEUDO_WEIGHT)])
    w = [fit_linear(Rows(given[v][0]), np.array(given[v][1]), weigh(len(given[v][1])), size) for v, size in ((0, N_TEXT), (1, META))]
    text, meta, y = own.some(held)
    raw = [Rows(r).dot(x[:-1]) + x[-1] for r, x in zip((text, meta), w)]
    calibration = tuple(fit_rising(x[:, None], y) for x in raw)
    both = np.stack([a[0] * x + a[1] for a, x in zip(calibration, raw)], 1)
    ends = []
    for p in (sigmoid(both[:, 0]), sigmoid(both[:, 1])):
        low, high = np.quantile(p, [sure, 1 - sure]).tolist()
        ends.append((low, high) if high - low > APART else (-1.0, 2.0))
    return Model(w[0].astype(np.float32), w[1].astype(np.float32), calibration, fit_rising(both, y), tuple(ends))


def train(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, history: list | None = None) -> Model | None:
    """None if the labels that have a document are not of both classes. ``history`` gets the documents exchanged in each round."""
    own = Examples(examples(features, labelled(labels)))
    if len(set(own.good.tolist())) < 2:
        return None
    more: list[Examples] = []
    for k in range(rounds):
        chosen = confident(features, _model(own, more), k)
        ids = chosen.collect()  # at most four times MAX_PSEUDO
        more.append(Examples(examples(features, features.sparkSession.createDataFrame(ids, chosen.schema))))
        if history is not None:
            history.append(more[-1])
    return _model(own, more)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """(id, text_score, meta_score, score, keep) of every row of ``docs``.

    A null or empty text is scored by its lack of words, missing metadata columns as null. Texts of any length are read whole. With labels of
    one class or none there is nothing to learn: every score is 1 and all rows stay. Rows that repeat each get a row.
    """
    features = stored(featured(docs, id_col), "cotrain-features")
    model = train(features, labels, rounds)
    given = session(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = given.value.scores(_rows(b, "text"), _rows(b, "meta")) if given.value else [np.ones(b.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.asarray(x, np.float64)) for x in out), pa.array(out[2] >= keep)], ["id", "text_score", "meta_score", "score", "keep"])

    return mapped(features, run, "id long, text_score double, meta_score double, score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    features = stored(featured(docs, id_col), "cotrain-features")
    model = train(features, labels)
    if model is None:
        return docs
    discard(features)
    given = session(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            text, meta = _features(*(_read(b, c) for c in ("text", "lang", "source")), seen)
            yield b.filter(pa.array(given.value.scores(Rows(text), Rows(meta))[2] >= keep))

    return mapped(docs, run, docs.schema)


def op3_cotraining(spark, sf_dir: str) -> DataFrame:
    found = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnsRenamed({"id": "doc_id", "keep": "kept"}).withColumns({c: F.round(c, 9) for c in ("text_score", "meta_score", "score")})
