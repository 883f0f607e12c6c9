"""Personal data by weak supervision.

Candidates come from strict patterns (the base, which always stays) and looser ones, many of which are something else. Labelers
of three sorts vote on each: patterns and checks, gazetteers, context. Their votes are counted over all documents;
expectation-maximisation on those counts estimates, kind by kind, how reliable each labeler is; its posteriors train a
classifier that reads the span and the words around it, and decides on the looser candidates. Counts of vote patterns and a
bounded sample of candidates reach the driver, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh32_intdigest

from .common import discard, mapped, session, stored, text_table

#: Kinds of the base, and those that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The labelers, in the order of their votes.
LABELERS = ("form", "check", "gazetteer", "context", "borders", "variety")
#: Code points on either side of a candidate that the context labeler reads.
CONTEXT = 40
#: Rounds of expectation-maximisation, and steps of the classifier's fit.
ROUNDS, STEPS = 60, 300
#: Candidates of a kind that the classifier is fitted on at most (the smallest by a hash), and its buckets.
MAX_FIT, BUCKETS = 4_000, 1 << 14

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser patterns: other spellings, and forms that may well be something else, so that labelers have both sorts to tell apart.
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]{1,63})+", re.I)
_DOTLESS = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.@-])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9.])")
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z+._/-])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20._/-][0-9]{4}){3})(?![0-9A-Za-z_/-])")
_GROUPED = re.compile(r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])")
_BARE = re.compile(r"(?<![0-9A-Za-z+(._/-])[0-9]{7,12}(?![0-9A-Za-z_/-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT = re.compile(r"[0-9]")
# Gazetteers.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app me co de fr es it nl be at ch uk us ca au nz jp cn in br mx pl se no fi dk pt ie eu ru".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 358 420 421".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30|36|38")
_SECRET_NAMES = ("token", "secret", "key", "apikey", "api_key", "api-key", "password", "passwd", "pwd", "auth", "bearer", "credential", "private_key", "access_key", "secret_key", "access_token")
_CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "client", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "secret", "key", "password", "login", "credentials", "auth"),
}
_AGAINST = ("version", "release", "chapter", "page", "isbn", "order", "invoice", "ticket", "id", "no.", "number", "figure", "section", "serial", "part", "commit", "sha", "checksum", "hash", "digest", "revision")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base: leftmost matches of each kind that do not overlap; those that fail their check are dropped."""
    out = []
    if "@" in text:
        at, last = text.find("@"), 0
        while at >= 0:
            if m := _DOMAIN.match(text, at):
                begin = at
                while begin > last and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
                    begin -= 1
                if begin < at:
                    out.append(("email", begin, m.end()))
                    last = m.end()
            at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """What may be personal data beside the base, by kind; leftmost first, none meeting another."""
    found = []
    if "@" in text or re.search(r"[\[(] ?at ?[\])]", text, re.I):
        found += [("email", *m.span()) for p in (_AT, _DOTLESS) for m in p.finditer(text)]
    if _DIGIT.search(text):  # all others have one
        if text.count(":") >= 7:
            found += [("ip", *m.span()) for m in _IPV6.finditer(text)]
        found += [("ip", *m.span()) for m in _QUAD.finditer(text)]
        found += [("card", *m.span()) for m in _LONG_NUMBER.finditer(text)]
        found += [("phone", *m.span()) for p in (_GROUPED, _BARE) for m in p.finditer(text)]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])]
    out, last = [], 0
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out.append((k, a, b))
            last = b
    return out


def _before(text: str, start: int) -> str:
    """The name that a value is given to, as in ``token = "..."``; empty if there is none."""
    m = re.search(r"([A-Za-z][A-Za-z0-9_-]{1,30}) ?[=:] ?[\"']?\Z", text[max(0, start - 40) : start])
    return m[1].lower() if m else ""


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes (``LABELERS``): 1 for, -1 against, 0 abstains. Form, check and gazetteer read the span, the others its neighbours
    and its letters, so none follows from the rest."""
    s = text[start:end]
    d = _digits(s)
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    free = -1 if (left.isalnum() or right.isalnum() or (left != "" and left in "=_/#")) else 1
    variety = 1 if len(set(d)) > 3 else -1 if len(set(d)) < 3 else 0
    if kind == "email":
        labels = re.split(r"[^A-Za-z0-9]+", s.lower())
        form = 1 if base else 0 if "@" not in s else -1
        check = 1 if len(labels) > 2 and labels[-1].isalpha() and len(labels[-1]) > 1 else -1
        known = 1 if labels[-1] in _TOP_LEVEL else -1
        variety = 1 if len(set(s.lower())) > 5 else -1
    elif kind == "ip":
        form = 1 if base else 0 if ":" in s else -1
        check = 1 if ":" in s or all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split(".")) else -1
        known = 0 if ":" in s else -1 if s.startswith(("0.", "127.", "255.")) else 1 if check > 0 else 0
    elif kind == "card":
        form = 1 if base else 0 if len(s) > len(d) else -1
        check = 1 if 13 <= len(d) <= 19 and _luhn(d) else -1
        known = 1 if _ISSUERS.match(d) else -1
    elif kind == "phone":
        form = 1 if base else 0 if len(s) > len(d) else -1
        check = 1 if 10 <= len(d) <= 15 else 0 if len(d) >= 8 else -1
        known = (1 if d.startswith(_CALLING) else -1) if s.startswith(("+", "00")) else 0 if len(s) == len(d) or len(d) < 10 else 1 if d[0] not in "01" else -1
    else:
        name = _before(text, start)
        quotes = left in ("'", '"') and left == right
        form = 1 if name and quotes else 0 if name or quotes else -1
        check = 1 if len(set(s)) >= 10 and sum(c.isdigit() for c in s) >= 4 else -1
        known = 1 if name in _SECRET_NAMES else -1 if name else 0
        variety = 1 if len(set(s)) * 4 >= min(len(s), 40) else -1
        free = -1 if left.isalnum() or right.isalnum() else 1
    near = re.findall(r"[^\W\d_][\w.-]*", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower())
    cue = 1 if any(w in _CUES[kind] for w in near) else -1 if any(w in _AGAINST for w in near) else 0
    return form, check, known, cue, free, variety


def features(text: str, kind: str, start: int, end: int, v: tuple[int, ...]) -> list[int]:
    """Buckets of what the classifier reads: the span's shape, its check and votes, and the words and marks around it."""
    s = text[start:end]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", s[:24])))
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    told = [f"length {min(40, len(s)) // 2}", f"digits {min(20, sum(c.isdigit() for c in s))}", f"shape {shape}", f"marks {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', s))))}"]
    told += [f"edge {before[-1:]}|{after[:1]}", f"name {_before(text, start)}"]
    told += [f"before {w}" for w in re.findall(r"\w+", before.lower())[-3:]] + [f"after {w}" for w in re.findall(r"\w+", after.lower())[:3]]
    told += [f"{n} {x}" for n, x in zip(LABELERS, v) if x]
    return sorted({xxh32_intdigest(f"{kind} {t}", 3) % BUCKETS for t in [*told, ""]})


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, whether of the base, votes) by kind and start; a looser span that meets any base span is left out."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, k, reach = [], 0, 0
    for x in loose_spans(text):  # both by start
        while k < len(taken) and taken[k][0] < x[2]:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= x[1]:
            more.append(x)
    found = [(k, a, b, True, votes(text, k, a, b, True)) for k, a, b in base] + [(k, a, b, False, votes(text, k, a, b, False)) for k, a, b in more]
    return sorted(found, key=lambda x: (ALL_KINDS.index(x[0]), x[1], x[2]))


def pattern(kind: str, base: bool, v: tuple[int, ...]) -> int:
    code = ALL_KINDS.index(kind) * 2 + base
    for x in v:
        code = code * 3 + x + 1
    return code


def unpacked(code: int) -> tuple[int, bool, tuple[int, ...]]:
    v = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code // 2, bool(code % 2), tuple(reversed(v))


@dataclass
class Model:
    """By kind: the share of personal data and the labelers' reliabilities. Of each vote pattern: the probability that its spans are
    personal data. The classifier's weights, once it is fitted."""

    prior: dict[str, float]
    reliability: dict[str, dict[str, tuple[float, float]]]
    posterior: dict[int, float]
    weights: np.ndarray | None = None

    def score(self, own: list[int]) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-np.clip(self.weights[own].sum(), -30, 30))))

    def takes(self, base: bool, own: list[int]) -> bool:
        return base or self.score(own) >= 0.5


def reliabilities(counts: dict[int, int]) -> Model:
    """Expectation-maximisation, kind by kind, from how often each vote pattern occurs.

    A labeler has a rate of votes for among personal data and one among the rest. Both begin, and are smoothed, as if a few votes had
    shown it to be right more often than not; an abstention tells nothing.
    """
    prior, reliability, posterior = {}, {}, {}
    for number, kind in enumerate(ALL_KINDS):
        codes = sorted(c for c in counts if unpacked(c)[0] == number)
        if not codes:
            continue
        n = np.array([counts[c] for c in codes], float)
        v = np.array([unpacked(c)[2] for c in codes])
        p = 1 / (1 + np.exp(-v.sum(1).astype(float)))  # begins at the vote
        for _ in range(ROUNDS):
            share = float(((n * p).sum() + 2) / (n.sum() + 4))
            odds = np.full(len(codes), np.log(share / (1 - share)))
            told = {}
            for j, name in enumerate(LABELERS):
                for_true, for_false = (((n * w * (v[:, j] > 0)).sum() + up, (n * w * (v[:, j] != 0)).sum() + 4) for w, up in ((p, 3), (1 - p, 1)))
                right, wrong = for_true[0] / for_true[1], for_false[0] / for_false[1]
                told[name] = (right, 1 - wrong)
                odds += np.where(v[:, j] > 0, np.log(right / wrong), np.where(v[:, j] < 0, np.log((1 - right) / (1 - wrong)), 0.0))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior[kind], reliability[kind] = share, told
        posterior |= dict(zip(codes, p.tolist()))
    return Model(prior, reliability, posterior)


def classifier(rows: list[list[int]], p: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of the features against the posteriors (Adagrad on whole passes)."""
    size = np.array([len(r) for r in rows], np.int64)
    columns = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(steps if rows else 0):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[columns], len(rows)), -30, 30)))
        g = np.bincount(columns, (q - p)[owner], BUCKETS) / len(rows) + decay * w / len(rows)
        g2 += g * g
        w -= 0.2 * g / np.sqrt(g2)
    return w.astype(np.float32)


_SPAN = "struct<kind: string, start: long, end: long, base: boolean, pattern: int, features: array<int>>"


def candidate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found array of (kind, start, end, base, pattern, features)) of every row, in order of kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]
        names = [n for n, _ in span]
        for b in batches:
            found = [[dict(zip(names, (k, s, e, own, pattern(k, own, v), features(t, k, s, e, v)))) for k, s, e, own, v in candidates(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(found, pa.list_(pa.struct(span)))], ["id", "found"])

    return mapped(text_table(docs, id_col, text_col), run, f"id long, found array<{_SPAN}>")


def trained(table: DataFrame) -> Model:
    """The model of a candidate table. Vote patterns are counted over all rows (at most 1,458 a kind reach the driver); the classifier is
    fitted on at most ``MAX_FIT`` candidates a kind, the smallest by a hash of place and content."""
    each = table.select("id", F.explode("found").alias("x")).select("id", "x.*")
    counts = each.groupBy("pattern").count().collect()
    model = reliabilities({r["pattern"]: r["count"] for r in counts})
    places = sorted({unpacked(c)[0] for c in model.posterior})
    kinds = [each.where(F.col("kind") == ALL_KINDS[k]).orderBy(F.xxhash64("id", "start", "features"), "pattern", "features").limit(MAX_FIT).select("pattern", "features") for k in places]
    rows = [r for k in kinds for r in k.collect()]
    model.weights = classifier([r.features for r in rows], np.array([model.posterior[r["pattern"]] for r in rows]))
    return model


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (kind, start, end, base)) of every row of ``docs``: base spans and those that the
    classifier adds; code points, end exclusive.

    Null and empty texts have none. Repeated rows each get a row. Texts are read whole. Other columns are not read.
    """
    table = stored(candidate_table(docs, id_col, text_col), "pii")
    given = session(docs.sparkSession).sparkContext.broadcast(trained(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]
        for b in batches:
            kept = [[{n: x[n] for n, _ in span} for x in found if given.value.takes(x["base"], x["features"])] for found in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(kept, pa.list_(pa.struct(span)))], ["id", "spans"])

    return mapped(table, run, "id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, as ``[EMAIL]``; all rows and columns stay, null texts too.
    Overlapping spans are replaced as one, under the kind of the first."""
    table = stored(candidate_table(docs.withColumn("__id", F.lit(0).cast("long")), "__id", text_col), "pii")
    model = trained(table)
    discard(table)
    given = session(docs.sparkSession).sparkContext.broadcast(model)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        spans = sorted((a, b, k) for k, a, b, own, v in candidates(text or "") if own or given.value.takes(own, features(text, k, a, b, v)))
        if not spans:
            return text
        out, last = [], 0
        for a, b, k in spans:
            if a >= last:
                out += [text[last:a], f"[{k.upper()}]"]
            last = max(last, b)
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([clean(t) for t in b.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in names], names)

    return mapped(docs, run, docs.schema)


def op10_private_spans(spark, sf_dir: str) -> DataFrame:
    found = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
