r"""Chat formatting into budgeted windows with loss masks.

Template of a turn: ``<turn ROLE>TEXT</turn>\n``. In texts and roles a backslash goes before each backslash and ``<`` (in
roles also ``>``), so no text can make a marker, and reading back is exact. Turns of a conversation are read in order; the
running sum of their tokens cuts turn-aligned windows. A window starts with the system turn and a limited
history, both repeated and masked; loss is on the texts of its new assistant turns alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .tokens import TOKENIZER, encoding

#: Tokens of a window, and of the history that it repeats.
BUDGET, HISTORY = 1024, 256
_TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def escaped(text: str, chars: str = r"[\\<]") -> str:
    return re.sub(chars, r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text starts in it."""
    head = f"<turn {escaped(role, r'[\\<>]')}>"
    return f"{head}{escaped(text)}</turn>\n", len(head)


def read(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


class Windows:
    """Windows of one conversation, given turn by turn; it holds one window and the history."""

    def __init__(self, count: Callable[[str], int], budget: int, history: int):
        self.count, self.budget, self.history = count, budget, history
        self.system: tuple[str, int] | None = None
        self.recent: deque[tuple[str, int]] = deque()  # the last turns but the system turn, within the history's tokens
        self.repeated: list[str] = []
        self.new: list[tuple[str, int, int]] = []  # turn, start and length of its loss
        self.tokens = self.n = self.turns = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn, start = formatted(role, text)
        size = self.count(turn)
        if self.new and self.tokens + size > self.budget:
            yield self.window()
            lead = [self.system] if self.system else []
            past = list(self.recent)
            while past and sum(t for _, t in lead + past) + size > self.budget:
                past.pop(0)
            self.repeated = [x for x, _ in lead + past]
            self.tokens = sum(t for _, t in lead + past)
        self.new.append((turn, start, len(escaped(text)) if role == "assistant" else -1))
        self.tokens += size
        if not self.turns and role == "system":
            self.system = turn, size
        else:
            self.recent.append((turn, size))
            while self.recent and sum(t for _, t in self.recent) > self.history:
                self.recent.popleft()
        self.turns += 1

    def window(self) -> tuple:
        """(number, text, tokens, repeated turns, loss spans, whether one turn alone is over the budget)."""
        at, loss = sum(map(len, self.repeated)), []
        for turn, start, length in self.new:
            if length > 0:
                loss.append({"start": at + start, "end": at + start + length})
            at += len(turn)
        out = self.n, "".join(self.repeated) + "".join(t for t, _, _ in self.new), self.tokens, len(self.repeated), loss, self.tokens > self.budget
        self.n, self.new = self.n + 1, []
        return out


SCHEMA = "conv_id long, window int, text string, n_tokens long, n_repeated int, loss array<struct<start: long, end: long>>, over_budget boolean"


def training_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (conv_id, window, text, n_tokens, n_repeated, loss, over_budget); ``loss`` in code points of ``text``.

    Turns go by turn, then role and text; repeated rows are turns like any other. A null text or role is
    empty; a null conv_id is a conversation of its own. A turn over the budget stands alone and whole, and is flagged. Windows
    of a conversation stand in one partition in order. Empty texts have no loss. Other columns are not read.
    """
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        count = lambda s: len(enc.encode_ordinary(s))
        out: list[tuple] = []
        now, windows = None, None

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["conv_id", "window", "text", "n_tokens", "n_repeated", "loss", "over_budget"])
            out.clear()
            return made

        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if windows is None or conv != now:
                    if windows is not None:
                        out.append((now, *windows.window()))
                    now, windows = conv, Windows(count, budget, history)
                out += [(now, *w) for w in windows.add(role, text)]
            if out:
                yield batch()
        if windows is not None:
            out.append((now, *windows.window()))
            yield batch()

    sorted_turns = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return mapped(sorted_turns, run, SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone (in order within a partition, as ``training_windows`` gives them):
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row(conv, s) -> tuple:
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        for b in batches:
            out = []
            for conv, text, repeated, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) or x is None else None) for x in row(now, state)], names)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if k in (0, 1, 3, 5) else c for k, c in enumerate(b.columns)], b.schema.names)

    return mapped(windows, typed, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_windows(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(training_windows(table.unionByName(own)))
