"""Edit-aware token counts.

A document's pre-tokens stand in a segment tree of token counts. An edit is encoded from a boundary before it until the new
pre-tokens fall on old boundaries again; only those leaves are replaced, and the sums above them updated. Counts
are exactly those of encoding the edited text anew. Trees are kept in a table beside their texts (``token_trees``); edits
start from it and leave the next one (``edited_trees``), so a text is encoded whole only once.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, text_table

#: Ranks of the vocabulary; the path of any other file of the kind may be given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_pre = regex.compile(PATTERN)
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000
#: Leaves of the trees in an output batch, beyond a document's own.
BATCH_LEAVES = 100_000
#: A kept tree: the leaves of each block, code points and tokens of each leaf, and both sums of each node over the blocks.
TREE = {"widths": "int", "lengths": "int", "counts": "int", "chars": "long", "tokens": "long"}
_TREE_SQL = "struct<" + ", ".join(f"{k}: array<{t}>" for k, t in TREE.items()) + ">"
_TREE_ARROW = pa.struct([(k, pa.list_(pa.int32() if t == "int" else pa.int64())) for k, t in TREE.items()])
COUNTS = ["tokens_before", "tokens_after", "n_edits", "chars_after", "chars_encoded"]


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of a pre-token."""

    def __init__(self, path: str = TOKENIZER):
        self.encoding, self.seen = encoding(path), {}

    def __call__(self, pieces: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for p in [p for p in set(pieces) if p not in seen]:
            seen[p] = len(self.encoding.encode_ordinary(p))
        return [seen[p] for p in pieces]


class Tree:
    """A segment tree over leaves (code points, tokens): blocks of leaves whose sums stand in levels above.

    Leaves live in blocks of at most 2 * ``WIDTH``; an edit rewrites the blocks that it touches and the sums over them.
    """

    WIDTH = 64

    def __init__(self, lengths: list[int], counts: list[int]):
        self.blocks: list[list[list[int]]] = [[lengths[k : k + self.WIDTH], counts[k : k + self.WIDTH]] for k in range(0, len(lengths), self.WIDTH)]
        self._sums()

    def _sums(self) -> None:
        n = 1
        while n < max(1, len(self.blocks)):
            n *= 2
        self.size = n
        chars, toks = [0] * (2 * n), [0] * (2 * n)
        for k, (a, b) in enumerate(self.blocks):
            chars[n + k], toks[n + k] = sum(a), sum(b)
        for k in range(n - 1, 0, -1):
            chars[k], toks[k] = chars[2 * k] + chars[2 * k + 1], toks[2 * k] + toks[2 * k + 1]
        self.chars, self.tokens = chars, toks

    def kept(self) -> dict[str, np.ndarray]:
        """The tree as arrays, see ``TREE``."""
        flat = lambda k: [x for b in self.blocks for x in b[k]]
        parts = {"widths": [len(b[0]) for b in self.blocks], "lengths": flat(0), "counts": flat(1), "chars": self.chars, "tokens": self.tokens}
        return {k: np.array(x, np.int32 if TREE[k] == "int" else np.int64) for k, x in parts.items()}

    @classmethod
    def of(cls, kept: dict[str, np.ndarray]) -> Tree:
        """The tree that was kept; no sum is made again."""
        tree = cls.__new__(cls)
        lengths, counts = kept["lengths"].tolist(), kept["counts"].tolist()
        ends = np.cumsum(kept["widths"]).tolist()
        tree.blocks = [[lengths[a:b], counts[a:b]] for a, b in zip([0, *ends], ends)]
        tree.chars, tree.tokens = kept["chars"].tolist(), kept["tokens"].tolist()
        tree.size = len(tree.chars) // 2
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, leaf and start of the leaf that holds code point ``at`` (the end of the text: after the last leaf)."""
        if at >= self.length:
            return len(self.blocks), 0, self.length
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= at:
                start += self.chars[k]
                k += 1
        block = k - self.size
        for leaf, n in enumerate(self.blocks[block][0]):
            if start + n > at:
                return block, leaf, start
            start += n
        raise AssertionError

    def back(self, block: int, leaf: int, start: int) -> tuple[int, int, int]:
        """The leaf before."""
        if leaf == 0:
            if block == 0:
                return 0, 0, 0
            block -= 1
            leaf = len(self.blocks[block][0])
        return block, leaf - 1, start - self.blocks[block][0][leaf - 1]

    def starts_from(self, block: int, leaf: int, start: int) -> Iterator[tuple[int, int, int]]:
        """The leaves from one on, with their starts; at last the end of the text."""
        while block < len(self.blocks):
            lengths = self.blocks[block][0]
            for k in range(leaf, len(lengths)):
                yield block, k, start
                start += lengths[k]
            block, leaf = block + 1, 0
        yield block, 0, start

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Leaves from ``first`` up to, not with, ``last``."""
        (b0, l0), (b1, l1) = first, last
        head = [x[:l0] for x in self.blocks[b0]] if b0 < len(self.blocks) else [[], []]
        tail = [x[l1:] for x in self.blocks[b1]] if b1 < len(self.blocks) else [[], []]
        new = [head[k] + x + tail[k] for k, x in enumerate((lengths, counts))]
        stop = min(b1 + 1, len(self.blocks))
        if stop - b0 == 1 and 0 < len(new[0]) <= 2 * self.WIDTH:
            self.blocks[b0] = new
            k = self.size + b0
            self.chars[k], self.tokens[k] = sum(new[0]), sum(new[1])
            while k > 1:
                k //= 2
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            return
        self.blocks[b0:stop] = [[x[k : k + self.WIDTH] for x in new] for k in range(0, len(new[0]), self.WIDTH)]
        self._sums()


class Document:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, counter: Counter, tree: Tree | None = None):
        self.text, self.counter = text, counter
        if tree is None:
            pieces = _pre.findall(text)
            tree = Tree(list(map(len, pieces)), counter(pieces))
        self.tree = tree
        self.encoded = 0  # code points encoded since

    @property
    def tokens(self) -> int:
        return self.tree.total

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace [start, end) by ``new``. Ends beyond the text are its end."""
        tree, old = self.tree, self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        # A pre-token depends on its own run and the character after it; a run of white space on what follows the run.
        block, leaf, at = tree.back(*tree.find(max(start - 1, 0))) if len(old) else (0, 0, 0)
        while at > 0 and old[at].isspace():
            block, leaf, at = tree.back(block, leaf, at)
        block, leaf, at = tree.back(block, leaf, at) if at else (block, leaf, at)
        olds = tree.starts_from(block, leaf, at)
        here = next(olds)
        lengths, pieces, place = [], [], at
        for m in _pre.finditer(self.text, at):
            place = m.start()
            if place - shift > end + 1 and place > start + len(new) + 1:
                while here[2] < place - shift:
                    here = next(olds)
                if here[2] == place - shift:
                    break
            pieces.append(m[0])
            lengths.append(len(m[0]))
        else:
            here = (len(tree.blocks), 0, len(old))
        self.encoded += sum(lengths)
        tree.replace((block, leaf), here[:2], lengths, self.counter(pieces))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of an array column, none of them null."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at, at[1:])]


def _trees(column: pa.StructArray) -> Iterator[Tree]:
    fields = [_lists(column.field(k)) for k in TREE]
    for arrays in zip(*fields):
        yield Tree.of(dict(zip(TREE, arrays)))


def _kept_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text, tree, counts ...) of bounded leaves."""

    def batch() -> pa.RecordBatch:
        ids, texts, trees, counts = zip(*held)
        parts = [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(trees, _TREE_ARROW)]
        parts += [pa.array(x, pa.int64()) for x in zip(*counts)]
        return pa.RecordBatch.from_arrays(parts, ["id", "text", "tree", *COUNTS[: len(parts) - 3]])

    held, leaves = [], 0
    for row in rows:
        held.append(row)
        leaves += len(row[2]["lengths"])
        if leaves >= BATCH_LEAVES:
            yield batch()
            held, leaves = [], 0
    if held:
        yield batch()


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text, tree) of every row of ``docs``: the state that edits start from, to be written as a table.

    Null texts are empty and have a tree without leaves. Null ids and repeated rows are rows like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        rows = (row for b in batches for row in zip(b.column("id").to_pylist(), b.column("text").to_pylist()))
        yield from _kept_batches((i, text or "", Document(text or "", counter).tree.kept(), ()) for i, text in rows)

    return mapped(text_table(docs, id_col, text_col), run, f"id long, text string, tree {_TREE_SQL}")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with ``edits``, the array of a document's edits (seq, start, end, text) in order; null for none.

    ``edits``: (id, seq, start, end, text), applied by seq, each to the text that those before it left; code points,
    end exclusive. Edits of an id that no document has are ignored; documents with the same id all get its edits.
    A null start is 0, a null end is the start, a null replacement is empty. Rows with a null id have no edits.
    """
    each = edits.select("id", F.struct("seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("end", "start", F.lit(0)).cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("edits"))  # one document's edits, as long as its own history
    return trees.select("id", "text", "tree").join(lists, "id", "left")


def _followed(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[int | None, Document, tuple[int, ...]]]:
    counter = Counter(tokenizer)
    for b in batches:
        for i, text, tree, edits in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), _trees(b.column("tree")), b.column("edits").to_pylist()):
            d = Document(text, counter, tree)
            before = d.tokens
            for e in edits or ():
                d.edit(e["start"], e["end"], e["text"])
            yield i, d, (before, d.tokens, len(edits or ()), len(d.text), d.encoded)


def edited_trees(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text, tree) after the edits of ``with_edits``, from which later edits start, and the columns of ``count_edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept_batches((i, d.text, d.tree.kept(), counts) for i, d, counts in _followed(batches, tokenizer))

    return mapped(rows.select("id", "text", "tree", "edits"), run, f"id long, text string, tree {_TREE_SQL}, " + ", ".join(f"{c} long" for c in COUNTS))


def count_edits(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens_before, tokens_after, n_edits, chars_after, chars_encoded) of every row of ``with_edits``.

    Only what edits touch is encoded: ``chars_encoded`` code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, more = _followed(batches, tokenizer), True
        while more:
            part = [(i, *counts) for _, (i, _, counts) in zip(range(10_000), rows)]
            more = len(part) == 10_000
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], ["id", *COUNTS])

    return mapped(rows.select("id", "text", "tree", "edits"), run, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def edited_counts(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """As ``count_edits``, from documents without kept trees. Nulls, repeated rows and edits as in ``token_trees`` and ``with_edits``."""
    return count_edits(with_edits(token_trees(docs, id_col, text_col, tokenizer), edits), tokenizer)


def op8_edit_counts(spark, sf_dir: str) -> DataFrame:
    """Every document, with three edits to its kept tree: an insertion a quarter in, a deletion at the half, a replacement three quarters in."""
    trees = stored(token_trees(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-trees", "zstd")
    n = F.length("text").cast("long")
    part = lambda k: (n * k / 4).cast("long")
    edit = lambda seq, a, b, new: F.struct(F.lit(seq).alias("seq"), a.alias("start"), b.alias("end"), F.lit(new).alias("text"))
    edits = F.array(edit(0, part(1), part(1), " [inserted 42] "), edit(1, part(2), part(2) + 25, ""), edit(2, part(3), part(3) + 10, "l'été\n\n  it's"))
    return count_edits(trees.withColumn("edits", edits)).withColumnRenamed("id", "doc_id")
