"""Token counts that follow edits: a segment tree over a document's pre-tokens, re-encoded only where an edit touches it.

A leaf is a run of whole pre-tokens of about ``LEAF`` characters.  Leaves are cut before a lone space between two other
characters, where the vocabulary's pattern always starts a pre-token, so a document's count is the sum of its leaves'
counts.  An edit takes the leaves it touches, and as context the neighbours on either side wherever the new text no longer
meets them at such a place; that region alone is encoded again and the sums above it are updated.

``build_trees`` encodes texts once; ``apply_edits`` takes trees and edits and returns counts and the trees that follow, so
that the next batch of edits finds them.  Trees are columns: keep them as Parquet between batches.  A text with no single
space between other characters is one leaf, which every edit encodes whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import bpe
from intervale.llm.common import kind, prepare, table

LEAF = 256
EDIT = "array<struct<at:bigint,remove:bigint,insert:string>>"
#: Leaves, and by place in the tree (1 the root, 2i and 2i + 1 below i) the sums of characters and of tokens.
TREE = "struct<leaves:array<string>,chars:array<bigint>,tokens:array<bigint>>"
_CUT = re.compile(r"(?<=[^\s<|>]) (?=[^\s<|>])")


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text cut into runs of whole pre-tokens of at least ``size`` characters where such places exist."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size)
        to = m.start() if m else len(text)
        out.append(text[at:to])
        at = to
    return out


def meets(left: str, right: str) -> bool:
    """Whether a pre-token starts where ``right`` follows ``left``, whatever stands around them."""
    if not left or not right:
        return False
    return bool(_CUT.match(left[-1] + right[:2], 1))


class CountTree:
    """Sums of characters and tokens over a document's leaves."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int], count) -> None:
        self.leaves, self.chars, self.tokens, self.count, self.encoded = leaves, chars, tokens, count, 0
        self.base = len(leaves)

    @classmethod
    def of(cls, text: str, count) -> CountTree:
        tree = cls([], [], [], count)
        leaves = leaves_of(text)
        tree._plant(leaves, [count(x) for x in leaves])
        return tree

    def _plant(self, leaves: list[str], tokens: list[int]) -> None:
        """Sums over leaves whose counts are known."""
        self.base = 1 << (max(1, len(leaves)) - 1).bit_length()
        none = self.base - len(leaves)
        self.leaves = leaves + [""] * none
        self.chars = [0] * self.base + [len(x) for x in self.leaves]
        self.tokens = [0] * self.base + tokens + [0] * none
        for i in range(self.base - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the character's place in it (the end of the text: its last character's leaf)."""
        i, at = 1, min(at, max(0, self.chars[1] - 1))
        while i < self.base:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _beside(self, i: int, step: int) -> int | None:
        """The next leaf that holds text."""
        i += step
        while 0 <= i < self.base and not self.leaves[i]:
            i += step
        return i if 0 <= i < self.base else None

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replaces ``remove`` characters at ``at`` by ``insert``; places beyond the text are its end."""
        size = self.chars[1]
        at = max(0, min(at, size))
        remove = max(0, min(remove, size - at))
        first, place = self._leaf_at(at)
        place = min(at, size) - (at - place) if at < size else len(self.leaves[first])
        last, _ = self._leaf_at(max(at, at + remove - 1))
        first, last = min(first, last), max(first, last)
        region = "".join(self.leaves[first : last + 1])
        region = region[:place] + insert + region[place + remove :]
        while (near := self._beside(first, -1)) is not None and not meets(self.leaves[near], region):
            first, region = near, self.leaves[near] + region
        while (near := self._beside(last, 1)) is not None and not meets(region, self.leaves[near]):
            last, region = near, region + self.leaves[near]
        self.encoded += len(region)
        parts = leaves_of(region)
        counts = [self.count(x) for x in parts]
        room = last - first + 1
        if len(parts) > room:  # more leaves than places: the tree grows, the others' counts stay
            of = self.tokens[self.base :]
            every = [*zip(self.leaves[:first], of[:first]), *zip(parts, counts), *zip(self.leaves[last + 1 :], of[last + 1 :])]
            some = [x for x in every if x[0]]
            self._plant([x for x, _ in some], [n for _, n in some])
            return
        for i, (leaf, n) in enumerate(zip(parts + [""] * (room - len(parts)), counts + [0] * (room - len(parts)), strict=True), first):
            self.leaves[i] = leaf
            self.chars[self.base + i], self.tokens[self.base + i] = len(leaf), n
        low, high = (self.base + first) // 2, (self.base + last) // 2
        while low:
            for i in range(low, high + 1):
                self._add(i)
            low, high = low // 2, high // 2


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """Documents (or trees) with their edits in order, from rows (doc_id, step, at, remove, insert); a column of that name is replaced."""
    own = edits.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("step", "at", "remove", "insert"))).alias("e"))
    own = own.select("_id", F.transform("e", lambda x: F.struct(x["at"].cast("long").alias("at"), x["remove"].cast("long").alias("remove"), x["insert"].alias("insert"))).alias("_edits"))
    keep = [c for c in docs.columns if c.lower() != edits_col.lower()]
    return docs.join(own, docs[id_col] == own["_id"], "left").select(*[docs[f"`{c}`"] for c in keep], F.col("_edits").alias(edits_col))


def _counter(path: str):
    enc = bpe.encoding(path)
    return lambda x: len(bpe.encode(enc, x))


def build_trees(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, tree, and the columns in ``keep``.  A null text is empty; an empty text has 0 tokens."""
    prepare(docs.sparkSession)
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                trees = [CountTree.of(t.as_py() or "", count) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), _column(trees), *b.columns[2:]], ["doc_id", "tree", *b.schema.names[2:]])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    more = "".join(f", `{c}` {kind(chosen, c)}" for c in keep)
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, tree {TREE}{more}")


def _column(trees: list[CountTree]) -> pa.Array:
    long = pa.list_(pa.int64())
    parts = [pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.chars for t in trees], long), pa.array([t.tokens for t in trees], long)]
    return pa.StructArray.from_arrays(parts, ["leaves", "chars", "tokens"])


def apply_edits(trees: DataFrame, path: str | None = None, *, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """One row per row of trees (doc_id, tree, edits): doc_id, tree (after the edits), n_chars, n_tokens, n_edits, new_chars, new_tokens, encoded_chars.

    ``edits_col`` holds the edits (at, remove, insert) in order, in characters of the text as it then stands; null or
    empty: none.  A null place, length or insert counts as 0, 0 and nothing.  ``encoded_chars`` is what the edits had
    encoded again; nothing else is.  ``path`` must be the vocabulary of the trees.  Repeated and null ids are kept.
    """
    prepare(trees.sparkSession)
    path = path or bpe.default_path()
    names = ["n_chars", "n_tokens", "n_edits", "new_chars", "new_tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                after, got = [], []
                for held, edits in zip(b.column("tree").to_pylist(), b.column("edits").to_pylist(), strict=True):
                    tree = CountTree(held["leaves"], held["chars"], held["tokens"], count)
                    row = [tree.chars[1], tree.total, len(edits or [])]
                    for e in edits or []:
                        tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                    got.append([*row, tree.chars[1], tree.total, tree.encoded])
                    after.append(tree)
                columns = [pa.array([r[k] for r in got], pa.int64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _column(after), *columns], ["doc_id", "tree", *names])

    chosen = trees.select(F.col(id_col).alias("doc_id"), "tree", F.col(edits_col).cast(EDIT).alias("edits"))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, tree {TREE}, " + ", ".join(f"{n} long" for n in names))


def count_tokens(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", keep_text: bool = False) -> DataFrame:
    """``build_trees`` and ``apply_edits`` in one pass, without the trees (with new_text, if kept).  Other columns are ignored; an empty table gives no rows."""
    trees = build_trees(docs.withColumn("_edits", F.col(edits_col).cast(EDIT)), path, id_col=id_col, text_col=text_col, keep=("_edits",))
    out = apply_edits(trees, path, edits_col="_edits")
    return (out.withColumn("new_text", F.array_join("tree.leaves", "")) if keep_text else out).drop("tree")


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted whole, then edited in four places that follow from its id and length, and counted again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")

    def edit(at, remove: int, insert: str):
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))

    edits = F.array(edit(n * 2 / 3, 7, ""), edit(F.pmod(F.coalesce("doc_id", F.lit(0)) * 7919, n + 1), 0, "don't re-encode"), edit(F.lit(0), 1, "Once "), edit(n + 99, 0, "  the end."))
    return count_tokens(docs.withColumn("edits", edits))
