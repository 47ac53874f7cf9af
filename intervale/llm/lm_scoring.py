"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary: all words of the corpus, one symbol for words it lacks, one
for the start of a text.  Both back off to their own smoothed word frequencies in the same way.  A text's score is the mean
over its words of the background's loss minus the target's: the higher, the more like the target.

Texts are packed in blocks, written once.  Each block asks for the counts of its distinct words, contexts and pairs (keys of
64 bits) and gives its own; requests meet by ranges of keys, at most one from each block for a key, and the totals go back
in the order of the block's sorted keys.  What is exchanged grows with the texts; the driver holds only three totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import cut, kind, prepare, table
from intervale.llm.words import blocks, mix, words_of

BACKOFF, FLOOR = 50.0, 0.5
#: Bytes of text in a block, for each range of keys, and in a packed row; a longer text stands alone.
BLOCK, ROW = 1 << 24, 1 << 21
#: Up to so many target ids are broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
_P, _C, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_ONE = np.uint64(1)


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def symbols(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """0 for other words, 1 on for the vocabulary's."""
    if not len(vocab):
        return np.zeros(len(h), np.int64)
    u, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(vocab, u), len(vocab) - 1)
    return np.where(vocab[at] == u, at + 1, 0)[back]


def pairs(raw: list[bytes], vocab: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For blocks of texts: each word's symbol pair (before * side + own), each text's first word, and the texts' number."""
    side = len(vocab) + 2
    for i, j in blocks(raw):
        *_, h, first = words_of(raw[i:j])
        own = symbols(h, vocab)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first[:-1][np.diff(first) > 0]] = side - 1
        yield before * side + own, first, j - i


def count_pairs(docs: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """Counts of symbol pairs in all texts of docs (text, wanted) and in the wanted ones: 2 x side x side, for few words only."""
    side = len(vocab) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, side * side), np.int64)
        for b in batches:
            for wanted in (0, 1):
                mine = b.filter(pa.array([bool(x) == bool(wanted) for x in b.column("wanted").to_pylist()], pa.bool_()))
                for pair, _, _ in pairs(_raw(mine.column("text").to_pylist()), vocab):
                    total[wanted] += np.bincount(pair, minlength=side * side)
        for at in range(0, side * side, 1 << 18):
            some = at + np.flatnonzero(total[:, at : at + (1 << 18)].any(0))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0, some] + total[1, some]), pa.array(total[1, some])], ["pair", "every", "target"])

    counts = docs.select("text", "wanted").mapInArrow(run, "pair int, every long, target long")
    got = counts.groupBy("pair").agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, side * side))
    out[0, got["pair"]], out[1, got["pair"]] = got["every"], got["target"]
    return out.reshape(2, side, side)


def encoded(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed: the upper planes of small numbers cost nothing."""
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def decoded(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[at], *[np.add.reduceat(c[order], at) if len(at) else c for c in counts]


@dataclass
class Keyed:
    """Keys of some texts' pairs (each after its words), words (odd) and contexts, and which of them each token has."""

    keys: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    context: np.ndarray
    some: np.ndarray  # a token of each distinct pair
    n: np.ndarray  # words of each text

    @staticmethod
    def of(raw: list[bytes]) -> Iterator[Keyed]:
        for i, j in blocks(raw):
            *_, h, first = words_of(raw[i:j])
            h = h | _ONE
            words, word = np.unique(h, return_inverse=True)
            fresh = first[:-1][np.diff(first) > 0]
            before, context = np.empty_like(h), np.empty_like(word)
            before[1:], context[1:] = h[:-1], word[:-1]
            before[fresh], context[fresh] = _START, len(words)
            pairs, some, pair = np.unique(mix(before * _P + h) & ~_ONE, return_index=True, return_inverse=True)
            contexts = mix(np.append(words, _START) ^ _C) & ~_ONE
            at = len(pairs)
            yield Keyed(np.concatenate((pairs, words, contexts)), pair, word + at, context + at + len(words), some, np.diff(first))

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = np.repeat(wanted, self.n)
        every, target = (sum(np.bincount(x[m], minlength=len(self.keys)) for x in (self.pair, self.word, self.context)) for m in (slice(None), mine))
        return every, target

    def losses(self, c: np.ndarray, words: int, vocabulary: int) -> np.ndarray:
        """Each text's summed loss (bits), given its keys' counts, all words and all distinct words of the model's texts."""
        share = (c[self.word[self.some]] + FLOOR) / (words + FLOOR * (vocabulary + 1))
        loss = np.log2(c[self.context[self.some]] + BACKOFF) - np.log2(c[: len(self.some)] + BACKOFF * share)
        return np.bincount(np.repeat(np.arange(len(self.n)), self.n), loss[self.pair], len(self.n))


def packed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (block, size, docs) of the texts in docs (doc_id, text, wanted), written: what block a text is in stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = np.array([len(x) for x in _raw(b.column("text").to_pylist())], np.int64)
            at = 0
            while at < len(size):
                many = max(1, int(np.searchsorted(np.cumsum(size[at:]), min(ROW, block), "right")))
                own = int(size[at : at + many].sum())
                if held and held + own > block:
                    number, held = number + 1, 0
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(b.slice(at, many))
                yield pa.RecordBatch.from_pylist([{"block": number, "size": own, "docs": sink.getvalue().to_pybytes()}])
                at, held = at + many, held + own

    return cut(docs.select("doc_id", "text", "wanted").mapInArrow(run, "block long, size long, docs binary"))


def _unpacked(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def requests(texts: DataFrame, ranges: int, *, counted: bool = True, asks: bool = True) -> DataFrame:
    """Rows (range, block, asks, keys, every, target): the distinct keys of each block and, if ``counted``, their counts."""
    cuts = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    names = ["range", "block", "asks", "keys", "every", "target"]

    def ask(block: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, every, target = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bounds = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i < j:
                row = [k, block, asks, encoded(np.diff(keys[i:j], prepend=np.uint64(0))), encoded(every[i:j]), encoded(target[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for block, docs in zip(b.column("block").to_pylist(), b.column("docs"), strict=True):
                if held and block != last:
                    yield from ask(last, held)
                    held = []
                last, t = block, _unpacked(docs.as_py())
                wanted, at = np.array(t["wanted"].to_pylist(), bool), 0
                for x in Keyed.of(_raw(t["text"].to_pylist())):
                    every, target = x.counts(wanted[at : at + len(x.n)])
                    held.append((x.keys, every * counted, target * counted))
                    at += len(x.n)
        if held:
            yield from ask(last, held)

    return texts.select("block", "docs").mapInArrow(run, "range int, block long, asks boolean, keys binary, every binary, target binary")


def answered(asked: DataFrame) -> DataFrame:
    """Rows (range, block, every, target) with the total counts of the keys that each block asked for, in their order.

    Where the block is null, words, all and wanted are the range's number of distinct words, of words, and of wanted words.
    """
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["range", "block", "every", "target", "words", "all", "wanted"]

    def run(t: pa.Table) -> pa.Table:
        own = [np.cumsum(decoded(x.as_py()), dtype=np.uint64) for x in t["keys"]]
        every, target = (np.concatenate([decoded(x.as_py()) for x in t[c]]).astype(np.int64) for c in ("every", "target"))
        keys, every, target = added(np.concatenate(own), every, target)
        known = (keys & _ONE).astype(bool) & (every > 0)
        of, asking = t["range"][0].as_py(), {}
        for block, asks, k in zip(t["block"].to_pylist(), t["asks"].to_pylist(), own, strict=True):
            if asks:
                asking.setdefault(block, []).append(k)
        rows = [(of, None, None, None, int(known.sum()), int(every[known].sum()), int(target[known].sum()))]
        for block, k in asking.items():
            at = np.searchsorted(keys, k[0] if len(k) == 1 else np.unique(np.concatenate(k)))
            rows.append((of, block, encoded(every[at]), encoded(target[at]), None, None, None))
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)], names)

    return asked.groupBy("range").applyInArrow(run, "range int, block long, every binary, target binary, words long, all long, wanted long")


@dataclass
class Model:
    """The packed texts that both models count, and into how many ranges their keys go."""

    texts: DataFrame
    ranges: int
    ids: str  # their type


def fit(docs: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Model:
    """Models of all texts of ``docs`` and of those whose id is in ``target_ids``.  Null ids are in no target."""
    prepare(docs.sparkSession)
    ids = target_ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("wanted", F.lit(True))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(ids, "_id", "left")
    texts = packed(texts.select(F.col("_id").alias("doc_id"), "text", F.coalesce("wanted", F.lit(False)).alias("wanted")), block)
    return Model(texts, 1 + (texts.agg(F.sum("size")).first()[0] or 0) // block, kind(docs, id_col))


def _scored(texts: DataFrame, asked: DataFrame, ids: str) -> DataFrame:
    got = cut(answered(asked))
    words, *totals = (int(x or 0) for x in got.where("block is null").agg(F.sum("words"), F.sum("all"), F.sum("wanted")).first())

    def run(mine: pa.Table, got: pa.Table) -> pa.Table:
        parts = [(t, list(Keyed.of(_raw(t["text"].to_pylist())))) for t in (_unpacked(x.as_py()) for x in mine["docs"])]
        keys = np.unique(np.concatenate([np.empty(0, np.uint64), *[x.keys for _, xs in parts for x in xs]]))
        order = np.argsort(got["range"].to_numpy())
        counts = [np.concatenate([np.empty(0), *[decoded(got[c][int(i)].as_py()) for i in order]]) for c in ("every", "target")]
        n, losses = [np.empty(0, np.int64)], [[np.empty(0)], [np.empty(0)]]
        for _, xs in parts:
            for x in xs:
                at = np.searchsorted(keys, x.keys)
                n.append(x.n)
                for to, c, total in zip(losses, counts, totals, strict=True):
                    to.append(x.losses(c[at], total, words))
        n = np.concatenate(n)
        low, high = (np.concatenate(x) / np.maximum(n, 1) for x in losses)
        ids = pa.concat_arrays([c for t, _ in parts for c in t["doc_id"].chunks])
        return pa.Table.from_arrays([ids, pa.array(n), pa.array(low), pa.array(high), pa.array(low - high)], ["doc_id", "n_words", "background_loss", "target_loss", "score"])

    got = got.where("block is not null").select("block", "range", "every", "target")
    schema = f"doc_id {ids}, n_words long, background_loss double, target_loss double, score double"
    return texts.select("block", "docs").groupBy("block").cogroup(got.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, background_loss, target_loss (bits a word), score (their difference).

    A text without words, or null, has losses and score 0.  Repeated and null ids are kept; other columns are ignored.
    """
    texts = packed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("wanted")))
    return _scored(texts, requests(model.texts, model.ranges, asks=False).unionByName(requests(texts, model.ranges, counted=False)), kind(docs, id_col))


def score_own(model: Model) -> DataFrame:
    """``score`` of the texts that the models were fitted on, whose keys are counted and asked for at once."""
    return _scored(model.texts, requests(model.texts, model.ranges), model.ids)


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of quality 1.  Background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_own(fit(docs, table(spark, sf_dir, "labels").where("quality = 1")))
