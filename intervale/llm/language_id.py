"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword.  Each bit has a linear classifier over the relative frequencies of hashed byte n-grams,
fitted by ridge regression to the bits of a bounded sample of labelled texts.  Decoding sums, over bits, the logistic loss
of a text's margin against a language's bit, weighted by how well the bit was told apart in training; the language with
the least loss wins, and a text whose best two losses are close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import fold, kind, prepare, table
from intervale.llm.ngrams import packed, word_blocks
from intervale.llm.words import mix

BUCKET_BITS, ORDERS, RIDGE, SAMPLE, TOTAL = 13, (1, 2, 3, 4), 0.02, 300, 4000
UNDETERMINED = "und"
#: Below this gap between the best two languages' probabilities a text is ambiguous; below the second it is rejected.
AMBIGUOUS, REJECT = 0.2, 0.001


def codewords(languages: int) -> np.ndarray:
    """Bits (+1, -1) of each language: all splits of up to five languages, else 63 balanced pseudo-random ones."""
    if languages <= 5:
        n = max(1, 2 ** (languages - 1) - 1)
        bits = [[1 if k == 0 else 1 - 2 * ((c + 1) >> (k - 1) & 1) for c in range(n)] for k in range(languages)]
        return np.array(bits, np.float64)
    draw = mix(np.arange(languages * 63, dtype=np.uint64)).reshape(63, languages).argsort(1).argsort(1)
    return np.where(draw.T % 2 == 0, 1.0, -1.0)


def _buckets(words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length class of words: indices, hashed n-grams (words x places), and which places are within the word."""
    for of, m, size in words.groups():
        for n in ORDERS:
            if m.shape[1] >= n:
                h = (mix(packed(m, n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                yield of, h, np.arange(h.shape[1]) <= size[:, None] + 2 - n


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit; they sum to 1

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = []
        padded = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        for words in word_blocks(texts):
            value = np.zeros((len(words.start), padded.shape[1]), np.float32)
            count = np.zeros(len(words.start))
            for of, h, inside in _buckets(words):
                h = np.where(inside, h, len(padded) - 1)
                part = padded[h[:, 0]]
                for j in range(1, h.shape[1]):
                    part += padded[h[:, j]]
                value[of] += part
                count[of] += inside.sum(1)
            out.append(words.sums(value) / np.maximum(words.sums(count), 1)[:, None] + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its probability, and the gap to the second's."""
        loss = np.stack([(np.log1p(np.exp(np.clip(-3 * margins * code, -50, 50))) * self.trust).sum(1) for code in self.codes], 1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        best = p.argmax(1)
        return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from at most ``sample`` texts of each language (1000 whatever is asked for): those first by a hash of their ids.

    Together they are at most ``TOTAL``, or 8 a language where there are more than 500 languages.  Rows without text or label
    are no examples; without any every text with letters is ``und``.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sample = min(sample, 1000, max(8, TOTAL // max(1, rows.select("lang").distinct().count())))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            langs = b.column("lang")
            for words in word_blocks(b.column("text").to_pylist()):
                own: list[list] = [[] for _ in range(words.texts)]
                for t, w in zip(words.text_of.tolist(), words.which.tolist(), strict=True):
                    own[t].append(w)
                grams: list[np.ndarray] = [np.empty(0, np.int32)] * len(words.start)
                for of, h, inside in _buckets(words):
                    for i, row, ok in zip(of.tolist(), h, inside, strict=True):
                        grams[i] = np.concatenate((grams[i], row[ok]))
                buckets, shares = [], []
                for ws in own:
                    seen = np.bincount(np.concatenate([grams[w] for w in ws]) if ws else np.empty(0, np.int32), minlength=1 << BUCKET_BITS).astype(np.float32)
                    some = np.flatnonzero(seen)
                    buckets.append(some.astype(np.int16).tobytes())
                    shares.append((seen[some] / max(seen.sum(), 1)).tobytes())
                yield pa.RecordBatch.from_arrays([langs.slice(at, words.texts), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["lang", "buckets", "shares"])
                at += words.texts

    # at most sample x languages ids: bounded by the parameters
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).mapInArrow(run, "lang string, buckets binary, shares binary").toPandas()
    languages = sorted(got["lang"].unique())
    if not languages:
        return LanguageModel([UNDETERMINED], np.ones((1, 1)), np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), np.ones(1))
    got = got.sort_values(["lang", "buckets", "shares"], kind="stable")
    y = np.searchsorted(languages, got["lang"].to_numpy())
    x = np.zeros((len(got), 1 << BUCKET_BITS), np.float32)
    for row, buckets, shares in zip(x, got["buckets"], got["shares"], strict=True):
        row[np.frombuffer(buckets, np.int16)] = np.frombuffer(shares, np.float32)
    del got
    codes = codewords(len(languages))
    weights, bias, margins = ridge(x, y, codes)
    trust = 1 - np.minimum(0.5, ((margins * codes[y]) <= 0).mean(0)) + 1e-6
    return LanguageModel(languages, codes, weights, bias, trust / trust.sum())


def ridge(x: np.ndarray, y: np.ndarray, codes: np.ndarray, slab: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, bias and the examples' margins of the bits of classes ``y``, from examples ``x`` (float32).

    The driver holds ``x`` once and a matrix of examples by examples; in double precision ``x`` is only ever seen by slabs of its columns.
    """
    # each class weighs the same, whatever its number of examples
    weight = np.sqrt(len(y) / (len(codes) * np.bincount(y, minlength=len(codes))))[y][:, None]
    scale = 1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-5)
    slabs = [slice(at, at + slab) for at in range(0, x.shape[1], slab)]
    gram = weight @ weight.T  # the bias is a column of ones
    for s in slabs:
        z = x[:, s] * scale[s] * weight
        gram += z @ z.T
    gram.flat[:: len(x) + 1] += RIDGE * np.trace(gram) / len(x)
    dual = np.linalg.solve(gram, codes[y] * weight) * weight
    del gram
    weights, bias = np.empty((x.shape[1], codes.shape[1]), np.float32), dual.sum(0)
    margins = np.tile(bias, (len(x), 1))
    for s in slabs:
        z = x[:, s] * scale[s]
        w = z.T @ dual
        margins += z @ w
        weights[s] = w * scale[s][:, None]
    return weights, bias, margins


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous, gap.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous.  Otherwise ``score`` is the winner's
    probability after decoding.  Only the text is looked at, whole.  Repeated and null ids are kept.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(1).to_pylist()
                best, score, gap = model.decode(model.margins(texts))
                none = np.array([not any(map(str.isalpha, t or "")) for t in texts], bool)
                lang = np.where(none, UNDETERMINED, names[best])
                score, gap = np.where(none, 0.0, score), np.where(none, 0.0, gap)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(gap < AMBIGUOUS), pa.array(gap)], ["doc_id", "lang_pred", "score", "ambiguous", "gap"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, lang_pred string, score double, ambiguous boolean, gap double")


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language: those without letters (null and empty among them) and near ties are rejected.  An empty table stays empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(place).to_pylist()
                gap = model.decode(model.margins(texts))[2]
                some = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                yield b.filter(pa.array(some & (gap >= REJECT)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 4) == 2


def op10_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
