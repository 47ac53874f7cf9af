"""Toxicity from class-conditional Kneser-Ney models of the characters of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, predict each byte of a word from up to five
before it.  N-grams seen fewer than ``RARE`` times in both classes together, and all of the two lowest orders, are smoothed
by counts that the classes share, so that rare expressions speak for neither class.  Compared are length-normalised
log-likelihoods: the difference per word over the whole text, and the largest over any ``WINDOWS`` words in a row (the text,
if it has fewer), so that a toxic passage in a long text shows.  Logistic regression on labelled texts that the models have
not seen turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import fold, kind, prepare, table
from intervale.llm.ngrams import Lookup, packed, word_blocks

ORDER, POOLED, DISCOUNT, RARE, CUT = 6, 2, 0.75, 3, 0.7
#: Lengths of the passages whose likelihoods per word are compared.
WINDOWS = (4, 16)
#: Labelled texts at most: of each class for the language models, and of both together for the calibration.
MODEL_SAMPLE, CALIBRATION_SAMPLE = 3000, 4000
_LOW = np.uint64(0xFF)


def _number(n: int) -> np.uint64:
    return np.uint64(n << (8 * n))


def _context(keys: np.ndarray, n: int) -> np.ndarray:
    """The first n - 1 bytes of packed n-grams, packed."""
    return ((keys - _number(n)) >> np.uint64(8)) + _number(n - 1)


def _suffix(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n - 1 bytes of packed n-grams, packed."""
    return (keys & (np.uint64((1 << (8 * (n - 1))) - 1))) + _number(n - 1)


def _first(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(8 * (n - 1))) & _LOW


@dataclass
class ClassModels:
    """For each order: the log-likelihood difference of its n-grams, and that of its contexts' backoff weights."""

    grams: dict[int, Lookup]
    backs: dict[int, Lookup]

    def word_differences(self, words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of distinct words."""
        out = np.zeros(len(words.start))
        for of, m, size in words.groups():
            total = np.zeros(len(of))
            shown = np.zeros(m.shape, np.float32)  # column j: the difference for the byte there
            for n in range(POOLED + 1, ORDER + 1):
                if m.shape[1] < n:
                    break
                keys = packed(m, n)
                inside = np.arange(n - 1, m.shape[1]) <= size[:, None] + 1
                ks = keys[inside]
                known = self.grams[n](ks)
                back = self.backs[n](_context(ks, n))
                low = shown[:, n - 1 :][inside]
                got = np.where(np.isnan(known), low + np.where(np.isnan(back), 0, back), known)
                shown[:, n - 1 :][inside] = got
            inside = np.arange(m.shape[1]) <= size[:, None] + 1
            inside[:, 0] = False
            np.sum(shown, 1, where=inside, out=total)
            out[of] = total
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text the difference per word: of the whole, and the largest of passages of each length."""
        rows = []
        for words in word_blocks(texts):
            d = self.word_differences(words)
            n = np.diff(words.first)
            mean = words.sums(d) / np.maximum(n, 1)
            rows.append(np.stack([mean, *(_largest(d[words.which], words.first, w, mean) for w in WINDOWS)], 1))
        return np.concatenate(rows) if rows else np.zeros((0, 1 + len(WINDOWS)))


def _largest(d: np.ndarray, first: np.ndarray, w: int, mean: np.ndarray) -> np.ndarray:
    """For each text the largest mean of ``w`` of its words in a row; of a shorter text its own mean."""
    out = mean.copy()
    total = np.concatenate(([0.0], np.cumsum(d)))
    long = np.flatnonzero(np.diff(first) >= w)
    if len(long):
        means = np.append((total[w:] - total[:-w]) / w, -np.inf)  # one for each place at which a passage may start
        bounds = np.stack([first[long], first[long + 1] - w + 1], 1).ravel()
        out[long] = np.maximum.reduceat(means, bounds)[::2]
    return out


def count_grams(texts: DataFrame) -> pd.DataFrame:
    """gram, toxic, ordinary: counts of the packed n-grams of the longest order (and word-initial shorter ones) by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls in (0, 1):
                mine = b.filter(pa.array([x == cls for x in b.column("toxic").to_pylist()]))
                for words in word_blocks(mine.column("text").to_pylist()):
                    times = np.bincount(words.which, minlength=len(words.start))
                    keys, counts = [], []
                    for of, m, size in words.groups():
                        for n in range(2, ORDER + 1):
                            if m.shape[1] >= n:
                                ks = packed(m, n)
                                # shorter n-grams only where they start a word: elsewhere they are counted by their left neighbours
                                wide = ks.shape[1] if n == ORDER else 1
                                inside = np.arange(n - 1, n - 1 + wide) <= size[:, None] + 1
                                keys.append(ks[:, :wide][inside])
                                counts.append(np.broadcast_to(times[of][:, None], inside.shape)[inside])
                    if keys:
                        u, back = np.unique(np.concatenate(keys), return_inverse=True)
                        c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c * cls), pa.array(c * (1 - cls))], ["gram", "toxic", "ordinary"])

    counts = texts.select("toxic", "text").mapInArrow(run, "gram long, toxic long, ordinary long")
    return counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas()


def kneser_ney(counted: pd.DataFrame) -> ClassModels:
    """The models of both classes from counts of their n-grams."""
    keys = counted["gram"].to_numpy(np.int64).view(np.uint64)
    c = counted[["toxic", "ordinary"]].to_numpy(np.float64)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    of_order = np.zeros(len(keys), np.int64)
    for n in range(2, ORDER + 1):
        of_order[(keys >= _number(n)) & (keys < _number(n) + np.uint64(1 << (8 * n)))] = n
    above: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(ORDER, 0, -1):
        ks, cs = keys[of_order == n], c[of_order == n]
        if above is not None:  # continuation counts: different bytes before
            more = _suffix(above[0], n + 1)
            ks, cs = np.concatenate((ks, more)), np.concatenate((cs, (above[1] > 0).astype(np.float64)))
        u, back = np.unique(ks, return_inverse=True)
        total = np.stack([np.bincount(back, cs[:, k], len(u)) for k in (0, 1)], 1) if len(u) else np.zeros((0, 2))
        above = (u, total)
        tables[n] = above
    grams, backs, lower, lower_keys = {}, {}, None, None
    for n in range(1, ORDER + 1):
        u, total = tables[n]
        if n <= POOLED:
            total = np.repeat(total.sum(1, keepdims=True), 2, 1)
        elif n > POOLED:
            total = np.where(total.sum(1, keepdims=True) >= RARE, total, 0)
        if n == 1:
            p = (total + 0.5) / (total + 0.5).sum(0) if len(u) else total
        else:
            contexts, of = np.unique(_context(u, n), return_inverse=True)
            mass = np.stack([np.bincount(of, total[:, k], len(contexts)) for k in (0, 1)], 1)
            kinds = np.stack([np.bincount(of, total[:, k] > 0, len(contexts)) for k in (0, 1)], 1)
            rest = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1e-9), 1.0)
            below = lower[np.searchsorted(lower_keys, _suffix(u, n))]
            p = np.maximum(total - DISCOUNT, 0) / np.maximum(mass[of], 1e-9) + rest[of] * below
            if n > POOLED:
                backs[n] = Lookup(contexts, np.log(rest[:, 0] / rest[:, 1]))
                grams[n] = Lookup(u, np.log(p[:, 0] / p[:, 1]))
        lower, lower_keys = p, u
    return ClassModels(grams, backs)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and coefficients (intercept last) by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6]) * len(x) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


@dataclass
class ToxicityModel:
    models: ClassModels
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.models.features(texts) - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model_sample: int = MODEL_SAMPLE, calibration_sample: int = CALIBRATION_SAMPLE) -> ToxicityModel:
    """Learns from labelled texts, at most ``2 * model_sample + calibration_sample`` of them: the first by a hash of their ids.

    Where an id has several labels the largest counts; null labels and ids are no examples.  The texts are split by that
    hash: four of ten calibrate, the others train the models.  Without texts of both classes every score is the share of
    toxic labels.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id")).withColumn("calibrates", F.pmod(F.xxhash64("h"), F.lit(10)) < 4)
    ids = []
    for part, n in ((F.col("calibrates"), calibration_sample), (~F.col("calibrates") & (F.col("toxic") == 1), model_sample), (~F.col("calibrates") & (F.col("toxic") == 0), model_sample)):
        ids.append(known.where(part).orderBy("h", "doc_id").limit(n).select("doc_id", "toxic", "calibrates"))
    chosen = ids[0].unionByName(ids[1]).unionByName(ids[2])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # bounded by the samples' sizes
    examples = texts.join(F.broadcast(chosen), "doc_id")
    models = kneser_ney(count_grams(examples.where("not calibrates")))
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    got = examples.where("calibrates").select("toxic", "text").mapInArrow(run, "toxic int, a double, b double, c double").toPandas()
    got = got.sort_values(["toxic", "a", "b", "c"])
    y = got["toxic"].to_numpy(np.float64)
    if len(set(y)) < 2:
        share = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel(models, np.zeros(3), np.ones(3), np.array([0, 0, 0, np.log(share / (1 - share))]))
    return ToxicityModel(models, *logistic(got[["a", "b", "c"]].to_numpy(), y))


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from ``CUT`` on).

    Whole texts are scored, and by nothing else.  A text without letters, empty or null gets the score of a text of which
    nothing is known.  Repeated and null ids are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                s = shared.value.scores(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, score double, predicted int")


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = fold("doc_id", 3) == 1
    model = fit(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
