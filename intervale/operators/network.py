"""Networks that map vectors to vectors: trained by gradients summed over partitions, scored by folds.

A round is one job.  Every task sums loss and gradient over its rows, for all the networks in training at once; the sums are added in
two levels, and the driver, which holds nothing but networks (their size follows from widths, not from rows), moves each along a
limited-memory quasi-Newton direction.  Rows stay where they were written, and no round shuffles them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.session import cut, prepare

#: Pairs of steps that a direction remembers, and the share of a step's promise that it must keep.
MEMORY, PROMISE = 10, 1e-4
SUMS = "net int, task int, g array<double>, loss double, n double, held double, m double"


def parameters(widths: list[int], seed: int) -> np.ndarray:
    """First weights of a network, one flat row: by layer, weights (in x out), then biases."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([(rng.random(a * b) * 2 - 1) * math.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(widths, widths[1:])])


def layers(flat: np.ndarray, widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(widths, widths[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(flat: np.ndarray, widths: list[int], x: np.ndarray) -> list[np.ndarray]:
    """The inputs and what each layer gives; all but the last are cut at 0."""
    got = [x]
    for i, (w, b) in enumerate(layers(flat, widths)):
        z = got[-1] @ w + b
        got.append(z if i == len(widths) - 2 else np.maximum(z, 0))
    return got


def _squared(out: np.ndarray, y: np.ndarray, sign: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    d = out - y
    return (d * d).mean(1), 2 * d / y.shape[1]


def _cosine(out: np.ndarray, y: np.ndarray, sign: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    no, ny = np.sqrt((out * out).sum(1)) + 1e-12, np.sqrt((y * y).sum(1)) + 1e-12
    c = (out * y).sum(1) / no / ny
    slope = y / (no * ny)[:, None] - (c / no**2)[:, None] * out
    alike = sign > 0
    return np.where(alike, 1 - c, np.maximum(c - margin, 0)), np.where(alike, -1.0, (c > margin) * 1.0)[:, None] * slope


#: Losses of a row and their slopes: mean squared difference; 1 - cosine of pairs, and what exceeds the margin of those that are none (sign -1).
LOSSES = {"squared": _squared, "cosine": _cosine}


def gradient(flat: np.ndarray, widths: list[int], x: np.ndarray, y: np.ndarray, sign: np.ndarray, loss: str, margin: float = 0.0) -> tuple[float, np.ndarray]:
    """The loss summed over rows, and its gradient."""
    got = forward(flat, widths, x)
    value, back = LOSSES[loss](got[-1], y, sign, margin)
    parts = []
    for i in range(len(widths) - 2, -1, -1):
        parts.append(np.concatenate([(got[i].T @ back).ravel(), back.sum(0)]))
        if i:
            back = (back @ layers(flat, widths)[i][0].T) * (got[i] > 0)
    return float(value.sum()), np.concatenate(parts[::-1])


class Descent:
    """One network's way down: where it stands, where it asks next, and the best place seen on the rows held back."""

    def __init__(self, at: np.ndarray, patience: int) -> None:
        self.asks, self.at, self.loss, self.slope = at, None, math.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.way, self.reach, self.patience = np.zeros_like(at), 1.0, patience
        self.best, self.best_held, self.waited, self.done = at, math.inf, 0, False
        self.losses: list[tuple[float, float]] = []

    def _direction(self) -> np.ndarray:
        q, kept = -self.slope, []
        for s, y in reversed(self.pairs):
            a = s @ q / (s @ y)
            kept.append(a)
            q = q - a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q = q + s * (a - y @ q / (s @ y))
        return q

    def told(self, loss: float, slope: np.ndarray, held: float) -> None:
        """Takes what the place asked for gave, and chooses the next."""
        if self.at is not None and not loss <= self.loss + PROMISE * self.reach * (self.slope @ self.way):
            self.reach /= 4
            self.done = self.reach < 1e-8
        else:
            if self.at is not None:
                s, y = self.asks - self.at, slope - self.slope
                if s @ y > 1e-12:
                    self.pairs = [*self.pairs, (s, y)][-MEMORY:]
            self.at, self.loss, self.slope = self.asks, loss, slope
            self.losses.append((loss, held))
            if held < self.best_held - 1e-9:
                self.best, self.best_held, self.waited = self.at, held, 0
            else:
                self.waited += 1
            self.done = self.waited >= self.patience or float(np.abs(slope).max()) < 1e-7
            self.way = self._direction()
            if self.slope @ self.way >= 0:
                self.pairs, self.way = [], -self.slope
            self.reach = 1.0 if self.pairs else min(1.0, 1 / (float(np.sqrt(slope @ slope)) + 1e-12))
        self.asks = self.at + self.reach * self.way


@dataclass
class Network:
    """A trained network; ``losses`` are pairs (on the rows learned from, on those held back), one for each step taken."""

    widths: list[int]
    flat: np.ndarray
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: np.ndarray
    y_std: np.ndarray
    losses: list[tuple[float, float]] = field(default_factory=list)

    def of(self, x: np.ndarray) -> np.ndarray:
        return forward(self.flat, self.widths, (x - self.x_mean) / self.x_std)[-1] * self.y_std + self.y_mean

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Adds ``p`` to vectors (v, ...): null where ``v`` is null, of another width or not finite."""
        prepare(vectors.sparkSession)
        rest = [c for c in vectors.columns if c != "p"]
        kind = vectors.select(*rest, F.lit(None).cast("array<double>").alias("p")).schema
        wanted = vectors.select(*rest, F.when(_whole("v", self.widths[0]), F.col("v").cast("array<double>")).alias("_v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(len(rest))
                some = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                got: list = [None] * len(v)
                for i, p in zip(some.tolist(), self.of(_matrix(v.drop_null(), self.widths[0])).tolist() if len(some) else [], strict=True):
                    got[i] = p
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(got, pa.list_(pa.float64()))], names=[*rest, "p"])

        return wanted.mapInArrow(run, kind)

    def encoder(self, encode: Callable) -> Callable:
        """An encoder of texts for the searches of ``index``: ``encode`` and then the network; texts that it can't place have null vectors."""
        return lambda rows, key, text: self.predict(encode(rows, key, text)).select(key, F.col("p").alias("v"))

    def save(self, spark: SparkSession, path: str) -> None:
        """As Parquet: a row for each part of the network; refuses to overwrite."""
        parts = {"widths": np.array(self.widths, float), "flat": self.flat, "x_mean": self.x_mean, "x_std": self.x_std, "y_mean": self.y_mean, "y_std": self.y_std}
        spark.createDataFrame([(k, x.tolist()) for k, x in parts.items()], "part string, x array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    got = {r["part"]: np.array(r["x"], float) for r in spark.read.parquet(path).collect()}  # six rows
    return Network([int(w) for w in got.pop("widths")], **got)


def _whole(name: str, width: int | None = None):
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(name).isNotNull() & finite & (F.size(name) > 0 if width is None else F.size(name) == width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ready(rows: DataFrame, folds: int, seed: int) -> tuple[DataFrame, list[int]]:
    """Rows (fold, v, y, sign) that can be learned from, written once, and the widths of v and y."""
    prepare(rows.sparkSession)
    sign = F.coalesce(F.col("sign").cast("double"), F.lit(1.0)) if "sign" in rows.columns else F.lit(1.0)
    x = rows.where(F.col("id").isNotNull() & _whole("v") & _whole("y"))
    x = cut(x.select(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(folds)).cast("int").alias("fold"), F.col("v").cast("array<double>").alias("v"), F.col("y").cast("array<double>").alias("y"), sign.alias("sign")))
    w = x.agg(F.min(F.size("v")), F.max(F.size("v")), F.min(F.size("y")), F.max(F.size("y"))).first()
    if w[0] != w[1] or w[2] != w[3]:
        raise ValueError(f"vectors of unequal width: {w[0]} to {w[1]}, {w[2]} to {w[3]}")
    return x, [] if w[0] is None else [w[0], w[2]]


def _scales(rows: DataFrame, ends: list[int], folds: int) -> np.ndarray:
    """By fold: the number of rows, and sums and sums of squares of v and of y."""
    size = 1 + 2 * sum(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size))
        for b in batches:
            z = np.hstack([_matrix(b.column(1), ends[0]), _matrix(b.column(2), ends[1])])
            np.add.at(sums, b.column(0).to_numpy(), np.hstack([np.ones((len(z), 1)), z, z * z]))
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, size), pa.int32()), pa.array(np.tile(np.arange(size), len(at)), pa.int32()), pa.array(sums[at].ravel())], names=["fold", "i", "x"])

    out = np.zeros((folds, size))
    for r in rows.select("fold", "v", "y").mapInArrow(run, "fold int, i int, x double").groupBy("fold", "i").agg(F.sum("x").alias("x")).collect():  # folds times widths
        out[r["fold"], r["i"]] = r["x"]
    return out


def _added(sums: DataFrame, tasks: int) -> list:
    """The sums of all tasks by network, added in two levels, in the order of tasks."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        own = pdf[["loss", "n", "held", "m"]].sum()
        return pd.DataFrame({"net": [pdf["net"].iloc[0]], "task": [pdf["task"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].tolist()), axis=0)], **{k: [v] for k, v in own.items()}})

    some = max(1, math.isqrt(tasks))
    if some > 4:
        sums = sums.groupBy("net", F.floor(F.col("task") / some).alias("_t")).applyInPandas(add, SUMS)
    return sums.groupBy("net").applyInPandas(add, SUMS).collect()  # a row a network


def _fit(rows: DataFrame, ends: list[int], folds: int, splits: list[tuple[set[int], set[int]]], hidden: tuple[int, ...], loss: str, rounds: int, patience: int, decay: float, margin: float, seed: int) -> list[Network]:
    """A network for each split (folds held back, folds unseen); all are trained in the same rounds."""
    widths = [ends[0], *hidden, ends[1]]
    stats, nets = _scales(rows, ends, folds), []
    for held, unseen in splits:
        s = stats[[f for f in range(folds) if f not in held | unseen]].sum(0)
        n, a = max(s[0], 1), sum(ends)
        mean = s[1 : 1 + a] / n
        std = np.sqrt(np.maximum(s[1 + a :] / n - mean**2, 0))
        std[std < 1e-9] = 1
        if loss != "squared":  # angles are of the vectors as they are
            mean, std = np.zeros(a), np.ones(a)
        flat = parameters(widths, seed)
        if loss == "squared":  # a network that has learned nothing gives the mean
            flat[-(widths[-2] + 1) * widths[-1] :] = 0
        nets.append(Network(widths, flat, mean[: ends[0]], std[: ends[0]], mean[ends[0] :], std[ends[0] :]))
    ways = [Descent(net.flat, patience) for net in nets]
    tasks = rows.rdd.getNumPartitions()
    for _ in range(rounds):
        asked = [(k, way.asks) for k, way in enumerate(ways) if not way.done]
        if not asked:
            break
        got = {r["net"]: r for r in _added(rows.mapInArrow(_sums(asked, nets, splits, loss, margin), SUMS), tasks)}
        for k, flat in asked:
            r = got.get(k)
            n = max(r["n"], 1) if r else 1
            own = (r["loss"] / n, np.array(r["g"]) / n) if r else (0.0, np.zeros_like(flat))
            held = r["held"] / r["m"] if r and r["m"] else own[0]
            ways[k].told(own[0] + decay / 2 * float(flat @ flat), own[1] + decay * flat, held)
    for net, way in zip(nets, ways, strict=True):
        net.flat, net.losses = way.best, way.losses
    return nets


def _sums(asked: list, nets: list[Network], splits: list, loss: str, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = {k: [np.zeros_like(flat), 0.0, 0, 0.0, 0] for k, flat in asked}
        for b in batches:
            fold, sign = b.column(0).to_numpy(), b.column(3).to_numpy()
            v, y = _matrix(b.column(1), nets[0].widths[0]), _matrix(b.column(2), nets[0].widths[-1])
            for k, flat in asked:
                net, s, (held, unseen) = nets[k], sums[k], splits[k]
                x, t = (v - net.x_mean) / net.x_std, (y - net.y_mean) / net.y_std
                kept, own = np.isin(fold, list(held)), ~np.isin(fold, list(held | unseen))
                value, g = gradient(flat, net.widths, x[own], t[own], sign[own], loss, margin)
                s[0] += g
                s[1] += value
                s[2] += int(own.sum())
                s[3] += float(LOSSES[loss](forward(flat, net.widths, x[kept])[-1], t[kept], sign[kept], margin)[0].sum())
                s[4] += int(kept.sum())
        task = TaskContext.get().partitionId()
        some = [(k, *s) for k, s in sums.items() if s[2] or s[4]]
        columns = list(zip(*some)) if some else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array([task] * len(some), pa.int32()), pa.array([g.tolist() for g in columns[1]], pa.list_(pa.float64())), *[pa.array([float(z) for z in c], pa.float64()) for c in columns[2:]]],
            names=["net", "task", "g", "loss", "n", "held", "m"],
        )

    return run


def train(rows: DataFrame, *, hidden: tuple[int, ...] = (256,), loss: str = "cosine", rounds: int = 100, patience: float = 0.2, folds: int = 10, decay: float = 1e-4, margin: float = 0.0, seed: int = 1) -> Network:
    """A network from ``v`` to ``y`` of rows (id, v, y[, sign]): layers of ``hidden`` widths cut at 0, then a linear one.

    ``loss`` is "squared" (of values scaled to mean 0 and deviation 1) or "cosine", where rows of sign -1 are pushed apart down to
    ``margin``.  One fold of the ids' hashes is held back: training ends when ``patience`` times ``rounds`` steps in a row have not bettered
    its loss, and the best network is kept; without rows there, the loss of all others decides.  Rows with null ids or with vectors that are
    null, empty or not finite take no part; vectors of unequal width, or no rows, raise ``ValueError``.  The same rows in the same files give
    the same network.
    """
    if loss not in LOSSES:
        raise ValueError(f"no such loss: {loss}")
    x, ends = _ready(rows, folds, seed)
    if not ends:
        raise ValueError("no rows to learn from")
    return _fit(x, ends, folds, [({0}, set())], hidden, loss, rounds, math.ceil(patience * rounds), decay, margin, seed)[0]


def reconstruction(rows: DataFrame, folds: int = 5, *, hidden: tuple[int, ...] = (200,), rounds: int = 60, patience: float = 0.2, decay: float = 1e-4, seed: int = 42) -> DataFrame:
    """Rows (fold, r2): how well networks restore the vectors ``b`` from the embeddings ``v`` of rows (id, v, b), fold by fold.

    As ``evaluate.reconstruction``, on the same folds, with networks in place of least squares.  Each fold is scored by a network that saw
    neither it nor, but for when to stop, the one after it.  R2 is averaged over the outputs; one without spread counts 1 if it is met, else 0.  Folds
    without rows have no row, nor have less than three folds with rows.
    """
    spark = rows.sparkSession
    x, ends = _ready(rows.withColumnRenamed("b", "y"), folds, seed)
    have = sorted(r["fold"] for r in x.select("fold").distinct().collect()) if ends else []
    if len(have) < 3:
        return spark.createDataFrame([], "fold int, r2 double")
    splits = [({have[(i + 1) % len(have)]}, {f}) for i, f in enumerate(have)]
    nets = _fit(x, ends, folds, splits, hidden, "squared", rounds, math.ceil(patience * rounds), decay, 0.0, seed)
    of = dict(zip(have, nets, strict=True))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, v, y = b.column(0).to_numpy(), _matrix(b.column(1), ends[0]), _matrix(b.column(2), ends[1])
            for f in np.unique(fold).tolist():
                own = fold == f
                d, n = y[own] - of[f].of(v[own]), ends[1]
                sums = [np.full(n, float(own.sum())), (d * d).sum(0), y[own].sum(0), (y[own] ** 2).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), *map(pa.array, sums)], names=["fold", "i", "n", "e", "s", "q"])

    sums = x.select("fold", "v", "y").mapInArrow(errors, "fold int, i int, n double, e double, s double, q double").groupBy("fold", "i").agg(*[F.sum(c).alias(c) for c in "nesq"])
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return sums.groupBy("fold").agg(F.avg(F.when(spread > 1e-9, 1 - F.col("e") / spread).otherwise((F.col("e") < 1e-9).cast("double"))).alias("r2"))
