"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Euclidean nearness becomes a maximum inner product: for a vector x and a query q, both less the sample's centre, the nearest
is the one with the largest ``q . x - |x|^2 / 2``.  The direction of x is cut into subspaces of two dimensions with 16
centroids each, so codes have four bits; its length is kept.  Centroids and codes minimise a loss that weighs the residual's
part parallel to the vector ``ETA`` times, since that part alone changes the scores of the queries that matter.

A scan looks the codes up, two at a time, in a query's table of partial products, which gives each row a score and, from
its residual, a band above that which holds the true one.  The bands' width is fitted on the sample, for its own nearest pairs.
The rows of the best scores of every step are ranked exactly, and then all whose band reaches the k-th best of those found so
far.  Which rows are ranked beyond the true neighbours so depends on how rows are dealt to steps; a result does only where a
true neighbour lies outside its band.  An infinite ``slack`` ranks every row exactly.

The index is fitted on at most ``SAMPLE`` rows; every row is in it.  Queries are met in blocks whose tables have
``TABLES`` entries of 256 numbers: one block at a time is on the driver and broadcast to a pass over the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import cut, prepare, table

SAMPLE, ETA, ROUNDS, TABLES, STEP = 8000, 4.0, 8, 1 << 16, 4096
#: The share of the sample's near pairs whose true score lies within the band.
WITHIN = 0.998
KIND = "query_id long, rank int, vec_id long, score double"


@dataclass
class Quantiser:
    centre: np.ndarray
    books: np.ndarray  # subspaces x 16 x 2
    slack: float = 4.0  # bands reach so many times |q| |x| |residual| / sqrt(width) above the score

    def directions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors (padded to an even width) and lengths of centred rows; a zero row has direction 0."""
        x = x - self.centre
        length = np.sqrt((x * x).sum(1))
        u = x / np.maximum(length, 1e-300)[:, None]
        return np.hstack([u, np.zeros((len(u), u.shape[1] % 2))]), length

    def encode(self, u: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (ETA - 1) (r . u)^2, r the residual of the unit vector u."""
        m = len(self.books)
        parts = u.reshape(len(u), m, 2)
        rest = parts[:, :, None, :] - self.books[None]
        far, along = (rest**2).sum(3), (rest * parts[:, :, None, :]).sum(3)  # rows x subspaces x 16
        codes, rows = far.argmin(2), np.arange(len(u))
        total = along[rows[:, None], np.arange(m), codes].sum(1)
        for _ in range(rounds):
            for s in range(m):
                other = total - along[rows, s, codes[:, s]]
                codes[:, s] = (far[:, s] + (ETA - 1) * (other[:, None] + along[:, s]) ** 2).argmin(1)
                total = other + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)

    def pull(self, u: np.ndarray, codes: np.ndarray) -> None:
        """Moves every centroid to where the loss is least, the others given: (I + w x x') c = x (1 + w (rest + |x|^2)), summed over its rows."""
        w, parts = ETA - 1, u.reshape(len(u), -1, 2)
        total = ((u - self.decode(codes)) * u).sum(1)
        for s in range(len(self.books)):
            x, of = parts[:, s], codes[:, s]
            rest = total - ((x - self.books[s, of]) * x).sum(1)
            n = np.bincount(of, minlength=16)
            a = np.zeros((16, 2, 2))
            for d in (0, 1):
                for e in (0, 1):
                    a[:, d, e] = np.bincount(of, w * x[:, d] * x[:, e], 16) + n * (d == e)
            gain = 1 + w * (rest + (x * x).sum(1))
            b = np.stack([np.bincount(of, x[:, d] * gain, 16) for d in (0, 1)], 1)
            some = n > 0
            self.books[s, some] = np.linalg.solve(a[some], b[some][:, :, None])[:, :, 0]
            total = rest + ((x - self.books[s, of]) * x).sum(1)


def train(x: np.ndarray, seed: int = 7) -> Quantiser:
    """A quantiser for rows like ``x``."""
    q = Quantiser(x.mean(0), np.zeros((0, 16, 2)))
    u, length = q.directions(x)
    rng = np.random.default_rng(seed)
    parts = u.reshape(len(u), -1, 2)
    q.books = np.stack([parts[rng.choice(len(u), 16, replace=len(u) < 16), s] for s in range(parts.shape[1])])
    for turn in range(ROUNDS):
        if turn < ROUNDS - 3:  # plain rounds first: each centroid the mean of its rows
            codes = np.concatenate([((parts[i : i + STEP, :, None, :] - q.books[None]) ** 2).sum(3).argmin(2) for i in range(0, len(u), STEP)])
            for s in range(parts.shape[1]):
                n = np.bincount(codes[:, s], minlength=16)
                for d in (0, 1):
                    mean = np.bincount(codes[:, s], parts[:, s, d], 16) / np.maximum(n, 1)
                    q.books[s, :, d] = np.where(n > 0, mean, q.books[s, :, d])
        else:
            q.pull(u, np.concatenate([q.encode(u[i : i + STEP], 1) for i in range(0, len(u), STEP)]))
    # bands: the errors of the inner products of a few hundred rows with those nearest to them
    codes = np.concatenate([q.encode(u[i : i + STEP]) for i in range(0, len(u), STEP)])
    near, rest = q.decode(codes), np.sqrt(((u - q.decode(codes)) ** 2).sum(1))
    asked = rng.choice(len(u), min(len(u), 256), replace=False)
    true = u[asked] @ u.T
    error = (true - u[asked] @ near.T) / np.maximum(rest, 1e-12) * np.sqrt(x.shape[1])
    score = true * length - (length**2 / 2 / np.maximum(length[asked], 1e-300)[:, None])
    best = np.argsort(-score, 1)[:, : min(64, len(u))]
    q.slack = max(0.0, float(np.quantile(np.take_along_axis(error, best, 1), WITHIN))) + 1e-9
    return q


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: not null, not zero, without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def build_index(rows: DataFrame, *, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser, int] | None:
    """Codes of all rows (vec_id, v, length, rest, code), the quantiser and the vectors' width; None if there are no rows.

    The width is the commonest, of equals the smallest; vectors of other widths take no part.
    """
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return None
    width = widths["width"]
    rows = rows.where(F.size("v") == width)
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    q = train(np.stack(first["v"].to_numpy()))
    shared = rows.sparkSession.sparkContext.broadcast(q)
    step = max(1, min(STEP, (1 << 18) // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                u, length = q.directions(_vectors(b.column("v"), width))
                codes = q.encode(u)
                rest = np.sqrt(((u - q.decode(codes)) ** 2).sum(1))
                if codes.shape[1] % 2:
                    codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
                pairs = codes[:, ::2] << 4 | codes[:, 1::2]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(length), pa.array(rest), pa.array([p.tobytes() for p in pairs], pa.binary())], ["vec_id", "v", "length", "rest", "code"])

    return cut(rows.mapInArrow(run, "vec_id long, v array<double>, length double, rest double, code binary")), q, width


def scan(index: DataFrame, shared, width: int, k: int) -> DataFrame:
    """Each partition's k nearest of each query of the broadcast (quantiser, slack, ids, queries): query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, slack, ids, queries = shared.value
        y = queries - q.centre
        size = np.sqrt((y * y).sum(1))
        part = np.einsum("qsd,scd->qsc", np.hstack([y, np.zeros((len(y), width % 2))]).reshape(len(y), -1, 2), q.books)
        if part.shape[1] % 2:
            part = np.concatenate((part, np.zeros((len(part), 1, 16))), 1)
        tables = (part[:, ::2, :, None] + part[:, 1::2, None, :]).reshape(len(y), -1, 256).astype(np.float32)
        limit = np.full(len(y), -np.inf)  # the score of the k-th best so far
        best = [(np.empty(0), np.empty(0, np.int64))] * len(y)

        def exact_to(i: int, x: np.ndarray) -> np.ndarray:
            return np.sqrt(((x - queries[i]) ** 2).sum(1))

        def score_of(i: int, d: float) -> float:
            return (size[i] ** 2 - d * d) / 2 - 1e-9 * (size[i] ** 2 + d * d)

        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                b = whole.slice(start, STEP)
                own, length = b.column("vec_id").to_numpy(), b.column("length").to_numpy()
                x = _vectors(b.column("v"), width)
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(own), -1).T
                half = length**2 / 2
                # float32 tables round; a little of each row's size covers that
                reach = slack * length * b.column("rest").to_numpy() / np.sqrt(width) + 1e-5 * length
                for i, query in enumerate(ids.tolist()):
                    dots = tables[i, 0][codes[0]]
                    for s in range(1, len(codes)):
                        dots += tables[i, s][codes[s]]
                    score = dots * length - half
                    score[own == query] = -np.inf
                    first, floor = np.argpartition(score, max(0, len(score) - k))[-k:], limit[i]
                    first = first[score[first] > -np.inf]
                    if len(first) == k:
                        floor = max(floor, score_of(i, exact_to(i, x[first]).max()))
                    near = np.union1d(np.flatnonzero(score + size[i] * reach >= floor), first)
                    near = near[own[near] != query]
                    exact = np.concatenate((best[i][0], exact_to(i, x[near])))
                    names = np.concatenate((best[i][1], own[near]))
                    top = np.lexsort((names, exact))[:k]
                    best[i] = exact[top], names[top]
                    if len(top) == k:
                        limit[i] = score_of(i, exact[top[-1]])
        found = [(np.full(len(n), query), n, d) for query, (d, n) in zip(ids.tolist(), best, strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return index.select("vec_id", "v", "length", "rest", "code").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, slack: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """Each query's k nearest vectors: query_id, rank (from 1), vec_id, score (Euclidean distance of the original vectors).

    ``queries`` are rows like ``vectors``.  A query is no candidate of its own (rows with its id).  Rows with a null id or
    whose vector is null, empty, zero, holds a null or non-finite component, or has another width than most take no part.
    Ties go to the smaller id; rows that repeat an id count each, but of queries that repeat one the least vector asks.
    With fewer than k candidates all are returned; empty tables give no rows.  Other columns are ignored.  ``slack``: the
    bands' width in place of the fitted one; infinity makes the search exact.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    built = build_index(usable(vectors, id_col, vector_col), sample=sample)
    if built is None:
        return spark.createDataFrame([], KIND)
    index, q, width = built
    asked = usable(queries, id_col, vector_col).where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    block = max(1, tables * 4 // width)
    blocks = -(-asked.count() // block)
    if not blocks:
        return spark.createDataFrame([], KIND)
    blocks = 1 if blocks == 1 else 2 * blocks
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = None
    for n in range(blocks):
        mine = asked.where(F.col("block") == n).select("vec_id", "v").orderBy("vec_id").toPandas()
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((q, q.slack if slack is None else slack, mine["vec_id"].to_numpy(), np.stack(mine["v"].to_numpy())))
        top = scan(index, shared, width, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # one block's queries and tables live at a time
            top = cut(top)
            shared.destroy()
        out = top if out is None else out.unionByName(top)
    return out


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)
