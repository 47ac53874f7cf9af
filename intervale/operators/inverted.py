"""Partitioned and quantised vector indexes.

``InvertedFile`` deals vectors to cells around centroids and keeps them as Parquet files partitioned by cell.  A query reads only
the files of the cells whose centroids are nearest to it; with all cells it is exact.  Batches are added to the
cells as they are.  Centroids are fitted on at most ``SAMPLE`` rows of the first batch.

``Quantised`` keeps a byte a component, clipped at a quantile of each, and with each row the length of what the byte lost.  A scan
multiplies whole numbers; from the row's loss follow bounds of its true score, and the rows that the bounds don't rule out are ranked
by their original vectors, so its results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators.index import SearchBackend
from intervale.operators.search import scores_of
from intervale.session import cut, prepare

#: Rows that centroids and clipping bounds are fitted on; the most cells; rows of a part and queries that meet at once.
SAMPLE, MOST_CELLS, PART, ASKED = 1 << 15, 4096, 1 << 14, 1 << 12
FOUND = "query_id long, id long, score double"
MEASURES = ("cosine", "ip", "l2")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _shaped(v: np.ndarray, measure: str) -> np.ndarray:
    """Vectors as cells see them: of length 1 for cosine."""
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None] if measure == "cosine" else v


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Rows whose v is not null, empty, without null or non-finite components, and of the width, if it is given."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("v", F.col("v").cast("array<double>")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows if width is None else rows.where(F.size("v") == width)


def _width(rows: DataFrame) -> int:
    """The commonest width, of equals the smallest."""
    top = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return top["w"] if top else 0


def _sampled(rows: DataFrame, n: int) -> np.ndarray:
    """At most n rows' vectors, by a hash of their ids."""
    return np.stack(rows.orderBy(F.xxhash64("id"), "id", "v").limit(n).select("v").toPandas()["v"].to_numpy())


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means of a bounded sample: each centroid the mean of its rows, empty ones moved to the rows that lie farthest."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of, far = _nearest(x, c)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    of, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), step):
        d = (c * c).sum(1) - 2 * x[at : at + step] @ c.T
        of[at : at + step], far[at : at + step] = d.argmin(1), d.min(1)
    return of, far + (x * x).sum(1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores (queries x rows), the largest first: queries, ids and scores of the first k, ties to the smaller id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
        i, j = np.nonzero(scores >= least[:, None])
    else:
        i, j = np.nonzero(~np.isnan(scores))
    s, name = scores[i, j], ids[j]
    order = np.lexsort((name, -s, i))
    i, s, name = i[order], s[order], name[order]
    start = np.searchsorted(i, np.arange(len(scores)))
    keep = np.arange(len(i)) - start[i] < k
    return i[keep], name[keep], s[keep]


def _ranked(found: DataFrame, measure: str, limit: int, offset: int) -> DataFrame:
    order = F.col("score").asc() if measure == "l2" else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return found.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("place", F.col("place") - offset)


class InvertedFile(SearchBackend):
    """An index of rows (id, v, payload) under a path, by cells of ``measure``; ``cells`` are as many as the root of the first batch's rows unless given."""

    def __init__(self, path: str, measure: str = "cosine", cells: int | None = None, probes: int = 8, sample: int = SAMPLE) -> None:
        if measure not in MEASURES:
            raise ValueError(f"unknown measure {measure!r}")
        self.path, self.measure, self.cells, self.probes, self.sample = path.rstrip("/"), measure, cells, probes, sample
        self.centres: np.ndarray | None = None
        self.spark = None

    def load(self, rows: DataFrame, payload: str | None = None) -> InvertedFile:
        """Adds rows (id, v) to the cells of their nearest centroids; the first rows are what centroids are fitted on.

        Rows of another width than most of the first batch's, and those without a usable vector, are left out.
        """
        self.spark = spark = rows.sparkSession
        prepare(spark)
        own = usable(rows.select("id", "v", *([F.col(payload).alias("payload")] if payload else [])))
        if self.centres is None:
            width = _width(own)
            if not width:
                return self
            own = own.where(F.size("v") == width)
            x = _shaped(_sampled(own, self.sample), self.measure)
            k = min(self.cells or max(1, round(own.count() ** 0.5)), MOST_CELLS, len(x))
            self.centres = centroids(x, k)
            spark.createDataFrame([(i, c) for i, c in enumerate(self.centres.tolist())], "cell int, c array<double>").write.parquet(f"{self.path}/centroids")
        own = own.where(F.size("v") == self.centres.shape[1])
        shared, measure, names = spark.sparkContext.broadcast(self.centres), self.measure, own.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of, _ = _nearest(_shaped(_matrix(b.column("v")), measure), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32))], [*names, "cell"])

        dealt = cut(own.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", cell int"))
        parts = dealt.groupBy("cell").count().withColumn("of", F.ceil(F.col("count") / PART)).drop("count")  # a row a cell
        spread = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")).drop("of")
        spread.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")
        return self

    def opened(self, spark) -> InvertedFile:
        """An index that is there already."""
        prepare(spark)
        self.spark = spark
        self.centres = np.array([r["c"] for r in spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()])  # at most MOST_CELLS
        return self

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def __len__(self) -> int:
        return 0 if self.centres is None else self.rows.count()

    def visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, q, cell: the cells that each query asks, by their centroids."""
        shared, measure = self.spark.sparkContext.broadcast(self.centres), self.measure
        probes = min(probes, len(self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, c = _shaped(_matrix(b.column("q")), measure), shared.value
                far = -q @ c.T if measure == "ip" else (c * c).sum(1) - 2 * q @ c.T
                cells = np.argsort(far, 1, kind="stable")[:, :probes]
                took = b.take(pa.array(np.repeat(np.arange(len(q)), probes)))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cells.ravel().astype(np.int32))], ["query_id", "q", "cell"])

        asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").alias("v")), self.centres.shape[1]).select("query_id", F.col("v").alias("q"))
        return asked.mapInArrow(run, "query_id long, q array<double>, cell int")

    def probed(self, visiting: DataFrame) -> DataFrame:
        """The rows of the cells that are visited: other cells' files are not read."""
        wanted = [r["cell"] for r in visiting.select("cell").distinct().collect()]  # at most MOST_CELLS
        return self.rows.where(F.col("cell").isin(wanted))

    def search(self, queries: DataFrame, limit: int, *, offset: int = 0, probes: int | None = None, itself: bool = True, with_payload: bool = True, with_vectors: bool = True) -> DataFrame:
        """query_id, place, id, score (and payload, v): the nearest rows (query_id, q) in the cells of the ``probes`` nearest centroids; in all rows, if there are no more cells than that."""
        measure, most = self.measure, offset + limit
        visiting = cut(self.visits(queries, probes or self.probes))
        held = self.probed(visiting)
        asked = visiting.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // ASKED)))).cast("int"))
        parts = held.select("cell", "part").distinct()
        asked = asked.join(parts, "cell")
        tasks = asked.select(F.col("cell").alias("_cell"), F.col("part").alias("_part"), F.col("chunk").alias("_chunk")).distinct()
        met = held.select(F.col("id").cast("long").alias("id"), "v", F.col("cell").alias("_cell"), F.col("part").alias("_part")).join(tasks, ["_cell", "_part"])

        def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
            names, ids = asked["query_id"].to_numpy(), rows["id"].to_numpy()
            out = []
            v = _matrix(rows["v"])
            for at in range(0, len(names), 256):
                s = np.round(scores_of(measure, v, _matrix(asked["q"].slice(at, 256))), 12).T
                if not itself:
                    s[names[at : at + 256, None] == ids[None, :]] = np.nan
                i, name, score = _top(np.where(np.isnan(s), -np.inf, s), ids, most)
                real = score > -np.inf
                out.append((names[at + i[real]], name[real], score[real] * (-1 if measure == "l2" else 1)))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

        found = asked.groupBy("cell", "part", "chunk").cogroup(met.groupBy("_cell", "_part", "_chunk")).applyInArrow(run, FOUND)
        found = _ranked(found, measure, limit, offset)
        more = [c for c, wanted in (("payload", with_payload), ("v", with_vectors)) if wanted and c in held.columns]
        return found.join(held.select("id", *more), "id").select("query_id", "place", "id", "score", *more) if more else found.select("query_id", "place", "id", "score")

    def retrieve(self, ids: DataFrame, *, with_vectors: bool = False) -> DataFrame:
        more = [c for c in ("payload", "v") if c in self.rows.columns and (c != "v" or with_vectors)]
        return self.rows.join(ids.select("id").distinct(), "id", "left_semi").select("id", *more)


@dataclass
class Bytes:
    """A byte a component: ``low`` and ``step`` of each."""

    low: np.ndarray
    step: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, quantile: float) -> Bytes:
        """Clipped so that the share ``quantile`` of each component lies within."""
        low, high = np.quantile(x, [(1 - quantile) / 2, (1 + quantile) / 2], axis=0)
        return Bytes(low, np.maximum(high - low, 1e-12) / 255)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step

    def products(self, codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries with coded rows (queries x rows), from products of whole numbers, and how far off the rounding of each query can be."""
        w = q * self.step
        unit = np.maximum(np.abs(w).max(1, keepdims=True), 1e-300) / 32767
        whole = np.rint(w / unit)
        # whole numbers below 2^53, held by doubles, multiply exactly
        return (whole @ codes.astype(np.float64).T) * unit + (q @ self.low)[:, None], np.abs(w - whole * unit).sum(1) * 255


class Quantised(SearchBackend):
    """An index of rows (id, v, payload) that scans a byte a component and gives exact results."""

    def __init__(self, measure: str = "cosine", quantile: float = 0.99, sample: int = SAMPLE) -> None:
        if measure not in MEASURES:
            raise ValueError(f"unknown measure {measure!r}")
        self.measure, self.quantile, self.sample = measure, quantile, sample
        self.bytes: Bytes | None = None
        self.rows = self.coded = None

    def load(self, rows: DataFrame, payload: str | None = None) -> Quantised:
        """Adds rows (id, v).  The first rows are what the clipping bounds are fitted on, by at most ``sample`` of them; any row may lie outside."""
        prepare(rows.sparkSession)
        own = usable(rows.select(F.col("id").cast("long").alias("id"), "v", *([F.col(payload).alias("payload")] if payload else [])))
        if self.measure == "cosine":
            own = own.where(F.exists("v", lambda x: x != 0))
        if self.bytes is None:
            width = _width(own)
            if not width:
                return self
            self.bytes = Bytes.fitted(_shaped(_sampled(own.where(F.size("v") == width), self.sample), self.measure), self.quantile)
        own = cut(own.where(F.size("v") == len(self.bytes.low)))
        shared, measure = rows.sparkSession.sparkContext.broadcast(self.bytes), self.measure

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ASKED):
                    b = whole.slice(at, ASKED)
                    x = _shaped(_matrix(b.column("v")), measure)
                    codes = shared.value.codes(x)
                    lost = np.sqrt(((x - shared.value.vectors(codes)) ** 2).sum(1))
                    columns = [b.column("id").to_numpy().tobytes(), codes.tobytes(), np.nextafter(lost.astype(np.float32), np.float32(np.inf)).tobytes(), (x * x).sum(1).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "codes", "lost", "length"])

        coded = cut(own.select("id", "v").mapInArrow(run, "ids binary, codes binary, lost binary, length binary"))
        self.rows = own if self.rows is None else cut(self.rows.unionByName(own, allowMissingColumns=True))
        self.coded = coded if self.coded is None else cut(self.coded.unionByName(coded))
        return self

    def __len__(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def candidates(self, queries: DataFrame, most: int, itself: bool) -> DataFrame:
        """query_id, id: every row that can be among a query's ``most`` nearest, by the bounds of its score.

        Queries are packed in blocks, rows as the index holds them; each block meets all rows, in one job.
        """
        measure, width = self.measure, len(self.bytes.low)
        shared = self.coded.sparkSession.sparkContext.broadcast(self.bytes)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("query_id").to_numpy().tobytes()], pa.binary()), pa.array([_shaped(_matrix(b.column("q")), measure).tobytes()], pa.binary())], ["names", "asked"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    ids, codes, lost, length, names, q = (np.frombuffer(b.column(c)[row].as_py(), t) for c, t in (("ids", np.int64), ("codes", np.uint8), ("lost", np.float32), ("length", float), ("names", np.int64), ("asked", float)))
                    q = q.reshape(len(names), width)
                    s, off = shared.value.products(codes.reshape(len(ids), width), q)
                    band = np.sqrt((q * q).sum(1))[:, None] * lost.astype(float) + off[:, None]
                    band += 1e-9 * (1 + np.abs(s) + length)
                    if measure == "l2":
                        s = s - length / 2
                    if not itself:
                        s[names[:, None] == ids[None, :]] = -np.inf
                    low, high = s - band, s + band
                    floor = np.partition(low, max(0, len(ids) - most), 1)[:, max(0, len(ids) - most)] if len(ids) > most else np.full(len(names), -np.inf)
                    i, j = np.nonzero((high >= floor[:, None]) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[j]), pa.array(low[i, j]), pa.array(high[i, j])], ["query_id", "id", "low", "high"])

        asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").alias("v")), width).select("query_id", F.col("v").alias("q"))
        if measure == "cosine":
            asked = asked.where(F.exists("q", lambda x: x != 0))
        blocks = cut(asked.mapInArrow(packed, "names binary, asked binary"))
        near = cut(self.coded.crossJoin(blocks).mapInArrow(run, "query_id long, id long, low double, high double"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "id"))
        floor = near.withColumn("n", nth).where(F.col("n") == most).select("query_id", F.col("low").alias("floor"))
        return near.join(floor, "query_id", "left").where("floor is null or high >= floor").select("query_id", "id")

    def search(self, queries: DataFrame, limit: int, *, offset: int = 0, itself: bool = True, with_payload: bool = True, with_vectors: bool = True) -> DataFrame:
        """query_id, place, id, score (and payload, v): exactly the nearest rows of each query (query_id, q), ties to the smaller id."""
        measure = self.measure
        near = self.candidates(queries, offset + limit, itself)
        own = self.rows.select("id", F.col("v").alias("_v"))
        met = near.join(own, "id").join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("_q")), "query_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, q = _matrix(b.column("_v")), _matrix(b.column("_q"))
                dots = (v * q).sum(1)
                if measure == "l2":
                    s = np.sqrt(((v - q) ** 2).sum(1))
                else:
                    s = dots if measure == "ip" else dots / np.sqrt((v * v).sum(1)) / np.sqrt((q * q).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(np.round(s, 12))], ["query_id", "id", "score"])

        found = _ranked(met.select("query_id", "id", "_v", "_q").mapInArrow(run, FOUND), measure, limit, offset)
        more = [c for c, wanted in (("payload", with_payload), ("v", with_vectors)) if wanted and c in self.rows.columns]
        return found.join(self.rows.select("id", *more), "id").select("query_id", "place", "id", "score", *more) if more else found.select("query_id", "place", "id", "score")

    def retrieve(self, ids: DataFrame, *, with_vectors: bool = False) -> DataFrame:
        more = [c for c in ("payload", "v") if c in self.rows.columns and (c != "v" or with_vectors)]
        return self.rows.join(ids.select("id").distinct(), "id", "left_semi").select("id", *more)
