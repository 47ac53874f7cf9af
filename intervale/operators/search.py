"""Exact vector search, bi-vector search, retrieval metrics and annotation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from intervale.session import cut, prepare

#: So many numbers of queries are on the driver and broadcast at once (2 MB), and so many scores in memory.
QUERY_NUMBERS, SCORES = 1 << 18, 1 << 20
#: So many queries of a random ranking meet all items in one task, one after another.
RANKED_AT_ONCE = 128


def scores_of(measure: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows by queries, the nearest largest; nan where there is none."""
    if measure == "l2":
        return -np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in q], 1)
    dots = v @ q.T
    with np.errstate(divide="ignore", invalid="ignore"):
        if measure == "cosine":
            dots /= np.sqrt((v * v).sum(1))[:, None]
            dots /= np.sqrt((q * q).sum(1))
        elif measure == "jaccard":
            a, b = (v > 0).astype(float), (q > 0).astype(float)
            dots = dots / (a.sum(1)[:, None] + b.sum(1) - a @ b.T)
        elif measure != "ip":
            raise ValueError(f"unknown measure {measure!r}")
    return dots


def knn(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "cosine", offset: int = 0, itself: bool = False, within: str | None = None) -> DataFrame:
    """query_id, id, place (from 1), score: k nearest of each query (query_id, q) among vectors (id, v), after ``offset`` of them.

    ``within``: a column of both sides whose values must agree.  Measures: cosine, ip (inner product), jaccard (of 0/1 vectors), and l2, whose score is a distance.  A query's own row is
    left out unless ``itself``.  Ties go to the smaller id.  Null vectors, and those that have no score, are no candidates.
    Exact: a block of queries is broadcast, partitions multiply their rows by it and hand on only what they rank first.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kinds = [x.dataType for x in (vectors.schema["id"], queries.schema["query_id"])]
    id_type, query_type = (to_arrow_type(k) for k in kinds)
    group = F.lit("") if within is None else F.col(within).cast("string")
    asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"), group.alias("g"))
    rows = vectors.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"), group.alias("g"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("w")).first()
    blocks = max(1, -(-size["n"] * (size["w"] or 1) // QUERY_NUMBERS))
    most, sign = offset + k, -1 if measure == "l2" else 1
    order = F.col("score").asc() if measure == "l2" else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    out = None
    for n in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).toPandas()
        if not len(own) and blocks > 1:
            continue
        shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), np.stack(own["q"].to_numpy()) if len(own) else np.zeros((0, 1)), own["g"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, groups = shared.value
            columns: dict = {}
            for i, name in enumerate(names.tolist()):
                columns.setdefault(name, []).append(i)
            best: tuple | None = None  # queries, scores and ids of what is ranked first so far
            floor = np.full(len(names), -np.inf)  # the least score that still counts, by query
            size = max(1, min(4096, SCORES // max(1, len(names))))
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    b = whole.slice(at, size)
                    ids = np.array(b.column("id").to_pylist())
                    v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    every = scores_of(measure, v, q)
                    np.round(every, 12, out=every)
                    if within is not None:
                        every[np.array(b.column("g").to_pylist(), object)[:, None] != groups[None, :]] = np.nan
                    if not itself:
                        for row, name in enumerate(ids.tolist()):
                            every[row, columns.get(name, [])] = np.nan
                    near = every >= floor  # not those without a score
                    if len(ids) > most and near.sum() > 4 * most * len(names):
                        np.copyto(every, -np.inf, where=np.isnan(every))
                        near &= every >= np.partition(every, len(ids) - most, axis=0)[len(ids) - most]
                    row, query = np.nonzero(near)
                    if len(row):
                        got = query, every[row, query], ids[row]
                        query, s, own = got if best is None else (np.concatenate(x) for x in zip(best, got, strict=True))
                        order = np.lexsort((own, -s, query))
                        query, s, own = query[order], s[order], own[order]
                        n = np.bincount(query, minlength=len(names))
                        top = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) < most
                        best = query, s, own = query[top], s[top], own[top]
                        full = np.flatnonzero(n >= most)
                        floor[full] = s[np.cumsum(np.minimum(n, most))[full] - 1]
            if best is not None:
                which, s, own = best
                yield pa.RecordBatch.from_arrays([pa.array(names[which].tolist(), query_type), pa.array(own.tolist(), id_type), pa.array(sign * s)], ["query_id", "id", "score"])

        ranked = rows.mapInArrow(run, f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double").withColumn("place", place).where(F.col("place") <= most)
        if blocks > 1:  # one block of queries lives at a time
            ranked = cut(ranked)
            shared.unpersist()
        out = ranked if out is None else out.unionByName(ranked)
    return out.where(F.col("place") > offset).withColumn("place", F.col("place") - offset)


def _packed(rows: DataFrame, key: str, name: str, size: int = 1024) -> DataFrame:
    """Rows (key, v) as blocks: <name>_ids, <name>_flat (all their numbers) and <name>_width; v of length 1, not a number where it has none."""
    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                vs = [np.array(v, float) if v is not None else np.empty(0) for v in b.column("v").to_pylist()]
                width = max(map(len, vs))
                x = np.full((len(vs), width), np.nan)
                for i, v in enumerate(vs):
                    if len(v) == width:
                        x[i] = v
                with np.errstate(divide="ignore", invalid="ignore"):
                    x /= np.sqrt((x * x).sum(1))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(key).to_pylist()], pa.list_(kind)), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([width], pa.int32())], [f"{name}_ids", f"{name}_flat", f"{name}_width"])

    return rows.select(key, "v").mapInArrow(run, f"{name}_ids array<{rows.schema[key].dataType.simpleString()}>, {name}_flat array<double>, {name}_width int")


def cosines(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, cosine of every row of left (left_key, v) with every one of right (right_key, v); null where a vector is null, zero or of another width.

    Vectors are scaled once; then blocks of both sides meet, and a pair of blocks is one product of matrices.
    """
    prepare(left.sparkSession)
    kinds = [left.schema[left_key].dataType, right.schema[right_key].dataType]
    arrow = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                n, m = len(x["a_ids"]), len(x["b_ids"])
                if x["a_width"] == x["b_width"]:
                    s = np.array(x["a_flat"], float).reshape(n, -1) @ np.array(x["b_flat"], float).reshape(m, -1).T
                else:
                    s = np.full((n, m), np.nan)
                ids = pa.array(x["a_ids"], arrow[0]).take(pa.array(np.repeat(np.arange(n), m))), pa.array(x["b_ids"], arrow[1]).take(pa.array(np.tile(np.arange(m), n)))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(s.ravel(), from_pandas=True)], [left_key, right_key, "cosine"])

    blocks = _packed(left, left_key, "a").crossJoin(_packed(right, right_key, "b"))  # blocks of up to 1024 rows, not rows
    return blocks.mapInArrow(run, f"{left_key} {kinds[0].simpleString()}, {right_key} {kinds[1].simpleString()}, cosine double")


def cosine_ends(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (least, most): the ends of the cosines of every row of left (id, v) with every one of right (id, v), of which a pair of blocks hands on its own two only."""
    prepare(left.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                if x["a_width"] == x["b_width"] and x["a_width"]:
                    s = np.array(x["a_flat"], float).reshape(len(x["a_ids"]), -1) @ np.array(x["b_flat"], float).reshape(len(x["b_ids"]), -1).T
                    s = s[~np.isnan(s)]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([s.min()]), pa.array([s.max()])], ["least", "most"])

    blocks = _packed(left, "id", "a").crossJoin(_packed(right, "id", "b"))
    return blocks.mapInArrow(run, "least double, most double").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """One index of the rows (id, ...) of several, with all their columns; ids go on from the largest of those before."""
    out = None
    for n, x in enumerate(indexes):
        x = x.withColumn("part", F.lit(n))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    sizes = out.groupBy("part").agg(F.max("id").alias("most"))
    shift = sizes.select("part", F.coalesce(F.sum(F.col("most") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    return out.join(F.broadcast(shift), "part").withColumn("id", F.col("id") + F.col("shift")).drop("part", "shift")  # a row an index


def first_limit(limit: int) -> int:
    """How many tags the first stage of a bi-vector search takes (a fixed rule)."""
    import math

    return int(math.log(limit) * 5) if limit > 10 else 5


def bivector(tags: DataFrame, vectors: DataFrame, limit: int, *, offset: int = 0, p: float = 1.0, q: float = 1.0, by: str = "score", measure: str = "cosine") -> DataFrame:
    """id, value, place (from 1): files found through the tags that stage one found, rows (tag_place from 0, tag_score, id).

    A file keeps its first tag's place and score.  Stage two asks with the vector of each such file for its ``limit`` nearest
    files, itself among them.  By score, a file found so is worth ``(p * tag score + q * own score) / 2``, where an l2
    distance d counts 1 - d; by rank, the larger of both places.  Of several ways to a file the best counts.
    """
    first = tags.groupBy("id").agg(F.min_by(F.struct("tag_place", "tag_score"), "tag_place").alias("t")).select(F.col("id").alias("query_id"), "t.*")
    asked = vectors.join(first.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = knn(asked, vectors.select("id", "v"), limit, measure, itself=True).join(first, "query_id")
    if by == "rank":
        best = found.groupBy("id").agg(F.min(F.greatest("tag_place", F.col("place") - 1)).alias("value"))
        order = F.col("value").asc()
    else:
        own = 1 - F.col("score") if measure == "l2" else F.col("score")
        best = found.groupBy("id").agg(F.max((p * F.col("tag_score") + q * own) / 2).alias("value"))
        order = F.col("value").desc()
    top = best.orderBy(order, "id").limit(offset + limit)
    place = F.row_number().over(Window.orderBy(order, "id"))  # of at most offset + limit rows
    return top.withColumn("place", place).where(F.col("place") > offset).withColumn("place", F.col("place") - offset)


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """Per query of rows (query_id, place, relevant 0/1): average precision, area under ROC, R-precision."""
    order = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    n = ranked.groupBy("query_id").agg(F.sum("relevant").alias("r"), F.count(F.lit(1)).alias("k"))
    x = ranked.withColumn("hits", F.sum("relevant").over(order)).join(n, "query_id")
    auc = F.sum(F.when(F.col("relevant") == 0, F.col("hits"))) / F.nullif(F.first("r") * (F.first("k") - F.first("r")), F.lit(0))
    return x.groupBy("query_id").agg(
        (F.sum(F.when(F.col("relevant") == 1, F.col("hits") / F.col("place")).otherwise(0.0)) / F.nullif(F.first("r"), F.lit(0))).alias("ap"),
        auc.alias("auc"),
        (F.sum(F.when(F.col("place") <= F.col("r"), F.col("relevant")).otherwise(0)) / F.nullif(F.first("r"), F.lit(0))).alias("rp"),
    )


def vote(neighbours: DataFrame, by: str, least: float = 0.5) -> DataFrame:
    """The most frequent label of the neighbours (by, place, score, label) with a score of at least ``least``; ties to the first seen."""
    good = neighbours.where(F.col("score") >= least).groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    best = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    won = good.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(by, "label")
    return neighbours.select(by).distinct().join(won, by, "left").select(by, F.coalesce(F.col("label").cast("string"), F.lit("Unknown")).alias("label"))


def majority(labels: DataFrame, by: str, label: str = "label") -> DataFrame:
    """by, label: the commonest label of each group, such as a cluster of annotated cells; ties to the first by name."""
    n = labels.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the queries of ``retrieval_metrics``; those that are undefined count in no mean."""
    return metrics.agg(F.avg("ap").alias("map"), F.avg("auc").alias("auc"), F.avg("rp").alias("rp"), F.count(F.lit(1)).alias("queries"))


def random_ranking(queries: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """query_id, id, place: all items (id) in a random order of each query's own (query_id), the baseline of retrieval metrics."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("id").cast("string")))
    pairs = items.select("id").crossJoin(queries.select("query_id")).withColumn("_h", h)  # the stated queries by all items
    return pairs.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("_h", "id")).alias("place"))


def random_metrics(queries: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """``retrieval_metrics`` of ``random_ranking`` for queries (query_id, wanted) and items (id, label), one of which is relevant if its label is the wanted one.

    The work is queries times items, but no pair is exchanged: a group of queries meets ids and labels of all items, and a query's order and
    its hits are gone before the next one's.  Items without an id take no part; keys are distinct.
    """
    prepare(queries.sparkSession)
    parts = max(1, -(-queries.count() // RANKED_AT_ONCE))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids = [x.encode() for x in rows["id"].to_pylist()]
        label = rows["label"].combine_chunks().dictionary_encode()
        code, known = label.indices.fill_null(-1).to_numpy(zero_copy_only=False), {x: i for i, x in enumerate(label.dictionary.to_pylist())}
        place, out = np.arange(1, len(ids) + 1), []
        for name, wanted in zip(asked["name"].to_pylist(), asked["wanted"].to_pylist(), strict=True):
            head = f"{seed}|{name}|".encode()
            h = np.frombuffer(b"".join([hashlib.md5(head + x).digest() for x in ids]), ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.argsort(h[:, 0])
            if (h[order[1:], 0] == h[order[:-1], 0]).any():
                order = np.lexsort((h[:, 1], h[:, 0]))
            got = code[order]
            relevant = got == known.get(wanted, -2)
            r = int(relevant.sum())
            hits, other = np.cumsum(relevant), ~relevant & (got >= 0)
            ap = float((hits[relevant] / place[relevant]).sum()) / r if r else None
            auc = float(hits[other].sum()) / (r * (len(ids) - r)) if r and other.any() else None
            out.append((ap, auc, float(hits[r - 1]) / r if r else None))
        return pa.table([asked["query_id"], *[pa.array(x, pa.float64()) for x in (zip(*out, strict=True) if out else [()] * 3)]], names=["query_id", "ap", "auc", "rp"])

    own = queries.select("query_id", F.col("query_id").cast("string").alias("name"), F.col("wanted").cast("string").alias("wanted"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    every = items.where("id is not null").select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return own.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(run, f"query_id {kind}, ap double, auc double, rp double")


def pool(vectors: DataFrame, by: str, how: str = "mean") -> DataFrame:
    """by, v: element-wise mean or max of the vectors (v) of each group; null vectors are skipped, groups of nothing else have none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    f = Summarizer.mean if how == "mean" else Summarizer.max
    pooled = vectors.where("v is not null").groupBy(by).agg(f(array_to_vector(F.col("v").cast("array<double>"))).alias("v"))
    return pooled.select(by, vector_to_array("v").alias("v"))


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a column scaled to [0, 1] over all of them; null where all are equal."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("_lo", "_hi")  # one row


def standardised(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with columns less their mean, by their population standard deviation; 0 where a column is constant."""
    stats = rows.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).select(rows.columns)  # one row
