"""Evaluation of embeddings and hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.regions import cosine_distance, genome_distance, snpr, uniform
from intervale.operators import intervals, search
from intervale.session import cut


def gdst(pairs: DataFrame, scale: float = 1e10) -> DataFrame:
    """Slope of cosine distance on scaled genome distance over pairs (s1, e1, s2, e2, v1, v2)."""
    x = genome_distance(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")) / scale
    return pairs.select(F.regr_slope(cosine_distance(F.col("v1"), F.col("v2")), x).alias("slope"))


def region_pairs(regions: DataFrame, seed: int) -> DataFrame:
    """uid, other: for each region another one of its chromosome, any with equal chance; none where it is alone."""
    at = intervals.ranked(regions.select("uid", "chrom", "start"), ["uid"])
    sizes = regions.groupBy("chrom").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    drawn = F.floor(uniform(seed, "pair", F.col("uid")) * F.col("others")) + 1
    asked = at.join(F.broadcast(sizes), "chrom").withColumn("m", drawn)  # a row a chromosome
    asked = asked.select("uid", "chrom", (F.col("m") + F.when(F.col("m") >= F.col("n"), 1).otherwise(0)).alias("n"))
    return asked.join(at.select(F.col("uid").alias("other"), "chrom", "n"), ["chrom", "n"]).select("uid", "other")


def random_vectors(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """id, v: vectors of numbers in [-0.5, 0.5) / width that follow from the ids."""
    places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: (uniform(seed, "rand", F.concat_ws("|", F.col("id").cast("string"), p.cast("string"))) - 0.5) / width)
    return ids.select("id", places.alias("v"))


def neighbourhood_preservation(regions: DataFrame, vectors: DataFrame, k: int, *, step: int = 10, samples: int = 100, seed: int = 0, measure: str = "cosine") -> DataFrame:
    """k (step, 2 step, ...), qnpr, rnpr, snpr: how far the nearest regions on the genome are the nearest in the embedding.

    ``samples`` regions (uid, chrom, start, end) with vectors (id, v) are drawn, chromosomes by their regions; 0 takes all.
    For each, the share of its k nearest on the genome that are among its k nearest by vector on the same chromosome is
    averaged (qnpr), and so it is for random vectors (rnpr); snpr compares the two.
    """
    known = regions.join(vectors.where("v is not null").select(F.col("id").alias("uid"), "v"), "uid")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    asked = known.select("uid", "chrom")
    if samples:
        total = known.count()
        sizes = known.groupBy("chrom").agg(F.count(F.lit(1)).alias("of"))
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("npt"), F.col("uid").cast("string")))
        place = F.row_number().over(Window.partitionBy("chrom").orderBy("_h", "uid"))
        asked = asked.withColumn("_h", h).withColumn("_i", place).where(F.col("_i") <= samples).join(F.broadcast(sizes), "chrom")  # a row a chromosome
        asked = asked.where(F.col("_i") <= F.rint(F.lit(samples) * F.col("of") / F.lit(total))).select("uid", "chrom")
    genome = intervals.neighbours(known.select("uid", "chrom", "start", "end"), k).join(asked.select("uid"), "uid", "left_semi")
    shares = []
    for name, v in (("qnpr", known.select(F.col("uid").alias("id"), "chrom", "v")), ("rnpr", random_vectors(known.select(F.col("uid").alias("id"), "chrom"), width, seed).join(known.select(F.col("uid").alias("id"), "chrom"), "id"))):
        queries = v.join(asked.select(F.col("uid").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "chrom", F.col("v").alias("q"))
        near = search.knn(queries, v, k, measure, within="chrom").select(F.col("query_id").alias("uid"), F.col("id").alias("neighbour"), "place")
        shares.append(neighbour_overlap(genome, near, list(range(step, k + 1, step))).withColumnRenamed("overlap", name))
    out = shares[0].join(shares[1], "k")
    return out.select("k", "qnpr", "rnpr", snpr(F.col("qnpr"), F.col("rnpr")).alias("snpr"))


def run_statistics(runs: DataFrame, by: str, score: str) -> DataFrame:
    """by, mean, std: over the runs of an evaluation (population standard deviation)."""
    return runs.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def info_nce(pairs: DataFrame, scale: float) -> DataFrame:
    """loss: of a batch of pairs (id, a, b), the mean cross-entropy of each a's own b among all b and the other way round.

    Logits are ``exp(scale)`` times cosines.  A batch is what a training step takes, so all its pairs meet.
    """
    from intervale.functions.regions import cosine

    logits = pairs.select(F.col("id").alias("i"), "a").crossJoin(pairs.select(F.col("id").alias("j"), "b")).select("i", "j", (cosine(F.col("a"), F.col("b")) * F.exp(F.lit(scale))).alias("x"))
    sides = [logits.groupBy(c).agg((F.log(F.sum(F.exp(F.col("x") - F.lit(1.0) * F.exp(F.lit(scale))))) + F.exp(F.lit(scale)) - F.sum(F.when(F.col("i") == F.col("j"), F.col("x")))).alias("loss")) for c in ("i", "j")]
    return sides[0].select("loss").unionByName(sides[1].select("loss")).agg(F.avg("loss").alias("loss"))


def neighbour_overlap(one: DataFrame, two: DataFrame, steps: list[int]) -> DataFrame:
    """k, overlap: mean share of one's top k neighbours (uid, neighbour, place) that are in two's top k."""
    both = one.join(two.select("uid", "neighbour", F.col("place").alias("other")), ["uid", "neighbour"], "left")
    ks = both.select("uid", "place", "other", F.explode(F.array(*[F.lit(k) for k in steps])).alias("k")).where("place <= k")
    own = ks.groupBy("k", "uid").agg(F.sum(F.when(F.col("other") <= F.col("k"), 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("n"))
    return own.groupBy("k").agg(F.avg(F.col("hits") / F.col("n")).alias("overlap"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labellings (a, b)."""
    def two(x):
        return x * (x - 1) / 2

    cells = labels.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    a = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    b = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / two(F.col("t"))
    return s.crossJoin(a).crossJoin(b).select(((F.col("s") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))).alias("ari"))  # one row each


def paths(edges: DataFrame) -> DataFrame:
    """node, path (from the root) of a forest of edges (parent, child) of any depth; a cycle raises ``ValueError``.

    One join and one write for each level.
    """
    edges = cut(edges.select("parent", "child").distinct())
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    level = cut(roots.select("node", F.array("node").alias("path")))
    out = level
    while not level.isEmpty():
        met = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), "path")
        level = cut(met.select("node", F.concat("path", F.array("node")).alias("path"), F.array_contains("path", F.col("node")).alias("again")))
        if not level.where("again").isEmpty():
            raise ValueError("the edges have a cycle")
        level = level.drop("again")
        out = out.unionByName(level)
    if not edges.join(out, edges["child"] == out["node"], "left_anti").isEmpty():
        raise ValueError("the edges have a cycle")
    return out


def hierarchy_distance(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Edges between the nodes of pairs (a, b) by their paths; null if a node is missing."""
    x = pairs.join(known.select(F.col("node").alias("a"), F.col("path").alias("pa")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("path").alias("pb")), "b", "left")
    same = F.size(F.filter(F.zip_with("pa", "pb", lambda p, q: p == q), lambda e: e))
    return x.select("a", "b", F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), F.size("pa") + F.size("pb") - 2 * same).alias("distance"))


#: The least data and the share of it that probes are, in ``clustering_tendency``; the box of the uniform points.
LEAST_DATA, PROBES, BOX = 100, 0.1, (0.05, 0.95)


def clustering_tendency(vectors: DataFrame, most: int = 10_000, seed: int = 42) -> DataFrame:
    """score: y / (x + y), of squared distances from data probes (x) and from uniform points (y) to their nearest in the data.

    The data are min(rows, ``most``) vectors (id, v) drawn with replacement: a vector drawn twice is its own nearest, at 0.
    A tenth of the draws are probes, again with replacement; as many points are uniform between the 5th and the 95th
    percentile of each dimension.  Fewer than 100 draws raise ``ValueError``.
    """
    rows = cut(vectors.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v")))
    total = rows.count()
    n = min(total, most)
    if n < LEAST_DATA:
        raise ValueError(f"{n} vectors are too few")
    spark = rows.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"), (F.floor(uniform(seed, "draw", F.col("id")) * total) + 1).alias("n"))
    places = intervals.ranked(rows.select("id", F.lit("").alias("chrom"), F.col("id").alias("start")), []).select("id", "n")
    drawn = cut(draws.join(places, "n").join(rows, "id").select("draw", "id", "v"))  # at most ``most`` rows
    data = drawn.groupBy("id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    box = drawn.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.percentile("x", F.array(*[F.lit(b) for b in BOX])).alias("q"))
    probes = spark.range(int(n * PROBES)).select(F.col("id").alias("probe"), F.floor(uniform(seed, "probe", F.col("id")) * n).alias("draw")).join(drawn, "draw").groupBy("id").agg(F.count(F.lit(1)).alias("weight"))
    asked = probes.join(data, "id")
    near = search.knn(asked.where("times = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q")), data.select("id", "v"), 1, "l2")
    x = near.join(probes, near["query_id"] == probes["id"]).agg(F.coalesce(F.sum(F.col("score") * F.col("score") * F.col("weight")), F.lit(0.0)).alias("x"))
    key = F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string"))
    points = spark.range(int(n * PROBES)).crossJoin(F.broadcast(box))  # a row a dimension
    at = F.col("q")[0] + uniform(seed, "point", key) * (F.col("q")[1] - F.col("q")[0])
    points = points.select("id", "pos", at.alias("x")).groupBy((-1 - F.col("id")).alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("q"))
    y = search.knn(points, data.select("id", "v"), 1, "l2", itself=True).agg(F.sum(F.col("score") * F.col("score")).alias("y"))
    return x.crossJoin(y).select((F.col("y") / F.nullif(F.col("x") + F.col("y"), F.lit(0.0))).alias("score"))  # one row each


def clustered_ari(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """ari: how well k-means clusters of vectors (id, v, label) agree with the labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("label", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    found = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="b").fit(x).transform(x)
    return adjusted_rand(found.select(F.col("label").alias("a"), "b"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """id, p: the first k principal components of vectors (id, v), less their mean."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.where("v is not null").select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    x = StandardScaler(withMean=True, withStd=False, inputCol="f", outputCol="c").fit(x).transform(x)
    return PCA(k=k, inputCol="c", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("p"))


def _fold_r2(grams: np.ndarray, fold: int, n_in: int) -> float:
    """R2, averaged over the targets, on one fold of least squares learned from the others; grams: (fold, row, column) over 1, inputs, targets."""
    train, test = grams.sum(axis=0) - grams[fold], grams[fold]
    w = np.linalg.lstsq(train[:n_in, :n_in], train[:n_in, n_in:], rcond=None)[0]
    xy, yy = test[:n_in, n_in:], np.diag(test)[n_in:]
    error = np.maximum(yy - 2 * (w * xy).sum(axis=0) + (w * (test[:n_in, :n_in] @ w)).sum(axis=0), 0)
    spread = yy - test[0, n_in:] ** 2 / test[0, 0]
    exact = np.isclose(error, 0, atol=1e-9)
    return float(np.where(spread > 1e-9, 1 - error / np.where(spread > 1e-9, spread, 1), exact).mean())


def reconstruction(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Rows (fold, r2): how well a linear model restores the binary vectors ``b`` from the embeddings ``v`` of rows (id, v, b).

    Folds follow from a hash of the id, so reruns agree; empty folds have no row.  One scan sums a matrix of products for
    each fold and partition; sizes of all that follows depend on the dimensions alone.  Rows with null vectors take no part.
    """
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        inputs = 0
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                v, b = np.array(part["v"].tolist(), float), np.array(part["b"].tolist(), float)
                z = np.hstack([np.ones((len(v), 1)), v, b])
                sums[fold] = sums.get(fold, 0) + z.T @ z
                inputs = 1 + v.shape[1]
        for fold, m in sums.items():
            at = np.indices(m.shape)
            yield pd.DataFrame({"fold": fold, "inputs": inputs, "i": at[0].ravel(), "j": at[1].ravel(), "x": m.ravel()})

    def scores(cells: pd.DataFrame) -> pd.DataFrame:
        kept, fold = np.unique(cells["fold"], return_inverse=True)
        size = int(cells["i"].max()) + 1
        grams = np.zeros((len(kept), size, size))
        grams[fold, cells["i"], cells["j"]] = cells["x"]
        r2 = [_fold_r2(grams, k, int(cells["inputs"].iloc[0])) for k in range(len(kept))] if len(kept) > 1 else []
        return pd.DataFrame({"fold": kept[: len(r2)], "r2": r2})

    dealt = rows.where("v IS NOT NULL AND b IS NOT NULL").select(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(folds)).cast("int").alias("fold"), "v", "b")
    cells = dealt.mapInPandas(products, "fold int, inputs int, i int, j int, x double")
    cells = cells.groupBy("fold", "inputs", "i", "j").agg(F.sum("x").alias("x"))
    return cells.groupBy("inputs").applyInPandas(scores, "fold int, r2 double")
