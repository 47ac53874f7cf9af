"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Rows are integer vectors, so that inner products are exact.  With one more coordinate, ``sqrt(M - |x|^2)`` (``M`` the
largest squared length), all rows lie on a sphere, and an anchor ``a``, whose own further coordinate is 0, has the distance
``sqrt(|a|^2 + M - 2 a . x)`` to a row: a window of scores is an annulus around the anchor, and a higher score is nearer.

1. A vantage-point tree, fitted on at most ``SAMPLE`` rows, deals all rows to at most ``MOST_CELLS`` cells: inside or outside
   a radius around each of a cell's vantage points.  Of all its rows a cell keeps the least and largest distance to each.
2. These bound an anchor's distance to a cell from below and above.  First every anchor visits the nearest cell that its
   annuli touch; what it finds there bounds how far it has to look, and then it visits the other cells within reach.
3. Cells are met in parts of ``part_rows`` rows or less, however many rows are alike, with so many anchors at once at most.  A task
   builds the tree of its part down to leaves and goes through them nearest first, for every anchor only as far as a leaf can
   still hold a better row.  What it hands on are the best rows of each window, so the result is exact and whole.

Positives are the same search with an annulus without bounds, among rows of the anchor's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import cut, prepare, table

SAMPLE, MOST_CELLS, LEAF = 16384, 1024, 256
#: A part's rows, and the anchors that meet it at once: four times the square root of all rows, within these bounds.
PARTS = (4096, 65536)
#: Squared lengths must lie below this, so that doubles hold every score exactly.
EXACT = 2.0**53
_FAR = 1 << 62
ASKED = "query_id long, label long, v array<long>, lo array<long>, hi array<long>"
FOUND = "query_id long, w int, vec_id long, score long"


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _padded(column, fill: int) -> np.ndarray:
    """A list column as a matrix, short rows filled up."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy()
    out = np.full((len(n), max(1, int(n.max(initial=1)))), fill, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy()
    return out


def reach(length: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """The distance at which a row has a score, by the anchors' squared lengths."""
    return np.sqrt(np.maximum(length.reshape((-1,) + (1,) * (score.ndim - 1)) + most - 2.0 * score.astype(np.float64), 0.0))


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))[:, None]])


@dataclass
class Tree:
    """Vantage points (augmented, in heap order) and radii of a complete tree of ``depth`` levels."""

    depth: int
    points: np.ndarray
    radius: np.ndarray

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of augmented rows, and their distances to the vantage points on their way."""
        node, path = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = np.sqrt(((x - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (path[:, level] > self.radius[node])
        return node - (1 << self.depth) + 1, path

    def on_the_way(self, level: int, cells: np.ndarray) -> np.ndarray:
        """The vantage point of that level on the way to each cell."""
        return ((cells + (1 << self.depth)) >> (self.depth - level)) - 1


def vantage(x: np.ndarray, rng: np.random.Generator, tries: int = 5) -> tuple[int, np.ndarray]:
    """Of a few rows the one whose distances to all spread most, and these distances."""
    best, at, far = -1.0, 0, np.zeros(len(x))
    for i in rng.choice(len(x), min(tries, len(x)), replace=False).tolist():
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        if d.var() > best:
            best, at, far = d.var(), i, d
    return at, far


def grow(x: np.ndarray, depth: int, seed: int = 5) -> Tree:
    """A tree for rows like the augmented ``x``; where no row is left to part, rows go inside."""
    rng, n = np.random.default_rng(seed), (1 << depth) - 1
    tree = Tree(depth, np.zeros((n, x.shape[1])), np.zeros(n))
    held = {0: np.arange(len(x))}
    for node in range(n):
        own = held.pop(node)
        if len(own):
            at, far = vantage(x[own], rng)
            tree.points[node], tree.radius[node] = x[own[at]], np.median(far)
            inside = far <= tree.radius[node]
            held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
        else:
            held[2 * node + 1] = held[2 * node + 2] = own
    return tree


def leaves(x: np.ndarray, size: int = LEAF, seed: int = 5) -> Iterator[tuple[np.ndarray, list[tuple[int, float, float]]]]:
    """A part's leaves, depth first: sorted places of rows, and for each vantage point on the way its place and the rows' least and largest distance."""
    rng, todo = np.random.default_rng(seed), [(np.arange(len(x)), [])]
    while todo:
        own, way = todo.pop()
        inside = np.zeros(0, bool)
        if len(own) > size:
            at, far = vantage(x[own], rng)
            inside = far <= np.median(far)
        if not len(inside) or inside.all():  # few rows, or rows that nothing parts
            yield own, way
            continue
        for side in (~inside, inside):
            todo.append((own[side], [*way, (int(own[at]), float(far[side].min()), float(far[side].max()))]))


def best(slot: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each slot by score (descending) and name."""
    order = np.lexsort((name, -score, slot))
    of = slot[order]
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    nth = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    return order[nth < k]


def search(asked: pa.Table, held: pa.Table, most: float, k: int, same: bool) -> pa.Table:
    """The k best rows of a part in each window of each anchor, of the anchor's label or of others."""
    ids = held.column("vec_id").to_numpy()
    if not len(ids):
        return pa.table([[]] * 4, pa.schema([("query_id", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]))
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], held.column("label").to_numpy()[order], _matrix(held.column("v"))[order]
    own, label, a = asked.column("query_id").to_numpy(), asked.column("label").to_numpy(), _matrix(asked.column("v"))
    lo, hi = _padded(asked.column("lo"), _FAR), _padded(asked.column("hi"), -_FAR)
    width, length = lo.shape[1], (a * a).sum(1)
    parts = list(leaves(augmented(x, most)))
    near, far = np.zeros((len(own), len(parts))), np.full((len(own), len(parts)), np.inf)
    at = sorted({p for _, way in parts for p, _, _ in way})
    to = dict(zip(at, reach(length, most, a @ x[at].T).T, strict=True)) if at else {}
    for n, (_, way) in enumerate(parts):
        for p, least, largest in way:
            near[:, n] = np.maximum(near[:, n], np.maximum(least - to[p], to[p] - largest))
            far[:, n] = np.minimum(far[:, n], to[p] + largest)
    slack = 1e-7 * (1 + np.sqrt(length + most))[:, None]
    near, far, floor = near - slack, far + slack, lo.copy()
    inner = reach(length, most, hi)
    slots, scores, names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    turn = np.argsort(near, 1, kind="stable")
    for r in range(len(parts)):
        leaf = turn[:, r]
        nearest, farthest = (np.take_along_axis(m, leaf[:, None], 1) for m in (near, far))
        open_ = (floor <= hi) & (nearest <= reach(length, most, floor)) & (farthest >= inner)
        active = open_.any(1)
        got = []
        for n in np.unique(leaf[active]).tolist():
            q, rows = np.flatnonzero(active & (leaf == n)), parts[n][0]
            s = a[q] @ x[rows].T
            fits = (s <= np.where(open_[q], hi[q], -_FAR).max(1)[:, None]) & (s >= np.where(open_[q], floor[q], _FAR).min(1)[:, None])
            fits &= ((labels[rows] == label[q][:, None]) == same) & (ids[rows] != own[q][:, None])
            i, j = np.nonzero(fits)
            value, i, j = s[i, j], q[i], rows[j]
            for w in range(width):
                inside = (value <= hi[i, w]) & (value >= floor[i, w])
                got.append((i[inside] * width + w, value[inside], ids[j[inside]]))
        if got:
            slots, scores, names = (np.concatenate(c) for c in zip((slots, scores, names), *got, strict=True))
            keep = best(slots, scores, names, k)
            slots, scores, names = slots[keep], scores[keep], names[keep]
            full = np.flatnonzero(np.bincount(slots, minlength=floor.size) == k)
            floor.reshape(-1)[full] = scores[np.searchsorted(slots, full, side="right") - 1].astype(np.int64)
    return pa.table([pa.array(own[slots // width]), pa.array((slots % width).astype(np.int32)), pa.array(names), pa.array(scores.astype(np.int64))], names=["query_id", "w", "vec_id", "score"])


@dataclass
class Index:
    rows: DataFrame  # vec_id, label, v, cell, salt
    tree: Tree
    most: float
    cells: np.ndarray
    low: np.ndarray  # cells x depth
    high: np.ndarray
    count: list[int]
    part_rows: int


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < EXACT))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(fine)
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < EXACT)
    return rows.select("vec_id", "label", F.transform("v", lambda x: x.cast("long")).alias("v"))


def build_index(rows: DataFrame, *, sample: int = SAMPLE, cell_rows: int | None = None, most_cells: int = MOST_CELLS) -> Index | None:
    """Deals rows (vec_id, label, v) to the cells of a tree; None if there are none.  Vectors of another width than most take no part."""
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return None
    rows = rows.where(F.size("v") == widths["width"])
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sample).select("v").toPandas()
    part = cell_rows or int(min(max(4 * widths["n"] ** 0.5, PARTS[0]), PARTS[1]))
    depth = (min(-(-widths["n"] // part), most_cells, max(1, len(first) // 16)) - 1).bit_length()
    tree = grow(augmented(np.stack(first["v"].to_numpy()).astype(np.float64), widths["most"]), depth)
    shared = rows.sparkSession.sparkContext.broadcast((tree, widths["most"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, most = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                cell, path = tree.route(augmented(_matrix(b.column("v")), most))
                path = pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * tree.depth, path.reshape(-1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(cell.astype(np.int32)), path], ["vec_id", "label", "v", "cell", "path"])

    dealt = cut(rows.mapInArrow(run, "vec_id long, label long, v array<long>, cell int, path array<double>").withColumn("salt", F.monotonically_increasing_id()))
    bounds = [f(F.col("path")[level]) for f in (F.min, F.max) for level in range(depth)]
    known = dealt.groupBy("cell").agg(F.count(F.lit(1)), *bounds).orderBy("cell").collect()  # a row a cell: at most MOST_CELLS
    stats = np.array([list(r)[2:] for r in known], np.float64).reshape(len(known), 2, depth)
    return Index(dealt.select("vec_id", "label", "v", "cell", "salt"), tree, widths["most"], np.array([r["cell"] for r in known]), stats[:, 0], stats[:, 1], [r[1] for r in known], part)


def visits(index: Index, asked: DataFrame, probe: bool) -> DataFrame:
    """Rows (query_id, label, v, lo, hi, cell) of the nearest cell that an anchor's annuli touch (``probe``), or of all others within reach of its windows of scores, lo to hi."""
    shared = asked.sparkSession.sparkContext.broadcast((index.tree, index.most, index.cells, index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, most, cells, low, high = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                a = _matrix(b.column("v"))
                length = (a * a).sum(1)
                to = reach(length, most, a @ tree.points[:, :-1].T)
                near, far = np.zeros((len(a), len(cells))), np.full((len(a), len(cells)), np.inf)
                for level in range(tree.depth):
                    d = to[:, tree.on_the_way(level, cells)]
                    near = np.maximum(near, np.maximum(low[:, level] - d, d - high[:, level]))
                    far = np.minimum(far, d + high[:, level])
                slack = 1e-7 * (1 + np.sqrt(length + most))[:, None]
                near, far = near - slack, far + slack
                lo, hi = _padded(b.column("lo"), _FAR), _padded(b.column("hi"), -_FAR)
                inner, outer = reach(length, most, hi), reach(length, most, lo)
                touched = np.where(far >= inner.min(1)[:, None], near, np.inf)
                first = np.zeros(near.shape, bool)
                first[np.arange(len(a)), touched.argmin(1)] = True
                wanted = first
                if not probe:
                    wanted = np.zeros(near.shape, bool)
                    for w in range(lo.shape[1]):
                        wanted |= (lo[:, w] <= hi[:, w])[:, None] & (near <= outer[:, w, None]) & (far >= inner[:, w, None])
                    wanted &= ~first
                i, j = np.nonzero(wanted)
                took = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cells[j].astype(np.int32))], [*took.schema.names, "cell"])

    return asked.select("query_id", "label", "v", "lo", "hi").mapInArrow(run, ASKED + ", cell int")


def meet(index: Index, visiting: DataFrame, anchors: int, k: int, same: bool) -> DataFrame:
    """query_id, w, vec_id, score: the k best rows that each visit finds in each window."""
    parts = [0] * (int(index.cells.max()) + 1)
    for cell, n in zip(index.cells.tolist(), index.count, strict=True):
        parts[cell] = -(-n // index.part_rows)
    of = F.element_at(F.lit(parts), F.col("cell") + 1)
    chunks = max(1, -(-anchors // index.part_rows))
    visiting = cut(visiting.withColumn("part", F.explode(F.sequence(F.lit(0), of - 1))).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")))
    tasks = visiting.select(F.col("cell").alias("_cell"), F.col("part").alias("_part"), F.col("chunk").alias("_chunk")).distinct()
    parted = index.rows.select("vec_id", "label", "v", F.col("cell").alias("_cell"), F.pmod(F.xxhash64("salt"), of).cast("int").alias("_part"))
    held, most = parted.join(tasks, ["_cell", "_part"]), index.most
    return visiting.groupBy("cell", "part", "chunk").cogroup(held.groupBy("_cell", "_part", "_chunk")).applyInArrow(lambda a, b: search(a, b, most, k, same), FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query's window, with their rank."""
    place = F.row_number().over(Window.partitionBy("query_id", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ranked(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, w, vec_id, score, rank: exactly the k best rows of each window of asked (query_id, label, v, lo, hi)."""
    anchors = asked.count()
    begun = cut(first_of(meet(index, visits(index, asked, True), anchors, k, same), k))
    # windows that are full look no further than their k-th best
    full = begun.where(F.col("rank") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    lo = F.transform("lo", lambda x, w: F.coalesce(F.element_at(F.col("kth"), w), x))
    narrowed = cut(asked.join(full, "query_id", "left").withColumn("lo", lo).drop("kth"))
    rest = meet(index, visits(index, narrowed, False), anchors, k, same)
    return cut(first_of(begun.drop("rank").unionByName(rest), k))


def mine(
    vectors: DataFrame, asks: Column, *, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", sample: int = SAMPLE, cell_rows: int | None = None, most_cells: int = MOST_CELLS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors: the rows for which ``asks`` (of vec_id) holds.

    Vectors hold integers, and scores are inner products.  An anchor's positives are the first rows of its label by score
    (ties to the smaller id), its own id's left out.  For each, the negatives are the first rows of another label whose scores
    are at most the positive's and at least ``percent`` of 100 of it; a negative positive score has none.  Fewer are returned where there are
    fewer.  Rows with a null id, label, vector or component, with an empty or non-finite one, of a squared length of 2^53 or
    more, or of another width than most take no part.  Rows that repeat an id count each; of anchors that repeat one the least
    (label, vector) asks.  An empty table gives no rows.  Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(usable(vectors, id_col, label_col, vector_col))
    index = build_index(rows, sample=sample, cell_rows=cell_rows, most_cells=most_cells)
    if index is None:
        return vectors.sparkSession.createDataFrame([], out)
    asked = index.rows.where(asks).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("query_id", "a.*")
    asked = cut(asked.withColumn("lo", F.array(F.lit(-_FAR))).withColumn("hi", F.array(F.lit(_FAR))))
    near = ranked(index, asked, positives, True).select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w"))
    # a window for each positive, by its place
    windows = near.where("positive_score >= 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("w", F.col("positive_score").alias("s")))).alias("x"))
    windows = windows.select("query_id", F.expr(f"transform(x.s, s -> (s * {int(percent)} + 99) div 100)").alias("lo"), F.col("x.s").alias("hi"))
    found = ranked(index, asked.drop("lo", "hi").join(windows, "query_id"), negatives, False)
    return found.join(near, ["query_id", "w"]).select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_vantage_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x.cast("double") * 256)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), whole.alias("embedding"))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
