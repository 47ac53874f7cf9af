"""Near-duplicate documents by chosen-path set similarity join, with links confirmed on whole shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a 128-bit digest of the set, and ``COORDS``
   minwise tokens.  Texts with equal sets are one *class*; only a class's representative goes on.
2. ``TREES`` independent trees branch the representatives.  A node picks one coordinate and, with probability
   ``1/similarity - 1``, a second one; a set goes to the child named by its minwise token there.  Two sets of the wanted
   similarity so share one child in expectation at every depth, and unlike sets soon part.
3. After every ``STEP`` levels nodes are counted.  Nodes of one set are done, nodes of at most ``SMALL`` are compared
   exhaustively, larger ones branch on.  Where branching no longer shrinks them (dense groups) they are compared in blocks: all sets
   against a pivot block, then the sets that this leaves outside the node's main component against all blocks - so that any
   two sets of the node end up in one component if they are linked, without listing all pairs.
4. All pairs of a node are compared twice.  First by their minwise tokens (256 bytes a set): pairs that share so few of them
   that it would take ``MARGIN`` standard deviations of chance are no candidates, and sets without a candidate leave.  Then
   whole sets are compared, in clusters of all that candidates join over all trees, so that each set is fetched once: common
   shingles are counted exactly, by a product of incidence matrices, and a spanning forest of the links goes on, at most one
   row per set.  Clusters of more than ``SMALL`` sets are compared by their nodes' groups, groups of more than ``MOST``
   shingles in pairs of blocks, so that the bytes in a task are bounded, not only its rows.
5. Components come from rounds in which tasks contract their links and paths shrink to half, the same for any number of
   links, and representatives hand theirs to their class.

Recall: a pair at exactly the threshold survives a tree to depth d with probability about 1 / (1 + 0.13 d), so ``TREES``
= 14 trees miss it in about 1 of 10,000 cases at depth 4 and 1 of 250 at depth 16; pairs above it are missed less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import cut, kind, table
from intervale.llm.words import blocks, mix, words_of

COORDS, TREES, STEP, DEPTH, SMALL = 64, 14, 4, 32, 512
#: Branching goes on while it leaves less than this share of the rows in large nodes; up to so many nodes are broadcast.
SHRINKS, BROADCAST_NODES = 0.6, 500_000
#: Links that a task contracts at once.
CHUNK = 1 << 14
#: Candidates share tokens as linked sets do, but for so many standard deviations; shingles of a group that is compared at once.
MARGIN, MOST = 4.5, 1 << 22
#: The groups that are compared before the others.
EARLY = "not late and pmod(xxhash64(node), 4) = 0"
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5CB9243F2CE3A6F)
_MULT = (mix(np.arange(1, 1025, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLUS = (mix(np.arange(2001, 3025, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one shingle, no words none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for i, j in blocks(raw):
        *_, h, first = words_of(raw[i:j])
        for k in range(j - i):
            w = h[first[k] : first[k + 1]]
            n = min(len(w), words)
            if not n:
                yield np.empty(0, np.uint64)
                continue
            m = np.full(len(w) - n + 1, n, np.uint64)
            for x in range(n):
                m = m * _A + (w[x : len(w) - n + 1 + x] ^ _B)
            yield np.unique(mix(m))


def minwise(sets: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The minwise token (32 bits) of a set at each coordinate."""
    got = np.full(coords, 0xFFFFFFFF, np.uint32)
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(got, (low[None, at : at + 2048] * _MULT[:coords, None] + _PLUS[:coords, None]).min(1), out=got)
    return got


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a, b = mix(s * _A).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + _B))
    return np.array([a ^ np.uint64(len(s)), b], np.uint64).tobytes()


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set; null if it is empty), sig (minwise tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, sig = [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), words):
                n.append(len(s))
                cls.append(_digest(s) if len(s) else None)
                sig.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "cls", "sig"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, n_shingles long, cls binary, sig binary")


def branch(frontier: DataFrame, levels: int, similarity: float, trees: int | None = None) -> DataFrame:
    """Children ``levels`` below: rows (node, id) of rows (nodes, id, sig), an id's nodes in one array, or of rows (id, sig) from the roots of ``trees``."""
    extra = np.uint64(int((1 / similarity - 1) * 2**32))
    roots = mix(np.arange(1, (trees or 0) + 1, dtype=np.uint64) * _A)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, one = np.uint64(0xFFFFFFFF), np.uint64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
                coords = np.uint64(sig.shape[1])
                if trees:
                    of, node = np.repeat(np.arange(b.num_rows), trees), np.tile(roots, b.num_rows)
                else:
                    own = b.column("nodes")
                    of, node = np.repeat(np.arange(b.num_rows), own.value_lengths().to_numpy()), own.flatten().to_numpy().view(np.uint64)
                for _ in range(levels):
                    draw = mix(node ^ _B)
                    more = np.flatnonzero(mix(draw + one) & low < extra)
                    first = (draw % coords).astype(np.int64)
                    step = one + mix(draw + np.uint64(2))[more] % (coords - one)
                    second = ((draw[more] + step) % coords).astype(np.int64)
                    of2, node2, pick = np.concatenate((of, of[more])), np.concatenate((node, node[more])), np.concatenate((first, second))
                    node = mix((node2 * _A) ^ (sig[of2, pick].astype(np.uint64) + (pick.astype(np.uint64) << np.uint64(32))))
                    of = of2
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("id").take(pa.array(of))], ["node", "id"])

    columns = ["id", "sig"] if trees else ["nodes", "id", "sig"]
    return frontier.select(columns).mapInArrow(run, "node long, id long")


def linked(sets: list[np.ndarray], percent: int, limit: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets with 100 * |both| >= percent * |either|, from an exact count of common members."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if n else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    _, col, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], renumber[col[keep]]
    both = np.zeros((n, n), np.int64)
    wide, total = max(1, limit // max(n, 1) // 4), int(shared.sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, total, wide):
        i, j = np.searchsorted(col, (at, at + wide))
        m = np.zeros((n, min(wide, total - at)), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        both += np.rint(m @ m.T).astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu((100 * both >= percent * either) & (both > 0), 1))


def forest(n: int, left: np.ndarray, right: np.ndarray, same: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what neither links before them nor ``same`` (an earlier member of each one's component) joins."""
    parent = list(same or range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def parted(near: np.ndarray) -> Iterator[np.ndarray]:
    """The connected parts of more than one place of a symmetric matrix of booleans."""
    left = near.any(1)
    while left.any():
        part = np.zeros(len(near), bool)
        edge = np.zeros(len(near), bool)
        edge[left.argmax()] = True
        while edge.any():
            part |= edge
            edge = near[edge].any(0) & ~part
        left &= ~part
        yield np.flatnonzero(part)


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """node, id, root, n, sig of batches sorted by (node, id), cut between nodes; an id counts once in a node."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(c).to_numpy() for c in ("node", "id", "root", "n")]
        own.append(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1))
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        last = int(np.searchsorted(own[0], own[0][-1]))
        held = [x[last:] for x in own]
        if last:
            yield _once([x[:last] for x in own])
    if held is not None:
        yield _once(held)


def _once(rows: list[np.ndarray]) -> list[np.ndarray]:
    new = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
    return [x[new] for x in rows]


def met_once(rows: DataFrame, known: DataFrame, few: bool = False) -> DataFrame:
    """Rows (id, ...) joined with ``known`` (id, ...): all rows of an id, which are a few a tree, meet its row at once and part again afterwards."""
    rest = [c for c in rows.columns if c != "id"]
    own = rows.groupBy("id").agg(F.collect_list(F.struct(*rest)).alias("_own"))
    met = known.join(F.broadcast(own) if few else own, "id")
    return met.withColumn("_o", F.explode("_own")).select("id", *[F.col("_o")[c].alias(c) for c in rest], *[c for c in known.columns if c != "id"])


def candidates(members: DataFrame, classes: DataFrame, percent: int, most: int = MOST) -> DataFrame:
    """Groups (node, id, root, late) of what the sketches leave to compare within the nodes of ``members`` (node, id, root).

    Only pairs of two roots count.  A group's name follows from its members, so equal groups of several nodes are one.  A
    group of more than ``most`` shingles becomes pairs of blocks; those without its first block are ``late``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, ids, roots, size, sig in whole_nodes(batches):
            coords, share = sig.shape[1], percent / 100
            least = max(1, int(coords * share - MARGIN * (coords * share * (1 - share)) ** 0.5))
            name = mix(ids.view(np.uint64) + _A)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # name, place, late
            start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            count = np.diff(np.append(start, len(node)))
            two = start[count == 2]
            two = two[((sig[two] == sig[two + 1]).sum(1) >= least) & (roots[two] != roots[two + 1])]
            out.append((np.repeat(mix(name[two] + name[two + 1]), 2), np.repeat(two, 2) + np.tile([0, 1], len(two)), np.zeros(2 * len(two), bool)))
            for at, n in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                agree = np.zeros((n, n), np.uint16)
                for c in sig[at : at + n].T:
                    agree += c[:, None] == c[None, :]
                near = (agree >= least) & (roots[at : at + n, None] != roots[None, at : at + n])
                for part in parted(near):
                    part = part + at
                    block = (np.cumsum(size[part]) - size[part]) // (most // 2)
                    every = [part[block == k] for k in np.unique(block)]
                    groups = [(part, False)] if len(every) < 3 else [(np.concatenate((x, y)), i > 0) for i, x in enumerate(every) for y in every[i + 1 :]]
                    for group, late in groups:
                        out.append((np.full(len(group), mix(name[group].sum(keepdims=True))[0]), group, np.full(len(group), late)))
            names, places, late = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ids[places]), pa.array(roots[places]), pa.array(late)], ["node", "id", "root", "late"])

    own = members.select("node", "id", "root")
    known = met_once(own, classes.select("id", F.col("n_shingles").alias("n"), "sig"), own.count() <= BROADCAST_NODES)
    found = known.repartition("node").sortWithinPartitions("node", "id").select("node", "id", "root", "n", "sig").mapInArrow(run, "node long, id long, root long, late boolean")
    return found.groupBy("node", "id", "root").agg(F.min("late").alias("late"))


def compare(groups: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the links within each of the groups (node, id, root, members); sets of one root are joined already."""

    def links(held: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        own = [x for _, _, x in held]
        if len(own) == 2:
            both = len(np.intersect1d(*own, assume_unique=True))
            return [(held[0][0], held[1][0])] if both and 100 * both >= percent * (len(own[0]) + len(own[1]) - both) else []
        first: dict[int, int] = {}
        same = [first.setdefault(r, i) for i, (_, r, _) in enumerate(held)]
        return [(held[i][0], held[j][0]) for i, j in forest(len(own), *linked(own, percent), same)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            kept: list[tuple[int, int]] = []
            for node, i, root, x in zip(*(b.column(c).to_pylist() for c in ("node", "id", "root")), b.column("members"), strict=True):
                if node != last:
                    kept += links(held) if len(held) > 1 else []
                    last, held = node, []
                if not held or held[-1][0] != i:
                    held.append((i, root, np.frombuffer(x.as_py(), np.uint64)))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept, strict=True)], ["a", "b"])
        kept = links(held) if len(held) > 1 else []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept, strict=True)], ["a", "b"])

    met = groups.select("node", "id", "root", "members").repartition("node").sortWithinPartitions("node", "id")
    return met.mapInArrow(run, "a long, b long").distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some links and for each the smallest that it reaches by them."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        least, before = np.minimum(up[a], up[b]), up.copy()
        np.minimum.at(up, before[a], least)
        np.minimum.at(up, before[b], least)
        while (up[up] != up).any():
            up = up[up]
        if (up == before).all():
            return ids, ids[up]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v, moved) with the same components: within each task of every ``CHUNK`` links only one from each id to the smallest that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
            ids, root = least_reached(u, v)
            moved = any(pc.any(b.column("moved")).as_py() for b in held)
            below = ids != root
            return pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(root[below]), pa.array(np.full(int(below.sum()), moved))], ["u", "v", "moved"])

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return links.select("u", "v", "moved").mapInArrow(run, "u long, v long, moved boolean")


def shortened(rows: DataFrame, n: int) -> DataFrame:
    """A round on n links (u, v, moved): each id's links go to its smallest neighbour and from there, if that has a smaller one, to the next, and tasks of ``CHUNK`` links contract what they then hold."""
    least = rows.select("u", "v").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    ends = F.array(F.struct(F.col("u"), F.col("m"), (F.col("v") != F.col("m")).alias("moved")), F.struct(F.col("v").alias("u"), F.col("m"), F.lit(False).alias("moved")))
    ends = least.select(F.explode(ends).alias("e")).select("e.*").where("u <> m")
    above = rows.groupBy(F.col("u").alias("m")).agg(F.min("v").alias("above"))
    met = ends.join(F.broadcast(above) if n <= BROADCAST_NODES else above, "m", "left")
    return contracted(met.select("u", F.coalesce("above", "m").alias("v"), (F.col("moved") | F.col("above").isNotNull()).alias("moved")).coalesce(-(-n // CHUNK)))


def _linked(links: DataFrame) -> DataFrame:
    return contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(True).alias("moved")).where("u <> v"))


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id it reaches) of all ids in ``links`` (a, b).

    Tasks first contract their own links, then rounds shorten paths to half or less, until nothing has moved.  A task hands
    on a row for each of its ids at most; as many tasks contract as there are ``CHUNK`` links.
    """
    rows = cut(_linked(links))
    while True:
        known = rows.agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")).first()
        if not known["moved"]:
            break
        rows = cut(shortened(rows, known["n"]))
    known = rows.select(F.col("u").alias("id"), F.col("v").alias("root")).distinct()
    return known.unionByName(known.select(F.col("root").alias("id"), "root").distinct())


def partly_joined(links: DataFrame) -> DataFrame:
    """id, root: what one contraction and one look at every id's links tell; ids of one root are joined, but not all that are joined have one."""
    return cut(_linked(links)).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def near_groups(
    docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, step: int = STEP, depth: int = DEPTH, small: int = SMALL, most: int = MOST
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only and split at ASCII white space.  Two texts are linked if their sets of distinct
    ``words``-word shingles have 100 * intersection >= percent * union.  ``component_id`` is the smallest doc_id reachable
    by links, ``kept`` whether that is the row's own.  A text without words (or null) has an empty set, is linked with
    nothing, and keeps its own id.  Rows that repeat an id all carry the component of their own text.  Rows with a null id
    take part; their ids are never a component's unless all its ids are null (then it is null).  Very long texts are compared
    whole.  An empty table gives no rows.  Other columns are ignored.
    """
    # this fits any cluster size: one row of some 600 bytes for each text
    drawn = cut(sketches(docs, words, id_col, text_col))
    classes = cut(
        drawn.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    similarity = percent / 100
    chosen, level, large, before = [], 0, None, None
    while level < depth:
        rows = branch(classes, step, similarity, trees) if large is None else branch(large.groupBy("id").agg(F.collect_list("node").alias("nodes")).join(classes.select("id", "sig"), "id"), step, similarity)
        level += step
        many = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        found = cut(rows.join(F.broadcast(many) if many.count() <= BROADCAST_NODES else many, "node"))
        # nodes with equal members, of other trees or paths, are one
        once = found.groupBy("node", "n").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id")).alias("y")).groupBy("n", "x", "y").agg(F.min("node").alias("node"))
        found = cut(found.join(once.select("node"), "node", "left_semi"))
        chosen.append(found.where(F.col("n") <= small).select("node", "id"))
        large = found.where(F.col("n") > small).select("node", "id")
        left = large.count()
        if not left or before is not None and left > SHRINKS * before:
            break
        before = left
    members = chosen[0]
    for m in chosen[1:]:
        members = members.unionByName(m)
    members = cut(members)
    groups = cut(candidates(members.withColumn("root", F.col("id")), classes, percent, most))
    few, many = clusters(groups, classes, small, most)
    links = cut(compare(class_sets(docs, classes.join(few, "id"), words, id_col, text_col).withColumn("root", F.col("id")), percent))
    rest = cut(many.select("id").unionByName(large.select("id")).distinct().withColumn("node", F.lit(0).cast("long")))
    sets = None if rest.isEmpty() else cut(class_sets(docs, classes.join(rest, "id"), words, id_col, text_col).select("id", "members").dropDuplicates(["id"]))
    if not many.isEmpty():
        early = cut(compare(met_once(many.where(EARLY), sets), percent))
        # what a quarter of the groups has linked needs no other group
        links = links.unionByName(early).unionByName(compare_apart(rooted(many.where(f"not ({EARLY})").drop("root"), cut(partly_joined(early))), sets, percent))
    known = components(compare_large(large, classes, sets, links, percent, small, most) if left else links)
    joined = classes.select("cls", "least", "n", "id").join(known, "id", "left")
    top = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    owners = joined.where("n > 1 or root is not null").join(top, "root", "left").select("cls", F.when(F.col("root").isNotNull(), F.col("top")).otherwise(F.col("least")).alias("owner"))
    owners = cut(owners.withColumn("grouped", F.lit(True)))
    # rows without a set have no partner: they stay out of the join
    full = drawn.where("cls is not null").select("doc_id", "n_shingles", "cls").join(F.broadcast(owners) if owners.count() <= BROADCAST_NODES else owners, "cls", "left").drop("cls")
    out = full.unionByName(drawn.where("cls is null").select("doc_id", "n_shingles"), allowMissingColumns=True)
    comp = F.when(F.col("grouped"), F.col("owner")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def clusters(groups: DataFrame, classes: DataFrame, small: int, most: int) -> tuple[DataFrame, DataFrame]:
    """What to compare for all candidates of groups (node, id, root, late): clusters (node, id), and groups as they are.

    What candidates join, over all trees and nodes, is a cluster; no link leaves one.  A cluster of at most ``small`` sets
    and ``most`` shingles is compared whole, so that each of its sets is fetched once.  Of larger ones the groups remain.
    """
    star = groups.groupBy("node").agg(F.min("id").alias("a"))
    joined = cut(components(groups.join(star, "node").where("id <> a").select("a", F.col("id").alias("b")).distinct()))
    sizes = joined.join(classes.select("id", "n_shingles"), "id").groupBy("root").agg((F.count(F.lit(1)) > small).alias("long"), (F.sum("n_shingles") > most).alias("heavy"))
    marked = cut(joined.join(sizes, "root").select("id", "root", (F.col("long") | F.col("heavy")).alias("large")))
    few = marked.where("not large").select(F.col("root").alias("node"), "id")
    return few, cut(groups.join(marked.where("large").select("id"), "id", "left_semi").select("node", "id", "root", "late"))


def class_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, node, members (the whole set as bytes) of the wanted classes (cls, id, least, node), from the texts of their representatives; once for each row that repeats one."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = cut(wanted.select("cls", "id", "least", "node"))
    few = wanted.count() <= BROADCAST_NODES
    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    texts = found.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if not wanted.where("least is null").isEmpty():
        texts = texts.unionByName(found.where("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                got = [s for s in shingle_sets(whole.column("text").slice(at, 256).to_pylist(), words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], ["cls", "members"])

    sets = texts.select("text").mapInArrow(run, "cls binary, members binary")
    named = wanted.select("cls", "id", "node")
    return sets.join(F.broadcast(named) if few else named, "cls").select("id", "node", "members")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the root of each row's id, as far as it is known."""
    return cut(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))


def compare_apart(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compares the groups of tasks (node, id, root) that have more than one root."""
    apart = tasks.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("node")
    return cut(compare(met_once(tasks.join(apart, "node", "left_semi"), sets), percent))


def compare_large(nodes: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, percent: int, small: int, most: int) -> DataFrame:
    """Links (a, b) that join what ``links`` joins and what is linked within nodes of any size: each block against the node's pivot block, then what stays outside the main component against all blocks."""
    sized = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    blocked = nodes.join(sized, "node").select("node", "id", F.ceil(F.col("n") / F.lit(small)).cast("int").alias("of"))
    blocked = cut(blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")))

    def compared(side: DataFrame, spread: DataFrame) -> DataFrame:
        """side: (node, block, id, root, other) - meets block ``other`` of its node; one task for each such pair."""
        one = F.xxhash64("node", "block", "other").alias("node")
        meets = side.select("node", "block", "other").distinct().join(spread.select("node", F.col("block").alias("other"), "id", "root"), ["node", "other"])
        tasks = side.select(one, "id", "root").unionByName(meets.select(one, "id", "root"))
        return cut(compare(met_once(cut(candidates(tasks, classes, percent, most)), sets), percent))

    spread = rooted(blocked, cut(partly_joined(links)))
    # pivots only spare work below; a quarter of the nodes is enough for that
    first = compared(spread.where("pmod(xxhash64(node), 4) = 0").withColumn("other", F.lit(0)), spread)
    known = cut(components(links.unionByName(first)))
    spread = rooted(blocked, known)
    main = spread.groupBy("node", "root").count().groupBy("node").agg(F.max(F.struct("count", "root")).alias("m")).select("node", F.col("m.root").alias("main"))
    outside = spread.join(main, "node").where("root <> main").drop("main", "block")
    # those outside are dealt to blocks of their own, so that few blocks of them meet all others
    blocks = outside.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(small)).cast("int").alias("own"))
    outside = outside.join(blocks, "node").withColumn("block", -1 - F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    every = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return known.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(compared(every, spread))


def drop_near_copies(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose document stays - one of each group - with all their columns, in their order.

    An id that repeats with different texts stays with all of them if one of them stays; rows with a null id stay.
    """
    groups = near_groups(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    gone = cut(groups.groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept")).where(f"not kept and {id_col} is not null").select(id_col))
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone, id_col, "left_anti")
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies: three-word shingles, similarity 0.85 or more."""
    return near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
