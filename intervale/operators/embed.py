"""Training embeddings over blocks of documents: tokens by continuous bags of words with negative sampling, and words and labels
by ranking a document's label before others.

The model is a table (token, v, u), a row a token.  In a round every block of documents goes from the rows of the tokens it needs
through its documents in small steps; a token's row then moves by the mean of how far its blocks have moved it.  Blocks of a group fetch
the rows of their tokens once and hand on the sum of their moves, so that what is exchanged is a row for a group and token.  No task
holds the corpus, nor a model of more than ``HELD`` numbers.  Documents are sets of tokens in no order of their own: each epoch
shuffles them anew.  Negative examples come from Walker's alias table of the tokens' shares to a power, drawn bucket by bucket for many
blocks at once, and reach a block as distinct tokens with their counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.regions import LABEL, is_label, uniform
from intervale.operators import tokens as tk
from intervale.session import cut, forget, prepare

#: Tokens of a block (a longer document stands alone), tokens of a step within it, rows of the model and of what moves it that are met at once, and negatives that are drawn at once.
BLOCK, STEP, ROWS, MOVES, DRAWS = 1 << 15, 128, 1 << 14, 1 << 16, 1 << 21
#: Blocks of a group at most, groups at least (if there are as many blocks), and numbers of the model's rows (32 MB a side) that a group holds.
GROUP, GROUPS, HELD = 32, 24, 1 << 22


def alias_table(weights: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """slot, keep, token, other of weights (token, p): a slot drawn evenly gives ``token`` with the chance ``keep``, else ``other``.

    Tables are built for buckets of tokens; a bucket has as many slots as tokens, and where a bucket's mean differs from the
    mean of all, ``worth`` (its share of all weight) is what a draw picks the bucket by: see ``drawn``.
    """
    x = weights.where("p > 0")
    n = -(-x.count() // bucket)
    x = x.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(max(n, 1))).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token").reset_index(drop=True)
        share = (pdf["p"] / pdf["p"].sum() * len(pdf)).tolist()
        keep, other = [1.0] * len(pdf), list(range(len(pdf)))
        small = [i for i, s in enumerate(share) if s < 1]
        large = [i for i, s in enumerate(share) if s >= 1]
        while small and large:
            a, b = small.pop(), large[-1]
            keep[a], other[a] = share[a], b
            share[b] -= 1 - share[a]
            if share[b] < 1:
                small.append(large.pop())
        return pd.DataFrame({"bucket": key[0], "slot": range(len(pdf)), "keep": keep, "token": pdf["token"], "other": pdf["token"].to_numpy()[other], "worth": pdf["p"].sum(), "slots": len(pdf)})

    kind = weights.schema["token"].dataType.simpleString()
    return x.groupBy("bucket").applyInPandas(build, f"bucket int, slot long, keep double, token {kind}, other {kind}, worth double, slots long")


def drawn(draws: DataFrame, table: DataFrame, seed: int, *key: str) -> DataFrame:
    """Adds ``token`` to draws, each named by its key columns: one join by slot, a row a draw."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    line = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = table.select("bucket", "worth", "slots").distinct().withColumn("hi", F.sum("worth").over(line)).orderBy("bucket").collect()  # a row for 65,536 tokens
    ends, sizes = [b["hi"] for b in buckets], [b["slots"] for b in buckets]
    at = uniform(seed, "bucket", name) * F.lit(ends[-1] if ends else 0.0)
    bucket = F.least(F.size(F.filter(F.lit(ends), lambda e: e <= at)), F.lit(len(ends) - 1))
    x = draws.withColumn("bucket", bucket.cast("int")).withColumn("slot", F.floor(uniform(seed, "slot", name) * F.element_at(F.lit(sizes), F.col("bucket") + 1)))
    met = x.withColumn("_c", uniform(seed, "coin", name)).join(table.select("bucket", "slot", "keep", F.col("token").alias("_t"), "other"), ["bucket", "slot"])
    return met.select(*draws.columns, F.when(F.col("_c") < F.col("keep"), F.col("_t")).otherwise(F.col("other")).alias("token"))


def negatives_of(counts: DataFrame, table: DataFrame, each: int, seed: int) -> DataFrame:
    """block, tokens, times: what ``each`` draws for each of a block's examples (block, m) give, distinct tokens with their counts; several rows a block.

    How many of a block's draws fall to each bucket of the alias table is drawn first; then a bucket serves blocks of about ``DRAWS`` draws together.
    """
    kind = table.schema["token"].dataType.simpleString()
    worth = [r["w"] for r in table.groupBy("bucket").agg(F.first("worth").alias("w")).orderBy("bucket").collect()]  # a row for 65,536 tokens
    names = [r["bucket"] for r in table.select("bucket").distinct().orderBy("bucket").collect()]
    draws = (counts.agg(F.sum("m")).first()[0] or 0) * each
    parts = max(1, -(-draws // max(1, len(names)) // DRAWS))
    share = np.array(worth) / max(sum(worth), 1e-300)

    def deal(batches):
        for b in batches:
            rows = [(names[k], block % parts, block, n) for block, m in zip(b.column("block").to_pylist(), b.column("m").to_pylist(), strict=True) if names for k, n in enumerate(np.random.default_rng([seed, block % (1 << 64)]).multinomial(m * each, share).tolist()) if n]
            bucket, part, block, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(n, pa.int64())], ["bucket", "part", "block", "n"])

    def draw(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows, blocks, tokens, times = rows.sort_by("slot"), [], [], []
        keep, name = rows["keep"].to_numpy(), rows["token"].combine_chunks()
        other = pc.index_in(rows["other"].combine_chunks(), value_set=name).to_numpy()
        for bucket, block, n in zip(asked["bucket"].to_pylist(), asked["block"].to_pylist(), asked["n"].to_pylist(), strict=True):
            rng = np.random.default_rng([seed, bucket + 1, block % (1 << 64)])
            slot = rng.integers(len(keep), size=n)
            seen = np.bincount(np.where(rng.random(n) < keep[slot], slot, other[slot]))
            at = np.flatnonzero(seen)
            blocks.append(block)
            tokens.append(at)
            times.append(seen[at])
        ends = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (name.take(pa.array(np.concatenate(tokens))), pa.array(np.concatenate(times), pa.int32()))]
        return pa.table([pa.array(blocks, pa.int64()), *lists], names=["block", "tokens", "times"])

    dealt = counts.select(F.col("block").cast("long").alias("block"), F.col("m").cast("long").alias("m")).mapInArrow(deal, "bucket int, part long, block long, n long")
    served = table.select("bucket", "slot", "keep", "token", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    served = served.join(dealt.select("bucket", "part").distinct(), ["bucket", "part"], "left_semi")
    return dealt.groupBy("bucket", "part").cogroup(served.groupBy("bucket", "part")).applyInArrow(draw, f"block long, tokens array<{kind}>, times array<int>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def step(v: np.ndarray, u: np.ndarray, context: np.ndarray, mask: np.ndarray, target: np.ndarray, negative: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of examples - contexts (n x 2w places of v, masked), a target and negatives (places of u) each - and its gradients in v and u."""
    some = np.maximum(mask.sum(1), 1)
    mean = (v[context] * mask[:, :, None]).sum(1) / some[:, None]
    out = np.concatenate((target[:, None], negative), 1)
    truth = np.zeros(out.shape)
    truth[:, 0] = 1
    # a negative that is the target says nothing
    counts = np.concatenate((np.ones((len(target), 1)), negative != target[:, None]), 1) * (mask.any(1)[:, None])
    p = _sigmoid(np.einsum("nd,nkd->nk", mean, u[out]))
    loss = -(counts * np.log(np.maximum(np.where(truth > 0, p, 1 - p), 1e-12))).sum()
    g = (p - truth) * counts
    du, dv = np.zeros_like(u), np.zeros_like(v)
    np.add.at(du, out, g[:, :, None] * mean[:, None, :])
    back = np.einsum("nk,nkd->nd", g, u[out]) / some[:, None]
    np.add.at(dv, context, back[:, None, :] * mask[:, :, None])
    return float(loss), dv, du


@dataclass
class Trained:
    model: DataFrame  # token, v, u
    losses: list[float]  # mean loss of an example, by epoch


def _first_rows(width: int, seed: int):
    def run(batches):
        for b in batches:
            names = b.column("token").to_pylist()
            v = [((np.random.default_rng([seed, zlib.crc32(str(t).encode())]).random(width) - 0.5) / width).tolist() for t in names]
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(v, pa.list_(pa.float64())), pa.array([[0.0] * width] * len(names), pa.list_(pa.float64()))], ["token", "v", "u"])

    return run


def _rows(column, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; rows that are null are 0, for which the width is asked."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False)
    if not column.null_count:
        return x.reshape(len(column), -1)
    out = np.zeros((len(column), width or len(x) // (len(column) - column.null_count)))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = x.reshape(-1, out.shape[1])
    return out


def _lists(x: np.ndarray, held: np.ndarray | None = None) -> pa.Array:
    """A matrix as a list column; null where a row isn't held."""
    held = np.ones(len(x), bool) if held is None else held
    ends = np.concatenate(([0], np.cumsum(held * x.shape[1])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[held].ravel(), pa.float64()), mask=pa.array(~held))


def _places(docs: pa.Table, names: pa.Array, seed: int, epoch: int) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """A block's documents in the order of ids, as the places of their tokens among ``names``, and those of its negatives in a seeded order."""
    block, given = docs["block"][0].as_py(), pc.is_valid(docs["id"])
    own, drawn = docs.filter(given).sort_by("id"), docs.filter(pc.invert(given))
    at, some = (pc.index_in(x["tokens"].combine_chunks().flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, drawn))
    ends = np.cumsum(pc.list_value_length(own["tokens"]).to_numpy())
    pool = np.sort(np.repeat(some, drawn["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False)))
    return own["id"].to_pylist(), np.split(at, ends[:-1]), np.random.default_rng([seed, epoch, block, 1]).permutation(pool)


def _told(block: int, names: pa.Array, dv: np.ndarray, du: np.ndarray, vs: np.ndarray | None, us: np.ndarray | None, loss: float, n: int) -> pa.Table:
    rest = len(names) - 1
    return pa.table([pa.array([block] * (rest + 1), pa.int64()), names, _lists(dv, vs), _lists(du, us), pa.array([loss] + [0.0] * rest), pa.array([n] + [0] * rest, pa.int64())], names=["block", "token", "dv", "du", "loss", "n"])


def _block_pass(docs: pa.Table, rows: pa.Table, epoch: int, window: int, negatives: int, rate: float, seed: int) -> pa.Table:
    """How far a block moves the rows of its tokens in one pass over its documents, and its loss."""
    rows = rows.sort_by("token")
    names = rows["token"].combine_chunks()
    ids, every, pool = _places(docs, names, seed, epoch)
    u0 = _rows(rows["u"])
    v0 = _rows(rows["v"], u0.shape[1])
    v, u = v0.copy(), u0.copy()
    target, context, mask = [], [], []
    for i, places in zip(ids, every, strict=True):
        own = places[np.random.default_rng([seed, epoch, zlib.crc32(str(i).encode())]).permutation(len(places))]
        at = np.arange(len(own))[:, None] + np.array([d for d in range(-window, window + 1) if d])
        inside = (at >= 0) & (at < len(own))
        target.append(own)
        context.append(np.where(inside, own[np.clip(at, 0, len(own) - 1)], own[:1]))
        mask.append(inside)
    target, context, mask = np.concatenate(target), np.concatenate(context), np.concatenate(mask)
    out = np.concatenate((target[:, None], pool.reshape(len(target), negatives)), 1)
    total, order = 0.0, np.random.default_rng([seed, epoch]).permutation(len(target))
    for i in range(0, len(order), STEP):
        some = order[i : i + STEP]
        # a step reads and moves the rows of its own tokens only, not the block's
        vs, of = np.unique(context[some], return_inverse=True)
        us, to = np.unique(out[some], return_inverse=True)
        of, to = of.reshape(len(some), -1), to.reshape(len(some), -1)
        loss, dv, du = step(v[vs], u[us], of, mask[some], to[:, 0], to[:, 1:])
        total += loss
        v[vs] -= rate * dv
        u[us] -= rate * du
    return _told(docs["block"][0].as_py(), names, v - v0, u - u0, rows["v"].combine_chunks().is_valid().to_numpy(zero_copy_only=False), None, total, int(mask.any(1).sum()))


def _group_pass(docs: pa.Table, rows: pa.Table, one) -> pa.Table:
    """What the blocks of a group tell, each from the same rows, as sums of their moves; ``times`` counts the blocks that told of a token."""
    rows = rows.sort_by("token")
    names = rows["token"].combine_chunks()
    shape, total, n = _rows(rows["u" if "u" in rows.column_names else "v"]).shape, 0.0, 0
    dv, du, times, moved = np.zeros(shape), np.zeros(shape), np.zeros(len(names), np.int64), np.zeros((len(names), 2), bool)
    for block in sorted(pc.unique(docs["block"]).to_pylist()):
        own = docs.filter(pc.equal(docs["block"], block))
        met = np.unique(pc.index_in(own["tokens"].combine_chunks().flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64))
        told = one(own, rows.take(pa.array(met)))
        for k, (d, c) in enumerate(((dv, "dv"), (du, "du"))):
            d[met] += _rows(told[c], shape[1])
            moved[met, k] |= told[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        times[met] += 1
        total, n = total + pc.sum(told["loss"]).as_py(), n + pc.sum(told["n"]).as_py()
    return _told(docs["group"][0].as_py(), names, dv, du, moved[:, 0], moved[:, 1], total, n).append_column("times", pa.array(times))


def _grouped(make, *options):
    return lambda docs, rows: _group_pass(docs, rows, lambda d, r: make(d, r, *options))


def train(docs: DataFrame, *, width: int = 100, window: int = 5, negatives: int = 5, epochs: int = 5, rate: float = 0.05, least: int = 1, power: float = 0.75, seed: int = 1, block: int = BLOCK) -> Trained:
    """Trains on documents (id, tokens); tokens that come less than ``least`` times are left out, as are null ids, tokens and documents of less than two tokens.

    The rate falls evenly to a tenth over the epochs.  The same seed gives the same model.  An empty table gives an empty model.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where("id is not null").select(F.col("id").cast("string").alias("id"), F.explode("tokens").alias("token")).where("token is not null")
    known = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("token")
    kept = cut(rows.join(known, "token"))
    chances = cut(alias_table(tk.negative_sampling(kept.select("token"), power)))
    lists = kept.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where("size(tokens) > 1")
    size = lists.agg(F.sum(F.size("tokens"))).first()[0] or 0
    held = cut(lists.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // block))))))
    counts = held.groupBy("block").agg(F.sum(F.size("tokens")).alias("m"))
    return _fit(held, known, counts, chances, width, negatives, epochs if size else 0, rate, seed, lambda epoch, now: _grouped(_block_pass, epoch, window, negatives, now, seed), (F.when(F.col("own"), F.col("v")).alias("v"), "u"))


def _fit(held: DataFrame, known: DataFrame, counts: DataFrame, chances: DataFrame, width: int, negatives: int, epochs: int, rate: float, seed: int, make, sides: tuple, apart=None) -> Trained:
    """Rounds over blocks (block, id, tokens) from first rows of the known tokens; ``counts`` (block, m) has each block's examples, for which negatives are drawn, and ``sides`` what a block reads of v and u.

    ``apart`` makes of the model, the negatives, the epoch and its rate what moves in blocks that are not held, numbered below 0.
    """
    kind = known.schema["token"].dataType.simpleString()
    schema = f"token {kind}, v array<double>, u array<double>"
    model = cut(known.mapInArrow(_first_rows(width, seed), schema))
    n, room, small = held.select("block").distinct().count(), HELD // width, model.count() <= HELD // width  # room: rows that a group may hold
    losses = []
    for epoch in range(epochs):
        now = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
        picked = negatives_of(counts, chances, negatives, seed * 1000 + epoch)
        if apart:
            every = cut(picked)
            picked = every.where("block >= 0")
        blocks = held.select("block", "id", "tokens", F.lit(None).cast("array<int>").alias("times")).unionByName(picked.select("block", F.lit(None).cast("string").alias("id"), "tokens", "times"))
        blocks = cut(blocks)
        most = GROUP if small else room // max(1, blocks.groupBy("block").agg(F.sum(F.size("tokens")).alias("m")).agg(F.max("m")).first()[0] or 0)
        groups = -(-n // max(1, min(GROUP, most, n // GROUPS)))
        blocks = blocks.withColumn("group", F.pmod("block", F.lit(max(1, groups)).cast("long")))
        # negatives move only what they are as targets
        needs = blocks.select(F.col("group").alias("_group"), F.col("id").isNotNull().alias("own"), F.explode("tokens").alias("token")).groupBy("_group", "token").agg(F.max("own").alias("own"))
        needs = needs.join(model.hint("merge"), "token").select("_group", "token", *sides)  # rows are multiplied by tokens, which the size of their files doesn't tell
        moved = blocks.groupBy("group").cogroup(needs.groupBy("_group")).applyInArrow(make(epoch, now), f"block long, token {kind}, dv array<double>, du array<double>, loss double, n long, times long")
        moved = cut(moved.unionByName(apart(model, every.where("block < 0"), epoch, now).withColumn("times", F.lit(1).cast("long"))) if apart else moved)
        told = moved.agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).first()
        losses.append(told["l"] / max(told["n"], 1))
        was, model = model, cut(_moved(model, moved, schema))
        forget(was, blocks, moved, *([every] if apart else []))
    return Trained(model, losses)


def ranking(x: np.ndarray, labels: np.ndarray, margin: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of a document x against labels, its own first: the mean over the others of max(0, margin - cosine to its own + cosine to the other), and the gradients."""
    nx, nl = np.sqrt((x * x).sum()) + 1e-12, np.sqrt((labels * labels).sum(1)) + 1e-12
    cos = labels @ x / nx / nl
    over = margin - cos[0] + cos[1:]
    g = np.zeros(len(labels))
    g[1:] = (over > 0) / max(len(over), 1)
    g[0] = -g[1:].sum()
    dx = (g / nl) @ labels / nx - (g @ cos) * x / nx**2
    dl = g[:, None] * (x / nx / nl[:, None] - cos[:, None] * labels / nl[:, None] ** 2)
    return float(np.maximum(over, 0).mean()) if len(over) else 0.0, dx, dl


def _label_pass(docs: pa.Table, rows: pa.Table, epoch: int, negatives: int, margin: float, rate: float, seed: int) -> pa.Table:
    """As ``_block_pass``, for documents of words and labels: of each, one of its labels stands against drawn ones that it has not."""
    rows = rows.sort_by("token")
    names = rows["token"].combine_chunks()
    v0 = _rows(rows["v"])
    v = v0.copy()
    marked = pc.match_substring(names, LABEL).to_numpy(zero_copy_only=False)
    _, every, pool = _places(docs, names, seed, epoch)
    pool, total = pool.reshape(-1, negatives), 0.0
    for n in np.random.default_rng([seed, epoch]).permutation(len(every)).tolist():
        words, own = every[n][~marked[every[n]]], every[n][marked[every[n]]]
        first = own[np.random.default_rng([seed, epoch, n]).integers(len(own))]
        others = pool[n][~np.isin(pool[n], own)]
        at = np.concatenate(([first], others)).astype(np.int64)
        loss, dx, dl = ranking(v[words].mean(0), v[at], margin)
        total += loss
        np.add.at(v, at, -rate * dl)
        v[words] -= rate * dx / len(words)  # words are distinct
    return _told(docs["block"][0].as_py(), names, v - v0, v, None, np.zeros(len(v), bool), total, len(every))


def train_labels(documents: DataFrame, *, width: int = 100, negatives: int = 10, margin: float = 0.2, epochs: int = 20, rate: float = 0.5, seed: int = 1, block: int = BLOCK) -> Trained:
    """Vectors of words and labels (model: token, v) of documents (filename, document), such that a document's mean word is nearer to its labels than to others.

    Words are parted by spaces; those that hold the label mark are labels.  Documents without a word or without a label teach nothing, and words
    of theirs alone get no vector.  The same seed gives the same model.
    """
    words = documents.select(F.col("filename").cast("string").alias("id"), F.explode(F.split("document", " ")).alias("token"))
    return train_label_rows(words, width=width, negatives=negatives, margin=margin, epochs=epochs, rate=rate, seed=seed, block=block)


#: Up to so many documents are broadcast to the rows of their words.
BROADCAST_DOCUMENTS = 10_000


def train_label_rows(words: DataFrame, *, width: int = 100, negatives: int = 10, margin: float = 0.2, epochs: int = 20, rate: float = 0.5, seed: int = 1, block: int = BLOCK) -> Trained:
    """As ``train_labels``, of the documents' words as rows (id, token).

    A document of more than ``block`` words is never held whole: it is a block of its own, of which parts sum their words' vectors,
    the sums meet its labels, and all of its words move alike.
    """
    prepare(words.sparkSession)
    words = words.where("id is not null and token <> ''").distinct()
    sizes = cut(words.groupBy("id").agg(F.count(F.when(~is_label(F.col("token")), 1)).alias("of"), F.count(F.lit(1)).alias("size")).where("of > 0 and of < size"))
    told = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count(F.when(F.col("size") > block, 1)).alias("long")).first()

    def small(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= BROADCAST_DOCUMENTS else rows

    kept = cut(words.join(small(sizes, told["n"]), "id"))
    lists = kept.where(F.col("size") <= block).groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    held = cut(lists.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-(told["size"] or 0) // block))))))
    known = kept.select("token").distinct()
    chances = cut(alias_table(known.where(is_label(F.col("token"))).withColumn("p", F.lit(1.0))))
    counts, apart = held.groupBy("block").agg(F.count(F.lit(1)).alias("m")), None
    if told["long"]:
        long = kept.where(F.col("size") > block).withColumn("block", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 62)))
        counts = counts.unionByName(long.select("block").distinct().withColumn("m", F.lit(1).cast("long")))
        parts = cut(long.where(~is_label(F.col("token"))).select("id", "token", F.pmod(F.xxhash64("token"), F.ceil(F.col("of") / block)).alias("part")))
        own = cut(long.where(is_label(F.col("token"))).select("id", "block", "of", "token"))

        def apart(model: DataFrame, picked: DataFrame, epoch: int, now: float) -> DataFrame:
            judged = cut(_judged(parts, own, model.select("token", "v"), picked, epoch, margin, now, seed, negatives))
            words = parts.select("id", "token").join(small(judged.where("token is null").select("id", "block", "dv"), told["long"]), "id")
            every = judged.where("token is not null").select("block", "token", "dv", "loss", "n").unionByName(words.select("block", "token", "dv", F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("n")))
            return every.withColumn("du", F.lit(None).cast("array<double>"))

    return _fit(held, known, counts, chances, width, negatives, epochs if told["size"] else 0, rate, seed, lambda epoch, now: _grouped(_label_pass, epoch, negatives, margin, now, seed), ("v",), apart)


def _judged(parts: DataFrame, own: DataFrame, vectors: DataFrame, picked: DataFrame, epoch: int, margin: float, rate: float, seed: int, negatives: int) -> DataFrame:
    """id, block, token, dv, loss, n: how far documents in parts (id, token, part) with labels ``own`` (id, block, of, token) move the labels they meet and, in a row without a token, each of their words."""

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("token")
        return pa.table([rows["id"][:1], rows["part"][:1], _lists(_rows(rows["v"]).sum(0)[None])], names=["id", "part", "v"])

    def judge(rows: pa.Table) -> pa.Table:
        sums, rows = rows.filter(pc.is_valid(rows["part"])).sort_by("part"), rows.filter(pc.is_null(rows["part"])).sort_by([("times", "ascending"), ("token", "ascending")])
        own = pc.equal(rows["times"], 0).to_numpy(zero_copy_only=False)
        of, name = rows["of"][0].as_py(), rows["id"][0].as_py()
        rng = np.random.default_rng([seed, epoch, zlib.crc32(name.encode())])
        first = np.flatnonzero(own)[rng.integers(own.sum())]
        times = rows["times"].to_numpy()
        drawn = rng.permutation(np.repeat(np.arange(len(rows)), times))[:negatives]
        drawn = drawn[~np.isin(rows["token"].to_numpy(zero_copy_only=False)[drawn], rows["token"].to_numpy(zero_copy_only=False)[own])]
        at = np.concatenate(([first], drawn)).astype(np.int64)
        v = _rows(rows["v"])
        loss, dx, dl = ranking(_rows(sums["v"]).sum(0) / of, v[at], margin)
        dv = np.zeros_like(v)
        np.add.at(dv, at, -rate * dl)
        met = np.unique(at)
        tokens = [rows["token"][int(i)].as_py() for i in met] + [None]
        n = len(tokens)
        return pa.table(
            [pa.array([name] * n, pa.string()), pa.array([rows["block"][0].as_py()] * n, pa.int64()), pa.array(tokens, pa.string()), _lists(np.concatenate((dv[met], -rate * dx[None] / of))), pa.array([loss] + [0.0] * (n - 1)), pa.array([1] + [0] * (n - 1), pa.int64())],
            names=["id", "block", "token", "dv", "loss", "n"],
        )

    sums = parts.join(vectors, "token").groupBy("id", "part").applyInArrow(summed, "id string, part long, v array<double>")
    documents = own.select("id", "block", "of").distinct()
    drawn = documents.join(picked, "block").select("id", "block", "of", F.explode(F.arrays_zip("tokens", "times")).alias("d")).select("id", "block", "of", "d.tokens", "d.times")
    drawn = drawn.withColumnRenamed("tokens", "token").groupBy("id", "block", "of", "token").agg(F.sum("times").cast("long").alias("times"))
    met = own.withColumn("times", F.lit(0).cast("long")).unionByName(drawn).join(vectors, "token")
    return sums.unionByName(met, allowMissingColumns=True).groupBy("id").applyInArrow(judge, "id string, block long, token string, dv array<double>, loss double, n long")


def _moved(model: DataFrame, moved: DataFrame, schema: str) -> DataFrame:
    """The model with each row moved by the mean of its blocks, of which rows of ``moved`` are sums of so many (times); summed in the order of groups."""
    parts = F.pmod(F.xxhash64("token"), F.lit(max(1, -(-model.count() // ROWS), -(-moved.count() // MOVES))))

    def run(rows: pa.Table, by: pa.Table) -> pa.Table:
        rows, by = rows.sort_by("token"), by.sort_by([("token", "ascending"), ("block", "ascending")])
        at = pc.index_in(by["token"].combine_chunks(), value_set=rows["token"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.maximum(np.bincount(at, by["times"].to_numpy(), minlength=len(rows)), 1)[:, None]
        out = []
        for own, d in (("v", "dv"), ("u", "du")):
            x = _rows(rows[own]).copy()
            if len(at):
                total = np.zeros_like(x)
                np.add.at(total, at, _rows(by[d], x.shape[1]))
                x += total / n
            out.append(_lists(x))
        return pa.table([rows["token"], *out], names=["token", "v", "u"])

    return model.withColumn("part", parts).groupBy("part").cogroup(moved.select("token", "block", "dv", "du", "times").withColumn("part", parts).groupBy("part")).applyInArrow(lambda a, b: run(a.drop_columns(["part"]), b.drop_columns(["part"])), schema)
