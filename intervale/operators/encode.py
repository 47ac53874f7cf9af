"""Vocabularies, token ids of regions and cells, and what they encode to in an embedding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.regions import parse_region, region_key
from intervale.operators import intervals, search
from intervale.session import cut

#: Special tokens, whose ids follow those of the universe's regions in this order (fixed values).
SPECIALS = ("unk", "pad", "mask", "cls", "eos", "bos", "sep")
#: Up to so many numbers (32 MB) a table of vectors is broadcast.
BROADCAST_NUMBERS = 1 << 22


def vocabulary(universe: DataFrame) -> DataFrame:
    """token, id, special of a universe (uid, chrom, start, end): its regions in the order of uid, then the special tokens."""
    at = intervals.ranked(universe.select(F.lit("").alias("chrom"), F.col("uid").alias("start"), region_key(F.col("chrom"), F.col("start"), F.col("end")).alias("token")), [])
    size = universe.count()
    extra = universe.sparkSession.createDataFrame([(f"<{t}>", size + k, True) for k, t in enumerate(SPECIALS)], "token string, id long, special boolean")
    return at.select("token", (F.col("n") - 1).alias("id"), F.lit(False).alias("special")).unionByName(extra)


def special_id(vocab: DataFrame, name: str) -> int:
    return vocab.where((F.col("token") == f"<{name}>") & F.col("special")).first()["id"]


def token_rows(regions: DataFrame, vocab: DataFrame, *by: str) -> DataFrame:
    """by, row_idx, id: the token ids of each region, those it overlaps or the unknown one's; equal rows of a file once."""
    spans = vocab.where(~F.col("special")).select("id", parse_region(F.col("token")).alias("r")).select("id", F.col("r.chrom").alias("chrom"), F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"))
    keys, rows = [*by, "row_idx"], regions.count() + vocab.count()
    found = intervals.interval_join(regions.select(*keys, "chrom", "start", "end"), spans, rows=rows).select(*keys, "id")
    own, found = (intervals.dealt(x, rows, *keys).distinct() for x in (regions.select(*keys), found))
    return own.join(found, keys, "left").fillna({"id": special_id(vocab, "unk")})


def token_lists(tokens: DataFrame, *by: str) -> DataFrame:
    """by, tokens: sorted ids of token rows, one list for each of ``by``."""
    return tokens.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("tokens"))


def _known(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """id, v of the vectors, broadcast if, counted, they have at most ``BROADCAST_NUMBERS`` numbers, and the widest one's width."""
    rows = embeddings.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    size = rows.agg(F.sum(F.size("v")).alias("n"), F.max(F.size("v")).alias("w")).first()
    return (F.broadcast(rows) if (size["n"] or 0) <= BROADCAST_NUMBERS else rows), size["w"] or 0


def _pooled(rows: DataFrame, by: list[str], width: int, how: str, weight: Column | None = None) -> DataFrame:
    """by, v: element-wise mean (by weight) or max of vectors (v) of a known width, a column an element; null where a group has none."""
    w = F.lit(1.0) if weight is None else weight
    held = F.when(F.col("v").isNotNull(), w)
    if how == "mean":
        each = [F.sum(F.get("v", F.lit(i)) * w) / F.sum(held) for i in range(width)]
    else:
        each = [F.max(F.get("v", F.lit(i))) for i in range(width)]
    names = [f"_{i}" for i in range(width)]
    sums = rows.groupBy(*by).agg(F.count("v").alias("_n"), *[c.alias(n) for c, n in zip(each, names, strict=True)])
    return sums.select(*by, F.when(F.col("_n") > 0, F.array(*names)).alias("v"))


def encode_regions(tokens: DataFrame, embeddings: DataFrame, *by: str, how: str = "mean") -> DataFrame:
    """by, row_idx, v: the mean (or max) of the vectors (id, v) of each region's tokens; null if none of them has one.

    A task pools the fewer regions, the wider their vectors.
    """
    (rows, width), tokens = _known(embeddings), cut(tokens)
    met = intervals.dealt(tokens.join(rows, "id", "left"), tokens.count() * max(1, width // 16), *by, "row_idx")
    return _pooled(met, [*by, "row_idx"], width, how)


def encode_files(encoded: DataFrame, by: str = "bed_id", how: str = "mean") -> DataFrame:
    """by, v: the mean (or max) of a file's region vectors."""
    return search.pool(encoded, by, how)


def file_vectors(tokens: DataFrame, embeddings: DataFrame, by: str = "bed_id", how: str = "mean") -> DataFrame:
    """``encode_files`` of ``encode_regions`` straight from tokens (by, row_idx, id), without the regions' vectors.

    The mean is linear, so tokens first sum their weights in the file, 1 by the tokens of their region, and each token's
    vector is met once a file.  Tokens without a vector count nowhere; files of nothing else have none.
    """
    rows, width = _known(embeddings)
    if how != "mean":
        return _pooled(tokens.select(by, "id").distinct().join(rows, "id"), [by], width, how)
    share = 1 / F.count(F.lit(1)).over(Window.partitionBy(by, "row_idx"))
    weights = tokens.join(rows.select("id"), "id", "left_semi").withColumn("w", share).groupBy(by, "id").agg(F.sum("w").alias("w"))
    return _pooled(weights.join(rows, "id"), [by], width, how, F.col("w"))


def cell_tokens(counts: DataFrame, features: DataFrame, vocab: DataFrame) -> DataFrame:
    """cell, id, place: the token ids of each cell's features with counts (cell, feature, n), a feature's in order.

    Features (feature, chrom, start, end) are tokenised once, whatever the number of cells; those that are unknown have the
    unknown id.
    """
    known = token_rows(features.withColumnRenamed("feature", "row_idx"), vocab).withColumnRenamed("row_idx", "feature")
    return counts.where("n > 0").select("cell", "feature").distinct().join(known, "feature").select("cell", "id", F.col("feature").alias("place"))


def encode_cells(tokens: DataFrame, embeddings: DataFrame, how: str = "mean") -> DataFrame:
    """cell, v: the mean (or max) of the vectors (id, v) of each cell's tokens, a token as often as it comes; null if none has one."""
    rows, width = _known(embeddings)
    return _pooled(tokens.join(rows, "id", "left"), ["cell"], width, how)


def model_embeddings(embeddings: DataFrame, vocab: DataFrame) -> DataFrame:
    """region, v: a model's vectors (id, v) by region, without special tokens'."""
    return embeddings.join(vocab.where(~F.col("special")).select("id", F.col("token").alias("region")), "id").select("region", "v")


def ordered_regions(embeddings: DataFrame) -> DataFrame:
    """The regions of an embedding table (region, v) by chromosome and start."""
    from intervale.functions.regions import natural_key

    x = embeddings.select("region", parse_region(F.col("region")).alias("r"))
    return x.orderBy(natural_key(F.col("r.chrom")), "r.start", "r.end").select("region")


def padded_batch(docs: DataFrame, width: int, pad: int, seed: int | None = None) -> DataFrame:
    """id, tokens, mask of documents (id, tokens): cut to ``width`` (at the end, or to a random subset in order) and padded on the right."""
    from intervale.functions.regions import mask, padded, random_subset

    kept = F.col("tokens") if seed is None else random_subset(F.col("tokens"), width, seed, F.col("id"))
    return docs.select("id", padded(kept, width, pad).alias("tokens")).withColumn("mask", mask(F.col("tokens"), pad))


def triplets(docs: DataFrame, label: str, seed: int) -> DataFrame:
    """id, positive, negative: for each document (id, label) another of its label and one of another label, by hashes.

    A document's place in a seeded order of its label, and of all, picks the next one; none where there is no such document.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    x = docs.select("id", F.col(label).cast("string").alias("chrom"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("start"))
    at = intervals.ranked(x, ["id"], bucket=1 << 50).select("id", "chrom", "n")
    sizes = at.groupBy("chrom").agg(F.max("n").alias("of"))  # a row a label
    asked = at.join(F.broadcast(sizes), "chrom")
    positive = asked.where("of > 1").select("id", "chrom", (F.col("n") % F.col("of") + 1).alias("n")).join(at.select(F.col("id").alias("positive"), "chrom", "n"), ["chrom", "n"]).select("id", "positive")
    labels = sizes.select("chrom", "of").orderBy("chrom").collect()  # a row a label
    if len(labels) < 2:
        return docs.limit(0).select("id", F.col("id").alias("positive"), F.col("id").alias("negative"))
    following = docs.sparkSession.createDataFrame([(a["chrom"], b["chrom"], b["of"]) for a, b in zip(labels, labels[1:] + labels[:1], strict=True)], "chrom string, next string, next_of long")
    other = at.join(F.broadcast(following), "chrom").select("id", F.col("next").alias("chrom"), ((F.col("n") - 1) % F.col("next_of") + 1).alias("n"))
    negative = other.join(at.select(F.col("id").alias("negative"), "chrom", "n"), ["chrom", "n"]).select("id", "negative")
    return positive.join(negative, "id")
