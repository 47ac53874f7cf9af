"""Token tables: context windows, frequencies, sentences, pooling inputs and rank encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.session import cut

#: Words that one task of Word2Vec goes through.
TRAINED = 1 << 20


def context(tokens: Column, i: Column, w: int) -> Column:
    """The in-bounds neighbours of place i (from 0), padded with 0 to 2w."""
    low = F.greatest(i - w, F.lit(0))
    got = F.concat(F.slice(tokens, low + 1, i - low), F.slice(tokens, i + 2, F.lit(w)))
    return F.concat(got, F.array_repeat(F.lit(0).cast("int"), F.lit(2 * w) - F.size(got)))


def cbow_windows(docs: DataFrame, w: int) -> DataFrame:
    """id, place, target, context of rows (id, tokens)."""
    x = docs.select("id", "tokens", F.posexplode("tokens").alias("place", "target"))
    return x.select("id", "place", "target", context(F.col("tokens"), F.col("place"), w).alias("context"))


def cbow_windows_wrapped(docs: DataFrame, w: int) -> DataFrame:
    """As ``cbow_windows`` with neighbours taken round the end; documents of at most 2w tokens are left out."""
    x = docs.where(F.size("tokens") > 2 * w).select("id", "tokens", F.posexplode("tokens").alias("place", "target"))
    steps = F.array(*[F.lit(d) for d in [*range(-w, 0), *range(1, w + 1)]])
    around = F.transform(steps, lambda d: F.element_at("tokens", (F.pmod(F.col("place") + d, F.size("tokens")) + 1).cast("int")))
    return x.select("id", "place", "target", around.alias("context"))


def frequency(tokens: DataFrame) -> DataFrame:
    """token, n, share of rows (token)."""
    n = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(tokens.agg(F.count(F.lit(1)).alias("_all")))).select("token", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def negative_sampling(tokens: DataFrame, power: float = 0.75) -> DataFrame:
    """token, p: the chance of each token as a negative example, its share to a power."""
    p = frequency(tokens).select("token", F.pow("share", F.lit(power)).alias("p"))
    return p.crossJoin(F.broadcast(p.agg(F.sum("p").alias("_all")))).select("token", (F.col("p") / F.col("_all")).alias("p"))  # one row


def sentences(tokens: DataFrame, seed: int) -> DataFrame:
    """id, sentence: the tokens (id, token) of each document in a seeded random order, space-joined."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("token")))
    return tokens.groupBy("id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(h.alias("h"), "token"))), lambda s: s["token"])).alias("sentence"))


def train_embeddings(sentences: DataFrame, width: int = 100, least: int = 5, passes: int = 1, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """word, v: Word2Vec vectors from sentences (sentence), in which tokens stand in random order.

    Each of ``partitions`` trains on its sentences, and Spark mixes their vectors; by default there is one for every ``TRAINED`` words, so
    that no task's work grows with the corpus.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    docs = sentences.select(F.split("sentence", " ").alias("words"))
    if partitions is None:
        docs = cut(docs)
        partitions = max(1, -(-(docs.agg(F.sum(F.size("words"))).first()[0] or 0) // TRAINED))
    model = Word2Vec(vectorSize=width, minCount=least, seed=seed, maxIter=passes, numPartitions=partitions, inputCol="words", outputCol="v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("v"))


def sampled_sentences(tokens: DataFrame, length: int, seed: int) -> DataFrame:
    """id, sentence: ``length`` tokens of each document drawn with replacement by their weight (id, token, weight).

    A document's weights lie end to end in the order of its tokens; each drawn number falls on one of them.
    """
    from intervale.functions.regions import uniform

    some = tokens.where("weight > 0")
    line = Window.partitionBy("id").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    spans = some.select("id", "token", F.coalesce(F.sum("weight").over(line), F.lit(0.0)).alias("_at"), F.lit(None).cast("int").alias("_k"))
    every = some.groupBy("id").agg(F.sum("weight").alias("_all"))
    draws = every.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_at", uniform(seed, "sample", F.concat_ws("|", F.col("id").cast("string"), F.col("_k").cast("string"))) * F.col("_all"))
    # each draw takes the last token that begins at or before it: rows of tokens and draws, not their product
    before = Window.partitionBy("id").orderBy("_at", F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = spans.unionByName(draws.select("id", F.lit(None).cast(tokens.schema["token"].dataType).alias("token"), "_at", "_k"))
    met = placed.withColumn("token", F.last("token", ignorenulls=True).over(before)).where("_k is not null")
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "token"))), lambda s: s["token"]), " ").alias("sentence"))


def collapse(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sums counts (cell, gene, n) of genes that map (gene, to) to one."""
    return counts.join(mapping, "gene").groupBy("cell", F.col("to").alias("gene")).agg(F.sum("n").alias("n"))


def rank_encode(counts: DataFrame, medians: DataFrame, length: int, cls: int | None = None, eos: int | None = None) -> DataFrame:
    """cell, tokens: genes of (cell, gene, n) by falling n / cell total * 10000 / median (ties: gene), cropped to ``length``."""
    total = counts.groupBy("cell").agg(F.sum("n").alias("all"))
    x = counts.join(total, "cell").join(medians, "gene").withColumn("x", F.col("n") / F.col("all") * 10000 / F.col("median")).where("x > 0")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc(F.round("x", 9)), "gene"))
    room = length - (cls is not None) - (eos is not None)
    kept = x.withColumn("place", place).where(F.col("place") <= room).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gene"))), lambda s: s["gene"]).alias("tokens"))
    around = [F.array(F.lit(t).cast("long")) for t in (cls, eos) if t is not None]
    tokens = F.col("tokens") if not around else F.concat(around[0], F.col("tokens"), *around[1:])
    return kept.select("cell", tokens.alias("tokens"), F.size(tokens).alias("length"))


def corrupt(tokens: DataFrame, vocabulary: int, rate: float, seed: int) -> DataFrame:
    """Replaces tokens (id, place, token) at a rate by random ids; label 1 where replaced, else 0."""
    from intervale.functions.regions import uniform

    key = F.concat_ws("|", F.col("id").cast("string"), F.col("place").cast("string"))
    hit = uniform(seed, "mask", key) < rate
    new = F.floor(uniform(seed, "pick", key) * vocabulary)
    return tokens.select("id", "place", F.when(hit, new).otherwise(F.col("token")).alias("token"), F.when(hit, 1).otherwise(0).alias("label"))
