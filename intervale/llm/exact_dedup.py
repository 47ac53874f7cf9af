"""Exact de-duplication by a tree merge of sorted digest runs.

Every input partition sorts its rows by digest and hands on one row for each digest it holds: a sorted run of (digest, length
and second hash of the text, smallest identifier, rows).  Runs then merge in binomial rounds: in round k the runs whose
numbers agree but for their lowest ``k * FAN_BITS`` bits exchange their rows by a hash of digest and run; each task sorts and merges what it
got, and of rows whose digest, length and second hash all agree only the smallest identifier and the sum of rows go on.  A digest
therefore costs one row for each run that holds it in the first round and fewer in each later one, however many copies
there are, and no task sees all copies.  A digest that comes once goes through all rounds too.

The smallest identifier is a struct, so Spark aggregates by sorting: each round's plan sorts and merges below the exchange,
exchanges, and merges the sorted pieces above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import cut, table

#: Runs at the start, and how many bits of the run number each round merges.
RUN_BITS, FAN_BITS = 8, 4
#: Up to so many groups of copies (24 MB of digests and ids) are broadcast to whole rows; more are joined by shuffling.
BROADCAST_GROUPS = 500_000
#: What two texts must share to be one: the digest, and what verifies it.
KEYS = ["digest", "check", "bytes"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digested(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """Rows (columns, digest, check, bytes, run) of documents."""
    norm = docs.select(*columns, normalised(F.col(text_col)).alias("_norm"))
    keep = [F.col(f"`{c}`") for c in norm.columns if c != "_norm"]
    return norm.select(
        *keep, F.unhex(F.sha2("_norm", 256)).alias("digest"), F.xxhash64("_norm").alias("check"), F.octet_length("_norm").alias("bytes"), F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS)).alias("run")
    )


def tree_merge(runs: DataFrame, run_bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Merges rows (KEYS, run, least, n), ``least`` a struct, in binomial rounds to one row for each of the keys: KEYS, least, n."""
    merged, left = runs, run_bits
    while True:
        merged = merged.groupBy(*KEYS, "run").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        if left <= 0:
            return merged.drop("run")
        left -= fan_bits
        merged = merged.withColumn("run", F.shiftright("run", fan_bits) if left > 0 else F.lit(0))


def identifier(id_col: str) -> Column:
    """Ids in order, null last."""
    return F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their white-space-normalised forms are; null is the empty text.  The row with the smallest id
    stays.  Where an id repeats within a group, all of that id's rows say kept.  A null id is larger than all others: it
    stays only in a group of null ids.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = cut(digested(docs, text_col, F.col(id_col).alias("doc_id")))
    groups = tree_merge(rows.select(*KEYS, "run", identifier("doc_id").alias("least"), F.lit(1).alias("n")))
    # only rows of real groups need a partner: the join is by digest, its large side may be split by the engine
    many = groups.where("n > 1").select(*KEYS, F.col("least.id").alias("least"), "n")
    out = rows.join(many, KEYS, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: of equal texts the first row by id (null ids last).

    Nothing that depends on how the table is split decides what stays, as the table is read twice.  Where the first id
    repeats within a group, the row whose columns come first as text stays.  An empty table stays empty.
    """
    narrow = cut(digested(docs, text_col, identifier(id_col).alias("_row")))
    many = tree_merge(narrow.select(*KEYS, "run", F.col("_row").alias("least"), F.lit(1).alias("n")))
    many = cut(many.where("n > 1").select(*KEYS, F.col("least").alias("_least")))
    small = many.count() <= BROADCAST_GROUPS

    def met(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(groups) if small else groups, KEYS, how)

    first = F.col("_row").eqNullSafe(F.col("_least"))
    tied = cut(met(narrow, many, "inner").where(first).groupBy(*KEYS).count().where("count > 1").select(*KEYS))
    own = [F.col(f"_whole.`{c}`") for c in docs.columns]
    out = met(digested(docs, text_col, F.struct("*").alias("_whole"), identifier(id_col).alias("_row")), many, "left").where(F.col("_least").isNull() | first)
    if tied.isEmpty():
        return out.select(own)
    out = met(out, tied.withColumn("_tied", F.lit(True)), "left")
    one = out.where("_tied").groupBy(*KEYS).agg(F.min_by("_whole", F.struct(*[c.cast("string") for c in own])).alias("_whole"))
    return out.where("_tied is null").select(own).unionByName(one.select(own))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY norm)
SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
