"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name: an offset and a
stride.  Shards take turns, and each claims the first slot of its permutation that is free, until the table is full.  A
document's slot is a hash of its id, and the broadcast table names its shard: constant time for each document, shares
within about shards / slots of each other, and few documents move when a shard is added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import cut, table

SHARDS, SLOTS = 64, 8191
#: The table is broadcast: its size is a parameter with this bound, never a number of documents.
MOST_SLOTS = 131_071


def number(text: Column) -> Column:
    """The first 32 bits of the text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table, one row for each slot.

    The fold's state is the table so far, in blocks of about the square root of its slots so that a claim copies two short
    arrays, each shard's next place in its permutation, and the claim at hand.  A turn takes two steps: the shard looks for
    its first free place, among the next 4, 32, 512 or all the rest, and then claims it.
    """
    if not 0 < len(set(names)) <= slots <= MOST_SLOTS or len(set(names)) != len(names):
        raise ValueError("names must differ, and be no more than the slots")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime from 3 on")
    side = int(slots**0.5) + 1
    of = F.array(*[F.lit(n) for n in names])
    one = spark.range(1).select(
        F.transform(of, lambda n: number(F.concat(F.lit("offset|"), n)) % slots).alias("off"), F.transform(of, lambda n: number(F.concat(F.lit("stride|"), n)) % (slots - 1) + 1).alias("skip")
    )

    def free(most: int) -> str:
        place = f"cast((off[i] + j * skip[i]) % {slots} as int)"
        return f"get(filter(sequence(s.next[i], least(s.next[i] + {most}, {slots - 1})), j -> s.claimed[cast({place} div {side} as int)][{place} % {side}] < 0), 0)"

    choose = f"""
        transform(array(cast(t div 2 % {len(names)} as int)), i ->
        transform(array(coalesce({free(3)}, {free(31)}, {free(511)}, {free(slots)})), j ->
        named_struct('i', i, 'j', j, 'c', cast((off[i] + j * skip[i]) % {slots} as int)))[0])[0]"""
    block, at = f"cast(s.claim.c div {side} as int)", f"s.claim.c % {side}"
    claimed = f"concat(slice(s.claimed, 1, {block}), array(concat(slice(s.claimed[{block}], 1, {at}), array(s.claim.i), slice(s.claimed[{block}], {at} + 2, {side}))), slice(s.claimed, {block} + 2, {side}))"
    after = f"concat(slice(s.next, 1, s.claim.i), array(s.claim.j + 1), slice(s.next, s.claim.i + 2, {len(names)}))"
    # no struct that holds the table passes through transform, which would copy the whole
    turn = f"if(t % 2 = 0, named_struct('claimed', s.claimed, 'next', s.next, 'claim', {choose}), named_struct('claimed', {claimed}, 'next', {after}, 'claim', s.claim))"
    start = f"named_struct('claimed', array_repeat(array_repeat(-1, {side}), {side}), 'next', array_repeat(cast(0 as bigint), {len(names)}), 'claim', named_struct('i', 0, 'j', cast(0 as bigint), 'c', 0))"
    filled = one.select(F.expr(f"slice(flatten(aggregate(sequence(0, {2 * slots - 1}), {start}, (s, t) -> {turn}, s -> s.claimed)), 1, {slots})").alias("claimed"))
    return cut(filled.select(F.posexplode_outer("claimed").alias("slot", "shard")))


def assign(docs: DataFrame, names: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """Adds slot (int) and shard (the place of its name in ``names``) to the rows, in place of columns so named.

    Equal ids go to one shard, and so do all null ids.  An empty table stays empty.
    """
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")])
    at = number(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % slots
    return docs.withColumn("slot", at.cast("int")).join(F.broadcast(lookup_table(docs.sparkSession, names, slots)), "slot").select(*[F.col(f"`{c}`") for c in docs.columns], "slot", "shard")


def op1_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 64, with its source and size in bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return assign(docs, [f"shard-{k:03d}" for k in range(SHARDS)])
