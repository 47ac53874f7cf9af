"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight over training time, piecewise linear between evenly spaced knots.  The integral of the weight is
its cumulative demand for words; a document that begins after ``c`` of its source's words is due where the demand reaches
``c``, found by inverting the integral.  Documents are then range-sorted by these positions.  A source's share of the whole
is its target; targets stop at ``max_passes`` times the source's size, and the excess is shared again by weight.

Cumulative sizes are sums over (source, bucket of the id's hash) plus windows within a bucket.  There are 4096 buckets or
more, so many that the largest source's hold some 4096 rows each; rows never meet by source alone.  Positions lie in [0, 1]
and are even over the words of the mix, so the ranges of the last sort are equal parts of that and need no sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import cut, table

#: The least number of hex digits of the hash that name a bucket, and the rows of a bucket beyond which there are more.
BUCKET_DIGITS, BUCKET_ROWS = 3, 4096
WEIGHTS = (3, 1, 2)
#: For each source in turn: its weight at the start, middle and end of training, relative to its mean.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def size_of(text: Column) -> Column:
    """The number of runs of characters that are not ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _turn(values, nth: Column) -> Column:
    """The value of a source that is the nth (from 1), the values repeating."""
    return F.element_at(F.array(*values), ((nth - 1) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, share: float, weights, schedules, max_passes: int) -> DataFrame:
    """key, source_size, target, schedule of sources (key, source, source_size), of which there is one row each.

    The smallest ``cap / weight`` are filled first; the level at which the rest share what is left is the first at which
    the next source is not filled.  This table has a row for each source, not for each document.
    """
    every, by_name = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    caps = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn("w", _turn([F.lit(x) for x in weights], F.col("nth"))).withColumn("cap", F.col("source_size") * max_passes)
    caps = caps.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    caps = caps.withColumn("level", level)
    open_at = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth"))
    caps = caps.withColumn("line", F.coalesce(F.min_by("level", open_at).over(every), F.lit(float("inf"))))
    knots = [F.array(*[F.lit(float(x)) for x in s]) for s in schedules]
    return caps.select("key", "source_size", F.least(F.col("cap").cast("double"), F.col("line") * F.col("w")).alias("target"), _turn(knots, F.col("nth")).alias("schedule"))


def due(share: Column, schedule: Column) -> Column:
    """The time in [0, 1] at which the integral of a schedule reaches a share of its whole."""
    last = F.size(schedule) - 1
    k = last.cast("double")
    steps = F.transform(F.sequence(F.lit(0), last - 1), lambda i: (schedule[i] + schedule[i + 1]) / 2 / k)
    reached = F.transform(F.sequence(F.lit(0), last), lambda j: F.aggregate(F.slice(steps, 1, j), F.lit(0.0), lambda a, x: a + x))
    want = share * F.element_at(reached, -1)
    at = F.array_max(F.filter(F.sequence(F.lit(0), last - 1), lambda j: reached[j] <= want))
    rest, a, b = want - reached[at], schedule[at], schedule[at + 1]
    root = F.sqrt(F.greatest(a * a + (b - a) * k * rest * 2, F.lit(0.0)))
    return F.when(share.isNull(), None).otherwise(F.least(F.lit(1.0), at / k + F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (a + root))))


def digits(rows: int) -> int:
    """How many hex digits name buckets of at most about ``BUCKET_ROWS`` of so many rows."""
    n = BUCKET_DIGITS
    while rows > BUCKET_ROWS << 4 * n:
        n += 1
    return n


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by (position, order): parts of equal width of [0, 1], each sorted; those without a position lie in any part, first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1))
    part = F.when(F.col("position").isNotNull(), placed).otherwise(F.pmod(F.xxhash64("order"), F.lit(parts)))
    return rows.repartitionById(parts, part.cast("int")).sortWithinPartitions("position", "order")


def plan(rows: DataFrame, *, bucket_digits: int = BUCKET_DIGITS, share: float = 1.5, weights=WEIGHTS, schedules=SCHEDULES, max_passes: int = 2) -> DataFrame:
    """Adds to rows (key, source, size, order, doc_id, ...) source_size, target, taken and positions (one for each pass that takes words).

    Words are taken in the order of the hash, pass after pass, until the target (rounded) is reached; the last document
    is taken in part.
    """
    rows = rows.withColumn("bucket", F.substring("order", 1, bucket_digits))
    parts = rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("held"))
    sizes = parts.groupBy("key").agg(F.first("source").alias("source"), F.sum("held").alias("source_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("key", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start")).join(targets(sizes, share, weights, schedules, max_passes), "key")
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["key", "bucket"])
    goal, before = F.floor(F.col("target") + 0.5), F.col("start") + F.col("inside")
    passes = F.sequence(F.lit(0), F.lit(max_passes - 1))

    def took(p: Column) -> Column:
        return F.least(F.greatest(goal - p * F.col("source_size") - before, F.lit(0)), F.col("size"))

    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda a, p: a + took(p))
    positions = F.transform(F.filter(passes, lambda p: took(p) > 0), lambda p: due((p * F.col("source_size") + before) / F.col("target"), F.col("schedule")))
    return rows.withColumn("taken", taken).withColumn("positions", positions).drop("bucket", "start", "inside", "schedule")


def keyed(docs: DataFrame, *columns: Column | str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows with key (of the source; null is a source of its own), source, size, order (hash of the id) and doc_id."""
    source = F.col(source_col).cast("string")
    return docs.select(
        *columns, F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), source.alias("source"), size_of(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("order"), F.col(id_col).alias("doc_id")
    )


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row, range-sorted by position: doc_id, size, source_size, target, taken, position (first; null if nothing is taken), positions.

    Null and empty texts have size 0 and are never taken.  Rows that repeat an id count each; their order among equals
    follows their sizes.  Reruns agree.  Other columns are ignored.  Where no text has words, nothing is taken.
    """
    rows = cut(keyed(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    out = plan(rows, bucket_digits=digits(rows.count()), **options).withColumn("position", F.when(F.size("positions") > 0, F.col("positions")[0]))
    return in_order(out).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, whole, with their columns, in the order of their positions: as often as their words are taken.

    A document of which the last pass takes under half its words is left out of that pass.
    """
    rows = keyed(docs, F.struct("*").alias("whole"), id_col=id_col, text_col=text_col, source_col=source_col)
    out = plan(rows, bucket_digits=digits(docs.count()), **options)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    out = out.where("taken > 0").select("whole", "order", F.explode(F.slice("positions", 1, times)).alias("position"))
    return in_order(out).select("whole.*")


def op3_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in a mix of half as many words again, sources weighing 3, 1, 2, repeating."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
c AS (SELECT *, [3, 1, 2][(nth - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl FROM c WINDOW o AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT lvl AS line FROM r WHERE lvl <= ratio ORDER BY ratio, nth LIMIT 1),
t AS (SELECT source, source_size, nth, least(CAST(cap AS DOUBLE), coalesce((SELECT line FROM l), 'inf'::DOUBLE) * w) AS target FROM r),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.nth, floor(t.target + 0.5) AS goal, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(least(greatest(goal - before, 0), size) AS BIGINT) AS first_pass, CAST(least(greatest(goal - source_size - before, 0), size) AS BIGINT) AS second_pass, CAST(before AS DOUBLE) / target AS u, CASE (nth - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM b),
p AS (SELECT *, CASE WHEN u < (1 + slope / 2) / 2 THEN 0 ELSE 1 END AS seg FROM k),
q AS (SELECT *, u - seg * (1 + slope / 2) / 2 AS rest, 1 + slope * (1 - seg) AS a FROM p)
SELECT doc_id, size, source_size, target, first_pass + second_pass AS taken,
  CASE WHEN first_pass > 0 THEN round(seg / 2 + CASE WHEN rest <= 0 THEN 0 ELSE rest * 2 / (a + sqrt(greatest(a * a - slope * 2 * rest * 2, 0))) END, 6) END AS position
FROM q
"""
