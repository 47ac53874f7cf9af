"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's fingerprint is every distinct hash of its five-word shingles that lies below a fixed share of all hashes, and the
least hash in any case, so that no text with words has an empty one.  Whether a hash is kept depends on nothing but itself (or on being the
least), so fingerprints merge: that of several texts together is the union of theirs, once more cut at the bar.  The share of a
fingerprint that another holds estimates how much of the one text the other contains, however unequal their lengths.

Each document is also compared with the next one by identifier.  Neighbours are found in ranges of identifiers: bounds from
approximate quantiles, a window within each range, and a copy of each range's last row in the range after it.  Texts are
exchanged once.  An identifier that fills several ranges is spread over them by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.common import cut, table

WORDS, DIGITS = 5, 16
#: Hashes, as hexadecimal digits, are kept if they sort before this: an eighth of all.
BAR = "2"
#: Bytes of text that a range of identifiers should hold, and the most ranges that there are.
RANGE_BYTES, MOST_RANGES = 1 << 22, 1 << 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of a text's shingles, in order; fewer words than a shingle make one, none (or null) none."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, words)).cast("binary")), 1, DIGITS))

    return _let(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""), hashes)


def sketch(text: Column, words: int = WORDS, bar: str = BAR) -> Column:
    """A text's fingerprint: sorted distinct hashes."""
    known = _let(shingle_hashes(text, words), lambda h: F.struct(h.alias("all"), F.array_min(h).alias("least")))
    return F.array_sort(F.array_distinct(_let(known, lambda k: F.filter(k["all"], lambda x: (x < bar) | (x == k["least"])))))


def contained(own: Column, other: Column) -> Column:
    """The share of a fingerprint that another holds: 1 if both are empty, 0 if only the first is."""
    return F.when(F.size(own) == 0, F.when(F.size(other) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def resemblance(own: Column, other: Column) -> Column:
    """Common hashes by all hashes of two fingerprints: 1 if both are empty."""
    both = F.size(F.array_intersect(own, other))
    return F.when((F.size(own) == 0) & (F.size(other) == 0), 1.0).otherwise(both / (F.size(own) + F.size(other) - both))


def merged(prints: DataFrame, *by: str, column: str = "fingerprint", bar: str = BAR) -> DataFrame:
    """by, hash: the fingerprints of all texts of each group together, a row a hash, so that no group's is in one place."""
    every = prints.select(*by, F.explode(column).alias("hash")).distinct()
    least = every.groupBy(*by).agg(F.min("hash").alias("_l"))
    low = every.where(F.col("hash") < bar)
    return low.unionByName(least.where(F.col("_l") >= bar).select(*by, F.col("_l").alias("hash")))


def containments(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """by, other, share: how much of each group's merged fingerprint (by, hash) of ``left`` those of ``right`` hold, where it is not 0."""
    size = left.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    met = left.join(right.select(F.col(by).alias("other"), "hash"), "hash").groupBy(by, "other").agg(F.count(F.lit(1)).alias("both"))
    return met.join(size, by).select(by, "other", (F.col("both") / F.col("n")).alias("share"))


def _reached(bounds: list[int], key: Column, strictly: bool) -> Column:
    """How many of the sorted bounds lie below ``key`` (or at it, unless ``strictly``), by binary search."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    padded = F.lit(bounds + [_MOST] * (2 * steps[0] - 1 - len(bounds)))

    def step(at: Column, width: Column) -> Column:
        there = F.element_at(padded, (at + width).cast("int"))
        return F.when(there < key if strictly else there <= key, at + width).otherwise(at)

    return F.least(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step), F.lit(len(bounds)))


def in_ranges(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds _key (the id, null as the least), _tie (a hash of the text) and _range to rows (doc_id, text).

    Ranges grow with _key and then _tie.  Only an aggregate of bounds, at most ``MOST_RANGES`` numbers, is on the driver.
    """
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("_tie", F.xxhash64("text"))
    held = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = min(-(-held // range_bytes), MOST_RANGES)
    if n < 2:
        return rows.withColumn("_range", F.lit(0))
    bounds = rows.agg(F.percentile_approx("_key", [k / n for k in range(1, n)], max(10_000, 16 * n))).first()[0]
    low, high = _reached(bounds, F.col("_key"), True), _reached(bounds, F.col("_key"), False)
    # a key that is several bounds fills the ranges between them, in the order of the tie
    share = F.col("_tie") / F.lit(2.0**64) + 0.5
    return rows.withColumn("_lo", low).withColumn("_hi", high).withColumn("_range", F.least(F.col("_lo") + 1 + F.floor(share * (F.col("_hi") - F.col("_lo"))).cast("int"), F.col("_hi"))).drop("_lo", "_hi")


def with_next(rows: DataFrame, columns: dict[str, Column], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds columns to rows (doc_id, text, ...), and as next_<column> those of the row with the next smaller doc_id, after the last of the first.

    Columns are computed after the last rows of ranges are copied, so once for each row.  Null ids come last; rows of one id in the order of a hash of their texts.  A row that is alone is its own next one.
    """
    names = list(dict.fromkeys([*rows.columns, *columns]))
    placed = in_ranges(rows, range_bytes)
    ends = placed.groupBy("_range").agg(F.max(F.struct("_key", "_tie")).alias("e"))  # a row a range: at most MOST_RANGES
    order = Window.orderBy("_range")
    first = F.min("_range").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = cut(ends.select("_range", F.col("e._key").alias("_key"), F.col("e._tie").alias("_tie"), F.coalesce(F.lead("_range").over(order), first).alias("_to")))
    ghosts = placed.join(F.broadcast(ends), ["_range", "_key", "_tie"]).withColumn("_range", F.col("_to")).drop("_to").withColumn("_ghost", F.lit(True))
    every = placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts).withColumns(columns)
    before = Window.partitionBy("_range").orderBy(F.desc("_ghost"), "_key", "_tie", "text")
    return every.withColumns({f"next_{c}": F.lag(c).over(before) for c in columns}).where("not _ghost").select(*names, *[f"next_{c}" for c in columns])


def compared(docs: DataFrame, *, words: int = WORDS, bar: str = BAR, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint (arrays of hashes).

    Ids are integers.  The edited text ends in the beginning of the next document, descending by id (null last; after the
    last comes the first), in place of its own last third; a shorter next document is taken whole.  A null text is empty,
    and texts without words have empty fingerprints.  Rows that repeat an id follow each other in the order of a hash of their
    texts.  Texts of any length are read whole.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, {"text": F.col("text"), "fingerprint": sketch(F.col("text"), words, bar)}, range_bytes)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    return out.withColumn("edited_fingerprint", sketch(F.col("edited"), words, bar))


def op11_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how much of the first that and the next document's hold."""
    out = compared(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join(own, " ").alias("fingerprint"), F.array_join(edited, " ").alias("edited_fingerprint"), contained(own, edited).alias("near_edited"), contained(own, following).alias("near_next")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d),
e AS (SELECT doc_id, n, text, following, left(text, n - n // 3) || left(following, n // 3) AS edited FROM o),
w AS (SELECT doc_id, n, edited, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(edited, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS b, list_filter(regexp_split_to_array(following, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS c FROM e),
h AS (SELECT doc_id, n, edited,
  list_transform(range(1, CASE WHEN len(a) = 0 THEN 1 ELSE greatest(len(a) - 3, 2) END), lambda i: left(md5(array_to_string(a[i:i + 4], ' ')), 16)) AS a,
  list_transform(range(1, CASE WHEN len(b) = 0 THEN 1 ELSE greatest(len(b) - 3, 2) END), lambda i: left(md5(array_to_string(b[i:i + 4], ' ')), 16)) AS b,
  list_transform(range(1, CASE WHEN len(c) = 0 THEN 1 ELSE greatest(len(c) - 3, 2) END), lambda i: left(md5(array_to_string(c[i:i + 4], ' ')), 16)) AS c FROM w),
m AS (SELECT *, list_min(a) AS la, list_min(b) AS lb, list_min(c) AS lc FROM h),
s AS (SELECT doc_id, n, edited, list_sort(list_distinct(list_filter(a, lambda x: x < '2' OR x = la))) AS a, list_sort(list_distinct(list_filter(b, lambda x: x < '2' OR x = lb))) AS b, list_sort(list_distinct(list_filter(c, lambda x: x < '2' OR x = lc))) AS c FROM m)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(a, ' '), '') AS fingerprint, coalesce(array_to_string(b, ' '), '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS near_edited,
  CASE WHEN len(a) = 0 THEN CASE WHEN len(c) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect(a, c))::DOUBLE / len(a) END AS near_next
FROM s
"""
