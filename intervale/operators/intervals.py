"""Interval algebra on half-open regions (chrom, start, end) as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.session import cut

#: Width of a join bin, and how many bins a row may fill before it is kept out of them.
BIN, WIDE = 1024, 64
#: Positions of one bucket are swept together; sums and neighbours are carried between buckets.
BUCKET = 1 << 20
#: Of tables of more rows than the session's shuffle partitions times this, a task gets about so many rows to sort or group.
DEALT = 1 << 18


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows in tasks by hashes of keys, the more tasks the larger ``n``, the count of rows; left as they are where the session's partitions suffice.

    Tables that are joined are dealt by the same n.  The number is fixed, so adaptive execution doesn't merge tasks by their compressed sizes.
    """
    tasks = -(-n // DEALT)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _bins(df: DataFrame, start: str, end: str, size: int, tier: str, bin_: str, narrow: tuple[int, ...] = (0, 2), wide: tuple[int, ...] = (1,)) -> DataFrame:
    """Rows once for each bin they fill in the tiers for narrow or for wide rows: fine bins in tier 0, bins ``WIDE`` times as wide in the others."""

    def filled(k: int) -> Column:
        width = size * WIDE if k else size
        first = F.floor(F.col(start) / width)
        return F.transform(F.sequence(first, F.greatest(F.floor((F.col(end) - 1) / width), first)), lambda b: F.struct(F.lit(k).alias("t"), b.alias("b")))

    places = F.when(F.col(end) - F.col(start) <= size * WIDE, F.concat(*map(filled, narrow))).otherwise(F.concat(*map(filled, wide)))
    return df.withColumn("_p", F.explode(places)).select(*df.columns, F.col("_p.t").alias(tier), F.col("_p.b").alias(bin_))


def interval_join(left: DataFrame, right: DataFrame, how: str = "inner", size: int = BIN, on: Column | None = None, least_share: float | None = None, rows: int | None = None) -> DataFrame:
    """Rows of ``left`` (chrom, start, end, ...) with overlapping rows of ``right`` (chrom, r_start, r_end, ...).

    Both sides are cut into bins and joined on (chrom, tier, bin).  Two narrow rows meet in the fine bins of tier 0; bins
    ``WIDE`` times as wide hold wide left rows and all right ones in tier 1, narrow left rows and wide right ones in tier 2.  So
    every pair meets in one tier, and narrow pairs never in wide bins.  It counts in the first bin that both fill, so nothing is made
    distinct afterwards.  ``least_share``: of the right row's length that
    must be covered.  ``semi`` and ``anti`` keep or drop the left rows that overlap, equal rows each for themselves.  Both sides are
    sorted and merged: rows are multiplied by their bins, which the size of their files, that broadcasts are chosen by, doesn't tell.  ``rows``: how many both sides have, where that is known without counting.
    """
    if rows is None:
        rows = 0 if left.isStreaming or right.isStreaming else left.count() + right.count()
    if how in ("semi", "anti"):
        # whether a row overlaps follows from its own columns, so equal rows share one answer
        keys = ["chrom", "start", "end"] if on is None else left.columns
        found = interval_join(dealt(left.select(keys), rows, *keys).distinct(), right, "inner", size, on, least_share, rows).select([F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        found, held = dealt(found, rows, *[f"_k{i}" for i in range(len(keys))]), dealt(left, rows, *keys)
        same = [held[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)]
        return held.join(found, same, f"left_{how}")
    overlap = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    if on is not None:
        overlap = overlap & on
    if least_share is not None:
        overlap = overlap & (F.least("end", "r_end") - F.greatest("start", "r_start") >= F.lit(least_share) * (F.col("r_end") - F.col("r_start")))
    a = _bins(left, "start", "end", size, "_lt", "_lb")
    b = _bins(right.withColumnRenamed("chrom", "_c"), "r_start", "r_end", size, "_rt", "_rb", (0, 1), (1, 2))
    met = F.col("_lb") == F.floor(F.greatest("start", "r_start") / F.when(F.col("_lt") == 0, size).otherwise(size * WIDE))
    keys = (F.col("chrom") == F.col("_c")) & (F.col("_lt") == F.col("_rt")) & (F.col("_lb") == F.col("_rb"))
    a, b = dealt(a, rows, "chrom", "_lt", "_lb"), dealt(b, rows, "_c", "_rt", "_rb")
    return a.join(b.hint("merge"), keys & met & overlap, "inner").drop("_lt", "_rt", "_lb", "_rb", "_c")


def _opened(regions: DataFrame, by: list[str], bucket: int, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is merged within buckets, (by, chrom, _b, start, end) with the last end of earlier buckets as ``_prior``, and a row a bucket with ``_prior`` and ``_all``, the last end of all.

    Rows are exchanged once, by (by, chrom, bucket), and what their buckets merge to is written: carries and ends are found on that.
    """
    keys = [*by, "chrom"]
    own, over = Window.partitionBy(*keys, "_b"), Window.partitionBy(*keys)
    x = dealt(regions.select(*keys, "start", "end").withColumn("_b", F.floor(F.col("start") / bucket)).repartition(*keys, "_b"), rows, *keys, "_b")
    before = F.max("end").over(own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumns({"_m": before, "_l": F.max("end").over(own)}).where("_m is null or start > _m")
    local = cut(x.withColumn("end", F.coalesce(F.lead("_m").over(own.orderBy("start")), F.col("_l"))).select(*keys, "_b", "start", "end"))
    lasts = local.groupBy(*keys, "_b").agg(F.max("end").alias("_last"))
    carried = lasts.select(*keys, "_b", F.max("_last").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"), F.max("_last").over(over).alias("_all"))
    carried = cut(carried)  # the size of its files tells that it, and not the rows, may be broadcast
    return local.join(carried.select(*keys, "_b", "_prior"), [*keys, "_b"]), carried


def merge(regions: DataFrame, *by: str, bucket: int = BUCKET) -> DataFrame:
    """Union of overlapping and book-ended regions within (by, chrom), none of which may be null.

    Buckets are merged on their own; what begins at or before the last end of earlier buckets goes on with a region of
    theirs, and the last region that a bucket opens ends where all before the next one that opens end.
    """
    keys = [*by, "chrom"]
    local, carried = _opened(regions, list(by), bucket, regions.count())
    opens = F.col("_prior").isNull() | (F.col("start") > F.col("_prior"))
    met = local.groupBy(*keys, "_b").agg(F.max(opens).alias("_opens"), F.greatest(F.max("_prior"), F.max(F.when(~opens, F.col("end")))).alias("_before"))
    after = met.where("_opens").select(*keys, "_b", F.lead("_before").over(Window.partitionBy(*keys).orderBy("_b")).alias("_after"))
    after = after.join(carried.select(*keys, "_b", "_all"), [*keys, "_b"]).select(*keys, "_b", F.coalesce("_after", "_all").alias("_after"))
    last = F.lead("start").over(Window.partitionBy(*keys, "_b").orderBy("start")).isNull()
    return local.where(opens).withColumn("_z", last).join(after, [*keys, "_b"]).select(*keys, "start", F.when(F.col("_z"), F.col("_after")).otherwise(F.col("end")).alias("end"))


def tokenize(regions: DataFrame, universe: DataFrame, least_share: float = 1e-9, *by: str) -> DataFrame:
    """Universe rows (uid) that each file touches: distinct (by, uid)."""
    right = universe.select("uid", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return interval_join(regions, right, least_share=least_share).select(*by, "uid").distinct()


def overlap_bp(regions: DataFrame, universe: DataFrame, by: str = "bed_id", merged: DataFrame | None = None) -> DataFrame:
    """Per file the base pairs only in the universe, only in the file and in both; both sides are merged first."""
    q, u = cut(merge(regions, by)) if merged is None else merged, cut(merge(universe))
    right = u.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = interval_join(q, right).groupBy(by).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("overlap"))
    own = q.groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    whole = u.agg(F.sum(F.col("end") - F.col("start")).alias("u_bp"))
    out = own.join(both, by, "left").crossJoin(F.broadcast(whole))  # one row
    ov = F.coalesce("overlap", F.lit(0))
    return out.select(by, (F.col("u_bp") - ov).alias("only_universe"), (F.col("bp") - ov).alias("only_file"), ov.alias("overlap"))


def around(queries: DataFrame, targets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds to queries (chrom, pos, ...) of the chromosome's targets (chrom, lo, hi): ``before``, the largest hi of those with lo <= pos, and ``after``, the smallest lo >= pos.

    Windows span one bucket of a chromosome, in which every position counts once, however many queries ask from it; what
    earlier and later buckets give is carried in.
    """
    n = queries.count() + targets.count()
    t = dealt(targets.select("chrom", "lo", "hi"), n, "chrom", "lo").groupBy("chrom", "lo").agg(F.max("hi").alias("hi")).withColumn("_b", F.floor(F.col("lo") / bucket))
    asked = dealt(queries.select("chrom", "pos"), n, "chrom", "pos").groupBy("chrom", "pos").agg(F.lit(None).cast("long").alias("_lo"), F.lit(None).cast("long").alias("_hi")).withColumn("_b", F.floor(F.col("pos") / bucket))
    marked = dealt(asked.unionByName(t.select("chrom", F.col("lo").alias("pos"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_b")), n, "chrom", "_b")
    # frames that end at the current row, in both directions: those that begin there cost the square of the rows
    own = Window.partitionBy("chrom", "_b")
    up, down = (own.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("pos"), F.desc("pos")))
    marked = marked.withColumns({"_p": F.max("_hi").over(up), "_n": F.min("_lo").over(down)})
    edges = marked.groupBy("chrom", "_b").agg(F.max("_hi").alias("hi"), F.min("_lo").alias("lo"))
    earlier, later = (Window.partitionBy("chrom").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    edges = edges.select("chrom", "_b", F.max("hi").over(earlier).alias("_before"), F.min("lo").over(later).alias("_after"))
    found = marked.where("_lo is null").join(edges, ["chrom", "_b"]).select("chrom", "pos", F.greatest("_p", "_before").alias("before"), F.coalesce("_n", "_after").alias("after"))
    return dealt(queries, n, "chrom", "pos").join(dealt(found, n, "chrom", "pos"), ["chrom", "pos"]).select(*queries.columns, "before", "after")


def nearest(queries: DataFrame, targets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds to queries (chrom, pos, ...) the nearest target position (chrom, pos) of the chromosome as ``near``, and ``distance``.

    Queries without a target on their chromosome are dropped.
    """
    both = around(queries, targets.select("chrom", F.col("pos").alias("lo"), F.col("pos").alias("hi")), bucket)
    low, high = F.col("pos") - F.col("before"), F.col("after") - F.col("pos")
    out = both.withColumn("near", F.when(high.isNull() | (low <= high), F.col("before")).otherwise(F.col("after"))).where("near is not null")
    return out.withColumn("distance", F.abs(F.col("pos") - F.col("near"))).select(*queries.columns, "near", "distance")


def nearest_span(queries: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``distance`` to queries (chrom, pos, ...): 0 within a closed span (chrom, lo, hi) of the chromosome, else to the nearest end of one."""
    both = around(queries, spans, bucket).where("before is not null or after is not null")
    gap = F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos"))
    return both.withColumn("distance", F.greatest(gap, F.lit(0).cast("long"))).select(*queries.columns, "distance")


def span_to_nearest(spans: DataFrame, points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``distance`` to closed spans (chrom, lo, hi, ...): 0 if a point (chrom, pos) lies within, else from the nearer end to the nearest point."""
    both = around(spans.withColumn("pos", F.col("hi")), points.select("chrom", F.col("pos").alias("lo"), F.col("pos").alias("hi")), bucket)
    low = F.when(F.col("before").isNotNull(), F.greatest(F.col("lo") - F.col("before"), F.lit(0).cast("long")))
    gap = F.least(low, F.col("after") - F.col("hi"))
    return both.where("before is not null or after is not null").withColumn("distance", gap).select(*spans.columns, "distance")


#: The spans of a flexible universe in which a region's start and end may lie.
SPANS = {"start": ("start", "core_start"), "end": ("core_end", "end")}


def _points(regions: DataFrame, *by: str) -> DataFrame:
    """Starts and ends as rows (by, chrom, pos), told apart by the chromosome's name, so that one pass finds the nearest of each."""
    ends = F.array(*[F.struct(F.concat("chrom", F.lit(f"|{c}")).alias("chrom"), F.col(c).alias("pos")) for c in SPANS])
    return regions.select(*by, F.explode(ends).alias("p")).select(*by, "p.*")


def _spans(universe: DataFrame) -> DataFrame:
    """A flexible universe's spans as rows (chrom, lo, hi), named as ``_points`` names starts and ends."""
    spans = F.array(*[F.struct(F.concat("chrom", F.lit(f"|{c}")).alias("chrom"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for c, (lo, hi) in SPANS.items()])
    return universe.select(F.explode(spans).alias("p")).select("p.*")


def _median(distances: DataFrame, by: str) -> DataFrame:
    return distances.groupBy(by).agg(F.percentile("distance", F.lit(0.5)).alias("median_distance"))


def _of_file(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("chrom", F.concat_ws("|", F.col(by).cast("string"), "chrom"))


def boundary_distances(regions: DataFrame, universe: DataFrame, by: str = "bed_id", merged: DataFrame | None = None) -> DataFrame:
    """Per file the median distance of its merged regions' starts and ends to the nearest universe start and end."""
    q = cut(merge(regions, by)) if merged is None else merged
    return _median(nearest(_points(q, by), _points(universe)), by)


def universe_distances(regions: DataFrame, universe: DataFrame, by: str = "bed_id", merged: DataFrame | None = None) -> DataFrame:
    """Per file the median distance of the universe's starts and ends to the nearest in the merged file.

    Every file asks for every universe row, which is the work that the median is over.
    """
    q = cut(merge(regions, by)) if merged is None else merged
    asked = _points(universe).crossJoin(q.select(by).distinct())
    return _median(nearest(_of_file(asked, by), _of_file(_points(q, by), by).drop(by)), by)


def flexible_boundary_distances(regions: DataFrame, universe: DataFrame, by: str = "bed_id") -> DataFrame:
    """As ``boundary_distances``, to a flexible universe (chrom, start, core_start, core_end, end)."""
    return _median(nearest_span(_points(merge(regions, by), by), _spans(universe)), by)


def flexible_universe_distances(regions: DataFrame, universe: DataFrame, by: str = "bed_id") -> DataFrame:
    """As ``universe_distances``, from a flexible universe."""
    q = cut(merge(regions, by))
    asked = _spans(universe).crossJoin(q.select(by).distinct())
    return _median(span_to_nearest(_of_file(asked, by), _of_file(_points(q, by), by).drop(by)), by)


def coverage(regions: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Run-length coverage (chrom, start, end, cov) of non-zero depth.

    Depth changes are summed by position first, then swept within buckets; the sum of earlier buckets is carried in.
    """
    deltas = regions.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    return swept(deltas.groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).withColumn("_b", F.floor(F.col("pos") / bucket)))


def swept(steps: DataFrame) -> DataFrame:
    """Runs (chrom, start, end, cov) of non-zero depth from its changes (chrom, _b, pos, d), one a position, in buckets ``_b`` that part positions in order."""
    order = Window.partitionBy("chrom").orderBy("_b")
    sums = steps.groupBy("chrom", "_b").agg(F.sum("d").alias("held"), F.min("pos").alias("lo"))
    sums = sums.select("chrom", "_b", F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"), F.lead("lo").over(order).alias("_next"))
    within = Window.partitionBy("chrom", "_b").orderBy("pos")
    runs = steps.withColumns({"_c": F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0)), "_e": F.lead("pos").over(within)}).join(sums, ["chrom", "_b"])
    runs = runs.select("chrom", F.col("pos").alias("start"), F.coalesce("_e", "_next").alias("end"), (F.col("_c") + F.col("_carry")).alias("cov"))
    return runs.where("cov > 0 and end is not null")


def boundary_coverage(regions: DataFrame, which: str, reach: int) -> DataFrame:
    """Coverage of the regions' starts or ends, each widened by ``reach`` on both sides."""
    at = F.col(which)
    return coverage(regions.select("chrom", F.greatest(at - reach, F.lit(0)).alias("start"), (at + reach + 1).alias("end")))


def numbered(runs: DataFrame, gap: int = 1, bucket: int = BUCKET) -> DataFrame:
    """Adds to disjoint runs (chrom, start, end, ...) the number ``island`` of the island they join: those less than ``gap`` positions apart, but at least adjacent ones.

    Windows span one bucket of a chromosome; the last end and the count of islands are carried in.
    """
    order = Window.partitionBy("chrom").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    x = runs.withColumn("_b", F.floor(F.col("start") / bucket))
    ends = x.groupBy("chrom", "_b").agg(F.max("end").alias("_last")).select("chrom", "_b", F.max("_last").over(order).alias("_prior"))
    within = Window.partitionBy("chrom", "_b").orderBy("start")
    before = F.coalesce(F.lag("end").over(within), F.col("_prior"))
    opened = F.when(F.col("start") - (before - 1) >= max(gap, 2), 1).otherwise(0)
    x = x.join(ends, ["chrom", "_b"]).withColumn("_o", opened).withColumn("_i", F.sum("_o").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    opens = x.groupBy("chrom", "_b").agg(F.max("_i").alias("_n")).select("chrom", "_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_carry"))
    return x.join(opens, ["chrom", "_b"]).select(*runs.columns, (F.col("_i") + F.col("_carry")).alias("island"))


def islands(runs: DataFrame, gap: int = 1, bucket: int = BUCKET) -> DataFrame:
    """Joins runs (chrom, start, end, cov) that are less than ``gap`` positions apart: chrom, start, end, top."""
    return numbered(runs, gap, bucket).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("cov").alias("top")).drop("island")


def zero_runs(cov: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The stretches without depth (chrom, start, end) before and between the runs of coverage; what follows the last run is none."""
    local, _ = _opened(cov, [], bucket)
    before = F.lag("end").over(Window.partitionBy("chrom", "_b").orderBy("start"))
    gaps = local.select("chrom", F.coalesce(F.greatest(before, "_prior"), F.lit(0).cast("long")).alias("start"), F.col("start").alias("end"))
    return gaps.where("start < end")


def covered_segments(cov: DataFrame, sizes: DataFrame, gap: int = 1000, area: int = 500) -> DataFrame:
    """Segments (chrom, start, end) that hold all covered positions, for chromosomes that are mostly empty.

    Covered positions more than ``gap`` apart part them; each is widened by ``area``.  The first begins at 0 if its first
    covered position is at most ``gap``; the last ends within the chromosome.
    """
    found = islands(cov, gap + 1).select("chrom", "start", "end")
    edges = found.groupBy("chrom").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    x = found.join(F.broadcast(edges), "chrom").join(F.broadcast(sizes), "chrom")  # a row a chromosome
    low = F.when((F.col("start") == F.col("_first")) & (F.col("start") <= gap), 0).otherwise(F.col("start") - area)
    high = F.col("end") - 1 + area
    return x.select("chrom", low.cast("long").alias("start"), F.when(F.col("end") == F.col("_last"), F.least(high, F.col("size"))).otherwise(high).alias("end"))


def segments_between_gaps(cov: DataFrame, sizes: DataFrame, gap: int = 10000, area: int = 1000) -> DataFrame:
    """Segments (chrom, start, end) between the stretches of at least ``gap`` empty positions, for chromosomes that are mostly covered.

    Each reaches ``area`` into the stretches on both sides; the first empty stretch counts whatever its length, and what
    lies before it is left out, the last segment goes to the chromosome's end.
    """
    empty = zero_runs(cov)
    first = empty.groupBy("chrom").agg(F.min("start").alias("_first"))
    # stretches that long are few on a chromosome
    kept = empty.join(F.broadcast(first), "chrom").where((F.col("start") == F.col("_first")) | (F.col("end") - F.col("start") >= gap))
    following = F.lead("start").over(Window.partitionBy("chrom").orderBy("start"))
    some = kept.join(F.broadcast(sizes), "chrom").select("chrom", F.greatest(F.col("end") - 1 - area, F.lit(0)).alias("start"), F.coalesce(following + area, F.col("size")).alias("end"))
    whole = cov.select("chrom").distinct().join(first, "chrom", "left_anti").join(F.broadcast(sizes), "chrom").select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return some.unionByName(whole)


def nonzero_segments(cov: DataFrame, sizes: DataFrame) -> DataFrame:
    """``covered_segments`` of the chromosomes of which less than half is covered, ``segments_between_gaps`` of the others."""
    covered = cov.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("n")).join(F.broadcast(sizes), "chrom")
    sparse = covered.where("n < size - n").select("chrom")
    return covered_segments(cov.join(F.broadcast(sparse), "chrom", "left_semi"), sizes).unionByName(segments_between_gaps(cov.join(F.broadcast(sparse), "chrom", "left_anti"), sizes))


def unsorted_rows(regions: DataFrame, by: str = "bed_id", bucket: int = BUCKET) -> DataFrame:
    """The rows (by, row_idx, chrom, start) that break their file's order by natural chromosome and start; none if it is sorted."""
    from intervale.functions.regions import natural_key

    x = regions.select(by, "row_idx", "chrom", "start", F.struct(natural_key(F.col("chrom")).alias("c"), "start").alias("_key")).withColumn("_b", F.floor(F.col("row_idx") / bucket))
    lasts = x.groupBy(by, "_b").agg(F.max_by("_key", "row_idx").alias("_last"))
    lasts = lasts.select(by, "_b", F.lag("_last").over(Window.partitionBy(by).orderBy("_b")).alias("_prior"))
    before = F.coalesce(F.lag("_key").over(Window.partitionBy(by, "_b").orderBy("row_idx")), F.col("_prior"))
    return x.join(lasts, [by, "_b"]).withColumn("_before", before).where("_key < _before").select(by, "row_idx", "chrom", "start")


def incidence(regions: DataFrame, universe: DataFrame, by: str = "bed_id") -> DataFrame:
    """uid, by: which files hold a region with exactly a universe row's chromosome, start and end."""
    return universe.select("uid", "chrom", "start", "end").join(regions.select(by, "chrom", "start", "end").distinct(), ["chrom", "start", "end"]).select("uid", by)


def ranked(rows: DataFrame, order: list[str], bucket: int = BUCKET) -> DataFrame:
    """Adds ``n``, the place (from 1) within the chromosome by start and then ``order``; counts of earlier buckets are carried in."""
    x = rows.withColumn("_b", F.floor(F.col("start") / bucket))
    earlier = Window.partitionBy("chrom").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("chrom", "_b").agg(F.count(F.lit(1)).alias("_n")).select("chrom", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    within = F.row_number().over(Window.partitionBy("chrom", "_b").orderBy("start", *order))
    return x.withColumn("_i", within).join(counts, ["chrom", "_b"]).withColumn("n", F.col("_i") + F.col("_carry")).drop("_i", "_carry", "_b")


def neighbours(regions: DataFrame, k: int) -> DataFrame:
    """The k regions of the same chromosome nearest to each (uid, neighbour, place), among the k before and after it.

    Each region asks 2k times, so neither side is broadcast.
    """
    from intervale.functions.regions import genome_distance

    at = ranked(regions.select("uid", "chrom", "start", "end"), ["uid"])
    other = at.select(F.col("uid").alias("neighbour"), "chrom", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("n").alias("m"))
    asked = at.withColumn("m", F.explode(F.sequence(F.col("n") - k, F.col("n") + k))).where("m <> n")
    near = asked.join(other.hint("merge"), ["chrom", "m"]).withColumn("d", genome_distance(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")))
    place = F.row_number().over(Window.partitionBy("uid").orderBy("d", "neighbour"))
    return near.withColumn("place", place).where(F.col("place") <= k).select("uid", "neighbour", "place")
