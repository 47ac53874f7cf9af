"""Universes from coverage, their likelihood, and their assessment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.regions import f_beta, rbs
from intervale.operators import intervals, paths
from intervale.session import cut, prepare


def cc(cov: DataFrame, sizes: DataFrame, cutoff: float | None = None, join: int = 0, least: int = 0) -> DataFrame:
    """Coverage-cutoff universe: positions covered at least ``cutoff`` times (default: the chromosome's mean)."""
    if cutoff is None:
        mean = cov.groupBy("chrom").agg(F.sum(F.col("cov") * (F.col("end") - F.col("start"))).alias("mass")).join(F.broadcast(sizes), "chrom")
        runs = cov.join(F.broadcast(mean.select("chrom", (F.col("mass") / F.col("size")).alias("cut"))), "chrom").where("cov >= cut")
    else:
        runs = cov.where(F.col("cov") >= cutoff)
    out = intervals.islands(runs, max(join, 2))
    return out.where(F.col("end") - F.col("start") >= least).select("chrom", "start", "end")


#: Up to so many rows of a likelihood model (32 MB) are broadcast; more are joined by shuffling.
BROADCAST_DEPTHS = 1_000_000
#: A core gap of so many positions splits a flexible region; how far the two cutoffs lie from the mean's quantile.
SPLIT, SHIFT = 50, 0.2


def flexible_cutoffs(cov: DataFrame, sizes: DataFrame) -> DataFrame:
    """chrom, lower, upper: the depths ``SHIFT`` below and above the quantile of the chromosome's rounded mean depth, over covered positions.

    All comes from the histogram of depths, which has a row for each chromosome and depth.
    """
    hist = cov.groupBy("chrom", "cov").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    whole = Window.partitionBy("chrom")
    hist = hist.withColumns({"upto": F.sum("n").over(whole.orderBy("cov").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole), "mass": F.sum(F.col("cov") * F.col("n")).over(whole)})
    goal = F.greatest(F.rint(F.col("mass") / F.col("size")), F.lit(1.0))
    hist = hist.join(F.broadcast(sizes), "chrom").withColumn("far", F.abs(F.col("cov") - goal))
    middle = ((F.col("upto") - F.col("n")) / F.col("all") + (F.col("upto") - 1) / F.col("all")) / 2
    at = hist.groupBy("chrom").agg(F.min_by(middle, F.struct("far", "cov")).alias("q"), F.first("all").alias("m"))
    at = at.select("chrom", "m", (F.greatest(F.col("q") - SHIFT, F.lit(0.0)) * (F.col("m") - 1)).alias("lo"), (F.least(F.col("q") + SHIFT, F.lit(1.0)) * (F.col("m") - 1)).alias("hi"))

    def value(place):
        return F.min(F.when(F.col("upto") > place, F.col("cov")))

    ranks = {f"{c}{k}": value(F.least(F.floor(c) + k, F.col("m") - 1)) for c in ("lo", "hi") for k in (0, 1)}
    got = hist.select("chrom", "cov", "upto").join(at, "chrom").groupBy("chrom", "lo", "hi").agg(*[v.alias(k) for k, v in ranks.items()])
    lower, upper = (F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(c) - F.floor(c)) for c in ("lo", "hi"))
    return got.select("chrom", lower.alias("lower"), upper.alias("upper"))


def ccf(cov: DataFrame, sizes: DataFrame, split: int = SPLIT) -> DataFrame:
    """Flexible coverage-cutoff universe: chrom, start, core_start, core_end, end.

    A run of positions at or above the lower cutoff is a region if some are above the upper one: its core.  Where core
    positions are ``split`` or more apart, the run is parted after the first least covered position between them.  Cores
    begin one later where they would begin with their region, and end one earlier where they would end with the run; a
    region whose core so begins where it ends is left out.
    """
    x = cov.join(F.broadcast(flexible_cutoffs(cov, sizes)), "chrom").where("cov >= lower").select("chrom", "start", "end", "cov", (F.col("cov") > F.col("upper")).alias("core"))
    order = Window.partitionBy("chrom", "island").orderBy("start")
    last = F.max(F.when(F.col("core"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col("core") & (last.isNull() | (F.col("start") - (last - 1) >= split)), 1).otherwise(0)
    x = intervals.numbered(x).withColumn("_o", opened).withColumn("part", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_until", F.max(F.when(F.col("core"), F.col("end"))).over(Window.partitionBy("chrom", "island", "part")))
    parts = x.groupBy("chrom", "island", "part").agg(
        F.min("start").alias("lo"),
        F.max("end").alias("hi"),
        F.min(F.when(F.col("core"), F.col("start"))).alias("first"),
        F.max(F.when(F.col("core"), F.col("end"))).alias("past"),
        F.min(F.when(F.col("start") >= F.col("_until"), F.struct("cov", "start")))["start"].alias("least"),
    )
    run, next_ = Window.partitionBy("chrom", "island"), Window.partitionBy("chrom", "island").orderBy("part")
    parts = parts.withColumns({"low": F.min("lo").over(run), "high": F.max("hi").over(run), "more": F.lead("part").over(next_).isNotNull(), "_was": F.when(F.lag("part").over(next_) > 0, F.lag("least").over(next_))})
    parts = parts.where("part > 0").withColumns({"start": F.coalesce(F.col("_was") + 1, F.col("low")), "end": F.when(F.col("more"), F.col("least") + 1).otherwise(F.col("high"))})
    core_start = F.col("first") + F.when(F.col("first") == F.col("start"), 1).otherwise(0)
    core_end = F.col("past") - 1 - F.when(F.col("past") == F.col("high"), 1).otherwise(0)
    return parts.select("chrom", "start", core_start.alias("core_start"), core_end.alias("core_end"), "end").where("core_start <> core_end")


def normalised_depth(cov: DataFrame, p: float) -> DataFrame:
    """chrom, cov, value: each depth of covered positions as the geometric quantile (success ``p``) of the middle of its share."""
    hist = cov.groupBy("chrom", "cov").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    whole = Window.partitionBy("chrom")  # a row for each depth
    middle = (F.sum("n").over(whole.orderBy("cov").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2) / F.sum("n").over(whole)
    return hist.select("chrom", "cov", (F.ceil(F.log(1 - middle) / F.log(F.lit(1 - p))) - 1).alias("value"))


def track_models(tracks: DataFrame, sizes: DataFrame, files: int) -> DataFrame:
    """``likelihood_model`` of the tracks start, core and end of rows (chrom, track, start, end, cov)."""
    one = F.concat_ws("|", "chrom", "track").alias("chrom")
    every = likelihood_model(tracks.select(one, "start", "end", "cov"), tracks.select("chrom", "track").distinct().join(F.broadcast(sizes), "chrom").select(one, "size"), files)
    return every.select(F.regexp_extract("chrom", r"^(.*)\|", 1).alias("chrom"), F.regexp_extract("chrom", r"\|(\w+)$", 1).alias("track"), "cov", "bg", "fg")


def _scored(rows: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """Rows with the columns of a written model or part of one, which is broadcast while it is small; the rows never are, whatever the size of their files."""
    return rows.join(F.broadcast(scores) if scores.count() <= BROADCAST_DEPTHS else scores.hint("merge"), list(keys))


def flexible_gains(tracks: DataFrame, model: DataFrame, universe: DataFrame) -> DataFrame:
    """chrom, uid, gain: what each region (uid, chrom, start, core_start, core_end, end) adds to the likelihood of background alone.

    Within the core the core track counts as peak; over the flanks its weight rises and falls linearly, and the start and
    the end track count as peak with the flank's share.  Weights are linear in the position, so a piece of constant depth
    has its sum in closed form; they are taken from places within the region, in whole numbers up to one division, so that no digits
    are lost far along a chromosome.  Chromosomes without a model add nothing.
    """
    n1, n2 = F.col("core_start") - F.col("start"), F.col("end") - F.col("core_end")
    whole = F.lit(1).cast("long")

    def part(track, low, high, n, rise):
        return F.struct(F.lit(track).alias("track"), F.col(low).alias("r_start"), F.col(high).alias("r_end"), F.nullif(n, F.lit(0).cast("long")).alias("of"), F.lit(rise).alias("rise"))

    # weights (position - start + 1) / n1, (end - position) / n2, and the same number throughout
    five = [
        part("core", "start", "core_start", n1, 1),
        part("core", "core_start", "core_end", whole, 0),
        part("core", "core_end", "end", n2, -1),
        part("start", "start", "core_start", n1, 0),
        part("end", "core_end", "end", n2, 0),
    ]
    parts = universe.select("uid", "chrom", F.explode(F.array(*five)).alias("p")).select("uid", "chrom", "p.*").where("r_start < r_end")
    model = cut(model)
    none = model.where("cov = 0").select("chrom", "track", (F.col("fg") - F.col("bg")).alias("v0"))
    more = _scored(model, none, "chrom", "track").select("chrom", "track", "cov", (F.col("fg") - F.col("bg") - F.col("v0")).alias("more"))
    key = F.concat_ws("|", "chrom", "track").alias("chrom")
    pieces = _scored(tracks, more, "chrom", "track", "cov").select(key, "start", "end", "more")

    def weight(low, high):
        up, down = (low - F.col("r_start")) + (high - F.col("r_start")) + 1, (F.col("r_end") - low) + (F.col("r_end") - high) + 1
        return (high - low) * F.when(F.col("rise") > 0, up).when(F.col("rise") < 0, down).otherwise(2) / (2 * F.col("of"))

    met = intervals.interval_join(pieces, parts.select(key, F.col("chrom").alias("name"), "uid", "r_start", "r_end", "of", "rise"), rows=tracks.count() + parts.count())
    met = met.select(F.col("name").alias("chrom"), "uid", (weight(F.greatest("start", "r_start"), F.least("end", "r_end")) * F.col("more")).alias("x"))
    flat = _scored(parts, none, "chrom", "track").select("chrom", "uid", (weight(F.col("r_start"), F.col("r_end")) * F.col("v0")).alias("x"))
    return flat.unionByName(met).groupBy("chrom", "uid").agg(F.sum("x").alias("gain"))


def flexible_likelihood(tracks: DataFrame, sizes: DataFrame, model: DataFrame, universe: DataFrame) -> DataFrame:
    """Per chromosome the log-likelihood of the three tracks, given the flexible universe."""
    width = F.col("end") - F.col("start")
    model = cut(model)  # a row for each depth of a chromosome's tracks, so it grows with the files
    held = _scored(tracks, model, "chrom", "track", "cov").groupBy("chrom", "track").agg(F.sum(width * F.col("bg")).alias("held"), F.sum(width).alias("covered"))
    zero = model.where("cov = 0").select("chrom", "track", F.col("bg").alias("bg0"))
    ground = held.join(zero, ["chrom", "track"]).join(F.broadcast(sizes), "chrom").groupBy("chrom").agg(F.sum(F.col("held") + (F.col("size") - F.col("covered")) * F.col("bg0")).alias("ground"))
    gains = flexible_gains(tracks, model, universe).groupBy("chrom").agg(F.sum("gain").alias("gain"))
    return ground.join(gains, "chrom", "left").select("chrom", (F.col("ground") + F.coalesce("gain", F.lit(0.0))).alias("likelihood"))


def is_flexible(columns: int) -> bool:
    """Whether a BED file with so many columns holds a flexible universe: its core is in columns 7 and 8."""
    return columns >= 8


def likelihood_model(cov: DataFrame, sizes: DataFrame, files: int) -> DataFrame:
    """chrom, cov, bg, fg: log10 probabilities of each depth outside and inside peaks; depth 0 included."""
    width = F.col("end") - F.col("start")
    mass = cov.groupBy("chrom").agg(F.sum(F.col("cov") * width).alias("c"))
    depths = cov.select("chrom", "cov").distinct().unionByName(cov.select("chrom", F.lit(0).cast("long").alias("cov")).distinct())
    d = depths.join(F.broadcast(mass.join(sizes, "chrom")), "chrom")
    bg = F.log10((F.lit(files) - F.col("cov")) / (F.lit(files) * F.col("size") - F.col("c")) + 1e-10)
    return d.select("chrom", "cov", bg.alias("bg"), F.log10(F.col("cov") / F.col("c") + 1e-10).alias("fg"))


def hard_likelihood(cov: DataFrame, sizes: DataFrame, model: DataFrame, universe: DataFrame) -> DataFrame:
    """Per chromosome the log-likelihood of the coverage, given that the disjoint universe is what is covered.

    All positions count as background, and those of the universe's regions get the difference.
    """
    width = F.col("end") - F.col("start")
    model = cut(model)  # a row for each depth of a chromosome, so it grows with the files
    known = _scored(cov, model, "chrom", "cov")
    ground = known.groupBy("chrom").agg(F.sum(width * F.col("bg")).alias("held"), F.sum(width).alias("covered"))
    zero = model.where("cov = 0").select("chrom", F.col("bg").alias("bg0"), F.col("fg").alias("fg0"))
    right = universe.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    common = F.least("end", "r_end") - F.greatest("start", "r_start")
    inside = intervals.interval_join(known, right).groupBy("chrom").agg(F.sum(common * (F.col("fg") - F.col("bg"))).alias("gain"), F.sum(common).alias("met"))
    bp = universe.groupBy("chrom").agg(F.sum(width).alias("u"))
    all_ = ground.join(zero, "chrom").join(sizes, "chrom").join(inside, "chrom", "left").join(bp, "chrom", "left").fillna(0, ["gain", "met", "u"])
    rest = (F.col("size") - F.col("covered")) * F.col("bg0") + (F.col("u") - F.col("met")) * (F.col("fg0") - F.col("bg0"))
    return all_.select("chrom", (F.col("held") + rest + F.col("gain")).alias("likelihood"))


def track_likelihood(tracks: DataFrame, sizes: DataFrame, model: DataFrame, universe: DataFrame) -> DataFrame:
    """Per chromosome the log-likelihood of the three tracks, given a hard universe: its rows for the core, their first position for the starts, the position after them for the ends."""
    key = F.concat_ws("|", "chrom", "track").alias("chrom")
    spans = {"core": ("start", "end"), "start": ("start", F.col("start") + 1), "end": ("end", F.col("end") + 1)}
    parts = F.array(*[F.struct(F.lit(t).alias("track"), F.col(a).alias("start"), (F.col(b) if isinstance(b, str) else b).alias("end")) for t, (a, b) in spans.items()])
    inside = universe.select("chrom", F.explode(parts).alias("p")).select("chrom", "p.*").select(key, "start", "end")
    every = sizes.crossJoin(tracks.sparkSession.createDataFrame([(t,) for t in spans], "track string")).select(key, "size")  # three rows a chromosome
    out = hard_likelihood(tracks.select(key, "start", "end", "cov"), every, model.select(key, "cov", "bg", "fg"), inside)
    return out.groupBy(F.regexp_extract("chrom", r"^(.*)\|", 1).alias("chrom")).agg(F.sum("likelihood").alias("likelihood"))


def likelihood(tracks: DataFrame, sizes: DataFrame, files: int, universe: DataFrame) -> DataFrame:
    """Per chromosome the log-likelihood of the tracks of so many files, given a universe; one with core_start is flexible."""
    model = track_models(tracks, sizes, files)
    return (flexible_likelihood if "core_start" in universe.columns else track_likelihood)(tracks, sizes, model, universe)


def assessment(regions: DataFrame, universe: DataFrame, by: str = "bed_id") -> DataFrame:
    """One row per file: base pairs, both median distances, F10 and the region boundary score.

    The files are merged once and written; every metric reads that.
    """
    merged = cut(intervals.merge(regions, by))
    to = intervals.boundary_distances(regions, universe, by, merged).withColumnRenamed("median_distance", "to_universe")
    back = intervals.universe_distances(regions, universe, by, merged).withColumnRenamed("median_distance", "from_universe")
    out = intervals.overlap_bp(regions, universe, by, merged).join(to, by).join(back, by)
    return out.withColumns({"f10": f_beta(F.col("overlap"), F.col("only_file"), F.col("only_universe")), "rbs": rbs(F.col("to_universe"), F.col("from_universe"))})


def mean_scores(assessed: DataFrame) -> DataFrame:
    """The means over files of the region boundary score and F10."""
    return assessed.agg(F.avg("rbs").alias("rbs"), F.avg("f10").alias("f10"))


#: Positions of a segment that one task reduces or decodes.
STRETCH = 1 << 17
TRACKS = ("start", "core", "end")


def in_segments(tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (chrom, first, past, track, start, end, ...) of the tracks' runs within each segment (chrom, start, end)."""
    right = segments.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = intervals.interval_join(tracks, right)
    rest = [c for c in tracks.columns if c not in ("chrom", "start", "end")]
    return met.select("chrom", F.col("r_start").alias("first"), F.col("r_end").alias("past"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), *rest)


REGION = "chrom string, start long, core_start long, core_end long, end long, top long"
_STRETCHES = ["chrom", "first", "stretch"]


def _in_stretches(rows: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """Rows (chrom, first, ...) once for each stretch of ``size`` positions that they reach into, and a row without a track for each stretch of each segment."""
    at = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)))
    low, high = F.col("stretch") * size, (F.col("stretch") + 1) * size

    def cut_up(x: DataFrame) -> DataFrame:
        return x.where("start < end").withColumn("stretch", at).withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})

    return cut_up(rows.drop("past")).unionByName(cut_up(segments.withColumn("first", F.col("start"))), allowMissingColumns=True)


def _runs(pdf: pd.DataFrame, values: list[str], empty: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The bounds of a stretch's runs of equal values on all tracks, the segment's first position a run of its own, and for each value an array (runs x tracks), ``empty`` where a track has none."""
    whole, rows = pdf[pdf["track"].isna()].iloc[0], pdf[pdf["track"].notna()]
    low, high = int(whole["start"]), int(whole["end"])
    first = [low + 1] if low == whole["first"] and high > low + 1 else []
    bounds = np.unique(np.concatenate(([low, high, *first], rows["start"], rows["end"])).astype(np.int64))
    out = {v: np.tile(np.asarray(empty[v], float), (len(bounds) - 1, 1)) for v in values}
    for k, track in enumerate(TRACKS):
        own = rows[rows["track"] == track].sort_values("start")
        start, end = own["start"].to_numpy(np.int64), own["end"].to_numpy(np.int64)
        at = np.searchsorted(start, bounds[:-1], "right") - 1
        inside = (at >= 0) & (bounds[:-1] < end[at]) if len(own) else np.zeros(len(at), bool)
        for v in values:
            out[v][inside, k] = own[v].to_numpy(float)[at[inside]]
    return bounds, out


def best_regions(rows: DataFrame, segments: DataFrame, scores, moves: np.ndarray, prefers: np.ndarray, begin: np.ndarray, stretch: int = STRETCH) -> DataFrame:
    """Flexible regions (chrom, start, core_start, core_end, end, top) of the best paths through the states start, core, end and background.

    ``scores`` makes of a stretch's rows (chrom, first, track, start, end, cov, ...; the one without a track stands for the stretch)
    the bounds of its runs, their scores (runs x states) and core depths.  ``moves`` (from x to) score moves between positions, ``prefers`` ranks
    the states before for each state where they tie, ``begin`` scores a segment's first state.  Stretches reduce to matrices in
    parallel, a segment's few matrices tell the states at the ends of stretches, and stretches are then decoded in
    parallel.  A region is a maximal run of other states than background that holds a core and an end, across stretches.
    """
    prepare(rows.sparkSession)
    held = cut(_in_stretches(rows, segments, stretch))
    alone = np.where(np.eye(paths.STATES, dtype=bool), 0, paths.NEVER)

    def steps(pdf: pd.DataFrame) -> tuple[np.ndarray, paths.Steps, paths.Steps, np.ndarray]:
        bounds, score, core = scores(pdf)
        score = paths.whole(score)
        single = paths.Steps.single(moves, prefers, score)
        if bounds[0] == pdf["first"].iloc[0]:  # no move leads to a segment's first position
            single.put(slice(0, 1), paths.Steps.single(alone, prefers, score[:1]))
        size = np.diff(bounds)
        return bounds, single, paths.powers(single, size, *paths.alike(single.score, size)), core

    def reduced(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = paths.product(steps(pdf)[2])
        return pd.DataFrame([(*key, one.score.tobytes(), one.rank.tobytes())], columns=[*_STRETCHES, "score", "rank"])

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        shape = (1, paths.STATES, paths.STATES)
        every = [paths.Steps(np.frombuffer(x, np.int64).reshape(shape), np.frombuffer(r, np.int8).reshape(shape)) for x, r in zip(pdf["score"], pdf["rank"], strict=True)]
        ends = paths.chain(every, begin)
        return pdf[_STRETCHES].assign(came=[a for a, _ in ends], left=[b for _, b in ends])

    def pieces(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bounds, single, runs, core = steps(pdf)
        at, size, state = paths.decoded(single, np.diff(bounds), runs, int(pdf["came"].iloc[0]), int(pdf["left"].iloc[0]))
        start, end = bounds[0] + at, bounds[0] + at + size
        lo, hi = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, end, "left")
        top = np.maximum.reduceat(np.append(core, 0), np.stack((lo, hi), 1).ravel())[::2].astype(np.int64)
        # pieces of one state that touch are handed on as one
        opens = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        start, end, state, top = start[opens], end[np.append(opens[1:], len(end)) - 1], state[opens], np.maximum.reduceat(top, opens)
        some = state != 3
        return pd.DataFrame({"chrom": key[0], "first": key[1], "start": start[some], "end": end[some], "state": state[some], "top": top[some]})

    matrices = cut(held.groupBy(*_STRETCHES).applyInPandas(reduced, "chrom string, first long, stretch long, score binary, rank binary"))
    ends = cut(matrices.groupBy("chrom", "first").applyInPandas(linked, "chrom string, first long, stretch long, came int, left int"))
    found = held.join(ends, _STRETCHES).groupBy(*_STRETCHES).applyInPandas(pieces, "chrom string, first long, start long, end long, state int, top long")
    # segments stand apart, whatever touches
    found = cut(found.select(F.concat_ws("|", "chrom", "first").alias("chrom"), F.col("chrom").alias("name"), "start", "end", "state", "top"))
    region = intervals.numbered(found).groupBy("chrom", "island").agg(
        F.first("name").alias("name"), F.min("start").alias("start"), F.min(F.when(F.col("state") == 1, F.col("start"))).alias("core_start"), F.min(F.when(F.col("state") == 2, F.col("start"))).alias("core_end"), F.max("end").alias("end"), F.max("top").alias("top")
    )
    return region.where("core_start is not null and core_end is not null").select(F.col("name").alias("chrom"), "start", "core_start", "core_end", "end", "top")


#: Moves of the likelihood's paths: to stay, or on to the next state; ties stay.
ON = np.array([[0 if b in (a, (a + 1) % 4) else paths.NEVER for b in range(4)] for a in range(4)])
STAY_FIRST = np.array([[(b - a) % 4 for b in range(4)] for a in range(4)])


def maximum_likelihood(tracks: DataFrame, segments: DataFrame, model: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Flexible regions (chrom, start, core_start, core_end, end, top) by dynamic programming within segments of any length.

    Every position scores as start, core, end or background by the three tracks' models (chrom, track, cov, bg, fg); what
    lies outside segments is background.
    """
    zero = model.where("cov = 0").groupBy("chrom").pivot("track", list(TRACKS)).agg(F.first("fg").alias("fg"), F.first("bg").alias("bg"))
    rows = in_segments(tracks.join(model, ["chrom", "track", "cov"]), segments)

    def scores(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = pdf[pdf["track"].isna()].iloc[0]
        bounds, x = _runs(pdf, ["fg", "bg", "cov"], {v: own[[f"{t}_{v}" for t in TRACKS]].to_numpy(float) for v in ("fg", "bg")} | {"cov": np.zeros(3)})
        return bounds, np.stack([sum((x["fg"] if t == k else x["bg"])[:, t] for t in range(3)) for k in range(4)], 1), x["cov"][:, 1]

    known = segments.select("chrom", "start", "end").join(F.broadcast(zero), "chrom")  # a row a chromosome
    return best_regions(rows, known, scores, ON, STAY_FIRST, np.zeros(4, np.int64), stretch)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    u, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in u.tolist()])[back].reshape(x.shape)


def poisson(x: np.ndarray, rate: float) -> np.ndarray:
    return x * np.log(rate) - rate - _log_gamma(x + 1)


def gaussian(x: np.ndarray, mean: float, variance: float) -> np.ndarray:
    return -((x - mean) ** 2 / variance + np.log(2 * np.pi * variance)) / 2


def negative_binomial(x: np.ndarray, n: float, p: float) -> np.ndarray:
    return _log_gamma(x + n) - _log_gamma(x + 1) - math.lgamma(n) + n * np.log(p) + x * np.log1p(-p)


def beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Of values in (0, 1); others are moved just inside."""
    x = np.clip(x, 1e-9, 1 - 1e-9)
    return (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


FAMILIES = {"poisson": poisson, "gaussian": gaussian, "negative_binomial": negative_binomial, "beta": beta}
# fixed values of the four-state model: rates of the start, core and end track in each state, moves between states, first state
RATES = [[5, 3, 0.0001], [0.05, 5, 0.05], [0.0001, 3, 5], [0.0001, 0.001, 0.0001]]
MOVES = [[1 - 1e-10, 1e-10, 0, 0], [0, 1 - 1e-6, 1e-6, 0], [0, 0, 1 - 1e-10, 1e-10], [0.1, 0, 0, 0.9]]
BEGIN = [0.01, 0.01, 0.97, 0.01]
#: Success probabilities of the geometric quantiles that depths become.
NORMAL = {"start": 0.1, "core": 0.2, "end": 0.1}


def normalised_tracks(tracks: DataFrame) -> DataFrame:
    """The tracks with ``value``, each depth's geometric quantile within its chromosome and track."""
    parts = []
    for t, p in NORMAL.items():
        own = tracks.where(F.col("track") == t)
        parts.append(own.join(normalised_depth(own, p), ["chrom", "cov"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hidden_states(tracks: DataFrame, segments: DataFrame, *, family: str = "poisson", parameters: list[list] | None = None, moves: list[list[float]] = MOVES, begin: list[float] = BEGIN, value: str = "value", stretch: int = STRETCH) -> DataFrame:
    """Flexible regions (chrom, start, core_start, core_end, end, top) from the likeliest states of a hidden Markov model.

    ``parameters`` are those of each state's and track's emission (a number or a tuple), by default Poisson rates.  The
    model is decoded anew in each segment, of any length; of states that tie the first comes.  What lies outside segments is
    background.
    """
    parameters = parameters or RATES
    density = FAMILIES[family]
    rows = in_segments(tracks, segments)

    def scores(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = list(dict.fromkeys([value, "cov"]))
        bounds, x = _runs(pdf, names, dict.fromkeys(names, np.zeros(3)))
        return bounds, np.stack([sum(density(x[value][:, t], *np.atleast_1d(of[t]).tolist()) for t in range(3)) for of in parameters], 1), x["cov"][:, 1]

    with np.errstate(divide="ignore"):
        step, first = paths.whole(np.log(np.array(moves, float))), paths.whole(np.log(np.array(begin, float)))
    return best_regions(rows, segments.select("chrom", "start", "end"), scores, step, np.tile(np.arange(4)[:, None], (1, 4)), first, stretch)


def filter_universe(universe: DataFrame, least_size: int = 0, least_score: float | None = None, least_likelihood: float | None = None) -> DataFrame:
    """Rows strictly above the given size, score and likelihood."""
    keep = F.col("end") - F.col("start") > least_size
    if least_score is not None:
        keep = keep & (F.col("score") > least_score)
    if least_likelihood is not None:
        keep = keep & (F.col("likelihood") > least_likelihood)
    return universe.where(keep)
