"""Flexible universes, spans and drawn rows against brute force over single positions."""

import random

import numpy as np
from pyspark.sql import functions as F

from intervale.operators import intervals, perturb, universe


def test_distances_to_and_from_spans_across_buckets(spark):
    rng = random.Random(8)
    spans = [(lo, lo + rng.choice([0, 3, 150])) for lo in (rng.randint(0, 2000) for _ in range(25))]
    points = [rng.randint(0, 2300) for _ in range(90)]
    ss = spark.createDataFrame([("chr1", a, b) for a, b in spans], "chrom string, lo long, hi long")
    ps = spark.createDataFrame([("chr1", p) for p in points] + [("chr2", 5)], "chrom string, pos long")

    def far(p, a, b):
        return max(a - p, p - b, 0)

    got = sorted((r["pos"], r["distance"]) for r in intervals.nearest_span(ps, ss, bucket=64).collect())
    assert got == sorted((p, min(far(p, a, b) for a, b in spans)) for p in points)
    got = sorted((r["lo"], r["hi"], r["distance"]) for r in intervals.span_to_nearest(ss, ps, bucket=64).collect())
    assert got == sorted((a, b, min(far(p, a, b) for p in points)) for a, b in spans)
    got = sorted((r["lo"], r["hi"], r["distance"]) for r in intervals.span_to_nearest(ss, spark.createDataFrame([("chr1", 5)], "chrom string, pos long"), bucket=64).collect())
    assert got == sorted((a, b, far(5, a, b)) for a, b in spans)
    late = spark.createDataFrame([("chr1", 2200)], "chrom string, pos long")
    got = sorted((r["lo"], r["hi"], r["distance"]) for r in intervals.span_to_nearest(ss, late, bucket=64).collect())
    assert got == sorted((a, b, far(2200, a, b)) for a, b in spans)


def test_islands_across_buckets(spark):
    rng = random.Random(9)
    at, runs = 0, []
    for _ in range(120):
        at += rng.choice([0, 0, 2, 9, 40])
        runs.append(("chr1", at, at := at + rng.randint(1, 90), rng.randint(1, 5)))
    frame = spark.createDataFrame(runs, "chrom string, start long, end long, cov long")
    want, gap = [], 10
    for _, a, b, c in runs:
        if want and a - (want[-1][1] - 1) < gap:
            want[-1] = (want[-1][0], b, max(want[-1][2], c))
        else:
            want.append((a, b, c))
    assert sorted((r["start"], r["end"], r["top"]) for r in intervals.islands(frame, gap, bucket=64).collect()) == want


def flexible_by_position(track):
    """Cutoffs from quantiles of all covered positions, regions from a walk over positions."""
    some = np.sort(track[track > 0])
    goal = max(1, np.round(track.mean()))
    depths = np.unique(some)
    goal = depths[np.abs(depths - goal).argmin()]
    places = np.flatnonzero(some == goal)
    q = (places[0] + places[-1]) / 2 / len(some)
    lower, upper = np.quantile(some, max(0, q - 0.2)), np.quantile(some, min(1, q + 0.2))
    out, inside, i = [], track >= lower, 0
    while i < len(track):
        j = i
        while j < len(track) and inside[j]:
            j += 1
        cores = [p for p in range(i, j) if track[p] > upper]
        groups = []
        for p in cores:
            if groups and p - groups[-1][-1] < 50:
                groups[-1].append(p)
            else:
                groups.append([p])
        start = i
        for k, g in enumerate(groups):
            end = j
            if k + 1 < len(groups):
                end = min(range(g[-1], groups[k + 1][0]), key=lambda p: (track[p], p)) + 1
            a, b = g[0] + (g[0] == start), g[-1] - (g[-1] == j - 1)
            if a != b:
                out.append((start, a, b, end))
            start = end
        i = max(j, i + 1)
    return (lower, upper), out


def test_flexible_cutoff_universe(spark):
    for seed in range(4):
        rng = random.Random(seed)
        track = np.zeros(4000, int)
        for _ in range(60):
            a = rng.randint(0, 3900)
            track[a : a + rng.randint(1, 260)] += rng.randint(1, 3)
        cuts = [0, *(np.flatnonzero(np.diff(track)) + 1).tolist(), len(track)]
        rows = [("chr1", a, b, int(track[a])) for a, b in zip(cuts, cuts[1:]) if track[a]]
        cov = spark.createDataFrame(rows, "chrom string, start long, end long, cov long")
        sizes = spark.createDataFrame([("chr1", len(track))], "chrom string, size long")
        want_cuts, want = flexible_by_position(track)
        got = universe.flexible_cutoffs(cov, sizes).first()
        assert np.allclose((got["lower"], got["upper"]), want_cuts)
        assert sorted((r["start"], r["core_start"], r["core_end"], r["end"]) for r in universe.ccf(cov, sizes).collect()) == want and want


def test_rows_drawn_from_those_that_overlap(spark):
    bed = spark.createDataFrame([(i, "chr1", 100 * i, 100 * i + 50, "-") for i in range(20)], "row_idx long, chrom string, start long, end long, mod string")
    other = spark.createDataFrame([("chr1", 0, 310)], "chrom string, start long, end long")
    sizes = spark.createDataFrame([("chr1", 100000)], "chrom string, size long")
    left = {r["row_idx"] for r in perturb.drop_from_file(bed, other, 0.1, 1).collect()}
    assert len(left) == 18 and set(range(4, 20)) <= left
    assert {r["row_idx"] for r in perturb.drop_from_file(bed, other, 0.9, 1).collect()} == set(range(4, 20))
    moved = perturb.shift_from_file(bed, sizes, other, 0.9, 5000.0, 1.0, 1).where(F.col("mod") == "S").collect()
    assert {r["row_idx"] for r in moved} == set(range(4))


def test_gains_lose_no_digits_far_along_a_chromosome(spark):
    far = 4_000_000_000
    model = spark.createDataFrame([("chr1", t, c, -0.7 * c - 0.1, 0.3 * c - 0.9) for t in universe.TRACKS for c in (0, 1, 2)], "chrom string, track string, cov long, bg double, fg double")
    runs = [("core", 3, 9, 1), ("core", 9, 25, 2), ("start", 4, 6, 1), ("end", 28, 33, 2)]
    tracks = spark.createDataFrame([("chr1", t, at + a, at + b, c) for at in (0, far) for t, a, b, c in runs], "chrom string, track string, start long, end long, cov long")
    regions = spark.createDataFrame([(k, "chr1", at, at + 7, at + 22, at + 33) for k, at in enumerate((0, far))], "uid long, chrom string, start long, core_start long, core_end long, end long")
    near, away = (r["gain"] for r in universe.flexible_gains(tracks, model, regions).orderBy("uid").collect())
    depth = {t: [next((c for k, a, b, c in runs if k == t and a <= p < b), 0) for p in range(33)] for t in universe.TRACKS}
    weigh = {"core": lambda p: (p + 1) / 7 if p < 7 else 1 if p < 22 else (33 - p) / 11, "start": lambda p: 1 / 7 if p < 7 else 0, "end": lambda p: 1 / 11 if p >= 22 else 0}
    want = sum(weigh[t](p) * (1.0 * depth[t][p] - 0.8) for t in universe.TRACKS for p in range(33))
    assert abs(near - want) < 1e-11 and abs(away - want) < 1e-11


def test_marked_rows_are_those_drawn_and_no_join_finds_them(spark):
    bed = spark.createDataFrame([(i, "chr1", i * 10, i * 10 + 5, "-") for i in range(300)], "row_idx long, chrom string, start long, end long, mod string")
    for rate in (0.0, 0.003, 0.37, 1.0):
        got = {r["row_idx"] for r in perturb.marked(bed, rate, 7, "drop").where("_d").collect()}
        assert got == {r["row_idx"] for r in perturb.drawn(bed, rate, 7, "drop").collect()} and len(got) == int(300 * rate)
    assert "Join" not in perturb.drop(bed, 0.3, 7)._jdf.queryExecution().optimizedPlan().toString()


def test_gains_broadcast_no_universe(spark):
    tracks = spark.createDataFrame([("chr1", "core", 0, 500, 2), ("chr1", "start", 0, 1, 1), ("chr1", "end", 500, 501, 1)], "chrom string, track string, start long, end long, cov long")
    model = universe.track_models(tracks, spark.createDataFrame([("chr1", 60_000)], "chrom string, size long"), 8)
    at = F.col("id") * 40
    regions = spark.range(1000).select(F.col("id").alias("uid"), F.lit("chr1").alias("chrom"), at.alias("start"), (at + 5).alias("core_start"), (at + 20).alias("core_end"), (at + 25).alias("end"))
    lines = universe.flexible_gains(tracks, model, regions)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    sent = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    assert sent
    for i in sent:
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any("Range (" in x for x in lines[i:below])
