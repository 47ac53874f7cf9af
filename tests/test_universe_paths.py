"""The sequential universes against plain loops over dense tracks, and the forms of segments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.operators import intervals, paths, universe
from intervale.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(spark):
    size = {r["chrom"]: r["size"] for r in catalogue.sizes(spark, D).collect()}
    merged, depth = {}, {c: np.zeros((n + 1000, 3), int) for c, n in size.items()}
    for r in sorted((r["bed_id"], r["chrom"], r["start"], r["end"]) for r in catalogue.regions(spark, D).collect()):
        own = merged.setdefault(r[:2], [])
        if own and r[2] <= own[-1][1]:
            own[-1][1] = max(own[-1][1], r[3])
        else:
            own.append(list(r[2:]))
    for (_, c), own in merged.items():
        for a, b in own:
            depth[c][a, 0] += 1
            depth[c][a:b, 1] += 1
            depth[c][b, 2] += 1
    return size, depth


def segments(x, size, few=(1000, 500), many=(10000, 1000)):
    """Position by position: clusters of covered positions, or what long empty stretches leave."""
    full = x[:size].any(1)
    if full.sum() < size - full.sum():
        at, (gap, area) = np.flatnonzero(full), few
        cut = np.flatnonzero(np.diff(at) > gap)
        first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
        out = [(a - area, b + area) for a, b in zip(first, last)]
        out[0] = (0 if first[0] <= gap else out[0][0], out[0][1])
        out[-1] = (out[-1][0], min(out[-1][1], size))
        return out
    gap, area = many
    runs, i = [], 0
    while i < size:
        j = i
        while j < size and not full[j]:
            j += 1
        if j > i and j < size:
            runs.append((i, j))
        i = max(j, i + 1)
    kept = [r for k, r in enumerate(runs) if not k or r[1] - r[0] >= gap]
    if not kept:
        return [(0, size)]
    return [(max(0, r[1] - 1 - area), n[0] + area if n else size) for r, n in zip(kept, [*kept[1:], None])]


def regions_of(path, first):
    path, out, i = [*path, 3], set(), 0
    while i < len(path) - 1:
        j = i
        while path[j] != 3:
            j += 1
        if 1 in path[i:j] and 2 in path[i:j]:
            out.add((first + i, first + path.index(1, i), first + path.index(2, i), first + j))
        i = max(j, i) + 1
    return out


def found(frame):
    return {(r["chrom"], r["start"], r["core_start"], r["core_end"], r["end"]) for r in frame.collect()}


def test_universe_ml(spark, dense):
    want = set()
    for c, x in dense[1].items():
        mass, n = x.sum(0), dense[0][c]
        bg, fg = np.log10((8 - x) / (8 * n - mass) + 1e-10), np.log10(x / mass + 1e-10)
        for a, b in segments(x, n):
            m = np.stack([sum((fg if t == k else bg)[a:b, t] for t in range(3)) for k in range(4)], 1)
            for i in range(1, len(m)):
                m[i] += [max(m[i - 1, j], m[i - 1, j - 1]) for j in range(4)]
            path = [int(m[-1].argmax())]
            for i in range(len(m) - 2, -1, -1):
                k = path[-1]
                path.append((k - (m[i, k - 1] > m[i, k])) % 4)
            want |= {(c, *r) for r in regions_of(path[::-1], a)}
    got = catalogue.queries()["universe_ml"](spark, D)
    assert want and found(got) == want
    for r in got.collect():
        assert r["top"] == dense[1][r["chrom"]][r["start"] : r["end"], 1].max()


def test_universe_hmm(spark, dense):
    want = set()
    with np.errstate(divide="ignore"):
        step, begin = np.log(universe.MOVES), np.log(universe.BEGIN)
    for c, x in dense[1].items():
        y = x.astype(float)
        for t, p in enumerate((0.1, 0.2, 0.1)):
            some = np.sort(x[x[:, t] > 0, t])
            for v in np.unique(some):
                m = (some < v).mean() + (some == v).mean() / 2
                y[x[:, t] == v, t] = math.ceil(math.log(1 - m) / math.log(1 - p)) - 1
        for a, b in segments(x, dense[0][c]):
            emitted = [[sum(v * math.log(r) - r - math.lgamma(v + 1) for v, r in zip(row, rates)) for rates in universe.RATES] for row in y[a:b].tolist()]
            best, back = begin + emitted[0], []
            for e in emitted[1:]:
                every = best[:, None] + step
                back.append(every.argmax(0))
                best = every.max(0) + e
            path = [int(best.argmax())]
            for came in reversed(back):
                path.append(int(came[path[-1]]))
            want |= {(c, *r) for r in regions_of(path[::-1], a)}
    assert found(catalogue.queries()["universe_hmm"](spark, D)) == want


def test_emission_families(spark):
    x = np.array([0.0, 1.0, 4.0])
    assert np.allclose(universe.poisson(x, 2.0), [-2, math.log(2) - 2, 4 * math.log(2) - 2 - math.log(24)])
    assert np.allclose(np.exp(universe.gaussian(x, 1.0, 4.0)), np.exp(-((x - 1) ** 2) / 8) / math.sqrt(8 * math.pi))
    assert np.allclose(np.exp(universe.negative_binomial(x, 1.0, 0.3)), 0.3 * 0.7**x)
    assert np.allclose(universe.beta(np.array([0.25]), 2.0, 3.0), math.log(12 * 0.25 * 0.75**2))
    tracks = spark.createDataFrame([("c", t, 40, 60, 5) for t in universe.TRACKS], "chrom string, track string, start long, end long, cov long")
    near = spark.createDataFrame([("c", 0, 100)], "chrom string, start long, end long")
    means = [[(5, 1), (0, 1), (0, 1)], [(5, 1), (5, 1), (5, 1)], [(0, 1), (0, 1), (5, 1)], [(0, 1), (0, 1), (0, 1)]]
    got = universe.hidden_states(tracks, near, family="gaussian", parameters=means, moves=[[0.8, 0.2, 0, 0], [0, 0.9, 0.1, 0], [0, 0, 0.5, 0.5], [0.1, 0, 0, 0.9]], value="cov")
    assert found(got) and all(38 <= r[1] <= 41 and r[4] >= 60 for r in found(got))


def plain_path(score, moves, prefers, begin):
    """A loop over positions, on whole numbers."""
    on, v = [begin], begin
    for s in score:
        v = np.maximum((v[:, None] + moves).max(0) + s, paths.NEVER)
        on.append(v)
    k, path = int(v.argmax()), []
    for before in on[-2::-1]:
        path.append(k)
        every = np.maximum(before + moves[:, k], paths.NEVER)
        k = min(np.flatnonzero(every == every.max()).tolist(), key=lambda q: prefers[q, k])
    return path[::-1]


@pytest.mark.parametrize("kind", ["ties", "real"])
@pytest.mark.parametrize("model", ["likelihood", "hidden"])
def test_matrices_choose_as_a_loop_does(kind, model):
    rng = np.random.default_rng(5)
    for _ in range(60):
        if model == "likelihood":
            moves, prefers, begin = universe.ON, universe.STAY_FIRST, np.zeros(4, np.int64)
        else:
            moves, prefers, begin = paths.whole(np.log(rng.random((4, 4)))), np.tile(np.arange(4)[:, None], (1, 4)), paths.whole(np.log(rng.random(4)))
        n = int(rng.integers(1, 30))
        values = rng.integers(-2, 1, (n, 4)).astype(float) if kind == "ties" else rng.normal(0, 2, (n, 4))
        length = rng.integers(1, 12, n)
        score = np.repeat(paths.whole(values - values.max(1, keepdims=True)), length, 0)
        single = paths.Steps.single(moves, prefers, paths.whole(values))
        runs = paths.power(single, length)
        ends = [0, *sorted(rng.integers(0, n + 1, 2).tolist()), n]
        parts = [(i, j) for i, j in zip(ends, ends[1:]) if i < j]
        got = []
        for (i, j), (came, left) in zip(parts, paths.chain([paths.product(runs[i:j]) for i, j in parts], begin)):
            at, size, state = paths.decoded(single[i:j], length[i:j], runs[i:j], came, left)
            assert at.tolist() == (np.cumsum(size) - size).tolist() and size.sum() == length[i:j].sum()
            got += np.repeat(state, size).tolist()
        assert got == plain_path(score, moves, prefers, begin)


@pytest.mark.parametrize("stretch", [7, 1000, 1 << 17])
def test_universes_do_not_depend_on_stretches(spark, stretch):
    rng = np.random.default_rng(3)
    depth, size = np.zeros((3, 6000), int), 6000
    for a in rng.integers(0, 5800, 150).tolist():
        b = a + int(rng.integers(20, 120))
        depth[0, a : a + 5] += 1
        depth[1, a:b] += 1
        depth[2, b - 5 : b] += 1
    depth[:, 3000:3200] = 0
    rows = []
    for track, own in zip(universe.TRACKS, depth):
        at = np.flatnonzero(np.diff(own, prepend=-1))
        rows += [("c", track, int(a), int(b), int(own[a])) for a, b in zip(at, np.append(at[1:], size)) if own[a]]
    tracks = spark.createDataFrame(rows, "chrom string, track string, start long, end long, cov long")
    near = spark.createDataFrame([("c", 10, 3100), ("c", 3100, 5990)], "chrom string, start long, end long")
    with np.errstate(divide="ignore"):
        step, begin = paths.whole(np.log(universe.MOVES)), paths.whole(np.log(universe.BEGIN))
    want = set()
    for a, b in ((10, 3100), (3100, 5990)):
        emitted = paths.whole(np.stack([sum(universe.poisson(depth[t, a:b].astype(float), rates[t]) for t in range(3)) for rates in universe.RATES], 1))
        first = np.maximum(begin + emitted[0], paths.NEVER)
        v, on = first, [first]
        for s in emitted[1:]:
            v = np.maximum((v[:, None] + step).max(0) + s, paths.NEVER)
            on.append(v)
        k, path = int(v.argmax()), []
        for before in on[-2::-1]:
            path.append(k)
            k = int(np.maximum(before + step[:, k], paths.NEVER).argmax())
        path.append(k)
        want |= {("c", *r) for r in regions_of(path[::-1], a)}
    got = universe.hidden_states(tracks, near, value="cov", stretch=stretch)
    assert len(want) > 3 and found(got) == want
    for r in got.collect():
        assert r["top"] == depth[1, r["start"] : r["end"]].max()


def test_a_chromosome_of_fifty_million_positions_is_one_segment(spark):
    size, step = 50_000_000, 40_000
    at = F.col("id") * step + 1000
    parts = [("start", 0, 20, 5), ("core", 0, 400, 5), ("end", 380, 400, 5)]
    tracks = None
    for track, a, b, cov in parts:
        one = spark.range(size // step).select(F.lit("c").alias("chrom"), F.lit(track).alias("track"), (at + a).alias("start"), (at + b).alias("end"), F.lit(cov).cast("long").alias("cov"))
        tracks = one if tracks is None else tracks.unionByName(one)
    whole = spark.createDataFrame([("c", 0, size)], "chrom string, start long, end long")
    got = universe.hidden_states(tracks, whole, value="cov").orderBy("start").collect()
    assert len(got) == size // step and all(r["start"] == i * step + 1000 and r["end"] == i * step + 1400 and r["top"] == 5 for i, r in enumerate(got))


@pytest.mark.parametrize("seed", range(3))
def test_segments_of_sparse_and_dense_chromosomes(spark, seed):
    rng = np.random.default_rng(seed)
    for few in (True, False):
        x = np.zeros((6000, 1), int)
        for _ in range(12 if few else 400):
            a = rng.integers(0, 5900)
            x[a : a + rng.integers(1, 60 if few else 100)] = 1
        if not few:
            x[2000:2300] = 0
        runs = np.flatnonzero(np.diff(np.concatenate(([0], x[:, 0], [0]))))
        cov = spark.createDataFrame([("c", int(a), int(b), 1) for a, b in zip(runs[::2], runs[1::2])], "chrom string, start long, end long, cov long")
        size = spark.createDataFrame([("c", 6000)], "chrom string, size long")
        full = x.any(1).sum()
        got = intervals.covered_segments(cov, size, 100, 40) if full < 3000 else intervals.segments_between_gaps(cov, size, 100, 40)
        assert sorted((r["start"], r["end"]) for r in got.collect()) == segments(x, 6000, (100, 40), (100, 40))


def test_runs_that_are_alike_are_worked_out_once(monkeypatch):
    rng = np.random.default_rng(3)
    kinds, n = paths.whole(rng.integers(-3, 3, (6, 4)) / 1.0), 4000
    single = paths.Steps.single(universe.ON, universe.STAY_FIRST, kinds[rng.integers(0, 6, n)])
    length, done, times = rng.integers(1, 9, n), [0], paths.times

    def counted(a, b, **options):
        done[0] += len(a)
        return times(a, b, **options)

    want = paths.power(single, length)
    monkeypatch.setattr(paths, "times", counted)
    got = paths.powers(single, length, *paths.alike(single.score, length))
    assert done[0] < 500 and np.array_equal(got.score, want.score) and np.array_equal(got.rank, want.rank)
    # a path that is decoded run by run is the one decoded position by position, whose work doesn't depend on lengths
    ones = paths.Steps(np.repeat(single.score, length, 0), np.repeat(single.rank, length, 0))
    states = paths.decoded(ones, np.ones(len(ones), int), ones, 3, 3)[2]
    done[0] = 0
    at, size, state = paths.decoded(single, length, got, 3, 3)
    assert np.array_equal(np.repeat(state, size), states) and at[0] == 0 and done[0] < 20 * n
