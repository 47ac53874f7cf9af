"""Hand-computed goldens and properties of the interval operators."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from intervale.functions import regions as fn
from intervale.operators import catalog, encode, intervals, perturb, search
from intervale.sources import bed

A = [(10, 30), (110, 130), (210, 230)]
PAIRS = {"s1": [(20, 40), (120, 140), (220, 240)], "s2": [(20, 40), (140, 160), (220, 240)], "s3": [(20, 40), (100, 120), (125, 145), (220, 240)]}
WANT = {"s1": (30, 30, 30), "s2": (20, 40, 40), "s3": (35, 25, 45)}


def frame(spark, rows, bed_id=0):
    return spark.createDataFrame([(bed_id, i, "chr1", s, e) for i, (s, e) in enumerate(rows)], "bed_id int, row_idx long, chrom string, start long, end long")


@pytest.mark.parametrize("name", PAIRS)
def test_overlap_and_distances(spark, name):
    a, b = frame(spark, A), frame(spark, PAIRS[name])
    got = intervals.overlap_bp(a, b).first()
    assert (got["overlap"], got["only_file"], got["only_universe"]) == WANT[name]
    assert intervals.boundary_distances(a, b).first()["median_distance"] == 10


def test_merge_joins_book_ended_rows_and_is_idempotent(spark):
    x = frame(spark, [(0, 5), (5, 9), (20, 30), (22, 24), (31, 40)])
    once = intervals.merge(x, "bed_id")
    assert sorted(r["start"] for r in once.collect()) == [0, 20, 31]
    assert sorted(intervals.merge(once, "bed_id").collect()) == sorted(once.collect())


def test_interval_join_against_brute_force_with_wide_rows(spark):
    rng = random.Random(3)
    left = [(s, s + rng.randint(1, 90)) for s in (rng.randint(0, 5000) for _ in range(150))]
    right = [(s, s + w) for s, w in ((rng.randint(0, 5000), rng.choice([1, 30, 4000])) for _ in range(120))]
    l, r = frame(spark, left), frame(spark, right).select(F.col("row_idx").alias("uid"), "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    got = sorted((x["row_idx"], x["uid"]) for x in intervals.interval_join(l, r, size=16).collect())
    assert got == sorted((i, j) for i, (a, b) in enumerate(left) for j, (c, d) in enumerate(right) if a < d and c < b)


def test_nearest_and_coverage_across_buckets(spark):
    rng = random.Random(4)
    q, t = [rng.randint(0, 999) for _ in range(80)], [rng.randint(0, 999) for _ in range(9)]
    qs, ts = (spark.createDataFrame([("chr1", p) for p in x], "chrom string, pos long") for x in (q, t))
    got = sorted((r["pos"], r["distance"]) for r in intervals.nearest(qs, ts, bucket=64).collect())
    assert got == sorted((p, min(abs(p - x) for x in t)) for p in q)
    spans = [(s, s + rng.randint(1, 300)) for s in q]
    depth = [sum(s <= i < e for s, e in spans) for i in range(1400)]
    cov = [0] * 1400
    for r in intervals.coverage(frame(spark, spans), bucket=64).collect():
        for i in range(r["start"], r["end"]):
            cov[i] = r["cov"]
    assert cov == depth


def test_scalar_functions(spark):
    row = spark.range(1).select(
        fn.genome_distance(F.lit(0), F.lit(10), F.lit(15), F.lit(20)).alias("gap"), fn.rbs(F.lit(0), F.lit(0)).alias("rbs"), fn.hyphenated(F.lit("0" * 32)).alias("uuid"),
        fn.parse_region(F.lit("chr1:5-9")).alias("region"), fn.padded(F.array(F.lit(1)), 3, 0).alias("pad"),
    ).first()
    assert row["gap"] == 6 and abs(row["rbs"] - 1.01) < 1e-12 and row["uuid"].count("-") == 4 and tuple(row["region"]) == ("chr1", 5, 9) and row["pad"] == [1, 0, 0]


def test_perturbations_are_exact_and_repeat(spark):
    x = frame(spark, [(i * 100, i * 100 + 50) for i in range(1000)]).select("row_idx", "chrom", "start", "end", F.lit("-").alias("mod"))
    size = spark.createDataFrame([("chr1", 200_000)], "chrom string, size long")
    assert perturb.drop(x, 0.315, 1).count() == 685
    assert perturb.add(x, size, 1.23, 320, 30, 1).where("mod = 'A'").count() == 1230
    assert perturb.cut(x, 0.909, 1).where("mod = 'C'").count() == 2 * 909
    assert sorted(perturb.drop(x, 0.3, 5).collect()) == sorted(perturb.drop(x, 0.3, 5).collect())
    steps = [{"op": "drop", "rate": 0.5}, {"op": "cut", "rate": 0.1}]
    assert perturb.program(x, steps, seed=2).count() == 550
    with pytest.raises(ValueError):
        perturb.drop(x, 1.5, 1)
    with pytest.raises(ValueError):
        perturb.program(x, [{"op": "fly"}], seed=2)


def test_bed_files_and_cache(spark, tmp_path):
    body = "chr1\t1\t10\nchr2\t5\t9\n"
    (tmp_path / "ok.bed").write_text("# a\n# b\n" + body)
    (tmp_path / "bad.bed").write_text("# x\n" * 8 + body)
    with gzip.open(tmp_path / "zip.bed.gz", "wt") as f:
        f.write(body)
    assert bed.read_bed(spark, str(tmp_path / "ok.bed")).count() == 2
    with pytest.raises(bed.BedFileError):
        bed.read_bed(spark, str(tmp_path / "bad.bed"))
    one, two = (catalog.identifiers(bed.read_bed(spark, str(tmp_path / n))).first()["identifier"] for n in ("ok.bed", "zip.bed.gz"))
    assert one == two and len(one) == 32
    cache = catalog.Cache(spark, str(tmp_path / "cache"))
    name = cache.add(bed.read_bed(spark, str(tmp_path / "ok.bed")).select("row_idx", "chrom", "start", "end"))
    assert cache.list() == [name] and cache.load(name).count() == 2
    cache.remove(name)
    with pytest.raises(catalog.RegionSetNotFoundError):
        cache.load(name)


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 0), (2, 1, 1), (2, 2, 1)], "query_id int, place int, relevant int")
    got = {r["query_id"]: r for r in search.retrieval_metrics(ranked).collect()}
    assert abs(got[1]["ap"] - (1 + 2 / 3) / 2) < 1e-12 and got[1]["auc"] == 0.75 and got[1]["rp"] == 0.5 and got[2]["auc"] is None


def test_reconstruction_against_least_squares(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from intervale.operators import evaluate

    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 4))
    b = np.column_stack([v[:, 0] + rng.normal(size=300) > 0, v[:, 1] > v[:, 2], np.ones(300)]).astype(float)
    rows = spark.createDataFrame([(i, v[i].tolist(), b[i].tolist()) for i in range(300)] + [(300, None, [1.0] * 3)], "id long, v array<double>, b array<double>")
    fold = np.array([r.f for r in rows.where("id < 300").orderBy("id").select(F.pmod(F.xxhash64(F.lit(42), F.col("id")), F.lit(5)).alias("f")).collect()])
    want = {}
    for k in range(5):
        one = np.column_stack([np.ones(300), v])
        w = np.linalg.lstsq(one[fold != k], b[fold != k], rcond=None)[0]
        y = b[fold == k]
        error, spread = ((y - one[fold == k] @ w) ** 2).sum(axis=0), ((y - y.mean(axis=0)) ** 2).sum(axis=0)
        want[k] = np.mean([1 - error[0] / spread[0], 1 - error[1] / spread[1], 1.0])
    got = {r.fold: r.r2 for r in evaluate.reconstruction(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert evaluate.reconstruction(rows.limit(0)).count() == 0


def _brute_pairs(left, right):
    return sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])


@pytest.mark.parametrize("wide", [(0, 0), (1, 0), (0, 1), (1, 1)])
def test_tiers_hold_narrow_and_wide_rows(spark, wide):
    import random

    random.seed(sum(wide))

    def made(n, some):
        out = []
        for i in range(n):
            at = random.randrange(300_000)
            width = random.choice([1, 40, 640, 641, 100_000]) if some and i % 3 == 0 else random.randrange(1, 640)
            out.append((i, random.choice(["a", "b"]), at, at + width))
        return out

    left, right = made(300, wide[0]), made(200, wide[1])
    a = spark.createDataFrame(left, "id int, chrom string, start long, end long")
    b = spark.createDataFrame(right, "uid int, chrom string, r_start long, r_end long")
    got = sorted((r["id"], r["uid"]) for r in intervals.interval_join(a, b, size=10).collect())
    assert got == _brute_pairs(left, right)
    # what meets before the predicate: no two narrow rows in wide bins, and fewer candidates than all pairs of a chromosome
    x = intervals._bins(a, "start", "end", 10, "t", "n")
    y = intervals._bins(b, "r_start", "r_end", 10, "t", "n", (0, 1), (1, 2)).withColumnsRenamed({"start": "s", "end": "e"})
    met = x.join(y, ["chrom", "t", "n"])
    narrow = met.where("t > 0 and end - start <= 640 and r_end - r_start <= 640")
    assert narrow.count() == 0
    if wide == (0, 0):
        assert met.count() < 300 * 200 / 2 / 20


def test_merging_carries_across_many_buckets(spark):
    import random

    random.seed(7)
    rows = []
    for f in ("x", "y"):
        for _ in range(400):
            at = random.randrange(20_000)
            rows.append((f, random.choice(["a", "b"]), at, at + random.choice([1, 3, 9, 200, 2500] if f == "x" else [1, 2, 5])))
    want = []
    for f, c in sorted({r[:2] for r in rows}):
        held = None
        for s, e in sorted((r[2], r[3]) for r in rows if r[:2] == (f, c)):
            if held and s <= held[1]:
                held = (held[0], max(held[1], e))
            else:
                want += [(f, c, *held)] if held else []
                held = (s, e)
        want.append((f, c, *held))
    frame = spark.createDataFrame(rows, "f string, chrom string, start long, end long")
    for bucket in (10, 64, 1 << 20):
        got = intervals.merge(frame, "f", bucket=bucket).select("f", "chrom", "start", "end").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    plan = intervals.merge(frame, "f")._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan


def test_positions_are_asked_once(spark):
    import random

    random.seed(2)
    queries = [(i, "a", random.randrange(50) * 13) for i in range(500)]
    targets = [("a", random.randrange(700)) for _ in range(40)]
    q, t = spark.createDataFrame(queries, "id int, chrom string, pos long"), spark.createDataFrame(targets, "chrom string, pos long")
    for bucket in (7, 100, 1 << 20):
        got = {r["id"]: r["distance"] for r in intervals.nearest(q, t, bucket).collect()}
        assert got == {i: min(abs(p - x) for _, x in targets) for i, _, p in queries}


def test_what_bins_or_neighbours_multiply_is_not_broadcast(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS uid", "'chr1' AS chrom", "id * 40 AS start", "id * 40 + 30 AS end")
    rows.write.parquet(str(tmp_path / "u"))  # files far below the limit for broadcasts
    u = spark.read.parquet(str(tmp_path / "u"))
    right = u.select("uid", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    joined = intervals.interval_join(u.select("chrom", "start", "end"), right)
    near = intervals.neighbours(u, 3)
    for frame in (joined, near):
        assert "SortMergeJoin" in frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert ", m#" not in "".join(x for x in near._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x)
    assert joined.count() == 50 and near.where("uid = 10").orderBy("place").select("neighbour").first()[0] == 9


def test_similarities_of_some_files_are_on_the_scale_of_all(spark):
    from intervale.operators import labels

    rng = random.Random(4)
    rows = [(f"F{i}", None if i == 5 else [0.0] * 3 if i == 6 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    db = spark.createDataFrame(rows, "db_file string, v array<double>")
    test = db.where("db_file in ('F1', 'F5', 'F10', 'F11', 'F20')").withColumnRenamed("db_file", "test_file")
    whole = {(r["db_file"], r["test_file"]): r["score"] for r in labels.file_similarities(db, test).collect()}
    some = {(r["db_file"], r["test_file"]): r["score"] for r in labels.file_similarities(db, test, "f1").collect()}
    assert len(whole) == 150 and set(some) == {k for k in whole if "F1" in k[1]}
    known = [x for x in whole.values() if x is not None]
    assert abs(min(known)) < 1e-12 and abs(max(known) - 1) < 1e-12 and len(known) == 4 * 28
    assert all((x is None) == (whole[k] is None) and (x is None or abs(x - whole[k]) < 1e-12) for k, x in some.items())


def test_tasks_follow_counted_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i % 3, i, f"chr{rng.randrange(2)}", s := rng.randrange(1 << 21), s + rng.randrange(1, 400)) for i in range(3000)]
    r = spark.createDataFrame(rows, "bed_id int, row_idx long, chrom string, start long, end long")
    u = spark.createDataFrame([(k, f"chr{k % 2}", k * 3000, k * 3000 + 900) for k in range(700)], "uid long, chrom string, start long, end long")
    other = u.select("uid", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 700, 3)], "id long, v array<double>")

    def every():
        semi = intervals.interval_join(r, other, "semi")
        tokens = encode.token_rows(r, encode.vocabulary(u), "bed_id")
        wide = encode.encode_regions(tokens, vectors, "bed_id")
        found = [semi, intervals.interval_join(r, other, "anti"), intervals.interval_join(r, other), intervals.merge(r, "bed_id"), intervals.universe_distances(r, u), intervals.boundary_distances(r, u), wide]
        return [sorted(x.collect(), key=str) for x in found], [semi.rdd.getNumPartitions(), wide.rdd.getNumPartitions()]

    want, few = every()
    monkeypatch.setattr(intervals, "DEALT", 100)
    got, many = every()
    assert [a == b for a, b in zip(got, want)] == [True] * 7
    assert max(few) <= 8 and many == [37, 30]
