"""Hard negatives: brute force over clustered, repeated and odd vectors, with one cell and with many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.llm import hard_negatives

SCHEMA = "vec_id long, label long, embedding array<double>, cell string, w string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def brute(rows, asks, k=5, n=5, percent=80):
    out, anchors = [], {}
    for i, label, v in rows:
        if asks(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    for a, (label, v) in anchors.items():
        s = x @ np.array(v, np.int64)
        order = np.lexsort((ids, -s))
        order = order[ids[order] != a]
        for p in order[labels[order] == label][:k]:
            found = [j for j in order if labels[j] != label and percent * s[p] <= 100 * s[j] <= 100 * s[p]][:n]
            out += [(a, int(ids[p]), r + 1, int(ids[j]), int(s[p]), int(s[j])) for r, j in enumerate(found)]
    return sorted(out)


def planted(seed, n, width=12, spread=25.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (8, width))
    return [(i, int(rng.integers(3)), np.floor(centres[rng.integers(8)] + rng.normal(0, spread, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 48, "sample": 512}, {"cell_rows": 48, "most_cells": 4}])
def test_matches_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rows = planted(1, 900)
    rows += [(2000 + i, i % 3, rows[7][2]) for i in range(300)]  # a quarter of all rows is one vector
    rows += [(2100, 1, rows[7][2]), (40, 2, rows[3][2]), (40, 2, rows[3][2])]  # ids that repeat, one of them an anchor's
    rows += [(5000, 0, [0.0] * 12), (5020, 0, [-x for x in rows[9][2]])]
    got = hard_negatives.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0)


def test_tree_bounds_hold_and_spare_work(spark):
    rows = planted(4, 4000, spread=4.0)
    index = hard_negatives.build_index(hard_negatives.usable(frame(spark, rows), "vec_id", "label", "embedding"), cell_rows=250)
    assert len(index.cells) > 8 and sum(index.count) == 4000
    asked = index.rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "v", F.array(F.lit(-(1 << 62))).alias("lo"), F.array(F.lit(1 << 62)).alias("hi"))
    x = {i: np.array(v) for i, _, v in rows}
    fifth = {i: sorted((int(x[i] @ v) for j, v in x.items() if j != i), reverse=True)[4] for i in x if i % 100 == 0}
    table = spark.createDataFrame(list(fifth.items()), "query_id long, s long")
    narrowed = asked.join(table, "query_id").withColumn("lo", F.array("s")).drop("s")
    visited = {(r["query_id"], r["cell"]) for kind in (True, False) for r in hard_negatives.visits(index, narrowed, kind).collect()}
    cell = {r["vec_id"]: r["cell"] for r in index.rows.collect()}
    for i, s in fifth.items():  # every row that is good enough lies in a cell that is visited
        assert all((i, cell[j]) in visited for j, v in x.items() if int(x[i] @ v) >= s)
    assert len(visited) < 0.6 * len(fifth) * len(index.cells)


def test_windows_of_negative_and_zero_scores(spark):
    rows = [(0, 0, [10.0, 0.0]), (1, 0, [-5.0, 1.0]), (2, 1, [-5.0, 0.0]), (3, 0, [0.0, 3.0]), (4, 1, [0.0, 9.0]), (6, 1, [3.0, 0.0]), (7, 0, [3.0, 0.0])]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i == 0) == [(0, 3, 1, 4, 0, 0), (0, 7, 1, 6, 30, 30)]


def test_odd_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = planted(2, 60, 3)
    odd = [(None, 1, [1.0, 2.0, 3.0]), (101, None, [1.0, 2.0, 3.0]), (102, 1, None), (103, 1, [1.0, None, 2.0]), (104, 1, [nan, 1.0, 1.0]), (105, 1, [inf, 1.0, 1.0]), (106, 1, [1e300, 1.0, 1.0]), (107, 1, []), (120, 1, [1.0, 2.0])]
    got = hard_negatives.mine(frame(spark, good + odd), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(good, lambda i: i % 20 == 0)
    for rows in ([], odd[:2], [(0, 1, [1.0])]):
        assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, good), F.col("vec_id") == -1).count() == 0


def test_the_query_maps_floats_to_integers(spark, tmp_path):
    rng = np.random.default_rng(8)
    raw = [(i, int(rng.integers(10)), rng.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in range(300)] + [(700, 3, [float("nan")] * 6), (701, 3, [float("inf")] + [0.0] * 5)]
    spark.createDataFrame(raw, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, np.floor(256 * np.array(v)).tolist()) for i, k, v in raw[:300]]
    got = hard_negatives.op12_vantage_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 100 == 0)
