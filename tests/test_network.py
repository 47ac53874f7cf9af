"""Networks: gradients against differences, folds against least squares, planted maps, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.functions.regions import cosine
from intervale.operators import evaluate, index, network

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("loss", ["squared", "cosine"])
@pytest.mark.parametrize("hidden", [(5,), (4, 3)])
def test_gradients_match_differences(loss, hidden):
    rng = np.random.default_rng(3)
    widths = [3, *hidden, 4]
    flat = network.parameters(widths, 1) + rng.normal(0, 0.1, len(network.parameters(widths, 1)))
    x, y, sign = rng.normal(0, 1, (7, 3)), rng.normal(0, 1, (7, 4)), np.array([1, 1, -1, 1, -1, -1, 1.0])
    value, g = network.gradient(flat, widths, x, y, sign, loss, 0.1)
    assert value > 0
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        up, down = (network.gradient(flat + z, widths, x, y, sign, loss, 0.1)[0] for z in (e, -e))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_descent_finds_a_minimum():
    a = np.diag([1.0, 50.0, 0.2])
    way = network.Descent(np.array([3.0, -2.0, 5.0]), 100)
    for _ in range(60):
        if way.done:
            break
        way.told(float(way.asks @ a @ way.asks) / 2, a @ way.asks, float(way.asks @ a @ way.asks))
    assert np.abs(way.best).max() < 1e-4 and all(q[0] <= p[0] for p, q in zip(way.losses, way.losses[1:]))


def bent(spark, n=1500):
    """Outputs that no linear map restores."""
    v = np.random.default_rng(5).normal(0, 1, (n, 4))
    b = np.stack([np.abs(v[:, 0]), (v[:, 1] * v[:, 2] > 0) * 1.0, np.maximum(v[:, 3], 0)], 1)
    return spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(v, b))], "id long, v array<double>, b array<double>").repartition(5)


def test_folds_beat_least_squares_where_maps_are_bent(spark):
    rows = bent(spark)
    linear = {r["fold"]: r["r2"] for r in evaluate.reconstruction(rows).collect()}
    got = {r["fold"]: r["r2"] for r in network.reconstruction(rows, hidden=(40,)).collect()}
    assert set(got) == set(linear) == set(range(5))
    assert all(got[f] > max(0.75, linear[f] + 0.3) for f in got)


def test_folds_reach_least_squares_on_the_table(spark):
    b = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.pmod("label", F.lit(10)) == k).cast("double"))
    rows = spark.read.parquet(f"{D}/embeddings.parquet").where("label is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), b.alias("b"))
    linear = {r["fold"]: r["r2"] for r in evaluate.reconstruction(rows.withColumn("v", F.col("v").cast("array<double>"))).collect()}
    got = {r["fold"]: r["r2"] for r in network.reconstruction(rows, rounds=30).collect()}
    assert set(got) == set(linear) and all(got[f] >= linear[f] for f in got)


def test_angles_keep_and_reload(spark, tmp_path):
    rng = np.random.default_rng(6)
    turn = rng.normal(0, 1, (6, 5))
    v = rng.normal(0, 1, (800, 6))
    y = np.maximum(v, 0) @ turn
    rows = [(i, a.tolist(), c.tolist()) for i, (a, c) in enumerate(zip(v, y))]
    frame = spark.createDataFrame(rows, "id long, v array<double>, y array<double>").repartition(6)
    net = network.train(frame, hidden=(32,), rounds=60)
    assert net.losses[-1][0] < 0.05 < net.losses[0][0]
    asked = spark.createDataFrame([(1, v[0].tolist(), "x"), (2, None, "y"), (3, [1.0], "z"), (4, [float("nan")] * 6, None)], "id long, v array<double>, more string")
    got = {r["id"]: r for r in net.predict(asked).collect()}
    assert got[2]["p"] is got[3]["p"] is got[4]["p"] is None and got[2]["more"] == "y" and len(got[1]["p"]) == 5
    net.save(spark, f"{tmp_path}/net")
    again = network.load(spark, f"{tmp_path}/net")
    assert np.allclose(again.of(v), net.of(v)) and np.allclose(got[1]["p"], net.of(v[:1])[0])
    fresh = rng.normal(0, 1, (200, 6))
    fresh = fresh[(fresh > 0).any(1)]  # without a positive number the true vector is 0 and has no angle
    p, t = net.of(fresh), np.maximum(fresh, 0) @ turn
    assert ((p * t).sum(1) / np.sqrt((p * p).sum(1) * (t * t).sum(1))).mean() > 0.95


def test_texts_find_vectors(spark):
    """A network behind the words' encoder: texts of a topic find the vectors of their topic."""
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, (4, 8))
    topic = rng.integers(0, 4, 240)
    texts = [" ".join(f"w{t}_{k}" for k in rng.choice(12, 6, replace=False)) for t in topic]
    vectors = centre[topic] + rng.normal(0, 0.2, (240, 8))
    frame = spark.createDataFrame([(i, a, b.tolist()) for i, (a, b) in enumerate(zip(texts, vectors))], "id long, text string, y array<double>").repartition(4)
    learned = frame.where("id < 200")
    net = network.train(index.text_vectors(learned, "id", "text").join(learned, "id").select("id", "v", "y"), hidden=(24,), rounds=40)
    held = index.VectorIndex().load(frame.select("id", F.col("y").alias("v")))
    found = index.TextSearch(held, net.encoder(index.text_vectors)).query(frame.where("id >= 200").select(F.col("id").alias("query_id"), "text"), 5).collect()
    assert len(found) == 200 and np.mean([topic[r["query_id"]] == topic[r["id"]] for r in found]) > 0.9


def test_pairs_that_are_none_are_pushed_apart(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (300, 3))
    rows = [(i, a.tolist(), a.tolist(), 1 if i % 2 else -1) for i, a in enumerate(v)]
    net = network.train(spark.createDataFrame([r for r in rows if r[3] < 0], "id long, v array<double>, y array<double>, sign int"), hidden=(16,), rounds=40)
    p = net.of(v)
    assert np.maximum((p * v).sum(1) / np.sqrt((p * p).sum(1) * (v * v).sum(1) + 1e-12), 0).mean() < 0.1


def test_odd_rows(spark):
    schema = "id long, v array<double>, y array<double>, b array<double>"
    with pytest.raises(ValueError):
        network.train(spark.createDataFrame([], schema))
    with pytest.raises(ValueError):
        network.train(spark.createDataFrame([(1, [1.0], [1.0], None), (2, [1.0, 2.0], [1.0], None)], schema))
    with pytest.raises(ValueError):
        network.train(spark.createDataFrame([(1, [1.0], [1.0], None)], schema), loss="other")
    assert network.reconstruction(spark.createDataFrame([], "id long, v array<double>, b array<double>")).count() == 0
    odd = [(None, [1.0], [1.0], None), (1, None, [1.0], None), (2, [float("inf")], [1.0], None), (3, [None], [1.0], None), (4, [2.0], [], None)]
    same = [(5, [1.0], [1.0], None)] * 4
    with pytest.raises(ValueError):
        network.train(spark.createDataFrame(odd, schema))
    net = network.train(spark.createDataFrame(odd + same, schema), loss="squared", rounds=5)
    assert abs(net.of(np.ones((1, 1)))[0, 0] - 1) < 1e-6


def test_vectors_without_a_direction_have_no_cosine(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0, 0.0], [0.0, 0.0]), (4, None, [1.0, 0.0])], "id int, p array<double>, y array<double>")
    got = {r["id"]: r["score"] for r in rows.select("id", cosine("p", "y").alias("score")).collect()}
    assert abs(got.pop(1) - 0.96) < 1e-12 and got == {2: None, 3: None, 4: None}
