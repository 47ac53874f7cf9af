"""Partitioned and quantised indexes against plain searches."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intervale.operators import index, inverted

SCHEMA = "id long, v array<float>, name string"


def planted(n, width=32, groups=200, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, width))
    return (centres[rng.integers(groups, size=n)] + rng.normal(0, 0.35, (n, width))).astype(np.float32).astype(float)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v, f"n{first + i}") for i, v in enumerate(x.tolist())], SCHEMA)


def asked(spark, x, every=50):
    return spark.createDataFrame([(i, x[i].tolist()) for i in range(0, len(x), every)], "query_id long, q array<double>")


def plain(x, ids, k, measure):
    if measure == "l2":
        s = np.round(-np.sqrt(((x[ids][:, None] - x[None]) ** 2).sum(2)), 12)
    else:
        y = x / np.sqrt((x * x).sum(1))[:, None] if measure == "cosine" else x
        s = np.round(y[ids] @ y.T, 12)
    return {i: np.lexsort((np.arange(len(x)), -row))[:k].tolist() for i, row in zip(ids, s)}


def lists(found):
    out = {}
    for r in found.select("query_id", "place", "id").orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("measure", inverted.MEASURES)
def test_all_cells_and_bytes_are_exact(spark, tmp_path, measure):
    x = planted(1500, 9, 20)
    x[700:760] = x[3]  # ties
    ids = list(range(0, 1500, 50))
    want = plain(x, ids, 10, measure)
    cells = inverted.InvertedFile(str(tmp_path / "a"), measure, cells=12).load(frame(spark, x[:900]), "name").load(frame(spark, x[900:], 900), "name")
    assert len(cells) == 1500 and lists(cells.search(asked(spark, x), 10, probes=12)) == want
    coded = inverted.Quantised(measure, quantile=0.9).load(frame(spark, x[:900]), "name").load(frame(spark, x[900:], 900), "name")
    assert len(coded) == 1500 and lists(coded.search(asked(spark, x), 10)) == want
    for one in (cells, coded):
        row = one.search(asked(spark, x[:1]), 1, offset=1).first()
        assert row["place"] == 1 and row["id"] == want[0][1] and row["payload"] == f"n{want[0][1]}" and len(row["v"]) == 9
        assert [r["payload"] for r in one.retrieve(spark.createDataFrame([(5,), (-1,)], "id long")).collect()] == ["n5"]
        assert isinstance(one, index.SearchBackend)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_leave_few_rows(spark, seed):
    x = planted(4000, 32, seed=seed)
    coded = inverted.Quantised("l2").load(frame(spark, x))
    near = coded.candidates(asked(spark, x), 10, True).groupBy("query_id").count().agg(F.avg("count"), F.min("count")).first()
    assert near[0] < 60 and near[1] >= 10


def test_recall_of_fifty_thousand_vectors(spark, tmp_path):
    x = planted(50_000)
    rows = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": pa.array(x.tolist(), pa.list_(pa.float32()))})).repartition(8)
    ids = list(range(0, len(x), 500))
    want = plain(x, ids, 10, "cosine")
    one = inverted.InvertedFile(str(tmp_path / "a"), cells=100, probes=8).load(rows)
    got = lists(one.search(asked(spark, x, 500), 10, with_vectors=False))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in ids]) >= 0.9
    # one query reads the files of its cells, which hold far less than all
    visiting = one.visits(asked(spark, x[:1]), 8)
    files = one.probed(visiting)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in files or "PartitionFilters: [cell" in files
    cells = [r["cell"] for r in visiting.collect()]
    read = sum(size_of(tmp_path / "a" / "rows" / f"cell={c}") for c in cells)
    assert len(cells) == 8 and read < 0.2 * size_of(tmp_path / "a" / "rows")
    again = inverted.InvertedFile(str(tmp_path / "a"), probes=8).opened(spark)
    assert lists(again.search(asked(spark, x[:1]), 10)) == {0: got[0]}
    coded = inverted.Quantised().load(rows)
    assert lists(coded.search(asked(spark, x, 500), 10, with_vectors=False)) == want
    codes = coded.coded.select(F.sum(F.length("codes"))).first()[0]
    assert codes * 4 == 50_000 * 32 * 4  # a quarter of the floats'


def test_recall_on_the_embeddings(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pdf = rows.toPandas().sort_values("id")
    x = np.stack(pdf["v"].to_numpy()).astype(float)
    ids = pdf["id"].to_numpy()
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    one = inverted.InvertedFile(str(tmp_path / "a"), probes=28).load(rows)
    got = lists(one.search(queries, 10))
    want = plain(x, list(np.flatnonzero(ids % 20 == 0)), 10, "cosine")
    assert np.mean([len(set(got[int(ids[i])]) & {int(ids[j]) for j in w}) / 10 for i, w in want.items()]) >= 0.9


def test_odd_vectors_and_empty_indexes(spark, tmp_path):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, None, "c"), (4, [nan, 1.0], "d"), (5, [], "e"), (6, [1.0, 2.0, 3.0], "f"), (7, [1.0, None], "g"), (8, [0.0, 0.0], "h")], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [nan, 1.0])], "query_id long, q array<double>")
    for one in (inverted.InvertedFile(str(tmp_path / "a"), "l2"), inverted.Quantised("l2")):
        assert len(one) == 0 and one.load(rows) is one
        assert lists(one.search(queries, 5)) == {1: [1, 2, 8]} and len(one) == 3
    coded = inverted.Quantised().load(rows)
    assert lists(coded.search(queries, 5)) == {1: [1, 2]}
    assert len(inverted.Quantised().load(rows.limit(0))) == 0
    with pytest.raises(ValueError):
        inverted.Quantised("far")
