"""Coverage kept up over micro-batches, restarts and files that come twice, against coverage of all files at once."""

import numpy as np
import pandas as pd

from intervale.operators import intervals
from intervale.plans import catalogue
from intervale.streaming import coverage

D = "/root/testdata/sf0.001"
SCHEMA = "bed_id int, chrom string, start long, end long, row_idx long"


def test_batches_restart_and_repeats(spark, tmp_path):
    every = catalogue.regions(spark, D).select("bed_id", "chrom", "start", "end", "row_idx").toPandas()
    source, to, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def arrive(ids, name):
        for i in ids:
            (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
            every[every["bed_id"] == i].to_parquet(f"{source}/{name}/{i}.parquet", index=False)

    def count():
        q = coverage.stream_coverage(spark, source, SCHEMA, to, state, files_per_batch=2, bucket=1000)
        q.awaitTermination(300)
        assert q.exception() is None

    def same(ids):
        want = intervals.coverage(spark.createDataFrame(every[every["bed_id"].isin(ids)], SCHEMA))
        assert sorted(coverage.streamed_coverage(spark, to).collect()) == sorted(want.collect()) and want.count()

    arrive(range(5), "a")
    count()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    same(range(5))
    arrive([1, 3], "b")  # come again, in a later run
    arrive([5, 6], "b")
    arrive([5, 6], "c")  # come twice at once
    count()
    same(range(7))
    count()  # nothing is new
    same(range(7))
    assert spark.read.parquet(to).select("batch").distinct().count() > 3


def test_changes_that_cancel_and_odd_rows(spark, tmp_path):
    """A later file that begins where an earlier one ends leaves a bucket whose changes are 0; nulls and empty regions count nothing."""
    source, to, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[(0, "c", 5, 1010, 0)], [(1, "c", 1010, 2500, 0), (1, "c", 1500, 1500, 1)], [(2, None, 1, 2, 0), (2, "c", None, 7, 1), (None, "c", 1, 2, 2), (3, "c", 2400, 2500, 3)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        coverage.stream_coverage(spark, source, SCHEMA, to, state, bucket=1000).awaitTermination(300)
    got = sorted((r["start"], r["end"], r["cov"]) for r in coverage.streamed_coverage(spark, to).collect())
    assert got == [(5, 1010, 1), (1010, 1500, 1), (1500, 2400, 1), (2400, 2500, 2)]


def test_a_bucket_counts_a_file_once():
    rows = pd.DataFrame({"bed_id": ["x", "x", "y"], "arrival": ["q", "p", "q"], "pos": [4, 4, 4], "d": [1, 1, -1]})
    none = np.zeros(0, np.int64)
    pos, d, files = coverage.counted(none, none, set(), rows)
    assert pos.tolist() == [4] and d.tolist() == [0] and len(files) == 2
    pos, d, again = coverage.counted(pos, d, files, pd.DataFrame({"bed_id": ["y", "z"], "arrival": ["r", "r"], "pos": [4, 9], "d": [5, 2]}))
    assert pos.tolist() == [4, 9] and d.tolist() == [0, 2] and len(again) == 3
