"""A stream of region files into coverage, kept up between micro-batches.

State stands by (chrom, bucket): where depth changes, by how much, and which files have been counted.  Changes that cancel stay, as
they part runs; so a bucket once touched is never empty.  A micro-batch meets only the buckets that its regions begin or end in, and
writes those anew; coverage is swept from the last version of every bucket.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from intervale.operators import intervals
from intervale.session import prepare

STATE = "pos binary, d binary, files binary"
CHANGES = "chrom string, _b long, pos long, d long"


def _kept(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(x)), np.int64)


def counted(pos: np.ndarray, d: np.ndarray, files: set[bytes], rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, set[bytes]]:
    """A bucket after rows (bed_id, arrival, pos, d): files counted before change nothing, and of one that arrives several times at once the first by name counts."""
    names = {b: hashlib.md5(b.encode()).digest() for b in rows["bed_id"].unique()}
    new = {b for b, h in names.items() if h not in files}
    some = rows[rows["bed_id"].isin(new)]
    some = some[some["arrival"] == some.groupby("bed_id")["arrival"].transform("min")]
    at, place = np.unique(np.concatenate((pos, some["pos"].to_numpy(np.int64))), return_inverse=True)
    sums = np.zeros(len(at), np.int64)
    np.add.at(sums, place, np.concatenate((d, some["d"].to_numpy(np.int64))))
    return at, sums, files | {names[b] for b in new}


def _step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pos = d = np.zeros(0, np.int64)
    files: set[bytes] = set()
    if state.exists:
        p, q, f = state.get
        seen = zlib.decompress(bytes(f))
        pos, d, files = _numbers(p), _numbers(q), {seen[i : i + 16] for i in range(0, len(seen), 16)}
    # a file's rows may come in several Arrow batches: all of a bucket's rows are one step
    pos, d, files = counted(pos, d, files, pd.concat(list(batches), ignore_index=True))
    state.update((_kept(pos), _kept(d), zlib.compress(b"".join(sorted(files)), 1)))
    yield pd.DataFrame({"chrom": key[0], "_b": key[1], "pos": pos, "d": d})


def stream_coverage(spark: SparkSession, folder: str, schema: str, to: str, checkpoint: str, *, files_per_batch: int = 1000, bucket: int = intervals.BUCKET) -> StreamingQuery:
    """Starts to count the Parquet files of regions (bed_id, chrom, start, end) that stand in ``folder`` or its subfolders; ends when none is left.

    Started again with the same checkpoint it goes on where it ended.  A bed_id names its content and arrives in one Parquet file:
    one that arrives again, under whatever name, counts once.  Rows with a null take no part.  A micro-batch writes the folder
    ``batch=n`` of ``to`` whole, so that one done again after a failure leaves the same.  State is the changes of a bucket (at most one a
    position) and 16 bytes for each file that touches it; where all buckets together outgrow the executors' memory, set Spark's RocksDB
    provider of state.
    """
    prepare(spark)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)
    rows = read.select(F.col("bed_id").cast("string").alias("bed_id"), F.col("_metadata.file_path").alias("arrival"), "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("d"))))
    changes = rows.select("bed_id", "arrival", "chrom", ends.alias("e")).select("bed_id", "arrival", "chrom", F.floor(F.col("e.pos") / bucket).alias("_b"), "e.pos", "e.d")
    kept = changes.groupBy("chrom", "_b").applyInPandasWithState(_step, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={n}")

    return kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def streamed_coverage(spark: SparkSession, to: str) -> DataFrame:
    """chrom, start, end, cov of all that ``stream_coverage`` has counted, as ``intervals.coverage`` of all files gives it."""
    versions = spark.read.schema(CHANGES + ", batch long").parquet(to)
    last = versions.groupBy("chrom", "_b").agg(F.max("batch").alias("batch"))
    return intervals.swept(versions.join(last, ["chrom", "_b", "batch"], "left_semi").select("chrom", "_b", "pos", "d"))
