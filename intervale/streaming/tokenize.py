"""A stream of regions, tokenized against a static universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from intervale.operators.intervals import interval_join


def stream_tokens(spark: SparkSession, folder: str, schema: str, universe: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends bed_id, chrom, start, end, uid for the Parquet files of regions that arrive in ``folder``.

    The join is stateless: each micro-batch meets the universe (uid, chrom, start, end) in bins.
    """
    from pyspark.sql import functions as F

    right = universe.select("uid", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    tokens = interval_join(spark.readStream.schema(schema).parquet(folder), right).select("bed_id", "chrom", "start", "end", "uid")
    return tokens.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
