"""What the corpus operators share: reading tables, folds of ids, and the session's helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale import session
from intervale.session import cut, shared_dir

__all__ = ["cut", "fold", "kind", "prepare", "shared_dir", "table"]

#: So many texts go to a Python worker at once: both sides hold a batch several times over, and workers of earlier stages live on.
BATCH, ROWS_A_BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """As for the core, with batches of at most ``BATCH`` texts."""
    session.prepare(spark)
    if not 0 < int(spark.conf.get(ROWS_A_BATCH)) <= BATCH:
        spark.conf.set(ROWS_A_BATCH, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind(df: DataFrame, column: str) -> str:
    """A column's type, as schemas name it."""
    return df.schema[column].dataType.simpleString()


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id is fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))
