"""Sessions, reaching the package from Python workers, and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temp folder in local mode only."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if to:
        return to.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="intervale-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before.  Unlike ``checkpoint()`` the
    rows are columnar and compressed, so later steps read only the columns they use.  The files go with the session.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/intervale-{uuid.uuid4().hex}"
    df.write.parquet(to)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(to)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of frames that ``cut`` gave, which nothing reads any more; a loop's rounds would else fill the disk one after another."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("intervale-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
