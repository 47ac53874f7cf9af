"""Writers of region sets, universes, models, tokens and embeddings; all but those that say so refuse to overwrite."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.functions.regions import parse_region


def write_vocabulary_regions(regions: DataFrame, path: str) -> None:
    """BED3 of region keys (region), chr:start-end."""
    regions.select(parse_region(F.col("region")).alias("r")).select("r.*").write.csv(path, sep="\t")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Lines token, id, by id."""
    vocab.select("token", "id").orderBy("id").write.csv(path, sep="\t")


def write_assessment(assessed: DataFrame, path: str) -> None:
    """CSV with a header, a row for each file."""
    assessed.write.csv(path, header=True)


def write_distances(distances: DataFrame, path: str, by: str = "bed_id") -> None:
    """A folder of Parquet for each file."""
    distances.write.partitionBy(by).parquet(path)


def write_universe(universe: DataFrame, path: str) -> None:
    """BED3 of a hard universe, or BED9 of a flexible one (with core_start and core_end), the core as thick part and ``top`` as score."""
    x = universe
    if "core_start" in universe.columns:
        top = F.col("top") if "top" in universe.columns else F.lit(0)
        x = x.select("chrom", "start", "end", F.lit("universe"), top, F.lit("."), "core_start", "core_end", F.lit("0,0,255"))
    else:
        x = x.select("chrom", "start", "end")
    x.orderBy("chrom", "start").write.csv(path, sep="\t")


def write_model(model: DataFrame, path: str, force: bool = False) -> None:
    """A likelihood model by chromosome; one that is there stays, unless ``force``."""
    model.write.mode("overwrite" if force else "ignore").partitionBy("chrom").parquet(path)


def read_model(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """A likelihood model, or one chromosome's part, of which no other file is read."""
    model = spark.read.parquet(path)
    return model if chrom is None else model.where(F.col("chrom") == chrom)


def write_tokens(tokens: DataFrame, path: str, universe: str) -> None:
    """Tokens of a universe in a folder of their own, in place of those that are there."""
    tokens.write.mode("overwrite").parquet(f"{path}/universe={universe}")


def write_rows(rows: DataFrame, path: str) -> None:
    """Tab-separated rows, such as a filtered universe."""
    rows.write.csv(path, sep="\t")


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """One line for each row: sentences, or documents with labels."""
    lines.select(column).write.text(path)


def export_model(embeddings: DataFrame, path: str, **config) -> None:
    """Embeddings (id, v) and their configuration: the vocabulary's size, the width, and what else is given."""
    size = embeddings.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    embeddings.write.parquet(f"{path}/embeddings")
    text = json.dumps({"vocab_size": size["n"], "embedding_dim": size["w"] or 0} | config, sort_keys=True)
    embeddings.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Embeddings and configuration; the width may also be called embedding_size."""
    config = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/config").collect()))  # one line
    config.setdefault("embedding_dim", config.get("embedding_size"))
    return spark.read.parquet(f"{path}/embeddings"), config
