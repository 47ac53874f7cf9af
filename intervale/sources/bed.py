"""Readers and writers of BED, MAF and chromosome-size files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.functions.regions import snp_end
from intervale.session import cut

MOST_HEADERS = 5


class BedFileError(ValueError):
    """A file whose first rows are not regions."""


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """bed_id (file name), row_idx, chrom, start, end, rest of BED files; gzip by extension.

    ``row_idx`` is the number of the line, from 0 and blank ones with it, over all files in the order of their paths.  It follows from the lines of
    earlier blocks and the place within the block, so that neither the splits nor the executors of a read change it; lines are written once.
    Up to five leading rows that are no regions are skipped; more, or one further down, raise.  ``rest`` holds the further
    columns, however many, that have a value in every row of the file.
    """
    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m")]
    held = cut(spark.read.text(path).select(F.col("_metadata.file_name").alias("bed_id"), *meta, F.split("value", "\t").alias("f")))
    blocks = held.groupBy("_path", "_at").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    rows = held.where(F.trim(F.array_join("f", "")) != "").join(blocks.select("_path", "_at", (before - F.col("_lo")).alias("_less")), ["_path", "_at"])
    got = rows.select("bed_id", (F.col("_m") + F.col("_less")).alias("row_idx"), F.col("f")[0].alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("start"), F.get("f", F.lit(2)).try_cast("long").alias("end"), F.expr("slice(f, 4, greatest(size(f) - 3, 0))").alias("rest"))
    bad = F.col("start").isNull() | F.col("end").isNull()
    gaps = F.filter(F.transform("rest", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    files = cut(
        got.groupBy("bed_id").agg(
            F.min(F.when(~bad, F.col("row_idx"))).alias("first"), F.max(F.when(bad, F.col("row_idx"))).alias("last"), F.count(F.when(bad, 1)).alias("bad"), F.min(F.when(~bad, F.size("rest"))).alias("wide"), F.array_distinct(F.flatten(F.collect_set(F.when(~bad, gaps)))).alias("gaps")
        )
    )
    if not files.where((F.col("bad") > MOST_HEADERS) | F.col("first").isNull() | (F.col("last") > F.col("first"))).isEmpty():
        raise BedFileError(f"rows that are no regions: {path}")
    kept = F.filter("rest", lambda x, i: (i < F.col("wide")) & ~F.array_contains("gaps", i))
    return got.where(~bad).join(files.select("bed_id", "wide", "gaps"), "bed_id").withColumn("rest", kept).drop("wide", "gaps")


def read_bed_list(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """The region sets that a list file names, one a line, relative to ``folder``."""
    names = [r["value"].strip() for r in spark.read.text(path).collect()]  # a line a file
    return read_bed(spark, [f"{folder.rstrip('/')}/{n}" if folder else n for n in names if n])


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines of a BED file that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_bedgraph(spark: SparkSession, path: str, track: str = "core") -> DataFrame:
    """chrom, start, end, cov, track of a bedGraph file: depths without fraction, runs of 0 left out."""
    x = spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, value double", comment="#")
    return x.where("start is not null and not isnan(value)").select("chrom", "start", "end", F.floor("value").alias("cov"), F.lit(track).alias("track")).where("cov > 0")


def read_tokens(spark: SparkSession, path: str, as_text: bool = False, seed: int | None = None) -> DataFrame:
    """Token documents (tokens array) from Parquet, as text if asked, in a seeded random order within each if a seed is given."""
    docs = spark.read.parquet(path)
    if seed is not None:
        key = F.md5(F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string"))))
        tagged = F.transform("tokens", lambda t, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, i.cast("string"))).alias("h"), t.alias("t")))
        docs = docs.withColumn("tokens", F.transform(F.array_sort(tagged), lambda x: x["t"]))
    return docs.withColumn("tokens", F.transform("tokens", lambda t: t.cast("string"))) if as_text else docs


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, v of vectors in Parquet, or in JSON lines by extension."""
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return raw.withColumn("v", F.col("v").cast("array<float>"))


def read_cells(spark: SparkSession, counts: str, features: str) -> tuple[DataFrame, DataFrame]:
    """Counts (cell, feature, n) and features (feature, chrom, start, end) of a single-cell matrix in coordinate form, from Parquet."""
    return spark.read.parquet(counts).select("cell", "feature", "n"), spark.read.parquet(features).select("feature", "chrom", "start", "end")


#: The first bytes of a gzip file (fixed value).
GZIP = "1f8b"


def gzipped(spark: SparkSession, path: str) -> DataFrame:
    """path, by_name, by_content: whether files are gzip by their extension and by their first bytes."""
    x = spark.read.format("binaryFile").load(path)
    return x.select("path", F.col("path").endswith(".gz").alias("by_name"), (F.lower(F.hex(F.substring("content", 1, 2))) == GZIP).alias("by_content"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size, weight (its share of all)."""
    x = spark.read.csv(path, sep="\t", schema="chrom string, size long")
    return x.crossJoin(F.broadcast(x.agg(F.sum("size").alias("_all")))).select("chrom", "size", (F.col("size") / F.col("_all")).alias("weight"))  # one row


#: The columns of a MAF file that are read (fixed values).
MAF_COLUMNS = ("Hugo_Symbol", "Entrez_Gene_Id", "Center", "NCBI_Build", "Chromosome", "Start_position", "End_position", "Strand")


def read_maf(spark: SparkSession, path: str, *, extend: bool = False, plain: bool = False, raw: bool = False) -> DataFrame:
    """Mutations with a chr prefix (unless ``plain``); ``extend`` adds one to the end.  Missing columns are null.  ``raw``: the texts as they stand."""
    got = spark.read.csv(path, sep="\t", header=True, comment="#")
    x = got.select(*[F.col(n) if n in got.columns else F.lit(None).cast("string").alias(n) for n in MAF_COLUMNS])
    if raw:
        return x
    chrom = F.col("Chromosome") if plain else F.concat(F.lit("chr"), F.col("Chromosome"))
    return x.withColumns({"Chromosome": chrom, "Start_position": F.col("Start_position").cast("long"), "End_position": F.col("End_position").cast("long") + int(extend)})


def maf_regions(maf: DataFrame) -> DataFrame:
    """chrom, start, end of mutations; one that begins where it ends is one position wide."""
    return maf.select(F.col("Chromosome").alias("chrom"), F.col("Start_position").alias("start"), snp_end(F.col("Start_position"), F.col("End_position")).alias("end"))


def write_bed(regions: DataFrame, path: str, compressed: bool = False) -> None:
    """Tab-separated rows by chrom, start, end, without a header; refuses to overwrite."""
    keep = [c for c in ("chrom", "start", "end", "mod") if c in regions.columns]
    regions.select(keep).orderBy("chrom", "start", "end").write.csv(path, sep="\t", compression="gzip" if compressed else "none")
