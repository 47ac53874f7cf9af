"""The command line: ``python -m intervale.cli COMMAND ...``; every command reads paths and writes a folder.

Commands: build-universe (cc, ccf, ml, hmm), tokenize, assess-universe, lh, perturb, eval (gdst, npt, ctt, rct), train,
train-map, apply-map, encode-cells, labels (l2r, r2l, r2r), search, cache (add, seek, remove, list).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators import catalog, encode, evaluate, intervals, labels, network, perturb, search, tokens, universe
from intervale.session import cut, session
from intervale.sources import bed, sinks


def _universe(spark: SparkSession, path: str) -> DataFrame:
    """uid, chrom, start, end of a BED file, and its core where it has eight columns."""
    x = bed.read_bed(spark, path)
    flexible = universe.is_flexible(3 + (x.agg(F.min(F.size("rest"))).first()[0] or 0))
    core = [F.get("rest", F.lit(k)).cast("long").alias(n) for k, n in ((3, "core_start"), (4, "core_end"))] if flexible else []
    return x.select(F.col("row_idx").alias("uid"), "chrom", "start", "end", *core)


def _tracks(regions: DataFrame) -> DataFrame:
    merged = intervals.merge(regions, "bed_id")
    parts = {"core": intervals.coverage(merged), "start": intervals.boundary_coverage(merged, "start", 0), "end": intervals.boundary_coverage(merged, "end", 0)}
    parts = [x.withColumn("track", F.lit(k)) for k, x in parts.items()]
    return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def build_universe(spark, a) -> None:
    regions, sizes = bed.read_bed(spark, a.regions), bed.read_chrom_sizes(spark, a.chrom_sizes).select("chrom", "size")
    if a.method in ("cc", "ccf"):
        cov = cut(intervals.coverage(regions))
        out = universe.cc(cov, sizes, a.cutoff, a.merge, a.filter_size) if a.method == "cc" else universe.ccf(cov, sizes)
    else:
        tracks = _tracks(regions)
        segments = cut(intervals.nonzero_segments(intervals.coverage(tracks), sizes))
        files = regions.select("bed_id").distinct().count()
        if a.method == "ml":
            out = universe.maximum_likelihood(tracks, segments, cut(universe.track_models(tracks, sizes, files)))
        else:
            normal = tracks.withColumn("value", F.col("cov")) if a.not_normalize else universe.normalised_tracks(tracks)
            out = universe.hidden_states(normal, segments)
    sinks.write_universe(out, a.output)


def tokenize(spark, a) -> None:
    found = intervals.tokenize(bed.read_bed(spark, a.regions), _universe(spark, a.universe), a.fraction, "bed_id")
    sinks.write_tokens(found, a.output, a.name)


def assess(spark, a) -> None:
    out = universe.assessment(bed.read_bed(spark, a.regions), _universe(spark, a.universe))
    sinks.write_assessment(out, a.output)


def lh(spark, a) -> None:
    regions, sizes = bed.read_bed(spark, a.regions), bed.read_chrom_sizes(spark, a.chrom_sizes).select("chrom", "size")
    model = universe.track_models(_tracks(regions), sizes, regions.select("bed_id").distinct().count())
    sinks.write_model(model, a.output, a.force)


def perturbed(spark, a) -> None:
    def read(path: str) -> DataFrame:
        return bed.read_bed(spark, path).select("row_idx", "chrom", "start", "end")

    rows = read(a.bed).withColumn("mod", F.lit("-"))
    sizes = bed.read_chrom_sizes(spark, a.chrom_sizes).select("chrom", "size") if a.chrom_sizes else None

    def once(x: DataFrame, seed: int) -> DataFrame:
        if a.yaml:
            return perturb.yaml_program(x, a.yaml, read, sizes=sizes, seed=seed)
        rates = {f"{k}_rate": getattr(a, f"{k}rate") for k in ("shift", "add", "cut", "merge", "drop")}
        return perturb.all_perturbations(x, sizes, seed, **rates, mean=a.shiftmean, sd=a.shiftstdev, add_mean=a.addmean, add_sd=a.addstdev)

    out = once(rows, a.seed) if a.repeat == 1 else perturb.repeated(rows, a.repeat, a.seed, once)
    if a.repeat == 1:
        bed.write_bed(out, a.output)
    else:
        out.select("chrom", "start", "end", "mod", "rep_id").write.partitionBy("rep_id").csv(a.output, sep="\t")


def evaluation(spark, a) -> None:
    x = spark.read.parquet(a.embeddings)  # region, v
    from intervale.functions.regions import parse_region

    numbered = cut(x.withColumn("id", F.monotonically_increasing_id()))
    regions = numbered.select(F.col("id").alias("uid"), parse_region(F.col("region")).alias("r")).select("uid", "r.*")
    vectors = numbered.select("id", "v")
    if a.test == "gdst":
        one, other = (regions.join(vectors.withColumnRenamed("id", "uid"), "uid").select(F.col("uid").alias(k), F.col("start").alias(f"s{i}"), F.col("end").alias(f"e{i}"), F.col("v").alias(f"v{i}")) for i, k in ((1, "uid"), (2, "other")))
        out = evaluate.gdst(evaluate.region_pairs(regions, a.seed).join(one, "uid").join(other, "other"))
    elif a.test == "npt":
        out = evaluate.neighbourhood_preservation(regions, vectors, a.K, step=a.resolution, samples=a.samples, seed=a.seed)
    elif a.test == "ctt":
        out = evaluate.clustering_tendency(vectors, a.most, a.seed)
    else:
        rows = numbered.select("id", "v", "b")
        out = network.reconstruction(rows, hidden=(a.hidden,), seed=a.seed) if a.hidden else evaluate.reconstruction(rows, seed=a.seed)
    out.write.csv(a.output, header=True)


def train(spark, a) -> None:
    docs = bed.read_tokens(spark, a.tokens, as_text=True, seed=a.seed).select(F.array_join("tokens", " ").alias("sentence"))
    words = tokens.train_embeddings(docs, a.width, a.min_count, a.epochs, a.seed, a.partitions)
    sinks.export_model(words.select(F.col("word").alias("id"), "v"), a.output)


def train_map(spark, a) -> None:
    net = network.train(spark.read.parquet(a.pairs), hidden=(a.hidden,), loss=a.loss, rounds=a.rounds, seed=a.seed)
    net.save(spark, a.output)


def apply_map(spark, a) -> None:
    network.load(spark, a.model).predict(spark.read.parquet(a.vectors)).write.parquet(a.output)


def encode_cells(spark, a) -> None:
    counts, features = bed.read_cells(spark, a.counts, a.features)
    vocab = encode.vocabulary(_universe(spark, a.universe))
    known, _ = sinks.load_model(spark, a.model)
    encode.encode_cells(encode.cell_tokens(counts, features, vocab), known.withColumn("id", F.col("id").cast("long"))).write.parquet(a.output)


def search_labels(spark, a) -> None:
    table = spark.read.csv(a.distances, header=True, inferSchema=True)
    found = {"l2r": lambda: labels.files_of_label(table, a.query, a.num), "r2l": lambda: labels.labels_of_file(table, a.query), "r2r": lambda: labels.files_of_file(table, a.query, a.num)}[a.type]()
    found.write.csv(a.output, header=True)


def search_vectors(spark, a) -> None:
    asked = bed.read_vectors(spark, a.queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    search.knn(asked, bed.read_vectors(spark, a.vectors), a.limit, a.measure, a.offset).write.parquet(a.output)


def region_cache(spark, a) -> None:
    cache = catalog.Cache(spark, a.cache)
    if a.action == "add":
        print(cache.add(bed.read_bed(spark, a.name).select("row_idx", "chrom", "start", "end")))
    elif a.action == "list":
        print("\n".join(cache.list(a.kind)))
    elif a.action == "seek":
        print(cache.seek(a.name))
    else:
        cache.remove(a.name)


def parser() -> argparse.ArgumentParser:
    """Every command's arguments."""
    top = argparse.ArgumentParser(prog="intervale")
    commands = top.add_subparsers(dest="command", required=True)

    def command(title: str, run, *needed: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(title)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            p.add_argument(f"--{n.replace('_', '-')}", **kind)
        p.set_defaults(run=run)
        return p

    p = command("build-universe", build_universe, "regions", "chrom-sizes", "output", merge=0, filter_size=0, not_normalize=False)
    p.add_argument("method", choices=("cc", "ccf", "ml", "hmm"))
    p.add_argument("--cutoff", type=float)
    command("tokenize", tokenize, "regions", "universe", "output", fraction=1e-9, name="universe")
    command("assess-universe", assess, "regions", "universe", "output")
    command("lh", lh, "regions", "chrom-sizes", "output", force=False)
    rates = {f"{k}rate": 0.0 for k in ("shift", "add", "cut", "merge", "drop")}
    command("perturb", perturbed, "bed", "output", chrom_sizes=None, yaml=None, seed=42, repeat=1, shiftmean=0.0, shiftstdev=150.0, addmean=320.0, addstdev=30.0, **rates)
    p = command("eval", evaluation, "embeddings", "output", K=50, resolution=10, samples=100, most=10_000, hidden=0, seed=42)
    p.add_argument("test", choices=("gdst", "npt", "ctt", "rct"))
    command("train", train, "tokens", "output", width=100, min_count=5, epochs=1, seed=1, partitions=1)
    command("train-map", train_map, "pairs", "output", hidden=256, loss="cosine", rounds=100, seed=1)
    command("apply-map", apply_map, "vectors", "model", "output")
    command("encode-cells", encode_cells, "counts", "features", "universe", "model", "output")
    p = command("labels", search_labels, "distances", "query", "output", num=10)
    p.add_argument("type", choices=("l2r", "r2l", "r2r"))
    command("search", search_vectors, "vectors", "queries", "output", limit=10, offset=0, measure="cosine")
    p = command("cache", region_cache, cache=None, kind="bedfiles")
    p.add_argument("action", choices=("add", "seek", "remove", "list"))
    p.add_argument("name", nargs="?", default="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.getActiveSession() or session(), a)


if __name__ == "__main__":
    main()
