"""Sources, sinks, functions, encoding, indexes, the cache, streams and the command line."""

import gzip
import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale import cli
from intervale.functions import regions as fn
from intervale.operators import catalog, encode, evaluate, index, intervals, labels, search, tokens, universe
from intervale.plans import catalogue
from intervale.sources import bed, sinks
from intervale.streaming.tokenize import stream_tokens

D = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_functions(spark):
    lit = F.lit
    r = one(
        spark, key=fn.region_key(lit("chr1"), lit(5), lit(9)), word=fn.region_key(lit("chr1"), lit(5), lit(9), "_"), snpr=fn.snpr(lit(0.5), lit(0.05)), none=fn.snpr(lit(0.0), lit(0.5)), first=fn.first_chromosome(lit("chr10"), lit("chr2"), lit("chrX")),
        line=fn.region_of_line(lit("chr1\t5\t9\tx")), h=fn.time_text(lit(7200.0)), m=fn.time_text(lit(90.0)), s=fn.time_text(lit(1.234)), label=fn.label_word(lit("t")), back=fn.label_of(lit("__label__t")), field=fn.payload_field(lit('{"a": {"b": 3}}'), "a.b"),
        kept=fn.random_subset(F.array(*[lit(k) for k in range(20)]), 6, 1, lit("k")), all=fn.random_subset(F.array(lit(1)), 6, 1, lit("k")), mask=fn.mask(F.array(lit(1), lit(0)), 0), end=fn.snp_end(lit(5), lit(5)), same=fn.snp_end(lit(5), lit(6)), f=fn.single_precision(F.array(lit(0.1))),
    )
    assert r["key"] == "chr1:5-9" and r["word"] == "chr1_5_9" and abs(r["snpr"] - 1) < 1e-6 and r["none"] == 0 and r["first"] == "chr2" and tuple(r["line"]) == ("chr1", 5, 9)
    assert (r["h"], r["m"], r["s"]) == ("2.00h", "1.50m", "1.23s") and r["label"] == "__label__t" and r["back"] == "t" and r["field"] == "3"
    assert len(r["kept"]) == 6 and r["kept"] == sorted(r["kept"]) and r["all"] == [1] and r["mask"] == [True, False] and (r["end"], r["same"]) == (6, 6) and r["f"][0] != 0.1


def test_row_numbers_follow_lines(spark, tmp_path):
    lines = [f"chr{k % 3}\t{k}\t{k + 5}" if k % 50 else "" for k in range(1, 6001)]
    (tmp_path / "a.bed").write_text("track\n" + "\n".join(lines) + "\n")
    (tmp_path / "b.bed").write_text("chr1\t7\t9\n" * 3)
    with gzip.open(tmp_path / "c.bed.gz", "wt") as f:
        f.write("chr1\t1\t2\n\nchr1\t3\t4\n")
    want = sorted([("a.bed", k, k) for k in range(1, 6001) if k % 50] + [("b.bed", 6001 + k, 7) for k in range(3)] + [("c.bed.gz", 6004, 1), ("c.bed.gz", 6006, 3)])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (was, "7000", "1111"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = bed.read_bed(spark, f"{tmp_path}/*.bed*")
            assert sorted((r["bed_id"], r["row_idx"], r["start"]) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_readers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr2\t5\t9\n\nchr1\t1\t3\n")
    (tmp_path / "list.txt").write_text("a.bed\n")
    assert bed.count_rows(spark, str(tmp_path / "a.bed")) == 2 and bed.read_bed_list(spark, str(tmp_path / "list.txt"), str(tmp_path)).count() == 2
    assert intervals.unsorted_rows(bed.read_bed(spark, str(tmp_path / "a.bed"))).count() == 1
    (tmp_path / "c.bedgraph").write_text("chr1\t0\t5\t2.7\nchr1\t5\t9\t0\nchr1\t9\t12\tNaN\n")
    assert [(r["start"], r["end"], r["cov"]) for r in bed.read_bedgraph(spark, str(tmp_path / "c.bedgraph")).collect()] == [(0, 5, 2)]
    (tmp_path / "s.sizes").write_text("chr1\t30\nchr2\t10\n")
    assert {r["chrom"]: r["weight"] for r in bed.read_chrom_sizes(spark, str(tmp_path / "s.sizes")).collect()} == {"chr1": 0.75, "chr2": 0.25}
    (tmp_path / "m.maf").write_text("#version\nHugo_Symbol\tChromosome\tStart_position\tEnd_position\nA\t1\t5\t5\nB\tX\t7\t9\n")
    maf = bed.read_maf(spark, str(tmp_path / "m.maf"))
    assert [(r["chrom"], r["start"], r["end"]) for r in bed.maf_regions(maf).collect()] == [("chr1", 5, 6), ("chrX", 7, 9)]
    assert maf.first()["Center"] is None and maf.first()["Hugo_Symbol"] == "A" and bed.read_maf(spark, str(tmp_path / "m.maf"), raw=True).first()["Chromosome"] == "1"
    assert bed.read_maf(spark, str(tmp_path / "m.maf"), extend=True, plain=True).first()["End_position"] == 6
    docs = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8],)], "tokens array<int>")
    docs.write.parquet(f"{tmp_path}/tokens")
    got = bed.read_tokens(spark, f"{tmp_path}/tokens", as_text=True, seed=3).first()["tokens"]
    assert sorted(got) == [str(k) for k in range(1, 9)] and got != sorted(got) and bed.read_tokens(spark, f"{tmp_path}/tokens").first()["tokens"] == list(range(1, 9))
    (tmp_path / "v.jsonl").write_text('{"id": 1, "v": [0.5, 1]}\n')
    assert bed.read_vectors(spark, f"{tmp_path}/v.jsonl").first()["v"] == [0.5, 1.0]
    bed.write_bed(bed.read_bed(spark, str(tmp_path / "a.bed")), f"{tmp_path}/out", compressed=True)
    assert [r["chrom"] for r in bed.read_bed(spark, f"{tmp_path}/out").orderBy("row_idx").collect()] == ["chr1", "chr2"]
    assert {(r["by_name"], r["by_content"]) for r in bed.gzipped(spark, f"{tmp_path}/out/*.gz").collect()} == {(True, True)}
    assert {(r["by_name"], r["by_content"]) for r in bed.gzipped(spark, f"{tmp_path}/a.bed").collect()} == {(False, False)}


def test_writers(spark, tmp_path):
    keys = spark.createDataFrame([("chr1:5-9", 1)], "region string, id long")
    sinks.write_vocabulary_regions(keys, f"{tmp_path}/v")
    assert bed.read_bed(spark, f"{tmp_path}/v").first()["end"] == 9
    sinks.write_vocabulary(keys.withColumnRenamed("region", "token"), f"{tmp_path}/w")
    assert spark.read.text(f"{tmp_path}/w").first()["value"] == "chr1:5-9\t1"
    flexible = spark.createDataFrame([("chr1", 5, 7, 9, 12, 3)], "chrom string, start long, core_start long, core_end long, end long, top long")
    sinks.write_universe(flexible, f"{tmp_path}/f")
    assert spark.read.text(f"{tmp_path}/f").first()["value"] == "chr1\t5\t12\tuniverse\t3\t.\t7\t9\t0,0,255"
    with pytest.raises(Exception, match="already exists"):
        sinks.write_universe(flexible.select("chrom", "start", "end"), f"{tmp_path}/f")
    model = spark.createDataFrame([("chr1", 0, -1.0), ("chr2", 1, -2.0)], "chrom string, cov long, bg double")
    for force in (False, False, True):
        sinks.write_model(model, f"{tmp_path}/m", force)
    assert sinks.read_model(spark, f"{tmp_path}/m").count() == 2
    part = sinks.read_model(spark, f"{tmp_path}/m", "chr2")
    assert part.count() == 1 and "PartitionFilters: [isnotnull(chrom" in part._jdf.queryExecution().toString()
    sinks.write_tokens(keys.select("id"), f"{tmp_path}/t", "u1")
    assert spark.read.parquet(f"{tmp_path}/t").first()["universe"] == "u1"
    sinks.write_lines(keys, "region", f"{tmp_path}/l")
    sinks.write_rows(keys, f"{tmp_path}/r")
    sinks.write_assessment(keys, f"{tmp_path}/a")
    sinks.write_distances(keys.withColumnRenamed("id", "bed_id"), f"{tmp_path}/d")
    assert spark.read.text(f"{tmp_path}/l").first()["value"] == "chr1:5-9" and spark.read.csv(f"{tmp_path}/a", header=True).columns == ["region", "id"] and spark.read.parquet(f"{tmp_path}/d").where("bed_id = 1").count() == 1
    sinks.export_model(spark.createDataFrame([("x", [1.0, 2.0])], "id string, v array<double>"), f"{tmp_path}/e", name="n")
    vectors, config = sinks.load_model(spark, f"{tmp_path}/e")
    assert vectors.first()["v"] == [1.0, 2.0] and config == {"vocab_size": 1, "embedding_dim": 2, "name": "n"}


def test_vocabulary_and_encoding(spark):
    u = spark.createDataFrame([(5, "chr1", 0, 10), (7, "chr1", 20, 30), (9, "chr2", 0, 5)], "uid long, chrom string, start long, end long")
    vocab = encode.vocabulary(u)
    assert [(r["token"], r["id"]) for r in vocab.orderBy("id").collect()][:4] == [("chr1:0-10", 0), ("chr1:20-30", 1), ("chr2:0-5", 2), ("<unk>", 3)] and vocab.count() == 3 + 7
    r = spark.createDataFrame([(0, 1, "chr1", 5, 25), (0, 2, "chr3", 1, 2), (0, 3, "chr2", 4, 9)], "bed_id int, row_idx long, chrom string, start long, end long")
    rows = encode.token_rows(r, vocab, "bed_id")
    assert sorted((x["row_idx"], x["id"]) for x in rows.collect()) == [(1, 0), (1, 1), (2, 3), (3, 2)]
    known = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 1.0]), (4, [9.0, 9.0])], "id long, v array<double>")
    got = {x["row_idx"]: x["v"] for x in encode.encode_regions(rows, known, "bed_id").collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: [0.0, 1.0]}
    assert encode.encode_files(encode.encode_regions(rows, known, "bed_id")).first()["v"] == [1.0, 2.5]
    assert encode.file_vectors(rows, known).first()["v"] == [1.0, 2.5]
    assert {x["row_idx"]: x["v"] for x in encode.encode_regions(rows, known, "bed_id", how="max").collect()}[1] == [3.0, 6.0]
    assert {x["region"] for x in encode.model_embeddings(known, vocab).collect()} == {"chr1:0-10", "chr1:20-30", "chr2:0-5"}
    assert [x["region"] for x in encode.ordered_regions(spark.createDataFrame([("chr10:1-2",), ("chr2:9-10",), ("chr2:1-5",)], "region string")).collect()] == ["chr2:1-5", "chr2:9-10", "chr10:1-2"]
    features = spark.createDataFrame([(1, "chr1", 5, 25), (2, "chr9", 0, 1)], "feature long, chrom string, start long, end long")
    counts = spark.createDataFrame([("c", 1, 2), ("c", 2, 0), ("d", 2, 1)], "cell string, feature long, n long")
    cells = encode.cell_tokens(counts, features, vocab)
    assert sorted((x["cell"], x["id"]) for x in cells.collect()) == [("c", 0), ("c", 1), ("d", 3)]
    assert {x["cell"]: x["v"] for x in encode.encode_cells(cells, known).collect()} == {"c": [2.0, 4.0], "d": None}
    assert encode.triplets(spark.createDataFrame([(1, "a"), (2, "a")], "id long, k string"), "k", 1).count() == 0


def test_index_with_payloads_texts_and_tags(spark):
    rows = spark.createDataFrame([([1.0, 0.0], "x"), ([0.0, 1.0], "y")], "v array<double>, name string")
    one_, two = index.VectorIndex().load(rows, "name"), index.VectorIndex().load(rows.limit(1), "name")
    both = index.VectorIndex.merged(one_.load(rows, "name"), two)
    assert len(one_) == 4 and len(both) == 5 and sorted(r["id"] for r in both.rows.collect()) == list(range(5))
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, q array<double>")
    got = one_.search(asked, 2, offset=1, with_vectors=False).orderBy("place").collect()
    assert [(r["place"], r["payload"]) for r in got] == [(1, "x"), (2, "y")] and "v" not in got[0].asDict()
    assert one_.retrieve(spark.createDataFrame([(0,), (77,)], "id long")).count() == 1
    texts = spark.createDataFrame([(0, "liver cells"), (1, "brain tissue"), (2, "Liver  tissue")], "id long, text string")
    own = index.VectorIndex().load(index.text_vectors(texts, "id", "text"))
    find = index.TextSearch(own)
    queries = texts.select(F.col("id").alias("query_id"), "text")
    assert all(r["score"] > 0.999 and r["id"] == r["query_id"] for r in find.query(queries, 1).collect())
    relevant = spark.createDataFrame([(0, 0), (1, 1)], "query_id long, id long")
    assert find.evaluate(queries, relevant).first()["map"] == 1.0
    named = spark.createDataFrame([(0, "liver", [0, 2]), (1, "brain", [1])], "id long, text string, files array<long>")
    tags = index.VectorIndex().load(index.text_vectors(named, "id", "text").join(named.select("id", "files"), "id"), "files")
    found = index.BiVectorSearch(tags, own).query(spark, "liver", 2).orderBy("place").collect()
    assert [r["id"] for r in found] == [0, 2] and found[0]["value"] > 0.9
    assert index.with_attributes(one_.search(asked, 1), spark.createDataFrame([("x", "human")], "file string, genome string")).first()["genome"] == "human"
    regions = spark.createDataFrame([(0, 1, "chr1", 0, 5)], "bed_id int, row_idx long, chrom string, start long, end long")
    vocab = encode.vocabulary(spark.createDataFrame([(1, "chr1", 0, 9)], "uid long, chrom string, start long, end long"))
    known = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>")
    assert index.RegionSearch(one_, vocab, known).query(regions, 1, with_payload=False).first()["score"] > 0.999


def test_cache_on_a_cluster_names_its_folder(monkeypatch):
    monkeypatch.delenv(catalog.CACHE_VARIABLE, raising=False)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://there:7077"))
    with pytest.raises(ValueError):
        catalog.Cache(cluster)
    assert catalog.Cache(cluster, "hdfs://shared/").folder == "hdfs://shared"


def test_likelihood_of_models_too_large_to_broadcast(spark, monkeypatch):
    want = [sorted(catalogue.queries()[q](spark, D).collect()) for q in ("lh_hard", "lh_flexible")]
    monkeypatch.setattr(universe, "BROADCAST_DEPTHS", 0)
    assert [sorted(catalogue.queries()[q](spark, D).collect()) for q in ("lh_hard", "lh_flexible")] == want and all(want)


def test_cache_of_sets_and_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(catalog.CACHE_VARIABLE, str(tmp_path / "cache"))
    cache = catalog.Cache(spark)
    rows = [spark.createDataFrame([(0, "chr1", k, k + 5)], "row_idx long, chrom string, start long, end long") for k in (1, 2)]
    names = [cache.add(r) for r in rows]
    group = cache.add_set(names)
    assert cache.list("bedsets") == [group] and cache.members(group) == names and cache.load_set(group).count() == 2 and "/bedsets/" in cache.seek(group)
    assert group != cache.add_set(names[::-1])
    cache.add_tokens("u", names[0], spark.createDataFrame([(1,)], "id long"))
    assert cache.load_tokens("u", names[0]).first()["id"] == 1
    cache.remove_tokens("u", names[0])
    with pytest.raises(catalog.TokensNotFoundError):
        cache.load_tokens("u", names[0])
    cache.remove(group, members=True)
    assert cache.list() == [] and not (tmp_path / "cache/bedfiles" / names[0][0] / names[0][1]).exists()
    with pytest.raises(catalog.RegionSetNotFoundError):
        cache.members(group)
    lazy = catalog.Cache(spark, str(tmp_path / "lazy"), lambda i: rows[0], lambda i: ["ab" * 16])
    assert lazy.load_set("cd" * 16).count() == 1 and lazy.list() == ["ab" * 16]


def test_identifiers_across_batches(spark):
    import hashlib

    x = spark.createDataFrame([(f"f{i % 3}", i, f"chr{i % 4}", i, i + 7) for i in range(300)], "bed_id string, row_idx long, chrom string, start long, end long")
    key, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {r["bed_id"]: r["identifier"] for r in catalog.identifiers(x).collect()}
    finally:
        spark.conf.set(key, was)
    for f in range(3):
        own = [(f"chr{i % 4}", i, i + 7) for i in range(f, 300, 3)]
        sums = [hashlib.md5(",".join(str(r[k]) for r in own).encode()).hexdigest() for k in range(3)]
        assert got[f"f{f}"] == hashlib.md5(",".join(sums).encode()).hexdigest()


def test_labels_and_sentences(spark):
    files = spark.createDataFrame([("a", "T1", [1.0, 0.0]), ("b", "T2", [0.0, 1.0])], "filename string, file_label string, v array<double>")
    terms = spark.createDataFrame([("T1", [1.0, 0.1]), ("T2", [0.1, 1.0])], "search_term string, v array<double>")
    x = labels.label_distances(files, terms)
    assert labels.label_similarities(x, keep_near=True).count() == 2 and labels.label_similarities(x).count() == 2
    assert [r["filename"] for r in labels.files_of_label(labels.label_similarities(x, keep_near=True), "t1").collect()] == ["a"]
    assert {(r["label"], r["predicted"], r["n"]) for r in labels.confusion(labels.predicted_labels(x), files.select("filename", F.col("file_label").alias("label"))).collect()} == {("T1", "T1", 1), ("T2", "T2", 1)}
    weighted = spark.createDataFrame([(1, "x", 1.0), (1, "y", 3.0), (2, "z", 2.0)], "id long, token string, weight double")
    got = {r["id"]: r["sentence"].split() for r in tokens.sampled_sentences(weighted, 400, 1).collect()}
    assert len(got[1]) == 400 and 0.65 < got[1].count("y") / 400 < 0.85 and set(got[2]) == {"z"}


def test_trained_words_that_share_sentences_are_near(spark):
    docs = spark.createDataFrame([(" ".join((["a", "b", "c"] if i % 2 else ["x", "y", "z"]) * 6),) for i in range(300)], "sentence string")
    v = {r["word"]: r["v"] for r in tokens.train_embeddings(docs, width=8, least=1, passes=5).collect()}

    def cos(p, q):
        return sum(a * b for a, b in zip(v[p], v[q])) / (sum(a * a for a in v[p]) * sum(b * b for b in v[q])) ** 0.5

    assert set(v) == set("abcxyz") and min(cos("a", "b"), cos("x", "y")) > max(cos("a", "x"), cos("b", "z"))
    x = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 2)], i % 2) for i in range(20)], "id long, v array<double>, label int")
    parts = evaluate.principal_components(x, 1).collect()
    assert abs(sum(r["p"][0] for r in parts)) < 1e-9 and len({r["p"][0] for r in parts}) == 20
    apart = spark.createDataFrame([(i, [100.0 * (i % 2) + i / 50, 0.0], i % 2) for i in range(20)], "id long, v array<double>, label int")
    assert evaluate.clustered_ari(apart, 2, 1).first()["ari"] == 1.0


def test_stream_against_the_batch_join(spark, tmp_path):
    r, u = catalogue.regions(spark, D).limit(500), catalogue.the_universe(spark, D)
    r.repartition(3).write.parquet(f"{tmp_path}/in")
    q = stream_tokens(spark, f"{tmp_path}/in", "bed_id int, chrom string, start long, end long, row_idx long", u, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    want = intervals.interval_join(spark.read.parquet(f"{tmp_path}/in"), catalogue.right(u)).select("bed_id", "chrom", "start", "end", "uid")
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want.collect()) and want.count()


def test_command_line(spark, tmp_path):
    rows = catalogue.regions(spark, D).where("chrom = 'chr1'").select("chrom", "start", "end").limit(400).collect()
    for k in (0, 1):
        (tmp_path / f"f{k}.bed").write_text("".join(f"{r['chrom']}\t{r['start']}\t{r['end']}\n" for r in rows[k::2]))
    (tmp_path / "sizes").write_text("chr1\t9000\n")
    files, sizes = f"{tmp_path}/f*.bed", f"{tmp_path}/sizes"

    def run(*argv):
        cli.main(list(argv), spark)

    for m in ("cc", "ccf", "ml", "hmm"):
        run("build-universe", m, "--regions", files, "--chrom-sizes", sizes, "--output", f"{tmp_path}/u_{m}")
    assert bed.read_bed(spark, f"{tmp_path}/u_cc").count() and bed.read_bed(spark, f"{tmp_path}/u_ml").count()
    run("tokenize", "--regions", files, "--universe", f"{tmp_path}/u_cc", "--output", f"{tmp_path}/tok")
    run("assess-universe", "--regions", files, "--universe", f"{tmp_path}/u_cc", "--output", f"{tmp_path}/ass")
    assert spark.read.csv(f"{tmp_path}/ass", header=True).count() == 2 and spark.read.parquet(f"{tmp_path}/tok").count()
    run("lh", "--regions", files, "--chrom-sizes", sizes, "--output", f"{tmp_path}/lh")
    assert {r["track"] for r in sinks.read_model(spark, f"{tmp_path}/lh").collect()} == {"start", "core", "end"}
    run("perturb", "--bed", f"{tmp_path}/f0.bed", "--chrom-sizes", sizes, "--droprate", "0.5", "--repeat", "2", "--output", f"{tmp_path}/rep")
    assert spark.read.csv(f"{tmp_path}/rep", sep="\t").count() == 200
    run("perturb", "--bed", f"{tmp_path}/f0.bed", "--chrom-sizes", sizes, "--droprate", "0.5", "--output", f"{tmp_path}/drop")
    assert bed.read_bed(spark, f"{tmp_path}/drop").count() == 100
    v = spark.read.parquet(f"{D}/embeddings.parquet").select(F.concat(F.lit("chr"), (1 + F.col("vec_id") % 2).cast("string"), F.lit(":"), (F.col("vec_id") * 10).cast("string"), F.lit("-"), (F.col("vec_id") * 10 + 5).cast("string")).alias("region"), F.col("embedding").alias("v"), F.array(F.col("embedding")[0].cast("double")).alias("b"))
    v.write.parquet(f"{tmp_path}/emb")
    for t in ("gdst", "npt", "ctt", "rct"):
        run("eval", t, "--embeddings", f"{tmp_path}/emb", "--output", f"{tmp_path}/e_{t}", "--K", "10")
        assert spark.read.csv(f"{tmp_path}/e_{t}", header=True).count()
    run("eval", "rct", "--embeddings", f"{tmp_path}/emb", "--output", f"{tmp_path}/e_net", "--hidden", "4")
    assert spark.read.csv(f"{tmp_path}/e_net", header=True).count() == 5
    spark.read.parquet(f"{D}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.slice("embedding", 1, 3).alias("y")).write.parquet(f"{tmp_path}/pairs")
    run("train-map", "--pairs", f"{tmp_path}/pairs", "--output", f"{tmp_path}/net", "--hidden", "8", "--rounds", "5")
    run("apply-map", "--vectors", f"{tmp_path}/pairs", "--model", f"{tmp_path}/net", "--output", f"{tmp_path}/mapped")
    assert all(len(r["p"]) == 3 for r in spark.read.parquet(f"{tmp_path}/mapped").collect())
    spark.createDataFrame([([1, 2, 3, 1, 2, 3],)] * 5, "tokens array<int>").write.parquet(f"{tmp_path}/docs")
    run("train", "--tokens", f"{tmp_path}/docs", "--width", "4", "--min-count", "1", "--output", f"{tmp_path}/r2v")
    assert sinks.load_model(spark, f"{tmp_path}/r2v")[1] == {"vocab_size": 3, "embedding_dim": 4}
    spark.createDataFrame([("c", 1, 2)], "cell string, feature long, n long").write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([(1, rows[0]["chrom"], rows[0]["start"], rows[0]["end"])], "feature long, chrom string, start long, end long").write.parquet(f"{tmp_path}/features")
    run("encode-cells", "--counts", f"{tmp_path}/cells", "--features", f"{tmp_path}/features", "--universe", f"{tmp_path}/u_cc", "--model", f"{tmp_path}/r2v", "--output", f"{tmp_path}/cellv")
    assert spark.read.parquet(f"{tmp_path}/cellv").count() == 1
    spark.createDataFrame([("a", "x", "y", 0.5)], "filename string, file_label string, search_term string, score double").write.csv(f"{tmp_path}/dist", header=True)
    run("labels", "l2r", "--distances", f"{tmp_path}/dist", "--query", "Y", "--output", f"{tmp_path}/l2r")
    assert spark.read.csv(f"{tmp_path}/l2r", header=True).first()["filename"] == "a"
    spark.read.parquet(f"{D}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).limit(50).write.parquet(f"{tmp_path}/vec")
    run("search", "--vectors", f"{tmp_path}/vec", "--queries", f"{tmp_path}/vec", "--limit", "3", "--output", f"{tmp_path}/found")
    assert spark.read.parquet(f"{tmp_path}/found").count() == 150
    run("cache", "add", f"{tmp_path}/f0.bed", "--cache", f"{tmp_path}/cache")
    names = catalog.Cache(spark, f"{tmp_path}/cache").list()
    run("cache", "list", "--cache", f"{tmp_path}/cache")
    run("cache", "seek", names[0], "--cache", f"{tmp_path}/cache")
    run("cache", "remove", names[0], "--cache", f"{tmp_path}/cache")
    assert catalog.Cache(spark, f"{tmp_path}/cache").list() == []
    assert json.dumps(search.first_limit(100)) == "23"


@pytest.mark.parametrize("measure", ["cosine", "l2"])
def test_nearest_rows_in_small_slices_are_those_of_one_sort(spark, monkeypatch, measure):
    monkeypatch.setattr(search, "SCORES", 90)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (140, 3)).astype(float)  # many ties, some zero vectors
    rows = spark.createDataFrame([(i, v.tolist(), str(i % 2)) for i, v in enumerate(x)], "id long, v array<double>, g string").coalesce(1)
    queries = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "g")
    for itself, within, offset in ((True, None, 0), (False, None, 2), (False, "g", 1)):
        want = set()
        for i in range(0, 140, 5):
            s = np.round(search.scores_of(measure, x, x[i : i + 1])[:, 0], 12)
            found = [(-s[j], j) for j in range(140) if not np.isnan(s[j]) and (itself or j != i) and (within is None or j % 2 == i % 2)]
            want |= {(i, j, k + 1 - offset) for k, (_, j) in enumerate(sorted(found)[: offset + 7]) if k >= offset}
        got = search.knn(queries, rows, 7, measure, offset, itself, within)
        assert {(r["query_id"], r["id"], r["place"]) for r in got.collect()} == want


def test_scores_of_a_block_stay_small():
    assert 8 * search.SCORES <= 1 << 23  # bytes of a worker's largest table of scores
