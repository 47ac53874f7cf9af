"""The corpus operators: edge cases, brute force, round trips and held-out accuracy on small tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.llm import ann, bpe, exact_dedup, language_id, lm_scoring, mixing, near_dedup, packing, registry, sharding, token_counts, toxicity

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size string, score string, node long"
ODD = [(1, None, "en", "a", "x", "y", 1), (2, "", None, None, "x", "y", 1), (3, "a b", "en", "a", None, None, None), (3, "a  b", "en", "a", "x", "y", 1), (None, "12 34", "en", None, "x", "y", 1), (4, "word " * 30000, "en", "b", "x", "y", 1), (5, "x" * 50000, "fr", "b", "x", "y", 1), (6, "퟿é <|endoftext|> a", "fr", "c", "x", "y", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, D).toPandas(), con.sql(sql).df()
        key = sorted(got.columns)
        a, b = (x[key].astype(str).sort_values(key).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name


def test_sharding_matches_turns_of_claims(spark, odd, empty):
    def number(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)

    names, m = ["a", "b", "c", "d", "e"], 101
    want, at, full = [-1] * m, [0] * 5, 0
    while full < m:
        for i, n in enumerate(names):
            off, skip = number("offset|" + n) % m, number("stride|" + n) % (m - 1) + 1
            while full < m and want[(off + at[i] * skip) % m] >= 0:
                at[i] += 1
            if full < m:
                want[(off + at[i] * skip) % m] = i
                full += 1
    got = sharding.lookup_table(spark, names, m).orderBy("slot").toPandas()
    assert got["shard"].tolist() == want
    out = sharding.assign(odd, names, m).toPandas()
    assert len(out) == len(ODD) and out.groupby("doc_id")["shard"].nunique().max() == 1
    assert sharding.assign(empty, names, m).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 100)


def test_exact_dedup_edges(odd, empty):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
    blank = hashlib.sha256(b"").hexdigest()
    assert got[2, blank]["keep_id"] == 1 and got[1, blank]["group_size"] == 2 and got[3, hashlib.sha256(b"a b").hexdigest()]["kept"]
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(odd).count() == len(ODD) - 2 and exact_dedup.drop_copies(odd).columns == odd.columns


def test_runs_merge_by_sorting(docs):
    rows = exact_dedup.digested(docs, "text", exact_dedup.identifier("doc_id").alias("least")).withColumn("n", F.lit(1))
    plan = exact_dedup.tree_merge(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 6 and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_equal_digests_need_equal_checks(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00" * 32))  # all digests collide
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(frame).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert exact_dedup.drop_copies(frame).count() == 3


def test_drop_copies_while_splits_change(spark, tmp_path, monkeypatch):
    rows = [(i if i % 50 else None, f"text {i % 100}", f"s{i}") for i in range(1000)] + [(1, "text 1", "a"), (7, "text 7", "t"), (7, "text  7", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(f"{tmp_path}/docs")
    key, was, real = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"), exact_dedup.cut

    def resplit(df):  # as when executors come or go between two jobs
        out = real(df)
        spark.conf.set(key, "1500")
        return out

    monkeypatch.setattr(exact_dedup, "cut", resplit)
    try:
        got = exact_dedup.drop_copies(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set(key, was)
    least = {}
    for i, text, source in rows:
        k = " ".join(text.split())
        least[k] = min(least.get(k, (2,)), (i is None, i or 0, text, source))
    for k in ("text 0", "text 50"):  # all ids null: any of them may stay, by its columns
        assert sum(r["text"] == k and r["doc_id"] is None for r in got) == 1
    assert {(r["doc_id"], r["source"]) for r in got if r["doc_id"]} == {(i, s) for n, i, _, s in least.values() if not n}
    assert len(got) == len(least) == 100


def brute_components(texts, words, percent):
    def shingles(t):
        w = bytes((t or "").encode()).lower().split()
        n = min(len(w), words)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("small", "most"), [(512, near_dedup.MOST), (8, 1000)])
def test_near_dedup_against_brute_force(spark, docs, small, most):
    rng = random.Random(5)
    texts = [(r["doc_id"], r["text"][:3000]) for r in docs.limit(60).collect()]
    base = texts[1][1].split()[:200]
    for k in range(60):  # a dense group of copies with a few words changed each
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        texts.append((10_000 + k, " ".join(own)))
    texts += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One  TWO")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = near_dedup.near_groups(frame, words=3, percent=85, small=small, most=most).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_of_long_texts_among_mostly_empty_ones(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    texts = [(i, None if i % 3 else "") for i in range(400)]
    for k in range(12):  # near copies of a long text, whose groups are compared in pairs of blocks
        own = list(long)
        for _ in range(rng.randint(0, 1500)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append((1000 + k, " ".join(own)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = near_dedup.near_groups(frame, words=3, percent=85, most=100_000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 85)


def test_near_dedup_edges(odd, empty):
    got = near_dedup.near_groups(odd, words=3, percent=85).collect()
    assert len(got) == len(ODD) and near_dedup.near_groups(empty).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    assert near_dedup.drop_near_copies(odd).columns == odd.columns or set(near_dedup.drop_near_copies(odd).columns) == set(odd.columns)


def test_mixing_edges(odd, empty):
    got = mixing.mixture(odd).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all() and abs(got["taken"].sum() - 1.5 * got["size"].sum()) < 5
    assert mixing.mixture(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    blank = odd.where("text is null or text = ''")
    assert mixing.mixture(blank).agg(F.sum("taken")).first()[0] == 0 and mixing.mixed(blank).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_are_sorted_in_parts(docs):
    out = mixing.mixture(docs).select(F.spark_partition_id().alias("part"), "position", "taken").toPandas()
    ranges = out[out["position"].notna()].groupby("part")["position"].agg(["min", "max"]).sort_index()
    assert len(ranges) > 1 and (ranges["max"].to_numpy()[:-1] <= ranges["min"].to_numpy()[1:]).all()
    assert all(own["position"].dropna().is_monotonic_increasing for _, own in out.groupby("part"))
    left = out[out["position"].isna()].groupby("part").size()
    assert left.max() < 0.5 * left.sum()
    assert mixing.digits(10) == 3 and mixing.digits(10**9) == 5


def test_packing_round_trip(odd, empty, docs):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(bpe.default_path())
    for frame in (odd, docs):
        got = packing.pack(frame).toPandas()
        texts = sorted(tuple(real.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in frame.select("text").collect())
        filled = got.groupby("sequence_id")["length"].sum()
        assert filled.max() <= 1024
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        if frame is docs:
            whole = [tuple(np.frombuffer(b"".join(own["ids"]), "<u4").tolist()) for _, own in got.sort_values("start").groupby("doc_id")]
            assert sorted(whole) == texts
            waste = (1024 - filled[(filled & (filled - 1)) != 0]).sum() / filled.sum()
            assert waste < 0.05
    assert packing.pack(empty).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 300)
    window = packing.windows_for(sizes, 1024)
    filled = np.bincount(window, sizes)
    assert filled.max() <= 1024 and filled.max() - filled.min() < 200


def test_encoder_equals_tokenizers_on_odd_characters():
    from tokenizers import Tokenizer

    real, own = Tokenizer.from_file(bpe.default_path()), bpe.encoding(bpe.default_path())
    for c in [*range(1, 0x3100), *range(0xFE00, 0x10100), 0x1F600, 0xE0001]:
        text = f"a{chr(c)}b {chr(c)}1 {chr(c) * 2} x"
        assert real.encode(text, add_special_tokens=False).ids == bpe.encode(own, text).tolist(), hex(c)


def test_token_counts_follow_edits(spark, odd, empty):
    own = bpe.encoding(bpe.default_path())
    rng = random.Random(2)
    for _ in range(400):
        text = " ".join(rng.choice(["alpha", "b", "don't", "  ", "7,1", "\n"]) for _ in range(rng.choice([0, 3, 400])))
        tree = token_counts.CountTree.of(text, lambda x: len(bpe.encode(own, x)))
        for _ in range(5):
            at, gone, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 30, 900]), rng.choice(["", " ", " q", "'s z", "<|endoftext|>", "yy" * 9])
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text == text and tree.total == len(bpe.encode(own, text))
    edits = spark.createDataFrame([(3, 1, 0, 1, "zz"), (3, 0, 9, 0, " end")], "doc_id long, step int, at long, remove long, insert string")
    got = token_counts.count_tokens(token_counts.with_edits(odd, edits), keep_text=True).collect()
    assert {r["new_text"] for r in got if r["doc_id"] == 3} == {"zz b end", "zz  b end"} and len(got) == len(ODD)
    assert token_counts.count_tokens(empty.withColumn("edits", F.lit(None))).count() == 0


def test_trees_are_kept_between_batches_of_edits(spark, docs, tmp_path):
    own = bpe.encoding(bpe.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    token_counts.build_trees(docs).write.parquet(f"{tmp_path}/0")
    for k in range(2):
        rows = [(i, 0, (i * 37 + k) % (len(t) + 1), 3, f" more{k} " if i % 2 else None) for i, t in texts.items()] + [(-1, 0, None, None, None)]
        edits = spark.createDataFrame(rows, "doc_id long, step int, at long, remove long, insert string")
        trees = token_counts.with_edits(spark.read.parquet(f"{tmp_path}/{k}").withColumn("edits", F.lit(1)), edits)
        token_counts.apply_edits(trees).write.parquet(f"{tmp_path}/{k + 1}")
        for i, _, at, gone, new in rows[:-1]:
            texts[i] = texts[i][:at] + (new or "") + texts[i][at + gone :]
        got = spark.read.parquet(f"{tmp_path}/{k + 1}").collect()
        assert {r["doc_id"]: ("".join(r["tree"]["leaves"]), r["new_tokens"]) for r in got} == {i: (t, len(bpe.encode(own, t))) for i, t in texts.items()}
        long = [r for r in got if r["n_chars"] > 4000]
        assert long and sum(r["encoded_chars"] for r in long) < 0.3 * sum(r["n_chars"] for r in long)


def test_ids_keep_their_type(odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    model, none = language_id.fit(named), F.lit(None)
    for out in (token_counts.count_tokens(named.withColumn("edits", none)), near_dedup.near_groups(named), packing.pack(named), language_id.identify(named, model), exact_dedup.exact_groups(named), mixing.mixture(named), lm_scoring.score(named, lm_scoring.fit(named, named)), toxicity.score(named, toxicity.fit(named, named.select("doc_id", F.lit(1).alias("toxic"))))):
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {None, *(f"d{i}" for i in range(1, 7))}


def test_language_id(spark, docs, odd, empty):
    got = registry.queries()["op10_ecoc_language_id"](spark, D).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert set(got["held_out"][got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    model = language_id.fit(docs)
    out = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[None]["lang_pred"] == "und" and out[4]["lang_pred"] != "und"
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert language_id.accepted(odd, model).columns == odd.columns


def test_toxicity(spark, odd, empty):
    got = registry.queries()["op2_kneser_ney_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    x = got[got["held_out"]].merge(labels, on="doc_id")
    order = x["score"].rank()
    yes = x["toxic"] == 1
    auc = (order[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert auc > 0.9 and got["score"].between(0, 1).all()
    model = toxicity.fit(odd, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0


def plain_kneser_ney(texts):
    """log P(w | toxic) - log P(w | ordinary) of padded words, from (words, class) by the definitions."""
    raw = [[collections.Counter() for _ in range(7)] for _ in (0, 1)]
    for words, c in texts:
        for w in words:
            w = b" " + w + b" "
            for n in range(2, min(6, len(w) + 1)):
                raw[c][n][w[:n]] += 1
            for i in range(len(w) - 5):
                raw[c][6][w[i : i + 6]] += 1
    p, rest = [{}, {}], [{}, {}]
    tables = [None, None]
    for c in (0, 1):
        t = {6: raw[c][6]}
        for n in range(5, 0, -1):
            t[n] = raw[c][n] + collections.Counter(g[1:] for g, k in t[n + 1].items() if k)
        tables[c] = t
    for n in range(1, 7):
        grams = set(tables[0][n]) | set(tables[1][n])
        counts = []
        for c in (0, 1):
            both = {g: tables[0][n][g] + tables[1][n][g] for g in grams}
            counts.append(both if n <= 2 else {g: tables[c][n][g] if both[g] >= 3 else 0 for g in grams})
        for c in (0, 1):
            own, mass, kinds = counts[c], collections.Counter(), collections.Counter()
            for g, k in own.items():
                mass[g[:-1]] += k
                kinds[g[:-1]] += k > 0
            for g, k in own.items():
                if n == 1:
                    p[c][g] = (k + 0.5) / sum(x + 0.5 for x in own.values())
                    continue
                m = mass[g[:-1]]
                rest[c][g[:-1]] = 0.75 * kinds[g[:-1]] / m if m else 1.0
                p[c][g] = (max(k - 0.75, 0) / m if m else 0) + rest[c][g[:-1]] * p[c][g[1:]]

    def difference(word):
        w, total = b" " + word + b" ", 0.0
        for j in range(1, len(w)):
            d = 0.0
            for n in range(3, min(6, j + 1) + 1):
                g = w[j - n + 1 : j + 1]
                if g in p[1]:
                    d = np.log(p[1][g] / p[0][g])
                elif g[:-1] in rest[1]:
                    d += np.log(rest[1][g[:-1]] / rest[0][g[:-1]])
            total += d
        return total

    return difference


def test_toxicity_models_against_plain_kneser_ney(spark):
    from intervale.llm import ngrams

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").orderBy("doc_id").select("toxic", "text").limit(120).collect()
    rows = [(r["toxic"], (r["text"] or "")[:1500]) for r in rows] + [(1, "zzq zzq zzqa"), (0, None)]
    frame = spark.createDataFrame(rows, "toxic int, text string")
    models = toxicity.kneser_ney(toxicity.count_grams(frame).rename(columns={}))
    assert {c for c, _ in rows} == {0, 1}

    def split(t):  # words in pieces of the operator's width
        words = ngrams.letters(t).split()
        return [w[i : i + ngrams.WIDTH] for w in words for i in range(0, len(w), ngrams.WIDTH)]

    plain = plain_kneser_ney([(split(t), c) for c, t in rows])
    for _, t in rows[:40] + rows[-2:]:
        words = split(t)
        d = [plain(w) for w in words]
        want = [np.mean(d) if d else 0.0]
        for n in toxicity.WINDOWS:
            want.append(max((np.mean(d[i : i + n]) for i in range(len(d) - n + 1)), default=want[0]))
        assert np.allclose(models.features([t])[0], want, atol=2e-4), t


def test_language_codes_are_decoded_as_defined(spark, docs):
    from intervale.llm import ngrams, words

    model = language_id.fit(docs)
    texts = [r["text"] for r in docs.limit(30).collect()] + ["", "Ünï 7 x"]
    margins = model.margins(texts)
    for t, got in zip(texts, margins):
        grams = [b" " + w[i : i + ngrams.WIDTH] + b" " for w in ngrams.letters(t).split() for i in range(0, len(w), ngrams.WIDTH)]
        keys = [int.from_bytes(bytes([n]) + g[i : i + n], "big") for g in grams for n in language_id.ORDERS for i in range(len(g) - n + 1)]
        at = words.mix(np.array(keys, np.uint64)) >> np.uint64(64 - language_id.BUCKET_BITS)
        want = model.weights[at.astype(int)].sum(0) / max(len(keys), 1) + model.bias
        assert np.allclose(got, want, atol=1e-4)
    codes = [[1, 1], [1, -1], [-1, 1]]
    two = language_id.LanguageModel(["a", "b", "c"], np.array(codes, float), model.weights, model.bias, np.array([0.7, 0.3]))
    rows = np.random.default_rng(1).normal(size=(50, 2))
    for m, best, score, gap in zip(rows, *two.decode(rows)):
        loss = [sum(w * np.log1p(np.exp(-3 * x * b)) for x, b, w in zip(m, code, (0.7, 0.3))) for code in codes]
        p = np.exp(-4 * np.array(loss)) / np.exp(-4 * np.array(loss)).sum()
        order = np.sort(p)
        assert best == p.argmax() and np.isclose(score, order[-1]) and np.isclose(gap, order[-1] - order[-2])


def test_ambiguous_texts_are_flagged(spark, docs):
    model = language_id.fit(docs)
    frame = docs.where("lang = 'en'").limit(5).selectExpr("doc_id", "text").unionByName(spark.createDataFrame([(-1, "q")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in language_id.identify(frame, model).collect()}
    assert not any(r["ambiguous"] for i, r in got.items() if i >= 0) and got[-1]["gap"] <= got[-1]["score"]
    assert all(r["ambiguous"] == (r["gap"] < language_id.AMBIGUOUS) for r in got.values())


def test_lm_scoring(spark, docs, odd, empty):
    got = registry.queries()["op5_cross_entropy_difference"](spark, D).toPandas()
    labels = spark.read.parquet(f"{D}/labels.parquet").toPandas()
    x = got.merge(labels, on="doc_id").groupby("quality")["score"].mean()
    assert len(got) == docs.count() and x[1] > x[0]
    counts = lm_scoring.count_pairs(odd.select("text", F.lit(True).alias("wanted")), np.empty(0, np.uint64))
    assert counts[0].sum() == counts[1].sum() == sum(len((r[1] or "").split()) for r in ODD)
    for frame in (odd, empty):
        assert lm_scoring.score(frame, lm_scoring.fit(frame, frame)).count() == frame.count()


@pytest.mark.parametrize("block", [lm_scoring.BLOCK, 20_000])
def test_lm_scoring_counts_all_pairs_of_all_words(spark, docs, odd, block):
    frame = docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in frame.collect()]
    target = {i for i, _ in rows[:20]}
    models, words = [], {w for _, t in rows for w in t}
    for mine in ([t for _, t in rows], [t for i, t in rows if i in target]):
        flat = collections.Counter(w for t in mine for w in t)
        models.append((flat, collections.Counter(x for t in mine for x in zip([None, *t], t)), collections.Counter(b for t in mine for b in [None, *t][: len(t)])))
    assert len(words) > 1500

    def loss(t, m):
        flat, pair, before = m
        share = {w: (flat[w] + 0.5) / (flat.total() + 0.5 * (len(words) + 1)) for w in t}
        return -sum(np.log2((pair[b, w] + 50 * share[w]) / (before[b] + 50)) for b, w in zip([None, *t], t)) / max(len(t), 1)

    want = sorted((-1 if i is None else i, len(t), loss(t, models[0]), loss(t, models[1])) for i, t in rows)
    ids = spark.createDataFrame([(i,) for i in target if i is not None], "doc_id long")
    model = lm_scoring.fit(frame, ids, block=block)
    for got in (lm_scoring.score_own(model), lm_scoring.score(frame, model)):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["background_loss"], r["target_loss"]) for r in got.collect())
        assert np.allclose(got, want)


def test_nearest(spark):
    x = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    got = registry.queries()["op7_anisotropic_ann"](spark, D).toPandas()
    v, ids, hits = np.stack(x["embedding"]).astype(float), x["vec_id"].to_numpy(), 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(ids[order]) & set(own["vec_id"]))
    assert hits / len(got) >= 0.9
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (100, [1.0, 1.0]), (6, [1.0, 2.0]), (5, [1.0, 0.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(odd, odd, 10).where("query_id = 100").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(5, 1.0), (6, 1.0)]
    assert ann.nearest(odd.limit(0), odd.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, docs):
    import corpus_pipeline

    kept = docs.limit(80)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, kept, D)
    two = stages["exact_dedup"](spark, one, D)
    texts = {}
    for r in sorted(one.collect()):
        texts.setdefault(exact_norm(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(texts.values())
    three = stages["near_dedup"](spark, two, D)
    comps = brute_components([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({c for _, c in comps.values()})
    four = stages["mixing"](spark, three, D)
    assert set(four.columns) == set(docs.columns) and four.count() > three.count() * 0.5
    five = stages["packing"](spark, four, D).toPandas()
    assert five["doc_id"].nunique() == four.select("doc_id").distinct().count()


def exact_norm(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


def lengths_vary(n=50_000, width=64):
    rng = np.random.default_rng(3)
    return rng.normal(size=(n, width)) * rng.lognormal(0, 1, (n, 1))


def test_nearest_of_vectors_of_varying_length_at_two_batch_sizes(spark, tmp_path):
    import pandas as pd

    x = lengths_vary()
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}).to_parquet(f"{tmp_path}/v.parquet")
    v = spark.read.parquet(f"{tmp_path}/v.parquet").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, out = spark.conf.get(key), []
    try:
        for size in ("10000", "700"):
            spark.conf.set(key, size)
            out.append(ann.nearest(v, v.where("vec_id % 1000 = 0"), 10).toPandas().sort_values(["query_id", "rank"]))
    finally:
        spark.conf.set(key, was)
    hits = 0
    for q, own in out[0].groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(own["vec_id"]))
    assert hits >= 0.98 * len(out[0])
    both = out[0].merge(out[1], on=["query_id", "vec_id"])
    assert len(both) >= 0.98 * len(out[0]) and np.allclose(both["score_x"], both["score_y"])
    few = ann.nearest(v, v.where("vec_id % 10000 = 0"), 10, tables=16, slack=float("inf")).toPandas()  # one query a block, exact
    for q, own in few.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert own.sort_values("rank")["vec_id"].tolist() == np.argsort(d)[:10].tolist()


def test_nearest_with_repeats_ties_and_other_widths(spark):
    rows = [(0, [0.0, 1.0], "a"), (0, [0.0, 3.0], "b"), (1, [0.0, 2.0], "c"), (1, [0.0, 2.0], "d"), (2, [2.0, 1.0], "e"), (3, [-2.0, 1.0], "f"), (4, [1.0, 1.0, 1.0], "g")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(frame, frame.where("vec_id in (0, 4)"), 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0), (0, 1, 1.0), (0, 2, 2.0)]


BLANKS = [x * n for n in (1, 2, 9_999, 10_000, 199_999, 200_000, 1_100_000, 2_000_000) for x in (" ", "\n")] + [" \n" * 1_050_000, "\u3000 \t" * 5_000, "\x1c " * 9_000]


def test_long_blanks_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    real, own = Tokenizer.from_file(bpe.default_path()), bpe.encoding(bpe.default_path())
    for run in BLANKS:
        for text in (run, run + "word", run + "\nword", "word" + run, "a" + run + "b 1", run + "<|endoftext|>" + run + "x", "<|endoftext|>" + run):
            assert bpe.encode(own, text).tolist() == real.encode(text, add_special_tokens=False).ids, (len(run), repr(text[:3]), repr(text[-9:]))


def test_documents_of_blanks_are_packed_and_counted(spark):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(bpe.default_path())
    rows = [(i, run + end) for i, (run, end) in enumerate((r, e) for r in BLANKS[9:17] for e in ("", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {i: len(real.encode(t, add_special_tokens=False).ids) for i, t in rows}
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r["doc_id"]: (r["n"], r["d"]) for r in got} == {i: (n + 1, n + 1) for i, n in sizes.items()}
    trees = token_counts.build_trees(docs).select("doc_id", F.col("tree.tokens")[1].alias("n"))
    assert {r["doc_id"]: r["n"] for r in trees.collect()} == sizes


@pytest.mark.parametrize("shape", ["path", "star", "forest", "dense"])
def test_components_of_any_shape(spark, shape, monkeypatch):
    rng = random.Random(shape)
    n = 3000
    ids = rng.sample(range(10**9), n)
    links = {
        "path": [(ids[i], ids[i + 1]) for i in range(n - 1)],
        "star": [(ids[0], x) for x in ids[1:]],
        "forest": [(ids[i], ids[rng.randrange(i // 50 * 50, i)]) for i in range(n) if i % 50],
        "dense": [(rng.choice(ids), rng.choice(ids)) for _ in range(n)],
    }[shape]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    rounds, real = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df: rounds.append(1) or real(df))
    monkeypatch.setattr(near_dedup, "CHUNK", 100)
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0 if shape in ("path", "dense") else 500_000)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()
    assert sorted((r["id"], r["root"]) for r in got) == sorted((x, root(x)) for x in list(up)) and len(rounds) <= 10
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shuffled_ways_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10_000))
    runs = {
        "near": lambda: near_dedup.near_groups(copies, words=3, percent=85), "kept": lambda: near_dedup.drop_near_copies(copies).select("doc_id"),
        "exact": lambda: exact_dedup.drop_copies(copies).select("doc_id"), "scores": lambda: lm_scoring.op5_cross_entropy_difference(spark, "/root/testdata/sf0.001"),
    }
    before = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 0)
    assert {k: sorted(map(str, f().collect())) for k, f in runs.items()} == before


def test_sets_meet_their_rows_once_and_in_small_batches(spark):
    from intervale.llm import common, near_dedup

    rows = spark.createDataFrame([(n, i, i % 3) for i in range(20) for n in range(i % 5)], "node long, id long, root long")
    known = spark.createDataFrame([(i, bytes([i])) for i in range(0, 20, 2)], "id long, members binary")
    got = near_dedup.met_once(rows, known)
    assert sorted(got.select("id", "node", "root", "members").collect()) == sorted(rows.join(known, "id").select("id", "node", "root", "members").collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # rows part again above the join
    common.prepare(spark)
    assert 0 < int(spark.conf.get(common.ROWS_A_BATCH)) <= common.BATCH
