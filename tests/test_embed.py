"""Training embeddings: gradients, alias tables, planted companions, and the same model for the same seed."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.ml import feature
from pyspark.sql import functions as F

from intervale.functions.regions import LABEL
from intervale.operators import embed, tokens


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    v, u = rng.normal(0, 1, (6, 4)), rng.normal(0, 1, (6, 4))
    context, mask = rng.integers(0, 6, (5, 4)), rng.random((5, 4)) < 0.7
    mask[0] = False  # an example without context counts nowhere
    target, negative = rng.integers(0, 6, 5), rng.integers(0, 6, (5, 3))
    loss, dv, du = embed.step(v, u, context, mask, target, negative)
    for x, d in ((v, dv), (u, du)):
        for i in np.ndindex(x.shape):
            was = x[i]
            x[i] = was + 1e-6
            up = embed.step(v, u, context, mask, target, negative)[0]
            x[i] = was - 1e-6
            down = embed.step(v, u, context, mask, target, negative)[0]
            x[i] = was
            assert abs((up - down) / 2e-6 - d[i]) < 1e-5


@pytest.mark.parametrize("bucket", [3, 1 << 16])
def test_alias_draws_follow_weights(spark, bucket):
    weights = {f"t{i}": w for i, w in enumerate([0.4, 0.05, 0.2, 0.01, 0.14, 0.1, 0.1])} | {"never": 0.0}
    table = embed.alias_table(spark.createDataFrame(list(weights.items()), "token string, p double"), bucket)
    chance = collections.Counter()
    for r in table.collect():
        chance[r["token"]] += r["worth"] / r["slots"] * r["keep"]
        chance[r["other"]] += r["worth"] / r["slots"] * (1 - r["keep"])
    assert all(abs(chance[t] - w) < 1e-12 for t, w in weights.items())  # exactly the weights
    got = embed.drawn(spark.range(40_000).withColumnRenamed("id", "k"), table, 5, "k")
    seen = {r["token"]: r["count"] for r in got.groupBy("token").count().collect()}
    assert sum(seen.values()) == 40_000 and "never" not in seen
    assert all(abs(seen[t] / 40_000 - w) < 0.012 for t, w in weights.items() if w)
    assert got.orderBy("k").limit(50).collect() == embed.drawn(spark.range(40_000).repartition(3).withColumnRenamed("id", "k"), table, 5, "k").orderBy("k").limit(50).collect()


def test_planted_companions_are_nearest(spark):
    rng = np.random.default_rng(2)
    docs = []
    for i in range(400):
        topic = int(rng.integers(5))
        docs.append((i, [f"g{topic}_{k}" for k in rng.choice(8, 6, replace=False)]))
    frame = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(4)
    options = {"width": 12, "window": 3, "epochs": 8, "rate": 0.3, "block": 300, "seed": 4}
    got = embed.train(frame, **options)
    assert got.losses[-1] < 0.75 * got.losses[0] and all(b < a + 0.02 for a, b in zip(got.losses, got.losses[1:]))
    rows = got.model.orderBy("token").collect()
    x = np.array([r["v"] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    same = [rows[i]["token"].split("_")[0] == rows[int(j)]["token"].split("_")[0] for i in range(len(rows)) for j in np.argsort(-s[i])[:5]]
    assert len(rows) == 40 and np.mean(same) > 0.9
    again = embed.train(frame.repartition(7), **options)
    assert again.losses == got.losses and [r["v"] for r in again.model.orderBy("token").collect()] == [r["v"] for r in rows]


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", None, "a"]), (2, None), (3, []), (None, ["a", "b"]), (4, ["c"]), (5, ["b", "a"])], "id long, tokens array<string>")
    got = embed.train(docs, width=3, epochs=1, least=2)
    assert sorted(r["token"] for r in got.model.collect()) == ["a", "b"] and len(got.losses) == 1
    assert embed.train(docs.limit(0), width=3).model.count() == 0


def test_draws_with_replacement_meet_one_token_each(spark):
    rows = [(d, f"t{k}", float(k)) for d in range(3) for k in range(6)]
    weights = spark.createDataFrame(rows, "id int, token string, weight double")
    got = tokens.sampled_sentences(weights, 3000, 7)
    for r in got.collect():
        seen = collections.Counter(r["sentence"].split(" "))
        assert sum(seen.values()) == 3000 and "t0" not in seen and all(abs(seen[f"t{k}"] / 3000 - k / 15) < 0.03 for k in range(1, 6))


def test_ranking_gradients_match_differences():
    rng = np.random.default_rng(3)
    x, labels = rng.normal(0, 1, 5), rng.normal(0, 1, (4, 5))
    loss, dx, dl = embed.ranking(x, labels, 0.9)
    assert loss > 0 and embed.ranking(x, labels[:1], 0.9)[0] == 0
    for a, d in ((x, dx), (labels, dl)):
        for i in np.ndindex(a.shape):
            was = a[i]
            a[i] = was + 1e-6
            up = embed.ranking(x, labels, 0.9)[0]
            a[i] = was - 1e-6
            down = embed.ranking(x, labels, 0.9)[0]
            a[i] = was
            assert abs((up - down) / 2e-6 - d[i]) < 1e-5


def test_held_out_documents_rank_their_label_first(spark):
    rng = np.random.default_rng(6)

    def document(topic):
        words = [f"chr{topic}_{k}_{k + 9}" for k in rng.choice(30, 8, replace=False)] + [f"chr9_{k}_{k + 9}" for k in rng.choice(30, 4, replace=False)]
        return words

    rows, kept = [], []
    for i in range(240):
        topic = i % 6
        words = document(topic)
        if i < 180:
            rows.append((f"f{i}", " ".join([*words, f"{LABEL}t{topic}"])))
        else:
            kept.append((topic, words))
    rows += [("none", " "), ("unlabelled", "chr1_1_10"), ("bare", f"{LABEL}t1"), (None, f"chr1_1_10 {LABEL}t1")]
    frame = spark.createDataFrame(rows, "filename string, document string").repartition(3)
    got = embed.train_labels(frame, width=10, epochs=8, block=400, seed=2)
    assert got.losses[-1] < 0.5 * got.losses[0]
    v = {r["token"]: np.array(r["v"]) for r in got.model.collect()}
    names = [f"{LABEL}t{t}" for t in range(6)]
    y = np.stack([v[n] / np.sqrt(v[n] @ v[n]) for n in names])
    hits = [int((y @ np.mean([v[w] for w in words if w in v], 0)).argmax()) == topic for topic, words in kept]
    assert np.mean(hits) >= 0.95


def test_negatives_come_as_counts_of_distinct_tokens(spark, monkeypatch):
    monkeypatch.setattr(embed, "DRAWS", 4000)  # several groups of blocks for a bucket
    weights = {f"t{i}": w for i, w in enumerate([0.4, 0.05, 0.2, 0.01, 0.14, 0.1, 0.1])} | {"never": 0.0}
    table = embed.alias_table(spark.createDataFrame(list(weights.items()), "token string, p double"), 3).cache()
    counts = spark.createDataFrame([(b, 1000 + b) for b in range(12)], "block long, m long")
    got = embed.negatives_of(counts, table, 5, 7).collect()
    own, seen = collections.Counter(), collections.Counter()
    for r in got:
        assert len(set(r["tokens"])) == len(r["tokens"]) == len(r["times"])
        own[r["block"]] += sum(r["times"])
        seen.update(dict(zip(r["tokens"], r["times"])))
    assert own == {b: 5 * (1000 + b) for b in range(12)} and "never" not in seen
    assert all(abs(seen[t] / sum(own.values()) - w) < 0.012 for t, w in weights.items() if w)
    again = embed.negatives_of(counts.repartition(3), table.repartition(5), 5, 7).collect()
    assert sorted((r["block"], *zip(r["tokens"], r["times"])) for r in again) == sorted((r["block"], *zip(r["tokens"], r["times"])) for r in got)


def test_words_are_trained_in_tasks_by_their_count(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"g{i % 4}_{k}" for k in rng.permutation(6))) for i in range(400)]
    frame = spark.createDataFrame(docs, "id int, sentence string").repartition(3, "id")
    asked, fit = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, docs: asked.append(self.getNumPartitions()) or fit(self, docs))
    options = {"width": 8, "least": 1, "passes": 8}
    few = tokens.train_embeddings(frame, **options).count()
    monkeypatch.setattr(tokens, "TRAINED", 800)
    got = {r["word"]: r["v"] for r in tokens.train_embeddings(frame, **options).collect()}
    assert asked == [1, 3] and few == len(got) == 24
    x = np.array([got[w] for w in sorted(got)])
    x /= np.sqrt((x * x).sum(1))[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert np.mean([i // 6 == int(j) // 6 for i in range(24) for j in np.argsort(-s[i])[:5]]) > 0.9


def test_long_labelled_documents_are_never_held_whole(spark, monkeypatch):
    real, held = embed.cut, []

    def cut(df):
        out = real(df)
        if "tokens" in df.columns:
            held.append(out.agg(F.max(F.size("tokens"))).first()[0] or 0)
        return out

    monkeypatch.setattr(embed, "cut", cut)
    words = [f"w{i}" for i in range(60)]
    rows = [("f", " ".join([*words, "w3", f"{LABEL}a"])), ("g", f"x y {LABEL}b"), ("h", f"y z {LABEL}b")]
    frame = spark.createDataFrame(rows, "filename string, document string")
    runs = [{r["token"]: np.array(r["v"]) for r in embed.train_labels(frame.repartition(k), width=6, epochs=1, rate=0.3, block=20, seed=4).model.collect()} for k in (1, 3)]
    assert held and max(held) <= 20
    assert runs[0].keys() == runs[1].keys() and all((runs[0][t] == runs[1][t]).all() for t in runs[0])
    v0 = {t: (np.random.default_rng([4, zlib.crc32(t.encode())]).random(6) - 0.5) / 6 for t in runs[0]}
    x = np.mean([v0[w] for w in words], 0)
    dx = embed.ranking(x, np.stack([v0[f"{LABEL}a"], v0[f"{LABEL}b"]]), 0.2)[1]
    assert np.abs(dx).max() > 0 and all(np.allclose(runs[0][w], v0[w] - 0.3 * dx / 60) for w in words)


def test_long_labelled_documents_teach_as_short_ones_do(spark):
    rng = np.random.default_rng(8)
    rows = [(f"f{i}", " ".join([f"c{i % 3}_{k}" for k in rng.choice(40, 25, replace=False)] + [f"{LABEL}t{i % 3}"])) for i in range(30)]
    got = embed.train_labels(spark.createDataFrame(rows, "filename string, document string"), width=8, epochs=6, block=10, seed=3)
    v = {r["token"]: np.array(r["v"]) for r in got.model.collect()}
    y = np.stack([v[f"{LABEL}t{t}"] / np.linalg.norm(v[f"{LABEL}t{t}"]) for t in range(3)])
    assert got.losses[-1] < got.losses[0]
    assert all(int((y @ np.mean([v[f"c{t}_{k}"] for k in range(40) if f"c{t}_{k}" in v], 0)).argmax()) == t for t in range(3))


def test_blocks_of_a_group_hand_on_one_row_a_token(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, [f"t{k}" for k in rng.choice(30, 8, replace=False)]) for i in range(200)], "id long, tokens array<string>")
    told, moved = [], embed._moved

    def counted(model, by, schema):
        told.append(by.count())
        return moved(model, by, schema)

    monkeypatch.setattr(embed, "_moved", counted)
    models = []
    for groups in (1000, 3):
        monkeypatch.setattr(embed, "GROUPS", groups, raising=False)
        got = embed.train(docs, width=4, epochs=2, rate=0.3, block=100, seed=3)
        models.append(np.array([r["v"] for r in got.model.orderBy("token").collect()]))
    assert max(told[2:]) <= 30 * 4 < min(told[:2])  # 16 blocks in four groups at most
    assert np.allclose(*models, atol=1e-12) and np.abs(models[0]).max() > 0.05
