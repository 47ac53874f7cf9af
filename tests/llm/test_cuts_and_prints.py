"""Fingerprints and fill-in-the-middle: brute force, ranges of hot identifiers, merges and round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from intervale.llm import fill_middle, fingerprints

SCHEMA = "doc_id long, text string, lang string, fingerprint string, n string, form string, _range long"
ODD = [(1, None, "en", "x", "y", "z", 1), (2, "", None, None, None, None, 1), (3, "a b", "en", "x", "y", "z", None), (3, "a  b", "en", "x", "y", "z", 1), (None, "12 34 \n", "en", "x", "y", "z", 1), (4, "word " * 30000, "en", "x", "y", "z", 1), (5, "x" * 50000, "fr", "x", "y", "z", 1), (6, " \t ", "fr", "x", "y", "z", 1), (7, "é <P> 日本 語", "fr", "x", "y", "z", 1), (8, "퟿é <|endoftext|> <S <<M>", "fr", "x", "y", "z", 1)]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_print(text, words=5, bar="2"):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    h = [hashlib.md5(" ".join(w[i : i + words]).encode()).hexdigest()[:16] for i in range(max(len(w) - words + 1, min(len(w), 1)))]
    return sorted({x for x in h if x < bar or x == min(h)})


def test_fingerprints_match_plain_ones(spark):
    random.seed(3)
    rows = [(i * 7 - 900, " ".join(random.choice("ab cé d \n e f g".split(" ")) + str(random.randrange(9)) for _ in range(random.choice([0, 1, 3, 5, 40, 400])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    order = sorted(rows, reverse=True)
    for size in (1 << 30, 3000):  # one range, and many
        got = {r["doc_id"]: r for r in fingerprints.compared(docs, range_bytes=size).collect()}
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(order):
            after, r = order[(k + 1) % len(order)][1], got[i]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"]) == (len(text), edited, plain_print(text), plain_print(edited), plain_print(after))


def test_ranges_of_one_hot_identifier(spark):
    rows = [(5 if i % 3 else i, f"text number {i}") for i in range(600)] + [(None, f"none {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprints.in_ranges(docs, 1000)
    sizes = placed.groupBy("_range").count()
    assert sizes.agg(F.max("count")).first()[0] < 150  # 400 rows share an id, 300 have none
    ranges = placed.groupBy("_range").agg(F.min(F.struct("_key", "_tie")).alias("lo"), F.max(F.struct("_key", "_tie")).alias("hi")).orderBy("_range").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    got = fingerprints.with_next(docs, {"text": F.col("text")}, 1000).collect()
    assert len(got) == 900 and sorted(r["next_text"] for r in got) == sorted(r["text"] for r in got)  # everyone is the next of someone


def test_fingerprint_edges(spark, odd, empty):
    got = fingerprints.compared(odd).collect()
    assert len(got) == len(ODD) and {len(r["fingerprint"]) for r in got if r["doc_id"] in (1, 2, 6)} == {0} and all(r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5, 7, None))
    assert fingerprints.compared(empty).count() == 0
    alone = fingerprints.compared(odd.where("doc_id = 7")).first()
    assert alone["next_fingerprint"] == alone["fingerprint"] and alone["edited"] == "é <P> 日é <"[: 7] + "é <"
    one = F.array(F.lit("a"), F.lit("b"))
    none = F.array().cast("array<string>")
    shares = spark.range(1).select(fingerprints.contained(one, none), fingerprints.contained(none, one), fingerprints.contained(none, none), fingerprints.contained(one, F.array(F.lit("a"))), fingerprints.resemblance(one, F.array(F.lit("a"))), fingerprints.resemblance(none, none)).first()
    assert tuple(shares) == (0.0, 0.0, 1.0, 0.5, 0.5, 1.0)


def test_fingerprints_merge(spark):
    random.seed(5)
    texts = [(i % 3, " ".join(random.choice("abcdefgh") for _ in range(random.choice([2, 30, 300])))) for i in range(30)] + [(9, "one two")]
    rows = spark.createDataFrame(texts, "g int, text string").withColumn("fingerprint", fingerprints.sketch(F.col("text")))
    got = {}
    for r in fingerprints.merged(rows, "g").collect():
        got.setdefault(r["g"], set()).add(r["hash"])
    for g in (0, 1, 2, 9):
        own = [{x for t in [t] for x in plain_print(t, bar="g")} for k, t in texts if k == g]
        every = set().union(*own)
        assert got[g] == {x for x in every if x < "2" or x == min(every)}
    shares = {(r["g"], r["other"]): r["share"] for r in fingerprints.containments(fingerprints.merged(rows, "g"), fingerprints.merged(rows, "g"), "g").collect()}
    assert shares[0, 0] == 1.0 and shares.get((0, 1), 0) == len(got[0] & got[1]) / len(got[0])


def test_a_part_of_a_long_text_is_contained(spark):
    random.seed(9)
    long = [str(random.randrange(10**6)) for _ in range(20000)]
    rows = spark.createDataFrame([(" ".join(long), " ".join(long[5000:5400]), " ".join(str(random.randrange(10**6)) for _ in range(400)))], "a string, b string, c string")
    a, b, c = (fingerprints.sketch(F.col(x)) for x in "abc")
    got = rows.select(fingerprints.contained(b, a), fingerprints.contained(c, a), fingerprints.resemblance(a, b)).first()
    assert got[0] > 0.97 and got[1] < 0.05 and got[2] < 0.05


@pytest.mark.parametrize("every", [1, 3, 64])
def test_checkpoints_match_the_pattern(every, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(fill_middle, "SCAN", 13)
    for _ in range(150):
        text = "".join(random.choice("ab é日\t\n  x ") for _ in range(random.randrange(90)))
        units = UNIT.findall(text)
        at = fill_middle.Checkpoints(text.encode(), every)
        assert (at.units, at.points) == (len(units), len(text)) and "".join(units) == text
        assert len(at.unit_at) <= len(units) // every + 1
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert at.cut(u) == (len(head.encode()), len(head))


def test_fill_middle_matches_plain_cuts(spark, odd, empty):
    random.seed(1)
    rows = [(i, "".join(random.choice("ab é日\t\n  <S<P") for _ in range(random.randrange(200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.transform(docs, every=4)
    got = {r["doc_id"]: r for r in out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()}
    seen = set()
    for i, text in rows:
        h = hashlib.sha256(f"42:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units, r = UNIT.findall(text), got[i]
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        seen.add(form)
        assert (r["n"], r["form"], r["output"], r["back"]) == (n, form, want, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert seen == {"plain", "psm", "spm"}
    out = fill_middle.transform(odd, rate=100).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r["doc_id"] or 0, r["back"]) for r in out) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert {r["doc_id"]: r["form"] for r in out}[7] == "plain" and {r["doc_id"]: r["n"] for r in out}[4] == 30001 and {r["doc_id"]: r["n"] for r in out}[6] == 1
    assert fill_middle.transform(empty).count() == 0


def test_long_texts_are_cut_in_several_batches(spark, monkeypatch):
    rows = [(i, f"w{i} " * 300000) for i in range(12)]  # 15 MB: more than one output batch
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rate=100)
    got = {r["doc_id"]: (r["n"], r["t"]) for r in out.select("doc_id", "n", F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("t")).collect()}
    assert got == {i: (300001, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
