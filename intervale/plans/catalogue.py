"""All queries over the driver tables, and SQL for those that SQL can express.

Regions come from ``lineitem`` (8 files, 5 chromosomes), the universe from ``part``, vectors from ``embeddings``, cells
and features from ``events``, token documents from ``conversations``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.functions import regions as fn
from intervale.operators import catalog, embed, encode, evaluate, index, intervals, inverted, labels, network, perturb, search, tokens, universe
from intervale.session import cut, shared_dir
from intervale.sources import bed as files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_R = """r AS (SELECT CAST(l_suppkey % 8 AS INT) AS bed_id, 'chr' || CAST(1 + l_orderkey % 5 AS VARCHAR) AS chrom, l_partkey * 40 + l_linenumber * 7 + l_orderkey % 97 AS "start",
  l_partkey * 40 + l_linenumber * 7 + l_orderkey % 97 + 10 + CAST(l_quantity AS BIGINT) * 2 AS "end", ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_idx FROM lineitem)"""
_U = """u AS (SELECT p_partkey AS uid, 'chr' || CAST(1 + p_partkey % 5 AS VARCHAR) AS chrom, p_partkey * 40 AS "start", p_partkey * 40 + 20 + 3 * p_size AS "end" FROM part)"""


def _merged(name: str, of: str, by: str = "bed_id, chrom") -> str:
    return f"""{name} AS (SELECT {by}, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY {by} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS i FROM
  (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY {by} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM {of})) GROUP BY {by}, i)"""


_M, _MU = _merged("m", "r"), _merged("mu", "u", "chrom")
_SIZES = 'sz AS (SELECT chrom, (max("end") // 1000 + 1) * 1000 AS size FROM (SELECT chrom, "end" FROM r UNION ALL SELECT chrom, "end" FROM u) GROUP BY chrom)'


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def regions(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") * 40 + F.col("l_linenumber") * 7 + F.col("l_orderkey") % 97
    return _read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 8).cast("int").alias("bed_id"), F.concat(F.lit("chr"), (1 + F.col("l_orderkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 10 + F.col("l_quantity").cast("long") * 2).alias("end"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("row_idx")
    )


def the_universe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, d, "part").select(k.alias("uid"), F.concat(F.lit("chr"), (1 + k % 5).cast("string")).alias("chrom"), (k * 40).alias("start"), (k * 40 + 20 + 3 * F.col("p_size")).alias("end"))


def right(u: DataFrame) -> DataFrame:
    return u.select("uid", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    both = regions(spark, d).select("chrom", "end").unionByName(the_universe(spark, d).select("chrom", "end"))
    return both.groupBy("chrom").agg(((F.floor(F.max("end") / 1000) + 1) * 1000).alias("size"))


# ---- intervals ----------------------------------------------------------------------------------------------------


@query(f'WITH {_R}, {_M} SELECT bed_id, chrom, "start", "end" FROM m')
def merge_regions(spark, d):
    return intervals.merge(regions(spark, d), "bed_id")


@query(f'WITH {_R}, {_U} SELECT DISTINCT r.bed_id, u.uid FROM r JOIN u ON r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end"')
def tokenize_hard(spark, d):
    return intervals.tokenize(regions(spark, d), the_universe(spark, d), 1e-9, "bed_id")


@query(f'WITH {_R}, {_U} SELECT DISTINCT r.bed_id, u.uid FROM r JOIN u ON r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end" WHERE least(r."end", u."end") - greatest(r."start", u."start") >= 0.5 * (u."end" - u."start")')
def tokenize_hard_fraction(spark, d):
    return intervals.tokenize(regions(spark, d), the_universe(spark, d), 0.5, "bed_id")


@query(f'WITH {_R}, {_U} SELECT r.bed_id, r.row_idx, u.uid FROM r JOIN u ON r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end"')
def overlap_pairs(spark, d):
    return intervals.interval_join(regions(spark, d), right(the_universe(spark, d))).select("bed_id", "row_idx", "uid")


@query(f'WITH {_R}, {_U} SELECT r.bed_id, r.row_idx, string_agg(CAST(coalesce(u.uid, -1) AS VARCHAR), \',\' ORDER BY u.uid) AS tokens FROM r LEFT JOIN u ON r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end" GROUP BY 1, 2')
def token_ids_per_region(spark, d):
    r = regions(spark, d)
    found = intervals.interval_join(r, right(the_universe(spark, d))).select("bed_id", "row_idx", "uid").groupBy("bed_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("uid")), lambda x: x.cast("string")), ",").alias("tokens"))
    return r.select("bed_id", "row_idx").distinct().join(found, ["bed_id", "row_idx"], "left").fillna("-1", ["tokens"])


_VOCAB = "vo AS (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS id FROM u)"
_TOKENS = f"""{_R}, {_U}, {_VOCAB}, rr AS (SELECT DISTINCT bed_id, row_idx, chrom, "start", "end" FROM r), ro AS (SELECT DISTINCT bed_id, row_idx FROM r),
hit AS (SELECT DISTINCT rr.bed_id, rr.row_idx, vo.id FROM rr JOIN vo ON rr.chrom = vo.chrom AND rr."start" < vo."end" AND vo."start" < rr."end"),
tk AS (SELECT ro.bed_id, ro.row_idx, coalesce(hit.id, (SELECT count(*) FROM u)) AS id FROM ro LEFT JOIN hit ON ro.bed_id = hit.bed_id AND ro.row_idx = hit.row_idx)"""


def _token_rows(spark, d) -> DataFrame:
    return encode.token_rows(regions(spark, d), encode.vocabulary(the_universe(spark, d)), "bed_id")


@query(f"WITH {_TOKENS} SELECT bed_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS tokens FROM tk GROUP BY bed_id")
def token_ids_per_file(spark, d):
    lists = encode.token_lists(_token_rows(spark, d), "bed_id")
    return lists.select("bed_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"))


@query(f"WITH {_TOKENS} SELECT bed_id, CAST(count(*) AS BIGINT) AS unknown FROM tk WHERE id = (SELECT count(*) FROM u) GROUP BY bed_id")
def token_unknown_count(spark, d):
    vocab = encode.vocabulary(the_universe(spark, d))
    return _token_rows(spark, d).where(F.col("id") == encode.special_id(vocab, "unk")).groupBy("bed_id").agg(F.count(F.lit(1)).alias("unknown"))


_EMBED = "em AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _pooled_sql(key: str, of: str) -> str:
    return f"pe AS (SELECT {key}, i, avg(v[i]) AS x FROM {of} JOIN em USING (id), (SELECT unnest(range(1, 65)) AS i) GROUP BY {key}, i)"


def _digest(v) -> list:
    return [F.round(F.col(v)[0], 6).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total")]


@query(f"WITH {_TOKENS}, {_EMBED}, {_pooled_sql('bed_id, row_idx', 'tk')}, pd AS (SELECT bed_id, row_idx, round(any_value(x) FILTER (i = 1), 6) AS first, round(sum(x), 6) AS total FROM pe GROUP BY 1, 2) SELECT ro.bed_id, ro.row_idx, first, total FROM ro LEFT JOIN pd ON ro.bed_id = pd.bed_id AND ro.row_idx = pd.row_idx")
def encode_regions(spark, d):
    return encode.encode_regions(_token_rows(spark, d), vectors(spark, d), "bed_id").select("bed_id", "row_idx", *_digest("v"))


@query(f"WITH {_TOKENS}, {_EMBED}, {_pooled_sql('bed_id, row_idx', 'tk')} SELECT bed_id, i - 1 AS pos, round(avg(x), 6) AS x FROM pe GROUP BY 1, 2")
def encode_files(spark, d):
    return encode.file_vectors(_token_rows(spark, d), vectors(spark, d)).select("bed_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f'WITH {_R}, {_U} SELECT bed_id, row_idx FROM r WHERE EXISTS (SELECT 1 FROM u WHERE r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end")')
def overlap_semi(spark, d):
    return intervals.interval_join(regions(spark, d), right(the_universe(spark, d)), "semi").select("bed_id", "row_idx")


@query(f'WITH {_R}, {_U} SELECT bed_id, row_idx FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end")')
def overlap_anti(spark, d):
    return intervals.interval_join(regions(spark, d), right(the_universe(spark, d)), "anti").select("bed_id", "row_idx")


_BP = f"""{_R}, {_U}, {_M}, {_MU},
ov AS (SELECT m.bed_id, CAST(sum(least(m."end", mu."end") - greatest(m."start", mu."start")) AS BIGINT) AS overlap FROM m JOIN mu ON m.chrom = mu.chrom AND m."start" < mu."end" AND mu."start" < m."end" GROUP BY 1),
bp AS (SELECT m.bed_id, CAST(any_value(t.u) - coalesce(any_value(overlap), 0) AS BIGINT) AS only_universe, CAST(sum("end" - "start") - coalesce(any_value(overlap), 0) AS BIGINT) AS only_file, CAST(coalesce(any_value(overlap), 0) AS BIGINT) AS overlap
  FROM m LEFT JOIN ov ON m.bed_id = ov.bed_id, (SELECT sum("end" - "start") AS u FROM mu) t GROUP BY m.bed_id)"""


@query(f"WITH {_BP} SELECT * FROM bp")
def overlap_bp(spark, d):
    return intervals.overlap_bp(regions(spark, d), the_universe(spark, d))


_F10 = "101 * p * q / nullif(100 * p + q, 0)"
_PQ = "(SELECT *, overlap / nullif(overlap + only_universe, 0) AS p, overlap / nullif(overlap + only_file, 0) AS q FROM bp)"


@query(f"WITH {_BP} SELECT bed_id, round({_F10}, 6) AS f10 FROM {_PQ}")
def f10_score(spark, d):
    return intervals.overlap_bp(regions(spark, d), the_universe(spark, d)).select("bed_id", F.round(fn.f_beta(F.col("overlap"), F.col("only_file"), F.col("only_universe")), 6).alias("f10"))


def _near(asked: str, of: str, key: str) -> str:
    parts = [f'SELECT a.bed_id, min(abs(a."{c}" - b."{c}")) AS x FROM {asked} a JOIN {of} b ON {key} GROUP BY a.bed_id, a.n' for c in ("start", "end")]
    return f"SELECT bed_id, median(x) AS median_distance FROM ({parts[0]} UNION ALL {parts[1]}) GROUP BY bed_id"


_TO = f'{_R}, {_U}, {_M}, mn AS (SELECT *, row_number() OVER () AS n FROM m), un AS (SELECT f.bed_id, u.*, row_number() OVER () AS n FROM u, (SELECT DISTINCT bed_id FROM m) f)'
_NEAR_FILE, _NEAR_UNIVERSE = _near("mn", "u", "a.chrom = b.chrom"), _near("un", "m", "a.chrom = b.chrom AND a.bed_id = b.bed_id")


@query(f"WITH {_TO} {_NEAR_FILE}")
def nearest_file_to_universe(spark, d):
    return intervals.boundary_distances(regions(spark, d), the_universe(spark, d))


@query(f"WITH {_TO} {_NEAR_UNIVERSE}")
def nearest_universe_to_file(spark, d):
    return intervals.universe_distances(regions(spark, d), the_universe(spark, d))


@query(f"""WITH {_BP}, mn AS (SELECT *, row_number() OVER () AS n FROM m), un AS (SELECT f.bed_id, u.*, row_number() OVER () AS n FROM u, (SELECT DISTINCT bed_id FROM m) f), a AS ({_NEAR_FILE}), b AS ({_NEAR_UNIVERSE})
SELECT x.bed_id, overlap, only_file, only_universe, a.median_distance AS to_universe, b.median_distance AS from_universe, round({_F10}, 6) AS f10, round((1010.0 / (a.median_distance + 100) + 101.0 / (b.median_distance + 100)) / 11, 6) AS rbs FROM {_PQ} x JOIN a ON x.bed_id = a.bed_id JOIN b ON x.bed_id = b.bed_id""")
def assessment_table(spark, d):
    return universe.assessment(regions(spark, d), the_universe(spark, d)).withColumns({"f10": F.round("f10", 6), "rbs": F.round("rbs", 6)})


_F = "f AS (SELECT p_partkey AS uid, 'chr' || CAST(1 + p_partkey % 5 AS VARCHAR) AS chrom, p_partkey * 40 AS s0, p_partkey * 40 + 5 AS s1, p_partkey * 40 + 15 + 3 * p_size AS e0, p_partkey * 40 + 20 + 3 * p_size AS e1 FROM part)"


def flexible(spark: SparkSession, d: str) -> DataFrame:
    """The universe with flanks of five positions."""
    return the_universe(spark, d).select("uid", "chrom", "start", (F.col("start") + 5).alias("core_start"), (F.col("end") - 5).alias("core_end"), "end")


_SPAN = "min(CASE WHEN q BETWEEN lo AND hi THEN 0 ELSE least(abs(lo - q), abs(hi - q)) END) AS x"


@query(f"""WITH {_R}, {_M}, {_F}, mq AS (SELECT row_number() OVER () AS n, * FROM m), q AS (SELECT n, bed_id, chrom, 0 AS k, "start" AS q FROM mq UNION ALL SELECT n, bed_id, chrom, 1, "end" FROM mq),
t AS (SELECT chrom, 0 AS k, s0 AS lo, s1 AS hi FROM f UNION ALL SELECT chrom, 1, e0, e1 FROM f), p AS (SELECT n, q.k, bed_id, {_SPAN} FROM q JOIN t ON q.chrom = t.chrom AND q.k = t.k GROUP BY 1, 2, 3) SELECT bed_id, CAST(median(x) AS DOUBLE) AS median_distance FROM p GROUP BY 1""")
def nearest_flexible_file_to_universe(spark, d):
    return intervals.flexible_boundary_distances(regions(spark, d), flexible(spark, d))


@query(f"""WITH {_R}, {_M}, {_F}, q AS (SELECT bed_id, chrom, 0 AS k, "start" AS q FROM m UNION ALL SELECT bed_id, chrom, 1, "end" FROM m),
t AS (SELECT uid, chrom, 0 AS k, s0 AS lo, s1 AS hi FROM f UNION ALL SELECT uid, chrom, 1, e0, e1 FROM f), p AS (SELECT uid, q.k, bed_id, {_SPAN} FROM q JOIN t ON q.chrom = t.chrom AND q.k = t.k GROUP BY 1, 2, 3) SELECT bed_id, CAST(median(x) AS DOUBLE) AS median_distance FROM p GROUP BY 1""")
def nearest_flexible_universe_to_file(spark, d):
    return intervals.flexible_universe_distances(regions(spark, d), flexible(spark, d))


def _cov(points: str, name: str = "cov") -> str:
    return f"""e AS ({points}), st AS (SELECT chrom, pos, sum(d) AS d FROM e GROUP BY 1, 2),
{name} AS (SELECT chrom, pos AS "start", lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end", CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS cov FROM st QUALIFY cov > 0)"""


_CORE = _cov('SELECT chrom, "start" AS pos, 1 AS d FROM r UNION ALL SELECT chrom, "end", -1 FROM r')


@query(f'WITH {_R}, {_CORE} SELECT chrom, "start", "end", cov FROM cov')
def coverage_core(spark, d):
    return intervals.coverage(regions(spark, d))


@query(f"""WITH {_R}, {_cov('SELECT chrom, greatest("start" - 5, 0) AS pos, 1 AS d FROM r UNION ALL SELECT chrom, "start" + 6, -1 FROM r')} SELECT chrom, "start", "end", cov FROM cov""")
def coverage_start(spark, d):
    return intervals.boundary_coverage(regions(spark, d), "start", 5)


@query(f"""WITH {_R}, {_cov('SELECT chrom, greatest("end" - 5, 0) AS pos, 1 AS d FROM r UNION ALL SELECT chrom, "end" + 6, -1 FROM r')} SELECT chrom, "start", "end", cov FROM cov""")
def coverage_end(spark, d):
    return intervals.boundary_coverage(regions(spark, d), "end", 5)


def _islands(of: str, gap: int) -> str:
    return f"""SELECT chrom, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS i FROM
  (SELECT *, CASE WHEN "start" - (lag("end") OVER (PARTITION BY chrom ORDER BY "start") - 1) >= {gap} THEN 1 ELSE 0 END AS o FROM {of})) GROUP BY chrom, i"""


_CUT = 'c AS (SELECT cov.* FROM cov JOIN (SELECT cov.chrom, sum(cov * ("end" - "start")) / any_value(size) AS mean FROM cov JOIN sz ON cov.chrom = sz.chrom GROUP BY 1) a ON cov.chrom = a.chrom WHERE cov >= mean)'


@query(f"WITH {_R}, {_U}, {_SIZES}, {_CORE}, {_CUT} {_islands('c', 2)}")
def universe_cc(spark, d):
    return universe.cc(intervals.coverage(regions(spark, d)), sizes(spark, d))


@query(f'WITH {_R}, {_CORE}, c AS (SELECT * FROM cov WHERE cov >= 3), i AS ({_islands("c", 50)}) SELECT * FROM i WHERE "end" - "start" >= 100')
def universe_cc_merged(spark, d):
    return universe.cc(intervals.coverage(regions(spark, d)), sizes(spark, d), 3, 50, 100)


@query(f'WITH {_U} SELECT uid, chrom, "start", "end" FROM u WHERE "end" - "start" > 100')
def universe_filter(spark, d):
    return universe.filter_universe(the_universe(spark, d), 100)


_DEPTH = _cov('SELECT chrom, "start" AS pos, 1 AS d FROM m UNION ALL SELECT chrom, "end", -1 FROM m')
_LH = f"""{_R}, {_U}, {_SIZES}, {_M}, {_DEPTH}, ms AS (SELECT cov.chrom, sum(cov * ("end" - "start")) AS c, any_value(size) AS size FROM cov JOIN sz ON cov.chrom = sz.chrom GROUP BY 1),
md AS (SELECT x.chrom, x.cov, log10((8 - x.cov) / (8 * size - c) + 1e-10) AS bg, log10(x.cov / c + 1e-10) AS fg FROM (SELECT DISTINCT chrom, cov FROM cov UNION SELECT DISTINCT chrom, 0 FROM cov) x JOIN ms ON x.chrom = ms.chrom)"""


def _depth(spark, d) -> DataFrame:
    """In how many of the eight files each position is covered."""
    return intervals.coverage(intervals.merge(regions(spark, d), "bed_id"))


@query(f"WITH {_LH} SELECT chrom, cov, round(bg, 6) AS bg, round(fg, 6) AS fg FROM md")
def lh_model(spark, d):
    return universe.likelihood_model(_depth(spark, d), sizes(spark, d), 8).select("chrom", "cov", F.round("bg", 6).alias("bg"), F.round("fg", 6).alias("fg"))


@query(f"""WITH {_LH}, k AS (SELECT cov.chrom, "start", "end", bg, fg FROM cov JOIN md ON cov.chrom = md.chrom AND cov.cov = md.cov),
g AS (SELECT chrom, sum(("end" - "start") * bg) AS held, sum("end" - "start") AS covered FROM k GROUP BY 1), z AS (SELECT chrom, bg AS bg0, fg AS fg0 FROM md WHERE cov = 0),
i AS (SELECT k.chrom, sum((least(k."end", u."end") - greatest(k."start", u."start")) * (fg - bg)) AS gain, sum(least(k."end", u."end") - greatest(k."start", u."start")) AS met FROM k JOIN u ON k.chrom = u.chrom AND k."start" < u."end" AND u."start" < k."end" GROUP BY 1),
ub AS (SELECT chrom, sum("end" - "start") AS ubp FROM u GROUP BY 1)
SELECT g.chrom, round(held + (size - covered) * bg0 + (coalesce(ubp, 0) - coalesce(met, 0)) * (fg0 - bg0) + coalesce(gain, 0), 3) AS likelihood FROM g JOIN z ON g.chrom = z.chrom JOIN sz ON g.chrom = sz.chrom LEFT JOIN i ON g.chrom = i.chrom LEFT JOIN ub ON g.chrom = ub.chrom""")
def lh_hard(spark, d):
    cov = cut(_depth(spark, d))
    out = universe.hard_likelihood(cov, sizes(spark, d), universe.likelihood_model(cov, sizes(spark, d), 8), the_universe(spark, d))
    return out.select("chrom", F.round("likelihood", 3).alias("likelihood"))


_CUTS = f"""{_R}, {_U}, {_SIZES}, {_CORE}, hn AS (SELECT chrom, cov, sum("end" - "start") AS n FROM cov GROUP BY 1, 2),
h AS (SELECT hn.chrom, cov, n, sum(n) OVER (PARTITION BY hn.chrom ORDER BY cov) AS upto, sum(n) OVER (PARTITION BY hn.chrom) AS a, abs(cov - greatest(round_even(sum(cov * n) OVER (PARTITION BY hn.chrom) / size, 0), 1)) AS far FROM hn JOIN sz ON hn.chrom = sz.chrom),
q AS (SELECT chrom, a, ((upto - n) / a + (upto - 1) / a) / 2 AS q FROM h QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY far, cov) = 1),
w AS (SELECT chrom, a, greatest(q - 0.2::DOUBLE, 0) * (a - 1) AS lo, least(q + 0.2::DOUBLE, 1) * (a - 1) AS hi FROM q),
v AS (SELECT w.chrom, lo, hi, min(cov) FILTER (upto > floor(lo)) AS l0, min(cov) FILTER (upto > least(floor(lo) + 1, w.a - 1)) AS l1, min(cov) FILTER (upto > floor(hi)) AS h0, min(cov) FILTER (upto > least(floor(hi) + 1, w.a - 1)) AS h1 FROM w JOIN h ON w.chrom = h.chrom GROUP BY 1, 2, 3),
cu AS (SELECT chrom, l0 + (l1 - l0) * (lo - floor(lo)) AS lower, h0 + (h1 - h0) * (hi - floor(hi)) AS upper FROM v)"""


@query(f"WITH {_CUTS} SELECT chrom, round(lower, 6) AS lower, round(upper, 6) AS upper FROM cu")
def flexible_cutoffs(spark, d):
    out = universe.flexible_cutoffs(intervals.coverage(regions(spark, d)), sizes(spark, d))
    return out.select("chrom", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(f"""WITH {_CUTS}, b AS (SELECT cov.chrom, unnest(range("start", "end")) AS pos, cov, cov > upper AS core FROM cov JOIN cu ON cov.chrom = cu.chrom WHERE cov >= lower),
rn AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM b),
pl AS (SELECT *, max(CASE WHEN core THEN pos END) OVER (PARTITION BY chrom, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM rn),
x AS (SELECT *, sum(CASE WHEN core AND (pl IS NULL OR pos - pl >= 50) THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM pl),
c AS (SELECT chrom, run, g, min(pos) FILTER (core) AS f, max(pos) FILTER (core) AS l FROM x WHERE g > 0 GROUP BY 1, 2, 3),
s AS (SELECT x.chrom, x.run, x.g, arg_min(pos, cov * 1000000000 + pos) AS sp FROM x JOIN c ON x.chrom = c.chrom AND x.run = c.run AND x.g = c.g WHERE pos >= l GROUP BY 1, 2, 3),
rr AS (SELECT chrom, run, min(pos) AS lo, max(pos) AS hi FROM x GROUP BY 1, 2),
o AS (SELECT c.chrom, f, l, lo, hi, sp, lag(sp) OVER w AS was, lead(c.g) OVER w IS NOT NULL AS more FROM c JOIN s ON c.chrom = s.chrom AND c.run = s.run AND c.g = s.g JOIN rr ON c.chrom = rr.chrom AND c.run = rr.run WINDOW w AS (PARTITION BY c.chrom, c.run ORDER BY c.g)),
z AS (SELECT chrom, coalesce(was + 1, lo) AS "start", f, l, hi, CASE WHEN more THEN sp + 1 ELSE hi + 1 END AS "end" FROM o),
y AS (SELECT chrom, "start", CASE WHEN f = "start" THEN f + 1 ELSE f END AS core_start, CASE WHEN l = hi THEN l - 1 ELSE l END AS core_end, "end" FROM z) SELECT * FROM y WHERE core_start <> core_end""")
def universe_ccf(spark, d):
    return universe.ccf(intervals.coverage(regions(spark, d)), sizes(spark, d))


@query(f"""WITH {_R}, {_CORE}, h AS (SELECT chrom, cov, sum("end" - "start") AS n FROM cov GROUP BY 1, 2),
m AS (SELECT chrom, cov, (sum(n) OVER (PARTITION BY chrom ORDER BY cov) - n / 2) / sum(n) OVER (PARTITION BY chrom) AS m FROM h) SELECT chrom, cov, CAST(ceil(ln(1 - m) / ln(0.8::DOUBLE)) - 1 AS BIGINT) AS value FROM m""")
def hmm_normalised_depth(spark, d):
    return universe.normalised_depth(intervals.coverage(regions(spark, d)), 0.2)


def _tracks(spark, d) -> DataFrame:
    m = intervals.merge(regions(spark, d), "bed_id")
    own = {"core": intervals.coverage(m), "start": intervals.boundary_coverage(m, "start", 0), "end": intervals.boundary_coverage(m, "end", 0)}
    parts = [x.withColumn("track", F.lit(k)) for k, x in own.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FLH = f"""{_R}, {_U}, {_SIZES}, {_M}, {_F}, te AS (SELECT 'core' AS track, chrom, "start" AS pos, 1 AS d FROM m UNION ALL SELECT 'core', chrom, "end", -1 FROM m UNION ALL SELECT 'start', chrom, "start", 1 FROM m UNION ALL SELECT 'start', chrom, "start" + 1, -1 FROM m
  UNION ALL SELECT 'end', chrom, "end", 1 FROM m UNION ALL SELECT 'end', chrom, "end" + 1, -1 FROM m), ts AS (SELECT track, chrom, pos, sum(d) AS d FROM te GROUP BY 1, 2, 3),
cov AS (SELECT track, chrom, pos AS "start", lead(pos) OVER o AS "end", CAST(sum(d) OVER o AS BIGINT) AS cov FROM ts WINDOW o AS (PARTITION BY track, chrom ORDER BY pos) QUALIFY cov > 0),
ms AS (SELECT track, cov.chrom, sum(cov * ("end" - "start")) AS c, any_value(size) AS size FROM cov JOIN sz ON cov.chrom = sz.chrom GROUP BY 1, 2),
md AS (SELECT x.track, x.chrom, x.cov, log10((8 - x.cov) / (8 * size - c) + 1e-10) AS bg, log10(x.cov / c + 1e-10) AS fg FROM (SELECT DISTINCT track, chrom, cov FROM cov UNION SELECT DISTINCT track, chrom, 0 FROM cov) x JOIN ms ON x.chrom = ms.chrom AND x.track = ms.track),
fp AS (SELECT *, unnest(range(s0, e1)) AS pos FROM f),
wt AS (SELECT uid, chrom, pos, 'core' AS track, CASE WHEN pos < s1 THEN (pos - s0 + 1) / (s1 - s0) WHEN pos < e0 THEN 1 ELSE (e1 - pos) / (e1 - e0) END AS w FROM fp UNION ALL SELECT uid, chrom, pos, 'start', 1 / (s1 - s0) FROM fp WHERE pos < s1 UNION ALL SELECT uid, chrom, pos, 'end', 1 / (e1 - e0) FROM fp WHERE pos >= e0),
de AS (SELECT wt.*, CASE WHEN wt.pos < cov."end" THEN cov.cov ELSE 0 END AS depth FROM wt ASOF LEFT JOIN cov ON wt.chrom = cov.chrom AND wt.track = cov.track AND wt.pos >= cov."start"),
ga AS (SELECT de.chrom, uid, sum(w * (fg - bg)) AS gain FROM de JOIN md ON de.chrom = md.chrom AND de.track = md.track AND de.depth = md.cov GROUP BY 1, 2)"""


@query(f"WITH {_FLH} SELECT chrom, uid, round(gain, 4) AS gain FROM ga")
def lh_flexible_regions(spark, d):
    t = cut(_tracks(spark, d))
    return universe.flexible_gains(t, universe.track_models(t, sizes(spark, d), 8), flexible(spark, d)).select("chrom", "uid", F.round("gain", 4).alias("gain"))


@query(f"""WITH {_FLH}, hd AS (SELECT cov.track, cov.chrom, sum(("end" - "start") * bg) AS held, sum("end" - "start") AS covered FROM cov JOIN md ON cov.chrom = md.chrom AND cov.track = md.track AND cov.cov = md.cov GROUP BY 1, 2),
gr AS (SELECT hd.chrom, sum(held + (size - covered) * bg) AS ground FROM hd JOIN md ON hd.chrom = md.chrom AND hd.track = md.track AND md.cov = 0 JOIN sz ON hd.chrom = sz.chrom GROUP BY 1), gs AS (SELECT chrom, sum(gain) AS gain FROM ga GROUP BY 1)
SELECT gr.chrom, round(ground + coalesce(gain, 0), 3) AS likelihood FROM gr LEFT JOIN gs ON gr.chrom = gs.chrom""")
def lh_flexible(spark, d):
    return universe.likelihood(cut(_tracks(spark, d)), sizes(spark, d), 8, flexible(spark, d)).select("chrom", F.round("likelihood", 3).alias("likelihood"))


@query(f"""WITH {_FLH}, kk AS (SELECT cov.*, bg, fg FROM cov JOIN md ON cov.chrom = md.chrom AND cov.track = md.track AND cov.cov = md.cov), z AS (SELECT track, chrom, bg AS bg0, fg AS fg0 FROM md WHERE cov = 0),
hd AS (SELECT track, chrom, sum(("end" - "start") * bg) AS held, sum("end" - "start") AS covered FROM kk GROUP BY 1, 2), us AS (SELECT 'core' AS track, chrom, "start", "end" FROM u UNION ALL SELECT 'start', chrom, "start", "start" + 1 FROM u UNION ALL SELECT 'end', chrom, "end", "end" + 1 FROM u),
i AS (SELECT kk.track, kk.chrom, sum((least(kk."end", us."end") - greatest(kk."start", us."start")) * (fg - bg)) AS gain, sum(least(kk."end", us."end") - greatest(kk."start", us."start")) AS met FROM kk JOIN us ON kk.chrom = us.chrom AND kk.track = us.track AND kk."start" < us."end" AND us."start" < kk."end" GROUP BY 1, 2),
ub AS (SELECT track, chrom, sum("end" - "start") AS ubp FROM us GROUP BY 1, 2)
SELECT hd.chrom, round(sum(held + (size - covered) * bg0 + (coalesce(ubp, 0) - coalesce(met, 0)) * (fg0 - bg0) + coalesce(gain, 0)), 3) AS likelihood FROM hd JOIN z ON hd.chrom = z.chrom AND hd.track = z.track JOIN sz ON hd.chrom = sz.chrom LEFT JOIN i ON hd.chrom = i.chrom AND hd.track = i.track LEFT JOIN ub ON hd.chrom = ub.chrom AND hd.track = ub.track GROUP BY hd.chrom""")
def lh_hard_tracks(spark, d):
    return universe.likelihood(cut(_tracks(spark, d)), sizes(spark, d), 8, the_universe(spark, d)).select("chrom", F.round("likelihood", 3).alias("likelihood"))


def _segments_sql(of: str) -> str:
    """Runs (chrom, s, e) of covered positions and zero runs (chrom, s, e) before and between them, from ``cov``."""
    return f"""ru AS (SELECT chrom, min("start") AS s, max("end") AS e FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN "start" = lag("end") OVER (PARTITION BY chrom ORDER BY "start") THEN 0 ELSE 1 END AS o FROM {of})) GROUP BY chrom, i),
ze AS (SELECT chrom, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s), 0) AS zs, s AS ze FROM ru QUALIFY zs < ze)"""


_UCOV = _cov('SELECT chrom, "start" AS pos, 1 AS d FROM u UNION ALL SELECT chrom, "end", -1 FROM u')


def _covered_sql(gap: int, area: int) -> str:
    return f"""ci AS (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s - (lag(e) OVER (PARTITION BY chrom ORDER BY s) - 1) <= {gap} THEN 0 ELSE 1 END AS o FROM ru)) GROUP BY chrom, i),
cs AS (SELECT ci.chrom, CASE WHEN s = min(s) OVER (PARTITION BY ci.chrom) AND s <= {gap} THEN 0 ELSE s - {area} END AS "start", CASE WHEN e = max(e) OVER (PARTITION BY ci.chrom) THEN least(e - 1 + {area}, size) ELSE e - 1 + {area} END AS "end" FROM ci JOIN sz ON ci.chrom = sz.chrom)"""


def _between_sql(gap: int, area: int) -> str:
    return f"""kz AS (SELECT * FROM ze QUALIFY zs = min(zs) OVER (PARTITION BY chrom) OR ze.ze - zs >= {gap}),
bs AS (SELECT kz.chrom, greatest(kz.ze - 1 - {area}, 0) AS "start", coalesce(lead(zs) OVER (PARTITION BY kz.chrom ORDER BY zs) + {area}, size) AS "end" FROM kz JOIN sz ON kz.chrom = sz.chrom
UNION ALL SELECT sz.chrom, 0, size FROM sz WHERE chrom IN (SELECT chrom FROM ru) AND chrom NOT IN (SELECT chrom FROM ze))"""


@query(f'WITH {_R}, {_U}, {_SIZES}, {_UCOV}, {_segments_sql("cov")}, {_covered_sql(150, 60)} SELECT chrom, "start", "end" FROM cs')
def segments_covered(spark, d):
    return intervals.covered_segments(intervals.coverage(the_universe(spark, d)), sizes(spark, d), 150, 60)


@query(f'WITH {_R}, {_U}, {_SIZES}, {_UCOV}, {_segments_sql("cov")}, {_between_sql(150, 60)} SELECT chrom, "start", "end" FROM bs')
def segments_between_gaps(spark, d):
    return intervals.segments_between_gaps(intervals.coverage(the_universe(spark, d)), sizes(spark, d), 150, 60)


@query(f"""WITH {_R}, {_U}, {_SIZES}, {_CORE}, {_segments_sql("cov")}, {_covered_sql(1000, 500)}, {_between_sql(10000, 1000)}, sp AS (SELECT ru.chrom FROM ru JOIN sz ON ru.chrom = sz.chrom GROUP BY 1 HAVING sum(e - s) < any_value(size) - sum(e - s))
SELECT chrom, "start", "end" FROM cs WHERE chrom IN (SELECT chrom FROM sp) UNION ALL SELECT chrom, "start", "end" FROM bs WHERE chrom NOT IN (SELECT chrom FROM sp)""")
def nonzero_segments(spark, d):
    return intervals.nonzero_segments(intervals.coverage(regions(spark, d)), sizes(spark, d))


def _written_tracks(spark, d) -> tuple[DataFrame, DataFrame]:
    """The three tracks, and the segments in which any has depth."""
    t = cut(_tracks(spark, d))
    return t, cut(intervals.nonzero_segments(intervals.coverage(t), sizes(spark, d)))


@query()
def universe_ml(spark, d):
    t, segments = _written_tracks(spark, d)
    return universe.maximum_likelihood(t, segments, cut(universe.track_models(t, sizes(spark, d), 8)))


@query()
def universe_hmm(spark, d):
    t, segments = _written_tracks(spark, d)
    return universe.hidden_states(universe.normalised_tracks(t), segments)


@query(f"""WITH {_U}, n AS (SELECT uid, chrom, "start", "end", row_number() OVER (PARTITION BY chrom ORDER BY "start", uid) AS n FROM u),
p AS (SELECT a.uid, b.uid AS neighbour, CASE WHEN a."end" < b."end" THEN greatest(b."start" - a."end" + 1, 0) ELSE greatest(a."start" - b."end" + 1, 0) END AS x FROM n a JOIN n b ON a.chrom = b.chrom AND a.uid <> b.uid AND b.n BETWEEN a.n - 4 AND a.n + 4),
k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY x, neighbour) AS place FROM p) SELECT uid, neighbour, place FROM k WHERE place <= 4""")
def genome_neighbours(spark, d):
    return intervals.neighbours(the_universe(spark, d), 4)


@query(f"""WITH {_R}, {_U}, un AS (SELECT chrom, "start", "end", min(row_idx) AS uid FROM r WHERE bed_id = 0 GROUP BY 1, 2, 3) SELECT un.uid, r.bed_id FROM (SELECT DISTINCT bed_id, chrom, "start", "end" FROM r) r JOIN un ON r.chrom = un.chrom AND r."start" = un."start" AND r."end" = un."end\"""")
def binary_incidence(spark, d):
    r = regions(spark, d)
    of_one = r.where("bed_id = 0").groupBy("chrom", "start", "end").agg(F.min("row_idx").alias("uid"))  # the first file's regions as the universe
    return intervals.incidence(r, of_one)


@query(f"""WITH {_R}, k AS (SELECT *, 1 + CAST(substr(chrom, 4) AS INT) AS c FROM r), l AS (SELECT *, lag(c) OVER w AS pc, lag("start") OVER w AS ps FROM k WINDOW w AS (PARTITION BY bed_id ORDER BY row_idx)) SELECT bed_id, row_idx, chrom, "start" FROM l WHERE c < pc OR c = pc AND "start" < ps""")
def unsorted_rows(spark, d):
    return intervals.unsorted_rows(regions(spark, d))


_RBS = "round((1010.0 / (a.median_distance + 100) + 101.0 / (b.median_distance + 100)) / 11, 6)"


@query(f"WITH {_TO}, a AS ({_NEAR_FILE}), b AS ({_NEAR_UNIVERSE}) SELECT a.bed_id, {_RBS} AS rbs FROM a JOIN b ON a.bed_id = b.bed_id")
def rbs_per_file(spark, d):
    return universe.assessment(regions(spark, d), the_universe(spark, d)).select("bed_id", F.round("rbs", 6).alias("rbs"))


@query(f"""WITH {_BP}, mn AS (SELECT *, row_number() OVER () AS n FROM m), un AS (SELECT f.bed_id, u.*, row_number() OVER () AS n FROM u, (SELECT DISTINCT bed_id FROM m) f), a AS ({_NEAR_FILE}), b AS ({_NEAR_UNIVERSE}), x AS (SELECT {_F10} AS f10, (1010.0 / (a.median_distance + 100) + 101.0 / (b.median_distance + 100)) / 11 AS rbs FROM {_PQ} x JOIN a ON x.bed_id = a.bed_id JOIN b ON x.bed_id = b.bed_id)
SELECT round(avg(rbs), 6) AS rbs, round(avg(f10), 6) AS f10 FROM x""")
def mean_scores(spark, d):
    return universe.mean_scores(universe.assessment(regions(spark, d), the_universe(spark, d))).select(F.round("rbs", 6).alias("rbs"), F.round("f10", 6).alias("f10"))


_MAF = "mf AS (SELECT 'chr' || CAST(1 + l_orderkey % 5 AS VARCHAR) AS chrom, l_partkey AS s, l_partkey + l_linenumber % 2 AS e FROM lineitem)"


@query(f'WITH {_MAF} SELECT chrom, s AS "start", CASE WHEN s = e THEN e + 1 ELSE e END AS "end" FROM mf')
def snp_to_region(spark, d):
    chrom = F.concat(F.lit("chr"), (1 + F.col("l_orderkey") % 5).cast("string")).alias("Chromosome")
    return files.maf_regions(_read(spark, d, "lineitem").select(chrom, F.col("l_partkey").alias("Start_position"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("End_position")))


@query("SELECT p_partkey AS bed_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def catalog_missing(spark, d):
    done = _read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("bed_id"))
    return catalog.missing(_read(spark, d, "part").select(F.col("p_partkey").alias("bed_id")), done)


# ---- identifiers and metadata -------------------------------------------------------------------------------------


def _agg(c: str) -> str:
    return f"md5(string_agg(CAST(\"{c}\" AS VARCHAR), ',' ORDER BY row_idx, \"start\", \"end\"))"


@query(f"WITH {_R} SELECT bed_id, md5({_agg('chrom')} || ',' || {_agg('start')} || ',' || {_agg('end')}) AS identifier FROM r GROUP BY bed_id")
def bed_identifier(spark, d):
    return catalog.identifiers(regions(spark, d))


@query(f"WITH {_R}, i AS (SELECT bed_id, md5({_agg('chrom')} || ',' || {_agg('start')} || ',' || {_agg('end')}) AS identifier FROM r GROUP BY bed_id) SELECT md5(string_agg(identifier, '' ORDER BY bed_id)) AS identifier FROM i")
def bedset_identifier(spark, d):
    return catalog.set_identifier(catalog.identifiers(regions(spark, d)).withColumnRenamed("bed_id", "ord"))


@query("""WITH n AS (SELECT 'chr' || CASE WHEN n_nationkey < 22 THEN CAST(n_nationkey + 1 AS VARCHAR) ELSE substr(n_name, 1, 1) || CAST(n_nationkey AS VARCHAR) END AS chrom FROM nation)
SELECT chrom, row_number() OVER (ORDER BY coalesce(TRY_CAST(replace(split_part(chrom, '_', 1), 'chr', '') AS INT), 2147483647), chrom) AS place FROM n""")
def natural_sort(spark, d):
    k = F.col("n_nationkey")
    n = _read(spark, d, "nation").select(F.concat(F.lit("chr"), F.when(k < 22, (k + 1).cast("string")).otherwise(F.concat(F.substring("n_name", 1, 1), k.cast("string")))).alias("chrom"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(fn.natural_key(F.col("chrom")))))  # one row a chromosome


_META = "mt AS (SELECT c_name, c_mktsegment, 'g' || CAST(c_nationkey % 3 AS VARCHAR) AS genome, CASE WHEN c_acctbal > 5000 THEN 'rich' END AS tier, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS origin FROM customer)"


def _metadata(spark, d) -> DataFrame:
    return _read(spark, d, "customer").select(
        "c_name", "c_mktsegment", F.concat(F.lit("g"), (F.col("c_nationkey") % 3).cast("string")).alias("genome"), F.when(F.col("c_acctbal") > 5000, "rich").alias("tier"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")).alias("origin")
    )


@query(f"""WITH {_META} SELECT c_mktsegment AS series, CAST(count(*) AS BIGINT) AS files, string_agg(c_name || ':' || coalesce(tier, '') || ':' || coalesce(origin, ''), ',' ORDER BY c_name) AS names FROM mt WHERE genome IN ('g0', 'g2') AND (tier IS NOT NULL OR origin IS NOT NULL) GROUP BY 1""")
def metadata_by_series(spark, d):
    out = catalog.metadata(_metadata(spark, d), ["tier", "origin"], "c_name", series_key="c_mktsegment", genome_key="genome", genomes=["g0", "g2"])
    names = F.transform("files", lambda f: F.concat_ws(":", f["name"], F.coalesce(f["metadata"]["tier"], F.lit("")), F.coalesce(f["metadata"]["origin"], F.lit(""))))
    return out.select("series", F.size("files").cast("long").alias("files"), F.array_join(names, ",").alias("names"))


@query(f"WITH {_META} SELECT 'data/' || c_name AS filename, 'data/' || c_name || ',' || coalesce(tier, '') || ',' || coalesce(origin, '') AS line FROM mt")
def metadata_lines(spark, d):
    return labels.metadata_lines(_metadata(spark, d).withColumnRenamed("c_name", "file_name"), ["tier", "origin"], "data/")


# ---- vectors ------------------------------------------------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(spark, d) -> DataFrame:
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT id AS query_id, v AS q FROM v WHERE id % 20 = 0)"


def _knn(score: str, order: str, low: int = 0, k: int = 10) -> str:
    return f"WITH {_V}, p AS (SELECT query_id, id, {score} AS s FROM q, v WHERE id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, id) AS n FROM p) SELECT query_id, id, n - {low} AS place, round(s, 6) AS score FROM k WHERE n > {low} AND n <= {low + k}"


_COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


@query(_knn(_COS, "DESC"))
def knn_cosine(spark, d):
    return search.knn(_asked(spark, d), vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query(_knn(_COS, "DESC"))
def knn_inverted_file(spark, d):
    """An index of cells, all of which are probed: exact."""
    index = inverted.InvertedFile(f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}").load(vectors(spark, d))
    found = index.search(_asked(spark, d), 10, probes=inverted.MOST_CELLS, itself=False, with_vectors=False)
    return found.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(_knn(_COS, "DESC"))
def knn_quantised(spark, d):
    found = inverted.Quantised().load(vectors(spark, d)).search(_asked(spark, d), 10, itself=False, with_vectors=False)
    return found.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(_knn("list_distance(v, q)", "ASC"))
def knn_quantised_euclidean(spark, d):
    found = inverted.Quantised("l2").load(vectors(spark, d)).search(_asked(spark, d), 10, itself=False, with_vectors=False)
    return found.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(_knn("list_distance(v, q)", "ASC"))
def knn_euclidean(spark, d):
    return search.knn(_asked(spark, d), vectors(spark, d), 10, "l2").withColumn("score", F.round("score", 6))


@query(_knn("len(list_intersect(list_filter(range(64), lambda i: v[i + 1] > 0), list_filter(range(64), lambda i: q[i + 1] > 0))) / len(list_filter(range(64), lambda i: v[i + 1] > 0 OR q[i + 1] > 0))", "DESC"))
def knn_jaccard(spark, d):
    def binary(c):
        return F.transform(c, lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias(c)

    return search.knn(_asked(spark, d).select("query_id", binary("q")), vectors(spark, d).select("id", binary("v")), 10, "jaccard").withColumn("score", F.round("score", 6))


@query(_knn(_COS, "DESC", 5))
def knn_offset(spark, d):
    return search.knn(_asked(spark, d), vectors(spark, d), 10, offset=5).withColumn("score", F.round("score", 6))


@query(f"""WITH {_V}, p AS (SELECT query_id, id, label, {_COS} AS s FROM q, v WHERE id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM p),
c AS (SELECT query_id, label, count(*) AS c, min(n) AS f FROM k WHERE n <= 3 AND s >= 0.05 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f) AS o FROM c)
SELECT q.query_id, coalesce(CAST(b.label AS VARCHAR), 'Unknown') AS label FROM q LEFT JOIN b ON q.query_id = b.query_id AND o = 1""")
def annotate_cells(spark, d):
    near = search.knn(_asked(spark, d), vectors(spark, d), 3).join(vectors(spark, d).select("id", "label"), "id")
    return search.vote(near, "query_id", 0.05)


_REL = f"""WITH {_V}, p AS (SELECT query_id, v.id, CAST(v.label = (SELECT label FROM v x WHERE x.id = query_id) AS INT) AS rel, {_COS} AS s FROM q, v WHERE v.id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM p), t AS (SELECT query_id, n, rel FROM k WHERE n <= 50),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY n) AS hits, sum(rel) OVER (PARTITION BY query_id) AS r, count(*) OVER (PARTITION BY query_id) AS kk FROM t)
SELECT query_id, round(sum(CASE WHEN rel = 1 THEN hits / n ELSE 0 END) / nullif(any_value(r), 0), 6) AS ap, round(sum(CASE WHEN rel = 0 THEN hits END) / nullif(any_value(r) * (any_value(kk) - any_value(r)), 0), 6) AS auc, round(sum(CASE WHEN n <= r THEN rel ELSE 0 END) / nullif(any_value(r), 0), 6) AS rp FROM h GROUP BY 1"""


@query(_REL)
def retrieval_metrics(spark, d):
    own = vectors(spark, d).select("id", "label")
    near = search.knn(_asked(spark, d), vectors(spark, d), 50).join(own, "id").join(own.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    out = search.retrieval_metrics(near.select("query_id", "place", (F.col("label") == F.col("wanted")).cast("int").alias("relevant")))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("ap", "auc", "rp")])


def _pooled(f: str) -> str:
    return f"SELECT label, pos - 1 AS pos, round({f}(CAST(embedding[pos] AS DOUBLE)), 6) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2"


@query(_pooled("avg"))
def pool_mean(spark, d):
    return search.pool(vectors(spark, d), "label").select("label", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(_pooled("max"))
def pool_max(spark, d):
    return search.pool(vectors(spark, d), "label", "max").select("label", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(_REL.replace("SELECT query_id, round(", "SELECT round(avg(ap), 6) AS map, round(avg(auc), 6) AS auc, round(avg(rp), 6) AS rp, count(*) AS queries FROM (SELECT query_id, round(").replace("FROM h GROUP BY 1", "FROM h GROUP BY 1)"))
def retrieval_means(spark, d):
    means = search.mean_metrics(QUERIES["retrieval_metrics"](spark, d))
    return means.select(*[F.round(c, 6).alias(c) for c in ("map", "auc", "rp")], "queries")


@query(f"""WITH {_V}, rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY md5('11|' || CAST(query_id AS VARCHAR) || '|' || CAST(id AS VARCHAR)), id) AS n FROM q, v), t AS (SELECT rk.query_id, n, CAST(a.label = b.label AS INT) AS rel FROM rk JOIN v a ON rk.id = a.id JOIN v b ON rk.query_id = b.id),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY n) AS hits, sum(rel) OVER (PARTITION BY query_id) AS r, count(*) OVER (PARTITION BY query_id) AS kk FROM t),
e AS (SELECT query_id, sum(CASE WHEN rel = 1 THEN hits / n ELSE 0 END) / nullif(any_value(r), 0) AS ap, sum(CASE WHEN rel = 0 THEN hits END) / nullif(any_value(r) * (any_value(kk) - any_value(r)), 0) AS auc, sum(CASE WHEN n <= r THEN rel ELSE 0 END) / nullif(any_value(r), 0) AS rp FROM h GROUP BY 1)
SELECT round(avg(ap), 6) AS map, round(avg(auc), 6) AS auc, round(avg(rp), 6) AS rp, count(*) AS queries FROM e""")
def random_retrieval(spark, d):
    own = vectors(spark, d).select("id", "label")
    asked = own.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    means = search.mean_metrics(search.random_metrics(asked, own, 11))
    return means.select(*[F.round(c, 6).alias(c) for c in ("map", "auc", "rp")], "queries")


@query(f"""WITH {_V}, p AS (SELECT query_id, id, label, {_COS} AS s FROM q, v WHERE id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM p),
c AS (SELECT query_id, label, count(*) AS c, min(n) AS f FROM k WHERE n <= 3 AND s >= 0.05 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f) AS o FROM c),
an AS (SELECT q.query_id % 3 AS cluster, coalesce(CAST(b.label AS VARCHAR), 'Unknown') AS label FROM q LEFT JOIN b ON q.query_id = b.query_id AND o = 1), g AS (SELECT cluster, label, count(*) AS n FROM an GROUP BY 1, 2)
SELECT cluster, label FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1""")
def annotate_clusters(spark, d):
    cells = QUERIES["annotate_cells"](spark, d).withColumn("cluster", F.col("query_id") % 3)
    return search.majority(cells, "cluster")


_LD = f"""{_V}, g AS (SELECT label, pos, avg(v[pos]) AS x FROM v, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2), l AS (SELECT 'Term' || CAST(label AS VARCHAR) AS search_term, list(x ORDER BY pos) AS c FROM g GROUP BY label),
ld AS (SELECT 'f' || CAST(id AS VARCHAR) AS filename, 'Term' || CAST(label AS VARCHAR) AS file_label, search_term, 1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))) AS x FROM v, l),
ls AS (SELECT filename, file_label, search_term, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM ld), rl AS (SELECT filename, file_label, search_term, 1 - x AS score FROM ls WHERE x > 0.5)"""


def _label_distances(spark, d) -> DataFrame:
    v = vectors(spark, d)
    term = F.concat(F.lit("Term"), F.col("label").cast("string"))
    named = v.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), term.alias("file_label"), "v")
    return labels.label_distances(named, search.pool(v, "label").select(term.alias("search_term"), "v"))


@query(f"WITH {_LD} SELECT filename, file_label, search_term, round(score, 6) AS score FROM rl")
def similarity_rl(spark, d):
    return labels.label_similarities(_label_distances(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_LD} SELECT filename, score FROM (SELECT filename, round(avg(score), 6) AS score FROM rl WHERE lower(search_term) = 'term3' GROUP BY 1) ORDER BY score DESC, filename LIMIT 10")
def search_l2r(spark, d):
    return labels.files_of_label(QUERIES["similarity_rl"](spark, d), "Term3")


@query(f"WITH {_LD} SELECT lower(search_term) AS search_term, round(score, 6) AS score FROM rl WHERE filename = 'f7'")
def search_r2l(spark, d):
    return labels.labels_of_file(QUERIES["similarity_rl"](spark, d), "f7")


@query(f"WITH {_LD} SELECT file_label AS label, search_term AS predicted, count(*) AS n FROM (SELECT * FROM ld QUALIFY row_number() OVER (PARTITION BY filename ORDER BY x, search_term) = 1) GROUP BY 1, 2")
def label_confusion(spark, d):
    x = _label_distances(spark, d)
    return labels.confusion(labels.predicted_labels(x), x.select("filename", F.col("file_label").alias("label")).distinct())


@query(f"WITH {_LD} SELECT filename, search_term, round(avg(score), 6) AS score FROM rl GROUP BY 1, 2")
def label_table(spark, d):
    return labels.long(labels.wide(labels.label_similarities(_label_distances(spark, d)))).withColumn("score", F.round("score", 6))


_RR = f"""{_V}, rd AS (SELECT 'F' || CAST(id AS VARCHAR) AS db_file, 'F' || CAST(query_id AS VARCHAR) AS test_file, 1 - {_COS} AS x FROM v, q), rr AS (SELECT db_file, test_file, round(1 - (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS score FROM rd)"""


def _similar(spark, d, part: str | None = None) -> DataFrame:
    v = vectors(spark, d).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("db_file"), "v")
    asked = _asked(spark, d).select(F.concat(F.lit("F"), F.col("query_id").cast("string")).alias("test_file"), F.col("q").alias("v"))
    return labels.file_similarities(v, asked, part).withColumn("score", F.round("score", 6))


@query(f"WITH {_RR} SELECT db_file, test_file, score FROM rr")
def similarity_rr(spark, d):
    return _similar(spark, d)


@query(f"WITH {_RR} SELECT lower(db_file) AS db_file, score FROM rr WHERE lower(test_file) LIKE '%f40%' ORDER BY score DESC, lower(db_file) LIMIT 10")
def search_r2r(spark, d):
    return labels.files_of_file(_similar(spark, d, "F40"), "F40")


def _label_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files' known tokens, and their labels."""
    u = right(the_universe(spark, d))
    met = intervals.interval_join(regions(spark, d), u).select(F.concat(F.lit("b"), F.col("bed_id").cast("string")).alias("filename"), F.col("row_idx").alias("place"), "chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    known = spark.range(10).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("filename"), F.concat(F.lit("kind"), (F.col("id") % 3).cast("string")).alias("label"))
    return met, known


@query(f"""WITH {_R}, {_U}, fi AS (SELECT 'b' || CAST(bed_id AS VARCHAR) AS filename, row_idx AS place, u.chrom || '_' || u."start" || '_' || u."end" AS word FROM r JOIN u ON r.chrom = u.chrom AND r."start" < u."end" AND u."start" < r."end"), wo AS (SELECT filename, word, min(place) AS place FROM fi GROUP BY 1, 2),
dc AS (SELECT filename, string_agg(word, ' ' ORDER BY place, word) AS regions FROM wo GROUP BY 1), lb AS (SELECT 'b' || CAST(k AS VARCHAR) AS filename, 'kind' || CAST(k % 3 AS VARCHAR) AS label FROM range(10) t(k))
SELECT lb.filename, CASE WHEN regions IS NULL THEN ' ' ELSE regions || ' __label__' || label END AS document FROM lb LEFT JOIN dc ON lb.filename = dc.filename""")
def label_documents(spark, d):
    return labels.label_documents(*_label_inputs(spark, d))


@query("""WITH a AS (SELECT vec_id AS id, embedding AS v, 'p' || CAST(label AS VARCHAR) AS payload FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id, embedding AS v, 'p' || CAST(label AS VARCHAR) AS payload FROM embeddings WHERE vec_id % 2 = 1),
x AS (SELECT * FROM a UNION ALL SELECT id + (SELECT max(id) + 1 FROM a), v, payload FROM b) SELECT id, payload, p - 1 AS pos, round(CAST(v[p] AS DOUBLE), 6) AS x FROM x, (SELECT unnest(range(1, 65)) AS p)""")
def merge_indexes(spark, d):
    v = vectors(spark, d).select("id", "v", F.concat(F.lit("p"), F.col("label").cast("string")).alias("payload"))
    return search.merge_indexes(v.where("id % 2 = 0"), v.where("id % 2 = 1")).select("id", "payload", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(f"""WITH {_V}, p AS (SELECT query_id, v.id, 'p' || CAST(label AS VARCHAR) AS payload, {_COS} AS s FROM q, v), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS n FROM p) SELECT query_id, n AS place, id, round(s, 6) AS score, payload FROM k WHERE n <= 5""")
def index_search(spark, d):
    rows = vectors(spark, d).select("id", "v", F.concat(F.lit("p"), F.col("label").cast("string")).alias("payload"))
    found = index.VectorIndex().load(rows, "payload").search(_asked(spark, d), 5, with_vectors=False)
    return found.select("query_id", "place", "id", F.round("score", 6).alias("score"), "payload")


_TEXT = r"""tw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM benchmark), th AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM tw),
tc AS (SELECT item_id, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END) AS x FROM th GROUP BY 1, 2), tz AS (SELECT item_id, sqrt(sum(x * x)) AS z FROM tc GROUP BY 1)"""


@query(f"""WITH {_TEXT}, tp AS (SELECT a.item_id AS query_id, b.item_id AS id, sum(a.x * b.x) / (any_value(za.z) * any_value(zb.z)) AS s FROM tc a JOIN tc b ON a.k = b.k JOIN tz za ON a.item_id = za.item_id JOIN tz zb ON b.item_id = zb.item_id WHERE za.z > 0 AND zb.z > 0 GROUP BY 1, 2),
al AS (SELECT a.item_id AS query_id, b.item_id AS id, coalesce(tp.s, 0) AS s FROM tz a JOIN tz b ON a.z > 0 AND b.z > 0 LEFT JOIN tp ON tp.query_id = a.item_id AND tp.id = b.item_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS n FROM al) SELECT query_id, n AS place, id, round(s, 6) AS score FROM k WHERE n <= 3""")
def text_search(spark, d):
    items = _read(spark, d, "benchmark")
    own = index.VectorIndex().load(index.text_vectors(items, "item_id", "text").select(F.col("item_id").alias("id"), "v"))
    found = index.TextSearch(own).query(items.select(F.col("item_id").alias("query_id"), "text"), 3, with_payload=False, with_vectors=False)
    return found.select("query_id", "place", "id", F.round("score", 6).alias("score"))


def _tags(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stage one: the labels nearest to vector 0, placed by their first vectors, and the files of each: its vectors."""
    v = vectors(spark, d)
    zero = v.where("id = 0").select(F.lit(-1).cast("long").alias("query_id"), F.col("v").alias("q"))
    lead = v.groupBy("label").agg(F.min("id").alias("id")).join(v.select("id", "v"), "id").select(F.col("label").cast("long").alias("id"), "v")
    tag = search.knn(zero, lead, search.first_limit(10)).select(F.col("id").alias("label"), (F.col("place") - 1).alias("tag_place"), F.col("score").alias("tag_score"))
    return tag.join(v.select("id", "label"), "label").select("id", "tag_place", "tag_score"), v.select("id", "v")


_BI = f"""{_V}, z AS (SELECT v AS q FROM v WHERE id = 0), l AS (SELECT label, min(id) AS id FROM v GROUP BY 1),
ts AS (SELECT l.label, round({_COS}, 12) AS s FROM l JOIN v ON l.id = v.id, z), tp AS (SELECT label, s, row_number() OVER (ORDER BY s DESC, label) - 1 AS p FROM ts QUALIFY p < 5),
fi AS (SELECT v.id AS asking, v.v AS q, tp.p, tp.s AS t FROM v JOIN tp ON v.label = tp.label), fo AS (SELECT asking, p, t, v.id, round({_COS}, 12) AS s FROM fi, v),
fr AS (SELECT *, row_number() OVER (PARTITION BY asking ORDER BY round(s, 12) DESC, id) - 1 AS j FROM fo QUALIFY j < 10)"""


@query(f"WITH {_BI}, b AS (SELECT id, max((t + s) / 2) AS value FROM fr GROUP BY 1) SELECT id, round(value, 6) AS value, row_number() OVER (ORDER BY value DESC, id) AS place FROM b QUALIFY place <= 10")
def bivec_score(spark, d):
    return search.bivector(*_tags(spark, d), 10).withColumn("value", F.round("value", 6))


@query(f"WITH {_BI}, b AS (SELECT id, min(greatest(p, j)) AS value FROM fr GROUP BY 1) SELECT id, value, row_number() OVER (ORDER BY value, id) AS place FROM b QUALIFY place <= 10")
def bivec_rank(spark, d):
    return search.bivector(*_tags(spark, d), 10, by="rank")


# ---- perturbation -------------------------------------------------------------------------------------------------


def bed(spark, d) -> DataFrame:
    r = regions(spark, d)
    return intervals.dealt(r, r.count(), "row_idx", "chrom", "start").groupBy("row_idx", "chrom", "start").agg(F.max("end").alias("end")).withColumn("mod", F.lit("-"))


_B = "b AS (SELECT row_idx, chrom, \"start\", max(\"end\") AS \"end\", '-' AS mod FROM r GROUP BY 1, 2, 3)"
_MEETS = 'EXISTS (SELECT 1 FROM u WHERE b.chrom = u.chrom AND b."start" < u."end" AND u."start" < b."end")'


def _drawn(step: str, rate: float, among: str = "true", of: str = "b") -> str:
    """The rows drawn in a step, as ``d_<step>``."""
    return f"d_{step} AS (SELECT row_idx FROM {of} WHERE {among} ORDER BY md5('7|{step}|' || CAST(row_idx AS VARCHAR)), row_idx LIMIT (SELECT CAST(floor(count(*) * {rate}::DOUBLE) AS BIGINT) FROM {of}))"


def _uni(salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('7|{salt}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296)"


def _normal(salt: str, key: str, mean: float, sd: float) -> str:
    return f"CAST(trunc({mean}::DOUBLE + {sd}::DOUBLE * sqrt(-2 * ln(1 - {_uni(salt + 'u', key)})) * cos(2 * pi() * {_uni(salt + 'v', key)})) AS BIGINT)"


def _p_drop(of: str, to: str, rate: float, step: str = "drop", among: str = "true") -> str:
    return f"{_drawn(step, rate, among, of)}, {to} AS (SELECT * FROM {of} WHERE row_idx NOT IN (SELECT row_idx FROM d_{step}))"


def _p_shift(of: str, to: str, rate: float, among: str = "true") -> str:
    return f"""{_drawn('shift', rate, among, of)}, w_{to} AS (SELECT x.*, size, y.row_idx IS NOT NULL AS x, {_normal('shift', 'x.row_idx', 0.0, 150.0)} AS s FROM {of} x LEFT JOIN d_shift y ON x.row_idx = y.row_idx JOIN sz ON x.chrom = sz.chrom),
k_{to} AS (SELECT *, x AND "start" + s >= 0 AND "end" + s <= size AS ok FROM w_{to}), {to} AS (SELECT row_idx, chrom, CASE WHEN ok THEN "start" + s ELSE "start" END AS "start", CASE WHEN ok THEN "end" + s ELSE "end" END AS "end", CASE WHEN ok THEN 'S' ELSE mod END AS mod FROM k_{to})"""


def _p_cut(of: str, to: str, rate: float) -> str:
    return f"""{_drawn('cut', rate, 'true', of)}, w_{to} AS (SELECT x.*, y.row_idx IS NOT NULL AS x, ("start" + "end") // 2 AS m0 FROM {of} x LEFT JOIN d_cut y ON x.row_idx = y.row_idx), v_{to} AS (SELECT *, CASE WHEN m0 <= "start" THEN "start" + 10 ELSE m0 END AS m1 FROM w_{to}), k_{to} AS (SELECT *, CASE WHEN m1 >= "end" THEN "end" - 10 ELSE m1 END AS mid FROM v_{to}),
{to} AS (SELECT row_idx * 2 AS row_idx, chrom, "start", CASE WHEN x THEN mid ELSE "end" END AS "end", CASE WHEN x THEN 'C' ELSE mod END AS mod FROM k_{to} UNION ALL SELECT row_idx * 2 + 1, chrom, mid, "end", 'C' FROM k_{to} WHERE x)"""


def _p_merge(of: str, to: str, rate: float) -> str:
    return f"""{_drawn('merge', rate, 'true', of)}, w_{to} AS (SELECT x.*, lead("end") OVER o AS ne, coalesce(y.row_idx IS NOT NULL AND lead(chrom) OVER o = chrom, false) AS made, coalesce(lag(y.row_idx IS NOT NULL) OVER o AND lag(chrom) OVER o = chrom, false) AS was FROM {of} x LEFT JOIN d_merge y ON x.row_idx = y.row_idx WINDOW o AS (ORDER BY x.row_idx)),
{to} AS (SELECT row_idx, chrom, "start", "end", mod FROM w_{to} WHERE NOT made AND NOT was UNION ALL SELECT row_idx, chrom, "start", ne, 'M' FROM w_{to} WHERE made)"""


def _p_add(of: str, to: str, rate: float) -> str:
    return f"""sp AS (SELECT chrom, size, sum(size) OVER (ORDER BY chrom) AS hi, sum(size) OVER () AS every FROM sz), n_{to} AS (SELECT i, {_uni('addc', 'i')} AS pt FROM range((SELECT CAST(floor(count(*) * {rate}::DOUBLE) AS BIGINT) FROM {of})) t(i)),
m_{to} AS (SELECT i, chrom, size, CAST(floor({_uni('adds', 'i')} * size) AS BIGINT) + 1 AS s FROM n_{to} JOIN sp ON pt * every >= hi - size AND pt * every < hi),
{to} AS (SELECT * FROM {of} UNION ALL SELECT i + (SELECT coalesce(max(row_idx), -1) + 1 FROM {of}), chrom, s, least(s + {_normal('addw', 'i', 320.0, 30.0)}, size), 'A' FROM m_{to})"""


_BED = 'SELECT row_idx, chrom, "start", "end", mod FROM'


@query(f"WITH {_R}, {_U}, {_B}, {_p_drop('b', 'o', 0.2, 'dropfile', _MEETS)} {_BED} o")
def perturb_drop_from_file(spark, d):
    return perturb.drop_from_file(bed(spark, d), the_universe(spark, d), 0.2, 7)


@query(f"WITH {_R}, {_B}, {_p_drop('b', 'o', 0.3)} {_BED} o")
def perturb_drop(spark, d):
    return perturb.drop(bed(spark, d), 0.3, 7)


@query(f"WITH {_R}, {_B}, {_p_merge('b', 'o', 0.4)} {_BED} o")
def perturb_merge(spark, d):
    return perturb.merge_rows(bed(spark, d), 0.4, 7)


@query(f"WITH {_R}, {_B}, {_p_cut('b', 'o', 0.5)} {_BED} o")
def perturb_cut(spark, d):
    return perturb.cut(bed(spark, d), 0.5, 7)


@query(f"WITH {_R}, {_U}, {_SIZES}, {_B}, {_p_shift('b', 'o', 0.5)} {_BED} o")
def perturb_shift(spark, d):
    return perturb.shift(bed(spark, d), sizes(spark, d), 0.5, 0.0, 150.0, 7)


@query(f"WITH {_R}, {_U}, {_SIZES}, {_B}, {_p_shift('b', 'o', 0.5, _MEETS)} {_BED} o")
def perturb_shift_from_file(spark, d):
    return perturb.shift_from_file(bed(spark, d), sizes(spark, d), the_universe(spark, d), 0.5, 0.0, 150.0, 7)


@query(f"WITH {_R}, {_U}, {_SIZES}, {_B}, {_p_add('b', 'o', 0.6)} {_BED} o")
def perturb_add(spark, d):
    return perturb.add(bed(spark, d), sizes(spark, d), 0.6, 320.0, 30.0, 7)


@query(f"""WITH {_R}, {_U}, {_B}, li AS (SELECT *, sum("end" - "start") OVER (ORDER BY chrom, "start", uid) AS hi, sum("end" - "start") OVER () AS every FROM u), nw AS (SELECT i, CAST(floor({_uni('validr', 'i')} * (SELECT any_value(every) FROM li)) AS BIGINT) AS pt FROM range((SELECT CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) FROM b)) t(i)),
mt AS (SELECT i, chrom, "start" + CAST(floor({_uni('valids', 'i')} * ("end" - "start" + 1)) AS BIGINT) AS s FROM nw JOIN li ON pt >= hi - ("end" - "start") AND pt < hi) {_BED} b UNION ALL SELECT i + (SELECT max(row_idx) + 1 FROM b), chrom, s, s + {_normal('addw', 'i', 320.0, 30.0)}, 'A' FROM mt""")
def perturb_add_valid(spark, d):
    return perturb.add_valid(bed(spark, d), the_universe(spark, d).withColumnRenamed("uid", "row_idx"), 0.6, 320.0, 30.0, 7)


@query(f"""WITH {_R}, {_U}, {_B}, pk AS (SELECT uid, chrom, "start", "end" FROM u ORDER BY md5('7|addfile|' || CAST(uid AS VARCHAR)), uid LIMIT (SELECT CAST(floor(count(*) * 0.02::DOUBLE) AS BIGINT) FROM b)) {_BED} b UNION ALL SELECT uid + (SELECT max(row_idx) + 1 FROM b), chrom, "start", "end", 'A' FROM pk""")
def perturb_add_file(spark, d):
    return perturb.add_from_file(bed(spark, d), the_universe(spark, d).withColumnRenamed("uid", "row_idx"), 0.02, 7)


@query(f"WITH {_R}, {_U}, {_SIZES}, {_B}, {_p_shift('b', 'p1', 0.2)}, {_p_add('p1', 'p2', 0.1)}, {_p_cut('p2', 'p3', 0.2)}, {_p_merge('p3', 'p4', 0.1)}, {_p_drop('p4', 'p5', 0.1)} {_BED} p5")
def perturb_all(spark, d):
    return perturb.all_perturbations(bed(spark, d), sizes(spark, d), 7, shift_rate=0.2, add_rate=0.1, cut_rate=0.2, merge_rate=0.1, drop_rate=0.1)


# ---- tokens -------------------------------------------------------------------------------------------------------


def token_docs(spark, d) -> DataFrame:
    words = F.transform(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    return _read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("tokens"))


_T = r"t AS (SELECT conv_id * 1000 + turn AS id, list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INT)) AS tokens FROM conversations), x AS (SELECT id, tokens, unnest(tokens) AS target, generate_subscripts(tokens, 1) - 1 AS place FROM t)"


@query(f"WITH {_T} SELECT id, place, target, array_to_string(list_concat(list_concat(tokens[greatest(place - 1, 1):place], tokens[place + 2:place + 3]), list_transform(range(4 - len(tokens[greatest(place - 1, 1):place]) - len(tokens[place + 2:place + 3])), lambda i: 0)), ',') AS context FROM x")
def cbow_windows(spark, d):
    return tokens.cbow_windows(token_docs(spark, d), 2).withColumn("context", F.array_join(F.transform("context", lambda c: c.cast("string")), ","))


@query(f"WITH {_T} SELECT id, place, target, array_to_string(list_transform([-2, -1, 1, 2], lambda i: tokens[(place + i + len(tokens)) % len(tokens) + 1]), ',') AS context FROM x WHERE len(tokens) > 4")
def cbow_windows_wrap(spark, d):
    return tokens.cbow_windows_wrapped(token_docs(spark, d), 2).withColumn("context", F.array_join(F.transform("context", lambda c: c.cast("string")), ","))


_W = r"w AS (SELECT conv_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS token FROM conversations), f AS (SELECT token, count(*) AS n, count(*) / (SELECT count(*) FROM w) AS share FROM w GROUP BY 1)"


def _words(spark, d) -> DataFrame:
    return _read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("token"))


def _u42(salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('42|{salt}|' || {key}), 1, 8) AS BIGINT) / 4294967296)"


@query(f"""WITH {_W}, c AS (SELECT id, token, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY 1, 2), s AS (SELECT id, token, n, sum(n) OVER (PARTITION BY id ORDER BY token ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY id) AS whole FROM c),
d AS (SELECT DISTINCT id, whole, k, {_u42('sample', "CAST(id AS VARCHAR) || '|' || CAST(k AS VARCHAR)")} * whole AS x FROM s, range(20) r(k))
SELECT d.id, string_agg(token, ' ' ORDER BY k) AS sentence FROM d JOIN s ON d.id = s.id AND x >= hi - n AND x < hi GROUP BY d.id""")
def sampled_sentences(spark, d):
    """Twenty tokens of each document with replacement, by how often it holds them."""
    counts = _words(spark, d).groupBy("id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return tokens.sampled_sentences(counts, 20, 42)


@query(f"WITH {_W} SELECT token, n, round(share, 9) AS share FROM f")
def token_frequency(spark, d):
    return tokens.frequency(_words(spark, d)).withColumn("share", F.round("share", 9))


@query(f"WITH {_W} SELECT token, round(pow(share, 0.75) / (SELECT sum(pow(share, 0.75)) FROM f), 9) AS p FROM f")
def negative_sampling_dist(spark, d):
    return tokens.negative_sampling(_words(spark, d)).withColumn("p", F.round("p", 9))


@query(f"WITH {_W} SELECT id, string_agg(token, ' ' ORDER BY md5('3|' || CAST(id AS VARCHAR) || '|' || token), token) AS sentence FROM w GROUP BY id")
def sentences(spark, d):
    return tokens.sentences(_words(spark, d), 3)


_C = "c AS (SELECT user_id AS cell, CAST(floor(value) AS BIGINT) % 50 AS gene, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


def _counts(spark, d) -> DataFrame:
    return _read(spark, d, "events").where("value is not null").groupBy(F.col("user_id").alias("cell"), (F.floor("value") % 50).alias("gene")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = f"""{_C}, {_U}, {_VOCAB}, fe AS (SELECT g AS feature, 'chr' || CAST(1 + abs(g) % 5 AS VARCHAR) AS chrom, abs(g) * 40 + 5 AS "start", abs(g) * 40 + 260 AS "end" FROM (SELECT DISTINCT gene AS g FROM c)),
fh AS (SELECT DISTINCT fe.feature, vo.id FROM fe JOIN vo ON fe.chrom = vo.chrom AND fe."start" < vo."end" AND vo."start" < fe."end"), fk AS (SELECT fe.feature, coalesce(fh.id, (SELECT count(*) FROM u)) AS id FROM fe LEFT JOIN fh ON fe.feature = fh.feature),
ck AS (SELECT c.cell, fk.id, c.gene AS place FROM c JOIN fk ON c.gene = fk.feature)"""


def _cell_tokens(spark, d) -> DataFrame:
    """Features are stretches of 255 positions, 40 apart."""
    counts, g = _counts(spark, d).withColumnRenamed("gene", "feature"), F.abs("feature")
    features = counts.select("feature").distinct().select("feature", F.concat(F.lit("chr"), (1 + g % 5).cast("string")).alias("chrom"), (g * 40 + 5).alias("start"), (g * 40 + 260).alias("end"))
    return encode.cell_tokens(counts, features, encode.vocabulary(the_universe(spark, d)))


@query(f"WITH {_CELLS} SELECT cell, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place, id) AS tokens FROM ck GROUP BY cell")
def tokenize_cells(spark, d):
    lists = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string"))
    return _cell_tokens(spark, d).groupBy("cell").agg(F.array_join(lists, ",").alias("tokens"))


@query(f"WITH {_CELLS}, {_EMBED}, {_pooled_sql('cell', 'ck')}, pd AS (SELECT cell, round(any_value(x) FILTER (i = 1), 6) AS first, round(sum(x), 6) AS total FROM pe GROUP BY 1) SELECT k.cell, first, total FROM (SELECT DISTINCT cell FROM ck) k LEFT JOIN pd ON k.cell = pd.cell")
def encode_cells(spark, d):
    return encode.encode_cells(_cell_tokens(spark, d), vectors(spark, d)).select("cell", *_digest("v"))


@query(f"WITH {_C} SELECT cell, gene % 10 AS gene, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2")
def gene_collapse(spark, d):
    mapping = spark.range(-50, 50).select(F.col("id").alias("gene"), (F.col("id") % 10).alias("to"))
    return tokens.collapse(_counts(spark, d), mapping)


@query(f"""WITH {_C}, t AS (SELECT cell, sum(n) AS a FROM c GROUP BY 1), x AS (SELECT c.cell, c.gene, round(c.n / a * 10000 / (1 + abs(c.gene) % 7), 9) AS x FROM c JOIN t ON c.cell = t.cell),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY x DESC, gene) AS p FROM x) SELECT cell, '-1,' || string_agg(CAST(gene AS VARCHAR), ',' ORDER BY p) || ',-2' AS tokens, count(*) + 2 AS length FROM k WHERE p <= 4094 GROUP BY cell""")
def rank_value_encoding(spark, d):
    medians = spark.range(-50, 50).select(F.col("id").alias("gene"), (1 + F.abs("id") % 7).alias("median"))
    return tokens.rank_encode(_counts(spark, d), medians, 4096, -1, -2).select("cell", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), F.col("length").cast("long").alias("length"))


_K = "CAST(id AS VARCHAR) || '|' || CAST(place AS VARCHAR)"


@query(f"""WITH {_T}, k AS (SELECT id, place, target, CAST('0x' || substr(md5('5|mask|' || {_K}), 1, 8) AS BIGINT) / 4294967296 AS m, CAST('0x' || substr(md5('5|pick|' || {_K}), 1, 8) AS BIGINT) / 4294967296 AS p FROM x)
SELECT id, place, CASE WHEN m < 0.15 THEN CAST(floor(p * 1000) AS BIGINT) ELSE target END AS token, CASE WHEN m < 0.15 THEN 1 ELSE 0 END AS label FROM k""")
def rtd_corrupt(spark, d):
    x = token_docs(spark, d).select("id", F.posexplode("tokens").alias("place", "token"))
    return tokens.corrupt(x, 1000, 0.15, 5)


@query(f"""WITH {_T}, pd AS (SELECT id, list_concat(tokens[1:8], list_transform(range(greatest(8 - len(tokens), 0)), lambda i: 0)) AS tokens FROM t) SELECT id, array_to_string(tokens, ',') AS tokens, len(list_filter(tokens, lambda x: x <> 0)) AS kept FROM pd""")
def padded_batch(spark, d):
    out = encode.padded_batch(token_docs(spark, d), 8, 0)
    return out.select("id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("kept"))


@query(f"""WITH k AS (SELECT vec_id AS id, label, CAST('0x' || substr(md5('3|' || CAST(vec_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM embeddings), n AS (SELECT id, CAST(label AS VARCHAR) AS l, row_number() OVER (PARTITION BY label ORDER BY h, id) AS n, count(*) OVER (PARTITION BY label) AS c FROM k),
nl AS (SELECT l, c, coalesce(lead(l) OVER (ORDER BY l), min(l) OVER ()) AS nx FROM (SELECT DISTINCT l, c FROM n)) SELECT a.id, p.id AS positive, g.id AS negative FROM n a JOIN n p ON p.l = a.l AND p.n = a.n % a.c + 1 AND a.c > 1 JOIN nl ON nl.l = a.l JOIN nl o ON o.l = nl.nx JOIN n g ON g.l = nl.nx AND g.n = (a.n - 1) % o.c + 1""")
def triplets(spark, d):
    return encode.triplets(_read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "label", 3)


# ---- evaluation ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_U}, {_V}, n AS (SELECT u.*, v.v, row_number() OVER (PARTITION BY chrom ORDER BY u."start", uid) AS n, count(*) OVER (PARTITION BY chrom) AS c FROM u JOIN v ON u.uid = v.id),
m AS (SELECT *, CAST(floor(CAST('0x' || substr(md5('9|pair|' || CAST(uid AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 * (c - 1)) AS BIGINT) + 1 AS m FROM n WHERE c > 1),
p AS (SELECT CASE WHEN a."end" < b."end" THEN greatest(b."start" - a."end" + 1, 0) ELSE greatest(a."start" - b."end" + 1, 0) END / 1e10 AS x, (1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) / 2 AS y FROM m a JOIN n b ON a.chrom = b.chrom AND b.n = a.m + CASE WHEN a.m >= a.n THEN 1 ELSE 0 END)
SELECT round(regr_slope(y, x), 0) AS slope FROM p""")
def gdst(spark, d):
    known = the_universe(spark, d).join(vectors(spark, d).select(F.col("id").alias("uid"), "v"), "uid")
    one, other = (known.select(F.col("uid").alias(k), F.col("start").alias(f"s{i}"), F.col("end").alias(f"e{i}"), F.col("v").alias(f"v{i}")) for i, k in ((1, "uid"), (2, "other")))
    pairs = evaluate.region_pairs(known, 9).join(one, "uid").join(other, "other")
    return evaluate.gdst(pairs).select(F.round("slope", 0).alias("slope"))


@query("""WITH l AS (SELECT label AS a, vec_id % 10 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2), 0), 6) AS ari FROM s, x, y""")
def adjusted_rand(spark, d):
    return evaluate.adjusted_rand(_read(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b"))).select(F.round("ari", 6).alias("ari"))


@query("""SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END AS distance FROM nation a, nation b""")
def hierarchy_distance(spark, d):
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    edges = r.select(F.lit("root").alias("parent"), F.concat(F.lit("r:"), "r_name").alias("child")).unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("r:"), "r_name").alias("parent"), F.col("n_name").alias("child")))
    pairs = n.select(F.col("n_name").alias("a")).crossJoin(n.select(F.col("n_name").alias("b")))  # 25 nations
    return evaluate.hierarchy_distance(pairs, evaluate.paths(edges))


@query("SELECT e AS epoch, round(0.025 - (0.025 - 0.0001) / 50 * e, 9) AS linear, round(greatest(0.025 * pow(0.5, floor(e / 10)), 0.0001), 9) AS milestone FROM range(50) t(e)")
def lr_schedule(spark, d):
    e = F.col("epoch")
    return spark.range(50).select(F.col("id").alias("epoch")).select("epoch", F.round(fn.linear_rate(0.025, 0.0001, 50, e), 9).alias("linear"), F.round(fn.milestone_rate(0.025, 0.0001, 0.5, 10, e), 9).alias("milestone"))


@query("""WITH RECURSIVE x(epoch, rate) AS (SELECT 0, 0.025::DOUBLE UNION ALL SELECT epoch + 1, greatest(rate / (1 + 0.01::DOUBLE * (epoch + 1)), 0.0001::DOUBLE) FROM x WHERE epoch < 49)
SELECT CAST(epoch AS BIGINT) AS epoch, 0.025::DOUBLE AS constant, round(greatest(0.025::DOUBLE - 0.0007::DOUBLE * epoch, 0.0001::DOUBLE), 9) AS linear, round(rate, 9) AS exponential,
round(CASE WHEN epoch < 5 THEN epoch / 5 WHEN (epoch - 5) / 35 >= 1 THEN 0 ELSE greatest(0, (45 - epoch) / 80 * (1 + cos(pi() * ((3 * (epoch - 5) / 35) % 1)))) END, 9) AS cosine, round(CASE WHEN epoch < 5 THEN epoch / 5 ELSE greatest((40 - epoch) / 35, 0.5::DOUBLE) END, 9) AS floored FROM x""")
def lr_schedules(spark, d):
    e = F.col("epoch")
    rates = {"constant": fn.constant_rate(0.025, e), "linear": fn.decayed_linear_rate(0.025, 0.0007, 0.0001, e), "exponential": fn.exponential_rate(0.025, 0.01, 0.0001, e), "cosine": fn.cosine_restart_rate(5, 40, 3, e), "floored": fn.linear_floor_rate(5, 40, 0.5, e)}
    return spark.range(50).select(F.col("id").alias("epoch")).select("epoch", *[F.round(x.cast("double"), 9).alias(k) for k, x in rates.items()])


_NPT = f"""{_U}, {_V}, kn AS (SELECT u.uid, u.chrom, u."start", u."end", v.v, row_number() OVER (PARTITION BY chrom ORDER BY u."start", uid) AS n, count(*) OVER (PARTITION BY chrom) AS c, count(*) OVER () AS t FROM u JOIN v ON u.uid = v.id),
sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5('0|npt|' || CAST(uid AS VARCHAR)), uid) AS i FROM kn) WHERE i <= round_even(100 * c / t, 0)),
gd AS (SELECT a.uid, b.uid AS nb, CASE WHEN a."end" < b."end" THEN greatest(b."start" - a."end" + 1, 0) ELSE greatest(a."start" - b."end" + 1, 0) END AS x FROM sa a JOIN kn b ON a.chrom = b.chrom AND a.uid <> b.uid AND b.n BETWEEN a.n - 10 AND a.n + 10), gp AS (SELECT uid, nb, row_number() OVER (PARTITION BY uid ORDER BY x, nb) AS p FROM gd QUALIFY p <= 10),
ra AS (SELECT uid, chrom, list_transform(range(64), lambda k: CAST('0x' || substr(md5('0|rand|' || CAST(uid AS VARCHAR) || '|' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 - 0.5::DOUBLE) AS v FROM kn)"""


def _npt_near(name: str, asked: str, of: str) -> str:
    cos = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
    return f"{name} AS (SELECT a.uid, b.uid AS nb, row_number() OVER (PARTITION BY a.uid ORDER BY round({cos}, 12) DESC, b.uid) AS p FROM {asked} a JOIN {of} b ON a.chrom = b.chrom AND a.uid <> b.uid QUALIFY p <= 10)"


def _npt_share(name: str, near: str) -> str:
    return f"{name} AS (SELECT k, avg(s) AS s FROM (SELECT k, gp.uid, sum(CASE WHEN {near}.p <= k THEN 1 ELSE 0 END) / count(*) AS s FROM (SELECT unnest([5, 10]) AS k) ks JOIN gp ON gp.p <= k LEFT JOIN {near} ON gp.uid = {near}.uid AND gp.nb = {near}.nb GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {_NPT}, {_npt_near('en', 'sa', 'kn')}, {_npt_near('rn', '(SELECT ra.* FROM ra JOIN sa ON ra.uid = sa.uid)', 'ra')}, {_npt_share('es', 'en')}, {_npt_share('rs', 'rn')}
SELECT es.k, round(es.s, 6) AS qnpr, round(rs.s, 6) AS rnpr, round(greatest(log10((es.s + 1e-10) / (rs.s + 1e-10)), 0), 6) AS snpr FROM es JOIN rs ON es.k = rs.k""")
def npt(spark, d):
    out = evaluate.neighbourhood_preservation(the_universe(spark, d), vectors(spark, d), 10, step=5)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("qnpr", "rnpr", "snpr")])


@query(f"""WITH {_V}, n AS (SELECT id, v, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS t FROM v), sz AS (SELECT least(any_value(t), 10000) AS n, any_value(t) AS t FROM n), dr AS (SELECT j, CAST(floor({_u42('draw', 'CAST(j AS VARCHAR)')} * (SELECT t FROM sz)) AS BIGINT) + 1 AS n FROM range((SELECT CAST(n AS BIGINT) FROM sz)) r(j)),
da AS (SELECT dr.j, n.id, n.v FROM dr JOIN n ON dr.n = n.n), dd AS (SELECT id, any_value(v) AS v, count(*) AS times FROM da GROUP BY 1), bx AS (SELECT p, quantile_cont(v[p + 1], 0.05) AS lo, quantile_cont(v[p + 1], 0.95) AS hi FROM da, (SELECT unnest(range(64)) AS p) GROUP BY 1),
pr AS (SELECT da.id, count(*) AS w FROM (SELECT CAST(floor({_u42('probe', 'CAST(k AS VARCHAR)')} * (SELECT n FROM sz)) AS BIGINT) AS j FROM range((SELECT CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM sz)) r(k)) x JOIN da ON x.j = da.j GROUP BY 1),
xs AS (SELECT a.id, any_value(w) AS w, min(list_distance(a.v, b.v)) AS d FROM pr JOIN dd a ON pr.id = a.id AND a.times = 1 JOIN dd b ON a.id <> b.id GROUP BY 1),
pt AS (SELECT k, list(lo + {_u42('point', "CAST(k AS VARCHAR) || '|' || CAST(p AS VARCHAR)")} * (hi - lo) ORDER BY p) AS q FROM range((SELECT CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM sz)) r(k), bx GROUP BY k), ys AS (SELECT k, min(list_distance(q, dd.v)) AS d FROM pt, dd GROUP BY k)
SELECT round(y / (x + y), 6) AS score FROM (SELECT coalesce(sum(w * d * d), 0) AS x FROM xs), (SELECT sum(d * d) AS y FROM ys)""")
def ctt(spark, d):
    return evaluate.clustering_tendency(vectors(spark, d)).select(F.round("score", 6).alias("score"))


@query(f"""WITH {_V}, g AS (SELECT label, pos, avg(v[pos]) AS m, max(v[pos]) AS h FROM v, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2), p AS (SELECT label, list(m ORDER BY pos) AS a, list(h ORDER BY pos) AS b FROM g GROUP BY 1),
x AS (SELECT i.label AS i, j.label AS j, list_dot_product(i.a, j.b) / (sqrt(list_dot_product(i.a, i.a)) * sqrt(list_dot_product(j.b, j.b))) * exp(2.0::DOUBLE) AS x FROM p i, p j),
e AS (SELECT ln(sum(exp(x))) - sum(CASE WHEN i = j THEN x ELSE 0 END) AS loss FROM x GROUP BY i UNION ALL SELECT ln(sum(exp(x))) - sum(CASE WHEN i = j THEN x ELSE 0 END) FROM x GROUP BY j) SELECT round(avg(loss), 6) AS loss FROM e""")
def info_nce(spark, d):
    v = vectors(spark, d)
    pairs = search.pool(v, "label").select(F.col("label").alias("id"), F.col("v").alias("a")).join(search.pool(v, "label", "max").select(F.col("label").alias("id"), F.col("v").alias("b")), "id")
    return evaluate.info_nce(pairs, 2.0).select(F.round("loss", 6).alias("loss"))


@query("SELECT label, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std FROM (SELECT label, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS z FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS e FROM embeddings)) GROUP BY label")
def standardised_runs(spark, d):
    x = vectors(spark, d).select("label", F.col("v")[0].cast("double").alias("z"))
    return evaluate.run_statistics(search.standardised(x, "z"), "label", "z").select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def kmeans_ari(spark, d):
    return evaluate.clustered_ari(vectors(spark, d).where("label is not null"), 10, 1).select(F.round("ari", 6).alias("ari"))


@query()
def region2vec_train(spark, d):
    return tokens.train_embeddings(tokens.sentences(_words(spark, d), 3), width=16, least=5, seed=1)


@query()
def region2vec_cbow(spark, d):
    """Vectors by continuous bags of words with negative sampling, trained over blocks of documents."""
    docs = _words(spark, d).groupBy("id").agg(F.collect_list("token").alias("tokens"))
    return embed.train(docs, width=16, epochs=2, least=5).model.select("token", "v")


@query()
def label_words_train(spark, d):
    model = embed.train_label_rows(labels.label_words(*_label_inputs(spark, d)), width=8, epochs=3).model
    return labels.label_embeddings(model.select(F.col("token").alias("word"), "v"))


@query()
def pca(spark, d):
    return evaluate.principal_components(vectors(spark, d), 2)


def _with_labels(spark: SparkSession, d: str) -> DataFrame:
    b = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.pmod("label", F.lit(10)) == k).cast("double"))
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), b.alias("b"))
    return rows.where("label IS NOT NULL")


@query()
def rct_linear(spark, d):
    return evaluate.reconstruction(_with_labels(spark, d)).select("fold", F.round("r2", 6).alias("r2"))


@query()
def rct_network(spark, d):
    """As rct_linear, by networks of one layer of 200, on the same folds."""
    return network.reconstruction(_with_labels(spark, d)).select("fold", F.round("r2", 6).alias("r2"))


@query()
def vec2vec(spark, d):
    """How near a network's vector of a text comes to the vector of the same number, by cosine."""
    texts = index.text_vectors(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")
    pairs = cut(texts.join(vectors(spark, d).select("id", F.col("v").cast("array<double>").alias("y")), "id"))  # learned from, then scored
    got = network.train(pairs, hidden=(64,), rounds=20).predict(pairs)
    return got.select("id", fn.cosine("p", "y").alias("score"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
