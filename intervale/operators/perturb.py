"""Reproducible perturbation of region sets (row_idx, chrom, start, end, mod).

Randomness is md5 of seed, step and row, so results depend on neither partitions nor engine.  ``int(rows * rate)`` rows are
drawn without replacement: those first by that hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.regions import uniform
from intervale.operators.intervals import BUCKET, interval_join
from intervale.session import cut as written


def check_rate(rate: float, most: float | None = 1.0) -> None:
    if rate < 0 or most is not None and rate > most:
        raise ValueError(f"rate {rate} is out of range")


def _hash(seed: int, step: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(step), F.col("row_idx").cast("string")))


#: Hex digits of the hash that name a bucket: 65,536 of them, whose counts are one small row each.
DIGITS = 4


def first_by_hash(rows: DataFrame, n: int, h: Column, *ties: str) -> DataFrame:
    """The ``n`` rows first by hash ``h`` (hex) and ``ties``, or all if fewer.

    Buckets of the hash are counted; whole buckets below the one that the n-th row lies in stay, and only that one's rows are
    ranked.  No task sees more than a bucket, however large n is.
    """
    x = rows.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, DIGITS))
    counts = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", "_n", F.coalesce(upto, F.lit(0)).alias("_upto"))  # at most 16**DIGITS rows
    counts = F.broadcast(counts.where(F.col("_upto") < n))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *ties))
    near = x.join(counts, "_p")
    whole = near.where(F.col("_upto") + F.col("_n") <= n)
    edge = near.where(F.col("_upto") + F.col("_n") > n).withColumn("_i", place).where(F.col("_upto") + F.col("_i") <= n)
    return whole.select(rows.columns).unionByName(edge.select(rows.columns))


def drawn(bed: DataFrame, rate: float, seed: int, step: str, among: DataFrame | None = None) -> DataFrame:
    """The row_idx of the rows drawn: a share of all, from those that overlap ``among`` (fewer, if those don't suffice)."""
    rows = bed.count()
    n = int(rows * rate)
    if among is not None:
        bed = interval_join(bed, among.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")), "semi", rows=rows + among.count())
    return first_by_hash(bed.select("row_idx"), n, _hash(seed, step), "row_idx")


def marked(bed: DataFrame, rate: float, seed: int, step: str) -> DataFrame:
    """Adds ``_d``, true for the rows that ``drawn`` names without ``among``, else null: those up to the place of the last one drawn.

    The place is one row, found in one bucket of the hash, so that the rows are neither exchanged nor joined.  Rows share a
    number only if they are drawn together.
    """
    n, h = int(bed.count() * rate), _hash(seed, step)
    x = bed.select("row_idx", h.alias("_h")).withColumn("_p", F.substring("_h", 1, DIGITS))
    counts = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumn("_upto", upto).where(F.col("_upto") >= n).orderBy("_p").first() if n else None  # of at most 16**DIGITS rows
    if edge is None:
        return bed.withColumn("_d", F.lit(None).cast("boolean"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", "row_idx"))
    last = x.where(F.col("_p") == edge["_p"]).withColumn("_i", place).where(F.col("_i") == n - edge["_upto"] + edge["_n"]).select("_h", "row_idx").first()
    return bed.withColumn("_d", F.when((h < last["_h"]) | (h == last["_h"]) & (F.col("row_idx") <= last["row_idx"]), True))


def normal(seed: int, step: str, mean: float, sd: float, key: Column) -> Column:
    """Box-Muller on two hashes."""
    u, v = uniform(seed, step + "u", key), uniform(seed, step + "v", key)
    return mean + sd * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def drop(bed: DataFrame, rate: float, seed: int) -> DataFrame:
    check_rate(rate)
    return marked(bed, rate, seed, "drop").where("_d is null").drop("_d")


def drop_from_file(bed: DataFrame, other: DataFrame, rate: float, seed: int) -> DataFrame:
    """Drops ``int(rows * rate)`` of the rows that overlap another set, at most all of those."""
    check_rate(rate)
    return bed.join(drawn(bed, rate, seed, "dropfile", other), "row_idx", "left_anti")


def shift_from_file(bed: DataFrame, sizes: DataFrame, other: DataFrame, rate: float, mean: float, sd: float, seed: int) -> DataFrame:
    """``shift`` of ``int(rows * rate)`` of the rows that overlap another set, at most all of those."""
    return shift(bed, sizes, rate, mean, sd, seed, other)


def shift(bed: DataFrame, sizes: DataFrame, rate: float, mean: float, sd: float, seed: int, other: DataFrame | None = None) -> DataFrame:
    """Moves both ends by one delta, truncated to a whole number; a row that would leave its chromosome stays."""
    check_rate(rate)
    by = normal(seed, "shift", mean, sd, F.col("row_idx")).cast("long")
    x = marked(bed, rate, seed, "shift") if other is None else bed.join(drawn(bed, rate, seed, "shift", other).withColumn("_d", F.lit(True)), "row_idx", "left")
    x = x.join(F.broadcast(sizes), "chrom", "left").withColumn("_by", by)
    ok = F.col("_d").isNotNull() & (F.col("start") + F.col("_by") >= 0) & (F.col("end") + F.col("_by") <= F.col("size"))
    ok = F.coalesce(ok, F.lit(False))
    return x.select("row_idx", "chrom", F.when(ok, F.col("start") + F.col("_by")).otherwise(F.col("start")).alias("start"), F.when(ok, F.col("end") + F.col("_by")).otherwise(F.col("end")).alias("end"), F.when(ok, F.lit("S")).otherwise(F.col("mod")).alias("mod"))


#: How far from an end a row is cut whose middle is that end.
ASIDE = 10


def cut(bed: DataFrame, rate: float, seed: int) -> DataFrame:
    """Splits drawn rows at their middle, or ``ASIDE`` from an end where the middle is no place within; row_idx doubles, so that second halves have numbers between."""
    check_rate(rate)
    x = marked(bed, rate, seed, "cut")
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    mid = F.when(mid <= F.col("start"), F.col("start") + ASIDE).otherwise(mid)
    mid = F.when(mid >= F.col("end"), F.col("end") - ASIDE).otherwise(mid)
    halves = F.array(F.struct(F.col("start").alias("s"), mid.alias("e"), F.lit("C").alias("m")), F.struct(mid.alias("s"), F.col("end").alias("e"), F.lit("C").alias("m")))
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("mod").alias("m")))
    parts = x.select("row_idx", "chrom", F.posexplode(F.when(F.col("_d"), halves).otherwise(whole)).alias("part", "p"))
    return parts.select((F.col("row_idx") * 2 + F.col("part")).alias("row_idx"), "chrom", F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.m").alias("mod"))


def _beside(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the next row's chromosome and end (``_chrom``, ``_end``), by row_idx over the whole frame, and whether the row before is joined with this one (``_was``).

    The range of row_idx is parted into buckets; only their first and last rows meet across them.
    """
    edge = rows.agg(F.min("row_idx").alias("_lo"), F.max("row_idx").alias("_hi"))
    part = F.least(F.floor((F.col("row_idx") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) * buckets), F.lit(buckets - 1)).cast("int")
    x = rows.crossJoin(F.broadcast(edge)).withColumn("_b", part).drop("_lo", "_hi")  # one row
    over, buckets_in_order = Window.partitionBy("_b").orderBy("row_idx"), Window.orderBy("_b")
    row = F.struct("chrom", "end", "_d")
    ends = x.groupBy("_b").agg(F.min_by(row, "row_idx").alias("_f"), F.max_by(row, "row_idx").alias("_l"))
    ends = F.broadcast(ends.select("_b", F.lead("_f").over(buckets_in_order).alias("_f"), F.lag("_l").over(buckets_in_order).alias("_l")))  # a row a bucket
    x = x.withColumns({"_next": F.lead(row).over(over), "_prev": F.lag(row).over(over)}).join(ends, "_b")
    following, before = F.coalesce("_next", "_f"), F.coalesce("_prev", "_l")
    return x.select(*rows.columns, following["chrom"].alias("_chrom"), following["end"].alias("_end"), (before["_d"] & (before["chrom"] == F.col("chrom"))).alias("_was"))


def merge_rows(bed: DataFrame, rate: float, seed: int) -> DataFrame:
    """Joins a drawn row with the next row of the frame, if that is on the same chromosome: from its start to the next one's end; both rows go."""
    check_rate(rate)
    x = _beside(marked(bed, rate, seed, "merge"), max(16, bed.count() >> 20))
    made = F.coalesce(F.col("_d") & (F.col("_chrom") == F.col("chrom")), F.lit(False))
    kept = x.where(~made & ~F.coalesce("_was", F.lit(False))).select("row_idx", "chrom", "start", "end", "mod")
    return kept.unionByName(x.where(made).select("row_idx", "chrom", "start", F.col("_end").alias("end"), F.lit("M").alias("mod")))


def _numbered(bed: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (id, chrom, start, end) after those of ``bed``, with row numbers that go on from its last."""
    most = bed.agg(F.coalesce(F.max("row_idx"), F.lit(-1)).alias("_most"))
    made = made.crossJoin(F.broadcast(most)).select((F.col("id") + F.col("_most") + 1).alias("row_idx"), "chrom", "start", "end", F.lit("A").alias("mod"))  # one row
    return bed.withColumn("row_idx", F.col("row_idx").cast(made.schema["row_idx"].dataType)).unionByName(made)


def add(bed: DataFrame, sizes: DataFrame, rate: float, mean: float, sd: float, seed: int) -> DataFrame:
    """New rows on chromosomes by size, with normal widths, ends clamped to the chromosome."""
    check_rate(rate, None)
    n = int(bed.count() * rate)
    spans = sizes.withColumn("_hi", F.sum("size").over(Window.orderBy("chrom"))).withColumn("_lo", F.col("_hi") - F.col("size"))
    spans = spans.withColumn("_all", F.sum("size").over(Window.partitionBy()))  # a row a chromosome
    new = bed.sparkSession.range(n).withColumn("_at", uniform(seed, "addc", F.col("id"))).withColumn("_w", normal(seed, "addw", mean, sd, F.col("id")).cast("long"))
    new = new.join(F.broadcast(spans), (F.col("_at") * F.col("_all") >= F.col("_lo")) & (F.col("_at") * F.col("_all") < F.col("_hi")))
    start = F.floor(uniform(seed, "adds", F.col("id")) * F.col("size")) + 1
    return _numbered(bed, new.select("id", "chrom", start.alias("start"), F.least(start + F.col("_w"), F.col("size")).alias("end")))


def add_valid(bed: DataFrame, valid: DataFrame, rate: float, mean: float, sd: float, seed: int) -> DataFrame:
    """New rows that start within the regions of ``valid`` (row_idx, chrom, start, end), drawn by their lengths; ends are not clamped.

    The regions lie end to end in the order of (chrom, start, row_idx); a drawn number falls into one of them, found by a
    join on ranges of that line.
    """
    check_rate(rate, None)
    n = int(bed.count() * rate)
    size = F.col("end") - F.col("start")
    per = valid.groupBy("chrom").agg(F.sum(size).alias("_s"))  # a row a chromosome
    carry = per.withColumn("_c", F.coalesce(F.sum("_s").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_s").over(Window.partitionBy()))
    x = valid.withColumn("_b", F.floor(F.col("start") / BUCKET))
    earlier = Window.partitionBy("chrom").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = x.groupBy("chrom", "_b").agg(F.sum(size).alias("_h")).select("chrom", "_b", F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_p"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy("chrom", "_b").orderBy("start", "row_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = x.withColumn("_i", within).join(held, ["chrom", "_b"]).join(F.broadcast(carry), "chrom").select("chrom", "start", "end", (F.col("_i") + F.col("_p") + F.col("_c")).alias("r_start"))
    line = line.select(F.lit("").alias("chrom"), F.col("chrom").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"), "r_start", (F.col("r_start") + F.col("end") - F.col("start")).alias("r_end"))
    new = bed.sparkSession.range(n).crossJoin(F.broadcast(carry.agg(F.max("_all").alias("_all"))))  # one row
    at = F.floor(uniform(seed, "validr", F.col("id")) * F.col("_all"))
    new = new.select("id", F.lit("").alias("chrom"), at.alias("start"), (at + 1).alias("end"))
    met = interval_join(new, line, size=1 << 16).select("id", F.col("of").alias("chrom"), "s", "e")
    start = F.col("s") + F.floor(uniform(seed, "valids", F.col("id")) * (F.col("e") - F.col("s") + 1))
    return _numbered(bed, met.select("id", "chrom", start.alias("start"), (start + normal(seed, "addw", mean, sd, F.col("id")).cast("long")).alias("end")))


def add_from_file(bed: DataFrame, other: DataFrame, rate: float, seed: int) -> DataFrame:
    """Adds ``int(rows * rate)`` rows of another set, at most all of them; their row numbers go on from the last."""
    check_rate(rate, None)
    picked = first_by_hash(other, int(bed.count() * rate), _hash(seed, "addfile"), "row_idx", "chrom", "start", "end")
    return _numbered(bed, picked.select(F.col("row_idx").alias("id"), "chrom", "start", "end"))


def all_perturbations(bed: DataFrame, sizes: DataFrame, seed: int, *, shift_rate=0.0, add_rate=0.0, cut_rate=0.0, merge_rate=0.0, drop_rate=0.0, mean=0.0, sd=150.0, add_mean=320.0, add_sd=30.0) -> DataFrame:
    """Shift, add, cut, merge, drop - those with a rate, in this order; the rows and each one's result are written, as the next reads them several times."""
    bed = written(bed)
    bed = written(shift(bed, sizes, shift_rate, mean, sd, seed)) if shift_rate else bed
    bed = written(add(bed, sizes, add_rate, add_mean, add_sd, seed)) if add_rate else bed
    bed = written(cut(bed, cut_rate, seed)) if cut_rate else bed
    bed = written(merge_rows(bed, merge_rate, seed)) if merge_rate else bed
    return drop(bed, drop_rate, seed) if drop_rate else bed


OPERATIONS = {"shift": shift, "add": add, "add_valid": add_valid, "cut": cut, "merge": merge_rows, "drop": drop, "add_from_file": add_from_file, "shift_from_file": shift_from_file, "drop_from_file": drop_from_file}


def program(bed: DataFrame, steps: list[dict], **inputs) -> DataFrame:
    """Applies named operations in order, each to the written result of the one before; ``inputs`` (sizes, seed) serve those that take them."""
    import inspect

    for step in steps:
        step = dict(step)
        name = step.pop("op", None)
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name!r}")
        f = OPERATIONS[name]
        takes = inspect.signature(f).parameters
        if unknown := set(step) - set(takes):
            raise ValueError(f"{name} takes no {sorted(unknown)}")
        bed = written(f(bed, **{k: v for k, v in inputs.items() if k in takes}, **step))
    return bed


#: What a YAML program calls its list, and the parameters of its operations (fixed values of the file's format).
YAML_LIST = "bedshift_operations"
YAML_NAMES = {"rate": "rate", "mean": "mean", "stdev": "sd", "valid_regions": "valid", "file": "other"}


def yaml_program(bed: DataFrame, path: str, read, **inputs) -> DataFrame:
    """Applies the operations that a YAML file lists, in order.

    An entry names one operation among its keys (add with valid_regions is ``add_valid``); ``read`` opens the regions that a
    path names, in which environment variables are expanded.  Keys that an operation doesn't take raise ``ValueError``.
    """
    import os

    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get(YAML_LIST)
    if not entries:
        raise ValueError(f"no {YAML_LIST} in {path}")
    steps = []
    for entry in entries:
        named = [k for k in entry if k in OPERATIONS]
        if len(named) != 1:
            raise ValueError(f"an entry must name one operation: {sorted(entry)}")
        rest = {k: v for k, v in entry.items() if k not in named and k != "delimiter"}
        if unknown := set(rest) - set(YAML_NAMES):
            raise ValueError(f"{named[0]} takes no {sorted(unknown)}")
        step = {YAML_NAMES[k]: v for k, v in rest.items()}
        for k in ("other", "valid"):
            if k in step:
                step[k] = read(os.path.expandvars(step[k]))
        steps.append({"op": "add_valid" if named[0] == "add" and "valid" in step else named[0], **step})
    return program(bed, steps, **inputs)


def repeated(bed: DataFrame, times: int, seed: int, f) -> DataFrame:
    """``times`` perturbed copies ``f(bed, seed)`` with rep_id (zero-padded to one width); each has a seed of its own."""
    out = None
    for k in range(1, times + 1):
        one = f(bed, seed * 1_000_003 + k).withColumn("rep_id", F.lit(str(k).zfill(len(str(times)))))
        out = one if out is None else out.unionByName(one)
    return out
