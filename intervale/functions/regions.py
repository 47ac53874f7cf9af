"""Column functions on regions, scores and identifiers; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(chrom: Column) -> Column:
    """Sorts chr2 before chr10, numbered chromosomes before named ones."""
    number = F.regexp_replace(F.split(chrom, "_")[0], "chr", "").try_cast("int")
    return F.struct(F.coalesce(number, F.lit(2147483647)), chrom)


def region_key(chrom: Column, start: Column, end: Column, sep: str = ":") -> Column:
    """chr:start-end, or with another separator chr_start_end."""
    return F.concat(chrom, F.lit(sep), start.cast("string"), F.lit("-" if sep == ":" else sep), end.cast("string"))


def parse_region(key: Column) -> Column:
    """struct(chrom, start, end) of chr:start-end."""
    part = F.split(F.trim(key), r"[:\-]")
    return F.struct(F.trim(part[0]).alias("chrom"), F.trim(part[1]).cast("long").alias("start"), F.trim(part[2]).cast("long").alias("end"))


def genome_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The gap between two regions plus one; 0 if they overlap."""
    return F.when(e1 < e2, F.greatest(s2 - e1 + 1, F.lit(0))).otherwise(F.greatest(s1 - e2 + 1, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero, which has no direction."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, from 0 to 1."""
    return (1 - cosine(a, b)) / 2


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def rbs(to_universe: Column, from_universe: Column) -> Column:
    """Region boundary score of the two median distances."""
    return (F.lit(10.0) * 101 / (to_universe + 100) + F.lit(101.0) / (from_universe + 100)) / 11


def f_beta(overlap: Column, only_file: Column, only_universe: Column, beta: float = 10.0) -> Column:
    """F score of recall and precision in base pairs; null where either is undefined."""
    recall = overlap / F.nullif(overlap + only_file, F.lit(0))
    precision = overlap / F.nullif(overlap + only_universe, F.lit(0))
    return (1 + beta * beta) * precision * recall / F.nullif(beta * beta * precision + recall, F.lit(0.0))


def snpr(query: Column, random: Column) -> Column:
    return F.greatest(F.log10((query + 1e-10) / (random + 1e-10)), F.lit(0.0))


def hyphenated(uuid: Column) -> Column:
    """A UUID of 32 digits in groups of 8-4-4-4-12."""
    return F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uniform(seed: int, salt: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the salt and the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296


def padded(tokens: Column, width: int, pad: int) -> Column:
    """Right-padded (or cut) to ``width``."""
    return F.concat(F.slice(tokens, 1, width), F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(tokens), F.lit(0))))


def mask(tokens: Column, pad: int) -> Column:
    return F.transform(tokens, lambda x: x != pad)


def linear_rate(start: float, end: float, epochs: int, epoch: Column) -> Column:
    return F.lit(start) - F.lit((start - end) / epochs) * epoch


def milestone_rate(start: float, end: float, ratio: float, every: int, epoch: Column) -> Column:
    return F.greatest(F.lit(start) * F.pow(F.lit(ratio), F.floor(epoch / every)), F.lit(end))


def constant_rate(start: float, epoch: Column) -> Column:
    return F.lit(start) + epoch * 0


def decayed_linear_rate(start: float, decay: float, least: float, epoch: Column) -> Column:
    return F.greatest(F.lit(start) - F.lit(decay) * epoch, F.lit(least))


def exponential_rate(start: float, decay: float, least: float, epoch: Column) -> Column:
    """Divided by 1 + decay * e after each epoch e from 1 to ``epoch``, not below ``least``."""
    steps = F.when(epoch > 0, F.sequence(F.lit(1), epoch.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(start), lambda rate, e: F.greatest(rate / (1 + F.lit(decay) * e), F.lit(least)))


def warmed(step: Column, warm: int) -> Column:
    return step / max(1, warm)


def cosine_restart_rate(warm: int, total: int, cycles: int, step: Column) -> Column:
    """Share of the top rate: a linear rise over ``warm`` steps, then ``cycles`` cosine falls whose height sinks with the steps left."""
    progress = (step - warm) / max(1, total - warm)
    height = (F.lit(total + warm) - step) / (2 * total)
    fall = F.greatest(F.lit(0.0), height * (1.0 + F.cos(F.lit(math.pi) * (F.lit(float(cycles)) * progress % 1.0))))
    return F.when(step < warm, warmed(step, warm)).when(progress >= 1.0, 0.0).otherwise(fall)


def linear_floor_rate(warm: int, total: int, floor: float, step: Column) -> Column:
    """Share of the top rate: a linear rise over ``warm`` steps, then a linear fall that stops at ``floor``."""
    return F.when(step < warm, warmed(step, warm)).otherwise(F.greatest((F.lit(total) - step) / max(1, total - warm), F.lit(floor)))


def snp_end(start: Column, end: Column) -> Column:
    """A mutation's end as a region's: one more where it would be empty."""
    return F.when(start == end, end + 1).otherwise(end)


def first_chromosome(*chroms: Column) -> Column:
    """The first of several chromosomes in natural order."""
    return F.array_min(F.array(*[F.struct(natural_key(c).alias("k"), c.alias("c")) for c in chroms]))["c"]


def region_of_line(line: Column) -> Column:
    """struct(chrom, start, end) of a tab-separated line."""
    part = F.split(line, "\t")
    return F.struct(part[0].alias("chrom"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))


def time_text(seconds: Column) -> Column:
    """Seconds as hours, minutes or seconds, whichever is the largest unit they fill, with two decimals."""
    return F.when(seconds >= 3600, F.concat(F.format_string("%.2f", seconds / 3600), F.lit("h"))).when(seconds >= 60, F.concat(F.format_string("%.2f", seconds / 60), F.lit("m"))).otherwise(F.concat(F.format_string("%.2f", seconds / 1), F.lit("s")))


def single_precision(vector: Column) -> Column:
    return vector.cast("array<float>")


def payload_field(payload: Column, name: str) -> Column:
    """A field of a JSON payload, as text."""
    return F.get_json_object(payload, f"$.{name}")


#: What marks a word as a label.
LABEL = "__label__"


def label_word(label: Column) -> Column:
    return F.concat(F.lit(LABEL), label)


def is_label(word: Column) -> Column:
    return word.contains(LABEL)


def label_of(word: Column) -> Column:
    return F.replace(word, F.lit(LABEL), F.lit(""))


def random_subset(tokens: Column, n: int, seed: int, key: Column) -> Column:
    """``n`` tokens drawn by a hash of the key and their place, in their order."""
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(places), 1, n), lambda x: x["i"]))
    return F.when(F.size(tokens) <= n, tokens).otherwise(F.transform(kept, lambda i: F.get(tokens, i)))
