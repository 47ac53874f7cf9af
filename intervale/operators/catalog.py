"""Content addresses and the cache of region sets, sets of them, and tokens."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The environment variable that names the cache's folder, and the folder where it names none.
CACHE_VARIABLE, CACHE_DEFAULT = "INTERVALE_CACHE", "~/.intervale"


class RegionSetNotFoundError(FileNotFoundError):
    """No such region set (or set of them) in the cache, and nothing to fetch it with."""


class TokensNotFoundError(FileNotFoundError):
    """No tokens of that region set for that universe in the cache."""


def identifiers(regions: DataFrame, by: str = "bed_id") -> DataFrame:
    """by, identifier: md5 of the md5s of the comma-joined columns, in file order (row_idx, then start and end).

    A file is digested row by row as its sorted batches arrive, so its size bounds no memory.
    """
    x = regions.select(by, "row_idx", "chrom", "start", "end").repartition(by).sortWithinPartitions(by, "row_idx", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, sums, none = None, [], True

        def done() -> pa.RecordBatch:
            whole = hashlib.md5(",".join(m.hexdigest() for m in sums).encode()).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([file], kind), pa.array([whole])], [by, "identifier"])

        for b in batches:
            kind, names = b.schema.field(by).type, b.column(by).to_pylist()
            columns = [[str(v) for v in b.column(c).to_pylist()] for c in ("chrom", "start", "end")]
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if none or names[at] != file:
                    if not none:
                        yield done()
                    file, none, sums = names[at], False, [hashlib.md5() for _ in columns]
                    fresh = True
                else:
                    fresh = False
                for m, c in zip(sums, columns, strict=True):
                    m.update((("" if fresh else ",") + ",".join(c[at:to])).encode())
                at = to
        if not none:
            yield done()

    return x.mapInArrow(run, f"{by} {x.schema[by].dataType.simpleString()}, identifier string")


def set_identifier(members: DataFrame) -> DataFrame:
    """md5 of the members' identifiers (ord, identifier), in order, joined by nothing."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "identifier"))), lambda s: s["identifier"])  # a row a file
    return members.agg(F.md5(F.array_join(names, "").cast("binary")).alias("identifier"))


def missing(wanted: DataFrame, done: DataFrame, by: str = "bed_id") -> DataFrame:
    """The files (by) that are wanted and not yet done."""
    return wanted.select(by).distinct().join(done.select(by).distinct(), by, "left_anti")


def metadata(rows: DataFrame, columns: list[str], file_key: str, *, series_key: str | None = None, genome_key: str | None = None, genomes: list[str] | None = None) -> DataFrame:
    """series, files: the files (name, metadata map) of each series, or of each file where there is no such column.

    Only the given genomes count, and only values that are there; a file without any is left out.  Of several rows of a
    file outside series the last by its metadata counts.
    """
    if genomes is not None:
        rows = rows.where(F.col(genome_key).isin(genomes))
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]), lambda e: e["value"].isNotNull())
    x = rows.select(F.col(file_key).alias("name"), entries.alias("entries"), *([F.col(series_key).alias("series")] if series_key else [])).where(F.size("entries") > 0)
    if not series_key:
        x = x.groupBy("name").agg(F.max("entries").alias("entries")).withColumn("series", F.col("name"))
    files = F.transform(F.array_sort(F.collect_list(F.struct("name", "entries"))), lambda f: F.struct(f["name"].alias("name"), F.map_from_entries(f["entries"]).alias("metadata")))
    return x.groupBy("series").agg(files.alias("files"))


class Cache:
    """Region sets, sets of region sets and tokens under a folder, by content address.

    ``folder``: by default the one that ``INTERVALE_CACHE`` names, or, on a local master only, one in the home folder; executors
    write to it, so it must be shared, and ``ValueError`` is raised where none is named.  ``fetch`` gives the rows of a region set that the cache
    lacks, and ``fetch_set`` the identifiers of a set's members.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fetch: Callable[[str], DataFrame] | None = None, fetch_set: Callable[[str], list[str]] | None = None) -> None:
        self.spark, self.fetch, self.fetch_set = spark, fetch, fetch_set
        named = folder or os.environ.get(CACHE_VARIABLE)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"name a folder that driver and executors share, or set {CACHE_VARIABLE}")
        self.folder = (named or os.path.expanduser(CACHE_DEFAULT)).rstrip("/")

    def _path(self, identifier: str, kind: str = "bedfiles") -> str:
        return f"{self.folder}/{kind}/{identifier[0]}/{identifier[1]}/{identifier}"

    def _tokens(self, universe: str, identifier: str) -> str:
        return f"{self.folder}/tokens/{universe}/{identifier}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def add(self, regions: DataFrame) -> str:
        """Stores one region set (row_idx, chrom, start, end) and returns its identifier."""
        identifier = identifiers(regions.withColumn("bed_id", F.lit(0))).first()["identifier"]
        regions.write.mode("overwrite").parquet(self._path(identifier))
        return identifier

    def add_set(self, members: list[str]) -> str:
        """Stores a set of cached region sets by their identifiers, in order, and returns its own."""
        for m in members:
            self.seek(m)
        rows = self.spark.createDataFrame(list(enumerate(members)), "ord long, identifier string")
        identifier = set_identifier(rows).first()["identifier"]
        rows.coalesce(1).write.mode("overwrite").parquet(self._path(identifier, "bedsets"))
        return identifier

    def seek(self, identifier: str) -> str:
        """The path of a set of region sets, or else of a region set."""
        for kind in ("bedsets", "bedfiles"):
            if self._there(self._path(identifier, kind)):
                return self._path(identifier, kind)
        raise RegionSetNotFoundError(identifier)

    def load(self, identifier: str) -> DataFrame:
        """The rows of a region set, fetched and stored if the cache lacks them."""
        path = self._path(identifier)
        if not self._there(path):
            if self.fetch is None:
                raise RegionSetNotFoundError(identifier)
            self.fetch(identifier).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def members(self, identifier: str) -> list[str]:
        """The identifiers of a set's region sets, in order."""
        path = self._path(identifier, "bedsets")
        if not self._there(path):
            if self.fetch_set is None:
                raise RegionSetNotFoundError(identifier)
            rows = self.spark.createDataFrame(list(enumerate(self.fetch_set(identifier))), "ord long, identifier string")
            rows.coalesce(1).write.mode("overwrite").parquet(path)
        return [r["identifier"] for r in self.spark.read.parquet(path).orderBy("ord").collect()]  # a row a file

    def load_set(self, identifier: str) -> DataFrame:
        """The rows of all region sets of a set, with bed_id, their identifier."""
        out = None
        for m in self.members(identifier):
            one = self.load(m).withColumn("bed_id", F.lit(m))
            out = one if out is None else out.unionByName(one)
        return out

    def add_tokens(self, universe: str, identifier: str, tokens: DataFrame) -> None:
        """Stores the tokens of a region set for a universe."""
        tokens.write.mode("overwrite").parquet(self._tokens(universe, identifier))

    def load_tokens(self, universe: str, identifier: str) -> DataFrame:
        if not self._there(self._tokens(universe, identifier)):
            raise TokensNotFoundError(f"{universe}/{identifier}")
        return self.spark.read.parquet(self._tokens(universe, identifier))

    def remove_tokens(self, universe: str, identifier: str) -> None:
        if not self._there(self._tokens(universe, identifier)):
            raise TokensNotFoundError(f"{universe}/{identifier}")
        self._remove(self._tokens(universe, identifier), 1)

    def remove(self, identifier: str, *, members: bool = False) -> None:
        """Removes a region set, or a set of them (with its members, if asked), and folders that this leaves empty."""
        path = self.seek(identifier)
        if members and "/bedsets/" in path:
            for m in self.members(identifier):
                if self._there(self._path(m)):
                    self._remove(self._path(m), 2)
        self._remove(path, 2)

    def _remove(self, path: str, above: int) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
        for _ in range(above):
            p = p.getParent()
            if len(fs.listStatus(p)):
                return
            fs.delete(p, False)

    def list(self, kind: str = "bedfiles") -> list[str]:
        """The identifiers of all region sets, or of all ``bedsets``, sorted."""
        fs, p = self._fs(f"{self.folder}/{kind}/*/*/*")
        return sorted(s.getPath().getName() for s in fs.globStatus(p) or [])
