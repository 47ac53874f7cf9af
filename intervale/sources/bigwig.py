"""bigWig files as a data source: signal tracks, read block by block through the file's own index.

The driver reads a file's header, its chromosome tree and its R-tree, and deals the data blocks to partitions of ``PART`` compressed bytes of
one chromosome; tasks seek to their blocks, inflate and decode them.  The option ``chroms`` names the chromosomes that are wanted; the
blocks of others are not read.  It is an option and no pushed filter, since the engine (4.1.2) keeps a relation's pushed filters for its
later scans.  Paths are local or of any file system that Arrow opens (hdfs, s3, gs), and are the same for all executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from intervale.session import prepare

#: Compressed bytes of a partition's blocks.
PART = 1 << 22
# fixed values of the format: what files, chromosome trees and R-trees begin with, and the layouts of a block's items
MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
SCHEMA = "file string, chrom string, start long, end long, value float"


@dataclass
class Blocks(InputPartition):
    """Data blocks (offset, compressed bytes) of one chromosome of a file, next to each other in its index."""

    path: str
    chrom: str
    number: int
    order: str
    packed: bool
    blocks: list[tuple[int, int]]


def _opened(path: str):
    system, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return system.open_input_file(name)


class BigWig:
    """A file's header, chromosomes and index."""

    def __init__(self, path: str) -> None:
        self.path, self.file = path, _opened(path)
        first = self._read(0, 4)
        self.order = next((o for o in "<>" if len(first) == 4 and struct.unpack(o + "I", first)[0] == MAGIC), "")
        if not self.order:
            raise ValueError(f"no bigWig file: {path}")
        _, _, _, self.chrom_at, _, self.index_at, _, _, _, _, buffer, _ = self._at("IHHQQQHHQQIQ", 0)
        self.packed = buffer > 0

    def close(self) -> None:
        self.file.close()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _at(self, layout: str, at: int) -> tuple:
        return struct.unpack(self.order + layout, self._read(at, struct.calcsize(self.order + layout)))

    def chromosomes(self) -> dict[str, tuple[int, int]]:
        """Number and size of each chromosome."""
        magic, _, key, _, _, _ = self._at("IIIIQQ", self.chrom_at)
        if magic != CHROM_MAGIC:
            raise ValueError(f"no chromosome tree: {self.path}")
        out, todo = {}, [self.chrom_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, count = self._at("BBH", at)
            layout = f"{key}sII" if leaf else f"{key}sQ"
            size = struct.calcsize(self.order + layout)
            data = self._read(at + 4, size * count)
            for name, *rest in struct.iter_unpack(self.order + layout, data):
                if leaf:
                    out[name.rstrip(b"\0").decode()] = (rest[0], rest[1])
                else:
                    todo.append(rest[0])
        return out

    def blocks(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """Chromosome, offset and compressed bytes of the data blocks of the wanted chromosomes, in the index's order; branches without any are not read."""
        if self._at("I", self.index_at)[0] != INDEX_MAGIC:
            raise ValueError(f"no index: {self.path}")
        todo = [self.index_at + 48]
        while todo:
            at = todo.pop()
            leaf, _, count = self._at("BBH", at)
            layout = "IIIIQQ" if leaf else "IIIIQ"
            data = self._read(at + 4, struct.calcsize(self.order + layout) * count)
            below = []
            for low, _, high, _, *to in struct.iter_unpack(self.order + layout, data):
                if wanted is not None and not any(low <= c <= high for c in wanted):
                    continue
                if leaf:
                    yield low, to[0], to[1]
                else:
                    below.append(to[0])
            todo += below[::-1]


def decoded(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome, starts, ends and values of an inflated block."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", data)
    whole, real = np.dtype("u4").newbyteorder(order), np.dtype("f4").newbyteorder(order)
    if kind == BED_GRAPH:
        x = np.frombuffer(data, np.dtype([("start", whole), ("end", whole), ("value", real)]), n, 24)
        return chrom, x["start"].astype(np.int64), x["end"].astype(np.int64), x["value"].astype(np.float32)
    if kind == VARIABLE_STEP:
        x = np.frombuffer(data, np.dtype([("start", whole), ("value", real)]), n, 24)
        at, value = x["start"].astype(np.int64), x["value"]
    elif kind == FIXED_STEP:
        at, value = start + step * np.arange(n, dtype=np.int64), np.frombuffer(data, real, n, 24)
    else:
        raise ValueError(f"unknown kind of block: {kind}")
    return chrom, at, at + span, value.astype(np.float32)


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.chroms = set(options["chroms"].split("\n")) if "chroms" in options else None
        self.part = int(options.get("part", PART))

    def partitions(self) -> list[Blocks]:
        out: list[Blocks] = []
        for path in self.paths:
            one = BigWig(path)
            known = {number: name for name, (number, _) in one.chromosomes().items()}
            wanted = None if self.chroms is None else {n for n, name in known.items() if name in self.chroms}
            last, held = None, 0
            for number, at, size in one.blocks(wanted):
                if last != number or held + size > self.part:
                    out.append(Blocks(path, known[number], number, one.order, one.packed, []))
                    last, held = number, 0
                out[-1].blocks.append((at, size))
                held += size
            one.close()
        return out or [Blocks("", "", -1, "<", False, [])]  # no partition at all would be read as a whole

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        file = _opened(partition.path)
        for at, size in partition.blocks:
            file.seek(at)
            data = file.read(size)
            chrom, start, end, value = decoded(zlib.decompress(data) if partition.packed else data, partition.order)
            if chrom == partition.number:
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path.rsplit("/", 1)[-1]] * n), pa.array([partition.chrom] * n), pa.array(start), pa.array(end), pa.array(value)], ["file", "chrom", "start", "end", "value"])
        file.close()


class BigWigSource(DataSource):
    """``spark.read.format("bigwig")``: file, chrom, start, end, value of one file, or of several whose paths stand in lines, as the names in ``chroms`` do."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def read_signal(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """file, chrom, start, end, value of bigWig files, as they hold them, of all or of some chromosomes."""
    prepare(spark)
    spark.dataSource.register(BigWigSource)
    reader = spark.read.format("bigwig")
    if chroms is not None:
        reader = reader.option("chroms", "\n".join(chroms))
    return reader.load("\n".join([path] if isinstance(path, str) else path))


def read_bigwig(spark: SparkSession, path: str, track: str = "core", chroms: list[str] | None = None) -> DataFrame:
    """chrom, start, end, cov, track of a bigWig file, as ``bed.read_bedgraph``: depths without fraction, runs of 0 and of no number left out."""
    x = read_signal(spark, path, chroms).where("not isnan(value)")
    return x.select("chrom", "start", "end", F.floor("value").alias("cov"), F.lit(track).alias("track")).where("cov > 0")


def chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size of a bigWig file."""
    one = BigWig(path)
    rows = [(name, size) for name, (_, size) in sorted(one.chromosomes().items())]
    one.close()
    return spark.createDataFrame(rows, "chrom string, size long")
