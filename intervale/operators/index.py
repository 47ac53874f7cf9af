"""Vector indexes with payloads, and searching them by vectors, region sets and texts."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators import search
from intervale.session import cut


class SearchBackend(ABC):
    """What an index of rows (id, v, payload) offers, so that searches by texts and region sets take any."""

    @abstractmethod
    def load(self, rows: DataFrame, payload: str | None = None) -> SearchBackend:
        """Adds rows."""

    @abstractmethod
    def search(self, queries: DataFrame, limit: int, *, offset: int = 0, with_payload: bool = True, with_vectors: bool = True) -> DataFrame:
        """query_id, place, id, score (and payload, v) of the nearest rows of each query (query_id, q)."""

    @abstractmethod
    def retrieve(self, ids: DataFrame, *, with_vectors: bool = False) -> DataFrame:
        """id, payload (and v) of ids (id)."""

    @abstractmethod
    def __len__(self) -> int:
        """How many rows there are."""


class VectorIndex(SearchBackend):
    """An exact index of rows (id, v, payload), the payload of any type; written to the shared folder as it grows."""

    def __init__(self, measure: str = "cosine") -> None:
        self.measure, self.rows = measure, None

    def load(self, rows: DataFrame, payload: str | None = None) -> VectorIndex:
        """Adds rows (v, and id if they have one): ids go on from those in the index unless given."""
        own = rows.select("v", *(["id"] if "id" in rows.columns else []), *([F.col(payload).alias("payload")] if payload else []))
        if "id" not in own.columns:
            from intervale.operators.intervals import ranked

            own = cut(own.withColumn("start", F.monotonically_increasing_id()))
            own = ranked(own.withColumn("chrom", F.lit("")), [], bucket=1 << 33).withColumn("id", F.col("n") - 1 + len(self)).drop("chrom", "start", "n")
        self.rows = cut(own if self.rows is None else self.rows.unionByName(own, allowMissingColumns=True))
        return self

    def __len__(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def search(self, queries: DataFrame, limit: int, *, offset: int = 0, with_payload: bool = True, with_vectors: bool = True) -> DataFrame:
        """query_id, place, id, score (and payload, v): the nearest rows of each query (query_id, q), itself among them."""
        found = search.knn(queries, self.rows, limit, self.measure, offset, itself=True)
        more = [c for c, wanted in (("payload", with_payload), ("v", with_vectors)) if wanted and c in self.rows.columns]
        return found.join(self.rows.select("id", *more), "id").select("query_id", "place", "id", "score", *more) if more else found.select("query_id", "place", "id", "score")

    def retrieve(self, ids: DataFrame, *, with_vectors: bool = False) -> DataFrame:
        """id, payload (and v) of the ids (id) that the index holds."""
        more = [c for c in ("payload", "v") if c in self.rows.columns and (c != "v" or with_vectors)]
        return self.rows.join(ids.select("id").distinct(), "id", "left_semi").select("id", *more)

    @staticmethod
    def merged(*indexes: VectorIndex) -> VectorIndex:
        """One index of several of the same measure, payloads kept, ids going on from one to the next."""
        out = VectorIndex(indexes[0].measure)
        out.rows = cut(search.merge_indexes(*[x.rows for x in indexes]))
        return out


def text_vectors(rows: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """key, v: a text's hashed word counts, of length 1, the stand-in for a sentence encoder.

    A lower-cased word counts at the place that its md5 names, with the sign that this names too.  A text without words has
    the zero vector.  Keys are distinct.
    """
    words = rows.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''")
    number = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
    sign = F.when(number >= 1 << 31, -1.0).otherwise(1.0)
    counts = words.groupBy(key, (number % width).alias("k")).agg(F.sum(sign).alias("x"))
    found = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("z"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    v = F.transform(places, lambda k: F.when(F.col("z") > 0, F.coalesce(F.col("m")[k], F.lit(0.0)) / F.col("z")).otherwise(0.0))
    return rows.select(key).join(found, key, "left").select(key, v.alias("v"))


class TextSearch:
    """Texts against an index of vectors; ``encode(rows, key, text)`` gives vectors of the index's width by key."""

    def __init__(self, index: VectorIndex, encode: Callable = text_vectors) -> None:
        self.index, self.encode = index, encode

    def query(self, texts: DataFrame, limit: int, **options) -> DataFrame:
        """Results of ``VectorIndex.search`` for rows (query_id, text)."""
        return self.index.search(self.encode(texts, "query_id", "text").select("query_id", F.col("v").alias("q")), limit, **options)

    def evaluate(self, texts: DataFrame, relevant: DataFrame) -> DataFrame:
        """Mean retrieval metrics over the whole index, given the rows (query_id, id) that are relevant; queries without any don't count."""
        asked = texts.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
        found = self.query(asked, len(self.index), with_payload=False, with_vectors=False)
        marked = found.join(relevant.select("query_id", "id").distinct().withColumn("relevant", F.lit(1)), ["query_id", "id"], "left").fillna(0, ["relevant"])
        return search.mean_metrics(search.retrieval_metrics(marked.select("query_id", "place", "relevant")))


class RegionSearch:
    """Region sets against an index of files' vectors, by the mean of their regions' vectors."""

    def __init__(self, index: VectorIndex, vocab: DataFrame, embeddings: DataFrame) -> None:
        self.index, self.vocab, self.embeddings = index, vocab, embeddings

    def vectors(self, regions: DataFrame) -> DataFrame:
        """bed_id, v of region sets (bed_id, row_idx, chrom, start, end)."""
        from intervale.operators import encode

        return encode.file_vectors(encode.token_rows(regions, self.vocab, "bed_id"), self.embeddings)

    def query(self, regions: DataFrame, limit: int, **options) -> DataFrame:
        return self.index.search(self.vectors(regions).select(F.col("bed_id").alias("query_id"), F.col("v").alias("q")), limit, **options)


class BiVectorSearch:
    """A text against tags, then the files of those tags against all files.

    The tags' payload is the array of their files' ids.
    """

    def __init__(self, tags: VectorIndex, files: VectorIndex, encode: Callable = text_vectors) -> None:
        self.tags, self.files, self.encode = tags, files, encode

    def query(self, spark: SparkSession, text: str, limit: int, **options) -> DataFrame:
        one = self.encode(spark.createDataFrame([(0, text)], "query_id long, text string"), "query_id", "text").select("query_id", F.col("v").alias("q"))
        own = 1 - F.col("score") if self.tags.measure == "l2" else F.col("score")
        tags = self.tags.search(one, search.first_limit(limit), with_vectors=False).select((F.col("place") - 1).alias("tag_place"), own.alias("tag_score"), F.explode("payload").alias("id"))
        return search.bivector(tags, self.files.rows, limit, measure=self.files.measure, **options)


def with_attributes(found: DataFrame, attributes: DataFrame, file: str = "file") -> DataFrame:
    """Search results whose payload names a file, with the file's attributes."""
    return found.join(attributes, found["payload"] == attributes[file], "left")
