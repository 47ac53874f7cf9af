"""Packing token ids into windows of a fixed capacity by Karmarkar-Karp multiway differencing.

A document's full windows stand alone.  What is left of it, cut into pieces of at most half a window, joins the other
rests of its partition.  Rests of about ``GROUP`` windows are partitioned at once: each piece starts as a partial
partition with one filled slot, and the two partial partitions with the largest spreads merge again and again, the fullest
slot of one with the emptiest of the other.  If the fullest window of the result exceeds the capacity, one window more is
allowed and the group is partitioned again.  Nothing is shuffled, a partition holds one group at a time, and a lost task
gives the same rows when it runs again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import bpe
from intervale.llm.common import kind, prepare, table

CAPACITY, GROUP = 1024, 192


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size, by multiway differencing."""
    n = len(sizes)
    if k == 1 or n == 1:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray | None] = []
    for s in sizes.tolist():
        slots = np.zeros(k, np.int64)
        slots[0] = s
        sums.append(slots)
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both)
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(merges)))
        merges.append((a, b, order))
    labels: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k)}
    window = np.zeros(n, np.int64)
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        own = labels.pop(n + m)
        for child, slot in ((a, order), (b, k - 1 - order)):
            got = np.empty(k, np.int64)
            got[slot] = own
            if child < n:
                window[child] = got[0]
            else:
                labels[child] = got
    return window


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; no window holds more than ``capacity``, and there are as few as differencing reaches."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        got = differencing(sizes, k)
        if np.bincount(got, sizes).max() <= capacity:
            return got
        k += 1


def pack(docs: DataFrame, path: str | None = None, *, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids (null: the empty text) and then ``end_id``, so an empty text is one id.  Each id lies in
    exactly one piece; the pieces of a sequence follow one another from offset 0 without gaps and have at most
    ``capacity`` ids together.  Rows that repeat an id are documents of their own.  Null ids are kept.  An empty table gives
    no pieces.  Other columns are ignored.
    """
    prepare(docs.sparkSession)
    path = path or bpe.default_path()
    most = max(1, capacity // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoding(path)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        rests: list[tuple] = []
        held = waiting = 0
        named = pa.int64()

        def close() -> None:
            nonlocal sequence, held, waiting
            if not rests:
                return
            window = windows_for(np.array([len(r[2]) for r in rests], np.int64), capacity)
            filled = [0] * (int(window.max()) + 1)
            numbers: dict[int, int] = {}
            for i in np.argsort(window, kind="stable").tolist():
                doc, start, ids, total = rests[i]
                w = int(window[i])
                out.append((doc, start, len(ids), ids.tobytes(), total, sequence + numbers.setdefault(w, len(numbers)), filled[w]))
                filled[w] += len(ids)
            waiting += held
            sequence += len(numbers)
            rests.clear()
            held = 0

        def rows() -> pa.RecordBatch:
            nonlocal waiting
            kinds = (named, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            waiting = 0
            return got

        for b in batches:
            named = b.schema.field(0).type
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(bpe.encode(enc, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                total, doc = len(ids), doc.as_py()
                full = total // capacity * capacity
                for at in range(0, full, capacity):
                    out.append((doc, at, capacity, ids[at : at + capacity].tobytes(), total, sequence, 0))
                    sequence += 1
                waiting += full
                for at in range(full, total, most):
                    rests.append((doc, at, ids[at : at + most], total))
                held += total - full
                if held >= group * capacity:
                    close()
                if waiting >= 1 << 20:
                    yield rows()
        close()
        if out:
            yield rows()

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op6_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens, with a digest of each piece's ids."""
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
