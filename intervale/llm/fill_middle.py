"""Fill-in-the-middle: documents cut into prefix, middle and suffix, found through a sparse index of checkpoints.

A text's units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched from the left: words with the white
space before them, and what white space ends the text.  One scan counts them, a few ten thousand bytes at a time, and keeps
a checkpoint after every ``EVERY`` units: how many units, bytes and code points lie before it.  To find a cut, a binary search
picks the last checkpoint before it and a short scan goes on from there, so that the units themselves are never listed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import kind, table
from intervale.llm.words import SPACE

EVERY, SCAN, OUT = 64, 1 << 16, 1 << 23
#: What begins the prefix, the suffix and the middle (fixed values); texts that hold one of them stay plain.
MARKS = (b"<P>", b"<S>", b"<M>")


def _word_ends(text: np.ndarray, at: int, to: int) -> np.ndarray:
    """Where words end (exclusive) among the bytes ``at`` to ``to``."""
    blank = SPACE[text[at : to + 1]]
    if to >= len(text):
        blank = np.append(blank, True)
    return at + 1 + np.flatnonzero(~blank[:-1] & blank[1:])


def _starts(text: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (text & 0xC0) != 0x80


@dataclass
class Checkpoints:
    """A text's units and code points, and how many units, bytes and code points lie before each checkpoint."""

    text: bytes
    every: int = EVERY
    units: int = 0
    points: int = 0
    unit_at: list[int] = field(default_factory=lambda: [0])
    byte_at: list[int] = field(default_factory=lambda: [0])
    point_at: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        text = np.frombuffer(self.text, np.uint8)
        for at in range(0, len(text), SCAN):
            to = min(at + SCAN, len(text))
            ends = _word_ends(text, at, to)
            marked = ends[(-self.units - 1) % self.every :: self.every]
            before = np.cumsum(_starts(text[at:to]))
            if len(marked):
                first = self.units // self.every + 1
                self.unit_at += range(first * self.every, (first + len(marked)) * self.every, self.every)
                self.byte_at += marked.tolist()
                self.point_at += (self.points + before[marked - at - 1]).tolist()
            self.units += len(ends)
            self.points += int(before[-1])
        if len(text) and SPACE[text[-1]]:
            self.units += 1

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the unit of that number (from 0); all of them after the last."""
        if unit >= self.units:
            return len(self.text), self.points
        k = bisect_right(self.unit_at, unit) - 1
        left, at, points = unit - self.unit_at[k], self.byte_at[k], self.point_at[k]
        text = np.frombuffer(self.text, np.uint8)
        while left:
            to = min(at + 16 * self.every, len(text))
            ends = _word_ends(text, at, to)
            stop = int(ends[left - 1]) if len(ends) >= left else to
            points += int(_starts(text[at:stop]).sum())
            left, at = left - min(len(ends), left), stop
        return at, points


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4 of a document: the first four groups of 8 hexadecimal digits of the sha256 of seed, colon and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are cut, of these ``spm`` of 100 as suffix, prefix, middle and the others as prefix, suffix,
    middle; a hash of seed and id decides and draws both cuts.  Texts that are null, empty or hold a mark are plain, and plain
    ones have no prefix_chars and middle_chars.  Rows that repeat an id are cut by the same draws, each in its own text; a null id
    counts as empty.  Texts of any length are cut whole, with a checkpoint for every ``every`` units in memory.  An empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

        def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            n, form, prefix, middle, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names)

        for b in batches:
            h = np.stack([b.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)], 1).tolist()
            rows, first, held = [], 0, 0
            for i, (h1, h2, h3, h4) in enumerate(h):
                raw = b.column("text")[i].as_buffer()
                text = raw.to_pybytes() if raw else b""
                at = Checkpoints(text, every)
                if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
                    rows.append((at.units, "plain", None, None, text))
                else:
                    (i1, c1), (i2, c2) = (at.cut(u) for u in sorted((h1 % (at.units + 1), h2 % (at.units + 1))))
                    p, s, m = (mark + part for mark, part in zip(MARKS, (text[:i1], text[i2:], text[i1:i2]), strict=True))
                    form = "spm" if h4 % 100 < spm else "psm"
                    rows.append((at.units, form, c1, c2 - c1, s + p + m if form == "spm" else p + s + m))
                held += len(text)
                if held > OUT:
                    yield batch(b.column("doc_id").slice(first, len(rows)), rows)
                    rows, first, held = [], i + 1, 0
            if rows:
                yield batch(b.column("doc_id").slice(first, len(rows)), rows)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws(id_col, seed))
    return chosen.mapInArrow(run, f"doc_id {kind(chosen, 'doc_id')}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A mark begins and ends with characters that occur nowhere else in it, so parts never spell another."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, form, and digests of what it became and of what that gives back."""
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
n AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c1, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c2, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 AS plain FROM u),
p AS (SELECT *, array_to_string(units[1:c1], '') AS prefix, array_to_string(units[c1 + 1:c2], '') AS middle, array_to_string(units[c2 + 1:], '') AS suffix, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
