"""Exact deduplication by Grace hashing.

Each task runs a hybrid Grace hash join of its records with themselves: an open-addressing table compares complete
contents; records that no longer fit go to spill files by the next bits of their digest, and each file is treated likewise,
recursively. Copies of a content that is in the table never spill, so a hot content costs one entry. This happens twice: within
every input partition (so that at most one record a partition and content is shuffled) and then within every partition of digests.

Null and empty texts are one class (empty content). Rows that share a doc_id are separate rows of a class; kept is true for rows with the id and the
length of the row that stays, so for more than one only where such rows repeat (drop_copies then keeps one of them). A null doc_id sorts last; any bigint
is an id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name

_SPACE = b" \t\n\x0b\x0c\r"
FANOUT = 16
#: The sixteen steps of four bits of the first half of a digest: contents equal in all of these are as good as never met.
LAST_LEVEL = 15


class OpenTable:
    """Open addressing with linear probing; entries hold complete contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.entries: list[list] = []  # digest, content, rows, chars, doc_id
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """Slot, and the entry there (-1: free)."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (e := int(self.slots[at])) >= 0:
            if self.entries[e][0] == digest:
                if self.entries[e][1] != content:
                    raise ValueError(f"two contents share the digest {digest.hex()}")
                return at, e
            at = (at + 1) & mask
        return at, -1

    def add(self, slot: int, record: list) -> None:
        self.slots[slot] = len(self.entries)
        self.entries.append(record)
        self.bytes += len(record[1]) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for k, e in enumerate(self.entries):
                mask, at = len(self.slots) - 1, int.from_bytes(e[0][8:16], "little")
                at &= mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def _order(r: list) -> tuple:
    """The longest text stays, then the smallest id; null sorts last."""
    return -r[3], r[4] is None, r[4] or 0


def grace(records: Iterator[list], budget: int, level: int = 0) -> Iterator[list]:
    """Merge records [digest, content, rows, chars, doc_id] of equal content; memory stays near budget bytes of distinct content."""
    table, files, folder = OpenTable(), {}, None
    try:
        for r in records:
            slot, e = table.find(r[0], r[1])
            if e >= 0:
                old = table.entries[e]
                old[2] += r[2]
                if _order(r) < _order(old):
                    old[3:5] = r[3:5]
            elif table.bytes < budget or level > LAST_LEVEL:
                table.add(slot, r)
            else:  # the partition doesn't fit: spill by the next digest bits
                folder = folder or tempfile.TemporaryDirectory(prefix="grace-")
                k = int.from_bytes(r[0][:8], "big") >> (60 - 4 * level) & (FANOUT - 1)
                if k not in files:
                    files[k] = open(os.path.join(folder.name, str(k)), "w+b")
                pickle.dump(r, files[k], protocol=5)
        yield from table.entries
        del table
        for f in files.values():
            f.seek(0)
            yield from grace(_load(f), budget, level + 1)
            f.close()
    finally:
        for f in files.values():
            f.close()
        if folder:
            folder.cleanup()


def _load(f) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


_SCHEMA = "digest binary, content binary, n_rows long, n_chars long, doc_id long"


def _emit(entries: Iterator[list], with_content: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    names = ["digest", "content", "n_rows", "n_chars", "doc_id"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for e in entries:
        rows.append((e[0], e[1] if with_content else b"", e[2], e[3], e[4]))
        held += len(rows[-1][1]) + 100
        if held > 4 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def class_winners(docs: DataFrame, budget_bytes: int = 48 << 20) -> DataFrame:
    """(text_sha256, keep_id, keep_chars, group_size): a row for each distinct content."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[list]:
            for b in batches:
                for i in range(b.num_rows):
                    raw = b.column(1)[i].as_py() or ""
                    content = raw.encode().translate(None, _SPACE)
                    doc_id = b.column(0)[i].as_py()
                    yield [hashlib.sha256(content).digest(), content, 1, len(raw), doc_id]

        yield from _emit(grace(records(), budget_bytes), True)

    def overall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(grace((list(r.values()) for b in batches for r in b.to_pylist()), budget_bytes), False)

    reps = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(local, _SCHEMA)
    merged = reps.repartition("digest").mapInArrow(overall, _SCHEMA)
    return merged.select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("n_rows").alias("group_size"))


def content_sha(text: str = "text"):
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE_CLASS + "+", ""), 256)


def _chars(text: str = "text"):
    return F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")


def exact_dedup(docs: DataFrame, budget_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    members = docs.select("doc_id", content_sha().alias("text_sha256"), _chars().alias("n_chars"))
    out = members.join(class_winners(docs, budget_bytes), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, budget_bytes: int = 48 << 20) -> DataFrame:
    """The rows of docs that stay, all columns unchanged, whatever their names. Rows that repeat one doc_id with equal content count as copies: one stays."""
    sha, keep, chars, id_, n = (free_name(docs, c) for c in ("sha_", "keep_", "keep_chars_", "id_", "n_"))
    winners = class_winners(docs, budget_bytes).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("keep_chars").alias(chars))
    own = docs.withColumns({sha: content_sha(), id_: F.col("doc_id").cast("long"), n: _chars()})
    kept = own.join(winners, sha).where(F.col(id_).eqNullSafe(F.col(keep)) & (F.col(n) == F.col(chars)))
    return kept.dropDuplicates([sha]).drop(sha, keep, chars, id_, n)


QUERY = lambda spark, sf_dir: exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
