"""Fill-in-middle: a text cut into prefix, middle and suffix, put in another order between marks.

Texts lie in Arrow batches as UTF-8. A bit for every byte says whether a code point starts there; the bits are packed to words, with a directory of the ones
before each block of words. The ones in a text's range are its code points; select() of two ranks gives the bytes to cut at. Nothing is decoded.

A null text counts as empty; empty texts, and texts that hold a mark, stay as they are (plain). The cuts follow from the id alone, so repeated rows, and rows
that share an id and a text, give equal results; a null id counts as an empty one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Bytes of texts that one bit vector covers; a longer text has one of its own.
SLICE_BYTES = 4 << 20


class Boundaries:
    """Rank and select over the starts of code points in UTF-8 bytes."""

    def __init__(self, data: np.ndarray) -> None:
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        room = np.zeros(-(-(len(packed) + 1) // (8 * BLOCK)) * 8 * BLOCK, dtype=np.uint8)
        room[: len(packed)] = packed
        self.words = room.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points start before byte at."""
        word = at >> 6
        block = word // BLOCK
        ones = np.bitwise_count(self.words.reshape(-1, BLOCK)[block])
        inside = (ones * (np.arange(BLOCK) < (word % BLOCK)[:, None])).sum(axis=1, dtype=np.int64)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + inside + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte at which the code point number k (from 0) starts; k must be below the number of all."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]), axis=1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, upto[np.arange(len(k)), word - 1], 0)
        found = self.words[block * BLOCK + word]
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * BLOCK + word) * 64 + np.argmax(np.cumsum(bits, axis=1) == left[:, None] + 1, axis=1)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, the code points before the two cuts, and the bytes of the cuts, of each text data[start:end]."""
    b = Boundaries(data)
    first = b.rank(starts)
    n = b.rank(ends) - first
    x, y = h1 % (n + 1), h2 % (n + 1)
    lo, hi = np.minimum(x, y), np.maximum(x, y)

    def at(r: np.ndarray) -> np.ndarray:
        out, inner = ends.copy(), r < n
        out[inner] = b.select((first + r)[inner])
        return out

    return n, lo, hi, at(lo), at(hi)


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output: a row for each row of docs."""
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1)
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
        h = [batch.column(2 + k).to_numpy() for k in range(4)]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
            own, base = slice(lo, hi), offsets[lo]
            n, a, b, at_a, at_b = cuts(data[base : offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base, h[0][own], h[1][own])
            forms, outputs = [], []
            for k in range(hi - lo):
                raw = data[offsets[lo + k] : offsets[lo + k + 1]].tobytes()
                form = "plain" if not raw or h[2][lo + k] % 100 >= 100 - plain_percent or any(m in raw for m in marks) else "spm" if h[3][lo + k] % 100 < spm_percent else "psm"
                i, j = (int(x) - int(offsets[lo + k] - base) for x in (at_a[k], at_b[k]))
                p, m, s = raw[:i], raw[i:j], raw[j:]
                forms.append(form)
                outputs.append(raw if form == "plain" else b"".join([marks[0], p, marks[1], s, marks[2], m] if form == "psm" else [marks[1], s, marks[0], p, marks[2], m]))
            cut = np.array([f != "plain" for f in forms])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(forms), pa.array(a, mask=~cut), pa.array(b - a, mask=~cut), pa.array(outputs, pa.binary())], names=names)
            lo = hi

    sha = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *numbers)
    return own.mapInArrow(lambda batches: (out for b in batches for out in parts(b)), _SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: no text that was cut holds a mark, and no mark can begin inside another."""

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))).when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERY = lambda spark, sf_dir: digest(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS pre, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(t, greatest(x, y) + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
