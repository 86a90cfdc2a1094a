"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed in blocks by seeds: a window of LENGTH words is anchored at its smallest hash of
SEED words, so equal windows share seed and offset, and about one word in fifteen carries a seed. The consecutive windows with one
anchor form a run. Runs with a seed that occurs elsewhere are parsed greedily against the index: a run whose whole cover occurs
elsewhere is a factor as it is; at the boundaries of factors (the run's cover occurs nowhere else, its seed does) each window is looked
up on its own, among the boundary windows and one representative of every factor with that seed. Adjoining factors that continue in the same
reference become one. Every covered word goes; no occurrence is spared. Windows are judged on the input only.

Contents are compared by keys of all their words, made of two independent 64-bit hashes a word (halves of its XXH3-128): a window by 128 bits, a cover
by 64 bits of the one among the covers whose seeds have equal 64 bits of the other. Hot passages are pre-aggregated: of a cover that occurs in any number
of documents, one representative is expanded. Rows are told apart by a number of their own, written with them, so null ids and repeated ids are rows like
any other. Null and empty texts have no words; texts shorter than LENGTH words keep all. Repeated rows are copies of each other and lose their windows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, forget, materialise

LENGTH = 35
SEED = 8
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[tuple[int, int], np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2**64."""
    size = 1 << max(10, n.bit_length())
    for b in (base, pow(base, -1, 1 << 64)):
        if (b, 0) not in _powers or len(_powers[b, 0]) < size:
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[b, 0] = np.multiply.accumulate(p)
    return _powers[base, 0], _powers[pow(base, -1, 1 << 64), 0]


class Ranges:
    """Hashes of any range of a sequence of 64-bit words, from one prefix sum of word * base**position."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        up, self.down = _power(base, len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word of UTF-8 bytes."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, re.findall(WORD_CLASS, text))), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each width consecutive values."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = f(out[: len(out) - have], out[have:]), 2 * have
    return f(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs(words: np.ndarray, others: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """start, number of windows, seed value (of others), key of the whole cover (of words): of each run of windows with one anchor."""
    n = len(words)
    if n < length:
        empty = np.array([], dtype=np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    first = np.arange(n - seed + 1)
    grams = Ranges(others, _B2).of(first, first + seed)
    width = length - seed + 1
    least = _slide(grams, width, np.minimum)
    # the leftmost place of the least hash: from the right, the nearest place at or after p that equals least[p]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    group = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    wanted = group[np.searchsorted(ranked, least)] * n + np.arange(len(least))
    place = order[np.searchsorted(group * n + order, wanted)]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([cut, [len(place)]]))
    cover = Ranges(words, _B1).of(cut, cut + count + length - 1)
    offset = (place[cut] - cut).astype(np.uint64)
    return cut, count, least[cut], _mix(cover ^ _mix(offset * np.uint64(_B2) + count.astype(np.uint64)))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _all_runs(docs: DataFrame, length: int) -> DataFrame:
    names = ["_row", "start", "windows", "seed", "cover"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                start, windows, seed, cover = runs(*word_hashes((text.as_py() or "").encode()), length)
                for c, x in zip(out, (np.full(len(start), row, dtype=np.int64), start, windows, seed, cover)):
                    c.append(x)
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([_i64(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), _i64(cols[3]), _i64(cols[4])], names=names)

    return docs.select("_row", "text").mapInArrow(find, "_row long, start int, windows int, seed long, cover long")


def _boundary_windows(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """asked: _row, spans array of (start, windows, wanted). Key, _row, start, wanted of each of their windows."""
    names = ["k1", "k2", "_row", "start", "wanted"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for row, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words, others = word_hashes((text.as_py() or "").encode())
                p = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in spans])
                wanted = np.concatenate([np.full(s["windows"], s["wanted"]) for s in spans])
                for c, x in zip(out, (Ranges(words, _B1).of(p, p + length), Ranges(others, _B2).of(p, p + length), np.full(len(p), row, dtype=np.int64), p, wanted)):
                    c.append(x)
            if out[0]:
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([_i64(c[0]), _i64(c[1]), _i64(c[2]), pa.array(c[3].astype(np.int32)), pa.array(c[4].astype(bool))], names=names)

    both = docs.join(asked, "_row").select("_row", "text", "spans")
    return both.mapInArrow(expand, "k1 long, k2 long, _row long, start int, wanted boolean")


def factors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: _row, text; written. _row, start, windows, ref_row, ref_start: windows [start, start + windows) of _row occur at ref_start of ref_row."""
    docs = docs.select("_row", "text").where("text is not null")
    every = materialise(_all_runs(docs, length), "rlz-runs")
    # written, so that both sides of the joins by seed are plain exchanges, whose hot partitions are split
    shared = materialise(every.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "rlz-shared")
    known = materialise(every.join(shared, "seed", "left_semi"), "rlz-known")
    forget(every, shared)
    place = F.struct("_row", "start")
    covers = materialise(known.groupBy("seed", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "rlz-covers")
    split = materialise(covers.where("n = 1").select("seed").distinct().withColumn("split", F.lit(True)), "rlz-split")
    index = materialise(covers.join(split, "seed", "left"), "rlz-index")
    forget(covers, split)
    parsed = known.join(index, ["seed", "cover"])
    ref = F.when(F.col("first") == place, F.col("last")).otherwise(F.col("first"))
    parsed = materialise(parsed.select("_row", "start", "windows", (F.col("n") > 1).alias("whole"), (F.col("split") & (F.col("first") == place)).alias("asked"), F.when(F.col("n") > 1, ref).alias("ref")), "rlz-parsed")
    forget(known, index)
    spans = parsed.where("asked").groupBy("_row").agg(F.collect_list(F.struct("start", "windows", (~F.col("whole")).alias("wanted"))).alias("spans"))
    windows = materialise(_boundary_windows(docs, spans, length), "rlz-windows")
    found = windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1")
    hits = windows.where("wanted").join(found, ["k1", "k2"]).select("_row", "start", F.lit(1).alias("windows"), ref.alias("ref"))
    out = parsed.where("whole").select("_row", "start", "windows", "ref").unionByName(hits)
    out = materialise(out.select("_row", "start", "windows", F.col("ref._row").alias("ref_row"), F.col("ref.start").alias("ref_start")), "rlz-factors")
    forget(parsed, windows)
    return out


def greedy(spans: list[dict]) -> list[dict]:
    """Join factors of one document that continue in the same reference, left to right."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] == out[-1]["start"] + out[-1]["windows"] and s["ref_row"] == out[-1]["ref_row"] and s["ref_start"] == out[-1]["ref_start"] + out[-1]["windows"]:
            out[-1]["windows"] += s["windows"]
        else:
            out.append(dict(s))
    return out


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, doc_id, n_words, n_removed, kept (text), spans (first word, words, ref_row, ref_start): a row for each row of docs.

    row is the number that ref_row names.
    """
    docs = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rlz-docs")
    found = factors(docs, length)
    by_doc = found.groupBy("_row").agg(F.collect_list(F.struct("start", "windows", "ref_row", "ref_start")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_row", pa.int64()), ("ref_start", pa.int64())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                rows = []
                for row, doc_id, text, spans in zip(*(b.column(c).to_pylist() for c in range(4))):
                    words = re.findall(WORD_CLASS, (text or "").encode())
                    joined = greedy(spans or [])
                    gone = np.zeros(len(words), dtype=bool)
                    for s in joined:
                        gone[s["start"] : s["start"] + s["windows"] + length - 1] = True
                    removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed else words)
                    rows.append((row, doc_id, len(words), removed, kept.decode(), [{"start": s["start"], "words": s["windows"] + length - 1, "ref_row": s["ref_row"], "ref_start": s["ref_start"]} for s in joined]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind))], names=["row", "doc_id", "n_words", "n_removed", "kept", "spans"])

    both = docs.join(by_doc, "_row", "left").select("_row", "doc_id", "text", "spans")
    return both.mapInArrow(remove, "row long, doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,words:long,ref_row:long,ref_start:long>>")


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERY = lambda spark, sf_dir: digest(substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))
