"""Secrets in texts: fixed patterns, and strings that a Markov model of random characters explains better than one of ordinary identifiers.

Two models of order 2 count which character follows which two others, in random strings and in ordinary identifiers. A candidate, a run of 16 or more characters
of [A-Za-z0-9+/_=-] between characters that are no word characters, is a secret if its log-likelihood under the random model exceeds that under the
ordinary one by a threshold. Both models back off: an order's estimate is mixed with the next lower one's, down to equal chances.

The models are trained from labelled samples (value, label, n: how often it counts). By default these come from the table itself: what the fixed patterns
find is random, words of 8 characters and more beside it are ordinary, all rows of the table counted; so that other alphabets are known as well, seeded
random strings are added (MADE of them). Counts are summed by Spark; the model has at most 2 x 66**3 numbers whatever the input, and goes out with the tasks.

Positions are code points, ends exclusive. A null text counts as empty and has no spans. Repeated rows and ids are scored alike, row by row. An empty table gives
an empty result. Other columns are not read. Runs of any length are one candidate; a model's span never overlaps a pattern's.
"""

from __future__ import annotations

import collections
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds in their order, their patterns, and the least length of what is kept ---
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as runs of [0-9a-f]+ of which those of 16 and more are kept
LEAST = {"assign": 12, "access": 18}
# --- end of fixed values ---
CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: A secret is taken to be so many times rarer than an ordinary run (natural logarithm).
THRESHOLD = 10.0
#: Seeded random strings among the samples, by alphabets of 32, 62 and 64 characters and of hexadecimal digits.
MADE = 4000
#: How many observations the next lower order's estimate stands for.
PRIOR = (40.0, 20.0)
ALPHABET = "\n" + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
_CODE = np.zeros(256, dtype=np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(SIZE)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind; sorted by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _values(text: str, base: list[tuple[str, int, int]]) -> Iterator[str]:
    for kind, lo, hi in base:
        yield ASSIGN.match(text, lo)[2] if kind == "assign" else text[lo:hi]


def _apart(spans: Iterator[tuple[int, int]], base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that overlap none of base; both sorted by start."""
    at, reach = 0, 0
    for lo, hi in spans:
        while at < len(base) and base[at][1] < hi:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= lo:
            yield lo, hi


def samples_of(docs: DataFrame) -> DataFrame:
    """(value, label, n) from all texts: what the patterns find (1), words beside it (0). Counted within each batch, so that frequent words travel once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: collections.Counter = collections.Counter()
            for text in b.column(0):
                t = text.as_py() or ""
                base = base_spans(t)
                counts.update((v, 1) for v in _values(t, base))
                counts.update((t[lo:hi], 0) for lo, hi in _apart((m.span() for m in WORD.finditer(t)), base))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in counts]), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["value", "label", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "value string, label int, n long")


def made_samples(n: int = MADE, seed: int = 7) -> list[str]:
    """Random strings of 16 to 64 characters."""
    rng = random.Random(seed)
    alphabets = [ALPHABET[1:27] + "234567", ALPHABET[1:63], ALPHABET[1:65], "0123456789abcdef"]
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64))) for k in range(n)]


def _grams(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the triples of each value, which begins behind two boundaries and ends with one; and where values begin and end among them."""
    raw = np.frombuffer("".join("\n\n" + v + "\n" for v in values).encode("ascii", "replace"), dtype=np.uint8)
    c = _CODE[raw]
    lengths = np.array([len(v) + 1 for v in values], dtype=np.int64)
    codes = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    starts = np.cumsum(lengths + 2) - lengths - 2
    keep = np.ones(len(codes), dtype=bool)
    keep[np.concatenate([starts[1:] - 1, starts[1:] - 2])] = False  # triples across two values
    ends = np.cumsum(lengths)
    return codes[keep], ends - lengths, lengths


def _log_model(triples: np.ndarray) -> np.ndarray:
    """Logarithms of the chance of a character after two others, from counts of shape (SIZE, SIZE, SIZE)."""
    single, pair = triples.sum(axis=(0, 1)), triples.sum(axis=0)
    p = (single + 1.0) / (single.sum() + SIZE)
    p = (pair + PRIOR[0] * p) / (pair.sum(axis=1, keepdims=True) + PRIOR[0])
    return np.log((triples + PRIOR[1] * p) / (triples.sum(axis=2, keepdims=True) + PRIOR[1]))


class Models:
    """The logarithm of the ratio of both models for every triple."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray) -> None:
        shape = (SIZE, SIZE, SIZE)
        self.ratio = (_log_model(random_counts.reshape(shape)) - _log_model(ordinary_counts.reshape(shape))).ravel().astype(np.float32)

    def scores(self, values: list[str]) -> np.ndarray:
        """Log-likelihood ratios: above zero, random is likelier."""
        if not values:
            return np.zeros(0)
        codes, starts, _ = _grams(values)
        return np.add.reduceat(self.ratio[codes].astype(np.float64), starts)


def fit(samples: DataFrame) -> Models:
    """From (value, label, n). Triples are counted in the tasks and summed by Spark; at most 2 x SIZE**3 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE**3), dtype=np.int64)
        for b in batches:
            values, labels, n = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for label in (0, 1):
                own = [k for k in np.flatnonzero(labels == label).tolist() if values[k]]
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    codes, _, lengths = _grams([values[k] for k in part])
                    np.add.at(sums[label], codes, np.repeat(n[part], lengths))
        for label in (0, 1):
            at = np.flatnonzero(sums[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, dtype=np.int32)), pa.array(at), pa.array(sums[label][at])], names=["label", "code", "n"])

    summed = samples.where("value is not null and label in (0, 1) and n > 0").select("value", "label", "n").mapInArrow(run, "label int, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, SIZE**3))
    counts[summed.column("label").to_numpy(), summed.column("code").to_numpy()] = summed.column("n").to_numpy()
    return Models(counts[1], counts[0])


def default_models(docs: DataFrame, made: int = MADE) -> Models:
    extra = docs.sparkSession.createDataFrame([(v, 1, 1) for v in made_samples(made)], "value string, label int, n long")
    return fit(samples_of(docs).unionByName(extra))


_SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan(docs: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (those and the models', by start, then kind)."""
    ratio = docs.sparkSession.sparkContext.broadcast(models.ratio)  # SIZE**3 numbers
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models.__new__(Models)
        own.ratio = ratio.value
        for b in batches:
            base, asked, values = [], [], []
            for k, text in enumerate(b.column(1)):
                t = text.as_py() or ""
                base.append(base_spans(t))
                for lo, hi in _apart((m.span() for m in CANDIDATE.finditer(t)), base[-1]):
                    asked.append((k, lo, hi))
                    values.append(t[lo:hi])
            every = [list(s) for s in base]
            for (k, lo, hi), s in zip(asked, own.scores(values)):
                if s > threshold:
                    every[k].append(("model", lo, hi))
            every = [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in every]
            cells = [pa.array([[{"kind": k, "start": lo, "stop": hi} for k, lo, hi in s] for s in rows], span) for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], names=["doc_id", "base", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(docs, default_models(docs)))


QUERY = query
