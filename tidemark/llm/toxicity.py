"""Toxicity by two class-conditional Kneser-Ney models.

Each class has a character model of ORDER symbols inside words: the highest order is discounted on the class's own counts and
interpolated with lower orders whose continuation counts are pooled over both classes. So an expression that neither class knows
gets the same backoff probability from both and says nothing. The logarithms of the two likelihoods of a text are compared per word
(words whose difference is within NOISE nats of zero count as undecided, and PRIOR_WORDS undecided words are added to each text, since sampling noise
is as large), and a logistic curve, fitted on a fold of its own, turns the difference into a score.

Fitting reads a bounded sample (at most MAX_DOCS labelled documents of a class, the smallest hashes of doc_id first, with all their words, and MAX_DOCS for
the curve) and happens in one task of an executor; the model that is broadcast is bounded by the words of that sample. Scoring reads every whole text.
Only labels whose crc32(doc_id as text) modulo 5 is not 0 are learned from: 1 to 3 for the counts, 4 for the curve. Null and empty texts have difference zero
and get the curve's value there. Without labels of both classes every score is the smoothed share of toxic labels. Repeated labels of a document: the largest
holds. Null labels and labels of a null doc_id say nothing; rows with a null doc_id are scored and not held out. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

ORDER = 6
DISCOUNT = 0.75
MAX_DOCS = 4000
NOISE = 2.0
PRIOR_WORDS = 10
CACHE_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\W_]+")
_START, _END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols (n, order) of each prediction, and start and number of predictions by word."""
    pad = _START * (order - 1)
    codes = np.frombuffer("".join([pad + w + _END for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = np.array([len(w) + 1 for w in words], dtype=np.int64)
    first = np.cumsum(n + order - 1) - (n + order - 1)
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return codes, place, n


def _hash(codes: np.ndarray, place: np.ndarray, start: int, length: int) -> np.ndarray:
    h = np.full(len(place), length, dtype=np.uint64)
    for k in range(start, start + length):
        h = (h ^ codes[place + k]) * np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return h


def _sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, weights=weights, minlength=len(unique))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of wanted in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    grams: np.ndarray  # hashes of the n-grams that a class knows, and their difference of log probabilities
    gram_value: np.ndarray
    contexts: np.ndarray  # hashes of the contexts that a class knows, and the difference of log backoff weights
    context_value: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        """Difference of the log likelihoods of each word."""
        codes, place, n = _grams(words)
        gram, context = _hash(codes, place, 0, ORDER), _hash(codes, place, 0, ORDER - 1)
        at, known = _find(self.grams, gram)
        value = np.zeros(len(place))
        value[known] = self.gram_value[at[known]]
        rest = np.flatnonzero(~known)
        at, seen = _find(self.contexts, context[rest])
        value[rest[seen]] = self.context_value[at[seen]]
        total = np.add.reduceat(value, np.cumsum(n) - n)
        return np.sign(total) * np.maximum(np.abs(total) - NOISE, 0)

    def key(self) -> str:
        """Names what words() depends on."""
        whole = hashlib.sha1()
        for x in (self.grams, self.gram_value, self.contexts, self.context_value):
            whole.update(len(x).to_bytes(8, "little") + x.tobytes())
        return whole.hexdigest()

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.intercept, -500, 500)))


def estimates(words: list[str], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """n-grams, contexts (hashes), and for each class the log probability of each n-gram and the log backoff weight of each context.

    counts: for each class, how many documents hold each word.
    """
    codes, place, n = _grams(words)
    gram = _hash(codes, place, 0, ORDER)
    keys, first, where = np.unique(gram, return_index=True, return_inverse=True)
    del gram
    count = [np.bincount(where, weights=np.repeat(c.astype(float), n), minlength=len(keys)) for c in counts]
    del where
    # shared lower orders: continuation counts, that is distinct longer n-grams of either class, from the shortest up
    below = np.full(len(keys), 1 / max(1, len(np.unique(codes))))
    sub_place = place[first]
    for length in range(1, ORDER):
        longer = np.unique(_hash(codes, place, ORDER - length - 1, length + 1), return_index=True)[1]
        own = _hash(codes, place[longer], ORDER - length, length)
        context = _hash(codes, place[longer], ORDER - length, length - 1)
        g, continuations = _sum_by(own, np.ones(len(own)))
        c, total = _sum_by(context, np.ones(len(context)))
        kinds, kind_first = np.unique(own, return_index=True)
        _, distinct = _sum_by(context[kind_first], np.ones(len(kinds)))
        at, _ = _find(g, _hash(codes, sub_place, ORDER - length, length))
        at_c, _ = _find(c, _hash(codes, sub_place, ORDER - length, length - 1))
        below = (np.maximum(continuations[at] - DISCOUNT, 0) + DISCOUNT * distinct[at_c] * below) / total[at_c]
    context = _hash(codes, sub_place, 0, ORDER - 1)
    contexts = np.unique(context)
    at, _ = _find(contexts, context)
    log_gram, log_back = [], []
    for c in count:
        total = np.bincount(at, weights=c, minlength=len(contexts))
        kinds = np.bincount(at, weights=(c > 0).astype(float), minlength=len(contexts))
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        log_gram.append(np.log(np.where(total[at] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1), 0) + back[at] * below))
        log_back.append(np.log(back))
    return keys, contexts, log_gram, log_back


def fit_counts(words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """toxic, ordinary: number of documents of the class that hold each word."""
    keys, contexts, log_gram, log_back = estimates(words, [toxic, ordinary])
    return Model(keys, (log_gram[0] - log_gram[1]).astype(np.float32), contexts, (log_back[0] - log_back[1]).astype(np.float32))


def fit_curve(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a weak pull to zero."""
    x = np.stack([mean, np.ones_like(mean)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * beta)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0)), float(beta[1])


def _mean(model: Model, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Difference of log likelihoods per word, and number of words, of each text."""
    split = [words_of(t) for t in texts]
    new = list({w for ws in split for w in ws if w not in cache})
    extra = dict(zip(new, model.words(new).tolist())) if new else {}
    if len(cache) + len(extra) <= CACHE_WORDS:
        cache.update(extra)
        extra = {}
    get = cache.__getitem__ if not extra else lambda w: cache[w] if w in cache else extra[w]
    n = np.array([len(ws) for ws in split], dtype=np.int64)
    total = np.array([sum(map(get, ws)) for ws in split], dtype=float)
    return total / (n + PRIOR_WORDS), n


def _scores(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns of docs, and mean (difference per word), n_words."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), model.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(("toxicity", key), dict)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                mean, n = _mean(held.value, b.column(0).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(mean), pa.array(n)], names=[*columns, "mean", "n_words"])

    chosen = docs.select(F.col("text").cast("string").alias("text"), *columns)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{kind}, mean double, n_words long")


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from the labelled rows of docs that are not held out."""
    given = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mixed = F.xxhash64("doc_id")

    def chosen(rule, n: int):
        """Ids first, so that sorting moves no texts."""
        ids = given.where(rule).orderBy(mixed, "doc_id").limit(n)
        return own.join(F.broadcast(ids), "doc_id")  # at most n ids

    sample = chosen((fold() != 4) & (F.col("toxic") == 1), max_docs).unionByName(chosen((fold() != 4) & (F.col("toxic") == 0), max_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1)):
                found[toxic.as_py()].update(set(words_of(text.as_py())))  # documents, so that one that repeats itself has no more say
        for toxic, c in enumerate(found):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "toxic", "n"])

    counted = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "word string, toxic int, n long")
    by_word = counted.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))

    def model_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, by_word_schema)
        t, o = rows["t"].to_numpy(), rows["o"].to_numpy()
        if t.sum() and o.sum():
            m = fit_counts(rows["word"].to_pylist(), t, o)
            parts = [m.grams.astype("<u8"), m.gram_value.astype("<f4"), m.contexts.astype("<u8"), m.context_value.astype("<f4")]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["grams", "gram_value", "contexts", "context_value"])

    by_word_schema = pa.schema([("word", pa.string()), ("t", pa.int64()), ("o", pa.int64())])
    found = by_word.select("word", F.col("t").cast("long"), F.col("o").cast("long")).coalesce(1).mapInArrow(model_of, "grams binary, gram_value binary, contexts binary, context_value binary").collect()
    if not found:
        got = given.agg(F.sum("toxic"), F.count(F.lit(1))).first()
        share = ((got[0] or 0) + 0.5) / (got[1] + 1)
        none = np.array([], dtype=np.uint64)
        return Model(none, none.astype(np.float32), none, none.astype(np.float32), 0.0, float(np.log(share / (1 - share))))
    model = Model(*(np.frombuffer(x, kind) for x, kind in zip(found[0], ("<u8", "<f4", "<u8", "<f4"))))
    curve = _scores(chosen(fold() == 4, max_docs), model, ["toxic"]).select("mean", "toxic").toArrow()
    if curve.num_rows:
        model.slope, model.intercept = fit_curve(curve["mean"].to_numpy(), curve["toxic"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words: a row for each row of docs."""
    model = fit(docs, labels, max_docs)
    found = _scores(docs, model, ["doc_id"])
    value = F.lit(1.0) / (1 + F.exp(-(F.lit(model.slope) * F.col("mean") + model.intercept)))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "n_words")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns unchanged. Clean documents stay, whatever their label."""
    model = fit(docs, labels, max_docs)
    # a text is scored where it lies, with its row: nothing is joined back by id
    names = [c for c in docs.columns if c != "text"]
    held, key = docs.sparkSession.sparkContext.broadcast(model), model.key()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(("toxicity", key), dict)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                mean, _ = _mean(held.value, b.column(0).to_pylist(), cache)
                yield b.filter(pa.array(held.value.score(mean) < 0.5))

    schema = docs.select("text", *names).schema
    return docs.select("text", *names).mapInArrow(keep, schema).select(*docs.columns)


QUERY = lambda spark, sf_dir: score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
