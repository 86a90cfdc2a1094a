"""Approximate nearest neighbours by multiprobe p-stable hashing.

Equal vectors are one point, which keeps the smallest ids that share it, so copies cost one entry. Every point lies in one bucket of each of TABLES
tables; a table has functions floor((a.x + b) / width) of SLOTS values with Gaussian a, as many as leave about BUCKET points in a bucket (at most
MAX_HASHES), so buckets get narrower as rows grow. Points are shuffled to their buckets and lie there in blocks; a bucket of more than CELL points, as
counted, is cut into several blocks, so that none is capped or gathered in one place. Each query computes once which buckets it visits: its own and perturbed
ones in the order of their estimated success, which is the probability, under the Gaussian of a pair at the distance of a true neighbour, that the
neighbour's projections fall there, until these add up to what all tables together need for RECALL. Queries meet blocks by bucket. The tables'
candidates are merged and reranked by exact distances in double precision.

The neighbour distance is fitted on a bounded sample (SAMPLE points, smallest hashes first), as are centre and width; what a query visits follows from
them. Vectors of different lengths are searched apart, length by length. Null and zero vectors, those that hold null or non-finite components and rows without
an id take no part. Repeated ids are rows of their own, as queries and as candidates; a query skips all rows of its own id. Ties go to the smaller id.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import forget, materialise

TABLES = 2
SLOTS = 3  # values of a function; the outer ones are open
BUCKET = 256
MAX_HASHES = 10
CELL = 4096
QUERY_CELL = 512
SAMPLE = 4096
RECALL = 0.94
K = 10
_KEY = {"t": "int", "bucket": "int", "cell": "int"}


@dataclass
class Hashing:
    """Functions of all tables (dim x tables * hashes), their offsets and width. The projection of a query's neighbour is taken
    as Gaussian, with pull times the query's as its mean and sigma as its standard deviation."""

    hashes: int
    centre: np.ndarray
    a: np.ndarray
    b: np.ndarray
    width: float
    pull: float
    sigma: float
    need: float  # what the visited buckets of one table have to add up to

    @property
    def buckets(self) -> int:
        return SLOTS**self.hashes

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket number of each vector in each table."""
        slot = np.floor(((x - self.centre) @ self.a + self.b) / self.width).astype(np.int64) + SLOTS // 2
        return np.clip(slot, 0, SLOTS - 1).reshape(len(x), TABLES, self.hashes) @ (SLOTS ** np.arange(self.hashes))

    def success(self, queries: np.ndarray, table: int) -> np.ndarray:
        """Of each query and bucket of a table, the probability that a neighbour lies there."""
        own = slice(table * self.hashes, (table + 1) * self.hashes)
        at = (self.pull * (queries - self.centre) @ self.a[:, own] + self.b[own]) / self.width
        edges = np.arange(SLOTS + 1, dtype=float) - SLOTS // 2
        edges[0], edges[-1] = -1e12, 1e12
        p = np.diff(_normal_cdf((edges - at[..., None]) * self.width / self.sigma), axis=2)
        out = np.ones((len(queries), 1))
        for j in range(self.hashes):
            out = (p[:, j, :, None] * out[:, None, :]).reshape(len(queries), -1)
        return out

    def probes(self, queries: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each query the buckets of a table that it visits, best first."""
        step = max(1, (1 << 21) // self.buckets)
        for lo in range(0, len(queries), step):
            success = self.success(queries[lo : lo + step], table)
            order = np.argsort(-success, axis=1, kind="stable")
            n = 1 + (np.cumsum(np.take_along_axis(success, order, 1), axis=1) < self.need).sum(axis=1)
            yield from (o[:k] for o, k in zip(order, n.tolist()))


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-np.minimum(x * x, 1400) / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def fit(sample: np.ndarray, points: int, k: int = K, seed: int = 7, recall: float = RECALL) -> Hashing:
    """points: how many there are, since neighbours get nearer as they grow in number."""
    rng = np.random.default_rng(seed)
    hashes = min(MAX_HASHES, max(1, round(math.log(max(points, 1) / BUCKET, SLOTS))))
    centre = sample.mean(axis=0)
    own = sample - centre
    spread = float(np.sqrt((own**2).sum(axis=1).mean())) or 1.0
    width = spread * 0.9
    a = rng.standard_normal((sample.shape[1], TABLES * hashes))
    b = rng.uniform(0, width, TABLES * hashes)
    some = own[:256]
    squared = (some**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None] - 2 * some @ own.T
    # the k-th of all neighbours lies at the quantile k / points; a sample shows it no nearer than its first other point
    at = min(len(own) - 1, max(1, math.ceil(k * len(own) / max(points, 1))))
    y = own[np.argsort(squared, axis=1, kind="stable")[:, at]]
    pull = float((y * some).sum() / max((some * some).sum(), 1e-300))
    sigma = float(np.sqrt(((y - pull * some) ** 2).sum(axis=1).mean()))
    return Hashing(hashes, centre, a, b, width, pull, max(sigma, 1e-9 * spread), 1 - (1 - recall) ** (1 / TABLES))


def usable(vectors: DataFrame) -> DataFrame:
    """id, dim and x (little-endian numbers) of the vectors that take part."""
    kind = vectors.schema["embedding"].dataType.elementType
    x = F.col("embedding").cast("array<float>" if isinstance(kind, FloatType) else "array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(x, lambda v: v != 0)).select(F.col("vec_id").cast("long").alias("id"), F.size(x).alias("dim"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            raw, end = flat.tobytes(), (flat.itemsize * np.cumsum(b.column(1).to_numpy())).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[s:e] for s, e in zip([0, *end], end)], pa.binary())], names=["id", "dim", "x"])

    return rows.mapInArrow(run, "id long, dim int, x binary")


def _numbers(raw: list[bytes], dim: int) -> np.ndarray:
    joined = b"".join(raw)
    return np.frombuffer(joined, "<f8" if len(joined) == 8 * dim * len(raw) else "<f4").reshape(-1, dim).astype(float)


def _packed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows sorted by t, bucket, cell in each partition: one row of lists for each of these keys."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def made() -> pa.RecordBatch:
            cols = [pa.concat_arrays([b.column(3 + c) for b in held]) for c in range(len(names))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *lists], names=["t", "bucket", *names])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if key is not None and tuple(keys[s]) != key:
                    yield made()
                    held = []
                key = tuple(keys[s].tolist())
                held.append(b.slice(s, e - s))
        if held:
            yield made()

    lists = ", ".join(f"{c} array<{kind}>" for c, kind in columns.items())
    return rows.repartition("t", "bucket", "cell").sortWithinPartitions("t", "bucket", "cell").select("t", "bucket", "cell", *names).mapInArrow(run, f"t int, bucket int, {lists}")


def _block(qids: np.ndarray, queries: np.ndarray, x: np.ndarray, members: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, int, float, int]]:
    """query's place, point's place, id, distance, rows: of the k nearest candidates of a block to each query."""
    first = np.array([m[0][0] for m in members])
    alone = np.array([len(m) == 1 for m in members])
    norms, qnorms = (x * x).sum(axis=1), (queries * queries).sum(axis=1)
    rough = norms[None] + qnorms[:, None] - 2 * queries @ x.T
    rough[(first[None] == qids[:, None]) & alone[None]] = np.inf  # rows of the query's own id
    slack = 1e-9 * (qnorms + norms.max())
    kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + slack
    for q, (qid, limit) in enumerate(zip(qids.tolist(), kth.tolist())):
        at = np.flatnonzero(rough[q] <= limit) if limit < np.inf else np.flatnonzero(rough[q] < np.inf)
        distance = np.sqrt(((x[at] - queries[q]) ** 2).sum(axis=1)).tolist()
        found = sorted((d, i, p, n) for d, p in zip(distance, at.tolist()) for i, n in members[p] if i != qid)
        yield from ((q, p, i, d, n) for d, i, p, n in found[:k])


def _search(points: DataFrame, asked: DataFrame, dim: int, n_points: int, n_queries: int, k: int) -> DataFrame:
    """points: x, members; asked: qkey, id, n, x; all of one length. qkey, query_id, copies, point, vec_id, score, n."""
    h = fit(_numbers(points.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow()["x"].to_pylist(), dim), n_points, k)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLES * h.buckets, dtype=np.int64)
        for b in batches:
            codes = h.codes(_numbers(b.column(0).to_pylist(), dim)) + h.buckets * np.arange(TABLES)
            total += np.bincount(codes.ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    # one number for each bucket: TABLES * SLOTS ** MAX_HASHES of them at most
    sizes = points.select("x").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    cells = np.ones(TABLES * h.buckets, dtype=np.int64)
    cells[sizes["at"].to_numpy()] = -(-sizes["n"].to_numpy() // CELL)
    query_cells = max(1, n_queries // QUERY_CELL)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                codes = h.codes(_numbers(b.column(0).to_pylist(), dim))
                for t in range(TABLES):
                    spread = b.column(1).to_numpy() % cells[t * h.buckets + codes[:, t]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, dtype=np.int32)), pa.array(codes[:, t].astype(np.int32)), pa.array(spread.astype(np.int32)), *b.columns], names=["t", "bucket", "cell", "x", "point", "members"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                queries, key = _numbers(b.column(3).to_pylist(), dim), b.column(0).to_numpy()
                for t in range(TABLES):
                    visited = list(h.probes(queries, t))
                    row = np.repeat(np.arange(len(queries)), [len(v) for v in visited])
                    keys = (np.full(len(row), t), np.concatenate(visited), key[row] % query_cells)
                    for s in range(0, len(row), 8192):
                        yield pa.RecordBatch.from_arrays([*(pa.array(c[s : s + 8192].astype(np.int32)) for c in keys), *(c.take(pa.array(row[s : s + 8192])) for c in b.columns)], names=["t", "bucket", "cell", "qkey", "id", "copies", "qx"])

    spread = points.select("x", F.shiftrightunsigned(F.xxhash64("x"), 1).alias("point"), "members")
    content = {"x": "binary", "point": "long", "members": "array<struct<id:bigint,n:bigint>>"}
    spread = points.select("x", F.shiftrightunsigned(F.xxhash64("x"), 1).alias("point"), "members").mapInArrow(placed, ", ".join(f"{c} {kind}" for c, kind in (_KEY | content).items()))
    blocks = _packed(spread, content)
    content = {"qkey": "long", "id": "long", "copies": "long", "qx": "binary"}
    visited = asked.select("qkey", "id", F.col("n").alias("copies"), F.col("x").alias("qx")).mapInArrow(probed, ", ".join(f"{c} {kind}" for c, kind in (_KEY | content).items()))
    visits = _packed(visited, content)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["qkey", "query_id", "copies", "point", "vec_id", "score", "n"]
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
        for b in batches:
            for x, point, members, qkey, ids, copies, qx in zip(*(c.to_pylist() for c in b.columns)):
                members = [[(m["id"], m["n"]) for m in own] for own in members]
                found = _block(np.array(ids), _numbers(qx, dim), _numbers(x, dim), members, k)
                rows = [(qkey[q], ids[q], copies[q], point[p], i, d, n) for q, p, i, d, n in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    # what a query visits is many times the size that the planner sees in the queries, so neither side is broadcast
    met = blocks.hint("merge").join(visits, ["t", "bucket"]).select("x", "point", "members", "qkey", "id", "copies", "qx")
    return met.mapInArrow(compare, "qkey long, query_id long, copies long, point long, vec_id long, score double, n long")


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query selects, against every other row."""
    rows = materialise(usable(vectors).groupBy("x", "dim", "id").agg(F.count(F.lit(1)).alias("n")), "ann-rows")
    # a point needs no more than k ids beside a query's own; the limit is applied before the shuffle, so copies of one vector meet in no task
    least = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    few = rows.withColumn("least", least).where(F.col("least") <= k + 1)
    points = materialise(few.groupBy("x").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list(F.struct("id", "n"))).alias("members")), "ann-points")
    asked = materialise(rows.where(is_query(F.col("id"))).withColumn("qkey", F.monotonically_increasing_id()), "ann-queries")
    forget(rows)
    sizes, queries = ({r["dim"]: r["count"] for r in t.groupBy("dim").count().collect()} for t in (points, asked))
    found = [_search(points.where(F.col("dim") == d).select("x", "members"), asked.where(F.col("dim") == d).select("qkey", "id", "n", "x"), d, sizes[d], queries[d], k) for d in sorted(queries)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = reduce(DataFrame.unionAll, found).groupBy("qkey", "vec_id", "point").agg(F.first("query_id").alias("query_id"), F.first("copies").alias("copies"), F.first("score").alias("score"), F.first("n").alias("n"))
    order = ["score", "vec_id", "point"]
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy(*order))).where(F.col("rank") <= k)
    each = top.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy(*order, "copy"))).where(F.col("rank") <= k)
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


QUERY = lambda spark, sf_dir: nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
