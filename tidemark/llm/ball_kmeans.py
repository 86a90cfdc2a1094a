"""Ball k-means over integer vectors, exact in every comparison.

A cluster's members in an Arrow batch are a ball around its centroid: each has one exact distance to it, the largest is the radius. Another centroid is a neighbour
if its distance to the ball's is at most twice the radius; neighbours in order of distance cut the ball into a core, whose members can't be nearer to any of them,
and annuli, whose members are compared with as many neighbours as their annulus says. All tests are done on squared integers, so that ties (to the smaller
number) are decided as by comparing with every centroid.

A round is one pass that assigns, written to the shared folder, and one that sums: each task adds up its members by cluster, and the partial sums are
added up once more by cluster and part. The driver holds the centroids alone. Nothing is shuffled but partial sums.

Vectors count if they have exactly `dims` components, none null or not finite; others are left out. Components are floor(scale * x), of any size: beyond
2**25 all is done in whole numbers of Python, and a distance beyond a bigint is null. Rows may repeat ids or vectors, or have none (a null id counts as
an empty one for the first centroids); among equal hashes the smaller vector comes first. With fewer vectors than k, each is a centroid; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Components up to here keep four times a squared distance of 64 components inside an int64.
SMALL = 1 << 25
_LONG = 2**63 - 1
#: Partial sums of a cluster are added up in so many parts first.
PARTS = 64


def vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors; v is text where a component is beyond SMALL, else null, with the components in e."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = table.where(F.col("embedding").isNotNull()).where((F.size(x) == dims) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = np.floor(b.column(1).flatten().to_numpy().reshape(-1, dims) * float(scale))
            small = (np.abs(f) < SMALL).all(axis=1)
            e = pa.ListArray.from_arrays(np.arange(0, len(f) * dims + 1, dims, dtype=np.int32), pa.array(np.where(small[:, None], f, 0).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), e, pa.array([None if s else json.dumps([int(c) if abs(c) < float("inf") else int(x) * scale for c, x in zip(r, raw)]) for s, r, raw in zip(small, f, b.column(1).flatten().to_numpy().reshape(-1, dims))], pa.string())], names=["vec_id", "e", "big"])

    return own.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(run, "vec_id long, e array<int>, big string")


def _matrix(batch: pa.RecordBatch, at: int, dims: int) -> np.ndarray:
    """The vectors of a batch: int64, or whole numbers of Python where one of them is big."""
    e = batch.column(at).flatten().to_numpy().reshape(-1, dims).astype(np.int64)
    big = [(k, t) for k, t in enumerate(batch.column(at + 1).to_pylist()) if t is not None] if batch.column(at + 1).null_count < batch.num_rows else []
    if big:
        e = e.astype(object)
        for k, t in big:
            e[k] = json.loads(t)
    return e


def _as_matrix(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(c) < SMALL for r in rows for c in r)
    return np.array(rows, dtype=np.int64 if small else object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to the same row of b, or to the only one."""
    d = a - b
    return (d * d).sum(axis=1)


def between(centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(centroids, c) for c in centroids])


def assign(x: np.ndarray, owner: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, squared distance to it, and how many distances that took, for members of balls."""
    best, dist, taken = owner.copy(), squared(x, centroids[owner]), np.ones(len(x), dtype=np.int32)
    four = 4 * dist
    for c in np.unique(owner):
        inside = np.flatnonzero(owner == c)
        order = np.argsort(apart[c], kind="stable")
        order = order[order != c]
        radius = four[inside].max()
        order = order[apart[c][order] <= radius]  # neighbours: others can't be nearer to any member
        # annulus of a member: the number of neighbours within twice its distance; 0 is the core
        annulus = np.searchsorted(apart[c][order], four[inside], side="right")
        by_annulus = np.argsort(-annulus, kind="stable")
        sorted_, members = -annulus[by_annulus], inside[by_annulus]
        for place, other in enumerate(order):
            far = members[: np.searchsorted(sorted_, -place, side="left")]  # those of a higher annulus
            if not len(far):
                break
            d = squared(x[far], centroids[other])
            nearer = (d < dist[far]) | ((d == dist[far]) & (other < best[far]))
            best[far[nearer]], dist[far[nearer]] = other, d[nearer]
            taken[far] += 1
    return best, dist, taken


def _assigned(state: DataFrame, rows: list[list[int]], dims: int, owned: bool) -> DataFrame:
    """state with cluster and distance by these centroids (and the number of distances computed)."""
    centroids = _as_matrix(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, 1, dims)
            c = centroids if x.dtype == centroids.dtype else centroids.astype(object)
            x = x if x.dtype == c.dtype else x.astype(object)
            if apart is None or apart.dtype != c.dtype:
                apart = between(c)
            owner = b.column(3).to_numpy().astype(np.int64) if owned else np.zeros(len(x), dtype=np.int64)
            cluster, distance, taken = assign(x, owner, c, apart)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(cluster.astype(np.int32)), pa.array([int(d) if d <= _LONG else None for d in distance], pa.int64()), pa.array(taken)], names=["vec_id", "e", "big", "cluster", "distance", "compared"])

    columns = ["vec_id", "e", "big", *(["cluster"] if owned else [])]
    return state.select(*columns).mapInArrow(run, "vec_id long, e array<int>, big string, cluster int, distance long, compared int")


_SUMS = "cluster int, part int, n long, total string"


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Members and componentwise sums of each cluster. k rows come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            x, cluster = _matrix(b, 0, dims), b.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                add = [int(s) for s in own.sum(axis=0)]
                n, old = found.get(c, (0, [0] * dims))
                found[c] = (n + len(own), [s + a for s, a in zip(old, add)])
        if found:
            part = int(hashlib.sha256(json.dumps(sorted(found.items())).encode()).hexdigest()[:8], 16) % PARTS
            yield pa.RecordBatch.from_pylist([{"cluster": c, "part": part, "n": n, "total": json.dumps(t)} for c, (n, t) in found.items()], pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    def together(key, frame):
        import pandas as pd

        totals = [json.loads(t) for t in frame["total"]]
        return pd.DataFrame({"cluster": [key[0]], "part": [0], "n": [int(frame["n"].sum())], "total": [json.dumps([sum(t) for t in zip(*totals)])]})

    parts = state.select("e", "big", "cluster").mapInArrow(partial, _SUMS)
    merged = parts.groupBy("cluster", "part").applyInPandas(together, _SUMS).groupBy("cluster").applyInPandas(together, _SUMS)
    return {r["cluster"]: (r["n"], json.loads(r["total"])) for r in merged.collect()}


def first_centroids(state: DataFrame, k: int = K, seed: str = "2") -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    sha = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = state.select(sha.alias("sha"), "e", "big").orderBy("sha", "e", "big").limit(k).collect()
    return [json.loads(r["big"]) if r["big"] is not None else list(r["e"]) for r in found]


def kmeans(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, e, big, cluster, distance, compared) of every vector that counts, written; and the final centroids."""
    state, owned = materialise(vectors(table, dims, scale), "ball-vectors"), False
    centroids = first_centroids(state, k, seed)
    if not centroids:
        return materialise(_assigned(state, [[0] * dims], dims, False), "ball-assigned"), []
    for last in [False] * rounds + [True]:
        done = materialise(_assigned(state, centroids, dims, owned), "ball-assigned")
        forget(state)
        state, owned = done, True
        if not last:
            for c, (n, total) in _sums(state, dims).items():
                centroids[c] = [t // n for t in total]
    return state, centroids


def digest(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: inertias are sums of k numbers, broadcast with the hashes of the centroids."""
    spark = state.sparkSession
    hashes = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertias = spark.createDataFrame([(c, int(s)) for c, s in sums.items() if s is not None and s <= _LONG], "cluster int, cluster_inertia long")
    total = sum(int(s) for s in sums.values() if s is not None)
    small = F.broadcast(named.join(inertias, "cluster", "left"))  # k rows
    inertia = F.lit(total if total <= _LONG else None).cast("long")
    return state.join(small, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")


QUERY = lambda spark, sf_dir: digest(*kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS k, e FROM v ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e LIMIT {k})"]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (SELECT r, vec_id, v.e AS x, k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT k, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY 1, 2))")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT k, list(m ORDER BY i) AS e FROM s{n} GROUP BY 1) m ON c.k = m.k)")
    last = rounds
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.k = c.k"


SQL = _sql()
