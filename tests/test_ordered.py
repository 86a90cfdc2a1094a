"""Ordered scans in many small blocks against plain loops: dense hours, hot times, nulls; exact signed ranks; percentiles of many groups."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, evaluate, ordered, patterns, stats
from tidemark.spec import AnomalyConfig, ScanConfig

T0 = datetime(2024, 3, 1)
SMALL = ScanConfig(rows_per_block=60, samples_per_block=8)


@pytest.fixture(scope="module")
def dense(spark):
    """One hour holds nearly all rows, one instant a third of them; the rest is spread over years."""
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        at = T0 + (timedelta(minutes=7) if k % 3 == 0 else timedelta(microseconds=rng.randrange(3_600_000_000)) if k % 10 else timedelta(days=rng.randrange(-900, 900)))
        rows.append((rng.choice(["a", "a", "a", "b", None]), at if k % 97 else None, k, rng.gauss(1000, 5)))
    return rows, spark.createDataFrame(rows, "g string, ts timestamp_ntz, k long, v double").repartition(7).cache()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2]))


def series_of(rows):
    return {g: [r for r in in_order(rows) if r[0] == g] for g in {r[0] for r in rows}}


def test_blocks_follow_the_density(dense):
    rows, df = dense
    placed, cut = ordered.in_blocks(df, "ts", ("g",), ("k",), SMALL)
    sizes = [r["count"] for r in placed.groupBy("_block").count().collect()]
    assert cut and sum(sizes) == len(rows) and len(sizes) >= 25 and max(sizes) <= 400
    by_block = placed.groupBy("_block").agg(F.min(F.struct("ts", "k")).alias("lo"), F.max(F.struct("ts", "k")).alias("hi")).orderBy("_block").collect()
    key = lambda s: (s["ts"] is not None, s["ts"] or T0, s["k"])
    assert all(key(a["hi"]) < key(b["lo"]) for a, b in itertools.pairwise(by_block))


def test_places_and_neighbours_in_dense_blocks(dense):
    rows, df = dense
    for cfg in (SMALL, ScanConfig()):
        got = {r["k"]: r for r in ordered.numbered(df, "ts", ("g",), "place", ("k",), cfg).collect()}
        before = {r["k"]: r["p"] for r in ordered.previous(df, "ts", ("g",), {"k": "p"}, ("k",), cfg).collect()}
        for own in series_of(rows).values():
            assert [got[r[2]]["place"] for r in own] == list(range(len(own)))
            assert [before[r[2]] for r in own] == [None, *(r[2] for r in own[:-1])]


def test_running_sums_with_ties(dense):
    rows, df = dense
    for cfg in (SMALL, ScanConfig()):
        upto = {r["k"]: r["s"] for r in ordered.running_sums(df, "ts", ("g",), {"s": F.col("k")}, cfg).collect()}
        ahead = {r["k"]: r["s"] for r in ordered.running_sums(df, "ts", ("g",), {"s": F.col("k")}, cfg, ahead=True).collect()}
        for own in series_of(rows).values():
            total = 0
            for _, same in itertools.groupby(own, key=lambda r: r[1]):
                same = list(same)
                assert {ahead[r[2]] for r in same} == {total}
                total += sum(r[2] for r in same)
                assert {upto[r[2]] for r in same} == {total}


@pytest.mark.parametrize("rows_per_block", [40, 10**6])
def test_rolling_statistics_of_a_dense_hour(dense, monkeypatch, rows_per_block):
    rows, df = dense
    monkeypatch.setattr(ordered, "SCAN", ScanConfig(rows_per_block, 8))
    long = df.select(F.coalesce("g", F.lit("none")).alias("series"), F.lit("v").alias("metric"), "ts", F.col("v").alias("value"), "k")
    got = patterns.rolling_z(long, AnomalyConfig(rolling_days=7)).collect()
    want = {}
    for g, own in series_of(rows).items():
        own = [r for r in own if r[1] is not None]
        at, v = np.array([r[1] for r in own], dtype="datetime64[us]"), np.array([r[3] for r in own])
        for r in own:
            w = v[(at <= np.datetime64(r[1])) & (at > np.datetime64(r[1] - timedelta(days=7)))]
            want[g or "none", r[1], r[3]] = (len(w), (r[3] - w.mean()) / w.std(ddof=1) if len(w) >= 24 else None)
    assert len(got) == len(want)
    for r in got:
        n, z = want[r["series"], r["ts"], r["value"]]
        assert r["n"] == n and (z is None) == (r["z"] is None) and (z is None or abs(z - r["z"]) < 1e-6)


def test_persistence_in_dense_blocks(spark, dense):
    rows, df = dense
    history = df.where("g is not null and ts is not null").select("g", "ts", F.col("v").alias("value"))
    asked = [(g, k, T0 + timedelta(seconds=rng * 37)) for g in "abz" for k, rng in enumerate(range(-50, 120, 3))]
    targets = spark.createDataFrame(asked, "g string, target_id long, ts timestamp_ntz")
    got = {(r["g"], r["target_id"]): r["prediction"] for r in baselines.persistence(history, targets, ("g",), SMALL).collect()}
    for g, k, at in asked:
        earlier = [(r[1], -r[3]) for r in rows if r[0] == g and r[1] is not None and r[1] < at]
        assert got[g, k] == (-max(earlier)[1] if earlier else None)


def test_order_of_texts(spark):
    names = [f"question-{k:05d}" for k in range(900)]
    df = spark.createDataFrame([("m", n, float(k)) for k, n in enumerate(names)], "g string, name string, d double").repartition(5)
    placed, cut = ordered.in_blocks(df, "name", ("g",), (), SMALL)
    assert cut and placed.select("_block").distinct().count() > 5
    got = {r["name"]: r["b"] for r in ordered.previous(df, "name", ("g",), {"d": "b"}, (), SMALL).collect()}
    assert [got[n] for n in names] == [None, *map(float, range(899))]


def test_loss_differences_and_ranks_over_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("a", "b", k, abs(rng.gauss(1, 1)), abs(rng.gauss(1.1, 1))) for k in range(700)]
    p = spark.createDataFrame(rows, "model_a string, model_b string, query_id long, error_a double, error_b double")
    whole = [evaluate.loss_difference(p, absolute=True).first(), evaluate.signed_ranks(p).first()]
    monkeypatch.setattr(ordered, "SCAN", SMALL)
    cut = [evaluate.loss_difference(p, absolute=True).first(), evaluate.signed_ranks(p).first()]
    d = np.array([r[3] - r[4] for r in rows])
    v = d.var(ddof=1) + np.cov(d[1:], d[:-1])[0, 1]
    assert abs(cut[0]["dm"] - d.mean() / np.sqrt(v / len(d))) < 1e-9 and abs(whole[0]["dm"] - cut[0]["dm"]) < 1e-9
    rank = np.argsort(np.argsort(abs(d))) + 1
    assert cut[1]["statistic"] == whole[1]["statistic"] == min(rank[d > 0].sum(), rank[d < 0].sum()) and not cut[1]["exact"]


def plain_p(d):
    size = sorted(map(abs, d))
    w = min(sum(size.index(abs(x)) + 1 for x in d if x > 0), sum(size.index(abs(x)) + 1 for x in d if x < 0))
    n = len(d)
    return w, min(1.0, 2 * sum(sum(k + 1 for k in range(n) if m >> k & 1) <= w for m in range(1 << n)) / 2**n)


def test_exact_signed_ranks_equal_counting_all_signs(spark):
    rng = random.Random(2)
    given = {f"m{n}": [(k + 1) * rng.choice((-1, 1)) * 1.5 for k in range(n)] for n in (10, 11, 12, 13)} | {"up": [float(k + 1) for k in range(12)]}
    ties, zero = {"ties": [1.0, 1.0, *map(float, range(2, 12))]}, {"zero": [0.0, *map(float, range(1, 12))]}
    long = {"long": [float(k + 1) * (-1) ** k for k in range(50)], "longer": [float(k + 1) * (-1) ** k for k in range(51)], "few": [1.0] * 9}
    rows = [(m, "x", k, 1000.0 + d, 1000.0) for m, ds in (given | ties | zero | long).items() for k, d in enumerate(ds)]
    got = {r["model_a"]: r for r in evaluate.signed_ranks(spark.createDataFrame(rows, "model_a string, model_b string, query_id long, error_a double, error_b double")).collect()}
    for m, ds in given.items():
        assert got[m]["exact"] and (got[m]["statistic"], got[m]["p_value"]) == pytest.approx(plain_p(ds), abs=1e-12)
    assert got["up"]["p_value"] == pytest.approx(2 / 2**12) and not got["ties"]["exact"] and not got["zero"]["exact"] and got["zero"]["n"] == 11
    assert got["long"]["exact"] and not got["longer"]["exact"] and abs(got["long"]["p_value"] - got["longer"]["p_value"]) < 0.05 and got["few"]["p_value"] is None
    ways = np.array([1.0])  # an own count for fifty ranks
    for r in range(1, 51):
        ways = np.convolve(ways, np.eye(1, r + 1, 0)[0] + np.eye(1, r + 1, r)[0])
    assert got["long"]["p_value"] == pytest.approx(2 * ways[: int(got["long"]["statistic"]) + 1].sum() / 2**50)


def test_winner_by_median_only_where_significant(spark):
    rows = [(m, q, e) for q in range(20) for m, e in (("a", 1.0 + q / 100), ("b", 2.0 + q / 50), ("c", 1.0 + q / 100 + (-1) ** q * (q + 1) / 1000))]
    got = {(r["model_a"], r["model_b"]): r for r in evaluate.all_pairs(spark.createDataFrame(rows, "model string, query_id long, error double")).collect()}
    assert got["a", "b"]["winner"] == "a" and got["a", "c"]["winner"] is None and got["a", "b"]["median_a"] == pytest.approx(1.095)


def test_percentiles_of_many_groups_and_small_sketches(spark, monkeypatch):
    monkeypatch.setattr(stats, "BROADCAST_GROUPS", 3)
    rng = np.random.default_rng(3)
    groups = {g: np.round(rng.standard_normal(3000) * 10 ** (g % 4), 1).tolist() + [float("nan")] * (g % 2) for g in range(6)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").repartition(5)
    for size in (64, 4096):
        got = {r["g"]: r["q"] for r in stats.quantiles(df, "v", ("g",), (99, 1, 50), size).collect()}
        assert all(np.allclose(got[g], np.nanpercentile(vs, (99, 1, 50))) for g, vs in groups.items())
