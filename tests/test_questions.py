"""Retrieval for a table of questions against one retrieval for each, and its plan."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import questions, retrieve
from tidemark.plans.windows import ROUTES, windows_of
from tidemark.spec import Filters, RetrievalConfig, SeriesSpec

SPEC = SeriesSpec("ts", "g", ("v",), "k")
COLUMNS = "question_id int, route string, anchor timestamp_ntz, groups array<string>, times array<string>, target_start timestamp_ntz, target_end timestamp_ntz, freq string"


@pytest.fixture(scope="module")
def readings(spark):
    rng, t = random.Random(1), datetime(2017, 6, 1)
    rows = [(k, t + timedelta(minutes=30 * rng.randrange(48 * 365 * 8)), rng.choice("aab"), rng.random()) for k in range(20_000)]
    rows += [(30_000 + k, datetime(2024, 5, 20, 9), "a", float(k)) for k in range(800)]  # many rows at one time
    return rows, spark.createDataFrame(rows, "k long, ts timestamp_ntz, g string, v double").repartition(6).cache()


def plain(asked):
    """(question, window) by the windows of a single question."""
    out = set()
    for q, route, anchor, _, _, start, end, freq in asked:
        out |= {(q, *w) for w in windows_of(anchor, route, RetrievalConfig(), start, end, freq)}
    return out


def test_windows_equal_those_of_single_questions(spark):
    rng, asked = random.Random(4), []
    days = [datetime(2024, 2, 29, 10, 30), datetime(2023, 2, 28), datetime(2024, 12, 31, 23, 30), datetime(2021, 1, 1), datetime(2024, 3, 30, 1), datetime(2023, 5, 31, 6)]
    for k in range(120):
        at = rng.choice(days) + timedelta(days=rng.choice((0, 0, 1, 7)))
        start = rng.choice((None, at + timedelta(days=rng.randrange(40), hours=rng.randrange(24))))
        end = start and rng.choice((None, start + timedelta(hours=rng.choice((1, 30, 200)))))
        asked.append((k, list(ROUTES)[k % 3], at, None, None, start, end, rng.choice((None, "hourly", "30 minutes", "15min", "daily", "weekly"))))
    got = questions.windows(questions.normalised(spark.createDataFrame(asked, COLUMNS)))
    found = {tuple(r) for r in got.select("question_id", "ret_block", "block_rank", "lag", "lo", "hi", "prior_year", "lag_days", "prior_woy").collect()}
    assert found == plain(asked)


def ask(n=12):
    rng, out = random.Random(9), []
    for k in range(n):
        target = datetime(2024, 6, 1 + k, rng.randrange(24)) if k % 2 else None
        out.append((k, list(ROUTES)[k % 3], None, [None, ["A"], ["b", "A"], ["b"]][k % 4], ["09:10"] if k % 3 == 0 else ["25:00"] if k % 3 == 1 else None, target, target + timedelta(hours=5) if k % 4 == 3 else None, "hourly" if k % 5 == 0 else None))
    return out


@pytest.mark.parametrize("limit", [questions.BROADCAST_ROWS, 0])
def test_table_equals_one_retrieval_for_each(spark, readings, monkeypatch, limit):
    monkeypatch.setattr(questions, "BROADCAST_ROWS", limit)
    _, df = readings
    asked, cfg = ask(), RetrievalConfig(max_segments=300)
    e = questions.retrieve_all(df, SPEC, spark.createDataFrame(asked, COLUMNS), cfg)
    rows, best = {}, {}
    for r in e.rows.collect():
        rows.setdefault(r["question_id"], []).append((r["ret_block"], r["lag"], r["k"], round(r["ret_score"], 9), r["prior_year"], r["lag_days"], r["prior_woy"]))
    for r in e.combined.orderBy("question_id", "rank").collect():
        best.setdefault(r["question_id"], []).append((r["k"], round(r["ret_score"], 9)))
    counts = {(r["question_id"], r["ret_block"]): r["n_rows"] for r in e.counts.collect()}
    for q, route, _, groups, times, start, end, freq in asked:
        f = Filters(groups=tuple(groups or ()), times=tuple(times or ()), start_time=start and str(start), end_time=end and str(end), freq=freq)
        one = retrieve.retrieve(df, SPEC, route, f, cfg)
        want = [(r["ret_block"], r["lag"], r["k"], round(r["ret_score"], 9), r["prior_year"], r["lag_days"], r["prior_woy"]) for r in one.rows.collect()]
        key = lambda x: tuple(map(str, x))
        assert sorted(rows.get(q, []), key=key) == sorted(want, key=key)
        assert best.get(q, []) == [(r["k"], round(r["ret_score"], 9)) for r in one.combined.collect()]
        assert {b: n for (i, b), n in counts.items() if i == q} == {r["ret_block"]: r["n_rows"] for r in one.counts.collect()}


def test_one_scan_and_no_nested_loop(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    spec = SeriesSpec("o_orderdate", "o_orderpriority", ("o_totalprice",), "o_orderkey")
    asked = spark.createDataFrame([(k, "mid_term", datetime(2000, 1, 1 + k), None if k % 2 else ["1-URGENT"], None, None, None, None) for k in range(20)], COLUMNS)
    for limit in (questions.BROADCAST_ROWS, 0):
        monkeypatch.setattr(questions, "BROADCAST_ROWS", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if limit else "-1")
        plan = questions.matches(df, spec, questions.windows(questions.normalised(asked)))._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        assert "NestedLoop" not in physical and "Cartesian" not in physical and physical.count("FileScan parquet") == 1
        assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in physical
        assert ("SortMergeJoin" in physical or "ShuffledHashJoin" in physical) == (limit == 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_awkward_questions(spark, readings):
    _, df = readings
    asked = [(1, "short_term", None, ["nobody"], None, None, None, None), (2, "nonsense", None, None, None, None, None, None), (3, "short_term", datetime(1990, 1, 1), None, None, None, None, None), (4, "long_term", datetime(2024, 1, 1), [], None, None, None, None), (4, "long_term", datetime(2024, 1, 1), [], None, None, None, None)]
    table = spark.createDataFrame(asked, COLUMNS)
    e = questions.retrieve_all(df, SPEC, table)
    assert {r["question_id"] for r in e.counts.collect()} == {4}
    assert questions.retrieve_all(df, SPEC, table.where("false")).rows.count() == 0 and questions.retrieve_all(df.where("false"), SPEC, table).rows.count() == 0
    few = table.select("question_id", "route")
    assert questions.retrieve_all(df, SPEC, few.where("question_id = 1")).counts.count() > 0  # no groups named: all of them
    f = questions.forecasts(e, SPEC, table.dropDuplicates(["question_id"])).collect()
    assert {(r["series"], r["metric"]) for r in f} == {("a", "v"), ("b", "v")} and all(0 <= r["forecast"] <= 1 for r in f)
    assert e.rows.agg(F.max("ts") < F.lit(datetime(2024, 1, 1))).first()[0]


def test_runs_of_a_table_equal_single_runs(spark, readings):
    from tidemark.plans import pipeline
    from tidemark.spec import Flags

    rng = random.Random(3)
    rows = [(k, datetime(2021, 1, 1) + timedelta(hours=6 * k), rng.choice(["NSW1", "VIC1"]), rng.random()) for k in range(6000)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, g string, v double")
    asked = [("q1", "demand in Sydney on 2025-02-20 at 09:30"), ("q2", "spot price in Victoria on March 2, 2026"), ("q3", "what next?"), ("q4", "load in Brisbane"), ("q5", None)]
    setups = {"full": Flags(stats=False, patterns=False, summary=False), "flat": Flags(horizon=False, stats=False, patterns=False, summary=False)}
    got = {(r["exp_id"], r["query_id"]): r for r in pipeline.run_questions(df, SPEC, spark.createDataFrame(asked, "id string, text string"), setups, (7,)).collect()}
    assert len(got) == 10
    for exp, flags in setups.items():
        for q, text in asked[:4]:
            one, _ = pipeline.run_one(df, SPEC, exp, 7, {"id": q, "text": text}, flags)
            r = got[exp, q]
            assert (r["run_id"], r["route"], bool(r["error"])) == (one["run_id"], one["route"], bool(one["error"]))
            numbers = lambda s: [(p.split("=")[0], round(float(p.split("=")[1]), 9)) for p in s.split("; ") if p]
            assert numbers(r["answer"]) == numbers(one["answer"]) and bool(r["answer"]) == (q != "q4")
