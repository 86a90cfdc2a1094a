"""Loose request objects as columns, against the row-by-row rules and by case."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import calendar, payloads
from tidemark.operators import questions
from tidemark.spec import SeriesSpec


def read(spark, *said):
    df = spark.createDataFrame(list(enumerate(said)), "id int, said string")
    return [r["request"].asDict(recursive=True) for r in payloads.request_payloads(df, "said").orderBy("id").collect()]


def filled(request):
    return {k: v for k, v in request.items() if v not in (None, [], False)}


def test_single_values_texts_and_what_cannot_be_read(spark):
    a, b, c = read(
        spark,
        'Sure: {"years": "2024", "months": [2, "13", 3], "days": [29, 30, "x", null], "times": ["9:30", "25:00", "10:05:07", 7], "weekdays": ["monday", "Funday", "SUN"], "weekends": "Yes", "regions": ["Sydney", "vic", "vic."], "metrics": "demand", "modality": "both"} as asked',
        '{"horizon": [{"steps": "6", "units": "Hours", "hint": "mid_term"}], "vague_label": "Morning", "vague_tolerance_minutes": "45", "notes": "Easter, perhaps"}',
        '{"horizon": {"steps": 2.5, "units": "years"}, "vague_label": "sometime", "vague_tolerance_minutes": [1], "times": {}, "weekends": "perhaps", "years": [99999999999]}',
    )
    assert (a["groups"], a["metrics"], a["times"]) == (["NSW1", "VIC1"], ["TOTALDEMAND"], ["09:30:00", "10:05:07"])
    assert (a["years"], a["months"], a["days"], a["dates"]) == ([2024], [2, 3], [29, 30], [date(2024, 2, 29), date(2024, 3, 29), date(2024, 3, 30)])
    assert a["weekdays"] == ["MON", "THU", "FRI", "SAT", "SUN"] and a["weekends"] and a["weekend_dates"] == [date(2024, 3, 30)] and a["holiday_dates"] == [date(2024, 3, 29)] and a["modality"] is None
    assert filled(b) == {"times": ["09:00:00"], "holidays": True, "horizon_steps": 6, "horizon_units": "hours", "horizon_hint": "mid_term", "vague_label": "Morning", "vague_tolerance": 45, "notes": "Easter, perhaps"}
    assert filled(c) == {"vague_label": "sometime"}


def test_targets(spark):
    got = read(spark, '{"date_start": "2024-05-01"}', '{"date_end": "2024-05-02"}', '{"date_start": "2024-05-01", "date_end": "2024-05-03T10:00"}', '{"start_time": "2024-05-01T06:00Z", "date_end": "2024-05-03"}', '{"end_time": "2024-05-02 08:00", "date_start": "2024-05-01"}', '{"end_time": "2024-05-02T08:00"}', '{"date_start": "2024-05-04", "date_end": "2024-05-01"}')
    at, last = lambda d, h=0: datetime(2024, 5, d, h), lambda d: datetime(2024, 5, d, 23, 59, 59)
    assert [(g["target_start"], g["target_end"]) for g in got] == [(at(1), last(1)), (at(2), last(2)), (at(1), last(3)), (at(1, 6), last(3)), (at(1), at(2, 8)), (None, at(2, 8)), (at(4), last(1))]
    assert [len(g["dates"]) for g in got] == [1, 1, 3, 3, 2, 1, 0]


def test_ranges_by_any_name(spark):
    (got,) = read(spark, '{"date_ranges": [{"from": "2024-01-30", "to": "2024-02-01"}, {"end": "2024-03-05"}, 5, {"start": "never"}, {"start_date": "", "start": "2024-04-02", "end": "2024-04-01"}], "timestamp_ranges": {"timestamp_start": "2024-06-01T23:00", "timestamp_end": "2024-06-02T01:00"}, "single_timestamps": ["2024-02-30", "2024-07-01"]}')
    assert [(r["start"], r["end"]) for r in got["date_ranges"]] == [(date(2024, 1, 30), date(2024, 2, 1)), (None, date(2024, 3, 5)), (date(2024, 4, 2), date(2024, 4, 1))]
    assert got["dates"] == [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 3, 5), date(2024, 6, 1), date(2024, 6, 2), date(2024, 7, 1)]


def test_no_object_is_an_empty_request(spark):
    for got in read(spark, None, "", "no object", "{bad", "[1]", "{}", '{"years": 1, "years": 2}', "null", "{" * 5000, '{"a": ' + "[" * 400 + "]" * 400 + "}"):
        assert filled(got) == {}


def test_long_and_clashing(spark):
    df = spark.createDataFrame([('{"notes": "' + "x" * 1_000_000 + '", "days": [' + ",".join(map(str, range(50_000))) + "]}", "own", 1), (None, None, None)], "said string, request string, years int")
    made = payloads.request_payloads(df, "said")
    assert made.columns == ["said", "years", "request"]
    long, none = sorted(made.collect(), key=lambda r: r["years"] is None)
    assert len(long["request"]["notes"]) == 1_000_000 and long["request"]["days"] == list(range(1, 32)) and none["years"] is None and none["request"]["dates"] == []
    assert payloads.request_payloads(df.where("false"), "said").count() == 0


def test_holidays_equal_the_rules(spark):
    days = spark.range(366 * 150).select(F.date_add(F.lit(date(1950, 1, 1)), F.col("id").cast("int")).alias("d"))
    assert all(r["h"] == calendar.is_holiday(r["d"]) for r in days.select("d", calendar.holiday_column(F.col("d")).alias("h")).collect())


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.lit("{}").alias("said"))
    plan = payloads.request_payloads(df, "said")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_objects_as_questions(spark):
    rng, t = random.Random(2), datetime(2024, 1, 1)
    spec = SeriesSpec("ts", "g", ("v",), "k")
    readings = spark.createDataFrame([(k, t + timedelta(minutes=30 * k), rng.choice(["NSW1", "VIC1"]), rng.random()) for k in range(4000)], "k long, ts timestamp_ntz, g string, v double")
    anchor = t + timedelta(days=80)
    said = [("q1", '{"regions": "sydney", "date_start": "2024-03-25"}', anchor), ("q2", '{"horizon": "long_term"}', anchor), ("q3", '{"date_start": "2024-09-01", "regions": ["Victoria"], "times": "9:30"}', anchor), ("q4", None, anchor), ("q5", '{"date_start": "2026-01-01"}', anchor)]
    asked = payloads.asked(payloads.request_payloads(spark.createDataFrame(said, "id string, said string, at timestamp_ntz"), "said"), "id", "at")
    routes = {r["question_id"]: r["route"] for r in asked.collect()}
    assert routes == {"q1": "short_term", "q2": "long_term", "q3": "mid_term", "q4": "mid_term", "q5": "long_term"}
    rows = questions.retrieve_all(readings, spec, asked).rows.select("question_id", "g", "ts").collect()
    assert {r["question_id"] for r in rows} >= {"q1", "q2", "q3", "q4"} and all(r["ts"] < anchor for r in rows)
    assert {r["g"] for r in rows if r["question_id"] == "q1"} == {"NSW1"} and {r["g"] for r in rows if r["question_id"] == "q4"} == {"NSW1", "VIC1"}
