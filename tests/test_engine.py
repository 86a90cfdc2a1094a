"""Edges that the sample tables don't have."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, text
from tidemark.operators import baselines, chunks, evaluate, filters, parse, patterns, resample, retrieve, stats
from tidemark.plans import clients, pipeline
from tidemark.plans.windows import recent_span, target_window, windows_of, years_back
from tidemark.sources import readings
from tidemark.spec import AnomalyConfig, EvaluationConfig, Filters, Flags, RetrievalConfig, ScanConfig, SeriesSpec

SPEC = SeriesSpec("ts", "g", ("v",), "k")


@pytest.fixture(scope="module")
def series(spark):
    start = datetime(2023, 2, 27)
    rows = [(k, start + timedelta(hours=k), "ab"[k % 2], float(k % 24) + (100.0 if k == 9000 else 0.0)) for k in range(9200)]
    return spark.createDataFrame(rows, "k long, ts timestamp_ntz, g string, v double")


def test_leap_day_is_clamped():
    assert years_back(datetime(2024, 2, 29, 5), 1) == datetime(2023, 2, 28, 5)
    rows = windows_of(datetime(2024, 2, 29, 12), "short_term")
    assert (r := next(r for r in rows if r[0] == "prior_years_same_week"))[3] == datetime(2023, 2, 25) and r[4] == datetime(2023, 3, 3, 23, 59, 59)


def test_no_row_at_or_after_the_anchor_and_combined_is_a_part_of_blocks(series):
    r = retrieve.retrieve(series, SPEC, "short_term")
    assert r.rows.where(F.col("ts") >= F.lit(r.anchor)).isEmpty()
    assert r.combined.select("k").exceptAll(r.rows.select("k").distinct()).isEmpty()
    cfg = RetrievalConfig(max_segments=7)
    assert retrieve.retrieve(series, SPEC, "short_term", cfg=cfg).combined.count() == 7


def test_empty_group_filter_and_unknown_group(series):
    assert filters.groups(series, "g", ()).count() == 9200
    assert filters.groups(series, "g", ("A",)).count() == 4600
    with pytest.raises(ValueError):
        retrieve.retrieve(series, SPEC, "short_term", Filters(groups=("none",)))


def test_explicit_time_is_kept_unless_compat():
    f = Filters(date_start="2025-06-19T23:30:00")
    assert target_window(f) == (datetime(2025, 6, 19, 23, 30), None)
    assert target_window(f, compat=True) == (datetime(2025, 6, 19), None)
    assert recent_span("daily", RetrievalConfig()) == timedelta(days=365)
    assert recent_span("daily", RetrievalConfig(compat=True)) == timedelta(days=7)


def test_rolling_z_over_block_borders_equals_pandas(spark, series):
    one = series.where("g = 'a'")
    got = patterns.rolling_z(stats.unpivot(one, SPEC), AnomalyConfig()).orderBy("ts").toPandas()
    s = one.orderBy("ts").toPandas().set_index("ts")["v"]
    roll = s.rolling("7D")
    z = (s - roll.mean()) / roll.std()
    want = z.where(roll.count() >= 24)
    assert got["n"].tolist() == roll.count().astype(int).tolist()
    assert (got["z"].round(6).fillna(-99).to_numpy() == want.round(6).fillna(-99).to_numpy()).mean() > 0.999
    assert patterns.anomalies(stats.unpivot(one, SPEC)).where("value >= 100").count() == 1


def test_constant_single_and_null_series(spark):
    df = spark.createDataFrame([("c", datetime(2024, 1, 1) + timedelta(hours=k), 5.0, None) for k in range(30)] + [("s", datetime(2024, 1, 1), 1.0, None)], "g string, ts timestamp_ntz, v double, w double")
    b = {r["g"]: r for r in stats.basic(df, "v", ("g",)).collect()}
    assert b["s"]["std"] == 0.0 and b["c"]["p50"] == 5.0
    assert stats.correlation_matrix(df, ("v", "w")).first()["r"] is None
    assert stats.correlation_matrix(df.withColumn("u", F.lit(1.0)), ("v", "u")).first()["r"] is None
    spec = SeriesSpec("ts", "g", ("v",))
    assert all(r["acf"] is None for r in patterns.autocorrelation(stats.unpivot(df, spec), 3600, (1,)).collect())
    assert patterns.labels(stats.unpivot(df, spec)).count() == 2


def test_interpolation_fills_gaps_in_a_line(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0), 1.0), (datetime(2024, 1, 1, 3), 4.0)], "ts timestamp_ntz, v double")
    assert [r["value"] for r in resample.regular(df, "ts", "v", 3600).orderBy("slot").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_gap_report_and_ties(spark):
    at = [datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 6)]
    df = spark.createDataFrame([("a", t) for t in at], "g string, ts timestamp_ntz")
    r = stats.gap_report(df, "ts", ("g",), 86400).first()
    assert (r["n_gaps"], r["max_gap_steps"], r["duplicate_rows"]) == (1, 4.0, 1)
    assert stats.sampling_interval(df, "ts", ("g",)).first()["step_seconds"] == 86400


def test_persistence_is_strictly_before_and_carries_over_blocks(spark):
    h = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 6, 1), 2.0)], "g string, ts timestamp_ntz, value double")
    t = spark.createDataFrame([("a", 0, datetime(2024, 1, 1)), ("a", 1, datetime(2024, 5, 31)), ("a", 2, datetime(2024, 6, 1)), ("a", 3, datetime(2025, 1, 1))], "g string, target_id long, ts timestamp_ntz")
    got = {r["target_id"]: r["prediction"] for r in baselines.persistence(h, t, ("g",)).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 2.0}


def test_sarima_finds_coefficients_and_continues_seasons(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    phi, theta, big = 0.5, 0.3, -0.4
    e, w = rng.standard_normal(4000), np.zeros(4000)
    for t in range(49, 4000):
        w[t] = phi * w[t - 1] + big * (w[t - 48] - phi * w[t - 49]) + e[t] + theta * e[t - 1]
    d, y = np.zeros(4000), np.zeros(4001)
    for t in range(4000):
        d[t] = w[t] + (d[t - 48] if t >= 48 else 0)
        y[t + 1] = y[t] + d[t]
    *_, found = baselines.fit_sarima(y[200:2000], 3)
    assert all(abs(a - b) < 0.08 for a, b in zip(found, (phi, theta, big)))
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=30 * k), 100 + 0.1 * k + k % 48) for k in range(400)] + [("b", start, 1.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, value double")
    got = baselines.sarima(df, 5, ("g",)).orderBy("step").collect()
    assert [(r["g"], r["step"], round(r["prediction"], 6)) for r in got] == [("a", k + 1, round(100 + 0.1 * (400 + k) + (400 + k) % 48, 6)) for k in range(5)]


def test_chunks_partition_rows(series):
    c = chunks.by_time(series, "ts", 24, ("g",))
    assert c.count() == 9200 and c.where("chunk_id < 0").isEmpty()
    assert chunks.by_rows(series, ("ts",), ("g",), rows=100).groupBy("g", "chunk_id").count().where("count > 100").isEmpty()


def test_daylight_saving_times(spark):
    tr = spark.createDataFrame([(datetime(2024, 10, 6, 2), datetime(2024, 10, 6, 3), datetime(2024, 4, 7, 2), datetime(2024, 4, 7, 3))], "gap_lo timestamp_ntz, gap_hi timestamp_ntz, fold_lo timestamp_ntz, fold_hi timestamp_ntz")
    df = spark.createDataFrame([(1, datetime(2024, 10, 6, 2, 30)), (2, datetime(2024, 4, 7, 2, 30)), (3, datetime(2024, 7, 1))], "k int, ts timestamp_ntz")
    assert [r["ts"] for r in calendar.localise(df, "ts", tr).orderBy("k").collect()] == [datetime(2024, 10, 6, 3), None, datetime(2024, 7, 1)]


def test_calendar_words():
    assert [calendar.normalise_freq(x) for x in ("half hour", "2 days", "Hourly", "15 min", "odd", None)] == ["30min", "2D", "1H", "15min", "odd", None]
    assert calendar.regions_of(["Sydney", "nsw", "xx"]) == ["NSW1", "XX"] and calendar.metrics_of(["spot price", "load", "foo"]) == ["RRP", "TOTALDEMAND"]
    assert calendar.salvage_json('say {"a": 1} end') == {"a": 1} and calendar.salvage_json("no") is None and calendar.salvage_json("no", 5) == {"text": "no"}
    assert calendar.schema_errors({"a": "x"}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "integer"}}}) == ["$.b: missing", "$.a: expected integer"]
    assert len(calendar.concrete_dates(Filters(date_start="2024-02-27", date_end="2024-03-01"))) == 4
    assert calendar.concrete_dates(Filters(years=(2024,), months=(2,), days=(29, 30))) == [datetime(2024, 2, 29).date()]
    f = calendar.parse_request("demand in Brisbane on Christmas, 2024-12-25 in the late evening")
    assert f.groups == ("QLD1",) and f.times == ("21:00:00",) and f.holidays and f.weekdays == ("wednesday",)
    assert calendar.sector_of("electricity demand") == "Energy" and calendar.sector_of("zzz") == "Undetected"


@pytest.mark.parametrize("said,want", [
    ("- 2025/09/22 02:00:00 : TOTALDEMAND=5873.17 and RRP=54.29", [("RRP", 54.29), ("TOTALDEMAND", 5873.17)]),
    ("On June 3, 2025 at 2:30 PM demand: 7.2 GW, price about $45.10/MWh.", [("RRP", 45.1), ("TOTALDEMAND", 7200.0)]),
    ("| Time | Value | Unit |\n|---|---|---|\n| 2025-06-01 10:00 | 7,012.5 | MW |\n| 2025-06-01 10:00 | 55.1 | $/MWh |\n\nRationale\nlast year 1 MW", [("RRP", 55.1), ("TOTALDEMAND", 7012.5)]),
    ("nothing here", []),
    (None, []),
])
def test_forecast_texts(said, want):
    assert [(m, v) for m, v, _ in parse.parse(said)] == want


def test_point_question_takes_the_last_value():
    at = datetime(2025, 1, 1, 5)
    assert parse.parse("demand: 5 MW then demand: 6 MW", at) == [("TOTALDEMAND", 6.0, at)]


def test_p_values(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (3.0,), (5.0,)], "z double").select(evaluate._p_normal(F.col("z"))).collect()]
    import math

    assert all(abs(g - math.erfc(abs(z) / math.sqrt(2))) < 1e-9 for g, z in zip(got, (0.0, 1.96, 3.0, 5.0)))


def test_repeated_truth_raises(spark):
    p, t = spark.createDataFrame([(1, 2.0)], "query_id int, prediction double"), spark.createDataFrame([(1, 2.0), (1, 3.0)], "query_id int, ground_truth double")
    with pytest.raises(ValueError):
        evaluate.with_truth(p, t)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.lit("m").alias("model"), F.col("id").alias("query_id"), (F.col("id") % 10).cast("double").alias("error"))
    r = evaluate.bootstrap(df).first()
    assert r["lo"] < r["mae"] == 4.5 < r["hi"] and r["hi"] - r["lo"] < 1


def test_csv_roundtrip_and_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text("REGION,SETTLEMENTDATE,TOTALDEMAND,RRP,PERIODTYPE\nNSW1,2025/01/01 00:05:00,1.5,x,TRADE\nNSW1,2025/01/01 00:05:00,2.5,3,TRADE\n")
    df = readings.read_readings(spark, str(tmp_path / "a.csv"))
    assert df.where("RRP is null").count() == 1 and df.first()["source_file"] == "a.csv"
    assert readings.merge([df], ("REGION", "SETTLEMENTDATE"), ("source_file", "TOTALDEMAND"), "SETTLEMENTDATE").count() == 1
    (tmp_path / "q.json").write_text('{"queries": [{"text": "x"}, {"text": "y"}]}')
    assert [r["id"] for r in readings.read_queries(spark, str(tmp_path / "q.json")).orderBy("id").collect()] == ["q_0000", "q_0001"]
    readings.append_runs(spark.createDataFrame([("e", 1)], "exp_id string, n int"), str(tmp_path / "runs"))
    assert readings.read_results(spark, str(tmp_path / "runs/results_csv")).count() == 1


def test_pipeline_with_a_replay_client(series):
    log = clients.CallLog(clients.ReplayClient(rule=lambda m: "it will be so"), "forecast")
    a = pipeline.answer(series, SPEC, "value tomorrow at 2024-03-15 10:00", client=log, flags=Flags(patterns=False))
    assert a.route == "short_term" and a.text == "it will be so" and len(log.calls) == 1
    assert a.forecast.count() == 2 and "basic" in a.stats
    assert clients.chat_json(clients.ReplayClient(rule=lambda m: "no" if len(m) < 3 else '{"a": 1}'), [{"role": "user", "content": "q"}], {"type": "object", "required": ["a"]}) == {"a": 1}
    runs = pipeline.run_ablations(series.sparkSession, series, SPEC, [{"id": "q", "text": "x on 2024-03-15"}], {"full": Flags(), "direct": Flags(direct_only=True)})
    assert runs.where("error = ''").count() == 2


def test_texts(spark):
    df = spark.createDataFrame([("{'RRP': [[1.5, '2025/01/01 00:00:00'], [nan, '2025/01/01 01:00:00']]}",)], "p string")
    assert df.select(text.values_of(F.col("p"), "RRP")).first()[0] == [1.5, None]
    assert df.select(text.main_answer(F.lit('{"answer": "x"}'))).first()[0] == "x"
    assert df.select(text.compact(F.lit('{"a":  1.23456}'))).first()[0] == "a: 1.23"


def test_streaming_chunks(spark, sf, tmp_path):
    from tidemark.streaming import chunks as stream

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = stream.chunk_stats(stream.read_events(spark, str(tmp_path / "in"), e.schema), "ts", "event_type", "value", late="60 days")
    q = s.writeStream.format("memory").queryName("chunk_stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunk_stats").agg(F.sum("n")).first()[0] == e.count()


def test_rolling_z_of_ties_and_constants(spark):
    t = datetime(2024, 3, 1)
    rows = [("c", "v", t + timedelta(hours=k), 1e9 + 7.0) for k in range(300)] + [("d", "v", t + timedelta(hours=k // 3), float(k % 3)) for k in range(300)]
    got = patterns.rolling_z(spark.createDataFrame(rows, "series string, metric string, ts timestamp_ntz, value double")).collect()
    assert all(r["z"] is None for r in got if r["series"] == "c") and len(got) == 600
    d = [r for r in got if r["series"] == "d"]
    assert {r["n"] for r in d} == {3 * (min(k, 167) + 1) for k in range(100)} and sum(abs(r["z"]) for r in d if r["value"] == 1.0 and r["z"] is not None) < 1e-6


def test_places_of_rows_over_blocks(spark):
    t = datetime(2024, 3, 1)
    rows = [(k % 3 if k % 3 else None, t + timedelta(days=(k * 7) % 50) if k % 11 else None, k) for k in range(300)]
    got = resample.numbered(spark.createDataFrame(rows, "g int, ts timestamp_ntz, k int"), "ts", ("g",), then=("k",)).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["ts"] is not None, r["ts"] or t, r["k"]))
        assert [r["time_idx"] for r in own] == list(range(len(own)))


def test_seasonal_naive_equals_brute_force(spark):
    import random

    rng, t = random.Random(3), datetime(2024, 1, 1)
    history = [(rng.choice("ab"), t + timedelta(minutes=rng.randrange(60 * 24 * 60)), float(k)) for k in range(2500)]
    history = list({(g, at): (g, at, v) for g, at, v in history}.values())
    targets = [(g, k, t + timedelta(days=rng.randrange(5, 60), hours=rng.randrange(24), minutes=rng.choice((0, 10, 30, 45)))) for k in range(60) for g in "ab"]
    want = {}
    for g, k, at in targets:
        hour = [(h, v) for x, h, v in history if x == g and h < at and h.hour == at.hour]
        week = [(h, v) for h, v in hour if h.weekday() == at.weekday() and abs(h.minute - at.minute) <= 30]
        want[g, k] = max(week or hour or [(None, None)])[1]
    df = baselines.seasonal_naive(spark.createDataFrame(history, "g string, ts timestamp_ntz, value double"), spark.createDataFrame(targets, "g string, target_id long, ts timestamp_ntz"), ("g",), cfg=ScanConfig(300, 16))
    assert {(r["g"], r["target_id"]): r["prediction"] for r in df.collect()} == want


@pytest.mark.parametrize("said,want", [
    ("Demand on 3 Sep 2025, 14:00 → 5,100 MW", [("TOTALDEMAND", 5100.0)]),
    ("On Sept 3 nothing.\nOn Sep. 3rd, 2025 at 2:00 PM I forecast 5 GW. Historically it was 4 GW.", [("TOTALDEMAND", 5000.0)]),
    ("# Evidence\n2025-09-03 14:00: 1 MW\n## Forecast\nTime: 2025/09/03 15:00\nTOTALDEMAND: 5000 MW\nRRP: $45", [("RRP", 45.0), ("TOTALDEMAND", 5000.0)]),
    ("## Forecast | 2025-09-03 15:00 | 5000 MW | 45 $/MWh |", [("RRP", 45.0), ("TOTALDEMAND", 5000.0)]),
])
def test_forecasts_as_models_write_them(said, want):
    assert [(m, v) for m, v, _ in parse.parse(said)] == want


def test_provider_requests_and_responses():
    spec = clients.ModelSpec("m", roles="apart", json_answers=False, extra={"effort": "low"})
    said = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}, {"role": "user", "content": "again"}]
    sent = []
    answers = [{"candidates": [{"content": {"parts": []}, "finish_reason": 2}]}, {"candidates": [{"content": {"parts": []}, "finish_reason": "MAX_TOKENS"}]}, {"candidates": [{"content": {"parts": [{"text": "o"}, {"text": "k "}]}, "finish_reason": 1}]}]

    def send(request):
        sent.append(request)
        return answers[len(sent) - 1]

    assert clients.chat(clients.ProviderClient(spec, send), said, max_tokens=9, as_json=True) == "ok"
    assert [r["max_tokens"] for r in sent] == [9, 65_536, 16_384] and sent[0]["system_instruction"] == "be brief" and "response_format" not in sent[0]
    assert [c["role"] for c in sent[0]["contents"]] == ["user", "model", "user"] and sent[2]["contents"] == [{"role": "user", "parts": ["be brief\n\nagain"]}]
    plain = clients.request_of(clients.ModelSpec("m"), said, as_json=True)
    assert plain["messages"] == said and plain["response_format"] == {"type": "json_object"}
    for response, want in (({"choices": [{"message": {"content": " a "}}]}, "a"), ({"choices": [{"text": "b"}]}, "b"), ({"choices": [{"delta": {"content": "c"}}]}, "c"), ({"choices": [{"message": {"content": [{"text": "d"}, "e"]}}]}, "de"), ({}, "")):
        assert clients.response_text(response)[0] == want
    with pytest.raises(clients.Empty):
        clients.ProviderClient(spec, lambda r: {"choices": []}).chat(said)


def test_summaries_in_words_and_reports(series, tmp_path):
    import json as js

    from tidemark.plans import prompts, reports

    chunked = chunks.by_time(series.where("k < 100"), "ts", 24, ("g",))
    chunk, per_origin, _ = chunks.summarise(chunked, "ts", "v", "g")
    asked = []

    def rule(messages):
        asked.append(messages)
        return js.dumps({"headlines": ["h"], "bullets": ["b"], "origin": "x"})

    told = prompts.narrate(clients.ReplayClient(rule=rule), chunk, per_origin, None, "g")
    assert prompts.as_text(told) == "Overall: h\na: b\nb: b" and len(asked) == 5 + 5 + 2 + 1 and prompts.as_text({}) == "No summaries."
    asked.clear()
    less = prompts.narrate(clients.ReplayClient(rule=rule), chunk, per_origin, None, "g", chunks_each=2, origins=1)
    assert less["left_out"] == {"origins": 1, "anomalies": 0, "chunks": {"a": 3}} and len(asked) == 2 + 1 + 1 and '"chunks": 3' in asked[2][1]["content"] and '"origins": 1' in asked[3][1]["content"]
    every = prompts.narrate(clients.ReplayClient(rule=rule), chunk, per_origin, None, "g", chunks_each=None, origins=None)
    assert every["left_out"] == {"origins": 0, "anomalies": 0, "chunks": {}} and len(every["per_origin"]) == 2
    assert len(prompts.shortened(list(range(10_000)), 200)) < 230 and js.loads(prompts.shortened({"a": [1], "b": "x"}, 100)) == {"a": [1], "b": "x"}
    table = per_origin.select("g", "n", F.lit(0.5).alias("x_1"))
    assert reports.text_table(table, "T", ("g",)).splitlines()[4].split() == ["a", "50", "0.5000"]
    assert r"a & 50 & 0.5000 \\" in reports.latex_table(table, "C", "t", ("g",)) and r"x\_1" in reports.latex_table(table, "C", "t", ("g",))
    reports.main(["dataset_now", "/root/testdata/sf0.001", "--out", str(tmp_path / "r")])
    assert (tmp_path / "r" / "dataset_now.txt").read_text().startswith("dataset_now")
    assert reports.seeded(5).random() == reports.seeded(5).random()


def test_ablation_records_and_traces(spark, series, tmp_path):
    asked = [{"id": "q1", "text": "demand tomorrow"}, {"id": "q2", "text": "price in Sydney"}]
    client = clients.ReplayClient(rule=lambda m: "said", model="m")
    runs = pipeline.run_ablations(spark, series, SPEC, asked, {"all": Flags(), "direct": Flags(direct_only=True)}, (1, 2), client, {"m": (1.0, 1.0)}, str(tmp_path / "t"))
    got = runs.collect()
    assert [r["run_id"] for r in got] == [f"{e}-{s}-{q}" for e in ("all", "direct") for s in (1, 2) for q in ("q1", "q2")]
    assert all(r["answer"] == "said" and r["tokens_in"] > 0 and r["cost_usd"] > 0 and not r["error"] for r in got if r["query_id"] == "q1")
    assert all("no rows" in r["error"] for r in got if r["query_id"] == "q2") and spark.read.text(str(tmp_path / "t")).count() == 8


def test_question_generators():
    bins = {"morning": ("09:00:00", 60), "night": ("22:00:00", 60)}
    point = readings.point_questions("2025-01-01", {"NSW1": "Sydney"}, bins, 7)
    times = [datetime.strptime(q["timestamp"], "%Y/%m/%d %H:%M:%S") for q in point]
    assert len(point) == 14 and all(t.minute in (0, 30) and t.second == 0 for t in times) and [t.weekday() >= 5 for t in times] == ([False] * 6 + [True]) * 2
    assert point == readings.point_questions("2025-01-01", {"NSW1": "Sydney"}, bins, 7)
    assert all("hourly" in q["id"] for q in readings.hourly_questions("2025-01-01", {"A": "a", "B": "b"}, (24, 48)))
    assert readings.half_hour(datetime(2025, 1, 1, 23, 45)) == datetime(2025, 1, 2)
    assert calendar.is_holiday(datetime(2022, 12, 27).date()) and calendar.is_holiday(datetime(2025, 4, 18).date()) and not calendar.is_holiday(datetime(2025, 4, 17).date())


def test_evidence_bundle(series):
    out = patterns.bundle(series, SPEC)
    assert {"labels", "thumbnail", "anomalies", "profile_hour_v"} <= set(out) and out["labels"].count() == 2 and out["profile_hour_v"].count() == 24


def test_quantiles_of_ties_nulls_and_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.standard_normal(1001).tolist(), "b": [5.0] * 30, None: [1.0, 2.0, 1e12], "d": rng.integers(0, 4, 500).astype(float).tolist(), "e": [7.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    got = {r["g"]: r["q"] for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ("g",), (1, 25, 50, 99)).collect()}
    assert set(got) == set(groups) and all(np.allclose(got[g], np.percentile(vs, (1, 25, 50, 99))) for g, vs in groups.items())
    assert stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", (), (50,)).count() == 1


def test_kalman_likelihood_equals_a_dense_one():
    import numpy as np

    rng = np.random.default_rng(4)
    for phi, theta, big, season in ((0.5, 0.3, -0.4, 4), (-0.7, 0.6, 0.5, 3), (0.2, -0.9, 0.8, 6), (0.0, 0.0, 0.0, 5)):
        w = rng.standard_normal(70)
        ar = baselines._companion(phi, big, season)
        psi = np.zeros(3000)
        for k in range(3000):
            psi[k] = (k == 0) + theta * (k == 1) + sum(c * psi[k - j] for j, c in enumerate(ar, 1) if c and k >= j)
        gamma = np.array([psi[: 3000 - k] @ psi[k:] for k in range(70)])
        cov = gamma[np.abs(np.subtract.outer(np.arange(70), np.arange(70)))]
        s2 = w @ np.linalg.solve(cov, w) / 70
        dense = -0.5 * (70 * np.log(2 * np.pi * s2) + np.linalg.slogdet(cov)[1] + 70)
        assert abs(baselines.log_likelihood(w, phi, theta, big, season) - dense) < 1e-6
        v, f = baselines.kalman_errors(w, phi, theta, big, season)
        assert abs((v * v / f).sum() - w @ np.linalg.solve(cov, w)) < 1e-6


def test_seasonal_model_inside_and_behind_the_sample(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=30 * k), 100 + 0.1 * k + k % 48) for k in range(400)] + [("b", start, 1.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, value double")
    asked = [(g, k, start + timedelta(minutes=30 * k + 10)) for g in "abc" for k in (-5, 10, 60, 200, 398, 399, 400, 450)]
    targets = spark.createDataFrame(asked, "g string, target_id long, ts timestamp_ntz")
    got = {(r["g"], r["target_id"]): r["prediction"] for r in baselines.sarima_at(df, targets, ("g",)).collect()}
    assert len(got) == 24 and all(got[g, k] is None for g, k in got if g != "a") and got["a", 10] is None and got["a", -5] is None
    for k in (60, 200, 398, 400, 450):
        assert abs(got["a", k] - (100 + 0.1 * k + k % 48)) < 1e-3
    both = baselines.run(df, targets.where("g = 'a'"), df, ("g",), seasonal_model=True)
    assert {"persistence", "seasonal_naive", "sarima", "ground_truth"} <= set(both.columns) and both.count() == 8


def test_drawn_bootstrap_agrees_with_a_plain_one(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    values = {"m": rng.exponential(2, 700), "k": rng.standard_normal(40)}
    df = spark.createDataFrame([(m, k, float(v)) for m, vs in values.items() for k, v in enumerate(vs)], "model string, query_id long, error double").repartition(5)
    cfg = EvaluationConfig(resamples=1500)
    got = {r["model"]: r for r in evaluate.bootstrap(df, cfg=cfg, rows_each=60).collect()}
    assert got["m"]["lo"] == {r["model"]: r for r in evaluate.bootstrap(df.repartition(3), cfg=cfg, rows_each=60).collect()}["m"]["lo"]
    for m, vs in values.items():
        ends = []
        for seed in range(12):
            draws = np.random.default_rng(seed).choice(np.abs(vs), (1500, len(vs)))
            ends.append([*np.percentile(draws.mean(axis=1), (2.5, 97.5)), *np.percentile(np.sqrt((draws**2).mean(axis=1)), (2.5, 97.5))])
        middle, spread = np.mean(ends, axis=0), np.std(ends, axis=0)
        own = [got[m][c] for c in ("lo", "hi", "rmse_lo", "rmse_hi")]
        assert got[m]["n"] == len(vs) and np.all(np.abs(own - middle) < 5 * spread + 1e-9), (own, middle, spread)


def test_incremental_ingest_restarts_and_keeps_first_rows(spark, tmp_path):
    from tidemark.streaming import ingest

    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("REGION,SETTLEMENTDATE,TOTALDEMAND,RRP,PERIODTYPE\n" + "".join(f"{r},{t},{d},{p},TRADE\n" for r, t, d, p in rows))

    def state():
        ingest.ingest_new(spark, folder, out, checkpoint, max_files=1)
        return sorted((r["REGION"], str(r["SETTLEMENTDATE"]), r["TOTALDEMAND"], r["RRP"], r["source_file"]) for r in ingest.readings_of(spark, out).collect())

    put("b.csv", [("NSW1", "2025/01/01 00:30:00", 5, 1), ("NSW1", "2025/01/01 00:30:00", 4, 1), ("VIC1", "2025/01/01 00:30:00", 7, "n/a"), ("VIC1", "soon", 1, 1)])
    first = state()
    assert first == [("NSW1", "2025-01-01 00:30:00", 4.0, 1.0, "b.csv"), ("VIC1", "2025-01-01 00:30:00", 7.0, None, "b.csv")]
    assert state() == first  # nothing new
    put("c.csv", [("NSW1", "2025-01-01 00:30", 99, 9), ("VIC1", "2025/01/01 00:30:00", 98, 9)])
    assert state() == first  # the same keys again
    put("a.csv", [("TAS1", "2024/12/01 00:00:00", 2, 2), ("NSW1", "2025/01/01 00:30:00", 1, 1)])
    late = state()
    assert late == sorted([*first, ("TAS1", "2024-12-01 00:00:00", 2.0, 2.0, "a.csv")])
    again = spark.read.schema(readings.READINGS).option("header", True).csv(f"{folder}/a.csv").withColumn("source_file", F.lit("a.csv"))
    ingest.merge_batch(again, 2, out)  # the last batch once more, as after a failure
    assert state() == late
    asked = spark.createDataFrame([("https://x/a.csv",), ("https://x/z.csv",)], "url string")
    assert [(r["file_path"], r["success"]) for r in ingest.report(asked, out, "/d").orderBy("url").collect()] == [("/d/a.csv", True), ("/d/z.csv", False)]
    assert not ingest.report(asked, str(tmp_path / "none"), "/d").where("success").count()


def test_tables_of_requests(spark):
    from tidemark.functions import requests

    said = ["demand in Brisbane on Christmas, 2024-12-25 in the late evening", None, "", "Hourly spot price in New South Wales and Victoria at 09:30 from March 2, 2024 to March 3, 2024", "load the next 3 days"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(said)], "id int, text string, groups string")
    got = {r["id"]: r for r in requests.request_columns(df).collect()}
    assert len(got) == 5 and got[0]["groups"] == ["QLD1"] and got[0]["holidays"] and got[0]["target_start"] == datetime(2024, 12, 25, 21) and got[0]["vague_tolerance"] > 0
    assert got[1]["groups"] == got[2]["metrics"] == [] and got[1]["target_start"] is None and got[4]["horizon_steps"] == 3
    assert (got[3]["target_start"], got[3]["target_end"], got[3]["freq"], len(got[3]["dates"])) == (datetime(2024, 3, 2, 9, 30), datetime(2024, 3, 3, 9, 30), "1H", 2)
    assert requests.request_columns(df.where("false")).count() == 0
    a = requests.answers(df.select("id", F.lit('x {"a": [1, "b"]} y').alias("t")), "t", {"type": "object", "required": ["c"]}).first()
    assert a["object"] == '{"a": [1, "b"]}' and a["errors"] == "$.c: missing"


def test_sequence_model_beats_the_season_before(spark):
    import numpy as np

    from tidemark.operators import sequence
    from tidemark.spec import SequenceConfig

    rng, start = np.random.default_rng(1), datetime(2024, 1, 1)
    curve = lambda g, k: 50 * (g + 1) + 10 * np.sin(2 * np.pi * k / 24) + 4 * ((k // 24) % 7 >= 5)
    rows = [(f"s{g}", start + timedelta(hours=int(k)), float(curve(g, k) + 3 * rng.standard_normal())) for g in range(3) for k in range(24 * 60)]
    history = spark.createDataFrame(rows, "g string, ts timestamp_ntz, value double")
    asked = [(f"s{g}", k, start + timedelta(hours=24 * 60 + k)) for g in range(3) for k in range(0, 160, 3)]
    targets = spark.createDataFrame(asked, "g string, target_id long, ts timestamp_ntz")
    truth = {(f"s{g}", k): curve(g, 24 * 60 + k) for g in range(3) for k in range(0, 160, 3)}
    cfg = SequenceConfig(samples=2500, epochs=6)
    own = {(r["g"], r["target_id"]): r for r in sequence.predict(history, targets, ("g",), cfg).collect()}
    naive = {(r["g"], r["target_id"]): r["prediction"] for r in baselines.seasonal_naive(history, targets, ("g",)).collect()}
    error = lambda p: np.mean([abs(p[k] - truth[k]) for k in truth])
    assert len(own) == len(truth) and all(r["lower"] <= r["prediction"] <= r["upper"] for r in own.values())
    assert error({k: r["prediction"] for k, r in own.items()}) < 0.7 * error(naive)
    short = history.where("ts < '2024-01-03'")
    assert sequence.predict(short, targets, ("g",), cfg).where("prediction is not null").count() == 0


def test_sequence_gradients():
    import numpy as np

    from tidemark.operators.sequence import Network
    from tidemark.spec import SequenceConfig

    rng = np.random.default_rng(0)
    net, x, y = Network(19, SequenceConfig(hidden=4)), rng.standard_normal((50, 19)), rng.standard_normal(50)
    _, g = net.gradients(x, y)
    for k, w in net.w.items():
        at, step = tuple(0 for _ in w.shape), 1e-6
        w[at] += step
        up = net.gradients(x, y)[0]
        w[at] -= 2 * step
        down = net.gradients(x, y)[0]
        w[at] += step
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-5


@pytest.mark.parametrize("said,want", [
    ("At 2025-06-01 10:00 demand 5000 MW; at 2025-06-01 11:00 demand 5100 MW.", [(5000.0, 10), (5100.0, 11)]),
    ("5000 MW at 2025-06-01 10:00 and 5.1 GW at 2025-06-01 11:00", [(5000.0, 10), (5100.0, 11)]),
    ("2025-06-01 10:00\nload: 5000 MW\n" + "x" * 300 + "\nload: 5100 MW\n2025-06-01 11:00", [(5000.0, 10), (5100.0, 11)]),
    ("2025-06-01 10:00 then\n" + "y" * 400 + "\nload: 5000 MW\n" + "z" * 400 + "\n2025-06-01 11:00: 5100 MW", [(5000.0, 10), (5100.0, 11)]),
    ("load: 5000 MW, as said", []),
])
def test_times_nearest_to_values(said, want):
    assert [(v, at.hour) for _, v, at in parse.parse(said)] == want


def test_sets_of_questions_share_files(spark, tmp_path):
    sets = spark.range(0, 400, 1, 2).selectExpr("id AS part", "array(named_struct('id', string(null), 'text', concat('a\n', id)), named_struct('id', 'own', 'text', 'b')) AS queries")
    readings.write_query_sets(sets, str(tmp_path / "sets"))
    assert len(list((tmp_path / "sets").rglob("*.json"))) == 2
    got = readings.read_queries(spark, str(tmp_path / "sets"), "part long, queries array<struct<id:string,text:string>>")
    assert {(r["part"], r["id"], r["text"]) for r in got.collect()} == {x for k in range(400) for x in ((k, "q_0000", f"a\n{k}"), (k, "own", "b"))}


def test_a_request_that_repeats_is_parsed_once(spark):
    from tidemark.functions import requests

    requests._asked.cache_clear()
    assert {requests._asked("load for Hobart the next 6 hours", False)[12] for _ in range(50)} == {6} and requests._asked.cache_info().misses == 1
    df = spark.range(0, 600, 1, 2).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'price in Sydney on 2024-03-02' WHEN 1 THEN 'load' END AS text")
    got = requests.request_columns(df).groupBy("text", "groups", "metrics", "date_start").count().collect()
    assert {(r["text"], *r["groups"], *r["metrics"], r["date_start"], r["count"]) for r in got} == {("price in Sydney on 2024-03-02", "NSW1", "RRP", "2024-03-02", 200), ("load", "TOTALDEMAND", None, 200), (None, None, 200)}


def test_blanks_before_a_value_cost_no_more_than_their_number(spark):
    import time

    began = time.process_time()
    assert parse.values_in("demand" + " " * 20 + "1,000 MW;" + " " * 30_000 + "x ~ 7 MW") == [(26, "TOTALDEMAND", 1000.0), (30_039, "TOTALDEMAND", 7.0)]
    assert time.process_time() - began < 1
    rows = [(1, "At 2024-03-05 10:30 demand 1000 MW; on 5 Mar 2024, 2:00 PM a load of 2 GW."), (2, None), (3, "nothing")]
    got = parse.parse_column(spark.createDataFrame(rows, "k int, answer string")).drop("answer").collect()
    assert sorted(map(tuple, got)) == [(1, "TOTALDEMAND", 1000.0, datetime(2024, 3, 5, 10, 30)), (1, "TOTALDEMAND", 2000.0, datetime(2024, 3, 5, 14))]
