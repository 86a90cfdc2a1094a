"""Retrieval for a table of questions: any number of anchors in one pass over the readings.

Questions expand to labelled windows by expressions, windows to the time buckets they touch; readings meet them by bucket and group in an equi-join, and exact bounds
decide. A reading is sent once (twice where some questions name groups and others take all), so the work is that of the readings and of what is found.
Windows of few buckets are broadcast, where their number has been counted; more are joined by shuffling, with skewed buckets split at run time.

A question: question_id; route; and optionally anchor (null: the latest time of its groups), groups (null or empty: all), times (HH:MM[:SS]), target_start,
target_end, freq. Questions without a row in their groups get no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import freq_column
from ..plans.windows import BLOCKS, ROUTES, SPANS
from ..spec import RetrievalConfig, SeriesSpec
from . import stats
from .ordered import micros

QUESTION = {"question_id": None, "route": "string", "anchor": "timestamp_ntz", "groups": "array<string>", "times": "array<string>", "target_start": "timestamp_ntz", "target_end": "timestamp_ntz", "freq": "string"}
LABELS = ("ret_block", "block_rank", "lag", "prior_year", "lag_days", "prior_woy")
#: Rows of windows by bucket that are broadcast at most, some 150 bytes each.
BROADCAST_ROWS = 100_000
#: Parts of a question in which its best rows are looked for first.
PARTS = 64
_ALL = "\x00all"


@dataclass
class Evidence:
    """What is found for all questions: labelled rows, counts by block, best rows."""

    rows: DataFrame
    counts: DataFrame
    combined: DataFrame
    windows: DataFrame


def normalised(questions: DataFrame) -> DataFrame:
    """The columns of QUESTION, absent ones null, group names in capitals."""
    cast = lambda c, t: F.col(c) if t is None else F.col(c).cast(t) if c in questions.columns else F.lit(None).cast(t)
    own = questions.select(*[cast(c, t).alias(c) for c, t in QUESTION.items()])
    return own.withColumn("groups", F.when(F.size("groups") > 0, F.transform("groups", F.upper)))


def anchored(questions: DataFrame, df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """A null anchor becomes the latest time of the question's groups, from one aggregate by group; questions with none go."""
    group = F.upper(F.col(spec.group)) if spec.group else F.lit("all")
    latest = df.groupBy(group.alias("_group")).agg(F.max(spec.ts).cast("timestamp_ntz").alias("_latest"))
    named = questions.where("anchor is null and groups is not null").select("question_id", F.explode("groups").alias("_group"))
    own = named.join(latest, "_group").groupBy("question_id").agg(F.max("_latest").alias("_own"))
    every = latest.agg(F.max("_latest").alias("_every"))  # one row
    found = questions.join(own, "question_id", "left").crossJoin(F.broadcast(every))
    anchor = F.coalesce("anchor", F.when(F.col("groups").isNull(), F.col("_every")).otherwise(F.col("_own")))
    return found.withColumn("anchor", anchor).where("anchor is not null").drop("_own", "_every")


def _years_back(t: Column, n: Column) -> Column:
    """29 February becomes the 28th."""
    return t - F.make_ym_interval(n, F.lit(0))


def _midnight(t: Column) -> Column:
    return t.cast("date").cast("timestamp_ntz")


def _on_day(t: Column, day: Column) -> Column:
    """t on that day of its month."""
    return t + F.make_dt_interval(day - F.dayofmonth(t))


def _days(n) -> Column:
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def windows(questions: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(question_id, anchor, groups, ..., ret_block, block_rank, lag, lo, hi, prior_year, lag_days, prior_woy) for each window of each question."""
    anchor, start, end = F.col("anchor"), F.col("target_start"), F.col("target_end")
    base = F.coalesce(start, anchor)
    tol = F.expr(f"make_dt_interval(0, 0, {cfg.time_tolerance_minutes})")
    day_end = F.expr("make_dt_interval(0, 23, 59, 59)")

    def row(block: str, lag: Column, lo: Column, hi: Column, **labels: Column) -> Column:
        given = {c: labels[c] if c in labels else F.lit(None).cast("int") for c in ("prior_year", "lag_days", "prior_woy")}
        return F.struct(F.lit(block).alias("ret_block"), F.lit(BLOCKS.index(block)).alias("block_rank"), lag.cast("int").alias("lag"), lo.cast("timestamp_ntz").alias("lo"), hi.cast("timestamp_ntz").alias("hi"), *[c.cast("int").alias(n) for n, c in given.items()])

    def whole(block: str, lag: Column, lo: Column, hi: Column, **labels: Column) -> Column:
        return row(block, lag, _midnight(lo), _midnight(hi) + day_end, **labels)

    def each(n: int, make) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), make)

    name = freq_column(F.col("freq"))
    known = {k: v for k, v in SPANS.items() if not (cfg.compat and k in ("1H", "1D"))}
    hours = F.coalesce(*[F.when(name == k, int(v.total_seconds() // 3600)) for k, v in known.items()], F.lit(24 * cfg.safe_default_recent_days))
    sameweek = cfg.sameweek_days

    def months(block: str, years: int, buffer: int) -> Column:
        day = F.dayofmonth(base)
        return each(years, lambda i: whole(block, i, _on_day(_years_back(base, i), F.greatest(F.lit(1), day - buffer)), _on_day(_years_back(base, i), F.least(F.lit(28), day + buffer)), prior_year=F.year(_years_back(base, i))))

    def same_week(i: Column) -> Column:
        ref = _on_day(_years_back(base, i), F.least(F.lit(28), F.dayofmonth(base)))
        span = F.greatest(_days(sameweek), F.when(start.isNotNull() & end.isNotNull(), end - start).otherwise(_days(0)))
        return whole("prior_years_same_week", i, ref - _days(sameweek), ref + span, prior_year=F.year(ref))

    def same_woy(i: Column) -> Column:
        ref = _on_day(_years_back(base, i), F.least(F.lit(28), F.dayofmonth(base)))
        return row("same_woy_prior_years", i, ref - _days(3) - tol, ref + _days(3) + tol, prior_woy=F.weekofyear(ref))

    def weekdays(n: int) -> Column:
        return each(n, lambda w: row("same_weekday_recent_weeks", w, base - _days(7 * w + 1) - tol, base - _days(7 * w - 1) + tol))

    recent = lambda back: F.array(whole("recent_window", F.lit(0), anchor - back, anchor))
    of = {
        "recent_window": lambda r: recent(F.make_dt_interval(F.lit(0), hours) if r == "short_term" else _days(7 * cfg.mid_rolling_weeks_back)),
        "same_hour_previous_days": lambda r: each(cfg.same_hour_back_days, lambda d: row("same_hour_previous_days", d, base - _days(d) - tol, base - _days(d) + tol, lag_days=d)),
        "same_weekday_recent_weeks": lambda r: weekdays(cfg.same_weekday_recent_weeks if r == "short_term" else cfg.mid_same_weekday_hour_profiles_weeks),
        "prior_years_same_dates": lambda r: each(cfg.previous_years, lambda i: row("prior_years_same_dates", i, _years_back(base, i), _years_back(F.coalesce(end, base), i), prior_year=F.year(_years_back(base, i)))),
        "prior_years_same_week": lambda r: each(cfg.previous_years, same_week),
        "same_month_prev_years": lambda r: months("same_month_prev_years", cfg.mid_same_month_prev_years, cfg.mid_same_month_buffer_days) if r == "mid_term" else months("same_month_prev_years", cfg.long_same_month_years, cfg.long_same_month_buffer_days),
        "same_woy_prior_years": lambda r: each(cfg.woy_years, same_woy),
        "macro_trend_blocks": lambda r: F.array(row("macro_trend_blocks", F.lit(0), _years_back(anchor, F.lit(max(cfg.long_macro_years, 3))), F.lit(None))),
    }
    by_route = [F.when(F.col("route") == r, F.concat(*[of[b](r) for b in blocks])) for r, blocks in ROUTES.items()]
    return questions.withColumn("_w", F.explode(F.coalesce(*by_route))).select(*questions.columns, "_w.*")


def _clock(t: Column) -> Column:
    """HH:MM[:SS] as seconds of the day; null if it is none."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(F.trim(t), r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", k), F.lit("")), F.lit("0") if k == 3 else F.lit(None)).cast("int")
    return F.when((part(1) < 24) & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3))


def score(ts: Column, anchor: Column, weights=RetrievalConfig().weights) -> Column:
    """R18 with a column as anchor."""
    hours = F.abs(F.timestamp_diff("MICROSECOND", ts, anchor)) / F.lit(3_600_000_000.0)
    return F.lit(weights[0]) / (1 + F.log1p(hours)) + F.lit(weights[1]) * (F.hour(ts) == F.hour(anchor)).cast("double") + F.lit(weights[2]) * (F.weekday(ts) == F.weekday(anchor)).cast("double") + F.lit(weights[3])


def matches(df: DataFrame, spec: SeriesSpec, w: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """The rows of df before the anchor in each window of w, once for each window: an equi-join by bucket and group."""
    width = bucket_hours * 3_600_000_000
    last = F.least(F.coalesce("hi", "anchor"), F.col("anchor"))
    own = w.where(F.col("lo") <= last)
    groups = F.coalesce("groups", F.array(F.lit(_ALL)))
    placed = own.withColumns({"_lo": F.floor(micros(F.col("lo")) / width).cast("long"), "_hi": F.floor(micros(last) / width).cast("long")})
    facts = placed.agg(F.min("lo").alias("lo"), F.max("anchor").alias("hi"), F.sum((F.col("_hi") - F.col("_lo") + 1) * F.size(groups)).alias("n"), F.max(F.col("groups").isNull()).alias("all"), F.max(F.col("groups").isNotNull()).alias("some")).first()
    keyed = placed.withColumn("_group", F.explode(groups)).withColumn("_bucket", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    if (facts["n"] or 0) <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    # the envelope of all windows reaches the scan
    ts = F.col(spec.ts)
    rows = df if facts["lo"] is None else df.where((ts >= F.lit(facts["lo"]).cast("timestamp_ntz")) & (ts < F.lit(facts["hi"]).cast("timestamp_ntz")))
    group = F.upper(F.col(spec.group)) if spec.group else F.lit(_ALL)
    keys = [F.lit(_ALL)] * bool(facts["all"]) + [group] * bool(facts["some"])
    sent = rows.withColumn("_group", F.explode(F.array(*keys)) if len(keys) > 1 else keys[0] if keys else F.lit(_ALL)).withColumn("_bucket", F.floor(micros(ts) / width).cast("long"))
    met = sent.join(keyed, ["_bucket", "_group"]).where((ts < F.col("anchor")) & (ts >= F.col("lo")) & (F.col("hi").isNull() | (ts <= F.col("hi"))))
    return met.drop("_bucket", "_group")


def best(found: DataFrame, spec: SeriesSpec, k: int, compat: bool = False) -> DataFrame:
    """R19, R20 for each question: the best row of each time and group (compat: of each time), and of these the k best, with their rank from 1.

    Rows are dealt by question and a hash of what is told apart, so that a question's rows spread over PARTS tasks; the best k of each part meet in the end.
    """
    one = [spec.ts] + ([spec.group] if spec.group and not compat else [])
    order = [F.col("ret_score").desc(), F.col("block_rank"), F.col("lag")] + [F.col(c) for c in (spec.group, spec.key) if c]
    by_score = [F.col("ret_score").desc(), *[F.col(c) for c in (spec.ts, spec.group, spec.key) if c]]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in one]), F.lit(PARTS)).cast("int")
    own = found.withColumn("_part", part).repartition("question_id", "_part")
    told = own.withColumn("_r", F.row_number().over(Window.partitionBy("question_id", "_part", *one).orderBy(*order))).where("_r = 1")
    some = told.withColumn("_r", F.row_number().over(Window.partitionBy("question_id", "_part").orderBy(*by_score))).where(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*by_score))).where(F.col("rank") <= k).drop("_r", "_part")


def retrieve_all(df: DataFrame, spec: SeriesSpec, questions: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), bucket_hours: int = 24) -> Evidence:
    """R22 for a table of questions. The columns of df must not bear the names of QUESTION or LABELS."""
    q = anchored(normalised(questions), df, spec)
    w = windows(q, cfg)
    found = matches(df, spec, w, bucket_hours).withColumn("ret_score", score(F.col(spec.ts), F.col("anchor"), cfg.weights))
    # Prior years near the asked times of day
    second = F.hour(spec.ts) * 3600 + F.minute(spec.ts) * 60 + F.second(spec.ts)
    clocks = F.filter(F.transform("times", _clock), lambda s: s.isNotNull())
    near = F.exists(clocks, lambda s: F.abs(second - s) <= 60 * cfg.time_tolerance_minutes)
    asked = F.col("ret_block").isin("prior_years_same_dates", "prior_years_same_week") & F.col("target_end").isNull() & (F.coalesce(F.size(clocks), F.lit(0)) > 0)
    found = found.where(~F.coalesce(asked, F.lit(False)) | near).select("question_id", "anchor", *LABELS, *df.columns, "ret_score")
    counts = found.groupBy("question_id", "ret_block").agg(F.count(F.lit(1)).alias("n_rows"))
    return Evidence(found, counts, best(found, spec, cfg.max_segments, cfg.compat), w)


def forecasts(found: Evidence, spec: SeriesSpec, questions: DataFrame, tolerance_minutes: int = 30) -> DataFrame:
    """M14 for all questions: (question_id, series, metric, forecast, n_same_slot, n_evidence), the score-weighted mean of the best rows near the target's time of
    day (of all best rows where there are none near, or no target)."""
    target = normalised(questions).select("question_id", "target_start")
    group = F.col(spec.group) if spec.group else F.lit("all")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("value")) for m in spec.metrics])).alias("c")
    long = found.combined.join(target, "question_id").select("question_id", group.alias("series"), F.col(spec.ts).alias("ts"), "target_start", "ret_score", cells).select("*", "c.*")
    minute = lambda t: F.hour(t) * 60 + F.minute(t)
    near = F.coalesce(F.abs(minute("ts") - minute("target_start")) <= tolerance_minutes, F.lit(True))
    v, w = F.col("value"), F.col("ret_score")
    same = stats.weighted_mean(F.when(near, v), w)
    return long.groupBy("question_id", "series", "metric").agg(F.coalesce(same, stats.weighted_mean(v, w)).alias("forecast"), F.sum(near.cast("long")).alias("n_same_slot"), F.count(v).alias("n_evidence"))


__all__ = ["Evidence", "anchored", "best", "forecasts", "matches", "normalised", "retrieve_all", "score", "windows"]
