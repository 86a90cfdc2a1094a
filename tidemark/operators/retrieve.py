"""Retrieval: one range join against the windows relation, then score, dedupe and trim."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.windows import target_window, windows_of, windows_relation
from ..spec import Filters, RetrievalConfig, RetrievalResult, SeriesSpec
from . import filters as flt


def anchor_of(df: DataFrame, spec: SeriesSpec, wanted=()) -> datetime | None:
    """The latest time (of the wanted groups)."""
    return flt.groups(df, spec.group, wanted).agg(F.max(spec.ts)).first()[0]


def now_iso(df: DataFrame, spec: SeriesSpec) -> str:
    """R2: raises if there is none."""
    found = anchor_of(df, spec)
    if found is None:
        raise ValueError("no usable timestamp")
    return found.isoformat()


def score_of(ts: Column, anchor: datetime, weights=RetrievalConfig().weights) -> Column:
    """R18."""
    a = F.lit(anchor).cast("timestamp_ntz")
    hours = F.abs(F.timestamp_diff("MICROSECOND", ts, a)) / F.lit(3_600_000_000.0)
    return F.lit(weights[0]) / (1 + F.log1p(hours)) + F.lit(weights[1]) * (F.hour(ts) == anchor.hour).cast("double") + F.lit(weights[2]) * (F.weekday(ts) == anchor.weekday()).cast("double") + F.lit(weights[3])


def candidates(df: DataFrame, spec: SeriesSpec, rows: list[tuple], anchor: datetime) -> DataFrame:
    """The rows of df before the anchor in each window, labelled. windows: bounded by the configuration, so they are broadcast."""
    lo = min(r[3] for r in rows)
    envelope = df.where((F.col(spec.ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(spec.ts) < F.lit(anchor).cast("timestamp_ntz")))
    w = F.broadcast(windows_relation(df.sparkSession, rows))
    inside = (F.col(spec.ts) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(spec.ts) <= F.col("hi")))
    return envelope.join(w, inside).drop("lo", "hi")


def dedupe(scored: DataFrame, spec: SeriesSpec, compat: bool = False) -> DataFrame:
    """The best row of each time and group (compat: of each time); ties by block, then group, then key."""
    by = [spec.ts] + ([spec.group] if spec.group and not compat else [])
    order = [F.col("ret_score").desc(), F.col("block_rank"), F.col("lag")] + [F.col(c) for c in (spec.group, spec.key) if c]
    return scored.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def top(scored: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The k best rows."""
    return scored.orderBy(F.col("ret_score").desc(), *[F.col(c) for c in (spec.ts, spec.group, spec.key) if c]).limit(k)


def preview(blocks: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The k best rows of each block."""
    order = [F.col("ret_score").desc()] + [F.col(c) for c in (spec.ts, spec.group, spec.key) if c]
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy("ret_block").orderBy(*order))).where(F.col("rank") <= k)


def retrieve(df: DataFrame, spec: SeriesSpec, route: str = "short_term", f: Filters = Filters(), cfg: RetrievalConfig = RetrievalConfig()) -> RetrievalResult:
    """Labelled rows, counts by block, combined best rows, meta."""
    own = flt.groups(df, spec.group, f.groups)
    anchor = anchor_of(own, spec)
    if anchor is None:
        raise ValueError("no rows for the requested groups")
    start, end = target_window(f, cfg.compat)
    rows = windows_of(anchor, route, cfg, start, end, f.freq)
    found = candidates(own, spec, rows, anchor).withColumn("ret_score", score_of(F.col(spec.ts), anchor, cfg.weights))
    times = flt.times_of(f.times)
    if times and end is None:  # R11
        near = flt.time_of_day_near(F.col(spec.ts), times, cfg.time_tolerance_minutes)
        found = found.where(~F.col("ret_block").isin("prior_years_same_dates", "prior_years_same_week") | near)
    counts = found.groupBy("ret_block").agg(F.count(F.lit(1)).alias("n_rows"))
    combined = top(dedupe(found, spec, cfg.compat), spec, cfg.max_segments)
    meta = {"route": route, "anchor": anchor.isoformat(), "target_start": start and start.isoformat(), "target_end": end and end.isoformat(), "freq": f.freq, "windows": len(rows), "groups": list(f.groups)}
    return RetrievalResult(found, counts, combined, meta, anchor)


def meta_frame(result: RetrievalResult) -> DataFrame:
    """R21 as one row, with the total of the blocks."""
    m = result.meta
    given = {k: F.lit(m[k]).cast("string") for k in ("route", "anchor", "target_start", "target_end", "freq")} | {"windows": F.lit(m["windows"]), "groups": F.lit(",".join(m["groups"]))}
    return result.counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("n_blocks")).withColumns(given)
