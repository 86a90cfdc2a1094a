"""Trends, autocorrelation, rolling anomalies, thumbnails, and the labels that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import AnomalyConfig, PatternConfig, SeriesSpec
from . import resample, stats
from .ordered import micros, running_sums

DAY = 86_400_000_000


def rolling_z(long: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """(series, ts, metric, value, n, z) of each row against the last cfg.rolling_days (left open, rows at the same time included).

    A row enters running sums at its time and leaves them one window later, so it costs two additions whatever the window holds. The sums run in
    blocks that follow the rows' density. Values are taken relative to their series' mean, so that little is cancelled.
    """
    width = cfg.rolling_days * DAY
    by = ("series", "metric")
    rows = long.where("value is not null and ts is not null")
    centre = rows.groupBy(*by).agg(F.avg("value").alias("centre"))
    at = micros(F.col("ts"))
    moved = F.explode(F.array(*[F.struct(when.alias("when"), F.lit(sign).alias("sign")) for when, sign in ((at, 1), (at + width, -1))])).alias("e")
    events = rows.select(*by, "ts", "value", moved).join(centre, list(by)).select(*by, "ts", "value", "e.*", (F.col("value") - F.col("centre")).alias("x"))
    sign, x = F.col("sign"), F.col("x")
    sums = running_sums(events, "when", by, {"n": sign.cast("long"), "s": sign * x, "q": sign * x * x}).where("sign > 0")
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    # what is left of equal values after rounding is no deviation
    std = F.when(spread > 1e-12 * F.col("q"), F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0))))
    z = F.when(F.col("n") >= cfg.min_points, F.try_divide(F.col("x") - F.col("s") / F.col("n"), std))
    return sums.select("series", "ts", "metric", "value", F.col("n").cast("long").alias("n"), z.alias("z"))


def anomalies(long: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Rows beyond the threshold, as spikes and drops."""
    return rolling_z(long, cfg).where(F.abs("z") >= cfg.z_threshold).withColumn("type", F.when(F.col("z") > 0, "spike").otherwise("drop"))


def top_anomalies(long: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """The top_k of each series and metric."""
    order = Window.partitionBy("series", "metric").orderBy(F.abs("z").desc(), "ts")
    return anomalies(long, cfg).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.top_k)


def trend(long: DataFrame, min_points: int = PatternConfig().min_trend_points) -> DataFrame:
    """A10: least-squares slope for each hour over hourly means."""
    hourly = resample.bucket_mean(long, "ts", "value", 3600, ("series", "metric"))
    return hourly.groupBy("series", "metric").agg(F.when(F.count("value") >= min_points, F.regr_slope("value", "slot")).alias("slope_per_hour"))


def autocorrelation(long: DataFrame, step_seconds: int, lags_hours: tuple[int, ...] = PatternConfig().acf_lags_hours) -> DataFrame:
    """Biased autocorrelation at hour lags on the regular, interpolated grid; null below 10 points.

    Each slot sends its value to the slots it is a partner of, and a plain sum by slot pairs them: no window over a series.
    """
    by = ("series", "metric")
    grid = resample.regular(long, "ts", "value", step_seconds, by)
    centre = grid.groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    c = grid.join(centre, list(by)).select(*by, "slot", (F.col("value") - F.col("mean")).alias("c"))
    lags = {h: stats.hours_to_steps(h, step_seconds) for h in lags_hours}
    sent = F.explode(F.array(F.struct(F.lit(-1).alias("lag"), F.col("slot").alias("at")), *[F.struct(F.lit(h).alias("lag"), (F.col("slot") + k).alias("at")) for h, k in lags.items()])).alias("e")
    met = c.select(*by, "c", sent).groupBy(*by, F.col("e.at").alias("at")).agg(F.max(F.when(F.col("e.lag") == -1, F.col("c"))).alias("c"), *[F.max(F.when(F.col("e.lag") == h, F.col("c"))).alias(f"c{h}") for h in lags])
    summed = met.groupBy(*by).agg(F.count("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("v"), *[F.sum(F.col("c") * F.col(f"c{h}")).alias(f"s{h}") for h in lags])
    cell = F.explode(F.array(*[F.struct(F.lit(h).alias("lag_hours"), F.when(F.col("n") >= 10, F.try_divide(F.coalesce(f"s{h}", F.lit(0.0)), F.nullif("v", F.lit(0.0)))).alias("acf")) for h in lags])).alias("a")
    return summed.select(*by, cell).select(*by, "a.*")


def thumbnail(long: DataFrame, points: int = PatternConfig().thumbnail_points) -> DataFrame:
    """Every ceil(n / points)-th row of each series."""
    by = ("series", "metric")
    n = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = resample.numbered(long, "ts", by, "place", ("value",)).join(n, list(by))
    return placed.where(F.col("place") % F.greatest(F.lit(1), F.ceil(F.col("n") / points)) == 0).select(*by, "ts", "value")


def first_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The rows of the first k groups by name."""
    names = df.select(group).distinct().orderBy(group).limit(k)  # k names
    return df.join(F.broadcast(names), group, "left_semi")


def labels(long: DataFrame, step_seconds: int = 3600, cfg: PatternConfig = PatternConfig(), anomaly: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Trend direction and strength, daily and weekly season, anomaly counts of each series and metric, by fixed thresholds."""
    by = ["series", "metric"]
    acf = autocorrelation(long, step_seconds, (24, 168)).groupBy(*by).pivot("lag_hours", [24, 168]).agg(F.first("acf"))
    found = anomalies(long, anomaly).groupBy(*by).agg(F.count(F.lit(1)).alias("n_anomalies"))
    s, (weak, moderate, strong), (present, clear) = F.abs("slope_per_hour"), cfg.slope_bounds, cfg.season_bounds
    season = lambda c: F.when(F.col(c) >= clear, "strong").when(F.col(c) >= present, "present").otherwise("absent")
    strength = F.when(s > strong, "strong").when(s >= moderate, "moderate").when(s >= weak, "weak").otherwise("none")
    direction = F.when(F.coalesce(s, F.lit(0.0)) < weak, "flat").when(F.col("slope_per_hour") > 0, "up").otherwise("down")
    all_ = trend(long, cfg.min_trend_points).join(acf, by, "left").join(found, by, "left")
    return all_.select(*by, "slope_per_hour", strength.alias("trend_strength"), direction.alias("trend_direction"), season("24").alias("daily_season"), season("168").alias("weekly_season"), F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"))


def bundle(df: DataFrame, spec: SeriesSpec, step_seconds: int = 3600, cfg: PatternConfig = PatternConfig()) -> dict[str, DataFrame]:
    """The evidence of a series: labels, hourly, weekly and monthly profiles, thumbnail, largest anomalies; of the first cfg.max_groups groups and
    cfg.max_metrics metrics by name."""
    own = first_groups(df, spec.group, cfg.max_groups) if spec.group else df
    spec = SeriesSpec(spec.ts, spec.group, spec.metrics[: cfg.max_metrics], spec.key)
    long = stats.unpivot(own, spec)
    out = {"labels": labels(long, step_seconds, cfg), "thumbnail": thumbnail(long, cfg.thumbnail_points), "anomalies": top_anomalies(long)}
    for part in ("hour", "weekday", "month"):
        out |= {f"profile_{part}_{m}": stats.profile(own, spec.ts, m, part) for m in spec.metrics}
    return out


def by_origin(blocks: DataFrame, spec: SeriesSpec, step_seconds: int = 3600) -> DataFrame:
    """Labels of every retrieval block at once: the block is part of the series' name."""
    named = blocks.withColumn("_series", F.concat_ws("/", "ret_block", spec.group or F.lit("all")))
    return labels(stats.unpivot(named, SeriesSpec(spec.ts, "_series", spec.metrics)), step_seconds)
