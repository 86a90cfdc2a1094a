"""Predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import WEEKDAYS, day_bounds, iso_date, times_of  # noqa: F401
from ..spec import Filters, SeriesSpec


def groups(df: DataFrame, group: str | None, wanted) -> DataFrame:
    """without regard to case; nothing wanted or no such column leaves df as it is."""
    names = [str(w).upper() for w in wanted or ()]
    return df.where(F.upper(F.col(group)).isin(names)) if names and group and group in df.columns else df


def time_of_day_near(ts: Column, times, tolerance_minutes: int) -> Column:
    """within the tolerance of any of times, on the timestamp's own day (no wrap at midnight)."""
    micros = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long") * 1_000_000
    near = [F.abs(micros - (h * 3600 + m * 60 + s) * 1_000_000) <= tolerance_minutes * 60_000_000 for h, m, s in times]
    return reduce(lambda a, b: a | b, near)


def predicate(spec: SeriesSpec, f: Filters, tolerance_minutes: int = 30, calendar: bool = False) -> list[Column]:
    """what filters say about the time. calendar: also weekdays and weekends (Q2)."""
    ts, times, out = F.col(spec.ts), times_of(f.times), []
    lo, hi = iso_date(f.date_start), iso_date(f.date_end)
    if lo:
        a = "%02d:%02d:%02d" % times[0] if times else "00:00:00"
        out.append(ts >= F.lit(f"{lo} {a}").cast("timestamp_ntz"))
    if hi:
        b = "%02d:%02d:%02d" % times[0] if times else "23:59:59"
        out.append(ts <= F.lit(f"{hi} {b}").cast("timestamp_ntz"))
    out += [part(ts).isin(*values) for part, values in ((F.year, f.years), (F.month, f.months), (F.dayofmonth, f.days)) if values]
    if times:
        out.append(time_of_day_near(ts, times, tolerance_minutes))
    if calendar and f.weekdays:
        out.append(F.weekday(ts).isin(*[WEEKDAYS.index(w.lower()) for w in f.weekdays if w.lower() in WEEKDAYS]))
    if calendar and f.weekends:
        out.append(F.weekday(ts) >= 5)
    return out


def apply(df: DataFrame, spec: SeriesSpec, f: Filters, tolerance_minutes: int = 30, calendar: bool = False) -> DataFrame:
    """F3."""
    out = groups(df, spec.group, f.groups)
    for p in predicate(spec, f, tolerance_minutes, calendar):
        out = out.where(p)
    return out


def before(df: DataFrame, ts: str, anchor) -> DataFrame:
    """no row at or after the anchor."""
    return df.where(F.col(ts) < F.lit(anchor))


def history(df: DataFrame, ts: str, value: str, cutoff) -> DataFrame:
    """Time and value before the cutoff, one row for each time (the smallest value), none null."""
    v = F.col(value).try_cast("double")
    return before(df, ts, cutoff).select(F.col(ts).alias("ts"), v.alias("value")).dropna().groupBy("ts").agg(F.min("value").alias("value"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """F10."""
    return df.where(F.col("stage") == name)


def split_by_horizon(df: DataFrame, id_col: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """multi-step questions (their id holds 'hourly') and the others."""
    multi = F.coalesce(F.lower(F.col(id_col)).contains("hourly"), F.lit(False))
    return df.where(multi), df.where(~multi)


def nonzero_truth(df: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """F12."""
    return df.where(F.abs(F.col(truth)) > 0)


def metric_columns(df: DataFrame, excluded: tuple[str, ...] = ()) -> list[str]:
    """columns with a number in them. One aggregate over text columns; numeric types by schema."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in excluded]
    if texts:
        found = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in texts]).first()
        numeric += [c for c in texts if found[c]]
    return [c for c in df.columns if c in numeric]


def preferred(df: DataFrame, names) -> DataFrame:
    """F14."""
    return df.select(*[c for c in names if c in df.columns])


__all__ = ["apply", "before", "day_bounds", "groups", "history", "metric_columns", "nonzero_truth", "predicate", "preferred", "split_by_horizon", "stage", "time_of_day_near"]
