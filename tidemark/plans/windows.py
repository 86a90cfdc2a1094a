"""An anchor and a route as a small relation of labelled time windows (at most a few dozen rows, bounded by the configuration)."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import day_bounds, iso_date, iso_datetime, normalise_freq, times_of
from ..spec import Filters, RetrievalConfig

SCHEMA = "ret_block string, block_rank int, lag int, lo timestamp_ntz, hi timestamp_ntz, prior_year int, lag_days int, prior_woy int"
BLOCKS = ("recent_window", "same_hour_previous_days", "same_weekday_recent_weeks", "prior_years_same_dates", "prior_years_same_week", "same_month_prev_years", "same_woy_prior_years", "macro_trend_blocks")
ROUTES = {
    "short_term": ("recent_window", "same_hour_previous_days", "same_weekday_recent_weeks", "prior_years_same_dates", "prior_years_same_week"),
    "mid_term": ("recent_window", "same_weekday_recent_weeks", "same_month_prev_years", "prior_years_same_week", "prior_years_same_dates"),
    "long_term": ("same_month_prev_years", "same_woy_prior_years", "macro_trend_blocks", "prior_years_same_dates"),
}
SPANS = {"15min": timedelta(hours=72), "30min": timedelta(hours=96), "1H": timedelta(days=7), "1D": timedelta(days=365)}


def years_back(t: datetime, n: int) -> datetime:
    """29 February becomes the 28th."""
    try:
        return t.replace(year=t.year - n)
    except ValueError:
        return t.replace(year=t.year - n, day=28)


def recent_span(freq: str | None, cfg: RetrievalConfig) -> timedelta:
    """R5. compat: hourly and daily frequencies are not recognised."""
    name = normalise_freq(freq)
    if cfg.compat and name in ("1H", "1D"):
        name = None
    return SPANS.get(name or "", timedelta(days=cfg.safe_default_recent_days))


def target_window(f: Filters, compat: bool = False) -> tuple[datetime | None, datetime | None]:
    """start/end, else date_start/date_end with the first time, else year, month and day."""
    times = times_of(f.times)
    at = time(*times[0]) if times else None

    def moment(value: str | None) -> datetime | None:
        t = iso_datetime(value)
        if t is None:
            return None
        if at is not None:
            return datetime.combine(t.date(), at)
        return datetime.combine(t.date(), time()) if compat else t

    if f.start_time and iso_datetime(f.start_time):
        return iso_datetime(f.start_time), iso_datetime(f.end_time)
    start, end = moment(f.date_start), moment(f.date_end)
    if start:
        return start, end if end and end > start else None
    if f.years and f.months and f.days:
        try:
            return datetime.combine(date(f.years[0], f.months[0], f.days[0]), at or time()), None
        except ValueError:
            pass
    return None, None


def windows_of(anchor: datetime, route: str, cfg: RetrievalConfig = RetrievalConfig(), start: datetime | None = None, end: datetime | None = None, freq: str | None = None) -> list[tuple]:
    """Rows of SCHEMA for the blocks of a route (R6 to R16). start, end: the target; the anchor if there is none."""
    tol, day = timedelta(minutes=cfg.time_tolerance_minutes), timedelta(days=1)
    base, rows = start or anchor, []

    def add(block: str, lag: int, lo: datetime, hi: datetime | None, prior_year=None, lag_days=None, prior_woy=None) -> None:
        rows.append((block, BLOCKS.index(block), lag, lo, hi, prior_year, lag_days, prior_woy))

    def whole(lo: datetime, hi: datetime) -> tuple[datetime, datetime]:
        return day_bounds(lo.date())[0], day_bounds(hi.date())[1]

    for block in ROUTES[route]:
        if block == "recent_window":
            back = recent_span(freq, cfg) if route == "short_term" else timedelta(weeks=cfg.mid_rolling_weeks_back)
            add(block, 0, *whole(anchor - back, anchor))
        elif block == "same_hour_previous_days":
            for d in range(1, cfg.same_hour_back_days + 1):
                add(block, d, base - d * day - tol, base - d * day + tol, lag_days=d)
        elif block == "same_weekday_recent_weeks":
            for w in range(1, (cfg.same_weekday_recent_weeks if route == "short_term" else cfg.mid_same_weekday_hour_profiles_weeks) + 1):
                ref = base - timedelta(weeks=w)
                add(block, w, ref - day - tol, ref + day + tol)
        elif block == "prior_years_same_dates":
            for i in range(1, cfg.previous_years + 1):
                add(block, i, years_back(base, i), years_back(end or base, i), prior_year=years_back(base, i).year)
        elif block == "prior_years_same_week":
            for i in range(1, cfg.previous_years + 1):
                ref = years_back(base, i).replace(day=min(28, base.day))
                add(block, i, *whole(ref - cfg.sameweek_days * day, ref + max(cfg.sameweek_days * day, (end - start) if start and end else timedelta())), prior_year=ref.year)
        elif block == "same_month_prev_years":
            years, buffer = (cfg.mid_same_month_prev_years, cfg.mid_same_month_buffer_days) if route == "mid_term" else (cfg.long_same_month_years, cfg.long_same_month_buffer_days)
            for i in range(1, years + 1):
                ref = years_back(base, i)
                add(block, i, *whole(ref.replace(day=max(1, base.day - buffer)), ref.replace(day=min(28, base.day + buffer))), prior_year=ref.year)
        elif block == "same_woy_prior_years":
            for i in range(1, cfg.woy_years + 1):
                ref = years_back(base, i).replace(day=min(28, base.day))
                add(block, i, ref - 3 * day - tol, ref + 3 * day + tol, prior_woy=ref.isocalendar()[1])
        elif block == "macro_trend_blocks":
            add(block, 0, years_back(anchor, max(cfg.long_macro_years, 3)), None)
    return rows


def windows_relation(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


__all__ = ["BLOCKS", "ROUTES", "iso_date", "recent_span", "target_window", "windows_of", "windows_relation", "years_back"]
