"""Configuration: frozen dataclasses whose defaults are the engine's public defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns of a table are time, group, metrics and row key."""

    ts: str = "ts"
    group: str | None = None
    metrics: tuple[str, ...] = ()
    key: str | None = None


@dataclass(frozen=True)
class RetrievalConfig:
    previous_years: int = 5
    time_tolerance_minutes: int = 30
    sameweek_days: int = 3
    safe_default_recent_days: int = 7
    max_segments: int = 5000
    same_hour_back_days: int = 14
    same_weekday_recent_weeks: int = 8
    mid_rolling_weeks_back: int = 12
    mid_same_weekday_hour_profiles_weeks: int = 16
    mid_same_month_prev_years: int = 4
    mid_same_month_buffer_days: int = 7
    long_same_month_years: int = 6
    long_same_month_buffer_days: int = 14
    long_macro_years: int = 3
    woy_years: int = 6
    weights: tuple[float, float, float, float] = (0.45, 0.25, 0.20, 0.10)
    compat: bool = False  # reproduce known slips: times lost after date_start, hourly frequencies unknown, one row for each timestamp


@dataclass(frozen=True)
class Filters:
    """A request as predicates. Empty means no restriction."""

    groups: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    days: tuple[int, ...] = ()
    times: tuple[str, ...] = ()
    date_start: str | None = None
    date_end: str | None = None
    start_time: str | None = None
    end_time: str | None = None
    freq: str | None = None
    weekdays: tuple[str, ...] = ()
    weekends: bool = False
    holidays: bool = False
    horizon_steps: int | None = None
    horizon_units: str | None = None
    single_timestamps: tuple[str, ...] = ()
    date_ranges: tuple[tuple[str, str], ...] = ()
    vague_label: str | None = None
    vague_tolerance_minutes: int | None = None
    period_type: str | None = None
    notes: str | None = None


@dataclass(frozen=True)
class StatConfig:
    percentiles: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    acf_lags_hours: tuple[int, ...] = (1, 24, 168)
    weighted_by_ret_score: bool = True
    min_pairs: int = 8


@dataclass(frozen=True)
class ScanConfig:
    """Ordered scans: rows of a block, keys sampled for each, and blocks at most."""

    rows_per_block: int = 500_000
    samples_per_block: int = 16
    max_blocks: int = 65_536


@dataclass(frozen=True)
class AnomalyConfig:
    z_threshold: float = 3.0
    rolling_days: int = 7
    min_points: int = 24
    top_k: int = 20


@dataclass(frozen=True)
class PatternConfig:
    acf_lags_hours: tuple[int, ...] = (1, 2, 3, 6, 12, 24, 48, 72, 168)
    thumbnail_points: int = 360
    max_groups: int = 6
    max_metrics: int = 2
    min_trend_points: int = 5
    slope_bounds: tuple[float, float, float] = (0.01, 0.05, 0.15)
    season_bounds: tuple[float, float] = (0.3, 0.5)


@dataclass(frozen=True)
class SequenceConfig:
    """The sequence forecaster: days of history, hours that it sees and looks ahead, its size and training, and windows that it is fitted on at most."""

    days: int = 90
    encoder: int = 168
    horizon: int = 168
    hidden: int = 32
    epochs: int = 10
    batch: int = 64
    rate: float = 0.005
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    samples: int = 6000
    seed: int = 42


@dataclass(frozen=True)
class ChunkConfig:
    hours: int | None = 24
    tokens: int = 60_000
    max_rows: int = 5000

    @property
    def rows(self) -> int:
        return min(self.max_rows, max(200, self.tokens * 4 // 100))


@dataclass(frozen=True)
class Flags:
    """Stages of the pipeline that can be left out."""

    sector: bool = True
    horizon: bool = True
    stats: bool = True
    patterns: bool = True
    summary: bool = True
    direct_only: bool = False


@dataclass(frozen=True)
class ManifestConfig:
    base_url: str = "https://data.example/price_and_demand_"
    regions: tuple[str, ...] = ("NSW1", "TAS1", "QLD1", "VIC1", "SA1")
    months: tuple[str, ...] = ("01", "02", "03", "04")
    years: tuple[str, ...] = ("2025",)


@dataclass(frozen=True)
class EvaluationConfig:
    resamples: int = 2000
    confidence: float = 0.95
    seed: int = 42
    min_signed: int = 10
    exact_signed: int = 50
    min_loss: int = 10
    min_loss_lagged: int = 4
    winner_below: float = 0.05
    min_shared: int = 5


@dataclass
class RetrievalResult:
    rows: object
    counts: object
    combined: object
    meta: dict = field(default_factory=dict)
    anchor: datetime | None = None
