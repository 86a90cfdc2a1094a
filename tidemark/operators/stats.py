"""Descriptive statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readings import scratch
from ..spec import SeriesSpec, StatConfig
from .ordered import numbered, previous

#: Size of the rank sketches: brackets of about 0.8 % of a group's rows.
SKETCH = 4096
#: Groups whose brackets are broadcast at most.
BROADCAST_GROUPS = 10_000


def unpivot(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(series, ts, metric, value): a row for each metric that df has."""
    group = F.col(spec.group) if spec.group else F.lit("all")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("value")) for m in spec.metrics if m in df.columns])).alias("p")
    keep = [F.col(c) for c in ("ret_score",) if c in df.columns]
    return df.select(group.alias("series"), F.col(spec.ts).alias("ts"), *keep, pairs).select("series", "ts", *keep, "p.metric", "p.value")


# The expressions below are texts: built piece by piece, they cost more time than the queries.


def _ranks(percentiles) -> str:
    """The places in ascending order that percentiles of n values need."""
    return f"array_sort(array_distinct(flatten(transform(array({', '.join(f'{p / 100!r}D' for p in percentiles)}), p -> array(cast(floor(p * (n - 1)) as bigint), cast(ceil(p * (n - 1)) as bigint))))))"


def brackets(own: DataFrame, percentiles, size: int = SKETCH) -> DataFrame:
    """(_g, _lo0, ..., _hi0, ...) of (_g, _v): values around each percentile, ascending, by one aggregate with a mergeable sketch of the ranks."""
    sums = own.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.kll_sketch_agg_double("_v", F.lit(size)).alias("_sketch"))
    # three times what a sketch of this size errs by in 99 of 100 cases
    slack, shares = 3 * 2.296 / size**0.9021, sorted(p / 100 for p in percentiles)
    at = lambda shift: f"kll_sketch_get_quantile_double(_sketch, array({', '.join(f'{min(1.0, max(0.0, x + shift))!r}D' for x in shares)}))"
    found = sums.selectExpr("_g", "_min", "_max", f"{at(-slack)} as _los", f"{at(slack)} as _his", f"n * {slack!r}D < 2 as _whole")
    # where two rows are more than the slack, the bracket is the whole range
    side = lambda all_, name, as_: [f"if(_whole, {all_}, {name}[{k}]) as {as_}{k}" for k in range(len(shares))]
    return found.selectExpr("_g", *side("_min", "_los", "_lo"), *side("_max", "_his", "_hi"))


def _fixed(found: DataFrame) -> DataFrame:
    """Brackets that are computed once, since sketches are drawn at random: of BROADCAST_GROUPS groups at most they are broadcast (some 300 bytes each), of more
    they are a written table, joined by shuffling."""
    spark = found.sparkSession
    few = found.limit(BROADCAST_GROUPS + 1).toArrow()
    if few.num_rows <= BROADCAST_GROUPS:
        return F.broadcast(spark.createDataFrame(few, found.schema))
    folder = scratch(spark, "brackets")
    found.write.parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def quantiles(df: DataFrame, value: str, by: tuple[str, ...], percentiles, size: int = SKETCH) -> DataFrame:
    """(by, q): exact percentiles with linear interpolation, as an array. Nulls and NaN are left out.

    A rank sketch of each group gives brackets around the percentiles. One more pass counts, before any shuffle, the rows between brackets and the distinct
    values inside them: some hundredths of the rows. Running counts then find the ranks; a task holds the distinct values of one bracket. A rank that
    its bracket misses (not in 10**14 cases) raises an error, never a wrong value.
    """
    v = F.col(value).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*by, F.lit(0).alias("_")).alias("_g"), v.alias("_v"))
    met = own.join(_fixed(brackets(own, percentiles, size)), "_g")
    # brackets in ascending order: how many begin at or before a value tells its region; inside rows of a region come before the others
    places = range(len(percentiles))
    region = " + ".join(f"cast(_v >= _lo{k} as int)" for k in places)
    inside = " or ".join(f"_v between _lo{k} and _hi{k}" for k in places)
    cells = met.selectExpr("_g", f"{region} as region", f"if({inside}, _v, null) as v").groupBy("_g", "region", "v").agg(F.count(F.lit(1)).alias("t"))
    totals = cells.groupBy("_g", "region").agg(F.sum("t").alias("total"))
    all_ = Window.partitionBy("_g")
    before = F.coalesce(F.sum("total").over(all_.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_g", "region", before.alias("before"), F.sum("total").over(all_).alias("n"))
    upto = F.col("before") + F.sum("t").over(Window.partitionBy("_g", "region").orderBy(F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.join(starts, ["_g", "region"]).withColumn("upto", upto)
    hits = placed.selectExpr("_g", "n", "v", f"explode(filter({_ranks(percentiles)}, r -> v is not null and r >= upto - t and r < upto)) as r")
    found = hits.groupBy("_g").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))
    value_at = lambda r: f"coalesce(try_element_at(m, cast({r} as bigint)), cast(raise_error('a rank lies outside its bracket: run again') as double))"
    at = [f"{p / 100!r}D * (n - 1)" for p in percentiles]
    q = ", ".join(f"{value_at(f'floor({x})')} + ({value_at(f'ceil({x})')} - {value_at(f'floor({x})')}) * ({x} - floor({x}))" for x in at)
    return found.select(*[F.col("_g")[b].alias(b) for b in by], F.expr(f"array({q})").alias("q"))


def basic(df: DataFrame, value: str, by: tuple[str, ...] = (), percentiles=StatConfig().percentiles) -> DataFrame:
    """A1 to A3: count, mean, standard deviation (0 for one value), extremes and exact linear percentiles."""
    v = F.col(value)
    group = F.struct(*by, F.lit(0).alias("_")).alias("_g")
    out = df.where(v.isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, value, by, percentiles).select(group, "q")
    return out.join(q, "_g").select(*[F.col("_g")[b].alias(b) for b in by], "n", "mean", "std", "min", "max", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate(percentiles)])


def weighted_mean(value: Column, weight: Column) -> Column:
    """A4: weights below zero count as zero; null if they add up to nothing."""
    w = F.when(value.isNotNull() & weight.isNotNull(), F.greatest(weight, F.lit(0.0)))
    return F.try_divide(F.sum(value * w), F.nullif(F.sum(w), F.lit(0.0)))


def correlation(a: Column, b: Column, min_pairs: int = StatConfig().min_pairs) -> Column:
    """A5: Pearson over pairs; null below min_pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return F.when(F.count(x) >= min_pairs, r)


def correlation_matrix(df: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = (), min_pairs: int = StatConfig().min_pairs) -> DataFrame:
    """A5 as rows (metric_a, metric_b, r)."""
    pairs = list(combinations(metrics, 2))
    wide = df.groupBy(*by).agg(*[correlation(F.col(a).cast("double"), F.col(b).cast("double"), min_pairs).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("c")
    return wide.select(*by, cells).select(*by, "c.*")


def profile(df: DataFrame, ts: str, value: str, part: str) -> DataFrame:
    """The median of each hour (24), weekday (7, Monday 0) or month (12); null where there is none."""
    of, lo, hi = {"hour": (F.hour, 0, 24), "weekday": (F.weekday, 0, 7), "month": (F.month, 1, 13)}[part]
    grid = df.sparkSession.range(lo, hi).select(F.col("id").cast("int").alias("slot"))
    found = quantiles(df.select(of(ts).alias("slot"), F.col(value).alias("v")), "v", ("slot",), (50,)).select("slot", F.col("q")[0].alias("median"))
    return grid.join(found, "slot", "left")


def distinct_times(df: DataFrame, ts: str, by: tuple[str, ...]) -> DataFrame:
    """One row for each time, with its count: what windows over raw rows would sort many times over."""
    return df.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).alias("ts")).agg(F.count(F.lit(1)).alias("n"))


def sampling_interval(df: DataFrame, ts: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent positive difference of neighbouring times in whole minutes (half to even; the smallest of ties), in seconds."""
    times = previous(distinct_times(df, ts, by), "ts", by, {"ts": "_before"})
    step = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("ts"))
    minutes = F.bround(step / F.lit(60_000_000.0), 0).cast("long")
    counted = times.select(*by, minutes.alias("minutes")).where("minutes is not null").groupBy(*by, "minutes").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by).agg(F.min_by("minutes", F.struct(-F.col("n"), F.col("minutes"))).alias("minutes"))
    return best.select(*by, (F.col("minutes") * 60).alias("step_seconds"))


def gap_report(df: DataFrame, ts: str, by: tuple[str, ...], step_seconds: float) -> DataFrame:
    """How many differences exceed one and a half steps, the longest in steps, and rows that repeat a time."""
    times = previous(distinct_times(df, ts, by), "ts", by, {"ts": "_before"})
    diff = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("ts")) / F.lit(1e6 * step_seconds)
    return times.select(*by, "n", diff.alias("steps")).groupBy(*by).agg(F.sum((F.col("steps") > 1.5).cast("long")).alias("n_gaps"), F.max("steps").alias("max_gap_steps"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def overview(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First and last time, rows, distinct groups. Groups are told apart before they are collected."""
    by = df.groupBy(F.col(spec.group).alias("series")).agg(F.min(spec.ts).alias("lo"), F.max(spec.ts).alias("hi"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.sum("n").alias("n_rows"), F.count("series").alias("n_series"))


def hours_to_steps(hours: float, step_seconds: float) -> int:
    """X22."""
    return max(1, round(hours * 3600 / step_seconds)) if step_seconds else 1


def autocorrelation(df: DataFrame, ts: str, value: str, lags: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson of a series with itself lags steps earlier, in rows (lag, r). Rows are numbered and sent to the places they are partners of."""
    placed = numbered(df.select(*by, F.col(ts).alias("ts"), F.col(value).alias("x")), "ts", by, "place")
    sent = F.explode(F.array(F.struct(F.lit(0).alias("lag"), F.col("place").alias("at")), *[F.struct(F.lit(k).alias("lag"), (F.col("place") + k).alias("at")) for k in lags])).alias("e")
    met = placed.select(*by, "x", sent).groupBy(*by, F.col("e.at").alias("at")).agg(F.max(F.when(F.col("e.lag") == 0, F.col("x"))).alias("x"), *[F.max(F.when(F.col("e.lag") == k, F.col("x"))).alias(f"x{k}") for k in lags])
    wide = met.groupBy(*by).agg(*[correlation(F.col("x"), F.col(f"x{k}")).alias(f"r{k}") for k in lags])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])).alias("c")).select(*by, "c.*")


def summarise(df: DataFrame, spec: SeriesSpec, cfg: StatConfig = StatConfig()) -> dict[str, DataFrame]:
    """The statistics of a retrieval result (or any table), a frame for each facet."""
    long = unpivot(df, spec)
    out = {"basic": basic(long, "value", ("series", "metric"), cfg.percentiles), "overview": overview(df, spec)}
    for part in ("hour", "weekday", "month"):
        for m in spec.metrics:
            out[f"profile_{part}_{m}"] = profile(df, spec.ts, m, part)
    if cfg.weighted_by_ret_score and "ret_score" in df.columns:
        out["weighted"] = long.groupBy("series", "metric").agg(weighted_mean(F.col("value"), F.col("ret_score")).alias("weighted_mean"))
    if len(spec.metrics) > 1:
        out["correlation"] = correlation_matrix(df, spec.metrics, (), cfg.min_pairs)
    return out
