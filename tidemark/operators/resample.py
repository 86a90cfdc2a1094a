"""Regular grids: bucket means, and interpolation by place or by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered  # noqa: F401


def bucket_mean(df: DataFrame, ts: str, value: str, seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each bucket of so many seconds. Map-side sums."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    return df.where(F.col(ts).isNotNull()).groupBy(*by, slot.alias("slot")).agg(F.avg(value).alias("value"))


def regular(df: DataFrame, ts: str, value: str, seconds: int, by: tuple[str, ...] = (), both_ways: bool = True, block: int = 4096) -> DataFrame:
    """(slot, value) on every bucket between the first and the last, gaps filled in a straight line. Buckets lie at equal distances, so by
    place and by time are the same. both_ways: also constant before the first value; else only after the last.

    The grid is cut into blocks of so many slots. What a block passes on, its last and its first known value, is one row, so a long series spreads
    over many tasks.
    """
    means = bucket_mean(df, ts, value, seconds, by)
    span = means.groupBy(*by).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    blocks = span.select(*by, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("block"))
    inside = F.sequence(F.greatest("lo", F.col("block") * block), F.least("hi", (F.col("block") + 1) * block - 1))
    on = blocks.select(*by, "block", F.explode(inside).alias("slot")).join(means, [*by, "slot"], "left")
    # a bucket can hold nulls only: its mean is null, and it counts as a gap
    known = F.when(F.col("value").isNotNull(), F.struct("slot", "value"))
    ends = means.where("value is not null").groupBy(*by, F.floor(F.col("slot") / block).alias("block")).agg(F.max(F.struct("slot", "value")).alias("last"), F.min(F.struct("slot", "value")).alias("first"))
    across = Window.partitionBy(*by).orderBy("block")
    passed = blocks.select(*by, "block").join(ends, [*by, "block"], "left").select(*by, "block", F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"), F.first("first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("from_after"))
    w = Window.partitionBy(*by, "block").orderBy("slot")
    before, after = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = on.select(*by, "block", "slot", before.alias("a"), after.alias("b")).join(passed, [*by, "block"])
    filled = seen.select(*by, "slot", F.coalesce("a", "from_before").alias("a"), F.coalesce("b", "from_after").alias("b"))
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("slot") - F.col("a.slot")) / F.nullif(F.col("b.slot") - F.col("a.slot"), F.lit(0))
    found = F.coalesce(F.when(F.col("a.slot") == F.col("b.slot"), F.col("a.value")), line, F.col("a.value"), *([F.col("b.value")] if both_ways else []))
    return filled.select(*by, "slot", F.timestamp_micros(F.col("slot") * seconds * 1_000_000).cast("timestamp_ntz").alias("ts"), found.alias("value"))


def normalise(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Z-scores by group, from one aggregate joined back (no window over whole groups)."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return df.join(s, list(by)).withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.nullif(F.col("_std"), F.lit(0.0)))).drop("_mean", "_std")
