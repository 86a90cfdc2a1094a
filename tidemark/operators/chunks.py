"""Chunks of time or rows, and the map, reduce, cross-reduce of their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ChunkConfig
from .resample import numbered


def by_time(df: DataFrame, ts: str, hours: int = 24, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id of [first time + k * hours, ...), anchored at the first time (of each group)."""
    first = df.groupBy(*by).agg(F.min(ts).alias("_first"))
    joined = df.join(first, list(by)) if by else df.crossJoin(first)  # one row
    chunk = F.floor(F.timestamp_diff("MICROSECOND", F.col("_first"), F.col(ts)) / F.lit(hours * 3_600_000_000)).cast("long")
    return joined.withColumn("chunk_id", chunk).drop("_first")


def by_rows(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...], cfg: ChunkConfig = ChunkConfig(), rows: int | None = None) -> DataFrame:
    """chunk_id of so many rows in order, within each group. The first column of order is a time."""
    placed = numbered(df, order[0], by, "_place", order[1:])
    return placed.withColumn("chunk_id", F.floor(F.col("_place") / (rows or cfg.rows)).cast("long")).drop("_place")


def summarise(chunked: DataFrame, ts: str, value: str, origin: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A summary of each chunk, of each origin (from its chunks), of all (from its origins)."""
    v = F.col(value)
    chunk = chunked.groupBy(origin, "chunk_id").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))

    def up(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    per_origin = up(chunk, origin)
    return chunk, per_origin, up(per_origin)


def text(summary: DataFrame, name: str, unit: str = "") -> DataFrame:
    """A line of text for each summary row."""
    mean = F.try_divide(F.col("total"), F.col("n"))
    return summary.withColumn("summary", F.concat_ws(" ", F.col(name), F.format_string(f"mean %.2f{unit}, from %.2f to %.2f, %d values", mean, F.col("lo"), F.col("hi"), F.col("n"))))
