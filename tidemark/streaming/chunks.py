"""The streaming form of time chunks and rolling statistics: tumbling and sliding windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def chunk_stats(stream: DataFrame, ts: str, group: str, value: str, hours: int = 24, late: str = "1 hour", slide_hours: int | None = None) -> DataFrame:
    """Count, mean and extremes of each window and group; rows later than late are left out."""
    at = F.col(ts).cast("timestamp")
    timed = stream.withColumn("_at", at).withWatermark("_at", late)
    w = F.window("_at", f"{hours} hours", f"{slide_hours or hours} hours")
    out = timed.groupBy(w, F.col(group).alias("series")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.select("series", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "mean", "lo", "hi")
