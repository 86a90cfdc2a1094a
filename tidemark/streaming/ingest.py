"""Incremental ingest: files of readings as they arrive, merged into one table that keeps the first row of each key.

A file source with a checkpoint hands on each file once. Each batch is written to a folder of its own number, without the keys that earlier batches hold; a batch that is
run again after a failure overwrites its own folder, so that nothing is written twice. The ledger has a row for each file: the report of what is there already
comes from it, not from a folder's listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readings import READINGS, coerce

KEYS = ("REGION", "SETTLEMENTDATE")


def _have(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _earlier(spark: SparkSession, path: str, batch: int, like: DataFrame) -> DataFrame:
    if not _have(spark, path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.withColumn("batch", F.lit(0).cast("long")).schema).parquet(path).where(F.col("batch") < batch).drop("batch")


def first_of_keys(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each key, the smallest in order (nulls last), by a plain aggregate: combined before the shuffle, so that hot keys don't matter."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c).alias(f"_of_{c}"))])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def merge_batch(rows: DataFrame, batch: int, out: str, keys: tuple[str, ...] = KEYS) -> None:
    """Write what rows adds to out/rows, and its files to out/files. Rows without a key's value are left out."""
    spark = rows.sparkSession
    typed = coerce(rows, "SETTLEMENTDATE", ("TOTALDEMAND", "RRP"))
    files = typed.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    known = typed.dropna(subset=list(keys))
    first = first_of_keys(known, keys, ("source_file", "TOTALDEMAND", "RRP", "PERIODTYPE"))
    ends = known.agg(F.min("SETTLEMENTDATE"), F.max("SETTLEMENTDATE")).first()
    if ends[0] is not None:
        # only the stretch of time that the batch touches is read again
        before = _earlier(spark, f"{out}/rows", batch, typed).where(F.col("SETTLEMENTDATE").between(F.lit(ends[0]).cast("timestamp_ntz"), F.lit(ends[1]).cast("timestamp_ntz")))
        first.join(before.select(*keys), list(keys), "left_anti").write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
    files.write.mode("overwrite").parquet(f"{out}/files/batch={batch}")


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, keys: tuple[str, ...] = KEYS, max_files: int = 1000) -> None:
    """Take in the files of folder that weren't taken in yet, and stop."""
    stream = spark.readStream.schema(READINGS).option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", max_files).csv(folder)
    tagged = stream.withColumn("source_file", F.col("_metadata.file_name"))
    run = tagged.writeStream.foreachBatch(lambda rows, batch: merge_batch(rows, batch, out, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def readings_of(spark: SparkSession, out: str) -> DataFrame:
    """The merged table."""
    return spark.read.parquet(f"{out}/rows").drop("batch")


def report(manifest: DataFrame, out: str, folder: str) -> DataFrame:
    """Manifest rows with file_path, and whether the ledger has the file."""
    spark = manifest.sparkSession
    name = F.element_at(F.split("url", "/"), -1)
    seen = spark.read.parquet(f"{out}/files").select(F.col("source_file").alias("_name")).distinct() if _have(spark, f"{out}/files") else spark.createDataFrame([], "_name string")
    return manifest.withColumn("_name", name).join(seen.withColumn("success", F.lit(True)), "_name", "left").select(*manifest.columns, F.concat(F.lit(f"{folder}/"), "_name").alias("file_path"), F.coalesce("success", F.lit(False)).alias("success"))
