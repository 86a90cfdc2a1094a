"""Sources and sinks: CSV, JSON and YAML, coercion, merging, manifests, profiles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import ManifestConfig

READINGS = "REGION string, SETTLEMENTDATE string, TOTALDEMAND string, RRP string, PERIODTYPE string"
STAMP_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


_own_dir: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; where it is unset and all runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="readings-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        base = _own_dir[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stamp(c: Column) -> Column:
    """Any of the known formats as wall-clock time; null if it is none."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in STAMP_FORMATS])


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, typed, with source_file. A missing file column is null."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(READINGS).csv(path)
    tagged = raw.withColumn("source_file", F.col("_metadata.file_name"))
    return coerce(tagged, "SETTLEMENTDATE", ("TOTALDEMAND", "RRP"))


def coerce(df: DataFrame, ts: str, metrics: tuple[str, ...]) -> DataFrame:
    return df.withColumns({ts: stamp(F.col(ts).cast("string"))} | {m: F.col(m).try_cast("double") for m in metrics if m in df.columns})


def manifest(spark: SparkSession, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """A row for each year, month and region."""
    axes = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in (("year", cfg.years), ("month", cfg.months), ("region", cfg.regions))]
    return with_urls(axes[0].crossJoin(axes[1]).crossJoin(axes[2]), cfg)  # literal lists of the configuration


def with_urls(df: DataFrame, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """S4 of a table with year, month (two digits) and region."""
    return df.withColumn("url", F.concat(F.lit(cfg.base_url), "year", "month", F.lit("_"), "region", F.lit(".csv")))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5."""
    df.write.mode(mode).option("header", True).csv(path)


def validate_manifest(df: DataFrame, required: tuple[str, ...] = ("year", "month", "region", "url")) -> DataFrame:
    """One row: missing columns, nulls by column, duplicate urls, rows."""
    missing = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    count = F.count(F.lit(1))
    return df.agg(F.lit(",".join(missing)).alias("missing_columns"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in have], *([(F.count("url") - F.count_distinct("url")).alias("duplicate_urls")] if "url" in have else []), count.alias("n_rows"))


def merge(frames: list[DataFrame], keys: tuple[str, ...], order: tuple[str, ...], ts: str) -> DataFrame:
    """Union by name, one row for each key (the first in order), then time coercion and sorting."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = every.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if dict(kept.dtypes)[ts] == "string":
        kept = kept.withColumn(ts, stamp(F.col(ts)))
    return kept.orderBy(*[k for k in keys if k != ts], ts)


def profile(df: DataFrame, ts: str, group: str) -> DataFrame:
    """A row for each group: rows, null times, first and last time, duplicate (group, time) rows."""
    pairs = df.groupBy(group, ts).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col(group).alias("series")).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col(ts).isNull(), F.col("n")).otherwise(0)).alias("null_times"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def write_query_sets(sets: DataFrame, path: str) -> None:
    """Rows with queries, an array of questions, as JSON lines: many sets share a file, so that the number of files doesn't grow with that of the sets."""
    sets.write.json(path)


def read_queries(spark: SparkSession, path: str, sets: str | None = None) -> DataFrame:
    """A JSON list, or files of {"queries": [...]}; ids are made up where they lack, by the place in their file. sets: the schema of a set, where each line is
    one ({"queries": [...], more}); ids are then by the place in their set."""
    df = spark.read.option("multiLine", True).json(path) if sets is None else spark.read.schema(sets).json(path)
    if "queries" in df.columns:
        df = df.select(*[c for c in df.columns if c != "queries"], F.posexplode("queries").alias("_at", "q")).select("*", "q.*").drop("q")
    else:
        df = df.withColumn("_at", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)  # a file of questions
    made = F.format_string("q_%04d", F.col("_at").cast("int"))
    return df.withColumn("id", F.coalesce("id", made) if "id" in df.columns else made).drop("_at")


def read_yaml(path: str) -> dict:
    """Two-level 'key: value' files, lists in brackets or dashes; with PyYAML if it is there."""
    try:
        import yaml

        return yaml.safe_load(Path(path).read_text())
    except ImportError:
        out: dict = {}
        own = out
        for line in Path(path).read_text().splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            key, _, value = line.strip().partition(":")
            own = out if not line[0].isspace() else own
            if not value.strip():
                own = out.setdefault(key, {})
            else:
                value = value.strip()
                own[key] = [x.strip() for x in value[1:-1].split(",")] if value.startswith("[") else value
        return out


def append_runs(df: DataFrame, folder: str) -> None:
    """Run records appended as CSV and JSON lines, by experiment."""
    df.write.mode("append").option("header", True).csv(f"{folder}/results_csv")
    df.write.mode("append").partitionBy(*[c for c in ("exp_id",) if c in df.columns]).json(f"{folder}/results_jsonl")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """S15."""
    return spark.read.option("header", True).csv(path)


def csv_text(df: DataFrame, order: tuple[str, ...], preferred: tuple[str, ...] = (), rows: int = 50) -> DataFrame:
    """One text of the first rows; preferred columns that are there, else the first eight."""
    cols = [c for c in preferred if c in df.columns] or df.columns[:8]
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if "timestamp" in dict(df.dtypes)[c] else F.col(c).cast("string") for c in cols]
    line = F.concat_ws(",", *[F.coalesce(s, F.lit("")) for s in shown])
    top = df.orderBy(*order).limit(rows).select(line.alias("line"), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)])
    packed = F.array_sort(F.collect_list(F.struct(*[f"_o{k}" for k in range(len(order))], "line")))
    return top.agg(F.concat(F.lit(",".join(cols) + "\n"), F.array_join(F.transform(packed, lambda x: x["line"]), "\n")).alias("csv"))


def ingest(spark: SparkSession, paths: list[str], out: str, keys: tuple[str, ...] = ("REGION", "SETTLEMENTDATE")) -> DataFrame:
    """Read, merge, write, profile."""
    merged = merge([read_readings(spark, p) for p in paths], keys, ("source_file", "TOTALDEMAND"), "SETTLEMENTDATE")
    write_csv(merged, out)
    return profile(merged, "SETTLEMENTDATE", "REGION")


def query_grid(start: str, days: int, bins: dict[str, tuple[str, int]], seed: int = 7) -> list[dict]:
    """Seeded questions: a time bin with jitter on each day, rounded to half hours; days cycle over weekday and weekend."""
    import random
    from datetime import datetime, timedelta

    rng, first, out = random.Random(seed), datetime.fromisoformat(start), []
    for k, (name, day) in enumerate(product(bins, range(days))):
        at, jitter = bins[name]
        h, m, s = map(int, at.split(":"))
        t = first + timedelta(days=day, hours=h, minutes=m, seconds=s)
        while (t.weekday() >= 5) != (k % 7 >= 5):
            t += timedelta(days=1)
        t += timedelta(minutes=rng.randint(-(jitter // 2), jitter // 2))
        t = datetime.fromtimestamp(round(t.timestamp() / 1800) * 1800)
        out.append({"id": f"q_{k:04d}", "timestamp": t.strftime("%Y/%m/%d %H:%M:%S"), "hour_bin": name})
    return out


def half_hour(t):
    """The nearest half hour; a quarter past goes up."""
    from datetime import timedelta

    whole = t.replace(minute=0, second=0, microsecond=0)
    return whole + timedelta(minutes=30 * ((t - whole + timedelta(minutes=15)) // timedelta(minutes=30)))


def point_questions(start: str, regions: dict[str, str], bins: dict[str, tuple[str, int]], each: int, seed: int = 7) -> list[dict]:
    """Each questions for every region and time bin: a day in the year from start, every seventh one on a weekend, a time near the bin's."""
    import random
    from datetime import datetime, timedelta

    rng, first, out = random.Random(seed), datetime.fromisoformat(start), []
    for region, name in regions.items():
        for label, (clock, jitter) in bins.items():
            for k in range(each):
                h, m, s = map(int, clock.split(":"))
                t = first + timedelta(days=rng.randrange(365))
                while (t.weekday() >= 5) != (k % 7 == 6):
                    t += timedelta(days=1)
                t = half_hour(t + timedelta(hours=h, minutes=m + rng.randint(-jitter // 2, jitter // 2), seconds=s))
                out.append({"id": f"{region}_{len(out):03d}", "region": region, "region_name": name, "timestamp": t.strftime("%Y/%m/%d %H:%M:%S"), "hour_bin": label, "text": f"What will demand and price be in {name} at {t:%Y-%m-%d %H:%M}?"})
    return out


def hourly_questions(start: str, regions: dict[str, str], hours: tuple[int, ...], seed: int = 7) -> list[dict]:
    """For every region and horizon a question over so many hours from a half hour of the month after start; ids hold 'hourly'."""
    import random
    from datetime import datetime, timedelta

    rng, first, out = random.Random(seed), datetime.fromisoformat(start), []
    for region, name in regions.items():
        for n in hours:
            t = first + timedelta(minutes=30 * rng.randrange(48 * 30))
            out.append({"id": f"{region}_hourly_{len(out):03d}", "region": region, "region_name": name, "forecast_horizon_hours": n, "start_timestamp": t.strftime("%Y/%m/%d %H:%M:%S"), "text": f"Forecast demand and price in {name} for each hour of the next {n} hours from {t:%Y-%m-%d %H:%M}."})
    return out
