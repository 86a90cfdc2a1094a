"""Scans in order: places, running sums and neighbours of rows, in blocks that follow the rows' density.

Cut points come from a sample of the order's keys, so that a block holds about as many rows wherever it lies: one dense hour is cut as finely as ten years.
A row's block is found by binary search inside the JVM. Windows then run within (series, block), and what a block passes on to the next ones is one row.
A key that repeats so often that it fills blocks alone is cut once more, by the columns that order its rows.

Bounds: the driver holds the sample, samples_per_block x max_blocks keys at most; a series has max_blocks rows of block totals. Where all rows fit one
block there are no cuts, and the window runs over the series as it is.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import ScanConfig

SCAN = ScanConfig()
_SUB = 1 << 20


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the wall clock, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _key(df: DataFrame, name: str) -> Column:
    """A number that grows with the column (equal for some neighbours, never in another order). Nulls are smallest, NaN largest."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = micros(c).cast("double")
    elif isinstance(kind, T.NumericType):
        number = F.nanvl(c.cast("double"), F.lit(float("inf")))
    else:
        # six bytes behind what the smallest and the largest have in common
        ends = df.agg(F.min(c.cast("string")), F.max(c.cast("string"))).first()
        lo, hi = ((x or "").encode() for x in ends)
        same = next((k for k, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        tail = F.rpad(F.hex(F.substring(F.encode(c.cast("string"), "UTF-8"), same + 1, 6)), 12, "0")
        number = F.conv(tail, 16, 10).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def in_blocks(df: DataFrame, order: str, by: tuple[str, ...] = (), then: tuple[str, ...] = (), cfg: ScanConfig | None = None) -> tuple[DataFrame, bool]:
    """df with _g, a row's series, and _block; whether there is more than one block. Blocks of a series follow each other in the order (order, then)."""
    from pyspark.ml.feature import Bucketizer

    cfg = cfg or SCAN
    own = df.withColumn("_g", F.struct(*[F.col(b) for b in by], F.lit(0).alias("_")))
    n = df.count()
    if n <= cfg.rows_per_block:
        return own.withColumn("_block", F.lit(0).cast("long")), False
    key = _key(df, order)
    share = min(1.0, cfg.samples_per_block / max(cfg.rows_per_block, n / cfg.max_blocks))
    tied = F.struct(*[F.col(c) for c in then]) if then else F.struct(F.lit(0).alias("_"))
    sample = df.select(key.alias("_key"), tied.alias("_then")).sample(share, 17).toArrow()
    keys = sorted(sample.column("_key").to_pylist())
    hot = [k for k, times in Counter(keys).items() if times >= 2 * cfg.samples_per_block] if then else []
    # a hot key lies alone between two cuts
    wanted = {*keys[cfg.samples_per_block :: cfg.samples_per_block], *hot, *(math.nextafter(k, math.inf) for k in hot)}
    cuts = sorted(k for k in wanted if abs(k) < math.inf)
    own = own.withColumn("_key", key)
    if cuts:
        placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="_place").transform(own)
    else:
        placed = own.withColumn("_place", F.lit(0.0))
    block = F.col("_place").cast("long") * _SUB
    if hot:
        tied_rows = df.sparkSession.createDataFrame(sample).where(F.col("_key").isin(hot))
        inner = F.filter(F.array_sort(F.collect_list("_then")), lambda x, k: (k > 0) & (k % cfg.samples_per_block == 0))
        subs = F.broadcast(tied_rows.groupBy("_key").agg(inner.alias("_subs")))  # a part of the sample
        placed = placed.join(subs, "_key", "left")
        block = block + F.coalesce(F.size(F.filter("_subs", lambda s: s <= tied)), F.lit(0))
    return placed.select(*df.columns, "_g", block.alias("_block")), True


def _window(order: tuple[str, ...]):
    return Window.partitionBy("_g", "_block").orderBy(*order)


def numbered(df: DataFrame, order: str, by: tuple[str, ...] = (), name: str = "time_idx", then: tuple[str, ...] = (), cfg: ScanConfig | None = None) -> DataFrame:
    """df with the place of each row in its series, from 0, in the order (order, then), nulls first. Rows that are equal in these are told apart by their contents."""
    own = df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    own, cut = in_blocks(own, order, by, (*then, "_tie"), cfg)
    inside = F.row_number().over(_window((order, *then, "_tie"))).cast("long") - 1
    if not cut:
        return own.select(*df.columns, inside.alias(name))
    counts = own.groupBy("_g", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_g", "_block", before.alias("_first"))
    return own.withColumn("_inside", inside).join(starts, ["_g", "_block"]).select(*df.columns, (F.col("_first") + F.col("_inside")).alias(name))


def running_sums(df: DataFrame, order: str, by: tuple[str, ...], sums: dict[str, Column], cfg: ScanConfig | None = None, ahead: bool = False) -> DataFrame:
    """df with the sum of each column of sums over the rows of the series up to the row's order, rows of equal order included (ahead: only those before it)."""
    own, cut = in_blocks(df, order, by, (), cfg)
    own = own.withColumns({f"_s{k}": c for k, c in enumerate(sums.values())})
    upto, equal = _window((order,)).rangeBetween(Window.unboundedPreceding, 0), _window((order,)).rangeBetween(0, 0)
    inside = own.withColumns({f"_i{k}": F.sum(f"_s{k}").over(upto) - (F.sum(f"_s{k}").over(equal) if ahead else 0) for k in range(len(sums))})
    if not cut:
        return inside.select(*df.columns, *[F.col(f"_i{k}").alias(n) for k, n in enumerate(sums)])
    blocks = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("_g", "_block").agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in range(len(sums))])
    starts = totals.select("_g", "_block", *[F.coalesce(F.sum(f"_t{k}").over(blocks), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    return inside.join(starts, ["_g", "_block"]).select(*df.columns, *[(F.col(f"_i{k}") + F.col(f"_b{k}")).alias(n) for k, n in enumerate(sums)])


def previous(df: DataFrame, order: str, by: tuple[str, ...], names: dict[str, str], then: tuple[str, ...] = (), cfg: ScanConfig | None = None) -> DataFrame:
    """df with the values that the row before has in its series. names: column -> name of the earlier value; null in a series' first row."""
    own, cut = in_blocks(df, order, by, then, cfg)
    values = F.struct(*[F.col(c) for c in names])
    inside = own.withColumn("_prev", F.lag(values).over(_window((order, *then))))
    if cut:
        edge = own.groupBy("_g", "_block").agg(F.max(F.struct(F.col(order), *[F.col(t) for t in then], values.alias("_v")))["_v"].alias("_last"))
        passed = edge.select("_g", "_block", F.lag("_last").over(Window.partitionBy("_g").orderBy("_block")).alias("_carried"))
        inside = inside.join(passed, ["_g", "_block"]).withColumn("_prev", F.coalesce("_prev", "_carried"))
    return inside.select(*df.columns, *[F.col("_prev")[c].alias(n) for c, n in names.items()])


__all__ = ["in_blocks", "micros", "numbered", "previous", "running_sums"]
