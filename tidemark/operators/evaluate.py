"""Accuracy, significance, reproducibility and cost of forecasting models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import EvaluationConfig
from .ordered import previous, running_sums
from .stats import quantiles

# --- fixed values: the stages of a run in their order ---
STAGES = ("reproducibility", "horizon", "pattern", "stats", "summary")
# --- end of fixed values ---
#: Weights of a Poisson variable of mean 1 up to 8; more is rarer than one in a million.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
_PRIME = 2_147_483_647


def with_truth(predictions: DataFrame, truth: DataFrame, key: str = "query_id") -> DataFrame:
    """Left join, many to one; a repeated key of truth raises."""
    if not truth.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"ground truth has repeated {key}")
    return predictions.join(truth, key, "left")


def error(prediction: Column, truth: Column, absolute: bool = True) -> Column:
    """X30."""
    return F.abs(truth - prediction) if absolute else truth - prediction


def normalised_error(df: DataFrame, model: str = "model", key: str = "query_id") -> DataFrame:
    """The mean of |error| / |truth| over the runs of a question."""
    e = F.abs(F.col("ground_truth") - F.col("prediction")) / F.abs(F.col("ground_truth"))
    return df.where(F.abs(F.col("ground_truth")) > 0).groupBy(model, key).agg(F.avg(e).alias("error"))


def pairs(errors: DataFrame, model: str = "model", key: str = "query_id") -> DataFrame:
    """Errors of each two models on the questions that both have."""
    a = errors.select(F.col(model).alias("model_a"), key, F.col("error").alias("error_a"))
    b = errors.select(F.col(model).alias("model_b"), key, F.col("error").alias("error_b"))
    return a.join(b, key).where("model_a < model_b and error_a is not null and error_b is not null")


def reproducibility(df: DataFrame, model: str = "model", key: str = "query_id", value: str = "prediction") -> DataFrame:
    """The coefficient of variation over the runs of each question (two at least), and its mean by model."""
    v = F.col(value)
    q = df.groupBy(model, key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).where("n >= 2")
    q = q.withColumn("cv", F.when(F.abs("mean") > 1e-9, F.col("std") / F.abs("mean")))
    return q.groupBy(model).agg(F.avg("cv").alias("mean_cv"), F.avg("std").alias("mean_std"), F.count(F.lit(1)).alias("n_queries"))


def _p_normal(z: Column) -> Column:
    """Two-sided p of a standard normal: 1 - P(|x| <= z), as the series of erf below 3 and its continued fraction above."""
    x = F.abs(z) / math.sqrt(2)
    term = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(F.lit(0.0).alias("s"), x.cast("double").alias("t")), lambda acc, n: F.struct((acc["s"] + acc["t"] / (2 * n + 1)).alias("s"), (acc["t"] * (-(x * x)) / (n + 1)).alias("t")))["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x.cast("double"), lambda acc, k: x + (k / F.lit(2.0)) / acc)
    return F.when(z.isNull(), None).when(x < 3, 1 - 2 / math.sqrt(math.pi) * term).otherwise(F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * fraction))


def loss_difference(p: DataFrame, order: str = "query_id", absolute: bool = False, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """A23 (squared loss, plain variance, 10 pairs at least) or A24 (absolute loss, one lag of weight 1/2 in the variance, 4 at least): mean loss difference by
    its standard error. The question before comes from an ordered scan, so a pair of models may have any number of questions."""
    by, least = ("model_a", "model_b"), cfg.min_loss_lagged if absolute else cfg.min_loss
    d = (F.abs("error_a") - F.abs("error_b")) if absolute else (F.col("error_a") * F.col("error_a") - F.col("error_b") * F.col("error_b"))
    rows = p.select(*by, order, d.alias("d"))
    variance = F.var_samp("d")
    if absolute:
        rows = previous(rows, order, by, {"d": "before"})
        variance += F.covar_samp(F.when(F.col("before").isNotNull(), F.col("d")), F.col("before"))
    out = rows.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), variance.alias("v"))
    usable = (F.col("n") >= least) & (F.col("v") > 0)
    stat = F.when(usable, F.col("mean") / F.sqrt(F.when(usable, F.col("v") / F.col("n"))))
    return out.select(*by, "n", stat.alias("dm")).withColumn("p_value", _p_normal(F.col("dm")))


def exact_signed_p(n: Column, statistic: Column) -> Column:
    """Two-sided p of the smaller rank sum of n differences without ties or zeros: among the 2**n choices of signs, how many give this sum or less.

    Dynamic programming over the ranks: ways[s] counts the sets of ranks up to r that sum to s; the sums beyond the statistic aren't needed. n is 62 at most.
    """
    top = statistic.cast("int")
    one = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1).otherwise(0).cast("long"))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, lambda acc, r: F.transform(acc, lambda x, s: x + F.when(s >= r, F.get(acc, s - r)).otherwise(0)))
    below = F.aggregate(ways, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def signed_ranks(p: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Ranks of |d| (zeros dropped, ties share their mean rank): the smaller rank sum and its two-sided p. The p is exact up to cfg.exact_signed pairs
    without ties and zeros, else normal with tie correction. Null below cfg.min_signed pairs. exact: which it is. Ranks are running counts of distinct
    sizes by an ordered scan."""
    by = ("model_a", "model_b")
    d = p.select(*by, (F.abs("error_a") - F.abs("error_b")).alias("d")).where("d is not null").withColumn("size", F.abs("d"))
    counted = d.groupBy(*by, "size").agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.count(F.lit(1)).alias("t"))
    zeros = F.col("size") == 0
    ranked = running_sums(counted, "size", by, {"below": F.when(zeros, 0).otherwise(F.col("t"))}, ahead=True).withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    full = lambda c: F.sum(F.when(~zeros, c).otherwise(0))
    t, up = F.col("t"), F.col("up")
    s = ranked.groupBy(*by).agg(full(F.col("rank") * up).alias("plus"), full(F.col("rank") * (t - up)).alias("minus"), full(t).alias("n"), full(t * t * t - t).alias("ties"), F.sum(F.when(zeros, t).otherwise(0)).alias("zeros"))
    w, n = F.least("plus", "minus"), F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    enough = F.col("n") + F.col("zeros") >= cfg.min_signed
    exact = enough & (F.col("n") + F.col("zeros") <= cfg.exact_signed) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    out = s.where("n > 0").select(*by, "n", exact.alias("exact"), F.when(enough, w).alias("statistic"), F.when(enough, F.try_divide(w - n * (n + 1) / 4, F.nullif(sd, F.lit(0.0)))).alias("z"))
    return out.select(*by, "n", "statistic", F.when(F.col("exact"), exact_signed_p(F.col("n"), F.col("statistic"))).otherwise(_p_normal(F.col("z"))).alias("p_value"), "exact")


def poisson_weights(seed, resample):
    """How often a resample draws a row: Poisson(1) from a number of the row and the number of the resample (integers or arrays of them).

    Arithmetic modulo a prime below 2**31, so SQL engines give the same numbers.
    """
    import numpy as np

    y = (seed + resample * 1_299_709) % _PRIME
    for add in (12_345, seed, resample):
        y = (y * y + add) % _PRIME
    return np.searchsorted(_POISSON, y / _PRIME, side="right")


def _intervals(own: DataFrame, means: DataFrame, by: tuple[str, ...], cfg: EvaluationConfig) -> DataFrame:
    """own: by, error; means: by, m, r of each resample."""
    tail = (1 - cfg.confidence) / 2
    ends = F.array(F.lit(tail), F.lit(1 - tail))
    interval = means.groupBy(*by).agg(F.percentile("m", ends).alias("_m"), F.percentile("r", ends).alias("_r"))
    point = own.groupBy(*by).agg(F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.count("error").alias("n"))
    return point.join(interval, list(by)).select(*by, "mae", "rmse", F.col("_m")[0].alias("lo"), F.col("_m")[1].alias("hi"), F.col("_r")[0].alias("rmse_lo"), F.col("_r")[1].alias("rmse_hi"), "n")


def weighted_bootstrap(errors: DataFrame, by: tuple[str, ...] = ("model",), cfg: EvaluationConfig = EvaluationConfig(), batch: int = 1024) -> DataFrame:
    """A21 in one pass without any grouping: (by, mae, rmse, lo, hi, rmse_lo, rmse_hi, n).

    Instead of drawing rows (bootstrap() does), each row gets Poisson(1) weights for every resample, from a number of its key (first digits of its MD5 and cfg.seed), in
    partial sums, so a model's errors never meet in one task. Poisson weights stand for resampling: their sums vary by a little.
    """
    import numpy as np
    import pyarrow as pa

    b = cfg.resamples
    names = [*by, "w", "s", "q"]

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                rb = whole.slice(lo, batch)
                weight = poisson_weights(rb.column(len(by) + 1).to_numpy()[:, None], np.arange(b)[None])
                e = np.abs(rb.column(len(by)).to_numpy())
                keys = list(zip(*(rb.column(k).to_pylist() for k in range(len(by)))))
                for key in set(keys):
                    own = np.array([k == key for k in keys])
                    w = weight[own]
                    sums[key] = sums.get(key, 0) + np.stack([w.sum(axis=0), e[own] @ w, (e[own] ** 2) @ w])
        for key, parts in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.string()) for x in key], *[pa.array([p.astype(float).tolist()]) for p in parts]], names=names)

    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(cfg.seed)), F.col("query_id").cast("string"), *by)), 1, 7), 16, 10).cast("long")
    own = errors.where("error is not null").select(*[F.col(c).cast("string").alias(c) for c in by], F.col("error").cast("double").alias("error"), number.alias("number"))
    parts = own.mapInArrow(partial, ", ".join([*(f"{c} string" for c in by), "w array<double>", "s array<double>", "q array<double>"]))
    places = parts.select(*by, F.posexplode(F.arrays_zip("w", "s", "q")).alias("k", "x"))
    drawn = F.nullif(F.sum("x.w"), F.lit(0.0))
    means = places.groupBy(*by, "k").agg((F.sum("x.s") / drawn).alias("m"), F.sqrt(F.sum("x.q") / drawn).alias("r"))
    return _intervals(own, means, by, cfg)


def bootstrap(errors: DataFrame, by: tuple[str, ...] = ("model",), cfg: EvaluationConfig = EvaluationConfig(), key: str = "query_id", rows_each: int = 5000) -> DataFrame:
    """Mean absolute and root mean squared error with percentile intervals: (by, mae, rmse, lo, hi, rmse_lo, rmse_hi, n), over resamples that draw exactly as
    many rows as a group has, with replacement.

    A resample is drawn in two steps: how many of its rows fall to each part of the group (multinomial, from the parts' sizes), then which rows of the
    part. Parts hold about rows_each rows by a hash, so no task holds a group, only its parts' sizes; partial sums meet in the end. Draws depend on cfg.seed,
    the group's name, the part and the resample alone.
    """
    import hashlib

    import numpy as np
    import pandas as pd

    b, names = cfg.resamples, list(by)
    own = errors.where("error is not null").select(*[F.col(c).cast("string").alias(c) for c in by], F.col("error").cast("double").alias("error"), F.col(key).cast("string").alias("_key"))
    wanted = own.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_each).cast("long").alias("_parts"))
    dealt = own.join(wanted, names).withColumn("_part", F.pmod(F.xxhash64("_key", "error"), F.col("_parts"))).drop("_parts")

    def rng_of(*parts) -> np.random.Generator:
        return np.random.default_rng(int(hashlib.sha256("|".join(map(str, (cfg.seed, *parts))).encode()).hexdigest()[:15], 16))

    def shares(group, frame):
        frame = frame.sort_values("_part")
        sizes = frame["_n"].to_numpy()
        drawn = rng_of(*group).multinomial(sizes.sum(), sizes / sizes.sum(), size=b)
        return pd.DataFrame({**{c: [v] * len(frame) for c, v in zip(by, group)}, "_part": frame["_part"], "_drawn": [drawn[:, k].tolist() for k in range(len(frame))]})

    columns = ", ".join(f"{c} string" for c in by)
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    plan = sizes.groupBy(*by).applyInPandas(shares, f"{columns}, _part long, _drawn array<long>")

    def partial(group, rows, drawn):
        e = np.sort(np.abs(rows["error"].to_numpy()))
        rng, counts = rng_of(*group), np.asarray(drawn["_drawn"].iloc[0])
        s, q = np.zeros(b), np.zeros(b)
        for k in range(b):
            x = e[rng.integers(0, len(e), counts[k])]
            s[k], q[k] = x.sum(), (x * x).sum()
        return pd.DataFrame({**{c: [v] for c, v in zip(by, group)}, "s": [s.tolist()], "q": [q.tolist()]})

    keys = [*by, "_part"]
    parts = dealt.groupBy(*keys).cogroup(plan.groupBy(*keys)).applyInPandas(partial, f"{columns}, s array<double>, q array<double>")
    n = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sums = parts.select(*by, F.posexplode(F.arrays_zip("s", "q")).alias("k", "x")).groupBy(*by, "k").agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
    means = sums.join(n, names).select(*by, "k", (F.col("s") / F.col("_n")).alias("m"), F.sqrt(F.col("q") / F.col("_n")).alias("r"))
    return _intervals(own, means, by, cfg)


def all_pairs(errors: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Each two models on the questions that both have: mean errors, signed-rank statistic and p, winner (the smaller median, where p is below
    cfg.winner_below; else none), in order of the better mean."""
    by = ["model_a", "model_b"]
    p = pairs(errors)
    means = p.groupBy(*by).agg(F.avg("error_a").alias("mae_a"), F.avg("error_b").alias("mae_b"), F.count(F.lit(1)).alias("n"))
    sides = p.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"error_{s}").alias("error")) for s in "ab"])).alias("e")).select(*by, "e.*")
    middle = quantiles(sides, "error", (*by, "side"), (50,))
    medians = middle.groupBy(*by).agg(*[F.max(F.when(F.col("side") == s, F.col("q")[0])).alias(f"median_{s}") for s in "ab"])
    means = means.join(medians, by)
    tests = signed_ranks(p, cfg).select(*by, "statistic", "p_value")
    winner = F.when(F.col("p_value") < cfg.winner_below, F.when(F.col("median_a") < F.col("median_b"), F.col("model_a")).otherwise(F.col("model_b")))
    return means.join(tests, by, "left").withColumns({"winner": winner, "stars": stars(F.coalesce("p_value", F.lit(1.0)))}).orderBy(F.least("mae_a", "mae_b"), *by)


def significance(errors: DataFrame, baselines: tuple[str, ...], cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Each model against each baseline on shared questions: both tests, stars of the smaller p, and who is better by the sign."""
    p = pairs(errors)
    mixed = p.where(F.col("model_a").isin(*baselines) != F.col("model_b").isin(*baselines))
    swap = F.col("model_a").isin(*baselines)
    own = mixed.select("query_id", F.when(swap, F.col("model_b")).otherwise(F.col("model_a")).alias("model_a"), F.when(swap, F.col("model_a")).otherwise(F.col("model_b")).alias("model_b"), F.when(swap, F.col("error_b")).otherwise(F.col("error_a")).alias("error_a"), F.when(swap, F.col("error_a")).otherwise(F.col("error_b")).alias("error_b"))
    dm = loss_difference(own, absolute=True, cfg=cfg).select("model_a", "model_b", "n", "dm", F.col("p_value").alias("dm_p"))
    both = dm.join(signed_ranks(own, cfg).select("model_a", "model_b", "statistic", F.col("p_value").alias("signed_p")), ["model_a", "model_b"], "left").where(F.col("n") >= cfg.min_shared)
    least = F.least(F.coalesce("dm_p", F.lit(1.0)), F.coalesce("signed_p", F.lit(1.0)))
    return both.withColumns({"stars": stars(least), "direction": F.when(F.col("dm") < 0, "model better").otherwise("baseline better")})


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], aliases: dict[str, str] | None = None) -> Column:
    """Prices: USD for 1,000 tokens in and out by model; aliases: other names of models. Unknown models cost nothing."""
    table = prices | {other: prices[name] for other, name in (aliases or {}).items() if name in prices}
    if not table:
        return F.lit(0.0)
    price = [F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v[side]))]) for side in (0, 1)]
    return tokens_in / 1000 * F.coalesce(price[0][model], F.lit(0.0)) + tokens_out / 1000 * F.coalesce(price[1][model], F.lit(0.0))


def cost_by_stage(calls: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Mean and deviation of cost and latency of each model and stage, stages in their order."""
    order = calls.sparkSession.createDataFrame([(s, k) for k, s in enumerate(stages)], "stage string, stage_order int")
    found = calls.groupBy("model", "stage").agg(F.avg("cost_usd").alias("mean_cost"), F.stddev_samp("cost_usd").alias("std_cost"), F.avg("latency_sec").alias("mean_latency"), F.stddev_samp("latency_sec").alias("std_latency"), F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(order), "stage")


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, errors, token and cost sums, means without infinities."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.when(F.col("error").isNotNull() & (F.col("error") != ""), 1).otherwise(0)).alias("errors"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"), F.avg(finite("latency_sec")).alias("mean_latency"), F.avg(finite("cost_usd")).alias("mean_cost"))
