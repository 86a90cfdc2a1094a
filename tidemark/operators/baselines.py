"""Forecast baselines and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import ScanConfig
from . import resample
from .ordered import in_blocks, micros


def persistence(history: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), cfg: ScanConfig | None = None) -> DataFrame:
    """For each target the latest value strictly before it. A sorted union with a running last, never a range join.

    The union is scanned in blocks that follow its density; what the end of each block passes on is one row, so a long or dense series spreads over many tasks.
    """
    last = history.where("value is not null").groupBy(*by, "ts").agg(F.min("value").alias("value"))
    h = last.select(*by, "ts", "value", F.lit(None).cast("long").alias("target"), F.lit(1).alias("kind"))
    t = targets.select(*by, "ts", F.lit(None).cast("double").alias("value"), F.col("target_id").cast("long").alias("target"), F.lit(0).alias("kind"))
    rows, cut = in_blocks(h.unionByName(t), "ts", by, (), cfg)
    inside = Window.partitionBy("_g", "_block").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # at equal times targets (kind 0) come first, so that the value at the target itself is not seen
    found = rows.withColumn("prediction", F.last("value", True).over(inside)).where("kind = 0")
    if cut:
        carry = rows.groupBy("_g", "_block").agg(F.max_by("value", F.when(F.col("kind") == 1, F.col("ts"))).alias("value"))
        blocks = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = carry.select("_g", "_block", F.last("value", True).over(blocks).alias("carried"))
        found = found.join(carried, ["_g", "_block"]).withColumn("prediction", F.coalesce("prediction", "carried"))
    return found.select(*by, F.col("target").alias("target_id"), "ts", "prediction")


def seasonal_naive(history: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), tolerance_minutes: int = 30, cfg: ScanConfig | None = None) -> DataFrame:
    """The latest earlier value of the same weekday and hour and near the minute; else of the same hour.

    Two as-of joins like that of persistence: by hour; and by weekday, hour and the target's minute, to which each value is sent that lies near
    it (the minutes that targets have in an hour of a week, 60 at most). Never targets times history.
    """
    parts = {"_weekday": F.weekday("ts"), "_hour": F.hour("ts"), "_minute": F.minute("ts")}
    h, t = history.where("value is not null").select(*by, "ts", "value").withColumns(parts), targets.withColumns(parts)
    slot = [*by, "_weekday", "_hour"]
    asked = t.select(*slot, F.col("_minute").alias("_asked")).distinct()
    near = h.join(asked, slot).where(F.abs(F.col("_minute") - F.col("_asked")) <= tolerance_minutes).select(*slot, F.col("_asked").alias("_minute"), "ts", "value")
    same = persistence(near, t, (*slot, "_minute"), cfg).select(*by, "target_id", "ts", F.col("prediction").alias("same"))
    hourly = persistence(h, t, (*by, "_hour"), cfg).select(*by, "target_id", "ts", F.col("prediction").alias("hourly"))
    return same.join(hourly, [*by, "target_id", "ts"]).select(*by, "target_id", "ts", F.coalesce("same", "hourly").alias("prediction"))


def truth(targets: DataFrame, readings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The value at each target's time."""
    exact = readings.groupBy(*by, "ts").agg(F.min("value").alias("ground_truth"))
    return targets.join(exact, [*by, "ts"], "left")


def _companion(phi: float, big: float, season: int):
    """Autoregressive coefficients of (1 - phi B)(1 - big B**season)."""
    import numpy as np

    ar = np.zeros(season + 1)
    ar[0], ar[season - 1], ar[season] = phi, big, -phi * big
    if season == 1:
        ar[0] = phi + big
    return ar


def kalman_errors(w, phi: float, theta: float, big: float, season: int, settled: float = 1e-11):
    """(v, f): one-step errors of the stationary series w under (1,.,1)(1,.,0)season and their variances in units of the noise, by a Kalman filter.

    The state has season + 1 numbers and begins in its stationary distribution, so the likelihood is exact from the first value on. Once the variance has
    settled at 1, the filter is the plain recursion of the errors.
    """
    import numpy as np

    w, n, ar = np.asarray(w, dtype=float), len(w), _companion(phi, big, season)
    r = season + 1
    noise = np.zeros(r)
    noise[0], noise[1] = 1.0, theta

    def moved(p):
        """T p T' for the companion matrix T."""
        half = ar[:, None] * p[0][None]
        half[:-1] += p[1:]
        out = half[:, :1] * ar[None]
        out[:, :-1] += half[:, 1:]
        return out

    q = np.outer(noise, noise)
    step = np.zeros((r, r))
    step[:, 0] = ar
    step[:-1, 1:] += np.eye(r - 1)
    p, power = q.copy(), step
    for _ in range(60):  # doubling: the sum of T**k q T'**k
        more = power @ p @ power.T
        p, power = p + more, power @ power
        if np.abs(more).max() <= 1e-14 * np.abs(p).max():
            break
    v, f, a = np.zeros(n), np.ones(n), np.zeros(r)
    flat = np.convolve(w, np.concatenate([[1.0], -ar]))[:n]  # the series without its autoregressive part
    for t in range(n):
        if t > r and abs(f[t - 1] - 1) < settled:
            last = v[t - 1]
            for k in range(t, n):
                last = flat[k] - theta * last
                v[k] = last
            break
        v[t], f[t] = w[t] - a[0], p[0, 0]
        gain = ar * p[0, 0]
        gain[:-1] += p[1:, 0]
        gain /= f[t]
        head = a[0]
        a = np.concatenate([a[1:], [0.0]]) + ar * head + gain * v[t]
        p = moved(p) + q - np.outer(gain, gain) * f[t]
    return v, f


def log_likelihood(w, phi: float, theta: float, big: float, season: int) -> float:
    """Exact, with the noise's variance at its best value."""
    import numpy as np

    v, f = kalman_errors(w, phi, theta, big, season)
    n = len(v)
    return float(-0.5 * (n * np.log(2 * np.pi * max(np.mean(v * v / f), 1e-300)) + np.log(f).sum() + n))


def fit_sarima(y, horizon: int, season: int = 48, iterations: int = 50):
    """(1,1,1)(1,1,0)season by exact maximum likelihood: fitted values inside the sample (NaN before the first that differences give), forecasts, and the
    coefficients (autoregressive, moving average, seasonal).

    Coefficients stay inside (-1, 1) by a hyperbolic tangent; the search is a simplex (Nelder and Mead) over these three numbers.
    """
    import numpy as np

    y = np.asarray(y, dtype=float)
    if len(y) < 2 * season or len(y) < season + 3:
        raise ValueError(f"at least {max(2 * season, season + 3)} values are needed")
    w = np.diff(y)
    w = w[season:] - w[:-season]

    def loss(x) -> float:
        return -log_likelihood(w, *np.tanh(x).tolist(), season)

    points = [np.zeros(3), *(0.5 * np.eye(3))]
    found = sorted(((loss(p), k, p) for k, p in enumerate(points)), key=lambda f: f[:2])
    for n in range(2 * iterations):
        best, worst = found[0], found[-1]
        if worst[0] - best[0] <= 1e-6 * (abs(best[0]) + 1e-300):
            break
        middle = sum(p for *_, p in found[:-1]) / 3
        tried = middle + (middle - worst[2])
        value = loss(tried)
        if value < best[0]:
            further = middle + 2 * (middle - worst[2])
            value, tried = min(((value, 0, tried), (loss(further), 1, further)), key=lambda f: f[:2])[::2]
        elif value >= found[-2][0]:
            tried = middle + 0.5 * (worst[2] - middle)
            value = loss(tried)
            if value >= worst[0]:
                found = [best] + [(loss(q), 10 * n + k, q) for k, q in enumerate(best[2] + 0.5 * (p - best[2]) for *_, p in found[1:])]
                found.sort(key=lambda f: f[:2])
                continue
        found[-1] = (value, 1000 + n, tried)
        found.sort(key=lambda f: f[:2])
    phi, theta, big = np.tanh(found[0][2]).tolist()
    v, _ = kalman_errors(w, phi, theta, big, season)
    fitted = np.full(len(y), np.nan)
    fitted[season + 1 :] = y[season + 1 :] - v
    ar, ws, ys, last = _companion(phi, big, season), w.tolist(), y.tolist(), float(v[-1])
    for _ in range(horizon):
        step = sum(c * ws[-k] for k, c in enumerate(ar, 1) if c and k <= len(ws)) + theta * last
        last = 0.0
        ws.append(step)
        ys.append(ys[-1] + ys[-season] - ys[-season - 1] + step)
    return fitted, ys[len(y) :], (phi, theta, big)


def sarima(history: DataFrame, horizon: int, by: tuple[str, ...], rows: int = 1344, season: int = 48) -> DataFrame:
    """M16 as (by, step, prediction): the next steps of each group behind its last half hour."""
    return _sarima(history, by, rows, season, F.lit(horizon)).where("step > 0").select(*by, "step", "prediction")


def _sarima(history: DataFrame, by: tuple[str, ...], rows: int, season: int, ahead) -> DataFrame:
    """(by, slot, step, prediction) on the last rows half hours of the regular grid of each group, and ahead steps behind it: bounded groups, fitted in numpy.
    ahead may depend on columns of history. Groups that are too short give no rows."""
    own = history.withColumn("_ahead", ahead.cast("long"))
    asked = own.groupBy(*by).agg(F.max("_ahead").alias("_ahead"))
    grid = resample.regular(history, "ts", "value", 1800, by)
    last = grid.groupBy(*by).agg(F.max("slot").alias("_last"))
    tail = grid.join(last, list(by)).where(F.col("slot") > F.col("_last") - rows).drop("_last").join(asked, list(by))

    def fit(key, frame):
        import numpy as np
        import pandas as pd

        s = frame.sort_values("slot")
        try:
            fitted, out, _ = fit_sarima(s["value"].to_numpy(), max(0, int(s["_ahead"].iloc[0])), season)
        except ValueError:
            fitted, out = [], []
        n = len(fitted) + len(out)
        first = int(s["slot"].iloc[0])
        predictions = pd.Series([*fitted, *out], dtype="float64")
        return pd.DataFrame({**{b: pd.Series([k] * n, dtype="object") for b, k in zip(by, key)}, "slot": np.arange(first, first + n, dtype="int64"), "step": np.arange(1 - len(fitted), 1 + len(out), dtype="int32"), "prediction": predictions.where(predictions.notna(), None)})

    schema = ", ".join([*(f"{b} string" for b in by), "slot long", "step int", "prediction double"])
    return tail.groupBy(*by).applyInPandas(fit, schema)


def sarima_at(history: DataFrame, targets: DataFrame, by: tuple[str, ...], rows: int = 1344, season: int = 48) -> DataFrame:
    """M16 for targets: (by, target_id, ts, prediction). Inside the sample the fitted value of the nearest half hour (the first one's for earlier targets), beyond it
    the forecast of the last half hour that has begun, one step at least. Null where a group is too short or has no fitted value there."""
    half = 1_800_000_000
    at = micros(F.col("ts")) / half
    last = history.where("value is not null").groupBy(*by).agg(F.floor(micros(F.max("ts")) / half).alias("_last"))
    placed = targets.join(last, list(by), "left").withColumn("_slot", F.when(at <= F.col("_last"), F.greatest(F.round(at), F.col("_last") - rows + 1)).otherwise(F.greatest(F.floor(at), F.col("_last") + 1)).cast("long"))
    steps = placed.groupBy(*by).agg(F.max(F.col("_slot") - F.col("_last")).alias("_steps"))
    known = history.where("value is not null").join(steps, list(by))
    values = _sarima(known, by, rows, season, F.greatest(F.col("_steps"), F.lit(0))).select(*by, F.col("slot").alias("_slot"), "prediction")
    return placed.join(values, [*by, "_slot"], "left").select(*by, "target_id", "ts", "prediction")


def run(history: DataFrame, targets: DataFrame, readings: DataFrame, by: tuple[str, ...] = (), seasonal_model: bool = False, sequence_model: bool = False) -> DataFrame:
    """A row for each target: persistence, seasonal naive, ground truth; seasonal_model: sarima as well; sequence_model: tft as well."""
    keys = [*by, "target_id", "ts"]
    p = persistence(history, targets, by).withColumnRenamed("prediction", "persistence")
    s = seasonal_naive(history, targets, by).withColumnRenamed("prediction", "seasonal_naive")
    out = p.join(s, keys)
    if seasonal_model:
        out = out.join(sarima_at(history, targets, by).withColumnRenamed("prediction", "sarima"), keys)
    if sequence_model:
        from . import sequence

        out = out.join(sequence.predict(history, targets, by).select(*keys, F.col("prediction").alias("tft")), keys)
    return out.join(truth(targets, readings, by).select(*keys, "ground_truth"), keys)


def errors(results: DataFrame, methods: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute and root mean squared error of each method over valid pairs."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("prediction")) for m in methods])).alias("c")
    e = results.select(*by, "ground_truth", cells).select(*by, "c.method", (F.col("c.prediction") - F.col("ground_truth")).alias("e")).where("e is not null")
    return e.groupBy(*by, "method").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("e").alias("n"))


def monthly_splits(df: DataFrame, start: str, end: str, months: int = 1) -> DataFrame:
    """(split, cutoff, test_end) of rolling monthly splits."""
    first = F.lit(start).cast("date")
    begins = F.expr("filter(sequence(date_trunc('month', _s), date_trunc('month', _e), interval 1 month), x -> x >= _s)")
    m = df.sparkSession.range(1).select(first.cast("timestamp_ntz").alias("_s"), F.lit(end).cast("timestamp_ntz").alias("_e")).select(F.posexplode(begins).alias("split", "cutoff"), F.col("_e"))
    stop = F.expr(f"cutoff + make_interval(0, {months})")
    return m.select("split", F.col("cutoff").cast("timestamp_ntz").alias("cutoff"), stop.cast("timestamp_ntz").alias("test_end")).where(F.col("test_end") <= F.lit(end).cast("timestamp_ntz") + F.expr("interval 2 days"))


__all__ = ["errors", "fit_sarima", "monthly_splits", "persistence", "run", "sarima", "sarima_at", "seasonal_naive", "truth"]
