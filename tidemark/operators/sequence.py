"""A trained sequence forecaster: windows of a regular grid as tensors, a gated network with quantile loss in numpy, scored in Arrow batches.

A window is what an encoder of so many hours sees: the values up to an origin. With it go the latest values of the target's hour of day, and the target's place in
the calendar. Values are taken relative to the window's mean and deviation. The network is fitted in one task on a bounded sample of windows (SequenceConfig.samples,
over the last days of all groups, chosen by a hash); forecasts are made where the data lie, for any number of targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SequenceConfig
from . import resample
from .ordered import micros

HOUR = 3_600_000_000


def hourly(history: DataFrame, by: tuple[str, ...], cfg: SequenceConfig = SequenceConfig()) -> DataFrame:
    """(by, slot, value): the hourly grid of the last days of each group, gaps filled."""
    grid = resample.regular(history, "ts", "value", 3600, by).where("value is not null")
    last = grid.groupBy(*by).agg(F.max("slot").alias("_last"))
    return grid.join(last, list(by)).where(F.col("slot") > F.col("_last") - 24 * cfg.days).select(*by, "slot", "value")


def windows(grid: DataFrame, asked: DataFrame, by: tuple[str, ...], cfg: SequenceConfig = SequenceConfig()) -> DataFrame:
    """asked: by, id, origin, slot (the target's hour). asked with past: the cfg.encoder values up to the origin, oldest first; asked whose window isn't whole go.

    Each asked row sends itself to the hours that it needs, so windows of one series spread over all tasks.
    """
    needed = asked.select(*by, "id", "origin", "slot", F.explode(F.sequence(F.col("origin") - cfg.encoder + 1, F.col("origin"))).alias("_at"))
    met = needed.join(grid.select(*by, F.col("slot").alias("_at"), "value"), [*by, "_at"])
    packed = met.groupBy(*by, "id", "origin", "slot").agg(F.collect_list(F.struct("_at", "value")).alias("_p"))
    return packed.where(F.size("_p") == cfg.encoder).select(*by, "id", "origin", "slot", F.transform(F.array_sort("_p"), lambda x: x["value"]).alias("past"))


def features(past, origin, slot):
    """(features, mean, deviation) of windows: the target hour's latest seven values, the last ones, and the calendar."""
    import numpy as np

    n, width = past.shape
    mean, std = past.mean(axis=1), past.std(axis=1)
    std = np.where(std > 1e-9, std, 1.0)
    z = (past - mean[:, None]) / std[:, None]
    ahead = slot - origin
    back = 24 * np.ceil(ahead / 24).astype(int)[:, None] + 24 * np.arange(7)[None] - ahead[:, None]  # hours before the origin
    same = np.take_along_axis(z, np.clip(width - 1 - back, 0, width - 1), axis=1)
    hour, weekday = slot % 24, (slot // 24 + 3) % 7
    turn = 2 * np.pi * np.stack([hour / 24, hour / 12, weekday / 7], axis=1)
    return np.concatenate([same, z[:, -3:], np.sin(turn), np.cos(turn), (weekday >= 5)[:, None], np.log1p(ahead)[:, None] / 6], axis=1), mean, std


class Network:
    """A gated hidden layer beside a linear path, one output for each quantile."""

    def __init__(self, inputs: int, cfg: SequenceConfig, weights: dict | None = None) -> None:
        import numpy as np

        rng, h, q = np.random.default_rng(cfg.seed), cfg.hidden, len(cfg.quantiles)
        self.cfg = cfg
        self.w = weights or {"a": rng.normal(0, 0.2, (inputs, h)), "ab": np.zeros(h), "g": rng.normal(0, 0.2, (inputs, h)), "gb": np.zeros(h), "o": rng.normal(0, 0.05, (h, q)), "l": np.concatenate([np.full((7, q), 1 / 7), np.zeros((inputs - 7, q))]), "b": np.zeros(q)}

    def forward(self, x):
        import numpy as np

        a, g = np.tanh(x @ self.w["a"] + self.w["ab"]), 1 / (1 + np.exp(-np.clip(x @ self.w["g"] + self.w["gb"], -30, 30)))
        return (a * g) @ self.w["o"] + x @ self.w["l"] + self.w["b"], a, g

    def gradients(self, x, y):
        """Of the mean quantile loss: (loss, a gradient for each weight)."""
        import numpy as np

        out, a, g = self.forward(x)
        tau = np.array(self.cfg.quantiles)[None]
        e = y[:, None] - out
        d = np.where(e > 0, -tau, 1 - tau) / e.size
        loss = float(np.mean(np.maximum(tau * e, (tau - 1) * e)))
        dh = d @ self.w["o"].T
        da, dg = dh * g * (1 - a * a), dh * a * g * (1 - g)
        return loss, {"o": (a * g).T @ d, "l": x.T @ d, "b": d.sum(axis=0), "a": x.T @ da, "ab": da.sum(axis=0), "g": x.T @ dg, "gb": dg.sum(axis=0)}

    def fit(self, x, y) -> None:
        """Adam, cfg.epochs passes in batches of cfg.batch."""
        import numpy as np

        rng = np.random.default_rng(self.cfg.seed)
        m, v, t = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(self.cfg.epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), self.cfg.batch):
                own = order[lo : lo + self.cfg.batch]
                t += 1
                for k, g in self.gradients(x[own], y[own])[1].items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - self.cfg.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def samples(grid: DataFrame, by: tuple[str, ...], cfg: SequenceConfig = SequenceConfig()) -> DataFrame:
    """At most cfg.samples windows with a target that is known: origins and steps ahead follow from a hash of the group and the hour."""
    code = lambda k: F.xxhash64(*by, "slot", F.lit(cfg.seed + k))
    ahead = F.pmod(code(1), F.lit(cfg.horizon)).cast("long") + 1
    drawn = grid.select(*by, "slot", F.col("value").alias("wanted"), code(0).alias("_h"), (F.col("slot") - ahead).alias("origin"))
    first = grid.groupBy(*by).agg((F.min("slot") + cfg.encoder).alias("_from"))
    usable = drawn.join(first, list(by)).where(F.col("origin") >= F.col("_from") - 1)
    few = usable.orderBy("_h", "slot").limit(cfg.samples).withColumn("id", F.col("slot"))
    return windows(grid, few, by, cfg).join(few.select(*by, "id", "origin", "wanted"), [*by, "id", "origin"])


def fit(grid: DataFrame, by: tuple[str, ...], cfg: SequenceConfig = SequenceConfig()) -> Network | None:
    """The network, fitted by one task from the bounded sample; None where there is no whole window."""
    import numpy as np
    import pandas as pd

    def run(key, frame):
        frame = frame.sort_values(["slot", "origin", "wanted"])
        x, mean, std = features(np.stack(frame["past"].to_list()), frame["origin"].to_numpy(), frame["slot"].to_numpy())
        net = Network(x.shape[1], cfg)
        net.fit(x, (frame["wanted"].to_numpy() - mean) / std)
        return pd.DataFrame({"name": list(net.w), "shape": [list(w.shape) for w in net.w.values()], "value": [w.ravel().tolist() for w in net.w.values()]})

    own = samples(grid, by, cfg).select("past", "origin", "slot", "wanted").withColumn("_one", F.lit(1))
    found = own.groupBy("_one").applyInPandas(run, "name string, shape array<int>, value array<double>").collect()
    weights = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in found}
    return Network(len(weights["a"]), cfg, weights) if weights else None


def predict(history: DataFrame, targets: DataFrame, by: tuple[str, ...], cfg: SequenceConfig = SequenceConfig(), net: Network | None = None) -> DataFrame:
    """(by, target_id, ts, prediction, lower, upper). A target behind its group's last hour is seen from there, cfg.horizon hours ahead at most; an earlier one from the
    hour before it. Null where no window is whole."""
    import numpy as np
    import pyarrow as pa

    grid = hourly(history, by, cfg)
    net = net or fit(grid, by, cfg)
    keys = [*by, "target_id", "ts"]
    if net is None:
        return targets.select(*keys, *[F.lit(None).cast("double").alias(c) for c in ("prediction", "lower", "upper")])
    last = grid.groupBy(*by).agg(F.max("slot").alias("_last"))
    placed = targets.join(last, list(by)).withColumn("slot", F.floor(micros(F.col("ts")) / HOUR).cast("long"))
    asked = placed.where(F.col("slot") - F.col("_last") <= cfg.horizon).select(*by, F.col("target_id").cast("long").alias("id"), "slot", F.least(F.col("_last"), F.col("slot") - 1).alias("origin"))
    middle = int(np.argmin(np.abs(np.array(cfg.quantiles) - 0.5)))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            past = b.column(len(by) + 3).flatten().to_numpy().reshape(b.num_rows, -1)
            x, mean, std = features(past, b.column(len(by) + 1).to_numpy(), b.column(len(by) + 2).to_numpy())
            out = np.sort(net.forward(x)[0], axis=1) * std[:, None] + mean[:, None]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(by) + 1)), b.column(len(by) + 2), *(pa.array(out[:, k]) for k in (middle, 0, -1))], names=[*by, "target_id", "slot", "prediction", "lower", "upper"])

    schema = ", ".join([*(f"{c} {t}" for c, t in history.select(*by).dtypes), "target_id long, slot long, prediction double, lower double, upper double"])
    made = windows(grid, asked, by, cfg).select(*by, "id", "origin", "slot", "past").mapInArrow(run, schema)
    own = targets.withColumn("slot", F.floor(micros(F.col("ts")) / HOUR).cast("long"))
    return own.join(made.dropDuplicates([*by, "target_id", "slot"]), [*by, "target_id", "slot"], "left").select(*keys, "prediction", "lower", "upper")


__all__ = ["Network", "features", "fit", "hourly", "predict", "samples", "windows"]
