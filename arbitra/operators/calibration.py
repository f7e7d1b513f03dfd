"""Temperature calibration: log loss at many temperatures at once, and the temperature that minimises it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.functions.probability import all_finite, is_close, total

LOW, HIGH = 0.05, 20.0
POINTS, ROUNDS = 33, 7


def log_losses(rows: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, log_loss (mean over rows of logsumexp(l/T) - sum(y l/T), without a floor), count.

    One pass: a row's losses at all temperatures are one array, whose elements meet in partial sums by place; the plan is as
    small for many temperatures as for one.
    """
    l, y = F.col("logits"), F.col("target")
    temps = F.array(*map(F.lit, temperatures))
    shifted = F.transform(l, lambda x: x - F.array_max(l))

    def loss(t):
        spread = F.log(total(F.transform("_l", lambda x: F.exp(x / t))))
        return spread - total(F.zip_with("_y", "_l", lambda a, b: a * b / t))

    each = rows.select(shifted.alias("_l"), y.alias("_y")).select(F.posexplode(F.transform(temps, loss)).alias("_i", "_loss"))
    sums = each.groupBy("_i").agg(F.avg("_loss").alias("log_loss"), F.count("_loss").alias("count"))
    return sums.select(F.get(temps, F.col("_i")).alias("temperature"), "log_loss", "count")


def check_calibration_rows(rows: DataFrame) -> DataFrame:
    """The rows, failing the job at one without finite logits and a normalised target of the same length."""
    l, y = F.col("logits"), F.col("target")
    ok = (F.size(l) >= 2) & (F.size(l) == F.size(y)) & all_finite(l) & all_finite(y) & F.forall(y, lambda v: v >= 0) & is_close(total(y), 1.0)
    return rows.withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("calibration needs finite logits and normalised targets")).cast("boolean"))).where("_ok").drop("_ok")


def fit_temperature(rows: DataFrame) -> float:
    """The temperature of least log loss in [LOW, HIGH]; 1, the bounds and the fitted point compete, the first on ties.

    A grid on the logarithm shrinks around its best point; each round is one distributed pass over cached logits. The driver sees POINTS numbers a round.
    """
    data = check_calibration_rows(rows.select("logits", "target")).persist()
    try:
        low, high = math.log(LOW), math.log(HIGH)
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
            found = sorted(log_losses(data, [math.exp(g) for g in grid]).collect(), key=lambda r: r.temperature)
            if not found:
                raise ValueError("the calibration partition is empty")
            best = min(range(POINTS), key=lambda i: found[i].log_loss)
            low, high = grid[max(0, best - 1)], grid[min(POINTS - 1, best + 1)]
        choices = [1.0, LOW, HIGH, math.exp((low + high) / 2)]
        losses = {r.temperature: r.log_loss for r in log_losses(data, choices).collect()}
        return min(choices, key=losses.__getitem__)
    finally:
        data.unpersist()
