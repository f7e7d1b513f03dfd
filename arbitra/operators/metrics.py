"""Quality of predicted distributions: accuracy, log loss, Brier score, calibration error, ordinal error, and comparisons.

Everything is algebraic: one row-level projection, then partial and final aggregates; calibration error adds one
level, by confidence bin. No group is ever gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions.probability import argmax, expectation, total
from arbitra.operators.sampling import ordinals

BINS = 15
FLOOR = 1e-300


def row_scores(rows: DataFrame, probabilities: str = "probabilities", target: str = "target", kind: str = "kind") -> DataFrame:
    """Adds correct, log_loss, brier, top (confidence), gold (target mass there), bin and ordinal_error (score rows only)."""
    p, y = F.col(probabilities), F.col(target)
    top = F.array_max(p)
    gold = F.get(y, argmax(p))
    return rows.select(
        "*",
        (gold > 0).cast("double").alias("correct"),
        (-total(F.zip_with(y, p, lambda a, b: a * F.log(F.greatest(b, F.lit(FLOOR)))))).alias("log_loss"),
        total(F.zip_with(p, y, lambda a, b: (a - b) * (a - b))).alias("brier"),
        top.alias("top"),
        gold.alias("gold"),
        F.least(F.lit(BINS - 1), F.floor(top * BINS).cast("int")).alias("bin"),
        F.when(F.col(kind) == "score", F.abs(expectation(p) - expectation(y))).alias("ordinal_error"),
    )


def _metrics(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Second level: sums by key and bin to metrics by key."""
    n = F.sum("n")
    return binned.groupBy(*keys).agg(
        n.alias("count"),
        (F.sum("correct") / n).alias("accuracy"),
        (F.sum("log_loss") / n).alias("log_loss"),
        (F.sum("brier") / n).alias("brier_score"),
        (F.sum(F.abs(F.col("top") - F.col("gold"))) / n).alias("ece_15"),
        (F.sum("ordinal_error") / F.nullif(F.sum("ordinal_count"), F.lit(0))).alias("ordinal_mae"),
        F.sum("ordinal_count").alias("ordinal_count"),
    )


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c).alias(c) for c in ("correct", "log_loss", "brier", "top", "gold")),
        F.sum("ordinal_error").alias("ordinal_error"),
        F.count("ordinal_error").alias("ordinal_count"),
    ]


def metrics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of metrics for each key (or for all). ``rows`` has probabilities, target and kind."""
    keys = keys or []
    return _metrics(row_scores(rows).groupBy(*keys, "bin").agg(*_sums()), keys)


def report(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Metrics over several groupings at once: ``report_key`` names the grouping, its columns are null where they don't count.

    Rows are scored and summed once, by all columns and the bin; the groupings only expand those sums.
    """
    columns = sorted({c for s in sets for c in s})
    sums = row_scores(rows).groupBy(*columns, "bin").agg(*_sums())
    parts = F.array(*(F.struct(F.lit("/".join(s) or "overall").alias("report_key"), *((F.col(c) if c in s else F.lit(None).cast("string")).alias(c) for c in columns)) for s in sets))
    wide = sums.withColumn("_set", F.explode(parts)).drop(*columns).select("*", "_set.*").drop("_set")
    again = wide.groupBy("report_key", *columns, "bin").agg(*(F.sum(c).alias(c) for c in ("n", "correct", "log_loss", "brier", "top", "gold", "ordinal_error", "ordinal_count")))
    return _metrics(again, ["report_key", *columns])


def probability_delta(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Drift between two predictions of the same rows: one row of max_abs, mean_abs, mean_total_variation, argmax_changes, argmax_change_rate."""
    a, b = F.col(before), F.col(after)
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    each = pairs.select(F.array_max(d).alias("most"), total(d).alias("sum"), F.size(d).alias("n"), (argmax(a) != argmax(b)).cast("int").alias("changed"))
    return each.agg(
        F.max("most").alias("max_abs"),
        (F.sum("sum") / F.sum("n")).alias("mean_abs"),
        F.avg(F.col("sum") / 2).alias("mean_total_variation"),
        F.sum("changed").cast("long").alias("argmax_changes"),
        F.avg("changed").alias("argmax_change_rate"),
    )


def pair_strictly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join by ``key``: a key without a partner, or with two, fails the job."""
    left, right = left.withColumn("_left", F.lit(1)), right.withColumn("_right", F.lit(1))
    both = left.join(right, key, "full_outer")
    repeats = F.count(F.lit(1)).over(Window.partitionBy(key))
    ok = F.col("_left").isNotNull() & F.col("_right").isNotNull() & (repeats == 1)
    return both.withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("rows and predictions aren't paired one to one")).cast("boolean"))).where("_ok").drop("_left", "_right", "_ok")


def paired_correctness(rows: DataFrame, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """both, only_a, only_b, neither."""
    x, y = F.col(a), F.col(b)
    return rows.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def auroc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve with tied scores at half weight.

    Scores are aggregated to one row for each distinct value first, so the ranking runs over those. Range-partitioned values are summed up where
    they lie; the driver adds one row of totals a partition. Null without both labels.
    """
    values = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")).withColumnRenamed(score, "value")

    def running(batches):
        """Sums over the sorted values of one partition: positives, negatives, and pairs that positives win, ties at half."""
        pos = neg = wins = 0
        for batch in batches:
            p, n = batch.column(0).to_numpy().astype(object), batch.column(1).to_numpy().astype(object)
            below = neg + np.cumsum(n) - n
            wins += int((p * (2 * below + n)).sum())
            pos, neg = pos + int(p.sum()), neg + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pos], pa.int64()), pa.array([neg], pa.int64()), pa.array([str(wins)])], names=["part", "pos", "neg", "wins"])

    laid = values.repartitionByRange("value").sortWithinPartitions("value").select("pos", "neg")
    blocks = sorted(laid.mapInArrow(running, "part int, pos long, neg long, wins string").collect())
    pos = neg = wins = 0
    for block in blocks:
        wins += int(block.wins) + 2 * neg * block.pos
        pos, neg = pos + block.pos, neg + block.neg
    return rows.sparkSession.createDataFrame([(wins / (2 * pos * neg) if pos and neg else None,)], "auroc double")


def confusion(rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(label) == 1
    tp, fp, fn, tn = (F.count_if(c) for c in (p & y, p & ~y, ~p & y, ~p & ~y))
    return rows.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"),
    )


def ordinal_report(rows: DataFrame) -> DataFrame:
    """For probabilities and target: within_one, numeric_mae (of the expected index against the gold index), soft_accuracy, total_variation, hard_ece."""
    p, y = F.col("probabilities"), F.col("target")
    gold, top = argmax(y), argmax(p)
    each = rows.select(
        (F.abs(top - gold) <= 1).cast("double").alias("within"), F.abs(expectation(p) - gold).alias("mae"), F.get(y, top).alias("soft"),
        (total(F.zip_with(p, y, lambda a, b: F.abs(a - b))) / 2).alias("tv"), F.array_max(p).alias("top"), (top == gold).cast("double").alias("hit"),
    ).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("top") * BINS).cast("int")))
    binned = each.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("within", "mae", "soft", "tv", "top", "hit")))
    n = F.sum("n")
    return binned.agg(
        (F.sum("within") / n).alias("within_one"), (F.sum("mae") / n).alias("numeric_mae"), (F.sum("soft") / n).alias("soft_accuracy"),
        (F.sum("tv") / n).alias("total_variation"), (F.sum(F.abs(F.col("top") - F.col("hit"))) / n).alias("hard_ece"),
    )


def latency_summary(rows: DataFrame, seconds: str, keys: list[str] | None = None) -> DataFrame:
    """median (interpolated) and p95 (nearest rank) in milliseconds, and rows for each second of work.

    Times are ranked once in a global order, so no group of any size meets in one task; the three places that count are picked from the ranks.
    """
    keys = keys or []
    times = rows.select(*keys, F.col(seconds).cast("double").alias("_s"))
    totals = times.groupBy(*keys).agg(F.count("_s").alias("count"), F.sum("_s").alias("_sum"))
    ranked = ordinals(times.where("_s is not null"), [*keys, "_s"], "_at")
    first = ranked.groupBy(*keys).agg(F.min("_at").alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    plan = totals.join(first.select(*(F.col(k).alias(f"_{k}") for k in keys), "_first"), same).drop(*(f"_{k}" for k in keys)) if keys else totals.crossJoin(first)
    half = (F.col("count") - 1) / 2
    wanted = {"low": F.floor(half), "high": F.ceil(half), "p95": F.ceil(F.col("count") * 0.95) - 1}
    places = plan.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(F.array(*((F.col("_first") + w).cast("long") for w in wanted.values()))).alias("_at")).select("_at").distinct()
    picked = ranked.join(places, "_at").select(F.col("_at").alias("_rank"), "_s")
    out = plan
    for name, w in wanted.items():
        out = out.join(picked.select(F.col("_rank").alias(f"_r_{name}"), F.col("_s").alias(f"_{name}")), (F.col("_first") + w).cast("long") == F.col(f"_r_{name}"), "left")
    return out.select(*keys, "count", ((F.col("_low") + (F.col("_high") - F.col("_low")) * (half - F.floor(half))) * 1000).alias("median_ms"), (F.col("_p95") * 1000).alias("p95_ms"), (F.col("count") / F.col("_sum")).alias("per_second"))


def require_finite(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows, failing the job at the first whose metric (such as a loss or a gradient's norm) isn't a finite number; null passes."""
    for name in columns:
        value = F.col(name)
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        rows = rows.withColumn(name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{name} isn't finite")).cast("double")).otherwise(value))
    return rows
