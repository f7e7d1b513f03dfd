"""Calibrating, evaluating, comparing and benchmarking scored decision files."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.probability import hash_logits, softmax
from arbitra.operators import calibration, metrics, sampling, validate
from arbitra.schema import ENCODED
from arbitra.sources import files
from arbitra.sources.shared import Store, materialise

SETS = [[], ["source"], ["kind"], ["source", "task"]]


def file_sha256(path: str | Path) -> str:
    with Path(path).open("rb") as stream:
        return hashlib.file_digest(stream, "sha256").hexdigest()


def hash_scored(rows: DataFrame) -> DataFrame:
    """Stand-in scorer for files without a model: logits from ids."""
    return rows.withColumn("logits", hash_logits(F.col("id"), F.size("candidates")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A prepared split's rows, validated; an empty file is an error."""
    rows = validate.require_valid(files.read_rows(spark, path, ENCODED), 64)
    if rows.isEmpty():
        raise ValueError(f"{path} is empty")
    return rows


def calibrate(spark: SparkSession, model_dir: str, path: str, scorer: Callable[[DataFrame], DataFrame] = hash_scored) -> float:
    """Fits the temperature on calibration.jsonl, never on another split, and records it beside the model."""
    if Path(path).name != "calibration.jsonl":
        raise ValueError("only calibration.jsonl may be used to calibrate")
    rows = scorer(load(spark, path)).select("logits", "target").persist()
    temperature = calibration.fit_temperature(rows)
    losses = {r.temperature: r.log_loss for r in metrics.require_finite(calibration.log_losses(rows, [1.0, temperature]), "log_loss").collect()}
    config_path = Path(model_dir) / "model_config.json"
    config = files.load_config(config_path) if config_path.exists() else {}
    files.write_json(config_path, config | {"temperature": temperature})
    files.write_json(Path(model_dir) / "calibration.json", {"temperature": temperature, "log_loss_before": losses[1.0], "log_loss_after": losses[temperature], "data_sha256": file_sha256(path)})
    rows.unpersist()
    return temperature


def report_document(table: DataFrame) -> dict:
    """A metrics table as nested JSON: key, then metric."""
    out = {}
    for r in table.collect():
        columns = [] if r["report_key"] == "overall" else r["report_key"].split("/")
        name = "/".join([columns[-1], *(r[c] for c in columns)]) if columns else "overall"
        out[name] = {k: r[k] for k in ("count", "accuracy", "log_loss", "brier_score", "ece_15", "ordinal_mae", "ordinal_count")}
    return out


def evaluate(spark: SparkSession, path: str, temperature: float, output: str, scorer: Callable[[DataFrame], DataFrame] = hash_scored) -> dict:
    """Metrics overall and by source, kind and task, before and after calibration, into a new file. Rows are scored once."""
    if Path(output).exists():
        raise FileExistsError(output)
    rows = scorer(load(spark, path)).select("source", "kind", "task", "target", "logits").persist()
    stages = {name: report_document(metrics.require_finite(metrics.report(rows.withColumn("probabilities", softmax(F.col("logits"), t)), SETS), "log_loss", "brier_score")) for name, t in (("uncalibrated", 1.0), ("calibrated", temperature))}
    rows.unpersist()
    result = {"temperature": temperature, "data_sha256": file_sha256(path), "stages": stages}
    files.write_json(output, result)
    return result


def predictions(sample: DataFrame, scorer: Callable[[DataFrame], DataFrame], clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """``sample`` with probabilities and seconds; written to the shared folder, so it is scored once.

    Scorers that time their rows (scoring.score_dense) give seconds themselves; for others it is the mean time that a row took.
    """
    start = clock()
    rows = materialise(scorer(sample).withColumn("probabilities", softmax(F.col("logits"))))
    spent = clock() - start
    return rows if "seconds" in rows.columns else rows.withColumn("seconds", F.lit(spent / max(rows.count(), 1)))


def latencies(spark: SparkSession, log: str, groups: list[str] | None = None) -> DataFrame:
    """Count, median, 95th percentile and throughput of a written log of predictions."""
    rows = spark.read.schema("index long, id string, probabilities array<double>, seconds double").json(log)
    return metrics.latency_summary(rows.withColumn("all", F.lit("all")), "seconds", groups or ["all"])


def altered(sample: DataFrame) -> dict:
    """How many rows a model would have to cut, overall and by source."""
    by_source = {r.source: r.n for r in sample.groupBy("source").agg(F.count_if("clipped").alias("n")).collect()}
    return {"overall": sum(by_source.values()), "by_source": by_source}


def compare(spark: SparkSession, path: str, models: dict[str, Callable[[DataFrame], DataFrame]], output: str, per_source: int = 0, seed: int = 42, clipped: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Two or more models on the same stratified sample: logs of predictions, metrics of all and of rows that none would cut, paired correctness, drift.

    Logs hold index (the row's place in the sample's order), id, probabilities and seconds.
    """
    sample = sampling.ordinals(sampling.stratified_sample(load(spark, path), per_source, seed), ["shuffle_key", "id"], "index")
    sample = materialise(clipped(sample) if clipped else sample.withColumn("clipped", F.lit(False)))
    result: dict = {"rows": sample.count(), "altered": altered(sample), "models": {}}
    tables = {}
    for name, scorer in models.items():
        rows = predictions(sample, scorer)
        tables[name] = rows
        rows.select("index", "id", "probabilities", "seconds").write.mode("errorifexists").json(f"{output}/predictions-{name}")
        kept = rows.where("NOT clipped")
        subset = metrics.metrics(kept).first().asDict() if not kept.isEmpty() else None
        result["models"][name] = report_document(metrics.report(rows, [[], ["source"], ["kind"]])) | {"shared_untruncated": subset}
    (first, a), *others = tables.items()
    for name, b in others:
        scored = [metrics.row_scores(t).select("id", (F.col("correct") > 0).alias(f"correct_{k}"), F.col("probabilities").alias(f"p_{k}")) for t, k in ((a, "a"), (b, "b"))]
        pairs = materialise(metrics.pair_strictly(*scored, "id"))
        result[f"{first}:{name}"] = {"paired": metrics.paired_correctness(pairs).first().asDict(), "delta": metrics.probability_delta(pairs, "p_a", "p_b").first().asDict()}
    Store(spark).write_json(f"{output}/report.json", result)
    return result


def workload(spark: SparkSession, path: str, decisions_per_request: int = 1, limit: int = 0) -> DataFrame:
    """request, decisions: the first ``limit`` rows (0: all) of a labelled file in their order by id, dealt into requests of so many decisions each."""
    if decisions_per_request < 1 or limit < 0:
        raise ValueError("counts must be positive")
    rows = sampling.ordinals(load(spark, path).select("id", "state", "instructions", "candidates", "kind"), ["id"])
    rows = rows.where(F.col("ordinal") < limit) if limit else rows
    decision = F.struct("ordinal", "id", "state", "instructions", "candidates", "kind")
    return rows.groupBy(sampling.chunk(F.col("ordinal"), decisions_per_request).alias("request")).agg(F.sort_array(F.collect_list(decision)).alias("decisions"))


def benchmark(run: Callable[[], None], requests: int, decisions: int, warmups: int = 1, repeats: int = 3, clock: Callable[[], float] = time.perf_counter) -> dict:
    """Times ``run`` after warm-ups; latency and throughput of the measured passes."""
    if requests < 1 or decisions < 1 or warmups < 0 or repeats < 1:
        raise ValueError("counts must be positive")
    spent = []
    for _ in range(warmups + repeats):
        start = clock()
        run()
        spent.append(clock() - start)
    measured = sorted(spent[warmups:])
    total = sum(measured)
    if total <= 0:
        raise ValueError("the clock didn't advance")
    middle = len(measured) // 2
    median = measured[middle] if len(measured) % 2 else (measured[middle - 1] + measured[middle]) / 2
    return {"first_ms": spent[0] * 1000, "median_ms": median * 1000, "p95_ms": measured[math.ceil(len(measured) * 0.95) - 1] * 1000, "requests_per_second": requests * repeats / total, "decisions_per_second": decisions * repeats / total}
