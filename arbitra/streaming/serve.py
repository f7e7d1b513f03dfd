"""Scoring request streams: batches from the queue, each request's own outcome; and the queue's admission rule for requests that lie in a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.probability import hash_logits, softmax
from arbitra.operators.requests import answer, explode_requests
from arbitra.operators.sampling import ordinals
from arbitra.sources.shared import materialise
from arbitra.streaming.queue import FULL, LATE, check_options, prepare_session, queued  # noqa: F401

INVALID, FAILED = "invalid request", "scoring failed"


def admit(batch: DataFrame, capacity: int, timeout_ms: int, now: Column, order: tuple[str, ...] = ("arrived", "request_id")) -> DataFrame:
    """Adds status 503 and detail to what can't be served: beyond ``capacity`` waiting requests, or past its deadline when work starts. ``place`` is the order of arrival.

    A micro-batch is the queue, bounded at its source (maxFilesPerTrigger, maxOffsetsPerTrigger). Places come from ranges of the order, so
    even an unbounded batch never meets in one task.
    """
    late = F.unix_millis(now) - F.unix_millis("arrived") >= timeout_ms
    ranked = ordinals(batch, list(order), "place").withColumn("_late", late)
    full = F.col("place") >= capacity
    return ranked.withColumn("status", F.when(full | F.col("_late"), 503)).withColumn("detail", F.when(full, FULL).when(F.col("_late"), LATE)).drop("_late")


def batch_numbers(batch: DataFrame, most: int, order: tuple[str, ...] = ("arrived", "request_id")) -> DataFrame:
    """Adds batch_no: up to ``most`` requests each, in order of arrival."""
    return ordinals(batch, list(order), "_place").withColumn("batch_no", F.floor(F.col("_place") / most).cast("int")).drop("_place")


def hash_scorer(rows: DataFrame) -> DataFrame:
    """Stand-in scorer: reproducible logits from ids."""
    return rows.withColumn("logits", hash_logits(F.concat_ws(":", "request_id", "question_id"), F.size("candidates")))


def respond(batch: DataFrame, scorer: Callable[[DataFrame], DataFrame] = hash_scorer, temperature: float = 1.0, max_candidates: int = 16, keep: Sequence[str] = ()) -> DataFrame:
    """request_id, status, detail, answers (map from question to typed answer): one row for each request of ``batch(request_id, body)``.

    A request that can't be parsed gets 422 and harms no other; order is by id, not by arrival. The scorer sees the columns ``keep`` as well.
    """
    rows, refused = explode_requests(batch.select("request_id", *keep, "body"), max_candidates=max_candidates)
    scored = scorer(rows).withColumn("p", softmax(F.col("logits"), temperature))
    each = scored.select("request_id", "q_ord", "question_id", answer(F.col("kind"), F.col("candidates"), F.col("keys"), F.col("p")).alias("a"))
    gathered = F.sort_array(F.collect_list(F.struct("q_ord", "question_id", F.to_json("a").alias("a"))))
    good = each.groupBy("request_id").agg(gathered.alias("g")).select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail"), F.map_from_arrays(F.transform("g", lambda x: x["question_id"]), F.transform("g", lambda x: x["a"])).alias("answers"))
    return good.unionByName(refused.select("request_id", F.lit(422).alias("status"), F.lit(INVALID).alias("detail"), F.lit(None).cast("map<string,string>").alias("answers")))


def score_batches(numbered: DataFrame, batch: list[str], scorer: Callable[[DataFrame], DataFrame], temperature: float = 1.0) -> DataFrame:
    """respond() for requests whose ``batch`` columns say which are scored together. A scorer that fails costs the requests of its batch (500) and no other.

    All batches are one job, whose rows carry their batch for scorers that work batch by batch. Only if it fails are they scored one after the other, to find
    those at fault. What isn't the scorer's fault, but the engine's, is raised.
    """
    numbered = materialise(numbered)
    try:
        return materialise(respond(numbered, scorer, temperature, keep=batch))
    except Exception as error:  # noqa: BLE001
        if not scorer_fault(error):
            raise
    parts = []
    for key in sorted(tuple(r) for r in numbered.select(*batch).distinct().collect()):
        own = numbered.where(reduce(Column.__and__, (F.col(c) == v for c, v in zip(batch, key, strict=True))))
        try:
            parts.append(materialise(respond(own, scorer, temperature, keep=batch)))
        except Exception as error:  # noqa: BLE001
            if not scorer_fault(error):
                raise
            parts.append(own.select("request_id", F.lit(500).alias("status"), F.lit(FAILED).alias("detail"), F.lit(None).cast("map<string,string>").alias("answers")))
    return reduce(DataFrame.unionByName, parts)


def scorer_fault(error: Exception) -> bool:
    """Whether code or data of a task failed, not Spark: Python errors and errors that expressions raise."""
    said = str(error)
    return isinstance(error, (PythonException, ValueError)) or "USER_RAISED_EXCEPTION" in said or "api.python.PythonException" in said


def work_off(admitted: DataFrame, most: int, scorer: Callable[[DataFrame], DataFrame], temperature: float = 1.0) -> DataFrame:
    """score_batches() in batches of up to ``most`` requests, in order of arrival."""
    return score_batches(batch_numbers(admitted, most), ["batch_no"], scorer, temperature)


def serve(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, capacity: int = 1024, timeout_ms: float = 30_000, scorer=hash_scorer, temperature: float = 1.0, trigger: dict | None = None, most: int = 64, wait_ms: float = 0, lanes: int = 1):
    """A running query over a stream of (request_id, body, arrived): requests wait in their lane's queue, leave it in batches, are scored and handed to ``sink``.

    trigger: {"availableNow": True} takes what is there and stops, leaving in the queue what still waits for its batch (nothing if ``wait_ms`` is 0);
    {"processingTime": "100 milliseconds"} looks that often. A trigger in which nothing leaves doesn't reach the sink.
    """
    trigger = trigger or {"availableNow": True}
    prepare_session(requests.sparkSession, drains="availableNow" in trigger)

    def work(batch: DataFrame, number: int) -> None:
        left = materialise(batch)
        if left.isEmpty():
            return
        refused = left.where("status is not null").select("request_id", "status", "detail", F.lit(None).cast("map<string,string>").alias("answers"))
        sink(score_batches(left.where("status is null").select("lane", "batch", "request_id", "body"), ["lane", "batch"], scorer, temperature).unionByName(refused), number)

    left = queued(requests, capacity, most, wait_ms, timeout_ms, lanes)
    return left.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def score_stream(decisions: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Stateless scoring as a stream or a batch: the same plan either way."""
    return decisions.withColumn("logits", hash_logits(F.col("id"), F.size("candidates"))).withColumn("probabilities", softmax(F.col("logits"), temperature))
