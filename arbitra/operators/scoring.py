"""Tokenizers and scorers as Arrow functions, and what surrounds them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.text import format_prompt
from arbitra.operators.batching import plan_rows
from arbitra.sources.shared import materialise, small_batches

#: Most tokens a pair may ever have.
LONGEST = 7999


def whitespace_tokenizer(prompt: str, candidate: str) -> list[int]:
    """A stand-in with the shape of the real thing: 1, a 3 for each word of the prompt, 2, a 4 for each of the candidate, 2."""
    return [1, *[3] * len(prompt.split()), 2, *[4] * len(candidate.split()), 2]


def nested(rows: list[list[np.ndarray] | None]) -> pa.Array:
    """Rows of arrays of ids as one Arrow array, without a Python number for each id; a missing row is null."""
    pairs = [p for row in rows if row is not None for p in row]
    ends = lambda sizes: np.cumsum([0, *sizes]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends(map(len, pairs))), pa.array(np.concatenate([np.empty(0, np.int32), *pairs])))
    return pa.ListArray.from_arrays(pa.array(ends(0 if row is None else len(row) for row in rows)), ids, mask=pa.array([row is None for row in rows], pa.bool_()))


def encode(rows: DataFrame, max_length: int = 1024, tokenizer: Callable[[str, str], list[int]] = whitespace_tokenizer) -> DataFrame:
    """Adds input_ids, attention_mask, labels and overlength; nothing is cut short. One Arrow stage for the tokenizer, whose batches hold so many bytes of text, not rows."""
    if not 1 <= max_length <= LONGEST:
        raise ValueError(f"max_length must be 1 to {LONGEST}")
    small_batches(rows.sparkSession)

    @F.arrow_udf("array<array<int>>")
    def tokenize(prompt: pa.Array, candidates: pa.Array) -> pa.Array:
        return nested([None if p is None or cs is None else [np.array(tokenizer(p, c), np.int32) for c in cs] for p, cs in zip(prompt.to_pylist(), candidates.to_pylist(), strict=True)])

    prompt = format_prompt(F.col("state"), F.col("instructions"), F.col("candidates"), F.col("kind"))
    out = rows.withColumn("input_ids", tokenize(prompt, F.col("candidates")))
    longest = F.array_max(F.transform("input_ids", F.size))
    mask = F.transform("input_ids", lambda ids: F.array_repeat(F.lit(1), F.size(ids)))
    return out.withColumn("attention_mask", mask).withColumn("labels", F.col("target")).withColumn("overlength", longest > max_length)


def word_count(text: Column) -> Column:
    """Words of the stand-in tokenizer, counted inside the JVM."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def native_lengths(rows: DataFrame) -> DataFrame:
    """Adds pair_lengths: the stand-in tokenizer's lengths without leaving the JVM."""
    prompt = format_prompt(F.col("state"), F.col("instructions"), F.col("candidates"), F.col("kind"))
    return rows.withColumn("_prompt", word_count(prompt)).withColumn("pair_lengths", F.transform("candidates", lambda c: F.col("_prompt") + word_count(c) + 3)).drop("_prompt")


def score(rows: DataFrame, load: Callable[[], Callable[[list[list[list[int]]]], list[list[float]]]]) -> DataFrame:
    """Adds logits by a model that each Python worker loads once; rows arrive grouped by length to save padding."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for ids in batches:
            found = model([[list(map(int, pair)) for pair in row] for row in ids])
            if len(found) != len(ids) or any(len(f) != len(i) for f, i in zip(found, ids, strict=True)):
                raise ValueError("the model returned another number of scores")
            yield pd.Series([list(map(float, f)) for f in found])

    laid = rows.withColumn("_longest", F.array_max(F.transform("input_ids", F.size))).sortWithinPartitions("_longest").drop("_longest")
    return laid.withColumn("logits", run("input_ids"))


DENSE = pa.schema([("_id", pa.int64()), ("_candidate", pa.int32()), ("_logit", pa.float64()), ("_seconds", pa.float64())])


def dense_batch(ids: list[list[int]], width: int, padded: int, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ids and masks of ``padded`` rows of ``width``: the pairs filled up with ``pad_id``, then the last pair again, as a row without any mask would break attention."""
    filled = np.full((padded, width), pad_id, np.int64)
    mask = np.zeros((padded, width), np.int64)
    for row, own in enumerate([*ids, *[ids[-1]] * (padded - len(ids))]):
        filled[row, : len(own)] = own
        mask[row, : len(own)] = 1
    return filled, mask


def score_dense(
    rows: DataFrame, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], pairs: int, tokens: int | None, max_length: int = LONGEST, multiple: int = 1, fixed_shapes: bool = False, pad_id: int = 0, clock: Callable[[], float] = time.perf_counter
) -> DataFrame:
    """Adds logits and seconds by a model of dense batches: (ids, mask) to one score a row.

    All pairs of all rows are planned together by length, under a limit of pairs and of padded tokens; each batch is one task's call of the model, which a Python worker
    loads once. Widths round up to ``multiple``, but not beyond ``max_length``; a longer pair isn't cut, its batch is as wide as it is, and a pair wider than ``tokens`` raises that limit to its width.
    A pair's seconds are its share of its batch's; a row has its pairs' sum. Scores go back to their rows whatever order batches end in. A row without pairs gets none.

    Pairs are planned by their lengths alone; ids travel to their rows' places and then to their batches.
    """
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.select("_id", F.posexplode(F.transform("input_ids", F.size)).alias("_candidate", "_length"))
    longest = sizes.agg(F.max("_length")).first()[0] or 1
    if longest > max_length:
        max_length = longest
    if tokens is not None:
        tokens = max(tokens, min(max_length, -(-longest // multiple) * multiple))
    planned = plan_rows(sizes, [], ["_id", "_candidate"], pairs, tokens, max_length, multiple, True, fixed_shapes, "_length")
    places = planned.groupBy(F.col("_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_candidate", "batch", "place", "width", "padded"))).alias("_places"))
    met = rows.select("_id", "input_ids").join(places, F.col("_id") == F.col("_of"))
    flat = met.select("_id", F.explode(F.arrays_zip("_places", F.col("input_ids").alias("_ids"))).alias("_")).select("_id", "_._places.*", "_._ids")
    made: list = []

    def run(table: pa.Table) -> pa.Table:
        if not made:
            made.append(load())
        table = table.sort_by("place")
        held = table.column("_ids").combine_chunks()
        own, ends = held.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *held.value_lengths().to_numpy(zero_copy_only=False)])
        ids, mask = dense_batch([own[a:b] for a, b in zip(ends, ends[1:], strict=False)], table.column("width")[0].as_py(), table.column("padded")[0].as_py(), pad_id)
        start = clock()
        scores = np.asarray(made[0](ids, mask), np.float64).reshape(-1)
        spent = clock() - start
        if len(scores) != len(ids):
            raise ValueError("the model returned another number of scores")
        n = table.num_rows
        return pa.Table.from_arrays([table.column("_id"), table.column("_candidate").cast(pa.int32()), pa.array(scores[:n]), pa.array(np.full(n, spent / n))], schema=DENSE)

    scored = flat.groupBy("batch").applyInArrow(run, "_id long, _candidate int, _logit double, _seconds double")
    gathered = F.sort_array(F.collect_list(F.struct("_candidate", "_logit")))
    found = scored.groupBy(F.col("_id").alias("_own")).agg(F.transform(gathered, lambda p: p["_logit"]).alias("logits"), F.sum("_seconds").alias("seconds"))
    return rows.join(found, F.col("_id") == F.col("_own"), "left").drop("_id", "_own")


def bad_pair(max_length: int, vocabulary: int) -> Column:
    """Why an encoded row can't be collated, or null: counts, lengths, ids and masks."""
    ids, mask = F.col("input_ids"), F.col("attention_mask")
    return (
        F.when((F.size(ids) != F.size(mask)) | (F.size(ids) != F.size("labels")), "count")
        .when(F.exists(ids, lambda p: ~F.size(p).between(1, max_length)), "length")
        .when(F.exists(ids, lambda p: F.exists(p, lambda t: (t < 0) | (t >= vocabulary))), "token")
        .when(F.exists(F.arrays_zip(ids, mask), lambda z: F.size(z["input_ids"]) != F.size(z["attention_mask"])), "mask_length")
        .when(F.exists(mask, lambda m: F.exists(m, lambda b: ~b.isin(0, 1)) | ~F.exists(m, lambda b: b == 1)), "mask")
    )
