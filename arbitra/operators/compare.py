"""Whether another model's token budgets would have cut a row, and the grid of configurations to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.probability import total

#: Fixed values of the other model's budgets: tokens of an option, least allowance, least option share, least head, extra tokens.
OPTION_CAP, ALLOWANCE, OPTION_LEAST, HEAD_LEAST, EXTRA = 48, 16, 4, 8, 4


def clips(head: Column, options: Column, state: Column, masked: Column, head_max: int = 192, max_length: int = 512) -> Column:
    """True where a head, option or state of so many tokens would lose some, or a text holds the mask token."""
    budget = F.lit(head_max)
    capped = F.transform(options, lambda n: 1 + F.least(F.lit(OPTION_CAP), n))
    share = F.greatest(F.lit(OPTION_LEAST), F.floor((budget - ALLOWANCE) / F.size(options)).cast("int"))
    tight = budget - total(F.transform(capped, lambda n: n.cast("double"))) < ALLOWANCE
    kept = F.when(tight, F.transform(capped, lambda n: F.least(n, share))).otherwise(capped)
    used = total(F.transform(kept, lambda n: n.cast("double")))
    kept_head = F.least(head.cast("double"), F.greatest(F.lit(float(HEAD_LEAST)), budget - used))
    room = F.greatest(F.lit(0.0), max_length - kept_head - used - EXTRA)
    lost = F.exists(F.zip_with(options, kept, lambda n, k: n + 1 > k), lambda x: x)
    return (head > kept_head) | lost | (state > room) | masked


def sweep_grid(spark: SparkSession, batch_sizes=(8, 16, 32), request_batches=(1, 4), max_batch_tokens: int = 8192, compiled: bool = False, flash: bool = False) -> DataFrame:
    """A fixed baseline, then the product of sizes, types and request batches; costly backends only at the largest size."""
    if not batch_sizes or not request_batches or min(*batch_sizes, *request_batches) < 1 or max_batch_tokens < 1:
        raise ValueError("sizes must be positive")

    def axis(values):
        return F.explode(F.array(*map(F.lit, dict.fromkeys(values))))

    # one row that each axis multiplies: a product of a few settings
    grid = spark.range(1, numPartitions=1).select(axis(batch_sizes).alias("pair_batch_size"))
    for name, values in (("weight_dtype", ("float32", "bfloat16")), ("requests_per_batch", request_batches), ("attn_implementation", ("sdpa", "flash_attention_2")), ("compile_model", (False, True))):
        grid = grid.select("*", axis(values).alias(name))
    flashy = F.col("attn_implementation") == "flash_attention_2"
    kept = grid.where((~F.col("compile_model") | F.lit(compiled)) & (~flashy | (F.lit(flash) & (F.col("weight_dtype") == "bfloat16"))) & (~(F.col("compile_model") | flashy) | (F.col("pair_batch_size") == max(batch_sizes))))
    name = F.concat(F.lit("pairs"), F.col("pair_batch_size"), F.lit("-"), "weight_dtype", F.lit("-"), "attn_implementation", F.lit("-requests"), F.col("requests_per_batch"), F.when(F.col("compile_model"), "-compiled").otherwise(""))
    rows = kept.select(name.alias("name"), "pair_batch_size", F.when(F.lit(True), F.lit(max_batch_tokens)).alias("max_batch_tokens"), F.lit(True).alias("group_by_length"), "weight_dtype", "attn_implementation", "compile_model", "requests_per_batch")
    base = spark.createDataFrame([("baseline", 8, None, False, "float32", "sdpa", False, 1)], "name string, pair_batch_size int, max_batch_tokens int, group_by_length boolean, weight_dtype string, attn_implementation string, compile_model boolean, requests_per_batch int")
    return base.unionByName(rows)


def planned_sweep(grid: DataFrame, plan) -> DataFrame:
    """``grid`` with the batches and padded tokens of a workload under each setting; ``plan(pair_batch_size, max_batch_tokens)`` plans it, once for equal settings."""
    settings = sorted({(r.pair_batch_size, r.max_batch_tokens) for r in grid.collect()}, key=lambda x: (x[0], x[1] or 0))
    found = None
    for n, tokens in settings:
        own = plan(n, tokens).where("place = 0").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("padded") * F.col("width")).cast("long").alias("padded_tokens"))
        own = own.select(F.lit(n).alias("_n"), F.lit(tokens).cast("int").alias("_tokens"), "batches", "padded_tokens")
        found = own if found is None else found.unionByName(own)
    return grid.join(found, (F.col("pair_batch_size") == F.col("_n")) & F.col("max_batch_tokens").eqNullSafe(F.col("_tokens"))).drop("_n", "_tokens")
