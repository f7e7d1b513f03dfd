"""Expressions over distributions held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_close(a: Column, b, relative: float = 1e-9, absolute: float = 1e-6) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def one_hot(index: Column, size: Column) -> Column:
    """1.0 at ``index``; null outside the range."""
    inside = (index >= 0) & (index < size)
    return F.when(inside, F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: (i == index).cast("double")))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Shifted by the maximum before dividing by the temperature. Null under two logits, for non-finite ones, and unless 0 < temperature < inf."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    valid = (F.size(logits) >= 2) & all_finite(logits) & ~F.isnan(t) & (t > 0) & (t < float("inf"))
    peak = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - peak) / t))
    return F.when(valid, F.transform(e, lambda x: x / total(e)))


def renormalize(values: Column) -> Column:
    whole = total(values)
    return F.transform(values, lambda x: x / whole)


def argmax(values: Column) -> Column:
    """Position from 0 of the largest, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def expectation(values: Column) -> Column:
    return total(F.transform(values, lambda x, i: x * i))


def confidence(values: Column) -> Column:
    n = F.size(values)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n * F.array_max(values) - 1) / (n - 1)))


def soft_target(scores: Column) -> Column:
    """Scores over their sum; null where they are fewer than two, negative, not finite, all equal or sum to nothing."""
    valid = (F.size(scores) >= 2) & all_finite(scores) & F.forall(scores, lambda x: x >= 0) & (F.size(F.array_distinct(scores)) > 1) & (total(scores) > 0)
    return F.when(valid, renormalize(scores))


def pad(values: Column, width: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0.0), width - F.size(values)))


def pad_mask(values: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), width - F.size(values)))


def hash_logits(key: Column, size: Column) -> Column:
    """Reproducible stand-in scores in [-4, 4): the first 8 hexadecimal digits of a digest, for each candidate."""
    digits = lambda i: F.substring(F.sha2(F.concat(F.lit("logit:"), key, F.lit(":"), i.cast("string")), 256), 1, 8)
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.conv(digits(i), 16, 10).cast("long") / 4294967296.0 * 8 - 4)


def round_up(length: Column, multiple: int, most: int) -> Column:
    return F.least(F.lit(most), (F.ceil(length / multiple) * multiple).cast("int"))


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
