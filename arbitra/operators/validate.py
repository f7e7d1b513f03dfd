"""Validation of decision rows: a reason for each, in the order in which the rules apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.probability import all_finite, is_close, total
from arbitra.functions.text import is_blank, strip
from arbitra.schema import KINDS


def invalid_reason(max_candidates: int = 16, with_target: bool = True) -> Column:
    """Why a row isn't a decision, or null."""
    c, t, kind = F.col("candidates"), F.col("target"), F.coalesce(F.col("kind"), F.lit("choice"))
    stripped = F.transform(c, strip)
    reason = (
        F.when(is_blank(F.col("state")), "blank_state")
        .when(is_blank(F.col("instructions")), "blank_instructions")
        .when(c.isNull() | ~F.size(c).between(2, max_candidates), "candidate_count")
        .when(F.exists(c, is_blank), "blank_candidate")
        .when(F.size(F.array_distinct(stripped)) != F.size(c), "repeated_candidate")
        .when(~kind.isin(*KINDS), "unknown_kind")
        .when((kind == "noul") & (F.size(c) != 2), "noul_candidates")
    )
    if with_target:
        reason = (
            reason.when(t.isNull() | (F.size(t) != F.size(c)), "target_length")
            .when(~all_finite(t) | F.exists(t, lambda x: x < 0), "target_value")
            .when(~is_close(total(t), 1.0), "target_sum")
        )
    return reason


def quarantine(rows: DataFrame, max_candidates: int = 16, with_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their reason)."""
    marked = rows.withColumn("invalid_reason", invalid_reason(max_candidates, with_target))
    return marked.where("invalid_reason is null").drop("invalid_reason"), marked.where("invalid_reason is not null")


def require_valid(rows: DataFrame, max_candidates: int = 16, with_target: bool = True) -> DataFrame:
    """The rows, failing the job at the first that isn't a decision."""
    reason = invalid_reason(max_candidates, with_target)
    checked = F.when(reason.isNull(), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("invalid decision: "), reason)).cast("string"))
    return rows.withColumn("state", checked)
