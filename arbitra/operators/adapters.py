"""One projection for each kind of raw source to decision rows.

Every adapter is a ``select`` over its source's own columns: a missing column fails analysis, an unusable value becomes
``skip_reason``, the first in the order of checks. Nothing is dropped here, so reasons can be counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra.functions.probability import all_finite, one_hot, total
from arbitra.functions.text import excluded_task, group_id, is_blank, native_row_id, row_id, strip
from arbitra.schema import NLI, RATINGS, SENTIMENT

#: What each kind of source asks, its answers where they aren't in the rows, and how instruct inputs begin.
RELATION = "What is the relationship between the premise and hypothesis?"
ENTAILS, ENTAILS_ANSWERS = "Does the premise entail the hypothesis?", ["entailment", "not_entailment"]
UPDATES, UPDATES_ANSWERS = "Does the update make the hypothesis more or less likely?", ["strengthener", "weakener"]
CONTINUES = "Choose the most plausible continuation of the passage."
READS, READS_ANSWERS = "Answer the question using the passage.", ["No", "Yes"]
CHOOSES = "Choose the best answer to the question."
INSTRUCT_PREFIX = "With no explanation, label the following with either "
INSTRUCT = {
    "yelp_review_full/yelp_review_full": (RATINGS, "score", "How many stars did the reviewer give?"),
    "tweet_eval/sentiment": (SENTIMENT, "score", "Rate the sentiment of the text."),
}

FIELDS = ("state", "instructions", "candidates", "target", "kind", "source", "task", "original_split", "group_id")


class Checks:
    """Ordered reasons to skip a row; the first that holds counts."""

    def __init__(self):
        self.items: list[tuple[Column, str]] = []

    def text(self, name: str) -> Column:
        self.items.append((is_blank(F.col(name).cast("string")), f"blank_or_invalid_{name}"))
        return strip(F.col(name).cast("string"))

    def skip(self, condition: Column, reason: str) -> None:
        self.items.append((F.coalesce(condition, F.lit(True)), reason))

    def reason(self) -> Column:
        out = F.lit(None).cast("string")
        for condition, reason in reversed(self.items):
            out = F.when(condition, reason).otherwise(out)
        return out


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def label_target(raw: DataFrame, name: str, values: list[str], checks: Checks) -> Column:
    """One-hot of a label given as a position or as one of ``values``; booleans are neither."""
    kind = raw.schema[name].dataType
    if isinstance(kind, T.StringType):
        index = F.array_position(strings(values), F.col(name)) - 1
    elif isinstance(kind, T.IntegralType):
        index = F.col(name)
    else:
        index = F.lit(None).cast("int")
    index = F.coalesce(index, F.lit(-1)).cast("int")
    checks.skip(~index.between(0, len(values) - 1), "invalid_label")
    return one_hot(index, F.lit(len(values)))


def _nli(raw: DataFrame, config: str, checks: Checks, label: str = "label", values: list[str] = NLI, question: str = RELATION, family_check: bool = False) -> dict[str, Column]:
    premise, hypothesis = checks.text("premise"), checks.text("hypothesis")
    out = {}
    if family_check:
        task = checks.text("task")
        checks.skip(excluded_task(task), "overlapping_task_family")
        out["task"] = task
    target = label_target(raw, label, values, checks)
    state = F.concat(F.lit("Premise: "), premise, F.lit("\nHypothesis: "), hypothesis)
    return out | {"state": state, "group": premise, "instructions": F.lit(question), "candidates": strings(values), "target": target}


def _zero_shot(raw, config, checks):
    return _nli(raw, config, checks, label="labels", family_check=True)


def _doc_nli(raw, config, checks):
    return _nli(raw, config, checks, values=ENTAILS_ANSWERS, question=ENTAILS)


def _defeasible(raw, config, checks):
    hypothesis, update = checks.text("Hypothesis"), checks.text("Update")
    premise = F.lit("") if config == "social" else checks.text("Premise")
    lead = F.lit("") if config == "social" else F.concat(F.lit("Premise: "), premise, F.lit("\n"))
    return {
        "state": F.concat(lead, F.lit("Hypothesis: "), hypothesis, F.lit("\nUpdate: "), update),
        "group": F.concat(F.lit("Premise: "), premise, F.lit("\nHypothesis: "), hypothesis),
        "instructions": F.lit(UPDATES),
        "candidates": strings(UPDATES_ANSWERS),
        "target": label_target(raw, "UpdateType", UPDATES_ANSWERS, checks),
    }


def _hellaswag(raw, config, checks):
    state = checks.text("ctx")
    label, endings = F.col("label").cast("string"), F.col("endings")
    checks.skip(~label.isin("0", "1", "2", "3") | (F.size(endings) != 4) if isinstance(raw.schema["label"].dataType, T.StringType) else F.lit(True), "unlabeled_or_invalid_hellaswag")
    group = F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), state) if "source_id" in raw.columns else state
    return {"state": state, "group": group, "instructions": F.lit(CONTINUES), "candidates": endings, "target": one_hot(F.expr("try_cast(label AS int)"), F.lit(4))}


def _boolq(raw, config, checks):
    passage, question = checks.text("passage"), checks.text("question")
    real = isinstance(raw.schema["answer"].dataType, T.BooleanType)
    checks.skip(F.col("answer").isNull() if real else F.lit(True), "invalid_boolq_answer")
    answer = F.col("answer") if real else F.lit(None).cast("boolean")
    return {
        "state": F.concat(F.lit("Passage: "), passage, F.lit("\nQuestion: "), question), "group": passage, "kind": F.lit("noul"),
        "instructions": F.lit(READS), "candidates": strings(READS_ANSWERS),
        "target": F.when(answer, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))),
    }


def _instruct(raw, config, checks):
    task = checks.text("task")
    checks.skip(~task.isin(*INSTRUCT), "outside_instruct_allowlist")
    inputs = checks.text("inputs")
    parts = F.split(inputs, "\n", 2)
    header = parts[0]
    checks.skip((F.size(parts) < 2) | ~header.startswith(INSTRUCT_PREFIX) | ~header.endswith("."), "unsupported_instruct_format")
    options = F.regexp_extract_all(F.substr(header, F.lit(len(INSTRUCT_PREFIX) + 1)), F.lit(r'"([^"\n]+)"'), 1)
    targets = checks.text("targets")
    checks.skip(~targets.endswith("."), "unsupported_instruct_target")
    answer = F.substr(targets, F.lit(1), F.length(targets) - 1)
    scale, kind, question = F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (values, its_kind, its_question) in INSTRUCT.items():
        scale, kind, question = F.when(task == name, strings(values)).otherwise(scale), F.when(task == name, its_kind).otherwise(kind), F.when(task == name, its_question).otherwise(question)
    checks.skip((F.size(options) < 2) | (F.size(F.array_distinct(options)) != F.size(options)) | (F.size(F.array_except(options, scale)) > 0) | ~F.array_contains(options, answer), "invalid_instruct_options")
    state = strip(F.get(parts, F.lit(1)))
    checks.skip(is_blank(state), "blank_instruct_state")
    target = F.transform(scale, lambda c: (c == answer).cast("double"))
    return {"task": task, "state": state, "group": state, "instructions": question, "kind": kind, "candidates": scale, "target": target}


def _bigbench(raw, config, checks):
    state = checks.text("inputs")
    candidates, scores = F.col("multiple_choice_targets"), F.col("multiple_choice_scores").cast("array<double>")
    checks.skip(F.size(candidates) == 0, "open_ended_bigbench")
    checks.skip((F.size(candidates) != F.size(scores)) | (F.size(scores) < 2), "invalid_bigbench_scores")
    checks.skip(~all_finite(scores) | F.exists(scores, lambda s: s < 0), "invalid_bigbench_scores")
    checks.skip((total(scores) <= 0) | (F.size(F.array_distinct(scores)) == 1), "uninformative_bigbench_scores")
    return {"state": state, "group": state, "instructions": F.lit(CHOOSES), "candidates": candidates, "target": F.transform(scores, lambda s: F.try_divide(s, total(scores)))}


ADAPTERS: dict[str, Callable] = {"nli": _nli, "zero_shot": _zero_shot, "doc_nli": _doc_nli, "defeasible": _defeasible, "hellaswag": _hellaswag, "boolq": _boolq, "instruct": _instruct, "bigbench": _bigbench}


def adapt(raw: DataFrame, dataset: str, adapter: str, config: str, split: str, max_candidates: int | None = None, exact: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decision columns and skip_reason for every raw row; an unknown adapter is an error.

    ``exact`` takes normalising and row ids to one Arrow stage for bits that equal canonical JSON's; otherwise all
    stays in the JVM. ``keep`` names raw columns to carry along.
    """
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}")
    checks = Checks()
    made = ADAPTERS[adapter](raw, config, checks)
    candidates = made["candidates"]
    checks.skip(candidates.isNull() | F.exists(candidates, is_blank), "invalid_candidates")
    clean = F.transform(candidates, strip)
    checks.skip(F.size(F.array_distinct(clean)) != F.size(clean), "duplicate_candidates")
    if max_candidates is not None:
        checks.skip(F.size(clean) > max_candidates, "over_candidate_limit")
    rows = raw.select(
        *keep, checks.reason().alias("skip_reason"), made["state"].alias("state"), made["instructions"].alias("instructions"), clean.alias("candidates"), made["target"].alias("target"),
        made.get("kind", F.lit("choice")).alias("kind"), F.lit(dataset).alias("source"), made.get("task", F.lit(f"{dataset}/{config}")).alias("task"), F.lit(split).alias("original_split"), made["group"].alias("_group"),
    )
    rows = rows.withColumn("group_id", group_id(F.col("_group"), exact)).drop("_group")
    ids = row_id(F.struct(*FIELDS)) if exact else native_row_id(*FIELDS)
    return rows.withColumn("id", F.when(F.col("skip_reason").isNull(), ids))
