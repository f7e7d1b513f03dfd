"""Text expressions: trimming, normalising, digests, split assignment, prompts."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode and the four separators that also count as such.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null too."""
    return F.coalesce(strip(text) == "", F.lit(True))


def normalize(text: Column) -> Column:
    """Lower case with sharp s spelled out and white space collapsed: inside code generation.

    Equal to normalize_exact wherever NFKC changes nothing and lower case is case folding but for sharp s,
    which covers Western European prose; use normalize_exact for arbitrary scripts.
    """
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, rf"(?U){SPACE}+", " "))


@F.pandas_udf(T.StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def content_key(state: Column, exact: bool = False) -> Column:
    """Identity of a state, whatever is asked about it."""
    return digest(normalize_exact(state) if exact else normalize(state))


group_id = content_key


def seeded_hash(seed: int | str, key: Column) -> Column:
    """Sampling priority: 64 hexadecimal digits, which sort as the number does."""
    return digest(F.concat(F.lit(f"{seed}:"), key))


def split_for(role: Column, group: Column, has_test: Column, seed: int = 42) -> Column:
    """train and test stay; validation is dealt by its group's hash fraction (the first 16 digits over 2**64)."""
    first = F.conv(F.substring(seeded_hash(seed, group), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    fraction = first / float(2**64)
    dealt = F.when(fraction < 0.5, "validation").when(has_test | (fraction < 0.75), "calibration").otherwise("test")
    known = F.when(role.isin("train", "test"), role).when(role == "validation", dealt)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unsupported split role: "), F.coalesce(role, F.lit("null")))).cast("string"))


#: Task families whose native sources are preferred; prefixes of near relatives.
FAMILIES = ["mnli", "multi-nli", "anli", "boolq", "hellaswag", "defeasible-nli", "fol-nli", "doc-nli", "bigbench", "zero-shot-label-nli", "yelp-review-full"]
PREFIXES = ["boolq-natural-perturbations", "robust-nli", "breaking-nli"]


def excluded_task(task: Column) -> Column:
    name = F.replace(F.lower(task), F.lit("_"), F.lit("-"))
    out = F.arrays_overlap(F.split(name, "/"), F.array(*map(F.lit, FAMILIES))) | (name == "tweet-eval/sentiment")
    for prefix in PREFIXES:
        out = out | name.startswith(prefix)
    return out


def format_prompt(state: Column, instructions: Column, candidates: Column, kind: Column) -> Column:
    """The scorer's prompt; all candidates are listed so that one may refer to another."""
    listed = F.array_join(F.transform(candidates, lambda c, i: F.concat(i.cast("string"), F.lit(": "), c)), "\n")
    return F.concat(F.lit("Decision type: "), F.coalesce(kind, F.lit("choice")), F.lit("\nInstructions: "), instructions, F.lit("\nState:\n"), state, F.lit("\nCriteria:\n"), listed)


def canonical_json(value) -> str:
    """A string as it is, anything else as JSON with sorted keys; NaN and infinities are errors."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_text(raw: pd.Series) -> pd.Series:
    """Raw JSON of a state or description as canonical text; null stays null."""
    return raw.map(lambda r: None if r is None else canonical_json(json.loads(r)))


@F.pandas_udf(T.StringType())
def row_id(row: pd.DataFrame) -> pd.Series:
    """SHA-256 of a row's canonical JSON, over the struct's fields by name (bit-compatible ids)."""

    def plain(value):
        return value.tolist() if hasattr(value, "tolist") else list(value) if isinstance(value, (list, tuple)) else value

    return pd.Series([hashlib.sha256(json.dumps({k: plain(v) for k, v in zip(row.columns, values, strict=True)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for values in row.itertuples(index=False)])


def native_row_id(*fields: str) -> Column:
    """The engine's own row id: the same purpose without leaving the JVM, other bits than row_id."""
    return digest(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}))
