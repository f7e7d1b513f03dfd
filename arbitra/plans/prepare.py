"""Preparing a decision data set: adapt, split, decontaminate, sample, deduplicate, cap, encode, audit, write."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.text import content_key, split_for
from arbitra.operators import adapters, dedup, sampling, scoring
from arbitra.schema import SPLIT_PRIORITY, SPLITS
from arbitra.sources import bundles, files
from arbitra.sources.shared import Store


@dataclass(frozen=True)
class Settings:
    max_train_per_source: int = 50_000
    max_train_per_task: int = 5_000
    max_eval_per_source: int = 2_000
    max_length: int = 1024
    max_candidates: int = 16
    seed: int = 42
    scan_limit_per_split: int | None = None
    exact: bool = True

    def __post_init__(self):
        for name in ("max_train_per_source", "max_train_per_task", "max_eval_per_source", "max_length", "max_candidates"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        if self.max_length > scoring.LONGEST or self.max_candidates < 2:
            raise ValueError("max_length or max_candidates is out of range")
        limit = self.scan_limit_per_split
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
            raise ValueError("scan_limit_per_split must be null or a positive integer")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise ValueError("seed must be an integer")


@dataclass
class Prepared:
    written: DataFrame
    dispositions: DataFrame
    audit: DataFrame
    retained: DataFrame
    scans: list[dict] = field(default_factory=list)


def adapt_sources(specs: list[dict], load, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """All sources' rows with role, has_test, aggregate and src_ord; ``load(dataset, config, split)`` gives a native split."""
    parts, scans = [], []
    for order, spec in enumerate(specs):
        has_test = "test" in spec["splits"].values()
        for config in spec["configs"]:
            for split, role in spec["splits"].items():
                raw = load(spec["dataset"], config, split)
                if settings.scan_limit_per_split is not None:
                    raw = raw.orderBy("ord").limit(settings.scan_limit_per_split)
                rows = adapters.adapt(raw, spec["dataset"], spec["adapter"], config, split, settings.max_candidates, settings.exact)
                parts.append(rows.withColumns({"role": F.lit(role), "has_test": F.lit(has_test), "aggregate": F.lit(bool(spec.get("aggregate", False))), "src_ord": F.lit(order)}))
                scans.append(raw.agg(F.lit(spec["dataset"]).alias("source"), F.lit(config).alias("config"), F.lit(split).alias("split"), F.count(F.lit(1)).alias("scanned")))
    return reduce(DataFrame.unionByName, parts), scans


def prepare(rows: DataFrame, settings: Settings, tokenizer=scoring.whitespace_tokenizer) -> Prepared:
    """From adapted rows to what is written, with every row's disposition.

    Holdouts reserve their groups and contents before any train row is sampled, also those that caps drop later. Samples are the
    lowest seeded hashes, not filled up after later drops. A row's drop is counted under the first reason that holds.
    """
    eligible = rows.where("skip_reason is null").withColumn("split", split_for(F.col("role"), F.col("group_id"), F.col("has_test"), settings.seed))
    eligible = eligible.withColumn("content_key", content_key(F.col("state"), settings.exact)).persist()
    holdouts, train = eligible.where("role != 'train'"), eligible.where("role = 'train'")
    kept, overlap = dedup.drop_holdout_overlap(train, holdouts)
    pool = holdouts.unionByName(kept)
    limit = F.when(F.col("split") == "train", settings.max_train_per_source).otherwise(settings.max_eval_per_source)
    sample = sampling.hash_sample(pool, ["source", "split"], limit, settings.seed).drop("place")
    sample = scoring.encode(sample, settings.max_length, tokenizer).persist()
    marked = dedup.group_conflicts(sample, dedup.group_owners(holdouts)).withColumn("row_key", F.concat_ws("|", "source", "split", "id"))
    free = marked.where("NOT conflict")
    evaluation = dedup.first_wins(free.where("split != 'train'").withColumn("_rank", -dedup.split_priority(F.col("split"))), ["_rank", "src_ord", "prio", "id"])
    capped = dedup.capped_first_wins(free.where("split = 'train'"), settings.max_train_per_task)
    decided = evaluation.select("row_key", "disposition").unionByName(capped).unionByName(marked.where("conflict").select("row_key", F.lit("group_partition_conflict").alias("disposition")))
    dispositions = marked.join(decided, "row_key")
    written = dispositions.where(F.col("disposition") == dedup.WRITTEN)
    named = F.when(F.col("disposition") == dedup.WRITTEN, F.concat(F.lit("written:"), "split")).when(F.col("disposition") == "overlength", F.concat(F.lit("dropped:overlength:"), "split")).otherwise(F.concat(F.lit("dropped:"), "disposition"))
    n = F.count(F.lit(1)).alias("n")
    seen = pool.groupBy("source", "split").agg(n)
    taken = sample.groupBy("source", "split").agg(F.count(F.lit(1)).alias("taken"))
    lost = seen.join(taken, ["source", "split"], "left").select("source", F.concat(F.lit("dropped:sampling_or_repetition:"), "split").alias("disposition"), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
    audit = (
        rows.groupBy("source").agg(n).select("source", F.lit("raw_scanned").alias("disposition"), "n")
        .unionByName(rows.where("skip_reason is not null").groupBy("source", F.concat(F.lit("dropped:"), "skip_reason").alias("disposition")).agg(n))
        .unionByName(overlap.groupBy("source").agg(n).select("source", F.lit("dropped:holdout_overlap").alias("disposition"), "n"))
        .unionByName(seen.select("source", F.concat(F.lit("eligible:"), "split").alias("disposition"), "n"))
        .unionByName(taken.select("source", F.concat(F.lit("sampled:"), "split").alias("disposition"), F.col("taken").alias("n")))
        .unionByName(lost.where("n > 0"))
        .unionByName(dispositions.groupBy("source", named.alias("disposition")).agg(n))
    )
    retained = written.groupBy("source", "split", "task").agg(n)
    return Prepared(written, dispositions, audit, retained)


def check_complete(prepared: Prepared, sources: list[str]) -> dict[str, int]:
    """Rows by split; an error where a source has no train row or a split is empty."""
    counts = {r["split"]: r["count"] for r in prepared.written.groupBy("split").count().collect()}
    trained = {r.source for r in prepared.written.where("split = 'train'").select("source").distinct().collect()}
    if missing := sorted(set(sources) - trained):
        raise RuntimeError(f"no usable training rows for: {', '.join(missing)}")
    if any(not counts.get(s) for s in SPLIT_PRIORITY):
        raise RuntimeError(f"an output partition is empty: {counts}")
    return counts


def run(spark: SparkSession, specs: list[dict], load, config: dict, output: str, tokenizer=scoring.whitespace_tokenizer, merged: bool = False) -> dict:
    """The whole job into an empty folder of any file system: manifest (preparing, then complete or failed) and Spark's part files of each split.

    With ``merged`` each split becomes one JSON Lines file, which the driver streams together.
    """
    store, out = Store(spark), str(output).rstrip("/")
    if store.exists(out) and (not store.is_folder(out) or store.names(out)):
        raise FileExistsError(out)
    names = Settings.__dataclass_fields__
    settings = Settings(**{k: v for k, v in config.items() if k in names})
    manifest = {"status": "preparing", "format_version": bundles.FORMAT_VERSION, "config": config, "sources": specs, "seed": settings.seed, "scan_limit_per_split": settings.scan_limit_per_split}
    store.write_json(f"{out}/manifest.json", manifest)
    try:
        rows, scans = adapt_sources(specs, load, settings)
        prepared = prepare(rows, settings, tokenizer)
        counts = check_complete(prepared, [s["dataset"] for s in specs])
        audit: dict[str, dict[str, int]] = {}
        for r in prepared.audit.collect():
            audit.setdefault(r.source, {})[r.disposition] = r.n
        columns = ["id", "state", "instructions", "candidates", "target", "kind", "source", "task", "original_split", "group_id", "input_ids", "attention_mask", "labels", "split"]
        parts = f"{out}/.parts"
        files.write_splits(prepared.written.repartitionByRange("split", "src_ord", "prio").sortWithinPartitions("split", "src_ord", "prio").select(columns), parts)
        for split in SPLITS:
            store.move(f"{parts}/split={split}", f"{out}/split={split}")
        store.delete(parts)
        if merged:
            files.merge_splits(spark, out)
        retained: dict[str, dict[str, int]] = {}
        for r in prepared.retained.collect():
            retained.setdefault(f"{r.source}:{r.split}", {})[r.task] = r.n
        limit = settings.scan_limit_per_split
        scanned = [r.asDict() | {"scan_limit_reached": limit is not None and r.scanned == limit} for r in reduce(DataFrame.unionByName, scans).collect()]
        manifest |= {"status": "complete", "counts": {s: counts[s] for s in SPLITS}, "source_counts": audit, "retained_tasks": retained, "scans": scanned}
    except Exception as error:
        manifest |= {"status": "failed", "error": str(error)[:2000]}
        raise
    finally:
        store.write_json(f"{out}/manifest.json", manifest)
    return manifest
