"""Command line: prepare, bundle, verify, pull, calibrate, evaluate, compare, benchmark, predict, serve, sweep."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arbitra.operators import compare as comparing
from arbitra.operators import sampling
from arbitra.plans import evaluate as ev
from arbitra.plans import prepare as prep
from arbitra.sources import bundles, files
from arbitra.sources.shared import Store
from arbitra.streaming import serve


def session() -> SparkSession:
    return SparkSession.builder.appName("arbitra").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def prepare(args) -> dict:
    """Native splits stand under data/<dataset>/<config>/<split> as Parquet with an ``ord`` column."""
    spark, config = session(), files.load_config(args.config)
    specs = files.load_config(args.sources)["sources"]
    for spec in specs:
        if spec["configs"] == "discover":
            spec["configs"] = files.discover_configs([p.name for p in Path(args.data, spec["dataset"]).iterdir()], config.get("bigbench_configs"))
    return prep.run(spark, specs, lambda dataset, name, split: spark.read.parquet(f"{args.data}/{dataset}/{name}/{split}"), config, args.output, merged=args.merged)


def compare(args) -> dict:
    """Stand-in scorers by name: hash (logits from ids) and uniform."""
    scorers = {"hash": ev.hash_scored, "uniform": lambda rows: rows.withColumn("logits", F.array_repeat(F.lit(0.0), F.size("candidates")))}
    return ev.compare(session(), args.data, {n: scorers[n] for n in args.models.split(",")}, args.output, args.per_source, args.seed)


def benchmark(args) -> dict:
    """Times scoring of a labelled file's decisions, so many in each request."""
    spark = session()
    rows = sampling.ordinals(ev.load(spark, args.data), ["id"])
    rows = rows.where(F.col("ordinal") < args.limit).persist() if args.limit else rows.persist()
    decisions = rows.count()
    report = ev.benchmark(lambda: ev.hash_scored(rows).write.format("noop").mode("overwrite").save(), -(-decisions // args.decisions_per_request), decisions, args.warmups, args.repeats)
    rows.unpersist()
    return report | {"requests": -(-decisions // args.decisions_per_request), "decisions": decisions}


def serving(args) -> dict:
    """JSON Lines of request_id and body that arrive in a folder, answered into another: until none is left, or (--every-ms) until stopped."""
    spark = session()
    # a request arrives with its file, which may be long before a trigger sees it
    stream = spark.readStream.schema("request_id string, body string").option("maxFilesPerTrigger", args.files).json(args.input).select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    trigger = {"processingTime": f"{args.every_ms} milliseconds"} if args.every_ms else None
    served = []

    def sink(frame, number: int) -> None:
        frame.write.mode("overwrite").json(f"{args.output}/batch={number}")
        served.append(number)

    serve.serve(stream, sink, args.checkpoint, args.capacity, args.timeout_ms, temperature=args.temperature, trigger=trigger, most=args.most, wait_ms=args.batch_wait_ms, lanes=args.lanes).awaitTermination()
    return {"batches": len(served)}


def pull(args) -> dict:
    """A snapshot from a folder of any file system, verified and published under its revision."""
    spark = session()

    def fetch(folder: str) -> None:
        store = Store(spark)
        for name in store.files(args.source):
            store.join([f"{args.source}/{name}"], f"{folder}/{name}")

    return {"folder": bundles.promote(spark, fetch, args.output, args.source, args.revision)}


def predict(args) -> dict:
    """One request from a file or standard input."""
    body = sys.stdin.read() if args.input == "-" else Path(args.input).read_text()
    spark = session()
    row = serve.respond(spark.createDataFrame([(0, body)], "request_id int, body string"), temperature=args.temperature).first()
    if row["status"] != 200:
        raise SystemExit(f"{row['status']}: {row['detail']}")
    return {"answers": {k: {n: v for n, v in json.loads(a).items() if v is not None} for k, a in row["answers"].items()}}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name, run, *options):
        sub = verbs.add_parser(name)
        for option, kwargs in options:
            sub.add_argument(option, **kwargs)
        sub.set_defaults(run=run)

    needed = {"required": True}
    verb("prepare", prepare, ("--config", needed), ("--sources", needed), ("--data", needed), ("--output", needed), ("--merged", {"action": "store_true"}))
    verb("bundle", lambda a: bundles.build(session(), a.data), ("--data", needed))
    verb("verify", lambda a: bundles.verify(session(), a.data), ("--data", needed))
    verb("calibrate", lambda a: {"temperature": ev.calibrate(session(), a.model, a.data)}, ("--model", needed), ("--data", needed))
    verb("evaluate", lambda a: ev.evaluate(session(), a.data, a.temperature, a.output), ("--data", needed), ("--output", needed), ("--temperature", {"type": float, "default": 1.0}))
    number = lambda default: {"type": int, "default": default}
    verb("compare", compare, ("--data", needed), ("--output", needed), ("--models", {"default": "hash,uniform"}), ("--per-source", number(0)), ("--seed", number(42)))
    verb("benchmark", benchmark, ("--data", needed), ("--decisions-per-request", number(1)), ("--limit", number(0)), ("--warmups", number(1)), ("--repeats", number(3)))
    verb("serve", serving, ("--input", needed), ("--output", needed), ("--checkpoint", needed), ("--capacity", number(1024)), ("--timeout-ms", number(30_000)), ("--most", number(64)), ("--batch-wait-ms", number(0)), ("--every-ms", number(0)), ("--files", number(1)), ("--lanes", number(1)), ("--temperature", {"type": float, "default": 1.0}))
    verb("pull", pull, ("--source", needed), ("--output", needed), ("--revision", needed))
    verb("predict", predict, ("--input", {"default": "-"}), ("--temperature", {"type": float, "default": 1.0}))
    verb("sweep", lambda a: [r.asDict() for r in comparing.sweep_grid(session(), compiled=a.compile, flash=a.flash).orderBy(F.col("compile_model"), "name").collect()], ("--compile", {"action": "store_true"}), ("--flash", {"action": "store_true"}))
    args = parser.parse_args(argv)
    print(json.dumps(args.run(args), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
