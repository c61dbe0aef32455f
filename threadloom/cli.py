"""Command line: context generation, rank benchmark, prompt adherence, prompt refinement.

    python -m threadloom.cli contexts --comments DIR --submissions DIR --users a,b --output DIR
    python -m threadloom.cli rank|adherence|refine --workflow W --models m1,m2 --judge-model J --input-data-file F ...
"""

from __future__ import annotations

import argparse
import logging
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.operators import authors, report, threads
from threadloom.plans import judging
from threadloom.plans.workflow import FORMATTERS, WORKFLOWS, Catalogue, judge_inputs, run_workflow
from threadloom.schema import COMMENTS, SUBMISSIONS
from threadloom.session import session
from threadloom.sources.clients import HttpClient
from threadloom.sources.csv import read_contexts, read_csv, sampled_contexts
from threadloom.sources.ndjson import ensure_parquet_cache
from threadloom.sources.prompts import load_prompt
from threadloom.tables import exists

PROMPTS = ("inference", "intent_only", "koa_only", "all_in_one")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    ctx = commands.add_parser("contexts", help="nested contexts of users, one folder per user")
    for name in ("--comments", "--submissions", "--cache", "--output"):
        ctx.add_argument(name, required=True)
    ctx.add_argument("--pattern", default="*.zst")
    ctx.add_argument("--users", help="comma-separated; without it users are sampled")
    ctx.add_argument("--num-users", type=int, default=10)
    ctx.add_argument("--sample-window", type=int, default=1000)
    for name in ("rank", "adherence", "refine"):
        c = commands.add_parser(name)
        c.add_argument("--workflow", choices=sorted(WORKFLOWS), required=True)
        c.add_argument("--models", required=True, help="comma-separated; adherence and refine take one")
        c.add_argument("--judge-model", required=True)
        c.add_argument("--judge-prompt-module")
        c.add_argument("--input-data-file")
        c.add_argument("--input-data-dir")
        c.add_argument("--num-samples", type=int, default=1 if name == "refine" else 10)
        c.add_argument("--output-dir", required=True)
        c.add_argument("--prompts", required=True, help="folder with <name>/v<N>.txt")
        c.add_argument("--url", required=True, help="chat completions endpoint; the key comes from TEXT_MODEL_KEY")
        c.add_argument("--seed", type=int)
        c.add_argument("--answers", help="folder of answers; prompts that it holds are not asked again")
        c.add_argument("--model-to-evaluate", help="of the models, the one whose outputs are judged; all by default")
        c.add_argument("--debug", action="store_true", help="log at debug level and keep Spark's messages")
    return top


def contexts(args) -> None:
    spark = session()
    comments = ensure_parquet_cache(spark, args.comments, args.pattern, COMMENTS, f"{args.cache}/comments")
    submissions = ensure_parquet_cache(spark, args.submissions, args.pattern, SUBMISSIONS, f"{args.cache}/submissions")
    if args.users:
        users = spark.createDataFrame([(u,) for u in args.users.split(",")], "user string")
    else:
        users = authors.sample_targets(comments, ["created_utc", "id"], args.sample_window, args.num_users).withColumnRenamed("author", "user")
    sinks.write_by_user(threads.contexts(comments, submissions, users), args.output)


def evaluate(args, client=None) -> str:
    spark = session()
    if args.debug:
        logging.basicConfig(level=logging.DEBUG)
        spark.sparkContext.setLogLevel("INFO")
    names = {t.prompt for s in WORKFLOWS[args.workflow] for t in s.tasks} | set(PROMPTS)
    found = {n: load_prompt(args.prompts, n) for n in sorted(names) if (Path(args.prompts) / n).is_dir()}
    catalogue = Catalogue(found, formatters=FORMATTERS)
    workflow = WORKFLOWS[args.workflow]
    named, directive = judging.default_directive(workflow, catalogue, args.judge_prompt_module)
    client = client or HttpClient(args.url, os.environ["TEXT_MODEL_KEY"])
    models = args.models.split(",")
    source = args.input_data_file or args.input_data_dir
    name = lambda seed, append: sinks.result_name(
        args.output_dir, args.command, args.workflow, args.judge_model, named, Path(source).stem, seed, append
    )
    seed = args.seed if args.seed is not None else int(time.time())
    if args.command == "refine":
        path = name(None, True)
        runs = spark.read.parquet(path) if exists(spark, path) else None
        seed = judging.effective_seed(args.seed, runs)
    frame = read_csv(spark, args.input_data_file) if args.input_data_file else read_contexts(spark, args.input_data_dir)
    samples = sampled_contexts(frame, args.num_samples, seed)
    results = run_workflow(samples, models, workflow, catalogue, client, answers=args.answers)
    inputs = judge_inputs(results, workflow)
    if args.model_to_evaluate:
        if args.model_to_evaluate not in models:
            raise ValueError(f"{args.model_to_evaluate} is none of the models")
        inputs = inputs.where(F.col("model") == args.model_to_evaluate)
    run = {"seed": seed, "workflow_name": args.workflow, "judge_prompt_name": named, "judge_prompt_version": catalogue.version(named)}
    if args.command == "rank":
        long = judging.judge_rankings(samples, inputs, client, args.judge_model, directive, seed, answers=args.answers)
        sinks.write_csv(judging.wide(long, results, catalogue, models, run), path := name(seed, False))
        report.leaderboard(long).show(truncate=False)
        report.leaderboard_by_tercile(long).show(truncate=False)
        return path
    long = judging.judge_constraints(samples, inputs, client, args.judge_model, directive, answers=args.answers)
    flat = long.withColumn("violated_constraints", F.to_json("violated_constraints")).withColumns({k: F.lit(v) for k, v in run.items()})
    if args.command == "refine":
        sinks.append_run(flat.withColumn("run_id", F.lit(time.time_ns())), path)
    else:
        sinks.write_csv(flat, path := name(seed, False))
    report.violation_summary(long).show()
    report.top_violations(flat, "violated_constraints").show(truncate=False)
    return path


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    contexts(args) if args.command == "contexts" else evaluate(args)


if __name__ == "__main__":
    main()
