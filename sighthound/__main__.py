"""Command line: ``python -m sighthound COMMAND``; rows come as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .api import Engine
from .operators.durable import durable
from .operators.evaluation import overall
from .sources.truth import template


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sighthound")
    p.add_argument("--db", default="sighthound-store", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("hash", "analyze", "store"):
        sub.add_parser(name).add_argument("path")
    v = sub.add_parser("verify")
    v.add_argument("path")
    v.add_argument("--manifest", required=True)
    t = sub.add_parser("track")
    t.add_argument("path")
    t.add_argument("--iou", type=float, default=0.3)
    t.add_argument("--max-gap", type=int, default=2)
    t.add_argument("--store", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("sha256")
    q.add_argument("--class", dest="class_name")
    q.add_argument("--min-conf", type=float, default=0.0)
    q.add_argument("--time-start", type=float)
    q.add_argument("--time-end", type=float)
    q.add_argument("--tracks", action="store_true")
    c = sub.add_parser("create-template")
    c.add_argument("--cameras", nargs="+", required=True)
    c.add_argument("--output", default="ground_truth.json")
    g = sub.add_parser("evaluate")
    g.add_argument("--gt", required=True)
    g.add_argument("--output", help="folder for the scores as JSON")
    return p


def run(spark: SparkSession, args: argparse.Namespace):
    e = Engine(spark, args.db)
    if args.command in ("hash", "analyze"):
        return getattr(e, args.command)(args.path)
    if args.command == "store":
        return e.import_reports(args.path)
    if args.command == "verify":
        return e.verify(args.path, args.manifest)
    if args.command == "track":
        return e.track(args.path, args.iou, args.max_gap, args.store)
    if args.command == "evaluate":
        scores = durable(e.evaluate(args.gt))
        if args.output:
            scores.coalesce(1).write.mode("overwrite").json(args.output)  # two rows
        return overall(scores)
    return e.tracks(args.sha256, args.class_name) if args.tracks else e.query(args.sha256, args.class_name, args.min_conf, args.time_start, args.time_end)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "create-template":
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        Path(args.output).write_text(template(args.cameras, datetime.datetime.now().strftime("%Y-%m-%d %H:%M")))
        return
    spark = SparkSession.builder.appName("sighthound").getOrCreate()
    for line in run(spark, args).toJSON().toLocalIterator():
        sys.stdout.write(line + "\n")


if __name__ == "__main__":
    main()
