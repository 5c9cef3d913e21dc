"""The store at a command line: add, access, retire, pin, recall, refresh, list and stats."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .functions import model


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tideline")
    out.add_argument("--store", default=None, help="path of the store")
    out.add_argument("--pure", action="store_true", help="recall without similarity, worth and supersession")
    sub = out.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("--content", required=True)
    add.add_argument("--category", default="general")
    add.add_argument("--protected", action="store_true")
    add.add_argument("--id", dest="memory_id", default=None)
    add.add_argument("--supersedes", default=None)
    for name in ("access", "retire", "pin"):
        sub.add_parser(name).add_argument("memory_id")
    recall = sub.add_parser("recall")
    recall.add_argument("--budget", type=int, default=model.BUDGET)
    recall.add_argument("--query", default=None)
    either = recall.add_mutually_exclusive_group()
    either.add_argument("--force-similarity", dest="force", action="store_true", default=None)
    either.add_argument("--no-similarity", dest="force", action="store_false")
    sub.add_parser("refresh").add_argument("--max-entries", type=int, default=0)
    sub.add_parser("list")
    sub.add_parser("stats")
    return out


def run(engine: Engine, args: argparse.Namespace, out=None) -> int:
    """One command against an engine; 0, or 1 if a row refused."""
    say = lambda x: print(x, file=out or sys.stdout)
    code = 0
    if args.command == "add":
        say(engine.add(args.content, args.category, args.protected, args.memory_id, supersedes=args.supersedes))
    elif args.command in ("access", "retire", "pin"):
        done = getattr(engine, args.command)(args.memory_id)
        say(f"{args.command} {args.memory_id}" if done else f"refused: {args.memory_id}")
        code = 0 if done else 1
    elif args.command == "recall":
        say(engine.recall(args.budget, query=args.query, force_similarity=args.force).text)
    elif args.command == "refresh":
        say(json.dumps(engine.refresh(max_entries=args.max_entries), sort_keys=True))
    elif args.command == "list":
        for r in engine.ordered().select("id", "strength", "tier", "retired", "summary_text").toLocalIterator():
            say(f"{r['id']}\t{r['strength']:.4f}\t{r['tier']}{' retired' if r['retired'] else ''}\t{r['summary_text']}")
    else:
        say(json.dumps(engine.stats(), indent=2, sort_keys=True))
    if args.command not in ("list", "stats") and engine.path:
        engine.save()
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    for name in ("budget", "max_entries"):
        if getattr(args, name, 0) < 0:
            print(f"{name} must not be negative", file=sys.stderr)
            return 2
    spark = spark or SparkSession.builder.appName("tideline").getOrCreate()
    switches = {"similarity": False, "knapsack": False, "stale_retirement": False} if args.pure else {}
    try:
        with Engine(spark, args.store, **switches) as engine:
            return run(engine, args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
