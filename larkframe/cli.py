"""Command line: run, explain or export a query, or generate test data."""

from __future__ import annotations

import argparse
import json
import sys

from larkframe import formats, plans
from larkframe.api import Engine
from larkframe.errors import EngineError
from larkframe.session import session
from larkframe.sources import generate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkframe", description="SQL over Parquet files, run by Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a query, or show or export its plan")
    run.add_argument("-q", "--query", required=True)
    run.add_argument("-f", "--file", nargs="+", help="Parquet files; else the folder of --data or DATA_PATH")
    run.add_argument("-t", "--table", nargs="+", help="names of the files, one each; else their stems")
    run.add_argument("-d", "--data")
    run.add_argument("-v", "--verbose", action="store_true", help="print times")
    how = run.add_mutually_exclusive_group()
    how.add_argument("--explain-only", action="store_true", help="print the logical plan")
    how.add_argument("--physical-plan", action="store_true")
    how.add_argument("--plan-json", action="store_true", help="print the optimized plan as JSON")
    how.add_argument("--manifest", action="store_true", help="write the query, its tables and plan")
    run.add_argument("-o", "--output", help="file for the plan, manifest or result")
    run.add_argument("--csv", action="store_true")
    tables = sub.add_parser("tables", help="print the tables of a folder as JSON")
    tables.add_argument("-d", "--data")
    gen = sub.add_parser("generate", help="write seeded test data")
    gen.add_argument("--table", choices=("orders", "order_items"), default="orders")
    gen.add_argument("-n", "--rows", type=int, default=10_000)
    gen.add_argument("-o", "--output", required=True)
    gen.add_argument("--seed", type=int, default=42)
    gen.add_argument("--files", type=int)
    return p


def _run(args: argparse.Namespace) -> str:
    engine = Engine(args.data, args.file, args.table)
    if args.manifest:
        return plans.export(engine.catalog, args.query).to_json()
    if args.explain_only:
        return plans.logical_text(engine.sql(args.query))
    if args.physical_plan:
        return plans.physical_text(engine.sql(args.query))
    if args.plan_json:
        return json.dumps(plans.plan_json(engine.sql(args.query)), indent=2)
    done = engine.run(args.query)
    if args.verbose:
        print(f"Execution time: {done.execution_time_ms:.1f} ms\nTotal time: {done.total_time_ms:.1f} ms", file=sys.stderr)
    return formats.csv(done.frame) if args.csv else formats.pretty(done.frame)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "generate":
            generate(session(), args.table, args.rows, args.output, args.seed, args.files)
            return 0
        out = json.dumps(Engine(args.data).list_tables(), indent=2) if args.command == "tables" else _run(args)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    if getattr(args, "output", None):
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        print(out.rstrip("\n"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
