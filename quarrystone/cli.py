"""python -m quarrystone.cli setup | commit | prove | verify | query | data-prep"""

from __future__ import annotations

import argparse
import sys
import time

from .plans import tpch
from .plans.workflow import Workspace, prepare, query
from .session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrystone")
    top.add_argument("--timed", action="store_true")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("setup", "commit", "prove", "verify", "query", "data-prep"):
        p = verbs.add_parser(verb)
        if verb != "query":
            p.add_argument("--workspace" if verb != "data-prep" else "--output", required=True)
        if verb in ("prove", "verify", "query"):
            which = p.add_mutually_exclusive_group(required=True)
            which.add_argument("--query")
            which.add_argument("--tpch-query", type=int)
        if verb != "setup":
            p.add_argument("--parquet-path", action="append", required=True)
        if verb in ("commit", "data-prep"):
            p.add_argument("--key", action="append")
        if verb in ("prove", "verify"):
            p.add_argument("--name", default="answer")
        if verb == "prove":
            p.add_argument("--without-rule", action="append", default=[])
        if verb == "verify":
            p.add_argument("--result-path")
        if verb == "query":
            p.add_argument("--logical-plan-graphviz", action="store_true")
        if verb == "data-prep":
            p.add_argument("--drop-null-rows", action="store_true")
            p.add_argument("--raw", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    began, spark, code = time.perf_counter(), local_session(), 0
    sql = (args.query or tpch.QUERIES[f"tpch_q{args.tpch_query}"]) if args.verb in ("prove", "verify", "query") else ""
    if args.verb == "data-prep":
        for path in args.parquet_path:
            prepare(spark, path, args.output, args.key, without_nulls=args.drop_null_rows, raw=args.raw)
    elif args.verb == "query":
        found = query(spark, sql, args.parquet_path, args.logical_plan_graphviz)
        if isinstance(found, str):
            print(found)
        elif found.isEmpty():
            print("Query returned 0 rows.")
        else:
            found.show(truncate=False)
    else:
        space = Workspace(spark, args.workspace)
        if args.verb == "setup":
            space.setup()
        elif args.verb == "commit":
            for path in args.parquet_path:
                print(space.commit(path, args.key).root)
        elif args.verb == "prove":
            space.rules = space.rules.without(*args.without_rule) if args.without_rule else space.rules
            print(space.prove(sql, args.parquet_path, args.name).result)
        else:
            report = space.verify(sql, args.parquet_path, args.name, args.result_path)
            for check, ok in report.checks.items():
                print(f"{'ok  ' if ok else 'FAIL'} {check}")
            code = 0 if report.ok else 1
    if args.timed:
        print(f"{args.verb}: {time.perf_counter() - began:.3f} s", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
