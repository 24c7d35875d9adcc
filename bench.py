"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default
8). Each query runs once to warm up and then RUNS times, results going nowhere
but computed in full; the least time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from quarrystone import queries as core
from quarrystone.plans.workflow import Workspace
from quarrystone.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
HEADLINE = [
    *[f"tpch_q{i}" for i in range(1, 23)], "micro_filter", "micro_aggregate", "micro_join", "micro_join_key", "micro_limit",
    "masked_filter", "masked_limit", "masked_aggregate", "join_mn", "join_pkfk_partial", "rematerialize", "row_id", "flagship",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    spark = local_session(CPUS, memory="16g", partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    found, queries = {}, core.queries()
    for name in HEADLINE:
        drain = lambda name=name: queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        try:
            drain()
            found[name] = round(min(timed(drain) for _ in range(RUNS)), 3)
        except Exception as e:  # a query that fails is missing from the figures, and named
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
    with tempfile.TemporaryDirectory() as folder:
        table, sql = f"{SF_DIR}/orders.parquet", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"
        took: dict[str, list[float]] = {}
        for i in range(1 + RUNS):  # each time a new workspace, which knows no manifest
            space = Workspace(spark, f"{folder}/{i}")
            for step, run in (("commit_orders", lambda: space.commit(table)), ("prove_orders", lambda: space.prove(sql, [table])), ("verify_orders", lambda: space.verify(sql, [table]))):
                took.setdefault(step, []).append(timed(run))
        found |= {step: round(min(times[1:]), 3) for step, times in took.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
