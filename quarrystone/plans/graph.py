"""Plans as text, JSON and Graphviz."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame


def plan_json(df: DataFrame) -> list[dict]:
    return json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def plan_hash(df: DataFrame) -> str:
    """Of the optimised plan without expression ids and paths: equal for one query over one schema and one engine."""
    text = re.sub(r"#\d+L?|\[plan_id=\d+\]|(file|hdfs|viewfs|s3a?):[^\s,\]]*", "", plan_text(df))
    return hashlib.sha256(text.encode()).hexdigest()


def graphviz(df: DataFrame) -> str:
    """The optimised plan as a DOT graph, edges from child to parent."""
    nodes, edges, stack = [], [], []
    for n, line in enumerate(plan_text(df).splitlines()):
        mark = re.search(r"[A-Za-z'!]", line)
        depth, label = (mark.start() if mark else 0), line[mark.start() if mark else 0 :].replace("\\", "\\\\").replace('"', '\\"')
        nodes.append(f'  n{n} [label="{label[:120]}"];')
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            edges.append(f"  n{n} -> n{stack[-1][1]};")
        stack.append((depth, n))
    return "\n".join(["digraph plan {", "  node [shape=box];", *nodes, *edges, "}"])
