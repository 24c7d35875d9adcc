"""Choices made from row counts, recorded so that a checker can replay them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import ACTIVE, next_power_of_two

REMATERIALIZE, TRUNCATE = "rematerialize", "truncate"


def counted(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.count(F.when(F.col(ACTIVE), 1)).alias("a")).first()
    return r["n"], r["a"]


def suggest(nodes: dict[str, DataFrame], under_check: tuple[str, ...] = (), truncate: bool = False) -> list[dict]:
    """For named masked results: compact those whose power of two shrinks, cut off those without an active row.

    Results directly under the final check are left alone; cutting off is off by default.
    """
    hints = []
    for path, df in nodes.items():
        n, active = counted(df)
        if truncate and not active:
            hints.append({"path": path, "hint": TRUNCATE})
        elif path not in under_check and next_power_of_two(active) < next_power_of_two(n):
            hints.append({"path": path, "hint": REMATERIALIZE, "rows": n, "active": active})
    return hints


def sound(df: DataFrame, path: str, hints: list[dict]) -> bool:
    """Whether the hints for a masked result change none of its rows: only what has no active row may be cut off."""
    own = [h for h in hints if h["path"] == path]
    known = all(h["hint"] in (REMATERIALIZE, TRUNCATE) for h in own)
    return known and (not any(h["hint"] == TRUNCATE for h in own) or not df.where(F.col(ACTIVE)).limit(1).count())


def apply(df: DataFrame, path: str, hints: list[dict]) -> DataFrame:
    from ..operators.mask import rematerialize

    for h in hints:
        if h["path"] == path:
            return df.limit(0) if h["hint"] == TRUNCATE else rematerialize(df)
    return df


def dumps(hints: list[dict]) -> str:
    return json.dumps(hints, sort_keys=True)
