"""Rules of the planner that a proof is made with, and checked with.

A certificate records them, so that a checker plans as the prover did. Only
settings that choose how a query is carried out are allowed, none that change
what it returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

EXCLUDED = "spark.sql.optimizer.excludedRules"
#: Settings that may be overridden, by prefix.
ALLOWED = (EXCLUDED, "spark.sql.adaptive.", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.cbo.", "spark.sql.join.preferSortMergeJoin", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")


@dataclass
class Rules:
    """Overrides of the planner, built step by step: ``Rules().without("...").set("...", "...")``."""

    settings: dict[str, str] = field(default_factory=dict)

    def without(self, *rules: str) -> Rules:
        """Leave out optimiser rules, by class name or by the last part of it."""
        full = [r if "." in r else f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in rules]
        had = [r for r in self.settings.get(EXCLUDED, "").split(",") if r]
        return self.set(EXCLUDED, ",".join(dict.fromkeys(had + full)))

    def set(self, name: str, value: str) -> Rules:
        if not name.startswith(ALLOWED):
            raise ValueError(f"{name} may change results")
        return Rules(self.settings | {name: str(value)})

    @property
    def sound(self) -> bool:
        return all(name.startswith(ALLOWED) for name in self.settings)

    @contextmanager
    def applied(self, spark: SparkSession) -> Iterator[None]:
        before = {name: spark.conf.get(name, None) for name in self.settings}
        try:
            for name, value in self.settings.items():
                spark.conf.set(name, value)
            yield
        finally:
            for name, value in before.items():
                if value is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, value)
