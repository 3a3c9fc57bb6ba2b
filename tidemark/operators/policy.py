"""Policies in Python: a fresh object for each run, asked bar by bar with the bars available by then.

A column expression (ledger.momentum) is the way that scales within a run; an object sees its run in one
task, and runs are independent.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Targets: long, flat, short (fixed values).
TARGETS = (1, 0, -1)


class Policy(Protocol):
    def target_position(self, as_of_us: int, bars: pd.DataFrame) -> int:
        """1, 0 or -1, from the bars that are available at as_of_us, in order."""


def accepted(policy: Any, used: list[Any]) -> Any:
    """policy, if it can be asked and is none of those used before; then it counts as used."""
    if not callable(getattr(policy, "target_position", None)):
        raise TypeError("a policy needs a target_position")
    if any(policy is x for x in used):
        raise ValueError("the factory gave an instance that was used before")
    used.append(policy)
    return policy


def with_targets(bars: DataFrame, factory: Callable[[], Any], dur: int, name: str = "target") -> DataFrame:
    """bars with the target that a policy of the run's own gives after each bar."""
    if not callable(factory):
        raise TypeError("a policy factory must be callable")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("open_us", ignore_index=True)
        policy = accepted(factory(), [])
        out = [policy.target_position(int(at) + dur, rows.iloc[: k + 1]) for k, at in enumerate(rows["open_us"])]
        if any(x not in TARGETS for x in out):
            raise ValueError(f"a target must be one of {TARGETS}")
        return rows.assign(**{name: out})

    return bars.groupBy("run_id").applyInPandas(run, T.StructType([*bars.schema.fields, T.StructField(name, T.IntegerType())]))


class Crossing:
    """Long above the mean close of the bars seen, short below it, flat at it."""

    def __init__(self) -> None:
        self.total, self.count = 0.0, 0

    def target_position(self, as_of_us: int, bars: pd.DataFrame) -> int:
        close = float(bars["close"].iloc[-1])
        self.total, self.count = self.total + close, self.count + 1
        mean = self.total / self.count
        return 0 if close == mean else 1 if close > mean else -1
