"""Returns, drawdown and per-observation Sharpe over equity curves (run_id, open_us, equity).

Curves are worked on in blocks, the replay's own where they come from it; the point before and the peak are
handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import DURATIONS
from ..plans.scratch import written
from . import scan
from .ledger import until


def in_blocks(curve: DataFrame) -> DataFrame:
    """curve, written aside, with its blocks."""
    curve = written(curve)
    return curve if scan.BLOCK in curve.columns else scan.blocked(curve, max(DURATIONS.values()))


def periodic_returns(curve: DataFrame, initial: float = 1000.0) -> DataFrame:
    """curve with `ret`: equity over the point before, the first over the initial cash, less one.

    A denominator that is not positive gives a null; `bad_denominator` marks it.
    """
    rows = scan.with_previous(in_blocks(curve), "run_id", "open_us", F.col("equity").cast("double"), "_prev")
    before = F.coalesce("_prev", F.lit(initial))
    return rows.withColumn("ret", F.when(before > 0, F.col("equity").cast("double") / before - 1)).withColumn("bad_denominator", before <= 0).drop("_prev")


def drawdowns(curve: DataFrame, initial: float = 1000.0) -> DataFrame:
    """curve with `peak`, at least the initial cash, and `drawdown` from it."""
    own = F.col("equity").cast("double")
    rows = scan.with_earlier(in_blocks(curve).withColumn("_top", F.max(own).over(until(0))), "run_id", "open_us", _peak=("max", own))
    rows = rows.withColumn("peak", F.greatest(F.lit(initial), "_peak", "_top")).drop("_top", "_peak")
    return rows.withColumn("drawdown", (F.col("peak") - own) / F.col("peak"))


def stage1_parts(initial: float = 1000.0) -> list[Column]:
    """Aggregates of a run's drawdowns: total_return and max_drawdown."""
    final = F.max_by(F.col("equity").cast("double"), "open_us")
    return [(final / initial - 1).alias("total_return"), F.max("drawdown").alias("max_drawdown")]


def stage1(curve: DataFrame, initial: float = 1000.0) -> DataFrame:
    """(run_id, total_return, max_drawdown)."""
    return drawdowns(curve, initial).groupBy("run_id").agg(*stage1_parts(initial))


def stage2(curve: DataFrame, initial: float = 1000.0, risk_free: float = 0.0) -> DataFrame:
    """(run_id, mean_return, return_stdev, sharpe_ratio), all null for a run with a denominator that is not
    positive, fewer than two returns or no spread. exact.metrics says which, as an error."""
    got = periodic_returns(curve, initial).groupBy("run_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("*").alias("n"), F.bool_or("bad_denominator").alias("bad"))
    good = ~F.col("bad") & (F.col("n") >= 2) & (F.col("s") > 0)
    value = lambda c, name: F.when(good, c).alias(name)
    return got.select("run_id", value(F.col("m"), "mean_return"), value(F.col("s"), "return_stdev"), value((F.col("m") - risk_free) / F.col("s"), "sharpe_ratio"))
