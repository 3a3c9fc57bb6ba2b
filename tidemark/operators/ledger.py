"""The replay of a target policy as window functions over bars.

The target of a bar is filled at the next bar's open, so positions, fills, entry prices, cash
and equity are lags and running sums over a run's evaluation bars. A run is cut into blocks of bars, so one
run is many tasks' work: lags reach into bars copied from the block before, and what has been paid and the
last fill are handed on from block to block. One partitioning, by run and block, and one order serve every
column. Bars: run_id, open_us, open, high, low, close, each a slot after the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import scan
from .costs import DUE, MONEY, CostModel, FundingModel, funding_due, linear, zero
from .policy import TARGETS

#: Bars that a target looks back at most, unless it is said.
LOOKBACK = 4


def in_run() -> WindowSpec:
    """A run's bars in order, as far as a policy looks back."""
    return scan.within("run_id", "open_us")


def until(last: int) -> WindowSpec:
    """A block's bars from the first to `last` rows after this one."""
    return in_run().rowsBetween(Window.unboundedPreceding, last)


def added(*terms: Column) -> Column:
    """The exact sum of terms of money."""
    out = terms[0].cast(MONEY)
    for t in terms[1:]:
        out = (out + t.cast(MONEY)).cast(MONEY)
    return out


def momentum() -> Column:
    """1 if a close is above the one before, -1 if not, 0 for the first bar."""
    before = F.lag("close").over(in_run())
    return F.when(before.isNull(), 0).when(F.col("close") > before, 1).otherwise(-1)


def flat_after_fall() -> Column:
    """1 above the close before, 0 at or below it, -1 below the two before: all kinds of changes occur."""
    one, two = (F.lag("close", k).over(in_run()) for k in (1, 2))
    return F.when(one.isNull(), 0).when(F.col("close") > one, 1).when(two.isNotNull() & (F.col("close") < one) & (F.col("close") < two), -1).otherwise(0)


def crossing(bars: DataFrame, dur: int, name: str = "target") -> DataFrame:
    """bars with a target from all bars so far: 1 above the mean of their closes, -1 below it, 0 at it.

    The sum and the number of closes are handed on from block to block, so a policy that looks at the whole prefix
    needs no task of its own for a run. close has 8 places at most.
    """
    rows = scan.blocked(bars, dur).withColumn("_close", F.col("close").cast("decimal(18,8)"))
    near = rows.withColumn("_sum", F.sum("_close").over(until(0))).withColumn("_n", F.count("*").over(until(0)))
    near = scan.with_earlier(near, "run_id", "open_us", _total=("sum", F.col("_close")), _count=("sum", F.lit(1)))
    total = (F.coalesce("_total", F.lit(0).cast("decimal(28,8)")) + F.col("_sum")).cast("decimal(28,8)")
    least = (F.col("_close") * (F.coalesce("_count", F.lit(0)) + F.col("_n")).cast("decimal(18,0)")).cast("decimal(38,8)")
    return near.withColumn(name, F.signum(least - total).cast("int")).select(*bars.columns, name)


def due_marks(events: DataFrame, dur: int, start: DataFrame) -> DataFrame:
    """(run_id, mark_us, funding): rate times reference price of the events due at each mark.

    An event is due at the first mark not before it; one at the very start waits for the first mark.
    start: (run_id, eval_start).
    """
    up = F.col("event_us") + F.pmod(-F.col("event_us"), F.lit(dur))
    mark = F.greatest(up, F.col("eval_start") + dur)
    due = events.join(start, "run_id").where("event_us >= eval_start")
    due = due.groupBy("run_id", mark.alias("mark_us")).agg(F.sum(funding_due(F.col("reference_price"), F.col("funding_rate"))).alias("funding"))
    return due.withColumn("funding", F.col("funding").cast(DUE))


def due_at(events: DataFrame, marks: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(run_id, mark_us, events, funding) of marks (run_id, mark_us) at any times: the events due at each that has some.

    An event is due at the first mark not before it, so one at a mark's own time is due there; events after the last mark are
    not due, nor are those before the run's eval_start if start (run_id, eval_start) is given. Events and marks are one
    sequence in order of time, along which the next mark is carried back. A mark given twice is one mark.
    """
    if start is not None:
        events = events.join(start, "run_id").where("event_us >= eval_start")
    due = events.select("run_id", F.col("event_us").alias("at"), funding_due(F.col("reference_price"), F.col("funding_rate")).alias("due"), F.lit(None).cast("long").alias("mark"))
    every = due.unionByName(marks.select("run_id", F.col("mark_us").alias("at"), F.lit(None).cast(DUE).alias("due"), F.col("mark_us").alias("mark")))
    back = [F.desc("at"), F.col("mark").desc_nulls_last()]  # events of a mark's time before it
    rows = scan.with_next(scan.cut(every, "at"), "run_id", back, F.col("mark"), "mark_us")
    got = rows.where("mark IS NULL AND mark_us IS NOT NULL").groupBy("run_id", "mark_us").agg(F.count("*").alias("events"), F.sum("due").alias("funding"))
    return got.withColumn("funding", F.col("funding").cast(DUE))


def replay(bars: DataFrame, target: Column, dur: int, initial: str = "1000", quantity: int = 2, cost: CostModel | None = None, funding: DataFrame | None = None, eval_from: Column | None = None, funding_model: FundingModel | None = None, lookback: int | None = LOOKBACK) -> DataFrame:
    """A row per evaluation bar with its position, fill, costs, cash, equity and realized profit.

    Targets see all bars; the ledger sees those from eval_from on. funding: as due_marks gives;
    funding_model says what a position pays of it, by default linear in the position. target looks at most
    `lookback` bars back; with None it may look at the whole run, which then is one task's work.
    """
    cost = cost or zero()
    if quantity <= 0:
        raise ValueError("quantity must be positive")
    known = target.cast("int")
    known = F.when(known.isin(*TARGETS), known).otherwise(F.raise_error(F.lit("a target must be 1, 0 or -1")).cast("int"))
    rows = bars.withColumn("mark_us", F.col("open_us") + dur)
    if funding is not None:
        rows = rows.join(funding, ["run_id", "mark_us"], "left")
    else:
        rows = rows.withColumn("funding", F.lit(None).cast(DUE))
    # what blocks hand on is computed beside what they say: bars are written aside, so that neither asks for them anew
    rows = written(rows)
    # a position is two targets' work
    rows = rows.withColumn(scan.BLOCK, F.lit(0).cast("long")).withColumn(scan.COPIED, F.lit(False)) if lookback is None else scan.blocked(rows, dur, back=lookback + 2)
    rows = rows.withColumn("target", known)
    if eval_from is not None:
        rows = rows.where(F.col("open_us") >= eval_from)
    q = F.lit(quantity)
    rows = rows.withColumn("position", q * F.coalesce(F.lag("target", 1).over(in_run()), F.lit(0))).withColumn("before", q * F.coalesce(F.lag("target", 2).over(in_run()), F.lit(0)))
    rows = rows.where(~F.col(scan.COPIED)).drop(scan.COPIED)
    rows = rows.withColumn("delta", F.col("position") - F.col("before")).withColumn("fill_price", F.when(F.col("delta") != 0, F.col("open")))
    rows = rows.withColumn("cost", F.when(F.col("delta") != 0, cost(F.abs("delta"), F.col("open"))).otherwise(F.lit(0).cast(MONEY)))
    rows = rows.withColumn("funding_cost", (funding_model or linear)(F.col("position"), F.coalesce("funding", F.lit(0).cast(DUE))).cast(MONEY))
    rows = rows.withColumn("_paid", added(F.col("delta") * F.col("open"), F.col("cost"), F.col("funding_cost")))
    none = F.lit(0).cast(MONEY)
    rows = rows.withColumn("_sum", F.sum("_paid").over(until(0))).withColumn("_last", F.last("fill_price", True).over(until(0))).withColumn("_prior", F.last("fill_price", True).over(until(-1)))
    rows = scan.with_earlier(rows, "run_id", "open_us", _before=("sum", F.col("_paid")), _fill=("last", F.col("fill_price")))
    paid = added(F.coalesce("_before", none), F.col("_sum"))
    rows = rows.withColumn("cash", (F.lit(initial).cast(MONEY) - paid).cast(MONEY))
    rows = rows.withColumn("equity", added(F.col("cash"), F.col("position") * F.col("close")))
    rows = rows.withColumn("entry", F.when(F.col("position") != 0, F.coalesce("_last", "_fill")))
    gain = (F.col("before") * (F.col("open") - F.coalesce("_prior", "_fill"))).cast(MONEY)
    rows = rows.withColumn("realized", F.when((F.col("delta") != 0) & (F.col("before") != 0), gain).otherwise(none))
    rows = rows.drop("_paid", "_sum", "_last", "_prior", "_before", "_fill")
    return rows.withColumn("trades", trades(F.col("before"), F.col("position")))


def trades(before: Column, after: Column) -> Column:
    """0 without a change, 1 for an opening or a closing, 2 for a reversal; a resize on one side fails."""
    resize = F.raise_error(F.lit("a position may not be resized")).cast("int")
    return F.when(before == after, 0).when((before == 0) | (after == 0), 1).when(F.signum(before) == -F.signum(after), 2).otherwise(resize)


def summary(ledger: DataFrame, initial: str = "1000", more: Sequence[Column] = ()) -> DataFrame:
    """One row per run: end state, profits, costs, counts, and whether the books balance; with `more` aggregates."""
    last = lambda c: F.max_by(c, "open_us")
    unrealized = F.when(F.col("position") == 0, F.lit(0).cast(MONEY)).otherwise((F.col("position") * (F.col("close") - F.col("entry"))).cast(MONEY))
    out = ledger.groupBy("run_id").agg(
        last("cash").alias("final_cash"),
        last("equity").alias("final_equity"),
        last("position").cast("long").alias("final_position"),
        F.sum("realized").cast(MONEY).alias("realized"),
        last(unrealized).alias("unrealized"),
        F.sum(added(F.col("cost"), F.col("funding_cost"))).cast(MONEY).alias("total_cost"),
        F.count_if(F.col("delta") != 0).alias("fills"),
        F.sum("trades").cast("long").alias("trades"),
        F.count("*").alias("bars"),
        *more,
    )
    total = (F.col("final_equity") - F.lit(initial).cast(MONEY)).cast(MONEY)
    return out.withColumn("balanced", total == added(F.col("realized"), F.col("unrealized"), -F.col("total_cost")))


def reconciled(summaries: DataFrame) -> DataFrame:
    """summaries without `balanced`; one that does not balance fails the query."""
    bad = F.raise_error(F.concat(F.lit("the books of a run do not balance: "), F.col("run_id"))).cast("string")
    return summaries.withColumn("run_id", F.when(F.col("balanced"), F.col("run_id")).otherwise(bad)).drop("balanced")
