"""Rolling evaluation: all windows of all runs in one job, in place of a loop over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import ledger, scan
from .costs import MONEY, CostModel


def rolling_windows(bars: DataFrame, dur: int, length: int, step: int, context: int = 0) -> DataFrame:
    """(run, window_idx, ctx_us, start_us, end_us) of windows of `length` bars every `step` bars that
    fit a run (run_id), each with `context` bars before it."""
    runs = bars.groupBy("run_id").agg(F.min("open_us").alias("lo"), (F.max("open_us") + dur).alias("hi"))
    first, room = F.col("lo") + context * dur, F.col("hi") - F.col("lo") - (context + length) * dur
    rows = runs.where(room >= 0).select(F.col("run_id").alias("run"), first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(room / (step * dur)))).alias("window_idx"))
    start = F.col("first") + F.col("window_idx") * step * dur
    return rows.select("run", "window_idx", (start - context * dur).alias("ctx_us"), start.alias("start_us"), (start + length * dur).alias("end_us"))


def window_bars(bars: DataFrame, windows: DataFrame, dur: int) -> DataFrame:
    """The bars of each window, context included, by an equi-join on the slots of the windows.

    run_id becomes run and window; eval_start is where the window's evaluation begins.
    """
    slots = windows.select("run", "window_idx", F.col("start_us").alias("eval_start"), F.explode(F.sequence("ctx_us", F.col("end_us") - dur, F.lit(dur))).alias("open_us"))
    both = bars.withColumnRenamed("run_id", "run").join(slots, ["run", "open_us"])
    return both.withColumn("run_id", F.concat_ws("#", "run", F.col("window_idx").cast("string")))


def evaluated(bars: DataFrame, windows: DataFrame, target: Column, dur: int, initial: str = "1000", quantity: int = 2, cost: CostModel | None = None, lookback: int = ledger.LOOKBACK) -> DataFrame:
    """(run, window_idx, final_equity, fills, trades, bars, total_return, max_drawdown) of windows of runs.

    A run is replayed once. A window begins flat and may see less than the run does, so its first bars, until its
    targets and two positions are the run's own, are replayed for themselves; from then on its equity is the run's and
    a constant. What is moved is therefore each bar a few times and each window once for every block that
    it spans, however long windows are and however much they overlap. A block's bars lie in arrays and are
    read where they are: for a window's fills and trades and its greatest equity there, and then, with the peak
    before the block, for its drawdown.
    """
    own, head = lookback + 2, F.col("start_us") + (lookback + 2) * dur
    first = windows.withColumn("ctx_us", F.greatest("ctx_us", F.col("start_us") - lookback * dur)).withColumn("end_us", F.least("end_us", head))
    rows = window_bars(bars, first, dur)
    began = ledger.replay(rows, target, dur, initial, quantity, cost, eval_from=F.col("eval_start"), lookback=own)
    equity, start = lambda c: c.cast("double"), float(initial)
    top = F.greatest(F.lit(start), F.max(equity(F.col("equity"))).over(Window.partitionBy("run_id").orderBy("open_us")))  # a few bars each
    began = began.withColumn("_top", top).withColumn("_drop", (F.col("_top") - equity(F.col("equity"))) / F.col("_top"))
    began = began.groupBy("run", "window_idx").agg(
        F.max_by("cash", "open_us").alias("cash"),
        F.max_by("equity", "open_us").alias("equity"),
        F.max("_top").alias("top"),
        F.max("_drop").alias("drop"),
        F.count_if(F.col("delta") != 0).alias("fills"),
        F.sum("trades").cast("long").alias("trades"),
        F.count("*").alias("bars"),
    )
    began = written(began)
    whole = ledger.replay(bars, target, dur, initial, quantity, cost, lookback=lookback)
    bar = F.struct("open_us", "cash", "equity", (F.col("delta") != 0).cast("int").alias("fill"), "trades")
    blocks = whole.groupBy(F.col("run_id").alias("run"), scan.BLOCK).agg(F.array_sort(F.collect_list(bar)).alias("in_block"))  # SLOTS bars at most
    blocks = written(blocks)
    spans = windows.where(F.col("end_us") > head).select("run", "window_idx", head.alias("from_us"), "end_us")
    # the run's cash before the window goes its own way, against the window's
    edge = spans.withColumn(scan.BLOCK, scan.slot_block(F.col("from_us") - dur, dur)).join(blocks, ["run", scan.BLOCK])
    before = F.get(F.filter("in_block", lambda b: b["open_us"] == F.col("from_us") - dur), F.lit(0))["cash"]
    apart = edge.select("run", "window_idx", "from_us", "end_us", before.alias("run_cash")).join(began.select("run", "window_idx", "cash"), ["run", "window_idx"])
    apart = apart.withColumn("apart", (F.col("cash") - F.col("run_cash")).cast(MONEY)).drop("cash", "run_cash")
    pieces = apart.withColumn(scan.BLOCK, F.explode(F.sequence(scan.slot_block(F.col("from_us"), dur), scan.slot_block(F.col("end_us") - dur, dur))))
    here = F.filter("in_block", lambda b: (b["open_us"] >= F.col("from_us")) & (b["open_us"] < F.col("end_us")))
    at = lambda b: equity((b["equity"] + F.col("apart")).cast(MONEY))
    read = pieces.join(blocks, ["run", scan.BLOCK]).withColumn("in_block", here)
    # one look gives what adds up and the block's own peak, a second the drawdown from the peak that came before
    tops = read.select("run", "window_idx", scan.BLOCK, "apart", F.array_max(F.transform("in_block", at)).alias("top"))
    so_far = Window.partitionBy("run", "window_idx").orderBy(scan.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("peak", F.max("top").over(so_far)).join(began.select("run", "window_idx", F.col("top").alias("head_top")), ["run", "window_idx"])
    tops = tops.select("run", "window_idx", scan.BLOCK, F.greatest("peak", "head_top").alias("peak"))
    read = read.join(tops, ["run", "window_idx", scan.BLOCK])

    def deeper(acc: Column, b: Column) -> Column:
        peak = F.greatest(acc["peak"], at(b))
        return F.struct(peak.alias("peak"), F.greatest(acc["drop"], (peak - at(b)) / peak).alias("drop"))

    drop = F.aggregate("in_block", F.struct(F.col("peak").alias("peak"), F.lit(0.0).alias("drop")), deeper)["drop"]
    last = F.element_at("in_block", -1)
    went = read.groupBy("run", "window_idx").agg(
        F.max(drop).alias("drop"),
        F.max_by((last["equity"] + F.col("apart")).cast(MONEY), scan.BLOCK).alias("equity"),
        F.sum(F.aggregate("in_block", F.lit(0), lambda a, b: a + b["fill"])).alias("fills"),
        F.sum(F.aggregate("in_block", F.lit(0), lambda a, b: a + b["trades"])).alias("trades"),
        F.sum(F.size("in_block")).cast("long").alias("bars"),
    )
    both = began.alias("a").join(went.alias("b"), ["run", "window_idx"], "left")
    total = lambda c: (F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0))).cast("long").alias(c)
    final = F.coalesce("b.equity", "a.equity")
    return both.select("run", "window_idx", final.alias("final_equity"), total("fills"), total("trades"), total("bars"), (equity(final) / start - 1).alias("total_return"), F.greatest("a.drop", "b.drop").alias("max_drawdown"))


def split_fault(is_start: Column, is_end: Column, oos_start: Column, oos_end: Column, dur: int) -> Column:
    """What is wrong with an in-sample and an out-of-sample range: grid, empty or order; null if nothing is."""
    off = F.lit(False)
    for c in (is_start, is_end, oos_start, oos_end):
        off = off | (F.pmod(c, F.lit(dur)) != 0)
    return F.when(off, "grid").when((is_start >= is_end) | (oos_start >= oos_end), "empty").when(is_end > oos_start, "order")


def check_split(in_sample: tuple[int, int], out_of_sample: tuple[int, int], dur: int) -> None:
    """Raises ValueError unless both ranges are on the grid, not empty, and in order."""
    for start, end in (in_sample, out_of_sample):
        if start >= end or start % dur or end % dur:
            raise ValueError("a range must be on the grid and not empty")
    if in_sample[1] > out_of_sample[0]:
        raise ValueError("the in-sample range must end before the other starts")
