"""Backtests over stores: the quality gates, the checks of arguments and data, the replay, and windows of it.

Arguments are checked before anything is read, bars before funding is read. A gate's figures are observed
while the bars that it is about are written aside; only if it passes are those replayed, so a store is read
once and what was gated is what is replayed. The forms for many runs take ranges as a table and are one job for all of
them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.timegrid import check_clamp, duration_us, excluded_tail_of
from ..operators import ledger, quality, rolling, scan
from ..operators.costs import CostModel, FundingModel, zero
from ..operators.policy import accepted, with_targets
from ..sources.store import FundingStore, KeyedStore, check_range
from .scratch import written


@dataclass(frozen=True)
class Market:
    """The partition of a store that a backtest is about."""

    exchange: str
    market_type: str
    symbol: str

    def __post_init__(self) -> None:
        if not all(isinstance(x, str) and x.strip() for x in (self.exchange, self.market_type, self.symbol)):
            raise ValueError("names must not be blank")

    @property
    def ids(self) -> dict[str, str]:
        return {"exchange": self.exchange, "market_type": self.market_type, "symbol": self.symbol}


@dataclass(frozen=True)
class Range:
    """What is asked for: [start_us, end_us) as known at as_of_us."""

    start_us: int
    end_us: int
    as_of_us: int


@dataclass(frozen=True)
class Account:
    initial: str = "1000"
    quantity: int = 2


def _one_range(store: KeyedStore | FundingStore, market: Market, start_us: int, end_us: int) -> DataFrame:
    return store.spark.createDataFrame([(market.symbol, start_us, end_us)], "symbol string, start_us long, end_us long")


def store_report(store: KeyedStore, market: Market, timeframe: str, asked: Range) -> DataFrame:
    """quality.report of a store's bars up to the effective end, with that end and the tail it leaves out."""
    dur = duration_us(timeframe)
    end = check_clamp(asked.start_us, asked.end_us, asked.as_of_us, dur)
    span = _one_range(store, market, asked.start_us, end)
    bars = store.query(asked.start_us, end, **market.ids, timeframe=timeframe).select("symbol", "open_us")
    got = quality.report(quality.in_order(bars, span), span, dur)
    return got.withColumn("effective_end", F.lit(end)).withColumn("excluded_tail", F.lit(excluded_tail_of(asked.end_us, end, dur)).cast("long"))


def gated(rows: DataFrame, market: Market, start_us: int, end_us: int, dur: int) -> tuple[DataFrame, dict[str, Any]]:
    """(rows written aside, the figures of quality.report for one range), both from one pass over rows.

    A bar out of range or repeated fails the pass. Figures are gathered as tasks end; should one have run
    twice, they do not fit what was written and are counted again from that.
    """
    span = rows.sparkSession.createDataFrame([(market.symbol, start_us, end_us)], "symbol string, start_us long, end_us long")
    seen = Observation()
    figures = (F.count(F.lit(1)).alias("actual"), F.count_if(F.pmod("open_us", F.lit(dur)) != 0).alias("unaligned"), F.min("open_us").alias("first_us"), F.max("open_us").alias("last_us"))
    aside = written(quality.in_order(rows, span).observe(seen, *figures))
    got = seen.get
    if got["actual"] != aside.count():
        got = aside.agg(*figures).first().asDict()
    expected = (end_us - start_us) // dur
    got |= {"symbol": market.symbol, "expected": expected, "missing": expected - got["actual"] + got["unaligned"]}
    return aside, got | {"status": "FAIL" if got["missing"] or got["unaligned"] or not got["actual"] else "PASS"}


def dataset(store: KeyedStore, market: Market, timeframe: str, asked: Range) -> DataFrame:
    """The bars of a range as one run (run_id), if the gate passes; ValueError if not.

    Bars that pass are the whole grid up to the last closed slot: they ascend, adjoin each other and are available.
    """
    dur = duration_us(timeframe)
    end = check_clamp(asked.start_us, asked.end_us, asked.as_of_us, dur)
    rows = store.scanned(asked.start_us, end, **market.ids, timeframe=timeframe)
    bars, gate = gated(rows.select("symbol", "open_us", "open", "high", "low", "close", "volume"), market, asked.start_us, end, dur)
    if gate["status"] != "PASS":
        raise ValueError(f"the quality gate failed: {gate}")
    return bars.withColumn("run_id", F.lit(market.symbol))


def check_bars(bars: DataFrame, dur: int, as_of_us: int) -> None:
    """Raises ValueError unless bars are one symbol's, adjoin each other and are available at as_of_us."""
    faults = quality.order_faults(bars, dur).limit(2).collect()
    if len(faults) != 1:
        raise ValueError("the bars of one symbol are needed")
    if faults[0].not_ascending or faults[0].gaps:
        raise ValueError("bars must ascend and adjoin each other")
    if bars.agg(F.max("open_us")).first()[0] + dur > as_of_us:
        raise ValueError("a bar is not available yet")


def check_funding_arguments(required: bool, store: FundingStore | None, model: FundingModel | None) -> None:
    """Funding comes with a store and a model or with neither."""
    if not isinstance(required, bool):
        raise TypeError("funding_required must be a bool")
    if required and (store is None or model is None):
        raise ValueError("funding needs a store and a model")
    if not required and (store is not None or model is not None):
        raise ValueError("without funding there is no store and no model")


def check_evaluation(at_us: int | None, start_us: int, end_us: int, dur: int) -> int:
    """Where evaluation starts: at_us on the grid within [start_us, end_us), by default at the start."""
    if at_us is None:
        return start_us
    if at_us % dur:
        raise ValueError("the evaluation's start must be aligned to the grid")
    if not start_us <= at_us < end_us:
        raise ValueError("the evaluation must start in the range")
    return at_us


def store_funding_report(store: FundingStore, market: Market, start_us: int, end_us: int) -> DataFrame:
    """quality.funding_report of a store's events and coverage in [start_us, end_us)."""
    check_range(start_us, end_us)
    span = _one_range(store, market, start_us, end_us)
    events = store.query_events(**market.ids, start_us=start_us, end_us=end_us)
    return quality.funding_report(events, store.query_coverage(**market.ids, start_us=start_us, end_us=end_us), span)


def funding_events(store: FundingStore, market: Market, start_us: int, end_us: int) -> DataFrame:
    """The events of a range that is covered without a gap, written aside; ValueError if it is not covered."""
    gaps = _gap_count(store, market, start_us, end_us)
    if gaps:
        raise ValueError(f"the funding gate failed: {gaps} gaps in the coverage of {market}")
    seen = Observation()
    rows = _with_faults(store.events.scanned(start_us, end_us, **market.ids), market, start_us, end_us)
    aside = written(rows.observe(seen, F.count_if("outside").alias("outside"), F.count_if("repeated").alias("repeated")).drop("outside", "repeated"))
    _raise_for(seen.get)
    return aside


def _gap_count(store: FundingStore, market: Market, start_us: int, end_us: int) -> int:
    check_range(start_us, end_us)
    return quality.coverage_gaps(store.query_coverage(**market.ids, start_us=start_us, end_us=end_us), _one_range(store, market, start_us, end_us)).count()


def _with_faults(events: DataFrame, market: Market, start_us: int, end_us: int) -> DataFrame:
    """events with `outside` and `repeated`; those of one key are in one block."""
    own = (F.col("exchange") == market.exchange) & (F.col("market_type") == market.market_type) & (F.col("symbol") == market.symbol)
    key = F.struct("event_us", "rate_type")
    rows = scan.blocked(events, quality.DAY // scan.SLOTS, "event_us").withColumn("_key", key)
    rows = rows.withColumn("repeated", F.coalesce(F.lag("_key").over(scan.within("symbol", "_key")) == F.col("_key"), F.lit(False)))
    return rows.withColumn("outside", ~(own & (F.col("event_us") >= start_us) & (F.col("event_us") < end_us))).drop("_key", scan.BLOCK)


def _raise_for(found: dict[str, int]) -> None:
    if found["outside"]:
        raise ValueError("an event is outside the partition or the range")
    if found["repeated"]:
        raise ValueError("an event's key occurs twice")
    if found.get("backward"):
        raise ValueError("events must ascend by time and rate type")


def check_events(events: DataFrame, market: Market, start_us: int, end_us: int, pos: str | None = None) -> None:
    """Raises ValueError unless events are the market's, in the range, and single by (time, rate type); with pos, also
    unless they ascend by that key in the order of pos, the one in which they came."""
    found = _with_faults(events, market, start_us, end_us).agg(F.count_if("outside").alias("outside"), F.count_if("repeated").alias("repeated")).first().asDict()
    if pos:
        found["backward"] = quality.event_faults(events, pos).agg(F.coalesce(F.sum("backward"), F.lit(0))).first()[0]
    _raise_for(found)


def run_from_store(store: KeyedStore, market: Market, timeframe: str, asked: Range, policy: Column | Callable[[], Any], account: Account = Account(), cost: CostModel | None = None, funding_required: bool = False, funding_store: FundingStore | None = None, funding_model: FundingModel | None = None, evaluation_start_us: int | None = None) -> DataFrame:  # noqa: B008
    """ledger.replay of a store's gated bars. policy: a column over a run's bars, or a factory of objects."""
    dur = duration_us(timeframe)
    check_funding_arguments(funding_required, funding_store, funding_model)
    check_evaluation(evaluation_start_us, asked.start_us, asked.end_us, dur)
    bars = dataset(store, market, timeframe, asked)
    end = check_clamp(asked.start_us, asked.end_us, asked.as_of_us, dur)
    start = check_evaluation(evaluation_start_us, asked.start_us, end, dur)
    due = None
    if funding_required:
        events = funding_events(funding_store, market, start, end).withColumn("run_id", F.lit(market.symbol))
        due = ledger.due_marks(events, dur, store.spark.createDataFrame([(market.symbol, start)], "run_id string, eval_start long"))
    if not isinstance(policy, Column):
        bars, policy = with_targets(bars, policy, dur, "_target"), F.col("_target")
    return ledger.replay(bars, policy, dur, account.initial, account.quantity, cost or zero(), due, F.lit(start), funding_model)


def placed(rows: DataFrame, ranges: DataFrame, time: str, dur: int) -> DataFrame:
    """rows once for each range (run_id, symbol, start_us, end_us) that their time is in, with its run_id."""
    points = rows.withColumn("s", F.col(time)).withColumn("e", F.col(time) + 1)
    spans = ranges.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), "run_id")
    return scan.overlaps(points, spans, "symbol", scan.SLOTS * dur).drop("s", "e", "lo", "hi")


def _by_run(df: DataFrame) -> DataFrame:
    """df with the run in place of the symbol, as the gates group by."""
    return df.drop("symbol").withColumnRenamed("run_id", "symbol")


def _all_pass(gate: DataFrame, what: str) -> None:
    bad = gate.where("status <> 'PASS'").orderBy("symbol").limit(1).collect()
    if bad:
        raise ValueError(f"the {what} failed: {bad[0].asDict()}")


def _span(ranges: DataFrame) -> tuple[int, int] | None:
    """From the first start to the last end of ranges, or None for no range."""
    low, high = ranges.agg(F.min("start_us"), F.max("end_us")).first()
    return None if low is None else (low, high)


def runs_from_store(store: KeyedStore, exchange: str, market_type: str, timeframe: str, ranges: DataFrame) -> DataFrame:
    """The bars of all ranges (run_id, symbol, start_us, end_us), gated and written aside: `dataset` for many runs.

    Ranges are on the grid, and closed by then. One whose gate fails fails all: ValueError.
    """
    dur, span = duration_us(timeframe), _span(ranges)
    kept = ["run_id", "symbol", "open_us", "open", "high", "low", "close", "volume"]
    if span is None:
        raise ValueError("there are no ranges")
    rows = placed(store.scanned(*span, exchange=exchange, market_type=market_type, timeframe=timeframe), ranges, "open_us", dur).select(*kept)
    runs = _by_run(ranges)
    name = F.col("symbol").alias("name")
    rows = rows.select(name, F.col("run_id").alias("symbol"), *kept[2:])
    aside = written(quality.in_order(rows, runs))
    _all_pass(quality.report(aside.select("symbol", "open_us"), runs, dur), "quality gate")
    return aside.select(F.col("symbol").alias("run_id"), F.col("name").alias("symbol"), *kept[2:])


def run_all_from_store(store: KeyedStore, exchange: str, market_type: str, timeframe: str, ranges: DataFrame, policy: Column, account: Account = Account(), cost: CostModel | None = None, funding_store: FundingStore | None = None, funding_model: FundingModel | None = None, lookback: int | None = ledger.LOOKBACK) -> DataFrame:  # noqa: B008
    """run_from_store for all ranges (run_id, symbol, start_us, end_us, evaluation_start_us) in one job."""
    check_funding_arguments(funding_store is not None, funding_store, funding_model)
    dur = duration_us(timeframe)
    wrong = (F.pmod("evaluation_start_us", F.lit(dur)) != 0) | (F.col("evaluation_start_us") < F.col("start_us")) | (F.col("evaluation_start_us") >= F.col("end_us"))
    if not ranges.where(wrong).isEmpty():
        raise ValueError("an evaluation must start in its range, aligned to the grid")
    bars = runs_from_store(store, exchange, market_type, timeframe, ranges)
    starts = ranges.select("run_id", F.col("evaluation_start_us").alias("eval_start"))
    due = None
    if funding_store is not None:
        paid = ranges.select("run_id", "symbol", F.col("evaluation_start_us").alias("start_us"), "end_us")
        span, ids = _span(paid), {"exchange": exchange, "market_type": market_type}
        events = written(placed(funding_store.events.scanned(*span, **ids), paid, "event_us", dur).select("run_id", "symbol", "event_us", "rate_type", "funding_rate", "reference_price"))
        known = placed_intervals(funding_store.coverage_of(*span, **ids), paid, dur)
        _all_pass(quality.funding_report(_by_run(events), known, _by_run(paid)), "funding gate")
        due = ledger.due_marks(events.drop("symbol"), dur, starts)
    return ledger.replay(bars.join(starts, "run_id"), policy, dur, account.initial, account.quantity, cost or zero(), due, F.col("eval_start"), funding_model, lookback)


def placed_intervals(intervals: DataFrame, ranges: DataFrame, dur: int) -> DataFrame:
    """(symbol, start_us, end_us): the runs' parts of intervals, by run in place of the symbol."""
    cut = intervals.select("symbol", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    spans = ranges.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), "run_id")
    return scan.overlaps(cut, spans, "symbol", scan.SLOTS * dur).select(F.col("run_id").alias("symbol"), F.greatest("s", "lo").alias("start_us"), F.least("e", "hi").alias("end_us"))


def rolling_all_from_store(store: KeyedStore, exchange: str, market_type: str, timeframe: str, windows: DataFrame, policy: Column, account: Account = Account(), cost: CostModel | None = None, lookback: int = ledger.LOOKBACK) -> DataFrame:  # noqa: B008
    """rolling.evaluated for windows (symbol, window_idx, ctx_us, start_us, end_us) of all symbols, in one job.

    The gate of a window passes if its bars adjoin from its context to its end; one that does not fails all:
    ValueError. Bars are read once, whatever windows share. Gives symbol in place of a run; of no windows nothing.
    """
    dur = duration_us(timeframe)
    wrong = ~((F.col("ctx_us") <= F.col("start_us")) & (F.col("start_us") < F.col("end_us"))) | F.greatest(*[F.pmod(c, F.lit(dur)) for c in ("ctx_us", "start_us", "end_us")]).cast("boolean")
    if not windows.where(wrong).isEmpty():
        raise ValueError("a window must have its context, start and end in order, on the grid")
    span = _span(windows.select(F.col("ctx_us").alias("start_us"), "end_us"))
    if span is None:
        kinds = "window_idx long, final_equity decimal(37,18), fills long, trades long, bars long, total_return double, max_drawdown double, symbol string"
        return store.spark.createDataFrame([], kinds)
    rows = store.scanned(*span, exchange=exchange, market_type=market_type, timeframe=timeframe).select("symbol", "open_us", "open", "high", "low", "close", "volume")
    bars = written(quality.islands(rows, dur))
    runs = bars.groupBy("run_id", "symbol").agg(F.min("open_us").alias("start_us"), (F.max("open_us") + dur).alias("end_us"))
    found = placed(windows.withColumnRenamed("start_us", "begin_us").withColumnRenamed("end_us", "close_us"), runs.where(F.pmod("start_us", F.lit(dur)) == 0), "ctx_us", dur)
    found = found.join(runs.select("run_id", F.col("end_us").alias("run_end")), "run_id").where("close_us <= run_end")
    found = written(found.select(F.col("run_id").alias("run"), "symbol", "window_idx", "ctx_us", F.col("begin_us").alias("start_us"), F.col("close_us").alias("end_us")))
    lost = windows.join(found, ["symbol", "window_idx"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"the quality gate of a window failed: {lost[0].asDict()}")
    done = rolling.evaluated(bars, found.drop("symbol"), policy, dur, account.initial, account.quantity, cost, lookback)
    return done.join(found.select("run", "symbol", "window_idx"), ["run", "window_idx"]).drop("run")


def rolling_from_store(store: KeyedStore, market: Market, timeframe: str, windows: list[tuple[int, int, int]], as_of_us: int, factory: Callable[[], Any], **how: Any) -> list[DataFrame]:
    """run_from_store for each window (context start, start, end), in order, each with a policy of its own.

    factory gives a column or an object; a factory that gives an object twice, or a window whose gate
    fails, ends it, and nothing is returned. rolling.window_bars does all windows of gated runs in one job.
    """
    for w in windows:
        if len(w) != 3 or not w[0] <= w[1] < w[2]:
            raise ValueError(f"a window must have its context, start and end in order: {w}")
    if not callable(factory):
        raise TypeError("a policy factory must be callable")
    out, used = [], []
    for context, start, end in windows:
        policy = factory()
        given = policy if isinstance(policy, Column) else (lambda got=accepted(policy, used): got)
        done = run_from_store(store, market, timeframe, Range(context, end, as_of_us), given, evaluation_start_us=start, **how)
        out.append(ledger.reconciled(ledger.summary(done, how.get("account", Account()).initial)))
    return out
