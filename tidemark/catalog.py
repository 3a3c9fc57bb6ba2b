"""The engine's registered queries and their SQL counterparts.

Each query derives its bars, events or intervals from the tables it is given. The SQL computes
the same with integers of 1e-8, so both sides are exact before they become doubles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import timegrid as g
from .functions import wide
from .operators import costs, exact, ledger, metrics, policy, quality, rolling
from .plans import backtest, ingest, views
from .plans.scratch import scratch, written
from .sources import paging, parse, requests, store

H1, H4 = g.DURATIONS["1h"], g.DURATIONS["4h"]
#: Length, step and context of rolling windows, in bars.
LENGTH, STEP, CONTEXT = 30, 10, 5
AS_OF = 1_706_000_000_000_000
COST = costs.composite(costs.commission("0.001"), costs.half_spread("0.0005"), costs.slippage("0.001"))


def _round(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name)


def _bars(spark: SparkSession, sf: str, timeframe: str = "4h") -> DataFrame:
    return views.candles(spark, sf, timeframe)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.islands(_bars(spark, sf), H4)


def _ledger(spark: SparkSession, sf: str, funded: bool = False) -> DataFrame:
    bars = _runs(spark, sf)
    due = None
    if funded:
        starts = bars.groupBy("run_id", "symbol").agg(F.min("open_us").alias("eval_start"), (F.max("open_us") + H4).alias("run_end"))
        # an event belongs to the run of its symbol that spans it: by the bar it falls in
        slots = bars.select("run_id", "symbol", F.col("open_us").alias("slot"))
        events = views.funding(spark, sf).withColumn("slot", g.floor_to(F.col("event_us"), H4)).join(slots, ["symbol", "slot"])
        due = ledger.due_marks(events.drop("symbol"), H4, starts.select("run_id", "eval_start"))
    return ledger.replay(bars, ledger.momentum(), H4, cost=COST, funding=due)


def _candles(timeframe: str):
    def query(spark, sf):
        return _bars(spark, sf, timeframe).select("symbol", "open_us", *[_round(c, c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"))

    return query


def grid_alignment(spark, sf):
    us = F.col("ts_us")
    return views.events(spark, sf).select("event_id", g.is_grid_aligned(us, H1).alias("aligned"), g.floor_to(us, H1).alias("slot_us"))


def availability(spark, sf):
    open_us = F.col("open_us")
    return _bars(spark, sf).select("symbol", "open_us", g.availability(open_us, H4).alias("available_us"), g.is_available(open_us, H4, F.lit(AS_OF)).alias("available"))


def effective_end_clamp(spark, sf):
    last = views.events(spark, sf).groupBy("symbol").agg(F.max("ts_us").alias("as_of_us"))
    end = g.floor_to(F.col("as_of_us"), H1) + 5 * H1
    rows = last.withColumn("requested_end", end).withColumn("effective_end", g.effective_end(end, F.col("as_of_us"), H1))
    return rows.withColumn("excluded", g.excluded_tail(F.col("requested_end"), F.col("effective_end"), H1))


def finalized_filter(spark, sf):
    rows = _bars(spark, sf, "1h").withColumn("close_ms", ((F.col("open_us") + H1) / 1000 - 1).cast("long"))
    return rows.where(g.is_finalized(F.col("open_us"), F.col("close_ms"), H1, F.lit(AS_OF))).select("symbol", "open_us", "close_ms")


def missing_slots(spark, sf):
    bars = _bars(spark, sf, "1h")
    return quality.missing_slots(bars, views.ranges(bars, H1), H1).select("symbol", "open_us")


def quality_report(spark, sf):
    parts = []
    for name, dur in (("1h", H1), ("4h", H4)):
        bars = _bars(spark, sf, name)
        parts.append(quality.report(bars, views.ranges(bars, dur), dur).withColumn("timeframe", F.lit(name)))
    return parts[0].unionByName(parts[1])


def quality_samples(spark, sf):
    bars = _bars(spark, sf, "1h")
    return quality.missing_samples(bars, views.ranges(bars, H1), H1)


def range_scan_half_open(spark, sf):
    return _bars(spark, sf, "1h").where(g.in_range(F.col("open_us"), AS_OF - AS_OF % H1 - 240 * H1, AS_OF - AS_OF % H1)).select("symbol", "open_us", _round("close", "close"))


def event_scan_tie_order(spark, sf):
    order = Window.partitionBy("symbol", "event_us").orderBy("rate_type")
    return views.funding(spark, sf).select("symbol", "event_us", "rate_type", _round("funding_rate", "funding_rate"), F.row_number().over(order).cast("long").alias("tie"))


def coverage_overlap(spark, sf):
    bars = _bars(spark, sf)
    got = quality.clipped(views.coverage(spark, sf), views.ranges(bars, H4))
    return got.groupBy("symbol").agg(F.count("*").alias("intervals"), F.sum(F.col("e") - F.col("s")).alias("covered_us"), F.min("s").alias("first_us"), F.max("e").alias("last_us"))


def coverage_gaps(spark, sf):
    return quality.coverage_gaps(views.coverage(spark, sf), views.ranges(_bars(spark, sf), H4)).drop("lo", "hi")


def range_overlaps(spark, sf):
    """Coverage in very many overlapping ranges of each symbol: six hours from each hour on that has a bar."""
    spans = _bars(spark, sf, "1h").select("symbol", F.col("open_us").alias("start_us"), (F.col("open_us") + 6 * H1).alias("end_us"))
    got = quality.clipped(views.coverage(spark, sf), spans)
    return got.groupBy("symbol", F.col("lo").alias("start_us")).agg(F.count("*").alias("intervals"), F.sum(F.col("e") - F.col("s")).alias("covered_us"))


def range_gaps(spark, sf):
    """What is not covered in each of those ranges."""
    spans = _bars(spark, sf, "1h").select("symbol", F.col("open_us").alias("start_us"), (F.col("open_us") + 6 * H1).alias("end_us"))
    return quality.coverage_gaps(views.coverage(spark, sf), spans).select("symbol", F.col("lo").alias("start_us"), "gap_start", "gap_end")


def funding_marks(spark, sf):
    """Funding due at marks off any grid, some of them at the very time of events."""
    events = views.funding(spark, sf).withColumnRenamed("symbol", "run_id")
    marks = views.events(spark, sf).where("event_id % 7 < 2").select(F.col("symbol").alias("run_id"), (F.col("ts_us") + F.when(F.col("event_id") % 7 == 1, 1234567).otherwise(0)).alias("mark_us"))
    got = ledger.due_at(events, marks)
    return got.select(F.col("run_id").alias("symbol"), "mark_us", "events", _round("funding", "funding"))


def full_report(spark, sf):
    """All that reports say of bars some of which are late, asked for beyond what was closed by then."""
    spans = views.ranges(_bars(spark, sf, "1h"), H1)
    asked = spans.select("symbol", "start_us", (F.col("end_us") + 5 * H1).alias("end_us"), (F.col("end_us") - 3 * H1 + 420_000_000).alias("as_of_us"))
    got = quality.full_report(_shifted(spark, sf), asked, H1, exchange=MARKET[0], market_type=MARKET[1], timeframe="1h")
    for c in ("missing_samples", "unaligned_samples"):
        got = got.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return got


def dataset_checks(spark, sf):
    """The first fault of each run as a dataset, faults of each kind planted by the run's start."""
    rows = _runs(spark, sf)
    head = F.split_part("run_id", F.lit("|"), F.lit(2)).cast("long")
    kind, at = F.pmod(F.call_function("div", head, F.lit(H4)), F.lit(5)), F.call_function("div", F.col("open_us") - head, F.lit(H4))
    ends = rows.groupBy("run_id").agg((F.max("open_us") + H4).alias("hi"))
    rows = rows.withColumn("pos", F.col("open_us")).where(~((kind == 1) & (at == 1))).join(ends, "run_id")
    rows = rows.withColumn("symbol", F.when((kind == 3) & (at == 1), "other").otherwise(F.col("symbol"))).withColumn("as_of", F.col("hi") - (kind == 4).cast("int"))
    rows = rows.withColumn("open_us", F.when((kind == 2) & (at == 1), F.col("open_us") - H4).otherwise(F.col("open_us")))
    return quality.dataset_faults(rows, H4, F.col("as_of"), "pos")


def event_input_checks(spark, sf):
    """The first fault of each run's funding events as they come, planted likewise."""
    ranges = _run_ranges(spark, sf, 1)
    rows = backtest.placed(views.funding(spark, sf), ranges, "event_us", H4).join(ranges.select("run_id", "start_us", "end_us"), "run_id")
    kind = F.pmod(F.call_function("div", F.col("start_us"), F.lit(H4)), F.lit(4))
    rows = rows.withColumn("pos", F.struct(F.when(kind == 2, -F.col("event_us")).otherwise(F.col("event_us")).alias("at"), "rate_type", F.lit(0).alias("copy")))
    rows = rows.withColumn("event_us", F.when(kind == 1, F.col("event_us") - 30 * 24 * H1).otherwise(F.col("event_us")))
    again = rows.where(kind == 3).withColumn("pos", F.struct("pos.at", "pos.rate_type", F.lit(1).alias("copy")))
    return quality.event_input_faults(rows.unionByName(again), F.col("start_us"), F.col("end_us"), "pos")


def evaluation_checks(spark, sf):
    """Starts of evaluation against runs: on and off the grid, before, in and after the range."""
    rows = _run_ranges(spark, sf, 1).withColumn("at_us", F.explode(F.array(*[F.col("start_us") + k for k in (-H4, 0, 1, H4, 30 * H4)])))
    return rows.select("run_id", "at_us", g.evaluation_fault(F.col("at_us"), F.col("start_us"), F.col("end_us"), H4).alias("fault"))


def request_checks(spark, sf):
    """Requests made of events: faults of their arguments and, for good ones, addresses."""
    k = F.col("event_id")
    start = F.when(k % 5 != 0, F.call_function("div", F.col("ts_us"), F.lit(1000)))
    rows = views.events(spark, sf).select("event_id", F.when(k % 11 == 0, "").otherwise(F.concat("symbol", F.lit("/+ "))).alias("name"), (k % 1003).alias("limit"), start.alias("start_ms"), (start + k % 7 * 1000 - 1000).alias("end_ms"))
    fault = requests.request_fault(F.col("name"), F.lit("1h"), F.col("limit"), F.col("start_ms"), F.col("end_ms"))
    url = requests.request_url(F.col("name"), F.lit("1h"), F.col("limit"), F.col("start_ms"), F.col("end_ms"), "https://host/klines")
    return rows.select("event_id", fault.alias("fault"), F.when(fault.isNull(), url).alias("url"))


def instants(spark, sf):
    """Times from microseconds and back, and numbers as plain texts without zeros at their ends."""
    at = g.instant_of(F.col("ts_us") - F.col("event_id") % 100 * 100_003 * H1)
    rows = views.events(spark, sf).withColumn("at", at)
    number = (F.col("value") * (F.col("event_id") % 5)).cast("decimal(18,8)")
    return rows.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant"), F.unix_micros("at").alias("back_us"), parse.decimal_to_text(number).alias("text"))


def crossing_backtest(spark, sf):
    """A policy that looks at all bars so far, in blocks, replayed."""
    bars = ledger.crossing(_runs(spark, sf), H4, "goal")
    rows = ledger.replay(bars, F.col("goal"), H4, cost=COST, lookback=0)
    return rows.select("run_id", "open_us", F.col("target").cast("long").alias("target"), _round("cash", "cash"), _round("equity", "equity"))


def funding_quality(spark, sf):
    return quality.funding_report(views.funding(spark, sf), views.coverage(spark, sf), views.ranges(_bars(spark, sf), H4))


def batch_classify(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"))
    old = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("p")).where("l_linenumber <= 3").select("l_orderkey", "l_linenumber", "p.*")
    got = store.classify(rows, old, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])
    return got.select("l_orderkey", "l_linenumber", "rows", "status")


def _pages(spark, sf):
    """Each event on its page of an hour, and those of an hour's last ten minutes on the next page too."""
    rows = views.events(spark, sf).withColumn("page_no", F.floor(F.col("ts_us") / H1))
    again = rows.where(F.pmod("ts_us", F.lit(H1)) >= 50 * 60_000_000).withColumn("page_no", F.col("page_no") + 1)
    return rows.unionByName(again)


def cross_page_dedup(spark, sf):
    got = paging.merged_pages(_pages(spark, sf), ["symbol", "ts_us", "user_id"], ["value"])
    return got.groupBy("symbol", "status").agg(F.count("*").alias("keys"), F.sum("pages").alias("pages"))


def page_order(spark, sf):
    return paging.page_order_faults(_pages(spark, sf), "ts_us", pos="event_id", strict=False).select(F.col("page_no").cast("long").alias("page_no"), "faults")


def order_contiguity_check(spark, sf):
    return quality.order_faults(_bars(spark, sf, "1h"), H1)


def fine_costs(spark, sf):
    """Exact totals of quantities and prices of 12 places with a rate of 10, and how many terms are above a bound."""
    rows = views.events(spark, sf)
    price = F.concat(F.col("value").cast("string"), F.lpad((F.col("event_id") * 7919 % 10**10).cast("string"), 10, "0"))
    quantity = F.concat(F.when(F.col("event_id") % 3 == 0, "-").otherwise(""), (F.col("user_id") % 97).cast("string"), F.lit("."), F.lpad((F.col("event_id") * 104729 % 10**12).cast("string"), 12, "0"))
    term = wide.Wide.of(quantity, 12) * wide.Wide.of(price, 12) * wide.Wide.constant("0.0001234567")
    rows = rows.select("symbol", term.limbs.alias("term"))
    term = wide.Wide(F.col("term"), term.count, term.scale)
    above = F.count_if(term.compared(wide.Wide.constant("0.5")) > 0).alias("above")
    return wide.summed(rows, ["symbol"], {"total": term}, F.count("*").alias("terms"), above)


def money_text(spark, sf):
    """Cash and equity in full, with prices of 8 places and a rate of 10 that make terms of 18."""
    bars = _runs(spark, sf)
    for k, c in enumerate(("open", "high", "low", "close")):
        bars = bars.withColumn(c, (F.col(c).cast("decimal(18,8)") + (F.col("open_us") / 1_000_000 % 99991 + k).cast("decimal(18,0)") * F.lit(Decimal("0.00000001"))).cast("decimal(18,8)"))
    rows = ledger.replay(bars, ledger.momentum(), H4, cost=costs.commission("0.0001234567"), lookback=1)
    return rows.select("run_id", "open_us", *[F.col(c).cast("string").alias(c) for c in ("cost", "cash", "equity")])


def positions(spark, sf):
    return _ledger(spark, sf).select("run_id", "open_us", *[F.col(c).cast("long").alias(c) for c in ("target", "position", "delta")])


def fills(spark, sf):
    return _ledger(spark, sf).where("delta != 0").select("run_id", "open_us", F.col("delta").cast("long").alias("delta"), _round("fill_price", "fill_price"), _round("cost", "cost"), F.col("trades").cast("long").alias("trades"))


def cost_components(spark, sf):
    rows = _ledger(spark, sf).where("delta != 0")
    q, p = F.abs("delta"), F.col("open")
    parts = {"commission": costs.commission("0.001"), "half_spread": costs.half_spread("0.0005"), "slippage": costs.slippage("0.001"), "total": COST}
    return rows.groupBy("run_id").agg(*[_round(F.sum(m(q, p)), n) for n, m in parts.items()])


def trade_counts(spark, sf):
    return _ledger(spark, sf).groupBy("symbol").agg(F.sum("trades").cast("long").alias("trades"), F.count_if(F.col("delta") != 0).alias("fills"))


def funding_asof(spark, sf):
    return _ledger(spark, sf, True).where("funding IS NOT NULL").select("run_id", "mark_us", F.col("position").cast("long").alias("position"), _round("funding", "funding"), _round("funding_cost", "funding_cost"))


def equity_curve(spark, sf):
    return _ledger(spark, sf, True).select("run_id", "mark_us", _round("cash", "cash"), _round("equity", "equity"))


def backtest_summary(spark, sf):
    s = ledger.summary(_ledger(spark, sf, True))
    return s.select("run_id", *[_round(c, c) for c in ("final_cash", "final_equity", "realized", "unrealized", "total_cost")], "final_position", "fills", "trades", "bars")


def pnl_reconciliation(spark, sf):
    return ledger.summary(_ledger(spark, sf, True)).select("run_id", "balanced", _round(F.col("final_equity") - 1000, "total_pnl"))


def context_evaluation(spark, sf):
    bars = _runs(spark, sf)
    bars = bars.join(bars.groupBy("run_id").agg((F.min("open_us") + CONTEXT * H4).alias("eval_start")), "run_id")
    rows = ledger.replay(bars, ledger.momentum(), H4, cost=COST, eval_from=F.col("eval_start"))
    return rows.select("run_id", "open_us", F.col("target").cast("long").alias("target"), F.col("position").cast("long").alias("position"), _round("equity", "equity"))


def periodic_returns(spark, sf):
    return metrics.periodic_returns(_ledger(spark, sf)).select("run_id", "open_us", _round("ret", "ret"), "bad_denominator")


def drawdown_curve(spark, sf):
    return metrics.drawdowns(_ledger(spark, sf)).select("run_id", "open_us", _round("peak", "peak"), _round("drawdown", "drawdown"))


def stage1_metrics(spark, sf):
    return metrics.stage1(_ledger(spark, sf)).select("run_id", _round("total_return", "total_return"), _round("max_drawdown", "max_drawdown"))


def stage2_metrics(spark, sf):
    return metrics.stage2(_ledger(spark, sf)).select("run_id", *[_round(c, c) for c in ("mean_return", "return_stdev", "sharpe_ratio")])


def is_oos_split(spark, sf):
    windows = rolling.rolling_windows(_runs(spark, sf), H4, LENGTH, STEP)
    cut = F.col("start_us") + 20 * H4
    ok = (F.pmod("start_us", F.lit(H4)) == 0) & (F.pmod("end_us", F.lit(H4)) == 0) & (cut <= F.col("end_us"))
    return windows.select("run", "window_idx", "start_us", cut.alias("cut_us"), "end_us", ok.alias("valid"))


def _rolling(context: int):
    def query(spark, sf):
        bars = _runs(spark, sf)
        got = rolling.evaluated(bars, rolling.rolling_windows(bars, H4, LENGTH, STEP, context), ledger.momentum(), H4, cost=COST, lookback=1)
        return got.select(F.concat_ws("#", "run", F.col("window_idx").cast("string")).alias("run_id"), _round("final_equity", "final_equity"), "fills", "trades", "bars", _round("total_return", "total_return"), _round("max_drawdown", "max_drawdown"))

    return query


def transport_bounds(spark, sf):
    us = F.col("ts_us") + F.pmod("event_id", F.lit(3))
    return views.events(spark, sf).select("event_id", g.transport_start_ms(us).alias("start_ms"), g.transport_end_ms(us).alias("end_ms"), g.exact_ms(us).alias("exact_ms"))


def kline_parse(spark, sf):
    v = F.col("value").cast("string")
    bad = F.col("event_id") % 7
    first = F.when(bad == 1, F.lit("x")).otherwise(v)
    high = F.when(bad == 2, (F.col("value") - 1).cast("string")).otherwise(v)
    ms = F.floor(F.col("ts_us") / H1) * 3_600_000
    text = F.concat(F.lit("["), ms.cast("string"), *[x for p in (first, high, v, v) for x in (F.lit(',"'), p, F.lit('"'))], F.lit(',"1.5"'), F.when(bad == 3, F.lit("]")).otherwise(F.concat(F.lit(","), (ms + 3_599_999).cast("string"), F.lit("]"))))
    got = parse.klines(views.events(spark, sf).select("event_id", text.alias("raw")))
    good = F.col("reject").isNull()
    return got.select("event_id", F.coalesce("reject", F.lit("ok")).alias("reject"), F.when(good, F.col("open_us")).alias("open_us"), F.when(good, F.round(F.col("close").cast("double"), 6)).alias("close"))


def funding_parse(spark, sf):
    bad = F.col("event_id") % 6
    ms = F.floor(F.col("ts_us") / 1000).cast("string")
    rate = F.when(bad == 1, F.lit("0.0001")).otherwise(F.lit('"0.0001"'))
    price = F.when(bad == 2, F.lit('"-1"')).otherwise(F.concat(F.lit('"'), (F.lit(100) + F.col("event_id") % 50).cast("string"), F.lit('"')))
    kind = F.when(bad == 3, F.lit("Odd")).otherwise(F.lit("Regular"))
    symbol = F.when(bad == 4, F.lit("OTHER")).otherwise(F.lit("S"))
    text = F.concat(F.lit('{"symbol":"'), symbol, F.lit('","fundingRate":'), rate, F.lit(',"fundingTime":'), ms, F.lit(',"markPrice":'), price, F.lit(',"rateType":"'), kind, F.lit('"}'))
    got = parse.funding_records(views.events(spark, sf).select("event_id", text.alias("raw")), "S")
    return got.select("event_id", F.coalesce("reject", F.lit("ok")).alias("reject"), "event_us", _round("reference_price", "reference_price"))


def kline_parse_six(spark, sf):
    """Klines without a closing time: prices of more places than are kept, and too few fields, are faults."""
    v = F.col("value").cast("string")
    bad = F.col("event_id") % 5
    ms = F.floor(F.col("ts_us") / H1) * 3_600_000
    last = F.when(bad == 1, F.lit("")).otherwise(F.lit(',"2"'))
    text = F.concat(F.lit("["), ms.cast("string"), *[x for p in (v, v, v, F.when(bad == 2, F.lit("1.123456789")).otherwise(v)) for x in (F.lit(',"'), p, F.lit('"'))], last, F.lit("]"))
    got = parse.klines(views.events(spark, sf).select("event_id", text.alias("raw")), fields=6)
    return got.select("event_id", F.coalesce("reject", F.lit("ok")).alias("reject"), F.when(F.col("reject").isNull(), F.col("open_us")).alias("open_us"), "close_ms")


def kline_close_time(spark, sf):
    """The closing time must be a JSON number: a text, a fraction and none are faults."""
    bad, ms = F.col("event_id") % 4, F.floor(F.col("ts_us") / H1) * 3_600_000
    close = F.when(bad == 0, (ms + 3_599_999).cast("string")).when(bad == 1, F.concat(F.lit('"'), (ms + 3_599_999).cast("string"), F.lit('"'))).when(bad == 2, F.lit("1.5")).otherwise(F.lit("null"))
    text = F.concat(F.lit("["), ms.cast("string"), F.lit(',"1","1","1","1","0",'), close, F.lit("]"))
    got = parse.klines(views.events(spark, sf).select("event_id", text.alias("raw")))
    return got.select("event_id", F.coalesce("reject", F.lit("ok")).alias("reject"), "close_ms")


def flat_fills(spark, sf):
    """Fills of a policy that opens, closes to flat and reverses."""
    rows = ledger.replay(_runs(spark, sf), ledger.flat_after_fall(), H4, cost=COST)
    return rows.where("delta != 0").select("run_id", "open_us", F.col("before").cast("long").alias("before"), F.col("position").cast("long").alias("position"), _round("cost", "cost"), _round("realized", "realized"), F.col("trades").cast("long").alias("trades"))


def _shifted(spark, sf):
    """Bars of 1h, some of them seven minutes late."""
    late = F.when(F.pmod(F.call_function("div", F.col("open_us"), F.lit(H1)), F.lit(11)) == 0, 420_000_000).otherwise(0)
    return _bars(spark, sf, "1h").withColumn("open_us", F.col("open_us") + late)


def unaligned_report(spark, sf):
    bars = _shifted(spark, sf)
    span = views.ranges(_bars(spark, sf, "1h"), H1)
    return quality.report(quality.in_order(bars, span), span, H1)


def unaligned_samples(spark, sf):
    return quality.unaligned_samples(_shifted(spark, sf), H1)


def gap_samples(spark, sf):
    return quality.gap_samples(views.coverage(spark, sf), views.ranges(_bars(spark, sf), H4))


def order_violations(spark, sf):
    """Slots of events in order of their id against ranges that end a day early."""
    rows = views.events(spark, sf).select("symbol", g.floor_to(F.col("ts_us"), H1).alias("open_us"), "event_id")
    span = views.ranges(rows, H1).withColumn("end_us", F.col("end_us") - 24 * H1)
    return quality.violations(rows, span, "event_id")


def backward_order_check(spark, sf):
    rows = _bars(spark, sf, "1h").withColumn("pos", F.col("open_us") - F.pmod("volume", F.lit(3)) * 5 * H1)
    return quality.order_faults(rows.withColumn("pos", F.struct("pos", "open_us")), H1, "pos")


def event_order_faults(spark, sf):
    rows = views.funding(spark, sf).withColumn("pos", F.struct(F.call_function("div", F.col("event_us"), F.lit(H4)), "funding_rate", "reference_price", "event_us", "rate_type"))
    return quality.event_faults(rows, "pos")


def page_disorder(spark, sf):
    pages = _pages(spark, sf).withColumn("pos", F.struct(F.pmod(F.col("event_id") * 7919, F.lit(101)), "event_id"))
    return paging.page_order_faults(pages, "ts_us", pos="pos").select(F.col("page_no").cast("long").alias("page_no"), "faults")


def effective_ends(spark, sf):
    """Ends asked for from three hours before to five after each event, as known at it."""
    rows = views.events(spark, sf).select("event_id", F.col("ts_us").alias("as_of_us"), (g.floor_to(F.col("ts_us"), H1) + (F.col("event_id") % 9 - 3) * H1).alias("requested_end"))
    end = g.effective_end(F.col("requested_end"), F.col("as_of_us"), H1)
    return rows.withColumn("effective_end", end).withColumn("excluded", g.excluded_tail(F.col("requested_end"), end, H1))


def split_checks(spark, sf):
    """In-sample and out-of-sample ranges of windows, some off the grid, empty or overlapping."""
    k = F.pmod("window_idx", F.lit(5))
    rows = rolling.rolling_windows(_runs(spark, sf), H4, LENGTH, STEP).select("run", "window_idx", F.col("start_us").alias("is_start"), (F.col("start_us") + 20 * H4 + F.when(k == 1, 1).when(k == 2, 5 * H4).otherwise(0)).alias("is_end"), (F.col("start_us") + F.when(k == 3, 30).otherwise(22) * F.lit(H4)).alias("oos_start"), F.col("end_us").alias("oos_end"))
    return rows.withColumn("fault", rolling.split_fault(F.col("is_start"), F.col("is_end"), F.col("oos_start"), F.col("oos_end"), H4))


def _solvent(spark, sf):
    return ledger.replay(_runs(spark, sf), ledger.flat_after_fall(), H4, initial="9973", quantity=1, cost=COST)


def _metrics():
    """The metrics rounded; a zero below zero is a zero."""
    return [(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in ("total_return", "max_drawdown", "mean_return", "return_stdev", "sharpe_ratio")]


def solvent_metrics(spark, sf):
    """Both stages in doubles over curves that stay positive."""
    done = _solvent(spark, sf)
    both = metrics.stage1(done, 9_973.0).join(metrics.stage2(done, 9_973.0), "run_id")
    return both.select("run_id", *_metrics())


def exact_metrics(spark, sf):
    """The same in decimals of 28 digits, with the fault where a run has no second stage."""
    got = exact.metrics(_solvent(spark, sf), "9973", strict=False)
    return got.select("run_id", *_metrics(), "fault")


def exact_digits(spark, sf):
    """Total return, mean return and drawdown in all their 28 digits."""
    got = exact.metrics(_solvent(spark, sf), "9973", strict=False).where("fault IS NULL")
    return got.select("run_id", *[F.col(c).cast("decimal(38,38)").cast("string").alias(c) for c in ("total_return", "mean_return", "max_drawdown")])


def metric_faults(spark, sf):
    """The first fault of each run's curve, faults of each kind planted by the run's start."""
    curve = _solvent(spark, sf).select("run_id", "open_us", F.col("equity").cast("decimal(28,2)").cast("string").alias("equity"))
    head = F.split_part("run_id", F.lit("|"), F.lit(2)).cast("long")
    kind, at = F.pmod(F.call_function("div", head, F.lit(H4)), F.lit(6)), F.call_function("div", F.col("open_us") - head, F.lit(H4))
    value = F.when((kind == 1) & (at == 2), "NaN").when((kind == 2) & at.isin(1, 3), F.concat(F.lit("-"), "equity")).when((kind == 3) & (at == 3), "none").when((kind == 3) & (at == 1), "0").when(kind == 4, "9973").otherwise(F.col("equity"))
    curve = curve.withColumn("equity", value).withColumn("open_us", F.when((kind == 5) & (at == 4), F.col("open_us") - H4).otherwise(F.col("open_us")))
    return exact.metrics(curve, "9973", strict=False).select("run_id", "fault")


def policy_targets(spark, sf):
    """Targets of a Python policy that is asked bar by bar."""
    bars = _runs(spark, sf).select("run_id", "open_us", F.col("close").cast("double").alias("close"))
    return policy.with_targets(bars, policy.Crossing, H4).select("run_id", "open_us", F.col("target").cast("long").alias("target"))


def python_cost(spark, sf):
    """Costs of a Python function in place of a column."""
    rows = ledger.replay(_runs(spark, sf), ledger.momentum(), H4, cost=costs.by_function(lambda quantity, price: quantity * price / 400))
    return rows.where("delta != 0").select("run_id", "open_us", _round("cost", "cost"))


MARKET = ("binance", "spot")


def _candle_rows(bars, timeframe):
    ids = [F.lit(x).alias(c) for c, x in zip(("exchange", "market_type"), MARKET, strict=True)]
    return bars.select(*ids, "symbol", F.lit(timeframe).alias("timeframe"), "open_us", *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("open", "high", "low", "close", "volume")])


def _kept_candles(spark, sf, timeframe="4h"):
    """A store of all bars, written in two batches that overlap."""
    rows = _candle_rows(_bars(spark, sf, timeframe), timeframe)
    kept = store.candle_store(spark, scratch(spark))
    kept.write(rows.where(F.col("open_us") < AS_OF))
    kept.write(rows.where(F.col("open_us") >= AS_OF - 24 * H4))
    return kept


def _kept_funding(spark, sf):
    """A store of all events and, as coverage, each symbol's range in two halves."""
    ids = [F.lit(x).alias(c) for c, x in zip(("exchange", "market_type"), MARKET, strict=True)]
    rows = views.funding(spark, sf).select(*ids, "symbol", "event_us", "rate_type", F.col("funding_rate").cast("decimal(18,10)").alias("funding_rate"), F.col("reference_price").cast("decimal(18,8)").alias("reference_price"))
    spans = views.ranges(_bars(spark, sf), H4)
    middle = F.col("start_us") + F.call_function("div", F.col("end_us") - F.col("start_us"), F.lit(2))
    halves = [spans.select(*ids, "symbol", F.col("start_us"), middle.alias("end_us")), spans.select(*ids, "symbol", middle.alias("start_us"), "end_us")]
    kept = store.FundingStore(spark, scratch(spark))
    for half in halves:
        own = half.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
        kept.write_many(rows.join(own, "symbol").where("event_us >= lo AND event_us < hi").select(*rows.columns), half)
    return kept


def _run_ranges(spark, sf, least):
    """(run_id, symbol, start_us, end_us) of runs of 4h bars of at least so many."""
    runs = _runs(spark, sf).groupBy("run_id", "symbol").agg(F.min("open_us").alias("start_us"), (F.max("open_us") + H4).alias("end_us"))
    return runs.where(F.col("end_us") - F.col("start_us") >= least * H4)


def store_range_query(spark, sf):
    """Bars written to a store in two overlapping batches, read by range."""
    kept = _kept_candles(spark, sf, "1h")
    return kept.query(AS_OF - AS_OF % H1 - 240 * H1, AS_OF - AS_OF % H1, exchange="binance", market_type="spot", timeframe="1h").select("symbol", "open_us", _round("close", "close"))


def store_events(spark, sf):
    """Funding events and coverage of all symbols, written in two batches and read in the middle of their time."""
    low, high = views.ranges(_bars(spark, sf), H4).agg(F.min("start_us"), F.max("end_us")).first()
    kept, start, end = _kept_funding(spark, sf), low + (high - low) // 4, high - (high - low) // 4
    ids = dict(zip(("exchange", "market_type"), MARKET, strict=True))
    events = kept.events.query(start, end, **ids).groupBy("symbol").agg(F.count("*").alias("rows"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us")).withColumn("kind", F.lit("event"))
    covered = kept.coverage_of(start, end, **ids).groupBy("symbol").agg(F.count("*").alias("rows"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us")).withColumn("kind", F.lit("coverage"))
    return events.unionByName(covered)


def store_ingest(spark, sf):
    """Raw pages of all symbols' 1h bars ingested into a store up to the last closed hour, and read back."""
    bars = _bars(spark, sf, "1h")
    low, high = bars.agg(F.min("open_us"), F.max("open_us")).first()
    ms = F.call_function("div", F.col("open_us"), F.lit(1000))
    text = F.concat(F.lit("["), ms.cast("string"), *[x for c in ("open", "high", "low", "close", "volume") for x in (F.lit(',"'), F.col(c).cast("string"), F.lit('"'))], F.lit(","), (ms + 3_599_999).cast("string"), F.lit("]"))
    slot = F.call_function("div", F.col("open_us") - low, F.lit(H1))
    page = F.call_function("div", slot, F.lit(paging.PAGE))
    kept = store.candle_store(spark, scratch(spark))
    pages = bars.select("symbol", page.alias("page_no"), (slot % paging.PAGE).alias("pos"), text.alias("raw"))
    ingest.ingest_candle_pages(kept, pages, None, "1h", low, high + H1, high + H1 - 10 * H1 + 1)
    return kept.query(low, high + H1, exchange="binance", market_type="spot", timeframe="1h").select("symbol", "open_us", _round("open", "open"), _round("close", "close"), _round("volume", "volume"))


def store_quality(spark, sf):
    """The gate's report of every symbol's stored bars, from one pass that writes them aside; gaps and all."""
    spans = views.ranges(_bars(spark, sf), H4)
    low, high = spans.agg(F.min("start_us"), F.max("end_us")).first()
    rows = _kept_candles(spark, sf).scanned(low, high, exchange="binance", market_type="spot", timeframe="4h")
    return quality.report(quality.in_order(rows.select("symbol", "open_us"), spans), spans, H4)


def store_backtest(spark, sf):
    """Funded backtests of all runs from stores, in one job: gates, context of five bars, replay and summary."""
    ranges = _run_ranges(spark, sf, CONTEXT + 1).withColumn("evaluation_start_us", F.col("start_us") + CONTEXT * H4)
    ranges = written(ranges)
    done = backtest.run_all_from_store(_kept_candles(spark, sf), *MARKET, "4h", ranges, ledger.momentum(), cost=COST, funding_store=_kept_funding(spark, sf), funding_model=costs.linear, lookback=1)
    s = ledger.reconciled(ledger.summary(done))
    return s.select("run_id", *[_round(c, c) for c in ("final_cash", "final_equity", "realized", "unrealized", "total_cost")], "final_position", "fills", "trades", "bars")


def store_rolling(spark, sf):
    """Windows of all stored runs with bars of context, in one job."""
    runs = _runs(spark, sf)
    windows = rolling.rolling_windows(runs, H4, LENGTH, STEP, CONTEXT).withColumn("symbol", F.split_part("run", F.lit("|"), F.lit(1)))
    windows = windows.withColumn("window_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("start_us")).cast("long")).drop("run")
    got = backtest.rolling_all_from_store(_kept_candles(spark, sf), *MARKET, "4h", written(windows), ledger.momentum(), cost=COST, lookback=1)
    return got.select("symbol", "window_idx", _round("final_equity", "final_equity"), "fills", "trades", "bars", _round("total_return", "total_return"), _round("max_drawdown", "max_drawdown"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity over the longest run of adjoining bars."""
    bars = _runs(spark, sf_dir)
    best = bars.groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(1)
    done = ledger.replay(bars.join(F.broadcast(best.select("run_id")), "run_id"), ledger.momentum(), H4, cost=COST)
    return done.select("run_id", "mark_us", _round("equity", "equity"), F.col("position").cast("long").alias("position"))


_QUERIES = {
    "candles_1h": _candles("1h"),
    "candles_4h": _candles("4h"),
    "rolling_zero_context": _rolling(0),
    "rolling_context_aware": _rolling(CONTEXT),
} | {
    f.__name__: f
    for f in (
        grid_alignment, availability, effective_end_clamp, finalized_filter, missing_slots, quality_report, quality_samples,
        range_scan_half_open, event_scan_tie_order, coverage_overlap, coverage_gaps, funding_quality, batch_classify,
        cross_page_dedup, page_order, order_contiguity_check, positions, fills, cost_components, trade_counts, funding_asof,
        equity_curve, backtest_summary, pnl_reconciliation, context_evaluation, periodic_returns, drawdown_curve,
        stage1_metrics, stage2_metrics, is_oos_split, transport_bounds, kline_parse, funding_parse,
        kline_parse_six, kline_close_time, flat_fills, unaligned_report, unaligned_samples, gap_samples, order_violations,
        backward_order_check, event_order_faults, page_disorder, effective_ends, split_checks, solvent_metrics,
        exact_metrics, policy_targets, python_cost, store_range_query, store_events, store_ingest, store_quality,
        full_report, dataset_checks, event_input_checks, evaluation_checks, request_checks, instants, crossing_backtest,
        store_backtest, store_rolling, range_overlaps, range_gaps, funding_marks, fine_costs, money_text, exact_digits, metric_faults,
    )
}


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLES

    return dict(ORACLES)
