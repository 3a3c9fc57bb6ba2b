"""Data-quality gates: missing slots, order and contiguity, coverage of intervals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import effective_end, excluded_tail
from ..plans.scratch import written
from . import scan

#: Members that a report lists of each kind of fault.
SAMPLE = 20
#: Microseconds of a day.
DAY = 86_400_000_000


def missing_slots(bars: DataFrame, ranges: DataFrame, dur: int) -> DataFrame:
    """(symbol, open_us): slots of the ranges that no bar has; only gaps are filled in, not the grid.

    The bars are in their ranges, as in_order has them.
    """
    on_grid = bars.select("symbol", "open_us").where(F.pmod("open_us", F.lit(dur)) == 0)
    ends = ranges.select("symbol", F.explode(F.array(F.col("start_us") - dur, F.col("end_us"))).alias("open_us"))
    rows = scan.with_previous(scan.blocked(on_grid.union(ends), dur), "symbol", "open_us", F.col("open_us"), "_before")
    gap = F.sequence(F.col("_before") + dur, F.col("open_us") - dur, F.lit(dur))
    return rows.where(F.col("open_us") - F.col("_before") > dur).select("symbol", F.explode(gap).alias("open_us"))


def _within_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """bars with _lo and _hi of their symbol's range; ranges are broadcast by Spark where it finds them small."""
    return bars.join(ranges.select("symbol", F.col("start_us").alias("_lo"), F.col("end_us").alias("_hi")), "symbol", "left")


def _outside() -> Column:
    return F.col("_lo").isNull() | (F.col("open_us") < F.col("_lo")) | (F.col("open_us") >= F.col("_hi"))


def in_order(bars: DataFrame, ranges: DataFrame, message: str = "a bar is out of its range, repeated or out of order", pos: str | None = None) -> DataFrame:
    """bars (symbol, open_us), failing at one outside its symbol's range or seen twice; with pos, also at one that
    is not after the one above it by pos."""
    rows = _within_ranges(bars, ranges)
    if pos:
        rows = scan.with_previous(scan.cut(rows, pos), "symbol", pos, F.col("open_us"), "_before")
    else:  # repeated bars are in one block, of a day
        rows = scan.blocked(rows, DAY // scan.SLOTS).withColumn("_before", F.lag("open_us").over(scan.within("symbol", "open_us")))
    bad = _outside() | (F.col("_before") >= F.col("open_us"))
    open_us = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("long")).otherwise(F.col("open_us"))
    return rows.withColumn("open_us", open_us).drop("_lo", "_hi", "_before", scan.BLOCK)


def violations(bars: DataFrame, ranges: DataFrame, pos: str = "open_us") -> DataFrame:
    """(symbol, out_of_range, repeated, backward): what in_order fails at, counted in one pass."""
    tests = {"repeated": lambda b, o: b == o, "backward": lambda b, o: b > o}
    return scan.counted(_within_ranges(bars, ranges), "symbol", pos, F.col("open_us"), tests, out_of_range=_outside())


def report(bars: DataFrame, ranges: DataFrame, dur: int) -> DataFrame:
    """One row per range: counts, first and last bar, status. FAIL for a missing or unaligned bar, or none.

    The bars are those of in_order, single and in their range, so the slots that none has are those
    expected less the aligned bars: one aggregate, and no slot is made.
    """
    seen = bars.groupBy("symbol").agg(
        F.count("*").alias("actual"),
        F.count_if(F.pmod("open_us", F.lit(dur)) != 0).alias("unaligned"),
        F.min("open_us").alias("first_us"),
        F.max("open_us").alias("last_us"),
    )
    out = ranges.join(seen, "symbol", "left").na.fill(0, ["actual", "unaligned"])
    expected = F.call_function("div", F.col("end_us") - F.col("start_us"), F.lit(dur))
    out = out.withColumn("expected", expected).withColumn("missing", F.col("expected") - F.col("actual") + F.col("unaligned"))
    bad = (F.col("missing") > 0) | (F.col("unaligned") > 0) | (F.col("actual") == 0)
    return out.select("symbol", "expected", "actual", "missing", "unaligned", "first_us", "last_us", F.when(bad, "FAIL").otherwise("PASS").alias("status"))


def _first(rows: DataFrame, by: str, *cols: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(by))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= SAMPLE).select("symbol", "rank", *cols)


def unaligned_samples(bars: DataFrame, dur: int) -> DataFrame:
    """(symbol, rank, open_us): the first SAMPLE bars off the grid of each symbol."""
    return _first(bars.where(F.pmod("open_us", F.lit(dur)) != 0), "open_us", "open_us")


def gap_samples(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol, rank, gap_start, gap_end): the first SAMPLE gaps of each range's coverage."""
    return _first(coverage_gaps(intervals, ranges), "gap_start", "gap_start", "gap_end")


def missing_samples(bars: DataFrame, ranges: DataFrame, dur: int) -> DataFrame:
    """(symbol, rank, open_us): the first SAMPLE missing slots of each range."""
    return _first(missing_slots(bars, ranges, dur), "open_us", "open_us")


def order_faults(bars: DataFrame, dur: int, pos: str = "open_us") -> DataFrame:
    """One row per symbol: bars, those not after the one before by pos, those not adjoining it."""
    tests = {"not_ascending": lambda b, o: b >= o, "gaps": lambda b, o: b + dur != o}
    return scan.counted(bars, "symbol", pos, F.col("open_us"), tests, bars=F.lit(True)).select("symbol", "bars", "not_ascending", "gaps")


def islands(bars: DataFrame, dur: int) -> DataFrame:
    """bars with run_id: a name for each longest stretch of adjoining bars.

    A bar without one a slot before it is a head; a bar's head is the last one in its block, or else in an
    earlier block. Bars are written aside first, as they are read for both.
    """
    rows = scan.blocked(written(bars), dur, back=1)
    before = F.lag("open_us").over(scan.within("symbol", "open_us"))
    rows = rows.withColumn("_head", F.when(before.isNull() | (before + dur != F.col("open_us")), F.col("open_us"))).where(~F.col(scan.COPIED))
    inside = F.last("_head", True).over(scan.within("symbol", "open_us"))
    rows = scan.with_earlier(rows.withColumn("_near", inside), "symbol", "open_us", _far=("last", F.col("_head")))
    run = F.concat_ws("|", "symbol", F.coalesce("_near", "_far").cast("string"))
    return rows.withColumn("run_id", run).select(*bars.columns, "run_id")


def clipped(intervals: DataFrame, ranges: DataFrame, bin_us: int = DAY) -> DataFrame:
    """(symbol, lo, hi, s, e): intervals (symbol, start_us, end_us) cut to each of the symbol's ranges that they overlap."""
    cut = intervals.select("symbol", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    r = ranges.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    both = scan.overlaps(cut, r, "symbol", bin_us)
    return both.select("symbol", "lo", "hi", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))


def coverage_gaps(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol, lo, hi, gap_start, gap_end): the parts of each range [lo, hi) that no interval covers, in order.

    Equal starts are merged first, so a start that very many intervals share is one row. A range's
    intervals are ordered day by day; only how far each day's reach is carried along the range.
    """
    own = ["symbol", "lo", "hi"]
    cut = clipped(intervals, ranges).groupBy(*own, "s").agg(F.max("e").alias("e"))
    ends = ranges.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), F.col("end_us").alias("s"), F.col("end_us").alias("e"))
    rows = cut.unionByName(ends).withColumn("day", F.floor(F.col("s") / DAY))
    along = Window.partitionBy(*own).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*own, "day").agg(F.max("e").alias("top")).withColumn("carried", F.max("top").over(along)).drop("top")
    before = Window.partitionBy(*own, "day").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("carried"), F.max("e").over(before))
    rows = rows.join(days, [*own, "day"]).withColumn("reach", F.coalesce(reach, F.col("lo")))
    return rows.where("s > reach").select(*own, F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))


def event_faults(events: DataFrame, pos: str) -> DataFrame:
    """(symbol, events, backward, repeated): events whose (time, rate type) is before, or equals, that above them by pos."""
    tests = {"backward": lambda b, o: b > o, "repeated": lambda b, o: b == o}
    return scan.counted(events, "symbol", pos, F.struct("event_us", "rate_type"), tests, events=F.lit(True)).select("symbol", "events", "backward", "repeated")


def funding_report(events: DataFrame, intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per range: events in it, gaps in its coverage, status. No event is no fault."""
    own = ["symbol", "start_us", "end_us"]
    gaps = coverage_gaps(intervals, ranges).groupBy("symbol", F.col("lo").alias("start_us"), F.col("hi").alias("end_us"))
    gaps = gaps.agg(F.count("*").alias("gap_count"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("gap_us"))
    points = events.select("symbol", F.col("event_us").alias("s"), (F.col("event_us") + 1).alias("e"))
    spans = ranges.select("symbol", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    inside = scan.overlaps(points, spans, "symbol", DAY).groupBy("symbol", F.col("lo").alias("start_us"), F.col("hi").alias("end_us")).agg(F.count("*").alias("event_count"))
    out = ranges.join(inside, own, "left").join(gaps, own, "left").na.fill(0, ["event_count", "gap_count", "gap_us"])
    return out.select("symbol", "event_count", "gap_count", "gap_us", F.when(F.col("gap_count") > 0, "FAIL").otherwise("PASS").alias("status"))


def full_report(bars: DataFrame, asked: DataFrame, dur: int, **ids: str) -> DataFrame:
    """One row per range that was asked for, with all that a report says: what was asked, the end that counts, counts, and
    the first SAMPLE members of each kind of fault, in order.

    asked: (symbol, start_us, end_us, as_of_us); a range counts to the last slot closed at as_of_us. ids become columns.
    """
    spans = asked.withColumn("effective_end", effective_end(F.col("end_us"), F.col("as_of_us"), dur))
    ranges = spans.select("symbol", "start_us", F.col("effective_end").alias("end_us"))
    inside = _within_ranges(bars, ranges).where(~_outside()).drop("_lo", "_hi")
    listed = lambda rows, name: rows.groupBy("symbol").agg(F.array_sort(F.collect_list("open_us")).alias(name))  # noqa: E731  SAMPLE at most
    samples = listed(missing_samples(inside, ranges, dur), "missing_samples").join(listed(unaligned_samples(inside, dur), "unaligned_samples"), "symbol", "full")
    out = spans.join(report(inside, ranges, dur), "symbol").join(samples, "symbol", "left")
    none = F.array().cast("array<bigint>")
    return out.select(
        *[F.lit(x).alias(name) for name, x in ids.items()],
        "symbol", F.col("start_us").alias("requested_start"), F.col("end_us").alias("requested_end"), "as_of_us", "effective_end",
        "first_us", "last_us", "expected", "actual", "missing", F.coalesce("missing_samples", none).alias("missing_samples"), "unaligned",
        F.coalesce("unaligned_samples", none).alias("unaligned_samples"), excluded_tail(F.col("end_us"), F.col("effective_end"), dur).alias("excluded_tail"), "status",
    )


def _first_fault(counts: DataFrame, key: str, *names: str) -> DataFrame:
    """(key, fault): the first of names that a run has any of, null for none."""
    fault = F.when(F.col(names[0]) > 0, names[0])
    for name in names[1:]:
        fault = fault.when(F.col(name) > 0, name)
    return counts.select(key, fault.alias("fault"))


def dataset_faults(bars: DataFrame, dur: int, as_of: Column, pos: str = "open_us") -> DataFrame:
    """(run_id, fault) of bars (run_id, symbol, open_us): what makes a run no dataset, the first that holds of: another
    symbol than before, a time that does not ascend by pos or does not adjoin, a bar not available at as_of."""
    tests = {
        "symbol": lambda b, o: b.isNotNull() & ~b["symbol"].eqNullSafe(o["symbol"]),
        "ascending": lambda b, o: b["open_us"] >= o["open_us"],
        "adjoining": lambda b, o: b["open_us"] + dur != o["open_us"],
    }
    found = scan.counted(bars, "run_id", pos, F.struct("open_us", "symbol"), tests, available=F.col("open_us") + dur > as_of)
    return _first_fault(found, "run_id", "symbol", "ascending", "adjoining", "available")


def event_input_faults(events: DataFrame, start: Column, end: Column, pos: str) -> DataFrame:
    """(run_id, fault) of events (run_id, event_us, rate_type) as they come by pos: the first that holds of: outside
    [start, end), before the one above it by time and rate type, a key that the one above has."""
    tests = {"order": lambda b, o: b > o, "repeated": lambda b, o: b == o}
    outside = (F.col("event_us") < start) | (F.col("event_us") >= end)
    found = scan.counted(events, "run_id", pos, F.struct("event_us", "rate_type"), tests, outside=outside)
    return _first_fault(found, "run_id", "outside", "order", "repeated")
