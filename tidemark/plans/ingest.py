"""From pages of a source to a store: all of a range or nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import check_clamp, duration_us, is_finalized, transport_end, transport_start
from ..operators import scan
from ..sources import parse, requests
from ..sources.paging import funding_history, paginate
from ..sources.store import FundingStore, KeyedStore, check_range
from .scratch import written

Fetch = Callable[[int, int], list]


def _raw(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")


def ingest_candles(store: KeyedStore, symbol: str, timeframe: str, start_us: int, end_us: int, as_of_us: int, fetch: Fetch | None = None, market_type: str = "spot") -> int:
    """Writes the final bars of [start_us, end_us) in one batch and gives their number.

    fetch(start ms, end ms) gives raw rows from a cursor on, bounds included; by default the public
    service is asked. A bar in the range that is not final, or a bad row, fails it all.
    """
    dur = duration_us(timeframe)
    end = check_clamp(start_us, end_us, as_of_us, dur)
    ask = fetch or (lambda a, b: requests.kline_page(symbol, timeframe, requests.PAGE, start_ms=a, end_ms=b))
    rows = paginate(lambda a, b: ask(a, b - 1), start_us // 1000, end // 1000, lambda r: int(r[0]), dur // 1000)
    if not rows:
        return 0
    return _write_candles(store, parse.klines(_raw(store.spark, rows)), symbol, timeframe, as_of_us, market_type)


def _write_candles(store: KeyedStore, parsed: DataFrame, symbol: str | None, timeframe: str, as_of_us: int, market_type: str) -> int:
    """Writes parsed klines as one batch. They are computed once, into a scratch table; the checks and the
    batch read that, so a source is asked once and what was checked is what is written."""
    name = F.col("symbol") if symbol is None else F.lit(symbol)
    seen = Observation()
    late = F.col("reject").isNull() & ~is_finalized(F.col("open_us"), F.col("close_ms"), duration_us(timeframe), F.lit(as_of_us))
    rows = parsed.withColumn("_late", late).withColumn("symbol", name)
    rows = written(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.min("reject").alias("reject")))
    found = seen.get
    if found["reject"] is not None:
        raise ValueError(f"a kline was rejected: {found['reject']}")
    if found["late"]:
        raise ValueError("a bar in the range is not final")
    if "page_no" in rows.columns:
        check_pages(rows)
    store.write(parse.candles(rows, parse.EXCHANGE, market_type, F.col("symbol"), timeframe))
    return rows.count()


def check_pages(rows: DataFrame) -> None:
    """Raises ValueError unless bars (symbol, page_no, pos, open_us) ascend from row to row in each symbol's pages and
    from page to page, so that every page gets on and none has what another had."""
    faults = scan.counted(rows.withColumn("_pos", F.struct("page_no", "pos")), "symbol", "_pos", F.struct("page_no", "open_us"), {
        "in_page": lambda b, o: (b["page_no"] == o["page_no"]) & (b["open_us"] >= o["open_us"]),
        "over_pages": lambda b, o: (b["page_no"] != o["page_no"]) & (b["open_us"] >= o["open_us"]),
    })
    bad = faults.where("in_page > 0 OR over_pages > 0").orderBy("symbol").limit(1).collect()
    if bad:
        raise ValueError(f"{'a page is out of order' if bad[0].in_page else 'a page makes no progress'}: {bad[0].symbol}")


def ingest_candle_pages(store: KeyedStore, pages: DataFrame, symbol: str | None, timeframe: str, start_us: int, end_us: int, as_of_us: int, market_type: str = "spot") -> int:
    """ingest_candles of pages (page_no, pos, raw) that a reader has asked for independently, as DataFrames all the way.

    Without a symbol the pages have a column of that name and may be of many. What lies outside the range is dropped,
    pages without page_no have no order that could be checked.
    """
    end = check_clamp(start_us, end_us, as_of_us, duration_us(timeframe))
    parsed = parse.klines(pages)
    inside = F.col("reject").isNotNull() | ((F.col("open_us") >= start_us) & (F.col("open_us") < end))
    return _write_candles(store, parsed.where(inside), symbol, timeframe, as_of_us, market_type)


def ingest_funding(store: FundingStore, symbol: str, market_type: str, start_us: int, end_us: int, source_as_of_us: int, fetch: Fetch | None = None) -> int:
    """Writes the events of [start_us, end_us) and that it is covered, in one batch, and gives their number.

    The source must know the whole interval. fetch(start ms, end ms) gives raw records, bounds
    included; what lies outside the interval was asked for in vain and is dropped. No event is no error.
    """
    if not symbol.strip() or not market_type.strip():
        raise ValueError("names must not be blank")
    check_range(start_us, end_us)
    if source_as_of_us < end_us:
        raise ValueError("the source does not know the end of the interval yet")
    ask = fetch or (lambda a, b: requests.funding_page(symbol, a, b))
    key = lambda r: (int(r["fundingTime"]), r["rateType"])
    rows = funding_history(ask, transport_start(start_us), transport_end(end_us), key, lambda r: (r["fundingRate"], r["markPrice"]))
    events = parse.funding_events(parse.funding_records(_raw(store.spark, rows), symbol), market_type, symbol)
    events = events.where((F.col("event_us") >= start_us) & (F.col("event_us") < end_us))
    store.write(events, parse.EXCHANGE, market_type, symbol, start_us, end_us)
    return events.count()
