"""Requests to a public market-data service: arguments, addresses, one page, and a reader of many.

The transport is a function (url, timeout) -> bytes, so pages come from the network or from
anything else. Failures to reach it are ConnectionError, bad arguments and bad replies ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.timegrid import duration_us
from .paging import PAGE, funding_history, with_retry

Transport = Callable[[str, float], bytes]
#: Addresses of the service (fixed values).
KLINES = "https://api.binance.com/api/v3/klines"
FUNDING_RATES = "https://fapi.binance.com/fapi/v1/fundingRate"


def over_http(url: str, timeout: float) -> bytes:
    try:
        with urlopen(url, timeout=timeout) as reply:  # noqa: S310
            return reply.read()
    except (URLError, OSError) as e:
        raise ConnectionError(f"{url}: {e}") from e


def _whole(name: str, value: object, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int")
    if least is not None and value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def _checked(symbol: str, limit: int, timeout: float, start_ms: int | None, end_ms: int | None) -> None:
    if not 1 <= _whole("limit", limit) <= PAGE:
        raise ValueError(f"limit must be from 1 to {PAGE}")
    if timeout <= 0:
        raise ValueError("timeout must be positive")
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("start must not be after end")


def kline_url(symbol: str, timeframe: str, limit: int, start_ms: int | None = None, end_ms: int | None = None, base: str = KLINES) -> str:
    bounds = {k: v for k, v in (("startTime", start_ms), ("endTime", end_ms)) if v is not None}
    return f"{base}?{urlencode({'symbol': symbol, 'interval': timeframe, 'limit': limit} | bounds)}"


def funding_url(symbol: str, start_ms: int, end_ms: int, limit: int, base: str = FUNDING_RATES) -> str:
    return f"{base}?{urlencode({'symbol': symbol, 'startTime': start_ms, 'endTime': end_ms, 'limit': limit})}"


def request_fault(symbol: Column, timeframe: Column, limit: Column, start_ms: Column, end_ms: Column) -> Column:
    """What kline_page would raise for a table of requests, in its order: names, limit, bounds; null for nothing."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(symbol) | empty(timeframe), "name").when(~limit.between(1, PAGE), "limit").when(start_ms > end_ms, "bounds")


def request_url(symbol: Column, timeframe: Column, limit: Column, start_ms: Column, end_ms: Column, base: str = KLINES) -> Column:
    """kline_url of columns: bounds that are null are left out."""
    coded = lambda name, c: F.concat(F.lit(f"{name}="), F.url_encode(c.cast("string")))
    parts = zip(("symbol", "interval", "limit", "startTime", "endTime"), (symbol, timeframe, limit, start_ms, end_ms), strict=True)
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *[coded(name, c) for name, c in parts]))


def _rows(url: str, timeout: float, transport: Transport) -> list:
    try:
        got = json.loads(transport(url, timeout))
    except ValueError as e:
        raise ValueError(f"the reply is not JSON: {e}") from e
    if not isinstance(got, list):
        raise ValueError("the reply must be a JSON list")
    return got


def kline_page(symbol: str, timeframe: str, limit: int = 1, timeout: float = 10.0, *, start_ms: int | None = None, end_ms: int | None = None, base: str = KLINES, transport: Transport = over_http) -> list:
    """Raw rows of one request; without bounds the most recent ones."""
    if not symbol or not timeframe:
        raise ValueError("symbol and timeframe must not be empty")
    for name, value in (("start_ms", start_ms), ("end_ms", end_ms)):
        if value is not None:
            _whole(name, value)
    _checked(symbol, limit, timeout, start_ms, end_ms)
    return _rows(kline_url(symbol, timeframe, limit, start_ms, end_ms, base), timeout, transport)


def funding_page(symbol: str, start_ms: int, end_ms: int, limit: int = PAGE, timeout: float = 10.0, *, base: str = FUNDING_RATES, transport: Transport = over_http) -> list:
    """Raw records of one request; both bounds are included."""
    if not symbol.strip():
        raise ValueError("symbol must not be blank")
    _whole("start_ms", start_ms, 0), _whole("end_ms", end_ms, 0)
    _checked(symbol, limit, timeout, start_ms, end_ms)
    return _rows(funding_url(symbol, start_ms, end_ms, limit, base), timeout, transport)


def _needed(options: dict, *names: str) -> list[str]:
    if not all(options.get(k) for k in names):
        raise ValueError(f"needed: {', '.join(names)}")
    return [options[k] for k in names]


class _Pages(DataSourceReader):
    """Pages of symbols over [start_ms, end_ms), each a partition asked for on its own, with bounded retries.

    Filters on the symbol and on the time that are equalities, lists or bounds say which pages are needed; Spark
    applies them to the rows of those pages again, as a page may have more than is asked for.
    """

    #: Column of the time.
    time = ""

    def __init__(self, symbols: str, start_ms: int, end_ms: int, width: int, base: str, timeout: float):
        if start_ms >= end_ms:
            raise ValueError("start must be before end")
        self.symbols = [x.strip() for x in symbols.split(",") if x.strip()]
        if not self.symbols:
            raise ValueError("a symbol is needed")
        self.origin = self.start_ms = start_ms
        self.end_ms, self.width, self.base, self.timeout = end_ms, width, base, timeout

    def pushFilters(self, filters):
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "symbol" and isinstance(f, (EqualTo, In)):
                self.symbols = [x for x in self.symbols if x in ([value] if isinstance(f, EqualTo) else value)]
            elif name == self.time and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self._from(value + isinstance(f, GreaterThan))
            if name == self.time and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.end_ms = min(self.end_ms, value + (not isinstance(f, LessThan)))
            yield f

    def _from(self, ms: int) -> None:
        """No page before the one with ms; pages and their numbers stay what they are."""
        self.start_ms += max(0, (ms - self.start_ms) // self.width) * self.width

    def partitions(self):
        cuts = range(self.start_ms, self.end_ms, self.width)
        return [_Range(s, (at - self.origin) // self.width, at, min(at + self.width, self.end_ms)) for s in self.symbols for at in cuts] or [_Range(None, 0, 0, 0)]


class _Range(InputPartition):
    def __init__(self, symbol: str | None, number: int, start_ms: int, end_ms: int):
        self.symbol, self.number, self.start_ms, self.end_ms = symbol, number, start_ms, end_ms


class MarketKlines(DataSource):
    """Raw klines of a range: spark.read.format("market_klines").options(symbol=, timeframe=, start_ms=, end_ms=).

    symbol may name several, with commas. The grid says which bars a page of the range can hold, so pages are
    partitions that are asked for independently. `base` is the service's address. Filters prune pages where
    spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "market_klines"

    def schema(self) -> str:
        return "symbol string, open_ms bigint, page_no int, pos int, raw string"

    def reader(self, schema) -> DataSourceReader:
        symbol, timeframe, start_ms, end_ms = _needed(self.options, "symbol", "timeframe", "start_ms", "end_ms")
        return _KlineReader(symbol, timeframe, int(start_ms), int(end_ms), self.options.get("base", KLINES), float(self.options.get("timeout", "10")))


class _KlineReader(_Pages):
    time = "open_ms"

    def __init__(self, symbols: str, timeframe: str, start_ms: int, end_ms: int, base: str, timeout: float):
        super().__init__(symbols, start_ms, end_ms, PAGE * (duration_us(timeframe) // 1000), base, timeout)
        self.timeframe = timeframe

    def read(self, partition):
        p = partition
        if p.symbol is None:
            return
        rows = with_retry(lambda: kline_page(p.symbol, self.timeframe, PAGE, self.timeout, start_ms=p.start_ms, end_ms=p.end_ms - 1, base=self.base))
        for k, r in enumerate(rows):
            yield p.symbol, int(r[0]), p.number, k, json.dumps(r)


class MarketFunding(DataSource):
    """Raw funding records of a range: spark.read.format("market_funding").options(symbol=, start_ms=, end_ms=).

    Records are at no grid, so a partition is a stretch of `hours` (1000 by default) that is read from page to page
    until one is not full; records of one time that two pages have come once.
    """

    @classmethod
    def name(cls) -> str:
        return "market_funding"

    def schema(self) -> str:
        return "symbol string, event_ms bigint, page_no int, pos int, raw string"

    def reader(self, schema) -> DataSourceReader:
        symbol, start_ms, end_ms = _needed(self.options, "symbol", "start_ms", "end_ms")
        return _FundingReader(symbol, int(start_ms), int(end_ms), int(self.options.get("hours", "1000")), self.options.get("base", FUNDING_RATES), float(self.options.get("timeout", "10")))


class _FundingReader(_Pages):
    time = "event_ms"

    def __init__(self, symbols: str, start_ms: int, end_ms: int, hours: int, base: str, timeout: float):
        super().__init__(symbols, start_ms, end_ms, _whole("hours", hours, 1) * 3_600_000, base, timeout)

    def read(self, partition):
        p = partition
        if p.symbol is None:
            return
        key = lambda r: (int(r["fundingTime"]), r["rateType"])
        rows = funding_history(lambda a, b: funding_page(p.symbol, a, b, PAGE, self.timeout, base=self.base), p.start_ms, p.end_ms - 1, key, lambda r: (r["fundingRate"], r["markPrice"]))
        for k, r in enumerate(rows):
            yield p.symbol, int(r["fundingTime"]), p.number, k, json.dumps(r)
