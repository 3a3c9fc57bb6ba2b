"""Raw exchange payloads as typed columns; rows that break a rule carry the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRICE, _WIDE = "decimal(18,8)", "decimal(38,18)"
#: Rate types known (fixed values).
RATE_TYPES = ("Regular", "Special")
#: Exchange that funding records are from (fixed value).
EXCHANGE = "binance"


def text_to_decimal(text: Column, kind: str = _PRICE) -> Column:
    """The number of a text, null where it is none, is not finite or does not fit without rounding."""
    wide, got = text.try_cast(_WIDE), text.try_cast(kind)
    return F.when(wide == got, got)


def decimal_to_text(number: Column) -> Column:
    """A decimal as plain text, without zeros at the end of its fraction."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def klines(raw: DataFrame, col: str = "raw", fields: int = 7) -> DataFrame:
    """raw with open_us, open, high, low, close, volume, close_ms and reject (null for a good row).

    col holds a JSON array: open time in ms, four prices, the volume, and, if fields is 7, the closing
    time in ms, which must be a JSON number.
    """
    rows = raw.withColumn("_p", F.from_json(col, "array<string>")).withColumn("_v", F.try_parse_json(col))
    at = lambda k: F.get("_p", F.lit(k))
    rows = rows.withColumn("open_us", at(0).try_cast("bigint") * 1000)
    for k, name in enumerate(("open", "high", "low", "close", "volume")):
        rows = rows.withColumn(name, text_to_decimal(at(k + 1)))
    whole = F.schema_of_variant(F.try_variant_get("_v", "$[6]", "variant")) == "BIGINT"
    rows = rows.withColumn("close_ms", F.when(whole, at(6).try_cast("bigint")) if fields > 6 else F.lit(None).cast("bigint"))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    number = F.lit(False)
    for c in (*prices, F.col("volume")):
        number = number | c.isNull()
    reject = (
        F.when(F.col("_p").isNull() | (F.size("_p") < fields), "fields")
        .when(F.col("open_us").isNull(), "open_time")
        .when(number, "number")
        .when(F.col("close_ms").isNull() & F.lit(fields > 6), "close_time")
        .when(F.col("volume") < 0, "volume")
        .when((F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices)), "high_low")
    )
    return rows.withColumn("reject", reject).drop("_p", "_v")


def candles(parsed: DataFrame, exchange: str, market_type: str, symbol: str | Column, timeframe: str) -> DataFrame:
    """Rows of klines() as candles with their key, the symbol a name or a column; a rejected row fails the query."""
    bad = F.raise_error(F.concat(F.lit("a kline was rejected: "), F.col("reject"))).cast("bigint")
    names = [(x if isinstance(x, Column) else F.lit(x)).alias(c) for c, x in zip(("exchange", "market_type", "symbol", "timeframe"), (exchange, market_type, symbol, timeframe), strict=True)]
    good = F.when(F.col("reject").isNull(), F.col("open_us")).otherwise(bad)
    return parsed.select(*names, good.alias("open_us"), "open", "high", "low", "close", "volume")


def funding_records(raw: DataFrame, expected_symbol: str, col: str = "raw") -> DataFrame:
    """raw with event_us, funding_rate, reference_price, rate_type and reject (null for a good row).

    Rate and price must be JSON strings and the time a JSON number, so the text is looked at too.
    """
    text = F.from_json(col, "symbol string, fundingRate string, fundingTime string, markPrice string, rateType string")
    rows = raw.withColumn("_r", text)
    quoted = lambda k: F.col(col).rlike(f'"{k}"\\s*:\\s*"')
    rate, price = text_to_decimal(F.col("_r.fundingRate"), "decimal(18,10)"), text_to_decimal(F.col("_r.markPrice"))
    ms = F.col("_r.fundingTime").try_cast("bigint")
    lacks = F.lit(False)
    for k in ("symbol", "fundingRate", "fundingTime", "markPrice", "rateType"):
        lacks = lacks | F.col(f"_r.{k}").isNull()
    reject = (
        F.when(F.col("_r").isNull() | lacks, "fields")
        .when(F.col("_r.symbol") != expected_symbol, "symbol")
        .when(~quoted("fundingRate") | rate.isNull(), "rate")
        .when(~quoted("markPrice") | price.isNull() | (price <= 0), "price")
        .when(quoted("fundingTime") | ms.isNull() | (ms < 0), "time")
        .when(~F.col("_r.rateType").isin(*RATE_TYPES), "rate_type")
    )
    rows = rows.withColumn("reject", reject)
    keep = F.col("reject").isNull()
    return rows.select(*raw.columns, F.when(keep, ms * 1000).alias("event_us"), F.when(keep, rate).alias("funding_rate"), F.when(keep, price).alias("reference_price"), F.when(keep, F.col("_r.rateType")).alias("rate_type"), "reject")


def funding_events(parsed: DataFrame, market_type: str, symbol: str) -> DataFrame:
    """Rows of funding_records() as canonical events; a rejected row fails the query."""
    bad = F.raise_error(F.concat(F.lit("a funding record was rejected: "), F.col("reject"))).cast("bigint")
    names = [F.lit(x).alias(c) for c, x in zip(("exchange", "market_type", "symbol"), (EXCHANGE, market_type, symbol), strict=True)]
    good = F.when(F.col("reject").isNull(), F.col("event_us")).otherwise(bad)
    return parsed.select(*names, good.alias("event_us"), "rate_type", "funding_rate", "reference_price")
