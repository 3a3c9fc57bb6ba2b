"""Fixed table schemas and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class DataConflictError(ValueError):
    """One key came with two different payloads."""


class DataCorruptionError(ValueError):
    """Stored data does not have the fixed schema or cannot be decoded."""


_PRICE, _RATE = T.DecimalType(18, 8), T.DecimalType(18, 10)
CANDLE_KEY = ("exchange", "market_type", "symbol", "timeframe", "open_us")
FUNDING_KEY = ("exchange", "market_type", "symbol", "event_us", "rate_type")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


CANDLES = _struct(*[(c, T.StringType()) for c in CANDLE_KEY[:4]], ("open_us", T.LongType()), *[(c, _PRICE) for c in ("open", "high", "low", "close", "volume")])
FUNDING = _struct(*[(c, T.StringType()) for c in FUNDING_KEY[:3]], ("event_us", T.LongType()), ("rate_type", T.StringType()), ("funding_rate", _RATE), ("reference_price", _PRICE))
COVERAGE = _struct(*[(c, T.StringType()) for c in FUNDING_KEY[:3]], ("start_us", T.LongType()), ("end_us", T.LongType()))


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its columns have the schema's names, types and order."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        raise DataCorruptionError(f"schema differs: {have} where {want} is fixed")
    return df
