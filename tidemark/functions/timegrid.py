"""Scalar functions on the epoch grid of microseconds, as columns and, for arguments, in Python."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DataCorruptionError

#: Timeframes and their microseconds (fixed values).
DURATIONS = {"1h": 3_600_000_000, "4h": 14_400_000_000}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def duration_us(timeframe: str) -> int:
    if timeframe not in DURATIONS:
        raise ValueError(f"timeframe {timeframe!r} is not one of {sorted(DURATIONS)}")
    return DURATIONS[timeframe]


def duration_column(timeframe: Column) -> Column:
    """Microseconds of a timeframe column; an unknown one fails the query."""
    out = F.raise_error(F.concat(F.lit("unknown timeframe: "), F.coalesce(timeframe, F.lit("null")))).cast("long")
    for name, us in DURATIONS.items():
        out = F.when(timeframe == name, F.lit(us)).otherwise(out)
    return out


def to_us(at: datetime) -> int:
    """Epoch microseconds of an aware datetime, by integer arithmetic."""
    if at.tzinfo is None or at.utcoffset() is None:
        raise ValueError("a time zone is needed")
    return (at - _EPOCH) // timedelta(microseconds=1)


def from_us(us: int) -> datetime:
    """The instant of stored microseconds; out of the calendar's range they are corrupt."""
    if isinstance(us, bool) or not isinstance(us, int):
        raise TypeError("microseconds must be an int")
    try:
        return _EPOCH + timedelta(microseconds=us)
    except OverflowError as e:
        raise DataCorruptionError(f"{us} microseconds are out of range") from e


def instant_of(us: Column) -> Column:
    """The TIMESTAMP of epoch microseconds; out of the calendar's years 1 to 9999 they are corrupt and fail the query."""
    low, high = to_us(datetime.min.replace(tzinfo=UTC)), to_us(datetime.max.replace(tzinfo=UTC))
    bad = F.raise_error(F.concat(F.lit("DataCorruptionError: microseconds out of range: "), us.cast("string"))).cast("timestamp")
    return F.when(us.isNull() | us.between(low, high), F.timestamp_micros(us)).otherwise(bad)


def evaluation_fault(at: Column, start: Column, end: Column, dur: int) -> Column:
    """What is wrong with where an evaluation is to start: off the grid or outside [start, end); null if nothing, or if it is null."""
    return F.when(F.pmod(at, F.lit(dur)) != 0, "grid").when((at < start) | (at >= end), "range")


def us_of(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ read as UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def floor_to(us: Column, dur: int) -> Column:
    return us - F.pmod(us, F.lit(dur))


def is_grid_aligned(us: Column, dur: int) -> Column:
    return F.pmod(us, F.lit(dur)) == 0


def availability(open_us: Column, dur: int) -> Column:
    """When a bar's features are available: at its end."""
    return open_us + F.lit(dur)


def is_available(open_us: Column, dur: int, as_of: Column) -> Column:
    return as_of >= availability(open_us, dur)


def effective_end(requested_end: Column, as_of: Column, dur: int) -> Column:
    """The requested end, or the last closed boundary if that is earlier."""
    return F.least(requested_end, floor_to(as_of, dur))


def excluded_tail(requested_end: Column, end: Column, dur: int) -> Column:
    return _div(requested_end - end - F.pmod(requested_end - end, F.lit(dur)), dur)


def excluded_tail_of(requested_end: int, end: int, dur: int) -> int:
    """excluded_tail of arguments, which must be on the grid and in order."""
    if requested_end % dur or end % dur:
        raise ValueError("both ends must be aligned to the grid")
    if end > requested_end:
        raise ValueError("the effective end must not be after the requested one")
    return (requested_end - end) // dur


def _div(a: Column, b: int) -> Column:
    """Whole division of a multiple of b, without doubles."""
    return F.call_function("div", a, F.lit(b))


def transport_start_ms(us: Column) -> Column:
    return _div(us - F.pmod(us, F.lit(1000)), 1000)


def transport_end_ms(us: Column) -> Column:
    return _div(us + F.pmod(-us, F.lit(1000)), 1000)


def transport_start(us: int) -> int:
    return us // 1000


def transport_end(us: int) -> int:
    return -(-us // 1000)


def exact_ms(us: Column) -> Column:
    """Milliseconds, null for a time before the epoch or within a millisecond."""
    return F.when((us >= 0) & (F.pmod(us, F.lit(1000)) == 0), _div(us, 1000))


def in_range(us: Column, start: Column | int, end: Column | int) -> Column:
    """Half-open membership."""
    return (us >= start) & (us < end)


def close_boundary_ok(open_us: Column, close_ms: Column, dur: int) -> Column:
    return (close_ms + 1) * 1000 == open_us + dur


def is_finalized(open_us: Column, close_ms: Column, dur: int, as_of: Column) -> Column:
    """Whether a bar with a right closing time is final at as_of."""
    return close_boundary_ok(open_us, close_ms, dur) & (as_of >= (close_ms + 1) * 1000)


def check_clamp(start_us: int, requested_end_us: int, as_of_us: int, dur: int) -> int:
    """The effective end of a requested range, for arguments."""
    if start_us >= requested_end_us:
        raise ValueError("start must be before end")
    if start_us % dur or requested_end_us % dur:
        raise ValueError("the range must be aligned to the grid")
    end = min(requested_end_us, as_of_us - as_of_us % dur)
    if end <= start_us:
        raise ValueError("nothing in the range is final yet")
    return end
