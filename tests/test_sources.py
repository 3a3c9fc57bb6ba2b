"""Stores, pages, parsers and the grid."""

import json
from datetime import UTC, datetime
from decimal import Decimal as D

import pytest

from tidemark.functions import timegrid as g
from tidemark.operators import quality, rolling
from tidemark.schemas import CANDLES, FUNDING, DataConflictError, DataCorruptionError
from tidemark.sources import paging, parse, store


def candle(k, close="1"):
    return ("x", "spot", "S", "1h", k, *(D(v) for v in ("1", "2", "0.5", close, "3")))


def test_store_is_idempotent_and_all_or_nothing(spark, tmp_path):
    s = store.candle_store(spark, str(tmp_path / "c"))
    frame = lambda rows: spark.createDataFrame(rows, CANDLES)
    assert s.read().count() == 0
    s.write(frame([candle(1), candle(2), candle(2, "1.00")]))
    s.write(frame([candle(2), candle(3)]))
    s.write(frame([]))
    assert sorted(r.open_us for r in s.read().collect()) == [1, 2, 3]
    for bad in ([candle(4), candle(3, "1.5")], [candle(5), candle(5, "1.5")]):
        with pytest.raises(DataConflictError):
            s.write(frame(bad))
    assert s.read().count() == 3
    with pytest.raises(DataCorruptionError):
        s.write(frame([candle(9)]).withColumnRenamed("open", "o"))


def test_funding_store_writes_coverage_without_events(spark, tmp_path):
    s = store.FundingStore(spark, str(tmp_path / "f"))
    none = spark.createDataFrame([], FUNDING)
    s.write(none, "x", "perp", "S", 0, 10)
    s.write(none, "x", "perp", "S", 0, 10)
    assert (s.events.read().count(), s.coverage.read().count()) == (0, 1)
    row = spark.createDataFrame([("x", "perp", "S", 12, "Regular", D("0.1"), D("5"))], FUNDING)
    with pytest.raises(ValueError):
        s.write(row, "x", "perp", "S", 0, 10)
    s.write(row, "x", "perp", "S", 10, 20)
    assert (s.events.read().count(), s.coverage.read().count()) == (1, 2)


def test_retry_and_pages(monkeypatch):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 7

    assert paging.with_retry(flaky) == 7
    with pytest.raises(ConnectionError):
        paging.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()))
    rows = [[t] for t in range(0, 10)]
    got = paging.paginate(lambda a, b: [r for r in rows if r[0] >= a][:3], 2, 8, lambda r: r[0], 1)
    assert [r[0] for r in got] == list(range(2, 8))
    monkeypatch.setattr(paging, "PAGE", 3)
    ties = [[1, "a"], [1, "b"], [2, "a"], [3, "a"]]
    key, payload = (lambda r: (r[0], r[1])), (lambda r: r[2:])
    assert paging.funding_history(lambda a, b: [r for r in ties if r[0] >= a][:3], 0, 9, key, payload) == ties
    for page in ([[1, "a"], [1, "a"]], [[2, "a"], [1, "a"]], [[99, "a"]], [[1, "a"]] * 4):
        with pytest.raises(ValueError):
            paging.funding_history(lambda a, b, page=page: page, 0, 9, key, payload)
    pages = iter([[[1, "a", 1], [2, "a", 1], [3, "a", 1]], [[3, "a", 2], [4, "a", 1]]])
    with pytest.raises(ValueError, match="two payloads"):
        paging.funding_history(lambda a, b: next(pages), 0, 9, key, payload)
    pages = iter([[[1, "a", 1], [1, "b", 1], [1, "c", 1]]] * 2)
    with pytest.raises(ValueError, match="progress"):
        paging.funding_history(lambda a, b: next(pages), 0, 9, key, payload)
    for bad in ((9, 9), (9, 3)):
        with pytest.raises(ValueError):
            paging.paginate(lambda a, b: [], *bad, lambda r: r[0], 1)
    with pytest.raises(ValueError):
        paging.paginate(lambda a, b: [[3], [2]], 0, 9, lambda r: r[0], 1)


def test_fixture_source_and_parse(spark, tmp_path):
    good = [0, "1", "2", "0.5", "1.5", "9", 3_599_999]
    (tmp_path / "p0.json").write_text(json.dumps([good, good[:5], [0, "x", *good[2:]]]))
    spark.dataSource.register(paging.FixturePages)
    raw = spark.read.format("fixture_pages").load(str(tmp_path))
    got = {r.pos: r for r in parse.klines(raw).collect()}
    assert [got[k].reject for k in range(3)] == [None, "fields", "number"]
    assert got[0].close == D("1.5")


def test_grid():
    assert g.duration_us("4h") == 14_400_000_000
    with pytest.raises(ValueError):
        g.duration_us("1d")
    assert g.from_us(g.to_us(datetime(2024, 1, 1, tzinfo=UTC))) == datetime(2024, 1, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        g.to_us(datetime(2024, 1, 1))  # noqa: DTZ001
    h = g.duration_us("1h")
    assert g.check_clamp(0, 5 * h, 3 * h + 5, h) == 3 * h
    for bad in ((0, 0, h), (1, 5 * h, 9 * h), (0, 5 * h, h - 1)):
        with pytest.raises(ValueError):
            g.check_clamp(*bad, h)
    with pytest.raises(ValueError):
        rolling.check_split((0, 2 * h), (h, 3 * h), h)


def test_coverage_union(spark):
    ranges = spark.createDataFrame([("S", 0, 24), ("T", 0, 24)], "symbol string, start_us long, end_us long")
    cases = spark.createDataFrame([("S", 0, 5), ("S", 4, 10), ("S", 10, 15), ("S", 14, 24)], "symbol string, start_us long, end_us long")
    got = {(r.symbol, r.gap_start, r.gap_end) for r in quality.coverage_gaps(cases, ranges).collect()}
    assert got == {("T", 0, 24)}
    cases = spark.createDataFrame([("S", 2, 20), ("S", 3, 4), ("T", -5, 30)], "symbol string, start_us long, end_us long")
    got = {(r.symbol, r.gap_start, r.gap_end) for r in quality.coverage_gaps(cases, ranges).collect()}
    assert got == {("S", 0, 2), ("S", 20, 24)}


def test_instants_of_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0,), (1_704_067_200_000_001,), (-1,), (None,)], "us long")
    got = rows.select(F.unix_micros(g.instant_of(F.col("us")))).collect()
    assert [r[0] for r in got] == [0, 1_704_067_200_000_001, -1, None]
    for bad in (1 << 62, -(1 << 62)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(bad,)], "us long").select(g.instant_of(F.col("us"))).collect()
    at = spark.createDataFrame([(None,), (3,), (4,), (0,), (8,)], "at long").select(g.evaluation_fault(F.col("at"), F.lit(4), F.lit(8), 2)).collect()
    assert [r[0] for r in at] == [None, "grid", None, "range", "range"]


def test_funding_of_many_partitions(spark, tmp_path):
    s = store.FundingStore(spark, str(tmp_path / "many"))
    event = lambda symbol, t: ("x", "perp", symbol, t, "Regular", D("0.001"), D(10))
    spans = spark.createDataFrame([("x", "perp", "S", 0, 10), ("x", "perp", "T", 5, 20)], "exchange string, market_type string, symbol string, start_us long, end_us long")
    s.write_many(spark.createDataFrame([event("S", 9), event("T", 19)], FUNDING), spans)
    assert s.events.scanned(0, 30, exchange="x", symbol="T").count() == 1
    assert s.coverage_of(15, 30, exchange="x").count() == 1
    for outside in (event("S", 10), event("T", 4), event("U", 6)):
        with pytest.raises(ValueError, match="outside"):
            s.write_many(spark.createDataFrame([outside], FUNDING), spans)
    assert s.events.read().count() == 2
