"""Requests, ingestion, store-backed backtests, policies and exact metrics: their errors and small cases."""

import http.server
import json
import threading
from decimal import Decimal
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timegrid as g
from tidemark.operators import costs, exact, ledger, policy, quality
from tidemark.plans import backtest, ingest
from tidemark.schemas import DataConflictError, DataCorruptionError
from tidemark.sources import parse, requests, store

H1 = g.DURATIONS["1h"]
START = 1_704_067_200_000_000 // H1 * H1
MARKET = backtest.Market("binance", "spot", "S")


def kline(k, close="1"):
    ms = (START + k * H1) // 1000
    return [ms, "1", "2", "0.5", close, "3", ms + 3_599_999]


def serve(rows, limit=1000):
    """A fetch over rows with a time in front, both bounds included."""
    return lambda a, b: [r for r in rows if a <= r[0] <= b][:limit]


def test_requests():
    asked = []

    def transport(url, timeout):
        asked.append(url)
        return b"[[1], [2]]"

    assert requests.kline_page("S", "1h", 5, start_ms=1, end_ms=2, transport=transport) == [[1], [2]]
    assert requests.funding_page("S", 1, 2, transport=transport) == [[1], [2]]
    assert asked[0].endswith("?symbol=S&interval=1h&limit=5&startTime=1&endTime=2")
    assert asked[1].endswith("?symbol=S&startTime=1&endTime=2&limit=1000")
    bad = (("", "1h"), ("S", ""), ("S", "1h", 0), ("S", "1h", 1001), ("S", "1h", 1, 0))
    for args in bad:
        with pytest.raises(ValueError):
            requests.kline_page(*args, transport=transport)
    with pytest.raises(TypeError):
        requests.kline_page("S", "1h", start_ms=True, transport=transport)
    with pytest.raises(ValueError):
        requests.kline_page("S", "1h", start_ms=2, end_ms=1, transport=transport)
    for args in ((" ", 1, 2), ("S", -1, 2), ("S", 3, 2)):
        with pytest.raises(ValueError):
            requests.funding_page(*args, transport=transport)
    for reply in (b"{}", b"no"):
        with pytest.raises(ValueError):
            requests.kline_page("S", "1h", transport=lambda u, t, reply=reply: reply)
    with pytest.raises(ConnectionError):
        requests.over_http("http://127.0.0.1:9/none", 1)


def test_kline_reader_plans_pages():
    reader = requests._KlineReader("S", "1h", 0, 2500 * 3_600_000, "http://none", 1)
    parts = reader.partitions()
    assert [(p.start_ms // 3_600_000, p.end_ms // 3_600_000) for p in parts] == [(0, 1000), (1000, 2000), (2000, 2500)]
    with pytest.raises(ValueError):
        requests._KlineReader("S", "1h", 5, 5, "http://none", 1)


def test_decimal_text(spark):
    rows = spark.createDataFrame([("1.50",), ("x",), ("NaN",), ("1.123456789",), ("100",)], "t string")
    got = rows.select(parse.decimal_to_text(parse.text_to_decimal(F.col("t")))).collect()
    assert [r[0] for r in got] == ["1.5", None, None, None, "100"]
    with pytest.raises(DataCorruptionError):
        g.from_us(1 << 62)


def test_candle_ingestion(spark, tmp_path):
    kept = store.candle_store(spark, str(tmp_path / "candles"))
    rows = [kline(k) for k in range(30)]
    ask = (START, START + 30 * H1, START + 25 * H1 + 5)
    assert ingest.ingest_candles(kept, "S", "1h", *ask, fetch=serve(rows, 7)) == 25
    assert ingest.ingest_candles(kept, "S", "1h", *ask, fetch=serve(rows, 9)) == 25  # again: nothing new
    assert kept.query(START, START + 99 * H1, symbol="S", timeframe="1h").count() == 25
    assert kept.query(START + H1, START + 3 * H1, symbol="S").count() == 2
    with pytest.raises(ValueError):
        kept.query(START, START)
    other = [kline(k, "1.5") for k in range(30)]
    with pytest.raises(DataConflictError):
        ingest.ingest_candles(kept, "S", "1h", *ask, fetch=serve(other))
    late = [*rows[:24], [*rows[24][:6], rows[24][6] + 1]]
    empty = store.candle_store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="not final"):
        ingest.ingest_candles(empty, "S", "1h", *ask, fetch=serve(late))
    broken = [*rows[:3], ["x", *rows[3][1:]]]
    with pytest.raises(ValueError):
        ingest.ingest_candles(empty, "S", "1h", *ask, fetch=lambda a, b: broken)
    assert ingest.ingest_candles(empty, "S", "1h", *ask, fetch=lambda a, b: []) == 0
    assert empty.read().count() == 0
    as_pages = lambda numbers: spark.createDataFrame([(p, i, json.dumps(r)) for (p, i), r in zip(numbers, rows, strict=True)], "page_no int, pos int, raw string")
    for numbers, fault in (([(0, 30 - k) for k in range(30)], "out of order"), ([(5 - k // 10, k % 10) for k in range(30)], "no progress")):
        with pytest.raises(ValueError, match=fault):
            ingest.ingest_candle_pages(empty, as_pages(numbers), "S", "1h", *ask)
    assert empty.read().count() == 0
    pages = as_pages([(k // 7, k % 7) for k in range(30)])
    asked = spark.sparkContext.accumulator(0)

    def once(batches, counter=asked):
        for b in batches:
            counter.add(b.num_rows)
            yield b

    assert ingest.ingest_candle_pages(empty, pages.mapInArrow(once, pages.schema), "S", "1h", *ask) == 25
    assert asked.value == 30  # every row was asked for once
    several = pages.withColumn("symbol", F.explode(F.array(F.lit("A"), F.lit("B"))))
    assert ingest.ingest_candle_pages(empty, several, None, "1h", *ask) == 50
    twice = several.unionByName(several.withColumn("page_no", F.col("page_no") + 100))
    with pytest.raises(ValueError, match="no progress"):
        ingest.ingest_candle_pages(empty, twice, None, "1h", *ask)


class Exchange(http.server.BaseHTTPRequestHandler):
    """Bars on every hour and funding every eight, two of them at each time."""

    asked: list[str] = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.asked.append(q["symbol"])
        low, high, hour = int(q["startTime"]), int(q["endTime"]), 3_600_000
        if "interval" in q:
            rows = [[t, "1", "2", "0.5", "1", "3", t + hour - 1] for t in range(-(-low // hour) * hour, high + 1, hour)]
        else:
            times = range(-(-low // (8 * hour)) * 8 * hour, high + 1, 8 * hour)
            rows = [{"symbol": q["symbol"], "fundingRate": "0.001", "fundingTime": t, "markPrice": "10", "rateType": kind} for t in times for kind in ("Regular", "Special")]
        body = json.dumps(rows[: int(q["limit"])]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def exchange():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Exchange)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Exchange.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_filters_prune_pages(spark, exchange):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(requests.MarketKlines)
    spark.dataSource.register(requests.MarketFunding)
    hour = 3_600_000
    options = {"symbol": "A, B,C", "start_ms": "0", "end_ms": str(5000 * hour), "base": exchange}
    every = spark.read.format("market_klines").options(timeframe="1h", **options).load()
    assert every.rdd.getNumPartitions() == 15
    assert every.count() == 15_000 and len(Exchange.asked) == 15
    wanted = (F.col("symbol") == "B") & (F.col("open_ms") >= 1500 * hour) & (F.col("open_ms") < 2100 * hour)
    Exchange.asked.clear()
    few = spark.read.format("market_klines").options(timeframe="1h", **options).load().where(wanted)
    assert few.rdd.getNumPartitions() == 2
    got = few.collect()
    assert Exchange.asked == ["B", "B"] and len(got) == 600
    assert sorted(map(tuple, got)) == sorted(map(tuple, every.where(wanted).collect()))
    assert spark.read.format("market_klines").options(timeframe="1h", **options).load().where("symbol = 'Z'").count() == 0
    parsed = parse.klines(every.where("symbol IN ('A', 'C')"))
    assert parsed.where("reject IS NULL").count() == 10_000
    paid = spark.read.format("market_funding").options(hours="700", **options).load()
    assert paid.rdd.getNumPartitions() == 24 and paid.count() == 3 * 2 * 625
    events = parse.funding_events(parse.funding_records(paid.where("symbol = 'B' AND event_ms >= 100"), "B"), "spot", "B")
    assert events.distinct().count() == 2 * 624


def test_a_store_is_read_once(spark, tmp_path, monkeypatch):
    kept = store.candle_store(spark, str(tmp_path / "candles"))
    kept.write(bars(spark, [100, 101, 102, 101, 100, 103]))
    read = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    plain = store.KeyedStore.scanned
    monkeypatch.setattr(store.KeyedStore, "scanned", lambda self, *a, **k: (rows := plain(self, *a, **k)).mapInArrow(once, rows.schema))
    done = backtest.run_from_store(kept, MARKET, "1h", backtest.Range(START, START + 6 * H1, START + 6 * H1), F.lit(1))
    assert ledger.summary(done).first().bars == 6 and read.value == 6


def test_many_runs_and_windows(spark, tmp_path):
    kept = store.candle_store(spark, str(tmp_path / "candles"))
    two = bars(spark, [100, 101, 102, 101, 100, 103])
    kept.write(two.unionByName(two.withColumn("symbol", F.lit("T")).where(F.col("open_us") != START + 2 * H1)))
    kinds = "run_id string, symbol string, start_us long, end_us long, evaluation_start_us long"
    ranges = [("a", "S", START, START + 4 * H1, START + H1), ("b", "S", START + 2 * H1, START + 6 * H1, START + 2 * H1), ("c", "T", START + 3 * H1, START + 6 * H1, START + 4 * H1)]
    done = backtest.run_all_from_store(kept, "binance", "spot", "1h", spark.createDataFrame(ranges, kinds), F.lit(1))
    got = {r.run_id: r for r in ledger.summary(done).collect()}
    for run, symbol, lo, hi, at in ranges:
        alone = backtest.run_from_store(kept, backtest.Market("binance", "spot", symbol), "1h", backtest.Range(lo, hi, hi), F.lit(1), evaluation_start_us=at)
        want = ledger.summary(alone).first()
        assert (got[run].final_equity, got[run].fills, got[run].bars) == (want.final_equity, want.fills, want.bars)
    gap = spark.createDataFrame([("d", "T", START, START + 4 * H1, START)], kinds)
    with pytest.raises(ValueError, match="quality gate"):
        backtest.run_all_from_store(kept, "binance", "spot", "1h", gap, F.lit(1))
    with pytest.raises(ValueError, match="evaluation"):
        backtest.run_all_from_store(kept, "binance", "spot", "1h", gap.withColumn("evaluation_start_us", F.col("end_us")), F.lit(1))
    spans = "symbol string, window_idx long, ctx_us long, start_us long, end_us long"
    windows = [("S", 0, START, START + H1, START + 4 * H1), ("S", 1, START + H1, START + 2 * H1, START + 6 * H1), ("T", 0, START + 3 * H1, START + 3 * H1, START + 6 * H1)]
    rolled = backtest.rolling_all_from_store(kept, "binance", "spot", "1h", spark.createDataFrame(windows, spans), ledger.momentum(), lookback=1)
    for r in rolled.collect():
        _, _, ctx, lo, hi = next(w for w in windows if w[:2] == (r.symbol, r.window_idx))
        alone = backtest.run_from_store(kept, backtest.Market("binance", "spot", r.symbol), "1h", backtest.Range(ctx, hi, hi), ledger.momentum(), evaluation_start_us=lo)
        want = ledger.summary(alone).first()
        assert (r.final_equity, r.fills, r.trades, r.bars) == (want.final_equity, want.fills, want.trades, want.bars)
    with pytest.raises(ValueError, match="gate of a window"):
        backtest.rolling_all_from_store(kept, "binance", "spot", "1h", spark.createDataFrame([("T", 0, START, START + H1, START + 4 * H1)], spans), ledger.momentum())
    with pytest.raises(ValueError, match="in order"):
        backtest.rolling_all_from_store(kept, "binance", "spot", "1h", spark.createDataFrame([("T", 0, START + H1, START, START + 4 * H1)], spans), ledger.momentum())
    assert backtest.rolling_all_from_store(kept, "binance", "spot", "1h", spark.createDataFrame([], spans), ledger.momentum()).count() == 0


def record(k, kind="Regular", rate="0.001"):
    return {"symbol": "S", "fundingRate": rate, "fundingTime": (START + k * H1) // 1000, "markPrice": "10", "rateType": kind}


def by_time(rows):
    return lambda a, b: [r for r in rows if a <= r["fundingTime"] <= b]


def test_funding_ingestion(spark, tmp_path):
    kept = store.FundingStore(spark, str(tmp_path / "funding"))
    rows = [record(0), record(0, "Special"), record(8), record(10)]
    ask = ("S", "spot", START, START + 10 * H1)
    assert ingest.ingest_funding(kept, *ask, START + 10 * H1, fetch=by_time(rows)) == 3  # the record at the end is beyond it
    assert kept.query_events("binance", "spot", "S", START, START + 10 * H1).select("rate_type").collect()[1][0] == "Special"
    assert kept.query_coverage("binance", "spot", "S", START + H1, START + 2 * H1).count() == 1
    assert kept.query_coverage("binance", "spot", "S", START + 10 * H1, START + 12 * H1).count() == 0
    assert ingest.ingest_funding(kept, "S", "spot", START + 20 * H1, START + 30 * H1, START + 30 * H1, fetch=by_time([])) == 0
    with pytest.raises(ValueError):
        ingest.ingest_funding(kept, *ask, START + 9 * H1, fetch=by_time(rows))
    with pytest.raises(DataConflictError):
        ingest.ingest_funding(kept, *ask, START + 10 * H1, fetch=by_time([record(0, rate="0.002")]))
    assert len(kept.folder.parts("coverage")) == 2 and len(kept.folder.parts("events")) == 1
    report = backtest.store_funding_report(kept, MARKET, START, START + 30 * H1).first()
    assert (report.event_count, report.gap_count, report.status) == (3, 1, "FAIL")


def bars(spark, closes, start=START):
    ids = [("binance", "spot", "S", "1h", start + k * H1, c, c, c, c, 1) for k, c in enumerate(closes)]
    rows = spark.createDataFrame([(*r[:5], *(Decimal(x) for x in r[5:])) for r in ids], store.CANDLES)
    return rows


def test_backtest_from_store(spark, tmp_path):
    kept = store.candle_store(spark, str(tmp_path / "candles"))
    kept.write(bars(spark, [100, 101, 102, 101, 100, 103]))
    asked = backtest.Range(START, START + 6 * H1, START + 6 * H1)
    fixed = lambda: F.lit(1)
    done = ledger.summary(backtest.run_from_store(kept, MARKET, "1h", asked, fixed())).first()
    assert (float(done.final_equity), done.fills, done.bars) == (1000 + 2 * (103 - 101), 1, 6)
    python = ledger.summary(backtest.run_from_store(kept, MARKET, "1h", asked, policy.Crossing)).first()
    assert python.bars == 6 and python.balanced
    with pytest.raises(ValueError, match="gate"):
        backtest.run_from_store(kept, MARKET, "1h", backtest.Range(START, START + 7 * H1, START + 9 * H1), fixed())
    with pytest.raises(ValueError, match="aligned"):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), evaluation_start_us=START + 1)
    with pytest.raises(ValueError, match="range"):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), evaluation_start_us=START + 6 * H1)
    with pytest.raises(TypeError):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), funding_required=1)
    with pytest.raises(ValueError):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), funding_required=True)
    with pytest.raises(ValueError):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), funding_model=costs.linear)
    funds = store.FundingStore(spark, str(tmp_path / "funding"))
    how = {"funding_required": True, "funding_store": funds, "funding_model": costs.linear}
    with pytest.raises(ValueError, match="funding gate"):
        backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), **how)
    ingest.ingest_funding(funds, "S", "spot", START, START + 6 * H1, START + 6 * H1, fetch=by_time([record(3)]))
    paid = ledger.summary(backtest.run_from_store(kept, MARKET, "1h", asked, fixed(), **how)).first()
    assert float(paid.final_equity) == 1004 - 2 * 0.001 * 10
    with pytest.raises(ValueError, match="blank"):
        backtest.Market("binance", " ", "S")


def test_bar_and_event_checks(spark):
    dur, good = H1, bars(spark, [1, 2, 3]).withColumn("run_id", F.lit("S"))
    backtest.check_bars(good, dur, START + 3 * dur)
    for rows, as_of in ((good, START + 2 * dur), (good.where(F.col("open_us") != START + dur), START + 9 * dur), (good.unionByName(good), START + 9 * dur), (good.limit(0), START)):
        with pytest.raises(ValueError):
            backtest.check_bars(rows, dur, as_of)
    event = spark.createDataFrame([("binance", "spot", "S", START, "Regular", Decimal(1), Decimal(1))], store.FUNDING)
    backtest.check_events(event, MARKET, START, START + 1)
    for rows, lo in ((event, START + 1), (event.unionByName(event), START), (event.withColumn("symbol", F.lit("T")), START)):
        with pytest.raises(ValueError):
            backtest.check_events(rows, MARKET, lo, START + 2)
    out_of_order = event.unionByName(event.withColumn("event_us", F.col("event_us") + 1)).withColumn("pos", -F.col("event_us"))
    backtest.check_events(out_of_order, MARKET, START, START + 2)
    with pytest.raises(ValueError, match="ascend"):
        backtest.check_events(out_of_order, MARKET, START, START + 2, pos="pos")
    span = spark.createDataFrame([("S", START, START + 2 * dur)], "symbol string, start_us long, end_us long")
    with pytest.raises(Exception, match="out of its range"):
        quality.in_order(good, span).collect()


def test_rolling_from_store(spark, tmp_path):
    kept = store.candle_store(spark, str(tmp_path / "candles"))
    kept.write(bars(spark, [100, 101, 102, 101, 100, 103]))
    windows = [(START, START + H1, START + 4 * H1), (START + H1, START + 2 * H1, START + 6 * H1)]
    got = backtest.rolling_from_store(kept, MARKET, "1h", windows, START + 6 * H1, policy.Crossing)
    assert [s.first().bars for s in got] == [3, 4]
    one = policy.Crossing()
    with pytest.raises(ValueError, match="used before"):
        backtest.rolling_from_store(kept, MARKET, "1h", windows, START + 6 * H1, lambda: one)
    with pytest.raises(TypeError):
        backtest.rolling_from_store(kept, MARKET, "1h", windows, START + 6 * H1, object)
    with pytest.raises(TypeError):
        backtest.rolling_from_store(kept, MARKET, "1h", windows, START + 6 * H1, 5)
    with pytest.raises(ValueError):
        backtest.rolling_from_store(kept, MARKET, "1h", [(START + H1, START, START + 2 * H1)], START + 6 * H1, policy.Crossing)


def test_exact_metrics(spark):
    times, d = [1, 2, 3], Decimal
    assert exact.stage1_of(d(100), times, [d(90), d(120), d(60)]) == (d("-0.4"), d("0.5"))
    mean, spread, sharpe = exact.stage2_of(d(3), times[:2], [d(1), d(2)])
    assert str(mean) == "0.1666666666666666666666666666" or str(mean).startswith("0.16666666666666666666666666")
    assert sharpe == exact._digits().divide(mean, spread)
    for initial, points in ((d(0), [d(1)]), (d("NaN"), [d(1)]), (d(1), []), (d(1), [d("Infinity")])):
        with pytest.raises(ValueError):
            exact.stage1_of(initial, times, points)
    with pytest.raises(ValueError, match="ascend"):
        exact.stage1_of(d(1), [2, 2], [d(1), d(1)])
    with pytest.raises(ValueError, match="equity at 1 is the denominator of return 2"):
        exact.stage2_of(d(1), times, [d(1), d(0), d(1)])
    with pytest.raises(ValueError, match="two returns"):
        exact.stage2_of(d(1), [1], [d(2)])
    with pytest.raises(ValueError, match="deviation"):
        exact.stage2_of(d(1), [1, 2], [d(1), d(1)])
    curve = spark.createDataFrame([("a", 1, d(90)), ("a", 2, d(120)), ("b", 1, d(-5)), ("b", 2, d(5))], "run_id string, open_us long, equity decimal(28,10)")
    got = {r.run_id: r for r in exact.metrics(curve, "100", strict=False).collect()}
    assert got["a"].fault is None and "denominator" in got["b"].fault and got["b"].sharpe_ratio is None
    with pytest.raises(Exception, match="denominator"):
        exact.metrics(curve, "100").collect()


def test_models(spark):
    rows = spark.createDataFrame([("a", 1, Decimal(3), Decimal(4))], "run_id string, open_us long, open decimal(18,8), close decimal(18,8)")
    with pytest.raises(ValueError):
        ledger.replay(rows, F.lit(1), 1, quantity=0)
    with pytest.raises(Exception, match="target"):
        ledger.replay(rows, F.lit(7), 1).collect()
    with pytest.raises(Exception, match="reference price"):
        rows.select(costs.funding_due(F.lit(Decimal("-1")).cast("decimal(18,8)"), F.lit(Decimal("0.1")).cast("decimal(18,10)"))).collect()
    summary = spark.createDataFrame([("a", False)], "run_id string, balanced boolean")
    with pytest.raises(Exception, match="balance"):
        ledger.reconciled(summary).collect()
