"""Work in blocks: the same results whatever the blocks, balanced tasks, and joins against brute force."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF, compare
from tidemark import catalog
from tidemark.operators import ledger, quality, rolling, scan

H = 3_600_000_000
BLOCKWISE = (
    "order_contiguity_check", "backward_order_check", "event_order_faults", "order_violations", "missing_slots", "unaligned_report", "quality_report",
    "equity_curve", "backtest_summary", "flat_fills", "drawdown_curve", "periodic_returns", "context_evaluation", "stage2_metrics", "exact_digits", "metric_faults",
    "funding_marks", "range_overlaps", "money_text", "store_backtest",
)


@pytest.mark.parametrize("name", BLOCKWISE)
def test_blocks_of_two_slots(spark, monkeypatch, name):
    monkeypatch.setattr(scan, "SLOTS", 2)
    compare(spark, name)


@pytest.mark.parametrize("name", ["rolling_zero_context", "rolling_context_aware", "store_rolling"])
def test_windows_over_many_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(scan, "SLOTS", 7)
    compare(spark, name, SF.replace("0.001", "0.01"))


def test_one_symbol_is_many_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("hot").alias("symbol"), (F.col("id") * H).alias("open_us"))
    dealt = scan.cut(rows, "open_us").repartition(8, "symbol", scan.BLOCK)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    plan = quality.order_faults(rows, H)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(symbol#\d+, _block#", plan)
    got = {r.symbol: r for r in quality.order_faults(rows, H).collect()}
    assert got["hot"].bars == 18_000 and got["hot"].not_ascending == 0 and got["hot"].gaps == 1_999


def test_what_windows_move_does_not_grow_with_their_length(spark):
    """Windows three times as long over the same bars: the rows that are exchanged stay about as many."""
    bars = spark.range(1500).select(F.lit("r").alias("run_id"), (F.col("id") * H).alias("open_us"), *[(100 + F.col("id") * 7 % 13).cast("decimal(18,2)").alias(c) for c in ("open", "high", "low", "close")])

    def moved(length):
        windows = rolling.rolling_windows(bars, H, length, 10)
        done = rolling.evaluated(bars, windows, ledger.momentum(), H, lookback=1)
        plan = done.collect() and done._jdf.queryExecution().executedPlan()
        todo, rows = [plan], 0
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                todo.append(node.plan())
            if node.nodeName() == "Exchange":
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            kids = node.children()
            todo += [kids.apply(k) for k in range(kids.size())]
        return rows

    short, long = moved(100), moved(300)
    assert long < 2 * short


def brute_marks(events, marks):
    out = {}
    for run, t, price, rate in events:
        later = sorted(m for r, m in set(marks) if r == run and m >= t)
        if later:
            n, total = out.get((run, later[0]), (0, Decimal(0)))
            out[run, later[0]] = (n + 1, total + price * rate)
    return out


def test_due_at_irregular_marks(spark, monkeypatch):
    monkeypatch.setattr(scan, "SLOTS", 3)
    rng = random.Random(5)
    marks = [(rng.choice("ab"), rng.randrange(0, 400)) for _ in range(60)]
    events = [(rng.choice("abc"), rng.randrange(-20, 450), Decimal(rng.randrange(1, 99)), Decimal(rng.randrange(-9, 9)) / 1000) for _ in range(300)]
    events += [(r, m, Decimal(7), Decimal("0.001")) for r, m in marks[:15]]
    left = spark.createDataFrame(events, "run_id string, event_us long, reference_price decimal(18,8), funding_rate decimal(18,10)")
    right = spark.createDataFrame(marks, "run_id string, mark_us long")
    got = {(r.run_id, r.mark_us): (r.events, r.funding) for r in ledger.due_at(left, right).collect()}
    assert got == brute_marks(events, marks)
    start = spark.createDataFrame([("a", 100), ("b", 0)], "run_id string, eval_start long")
    kept = [e for e in events if e[0] in "ab" and e[1] >= {"a": 100, "b": 0}[e[0]]]
    assert {(r.run_id, r.mark_us): (r.events, r.funding) for r in ledger.due_at(left, right, start).collect()} == brute_marks(kept, marks)


def test_next_is_carried_not_read_anew(spark, monkeypatch):
    """A window that begins at its row costs the square of its rows: 40,000 blocks of one key are one such window."""
    monkeypatch.setattr(scan, "SLOTS", 1)
    marks = spark.range(40_000).select(F.lit("a").alias("run_id"), (F.col("id") * 10).alias("mark_us"))
    events = marks.select("run_id", (F.col("mark_us") - 3).alias("event_us"), F.lit(2).cast("decimal(18,8)").alias("reference_price"), F.lit(1).cast("decimal(18,10)").alias("funding_rate"))
    got = ledger.due_at(events, marks)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert got.agg(F.count("*"), F.sum("events"), F.sum("funding")).first()[:] == (40_000, 40_000, 80_000)


def test_overlaps(spark):
    rng = random.Random(6)
    span = lambda: (rng.choice("ab"), (a := rng.randrange(0, 300)), a + rng.choice((0, 1, 5, 40)))
    left, right = [span() for _ in range(80)], [span() for _ in range(60)]
    got = scan.overlaps(spark.createDataFrame(left, "k string, s long, e long"), spark.createDataFrame(right, "k string, lo long, hi long"), "k", 16)
    want = [(k, s, e, lo, hi) for k, s, e in left for q, lo, hi in right if k == q and s < e and lo < hi and s < hi and e > lo]
    assert sorted((r.k, r.s, r.e, r.lo, r.hi) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in plan


def test_registered_names():
    assert set(BLOCKWISE) <= set(catalog.queries())
