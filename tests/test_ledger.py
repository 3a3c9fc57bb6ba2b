"""Hand-computed replays, and the window form against a sequential fold."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, ledger, metrics

H = 3_600_000_000
SCHEMA = "run_id string, open_us long, open decimal(18,2), high decimal(18,2), low decimal(18,2), close decimal(18,2), goal int"


def bars(spark, rows, run="r"):
    return spark.createDataFrame([(run, k * H, D(o), D(max(o, c)), D(min(o, c)), D(c), g) for k, (o, c, g) in enumerate(rows)], SCHEMA)


GOLDEN = [(100, 105, 1), (110, 115, -1), (90, 95, 0), (80, 85, 0), (120, 125, 1)]


@pytest.mark.parametrize(
    ("cost", "total", "curve"),
    [
        (costs.fixed_per_fill(2), "6", ["1000", "1008", "946", "974", "974"]),
        (costs.composite(costs.commission("0.001"), costs.half_spread("0.0005"), costs.slippage("0.001")), "1.85", ["1000", "1009.45", "948.55", "978.15", "978.15"]),
    ],
)
def test_golden(spark, cost, total, curve):
    done = ledger.replay(bars(spark, GOLDEN), F.col("goal"), H, cost=cost).persist()
    assert [r.equity for r in done.orderBy("open_us").collect()] == [D(x) for x in curve]
    s = ledger.summary(done).first()
    assert (s.realized, s.total_cost, s.fills, s.trades, s.balanced) == (D(-20), D(total), 3, 4, True)


def test_golden_with_funding(spark):
    rows = [(100, 100, 1), (101, 102, 1), (103, 104, -1), (105, 106, 0), (107, 108, 0)]
    half = H // 2
    events = [(H + half, "Regular", "0.001"), (3 * H, "Regular", "0.002"), (3 * H, "Special", "-0.0005"), (3 * H + half, "Regular", "0.001")]
    due = spark.createDataFrame([("r", t, k, D(x), D(100)) for t, k, x in events], "run_id string, event_us long, rate_type string, funding_rate decimal(18,6), reference_price decimal(18,2)")
    start = spark.createDataFrame([("r", 0)], "run_id string, eval_start long")
    done = ledger.replay(bars(spark, rows), F.col("goal"), H, quantity=1, cost=costs.commission("0.001"), funding=ledger.due_marks(due, H, start))
    assert [r.equity for r in done.orderBy("open_us").collect()] == [D(x) for x in ("1000", "1000.799", "1002.649", "1002.539", "1001.432")]
    s = ledger.summary(done).first()
    assert (s.realized, s.total_cost, s.balanced) == (D(2), D("0.568"), True)


def fold(rows, rate):
    """Bar by bar: mark, ask the policy, fill at the next open."""
    cash, position, entry, out, realized = D(1000), 0, None, [], D(0)
    want = 0
    for o, c, goal in rows:
        delta = want - position
        if delta:
            if position:
                realized += position * (D(o) - entry)
            cash -= delta * D(o) + abs(delta) * D(o) * rate
            position, entry = want, D(o)
        out.append(cash + position * D(c))
        want = 2 * goal
    return out, realized


def test_random_runs_match_a_fold(spark):
    rng = random.Random(3)
    runs = {f"r{k}": [(rng.randint(50, 150), rng.randint(50, 150), rng.choice((-1, 0, 1))) for _ in range(rng.randint(1, 14))] for k in range(25)}
    every = None
    for name, rows in runs.items():
        part = bars(spark, rows, name)
        every = part if every is None else every.union(part)
    done = ledger.replay(every, F.col("goal"), H, cost=costs.commission("0.001")).persist()
    got = {}
    for r in done.orderBy("open_us").collect():
        got.setdefault(r.run_id, []).append(r.equity)
    sums = {r.run_id: r for r in ledger.summary(done).collect()}
    for name, rows in runs.items():
        curve, realized = fold(rows, D("0.001"))
        assert got[name] == curve
        assert sums[name].realized == realized
        assert sums[name].balanced


def test_metrics(spark):
    curve = spark.createDataFrame([("r", 1, D(1100)), ("r", 2, D(1210)), ("r", 3, D(1100))], "run_id string, open_us long, equity decimal(18,2)")
    one, two = metrics.stage1(curve).first(), metrics.stage2(curve).first()
    assert abs(one.total_return - 0.1) < 1e-12
    assert abs(one.max_drawdown - 110 / 1210) < 1e-12
    mean = (0.1 + 0.1 + 1100 / 1210 - 1) / 3
    assert abs(two.mean_return - mean) < 1e-12


def test_costs_reject_bad_rates():
    for bad in ("-0.1", "NaN", "Infinity"):
        with pytest.raises(ValueError):
            costs.commission(bad)
