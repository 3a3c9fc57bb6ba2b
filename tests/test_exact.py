"""Numbers of any scale and metrics of 28 digits against Python's own arithmetic."""

import random
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions.wide import Wide, summed
from tidemark.operators import costs, exact, ledger, scan

H = 3_600_000_000


def number(rng, whole, places):
    text = ("-" if rng.random() < 0.5 else "") + str(rng.randrange(10 ** rng.randrange(whole + 1)))
    return text + ("." + "".join(rng.choice("0199") for _ in range(rng.randrange(1, places + 1))) if rng.random() < 0.8 else "")


def test_wide_numbers(spark):
    rng = random.Random(2)
    rows = [(k % 3, number(rng, 20, 12), number(rng, 5, 10), number(rng, 9, 8)) for k in range(300)]
    rows += [(0, "0", "0", "0"), (1, "-0.0", "5", "5"), (1, "007.50", "-0.0000000001", "1."), (2, None, "1", "1")]
    df = spark.createDataFrame(rows, "g int, a string, b string, c string")
    a, b, c = Wide.of(F.col("a"), 12, 20), Wide.of(F.col("b"), 10), Wide.of(F.col("c"), 8)
    got = df.select("*", (a * b * c).text().alias("product"), (a + b).text().alias("sum"), (a - c).text().alias("less"), a.compared(b).alias("order"), Wide.constant("-1.5").text().alias("k")).collect()
    wide = Context(prec=200)
    for r in got:
        if r.a is None:
            assert r["product"] is None and r["sum"] is None and r.order is None
            continue
        x, y, z = (Decimal(v) for v in (r.a, r.b, r.c))
        assert Decimal(r["product"]) == wide.multiply(wide.multiply(x, y), z)
        assert (Decimal(r["sum"]), Decimal(r.less)) == (wide.add(x, y), wide.subtract(x, z))
        assert r.order == (x > y) - (x < y) and r.k == "-1.5"
    for r in summed(df, ["g"], {"total": a * b * c}, F.count("*").alias("n")).collect():
        assert Fraction(r.total) == sum(Fraction(p) * Fraction(q) * Fraction(s) for g, p, q, s in rows if g == r.g and p)
    for bad in ("1e5", "x", "", "1.1234567890123", "1" * 40):
        with pytest.raises(Exception, match="no number"):
            spark.createDataFrame([(bad,)], "t string").select(Wide.of(F.col("t"), 12).text()).collect()


def curve(rng, n, jump):
    out, now = [], Decimal(1000)
    for _ in range(n):
        now = max(Decimal("0.01"), (now * Decimal(rng.uniform(1 - jump, 1 + jump))).quantize(Decimal("1e-8")))
        out.append(now)
    return out


def test_wide_arguments_are_computed_once(spark):
    """However deep a term is, each number in it is parsed once a row."""
    df = spark.createDataFrame([("1.5", "2.25", "-3")], "a string, b string, c string")
    a, b, c = (Wide.of(F.col(x), 12) for x in "abc")
    got = df.select((a * b * c - a).compared(Wide.constant("-11.625")).alias("order"), (a * b * c - a).text().alias("text"))
    assert got._jdf.queryExecution().analyzed().toString().count("raise_error") == 8
    assert got.first().order == 0 and Decimal(got.first().text) == Decimal("-11.625")


@pytest.mark.parametrize("slots", [1, 64])
def test_metrics_are_exact_and_rounded_once(spark, monkeypatch, slots):
    monkeypatch.setattr(scan, "SLOTS", slots)
    rng = random.Random(8)
    curves = {f"r{k}": curve(rng, rng.randrange(2, 60), jump) for k, jump in enumerate([0.001, 0.01, 0.1, 0.9] * 6)}
    rows = [(name, k * 4 * H, x) for name, points in curves.items() for k, x in enumerate(points)]
    rng.shuffle(rows)
    got = {r.run_id: r for r in exact.metrics(spark.createDataFrame(rows, "run_id string, open_us long, equity decimal(28,8)"), "1000", "0.0001").collect()}
    digits, wide = exact._digits(), Context(prec=120)
    for name, points in curves.items():
        times, start = list(range(len(points))), Decimal(1000)
        returns = [Fraction(x) for x in exact.returns_of(start, times, points)]
        n, mean = len(returns), sum(returns) / len(returns)
        variance = sum((x - mean) ** 2 for x in returns) / (n - 1)
        whole = lambda f: wide.divide(Decimal(f.numerator), Decimal(f.denominator))
        want_mean, want_spread = digits.plus(whole(mean)), digits.plus(wide.sqrt(whole(variance)))
        r = got[name]
        assert (Decimal(r.mean_return), Decimal(r.return_stdev)) == (want_mean, want_spread)
        with localcontext(digits):
            assert Decimal(r.sharpe_ratio) == (want_mean - Decimal("0.0001")) / want_spread
        assert (Decimal(r.total_return), Decimal(r.max_drawdown)) == exact.stage1_of(start, times, points)
        # the running sums of 28 digits are close, and the mean is the same where they never round
        seq = exact.stage2_of(start, times, points, Decimal("0.0001"))
        assert abs(seq[1] - want_spread) <= want_spread * Decimal("1e-24")
        assert abs(seq[0] - want_mean) <= max(abs(want_mean), Decimal("1e-3")) * Decimal("1e-24")


def test_faults_come_in_order(spark):
    d = lambda *x: [str(v) for v in x]
    curves = {
        "finite before times": ([1, 2, 2], d(5, "NaN", 5), "equity at 1 must be finite"),
        "times before denominators": ([1, 2, 2], d(5, 0, 5), "must ascend"),
        "first denominator": ([1, 2, 3, 4], d(5, -1, 0, 5), "equity at 1 is the denominator of return 2"),
        "last point is none": ([1, 2], d(5, -1), None),
        "count": ([1], d(5), "two returns"),
        "flat": ([1, 2, 3], d(10, 10, 10), "deviation"),
    }
    rows = [(name, t, x) for name, (times, points, _) in curves.items() for t, x in zip(times, points, strict=True)]
    df = spark.createDataFrame(rows, "run_id string, open_us long, equity string")
    got = {r.run_id: r.fault for r in exact.metrics(df, "10", strict=False).collect()}
    for name, (_, _, want) in curves.items():
        assert (got[name] is None) if want is None else (want in got[name]), name
    for initial, match in (("0", "positive"), ("NaN", "finite")):
        assert all(match in r.fault for r in exact.metrics(df, initial, strict=False).collect())
    assert "risk-free" in {r.fault for r in exact.metrics(df.where("run_id = 'count'"), "10", "NaN", strict=False).collect()}.pop()
    assert {r.fault for r in exact.metrics(df.where("run_id IN ('count', 'flat')"), "10", stage2=False).collect()} == {None}
    with pytest.raises(Exception, match="18 places"):
        exact.metrics(spark.createDataFrame([("a", 1, "0.1234567890123456789")], "run_id string, open_us long, equity string")).collect()


def test_money_is_never_rounded(spark):
    one = spark.createDataFrame([(1, Decimal("0.12345678"))], "q int, p decimal(18,8)")
    cost = costs.composite(costs.commission("0.00075"), costs.slippage("0.0001234567"))
    assert one.select(cost(F.col("q"), F.col("p"))).first()[0] == Decimal("0.12345678") * (Decimal("0.00075") + Decimal("0.0001234567"))
    due = costs.funding_due(F.lit(Decimal("0.12345678")).cast("decimal(18,8)"), F.lit(Decimal("0.0001234567")).cast("decimal(18,10)"))
    assert one.select(due).first()[0] == Decimal("0.12345678") * Decimal("0.0001234567")
    for bad in ("0.00000000001", "10"):
        with pytest.raises(ValueError, match="places"):
            costs.commission(bad)
    half = spark.createDataFrame([(Decimal("0.5"), Decimal("0.00000001"))], "q decimal(18,8), p decimal(18,8)")
    with pytest.raises(Exception, match="does not fit"):
        half.select(costs.commission("0.1")(F.col("q"), F.col("p"))).collect()


def test_zero_cost_and_lookback(spark):
    bars = spark.createDataFrame([("r", k * H, Decimal(p), Decimal(p), k) for k, p in enumerate((5, 7, 6, 8, 9, 4))], "run_id string, open_us long, open decimal(18,8), close decimal(18,8), k int")
    free = ledger.replay(bars, F.lit(1), H, cost=costs.zero())
    assert {r.cost for r in free.collect()} == {Decimal(0)}
    seen = F.when(F.count("*").over(ledger.until(0)) >= 5, 1).otherwise(0)  # looks at the whole run
    late = ledger.replay(bars, seen, H, lookback=None).orderBy("open_us")
    assert [r.position for r in late.collect()] == [0, 0, 0, 0, 0, 2]
