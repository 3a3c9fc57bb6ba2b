"""Metrics in decimals of 28 digits; faults are errors.

The checks come before any arithmetic, in a fixed order: initial cash, then the points (there are some,
ascending, finite), then for returns the denominators, and for stage 2 the rate and the count. The functions
*_of are for one curve at hand. `metrics` is for many curves of any length: each return is rounded to 28 digits
where its point is, as an integer of 1e-28 in four limbs; sums of limbs and of their products are exact and merge
in any order, and are divided and rooted once for each curve. So mean and deviation are the exact ones, rounded once,
where a running sum of 28 digits rounds at every point. The first fault of a curve is the least (check, point).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .metrics import in_blocks

#: Type of points, digits of a limb and the limbs of a return in units of 1e-28.
POINT, LIMB, LIMBS, UNIT = "decimal(38,18)", 10, 4, 28

def _digits() -> Context:
    return Context(prec=28, rounding=ROUND_HALF_EVEN, Emin=-999999, Emax=999999, capitals=1, clamp=0, traps=[])


def _finite(name: str, *values: Decimal) -> None:
    for x in values:
        if not x.is_finite():
            raise ValueError(f"{name} must be finite: {x}")


def check_curve(initial: Decimal, times: Sequence[int], equity: Sequence[Decimal]) -> None:
    _finite("initial cash", initial)
    if initial <= 0:
        raise ValueError("initial cash must be positive")
    if not len(equity):
        raise ValueError("the curve is empty")
    for k, x in enumerate(equity):
        _finite(f"equity at {k}", x)
        if k and times[k] <= times[k - 1]:
            raise ValueError("the curve's times must ascend")


def returns_of(initial: Decimal, times: Sequence[int], equity: Sequence[Decimal]) -> list[Decimal]:
    """As many returns as points; every point but the last is a denominator and must be positive."""
    check_curve(initial, times, equity)
    for k, x in enumerate(equity[:-1]):
        if x <= 0:
            raise ValueError(f"equity at {k} is the denominator of return {k + 1} and must be positive: {x}")
    with localcontext(_digits()):
        out = [x / before - 1 for before, x in zip([initial, *equity[:-1]], equity, strict=True)]
    for k, x in enumerate(out):
        _finite(f"return {k}", x)
    return out


def stage1_of(initial: Decimal, times: Sequence[int], equity: Sequence[Decimal]) -> tuple[Decimal, Decimal]:
    """(total return, greatest drawdown from a peak that starts at the initial cash)."""
    check_curve(initial, times, equity)
    with localcontext(_digits()):
        total, peak, worst = equity[-1] / initial - 1, initial, Decimal(0)
        for x in equity:
            peak = max(peak, x)
            worst = max(worst, (peak - x) / peak)
    _finite("total return", total)
    _finite("drawdown", worst)
    return total, worst


def stage2_of(initial: Decimal, times: Sequence[int], equity: Sequence[Decimal], risk_free: Decimal = Decimal(0)) -> tuple[Decimal, Decimal, Decimal]:
    """(mean return, sample deviation, mean over the risk-free rate by deviation), per point."""
    returns = returns_of(initial, times, equity)
    _finite("the risk-free rate", risk_free)
    if len(returns) < 2:
        raise ValueError("at least two returns are needed")
    with localcontext(_digits()):
        mean = sum(returns, Decimal(0)) / Decimal(len(returns))
        spread = (sum(((x - mean) * (x - mean) for x in returns), Decimal(0)) / Decimal(len(returns) - 1)).sqrt()
        _finite("a statistic", mean, spread)
        if spread <= 0:
            raise ValueError("the deviation must be positive")
        sharpe = (mean - risk_free) / spread
    _finite("the ratio", sharpe)
    return mean, spread, sharpe


def _limbs(value: Decimal) -> list[int]:
    left, out = int(value.scaleb(UNIT, Context(prec=99))), []
    sign = -1 if left < 0 else 1
    left = abs(left)
    for _ in range(LIMBS):
        left, low = divmod(left, 10**LIMB)
        out.append(sign * low)
    if left:
        raise ValueError(f"a return is too large: {value}")
    return out


def _ordered(value: Decimal) -> tuple[int, Decimal]:
    """A number that is not negative as (exponent, 28 digits), which compare as it does."""
    if not value:
        return -(10**6), Decimal(0)
    return value.adjusted(), Decimal(value.scaleb(27 - value.adjusted(), Context(prec=60)))


def _per_point(point: Column, before: Column, peak: Column) -> Column:
    @F.pandas_udf("l0 long, l1 long, l2 long, l3 long, size int, digits decimal(28,0)")
    def run(point: pd.Series, before: pd.Series, peak: pd.Series) -> pd.DataFrame:
        rows = []
        with localcontext(_digits()):
            for x, b, p in zip(point, before, peak, strict=True):
                rows.append((*(_limbs(x / b - 1) if x is not None and b is not None and b > 0 else [None] * LIMBS), *(_ordered((p - x) / p) if x is not None else (None, None))))
        return pd.DataFrame(rows, columns=["l0", "l1", "l2", "l3", "size", "digits"]).astype({f"l{k}": "Int64" for k in range(LIMBS)} | {"size": "Int32"})

    return run(point, before, peak)


def _whole(limbs: Sequence[Decimal | int]) -> int:
    return sum(int(x) * 10 ** (LIMB * k) for k, x in enumerate(limbs))


def mean_and_spread(n: int, total: int, squares: int) -> tuple[Decimal, Decimal]:
    """Mean and sample deviation of n numbers in units of 1e-28 with this sum and sum of squares, each rounded once."""
    wide = Context(prec=len(str(n * squares)) + 80, rounding=ROUND_HALF_EVEN)
    mean = _digits().plus(wide.divide(Decimal(total), Decimal(n)).scaleb(-UNIT, wide))
    variance = wide.divide(Decimal(n * squares - total * total), Decimal(n * (n - 1)))
    return mean, _digits().plus(wide.sqrt(variance).scaleb(-UNIT, wide))


def _of_run(initial: Decimal, risk_free: Decimal, stage2: bool) -> Callable[..., Column]:
    """(total_return, max_drawdown, mean_return, return_stdev, sharpe_ratio, flat) of a run's sums, as text."""

    @F.pandas_udf("total_return string, max_drawdown string, mean_return string, return_stdev string, sharpe_ratio string, flat boolean")
    def run(last: pd.Series, size: pd.Series, digits: pd.Series, n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
        rows = []
        with localcontext(_digits()):
            for final, s, d, k, one, two in zip(last, size, digits, n, sums, products, strict=True):
                worst = Decimal(0) if not d else Decimal(d).scaleb(int(s) - 27, Context(prec=60)).normalize(_digits())
                out = [str(final / initial - 1), format(worst, "f")]
                if not stage2 or k < 2:
                    rows.append((*out, None, None, None, False))
                    continue
                squares = sum((1 + (i != j)) * int(two[at]) * 10 ** (LIMB * (i + j)) for at, (i, j) in enumerate(_PAIRS))
                mean, spread = mean_and_spread(int(k), _whole(one), squares)
                rows.append((*out, str(mean), str(spread), str((mean - risk_free) / spread) if spread > 0 else None, spread <= 0))
        return pd.DataFrame(rows, columns=["total_return", "max_drawdown", "mean_return", "return_stdev", "sharpe_ratio", "flat"])

    return run


_PAIRS = [(i, j) for i in range(LIMBS) for j in range(i, LIMBS)]


def metrics(curve: DataFrame, initial: str = "1000", risk_free: str = "0", stage2: bool = True, strict: bool = True) -> DataFrame:
    """(run_id, total_return, max_drawdown[, mean_return, return_stdev, sharpe_ratio], fault) as text.

    Points are decimals, or texts of them, of at most 18 places. strict: a fault fails the query; else it is
    named in `fault` and the run has nulls.
    """
    names = ["total_return", "max_drawdown", *(["mean_return", "return_stdev", "sharpe_ratio"] if stage2 else [])]
    start, rate = Decimal(initial), Decimal(risk_free)
    rows = in_blocks(curve.select(*(c for c in ("run_id", "open_us", scan.BLOCK) if c in curve.columns), F.col("equity").cast("string").alias("said")))
    narrow = F.when(F.col("said").rlike(r"\.[0-9]{18}[0-9]*[1-9]"), F.raise_error(F.concat(F.lit("a point has more than 18 places: "), F.col("said"))).cast(POINT))
    rows = rows.withColumn("e", narrow.otherwise(F.col("said").try_cast(POINT))).withColumn("own", F.struct("e", "said", "open_us"))
    order = scan.within("run_id", "open_us")
    so_far = order.rowsBetween(scan.Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.row_number().over(order)).withColumn("near", F.lag("own").over(order)).withColumn("top", F.max("e").over(so_far))
    rows = scan.with_earlier(rows, "run_id", "open_us", points=("sum", F.lit(1)), far=("last", F.col("own")), peak=("max", F.col("e")))
    before, at = F.coalesce("near", "far"), F.coalesce("points", F.lit(0)) + F.col("turn") - 1
    rows = rows.select("run_id", "open_us", "e", "said", at.alias("at"), before.alias("before"), F.greatest(F.lit(start if start.is_finite() else 1).cast(POINT), "peak", "top").alias("peak"))
    as_fault = lambda rank, k, text: F.struct(F.lit(rank).alias("rank"), k.alias("at"), text.alias("text"))
    of_point = F.when(F.col("e").isNull(), as_fault(2, 2 * F.col("at"), F.concat(F.lit("equity at "), F.col("at").cast("string"), F.lit(" must be finite: "), F.coalesce("said", F.lit("None")))))
    of_point = of_point.when(F.col("before.open_us") >= F.col("open_us"), as_fault(2, 2 * F.col("at") + 1, F.lit("the curve's times must ascend")))
    denominator = F.concat(F.lit("equity at "), (F.col("at") - 1).cast("string"), F.lit(" is the denominator of return "), F.col("at").cast("string"), F.lit(" and must be positive: "), F.col("before.said"))
    of_return = F.when(F.col("before.e") <= 0, as_fault(3, F.col("at"), denominator))
    rows = rows.withColumn("of_point", of_point).withColumn("of_return", of_return if stage2 else F.lit(None).cast("struct<rank: int, at: bigint, text: string>"))
    first = F.col("before").isNull()
    base = F.when(first, F.lit(start if start.is_finite() else 1).cast(POINT)).otherwise(F.col("before.e"))
    rows = rows.withColumn("p", _per_point(F.col("e"), base, F.col("peak")))
    limb = [F.col(f"p.l{k}").cast(f"decimal({LIMB},0)") for k in range(LIMBS)]
    got = rows.groupBy("run_id").agg(
        F.max_by("e", "open_us").alias("last"),
        F.max(F.struct("p.size", "p.digits")).alias("worst"),
        F.count("*").alias("n"),
        F.array(*[F.sum(x).cast("decimal(38,0)") for x in limb]).alias("sums"),
        F.array(*[F.sum(limb[i] * limb[j]).cast("decimal(38,0)") for i, j in _PAIRS]).alias("products"),
        F.min("of_point").alias("of_point"),
        F.min("of_return").alias("of_return"),
    )
    said = F.coalesce(F.col("of_point.text"), F.col("of_return.text"))
    for name, value, bad in (("the risk-free rate", rate, not rate.is_finite()), ("initial cash", start, not start.is_finite())):
        if bad and (stage2 or name == "initial cash"):
            text = F.lit(f"{name} must be finite: {value}")
            said = F.coalesce(said, text) if name != "initial cash" else text
    if start.is_finite() and start <= 0:
        said = F.lit("initial cash must be positive")
    if stage2:
        said = F.coalesce(said, F.when(F.col("n") < 2, F.lit("at least two returns are needed")))
    got = got.withColumn("said", said)
    ok = F.col("said").isNull()
    safe = _of_run(start if start.is_finite() and start > 0 else Decimal(1), rate if rate.is_finite() else Decimal(0), stage2)
    last = F.when(ok, F.col("last")).otherwise(F.lit(1).cast(POINT))
    zeros = lambda c, k: F.when(ok, F.col(c)).otherwise(F.array(*[F.lit(0).cast("decimal(38,0)")] * k))
    got = got.withColumn("m", safe(last, F.col("worst.size"), F.col("worst.digits"), F.col("n"), zeros("sums", LIMBS), zeros("products", len(_PAIRS))))
    fault = F.coalesce("said", F.when(F.col("m.flat"), F.lit("the deviation must be positive"))) if stage2 else F.col("said")
    got = got.withColumn("fault", fault)
    if strict:
        got = got.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("string")))
    return got.select("run_id", *[F.when(F.col("fault").isNull(), F.col(f"m.{c}")).alias(c) for c in names], "fault")
