"""Cost and funding models: builders of columns over quantity and price."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CostModel = Callable[[Column, Column], Column]
#: Of signed quantity and funding due.
FundingModel = Callable[[Column, Column], Column]
#: Type of every term of the ledger: a price of 8 places times a rate of 10 is exact, and so are sums.
MONEY = "decimal(37,18)"
#: Types of what is multiplied: a notional, a rate, and the funding due for one unit.
NOTIONAL, RATE, DUE = "decimal(26,8)", "decimal(11,10)", "decimal(27,18)"


def _rate(rate: Decimal | str) -> Decimal:
    got = Decimal(rate)
    if not got.is_finite() or got < 0:
        raise ValueError(f"a rate must be finite and not negative: {rate}")
    if got >= 10 or got != got.quantize(Decimal(1).scaleb(-10)):
        raise ValueError(f"a rate is under 10 and has 10 places at most: {rate}")
    return got


def fitting(number: Column, kind: str, what: str) -> Column:
    """number as a type that holds it without rounding; else the query fails."""
    got = number.try_cast(kind)
    return F.when(number.isNull() | (got == number), got).otherwise(F.raise_error(F.lit(f"{what} does not fit {kind}")).cast(kind))


def zero() -> CostModel:
    return lambda quantity, price: F.lit(0).cast(MONEY)


def proportional(rate: Decimal | str) -> CostModel:
    """quantity * price * rate: a commission, half a spread, or slippage."""
    r = _rate(rate)
    return lambda quantity, price: (fitting(quantity * price, NOTIONAL, "a notional") * F.lit(r).cast(RATE)).cast(MONEY)


commission = half_spread = slippage = proportional


def fixed_per_fill(cost: Decimal | str) -> CostModel:
    c = Decimal(cost)
    return lambda quantity, price: F.lit(c).cast(MONEY)


def composite(*models: CostModel) -> CostModel:
    """The sum of models from left to right; of none, zero."""
    return lambda quantity, price: reduce(lambda a, m: (a + m(quantity, price)).cast(MONEY), models, F.lit(0).cast(MONEY))


def linear(quantity: Column, funding: Column) -> Column:
    """What a position pays of the rates times reference prices due: positive for a long one at positive rates."""
    return quantity * funding


def by_function(cost: Callable[[Decimal, Decimal], Decimal]) -> CostModel:
    """A model from a Python function of quantity and price, in batches; built-in columns are the fast way."""

    @F.pandas_udf(MONEY)
    def run(quantity: pd.Series, price: pd.Series) -> pd.Series:
        return pd.Series([cost(Decimal(str(q)), Decimal(str(p))) for q, p in zip(quantity, price, strict=True)], dtype=object)

    return lambda quantity, price: run(quantity.cast("decimal(18,8)"), price.cast("decimal(18,8)"))


def funding_due(reference_price: Column, rate: Column) -> Column:
    """Reference price times rate; a price that is not positive fails the query."""
    good = F.when(reference_price > 0, reference_price).otherwise(F.raise_error(F.lit("a reference price must be positive")).cast("decimal(18,8)"))
    return fitting(good.cast("decimal(18,8)") * rate.cast("decimal(18,10)"), DUE, "funding due")
