"""Numbers of any scale as columns of limbs: exact products, sums and comparisons where one decimal is too narrow.

A number is an array of signed limbs of 18 digits, the lowest first, over ten to a power, its scale. The scale
and the count of limbs are known when a query is written. A result gets as many limbs as it may need; sums are
exact for 10 ** 18 rows.

Each operation names its arguments once: an expression inside a lambda function is computed wherever it is named, so
one that is named twice by every operation is computed 2 ** depth times a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 18
_BASE = 10**DIGITS
#: Types of a limb of its own size, and of what limbs add and multiply to.
_LIMB, _SUM = f"decimal({DIGITS},0)", "decimal(38,0)"
#: Products of limbs that one sum holds.
_MOST = 9
NUMBER = r"^([+-]?)([0-9]+)(?:\.([0-9]*))?$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _number(x: int) -> Column:
    return F.lit(Decimal(x)).cast(_SUM)


def _pair(low: Column, high: Column) -> Column:
    return F.struct(low.alias("out"), high.cast(_SUM).alias("over"))


def _through(limbs: Column, step: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Limbs changed from the lowest up: step says of a limb, with what came over, its new value and what goes over."""

    def one(acc: Column, x: Column) -> Column:
        low, high = step((x + acc["over"]).cast(_SUM))
        return _pair(F.concat(acc["out"], F.array(low.cast(_SUM))), high)

    return F.aggregate(limbs, _pair(F.array().cast(f"array<{_SUM}>"), _number(0)), one)["out"]


def _split(x: Column) -> tuple[Column, Column]:
    return x % _number(_BASE), F.call_function("div", x, _number(_BASE))


@dataclass(frozen=True)
class Wide:
    """limbs: an array column of `count` limbs under 10 ** 18 in size, lowest first; scale: decimal places; value: a
    constant's, without them."""

    limbs: Column
    count: int
    scale: int
    value: int | None = None

    @classmethod
    def of(cls, text: Column, scale: int, whole: int = 18) -> Wide:
        """The number of a plain decimal text or column, of at most `scale` places and `whole` digits before them.

        A null stays null; what is no number or does not fit fails the query.
        """
        count = -(-(scale + whole) // DIGITS)
        size = count * DIGITS

        def digits(text: Column) -> Column:
            parts = F.struct(F.ltrim(F.regexp_extract(text, NUMBER, 2), F.lit("0")).alias("whole"), F.rtrim(F.regexp_extract(text, NUMBER, 3), F.lit("0")).alias("places"))

            def laid(p: Column) -> Column:
                bad = ~text.rlike(NUMBER) | (F.length(p["places"]) > scale) | (F.length(p["whole"]) + scale > size)
                out = F.concat(p["whole"], F.rpad(p["places"], scale, "0") if scale else F.lit(""))
                return F.when(bad, F.raise_error(F.concat(F.lit("no number of this width: "), text)).cast("string")).otherwise(F.lpad(out, size, "0"))

            return _let(parts, laid)

        def limbs(text: Column) -> Column:
            cut = lambda d: F.array(*[F.substring(d, size - DIGITS * (k + 1) + 1, DIGITS).cast(_SUM) for k in range(count)])
            return F.transform(_let(digits(text), cut), lambda x: F.when(F.substring(text, 1, 1) == "-", -x).otherwise(x).cast(_SUM))

        return cls(_let(text.cast("string"), lambda t: F.when(t.isNotNull(), limbs(t))), count, scale)

    @classmethod
    def constant(cls, number: Decimal | int | str) -> Wide:
        sign, digits, exponent = Decimal(number).as_tuple()
        value = int("".join(map(str, digits))) * 10 ** max(exponent, 0)
        return cls._constant(-value if sign else value, max(-exponent, 0))

    @classmethod
    def _constant(cls, value: int, scale: int) -> Wide:
        left, limbs = abs(value), []
        while left or not limbs:
            left, low = divmod(left, _BASE)
            limbs.append(_number(-low if value < 0 else low))
        return cls(F.array(*limbs), len(limbs), scale, value)

    def at_scale(self, scale: int) -> Wide:
        """The same number with more places."""
        if scale < self.scale:
            raise ValueError("a scale can only grow")
        if scale == self.scale:
            return self
        if self.value is not None:
            return Wide._constant(self.value * 10 ** (scale - self.scale), scale)
        more = self * Wide.constant(10 ** (scale - self.scale))
        return Wide(more.limbs, more.count, scale)

    def __mul__(self, other: Wide) -> Wide:
        if min(self.count, other.count) > _MOST:
            raise ValueError("too many limbs")

        def product(p: Column) -> Column:
            sums = []
            for k in range(self.count + other.count - 1):
                total = _number(0)
                for i in range(max(0, k - other.count + 1), min(k + 1, self.count)):
                    total = (total + (F.get(p["a"], F.lit(i)).cast(_LIMB) * F.get(p["b"], F.lit(k - i)).cast(_LIMB)).cast(_SUM)).cast(_SUM)
                sums.append(total)
            return F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.array(*sums))

        both = _let(F.struct(self.limbs.alias("a"), other.limbs.alias("b")), product)
        return Wide(both, self.count + other.count - 1, self.scale + other.scale).carried(1)

    def __add__(self, other: Wide) -> Wide:
        scale = max(self.scale, other.scale)
        a, b = self.at_scale(scale), other.at_scale(scale)
        both = F.zip_with(a.limbs, b.limbs, lambda x, y: (F.coalesce(x, _number(0)) + F.coalesce(y, _number(0))).cast(_SUM))
        return Wide(both, max(a.count, b.count), scale).carried(1)

    def __neg__(self) -> Wide:
        if self.value is not None:
            return Wide._constant(-self.value, self.scale)
        return Wide(F.transform(self.limbs, lambda x: (-x).cast(_SUM)), self.count, self.scale)

    def __sub__(self, other: Wide) -> Wide:
        return self + -other

    def carried(self, more: int = 0) -> Wide:
        """Limbs under 10 ** 18 in size, `more` of them for what is carried over."""
        limbs = F.concat(self.limbs, F.array(*[_number(0)] * more)) if more else self.limbs
        return Wide(_through(limbs, _split), self.count + more, self.scale)

    def sign(self) -> Column:
        """-1, 0 or 1: that of the highest limb that is not 0."""
        return F.aggregate(self.limbs, F.lit(0), lambda acc, x: F.when(x > 0, 1).when(x < 0, -1).otherwise(acc))

    def compared(self, other: Wide) -> Column:
        """-1, 0 or 1 as this is less than, equal to or greater than other."""
        return (self - other).sign()

    def text(self) -> Column:
        """The number in plain digits, with as many places as its scale."""
        width = max(self.count * DIGITS, self.scale + 1)

        def plain(p: Column) -> Column:
            borrow = lambda x: (F.when(x < 0, x + _number(_BASE)).otherwise(x), F.when(x < 0, _number(-1)).otherwise(_number(0)))
            limbs = _through(F.transform(p["limbs"], lambda x: (x * p["sign"]).cast(_SUM)), borrow)
            digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), DIGITS, "0")), "")
            whole = lambda d: F.regexp_replace(F.substring(d, 1, width - self.scale), "^0+(?=[0-9])", "")
            places = lambda d: [F.lit("."), F.substring(d, width - self.scale + 1, self.scale)] if self.scale else []
            out = _let(F.lpad(digits, width, "0"), lambda d: F.concat(F.when(p["sign"] < 0, "-").otherwise(""), whole(d), *places(d)))
            return F.when(p["limbs"].isNotNull(), out)

        own = _let(self.limbs, lambda v: F.struct(v.alias("limbs"), Wide(v, self.count, self.scale).sign().alias("sign")))
        return _let(own, plain)


def summed(rows: DataFrame, keys: list[str], values: dict[str, Wide], *more: Column) -> DataFrame:
    """keys, the text of each value's exact sum, and further aggregates; partial sums merge limb by limb."""
    got = rows.select("*", *[w.limbs.alias(f"_{name}") for name, w in values.items()])
    sums = [F.array(*[F.sum(F.get(f"_{name}", F.lit(k)).cast("decimal(28,0)")).cast(_SUM) for k in range(w.count)]).alias(f"_{name}") for name, w in values.items()]
    got = got.groupBy(*keys).agg(*sums, *more)
    totals = [Wide(F.col(f"_{name}"), w.count, w.scale).carried(2).text().alias(name) for name, w in values.items()]
    return got.select(*[c for c in got.columns if c not in {f"_{name}" for name in values}], *totals)
