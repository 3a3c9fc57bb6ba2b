"""Ordered work along a key that may hold most rows: in blocks of the order, and over what blocks hand on.

A window over a key and a block of it is a task's work whatever the key has. What a row needs from before its
block is a fold over the earlier blocks, one row each, which comes back by a join on key and block; rows
already lie by both, so only the folds travel. Where a row looks a fixed time back, rows near the end of a
block are copied into the next ones instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of the grid that a block spans, and rows that it has on average where the order is no grid.
SLOTS = 64
BLOCK, COPIED = "_block", "_copied"


def slot_block(us: Column, dur: int) -> Column:
    """The block that a time is in."""
    span = F.lit(SLOTS * dur)
    return F.call_function("div", us - F.pmod(us, span), span)


def blocked(rows: DataFrame, dur: int, time: str = "open_us", back: int = 0) -> DataFrame:
    """rows with their block, each also in the blocks that begin up to `back` slots after it, marked as copied."""
    own = slot_block(F.col(time), dur)
    if not back:
        return rows.withColumn(BLOCK, own)
    to = slot_block(F.col(time) + back * dur, dur)
    return rows.withColumn("_own", own).withColumn(BLOCK, F.explode(F.sequence("_own", to))).withColumn(COPIED, F.col(BLOCK) != F.col("_own")).drop("_own")


def leading(kind: T.DataType, value: Column) -> Column:
    """The first number that an order by value goes by."""
    while isinstance(kind, T.StructType):
        value, kind = value.getField(kind[0].name), kind[0].dataType
    return F.floor(value.cast("decimal(38,0)") if isinstance(kind, T.DecimalType) else value).cast("long")


def cut(rows: DataFrame, pos: str) -> DataFrame:
    """rows with a block, by equal steps of the first number of pos, as many as there are SLOTS of rows.

    One pass over that number finds its span. Rows of one number are in one block.
    """
    at = leading(rows.schema[pos].dataType, F.col(pos))
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, n // SLOTS)))
    return rows.withColumn(BLOCK, F.coalesce(F.call_function("div", at - F.lit(low or 0), F.lit(step)), F.lit(-1)))


def within(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key, BLOCK).orderBy(order)


#: A fold of a block's values, and of blocks' folds: of sums, maxima, and the last value that is not null.
FOLDS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]] = {
    "sum": (lambda c, order: F.sum(c), F.sum),
    "max": (lambda c, order: F.max(c), F.max),
    "last": (lambda c, order: F.max_by(c, F.when(c.isNotNull(), order)), lambda c: F.last(c, True)),
}


def handed_on(rows: DataFrame, key: str, order: str, **parts: tuple[str, Column]) -> DataFrame:
    """(key, block, *parts): each part, (fold, value), over all earlier blocks of the key; null in the first."""
    each = rows.groupBy(key, BLOCK).agg(*[FOLDS[how][0](value, F.col(order)).alias(name) for name, (how, value) in parts.items()])
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, BLOCK, *[FOLDS[how][1](F.col(name)).over(earlier).alias(name) for name, (how, _) in parts.items()])


def with_earlier(rows: DataFrame, key: str, order: str, **parts: tuple[str, Column]) -> DataFrame:
    """rows with what handed_on gives their block."""
    return rows.join(handed_on(rows, key, order, **parts), [key, BLOCK])


def with_previous(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows, which have a block, with the value of the row before by order, whichever block it is in."""
    own = rows.withColumn("_value", F.struct(value.alias("v")))
    near = own.withColumn("_near", F.lag("_value").over(within(key, order)))
    return with_earlier(near, key, order, _far=("last", F.col("_value"))).withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_value", "_near", "_far")


def counted(rows: DataFrame, key: str, pos: str, own: Column, tests: dict[str, Callable[[Column, Column], Column]], **more: Column) -> DataFrame:
    """A row per key: for how many rows each test of the value before by pos and the own one holds, and sums of `more`.

    Blocks count inside themselves; a block's first value and the last before it are compared once they are few.
    """
    holds = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    near = cut(rows, pos).withColumn("_own", own)
    near = near.withColumn("_before", F.lag("_own").over(within(key, pos)))
    each = near.groupBy(key, BLOCK).agg(
        F.min_by("_own", pos).alias("_first"),
        F.max_by("_own", pos).alias("_last"),
        *[F.sum(holds(test(F.col("_before"), F.col("_own")))).alias(name) for name, test in tests.items()],
        *[F.sum(holds(c)).alias(name) for name, c in more.items()],
    )
    each = each.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy(BLOCK)))
    edge = lambda test: holds(test(F.col("_before"), F.col("_first")))
    return each.groupBy(key).agg(*[F.sum(F.col(name) + edge(test)).alias(name) for name, test in tests.items()], *[F.sum(name).alias(name) for name in more])


def with_next(rows: DataFrame, key: str, back: list[Column], value: Column, name: str) -> DataFrame:
    """rows, which have a block, with the first value that is not null at or after each in time, in any block.

    back orders rows from the last to the first: a window that ends at its row is carried on from row to row, one
    that begins there is read anew for each. Values do not ascend along it, so a block's first one in time is its least.
    """
    on = Window.partitionBy(key, BLOCK).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_value", value).withColumn("_near", F.last("_value", True).over(on))
    each = near.groupBy(key, BLOCK).agg(F.min("_value").alias("_first"))
    later = Window.partitionBy(key).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    far = each.select(key, BLOCK, F.last("_first", True).over(later).alias("_far"))
    return near.join(far, [key, BLOCK]).withColumn(name, F.coalesce("_near", "_far")).drop("_value", "_near", "_far")


def overlaps(left: DataFrame, right: DataFrame, key: str, bin_us: int) -> DataFrame:
    """Each pair of an interval of left (key, s, e) and one of right (key, lo, hi) that meet, once; both half-open.

    Intervals are put in every bin of time that they touch, and a pair is found in the first that both do, so a key
    with very many intervals is as many groups as it has bins. Empty intervals meet nothing.
    """
    at = lambda us: F.call_function("div", us - F.pmod(us, F.lit(bin_us)), F.lit(bin_us))
    bins = lambda rows, a, b: rows.where(F.col(a) < F.col(b)).withColumn("_bin", F.explode(F.sequence(at(F.col(a)), at(F.col(b) - 1))))
    both = bins(left, "s", "e").join(bins(right, "lo", "hi"), [key, "_bin"])
    return both.where((F.col("s") < F.col("hi")) & (F.col("e") > F.col("lo")) & (F.col("_bin") == F.greatest(at(F.col("s")), at(F.col("lo"))))).drop("_bin")
