"""Bars, funding events and coverage intervals derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import duration_us, floor_to, us_of


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", us_of(F.col("ts")).alias("ts_us"), "user_id", F.col("event_type").alias("symbol"), F.col("value").cast("decimal(18,2)").alias("value"))


def candles(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """(symbol, open_us, open, high, low, close, volume): bars by event type; ties in time by id."""
    at = F.struct("ts_us", "event_id")
    rows = events(spark, sf_dir).withColumn("open_us", floor_to(F.col("ts_us"), duration_us(timeframe)))
    return rows.groupBy("symbol", "open_us").agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count("*").alias("volume"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, event_us, rate_type, funding_rate, reference_price), one row per key."""
    rate = ((F.col("event_id") % 21 - 10).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(6,6)")).cast("decimal(18,6)")
    rows = events(spark, sf_dir).select(
        "symbol",
        F.col("ts_us").alias("event_us"),
        F.when(F.col("event_id") % 2 == 0, "Regular").otherwise("Special").alias("rate_type"),
        "event_id",
        rate.alias("funding_rate"),
        (F.lit(100) + F.col("event_id") % 7).cast("decimal(18,2)").alias("reference_price"),
    )
    first = rows.groupBy("symbol", "event_us", "rate_type").agg(F.min_by(F.struct("funding_rate", "reference_price"), "event_id").alias("p"))
    return first.select("symbol", "event_us", "rate_type", "p.funding_rate", "p.reference_price")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, start_us, end_us): an interval of some minutes from each event on."""
    return events(spark, sf_dir).select("symbol", F.col("ts_us").alias("start_us"), (F.col("ts_us") + (F.lit(1) + F.col("event_id") % 90) * 60_000_000).alias("end_us"))


def ranges(bars: DataFrame, dur: int) -> DataFrame:
    """(symbol, start_us, end_us): from each symbol's first bar to the end of its last."""
    return bars.groupBy("symbol").agg(F.min("open_us").alias("start_us"), (F.max("open_us") + dur).alias("end_us"))
