"""Tables with a key, written batch by batch: all of a batch or none, and the same batch twice is once.

Tables are folders of Parquet parts beside a folder of manifests; a manifest lists the parts of a
batch, and a commit adds the next one by a rename, which Hadoop's file systems do at once. One writer
at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan
from ..operators.quality import DAY
from ..schemas import CANDLE_KEY, CANDLES, COVERAGE, FUNDING, FUNDING_KEY, DataConflictError, assert_schema


def classify(batch: DataFrame, stored: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """One row per key of batch with `status`: new, duplicate (as stored, or repeated) or conflict."""
    pay = F.struct(*payload)
    inner = batch.groupBy(*key).agg(F.count("*").alias("rows"), F.min(pay).alias("lo"), F.max(pay).alias("hi"))
    old = stored.select(*key, pay.alias("old"))
    both = inner.join(old, key, "left")
    status = F.when((F.col("lo") != F.col("hi")) | (F.col("old").isNotNull() & (F.col("old") != F.col("lo"))), "conflict").when(F.col("old").isNotNull(), "duplicate").otherwise("new")
    return both.select(*key, "rows", status.alias("status"), F.col("lo").alias("row"))


class Folder:
    """A folder of tables: parts, and manifests that say which parts count.

    A manifest has a line (table, part, least and greatest time) for each part of one batch; a commit adds
    the next manifest, so parts of several tables appear together or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> int:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        return sum(not s.getPath().getName().startswith((".", "_")) for s in self._fs.listStatus(folder))

    def parts(self, table: str, start: int | None = None, end: int | None = None) -> list[str]:
        """Parts of a table, of those with a time span only ones that touch [start, end)."""
        if not self._manifests():
            return []
        cut = F.split("value", "\t")
        rows = self.spark.read.text(f"{self.path}/manifests").select(cut[0].alias("of"), cut[1].alias("part"), cut[2].try_cast("long").alias("lo"), cut[3].try_cast("long").alias("hi")).where(F.col("of") == table)
        if start is not None:
            rows = rows.where(F.col("hi").isNull() | ((F.col("hi") >= start) & (F.col("lo") < end)))
        return [f"{self.path}/{table}/{r.part}" for r in rows.select("part").collect()]  # a line for each batch

    def commit(self, *staged: tuple[str, str, int, int] | None) -> None:
        """Makes staged parts visible, all at once."""
        new = [p for p in staged if p]
        if not new:
            return
        number, aside = self._manifests(), f"{self.path}/manifests/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside))
        out.write(bytearray("".join("\t".join(map(str, p)) + "\n" for p in new).encode()))
        out.close()
        if not self._fs.rename(self._path(aside), self._path(f"{self.path}/manifests/{number:09d}.txt")):
            raise OSError("the manifest was written by another writer")


class KeyedStore:
    """One keyed table in a folder; `time` is the key's column by which parts and range queries are cut."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...], name: str = "parts", folder: Folder | None = None, time: tuple[str, str] | None = None):
        self.spark, self.schema, self.key, self.name = spark, schema, list(key), name
        self.payload = [f.name for f in schema if f.name not in key]
        self.folder = folder or Folder(spark, path)
        self.time = time or (key[-1], key[-1])

    def read(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """The rows of all parts, or of those that may have a time in [start, end).

        The parts' own schema must be the fixed one, and a null anywhere fails the query.
        """
        parts = self.folder.parts(self.name, start, end)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        assert_schema(self.spark.read.parquet(*parts), self.schema)
        return whole(self.spark.read.schema(self.schema).parquet(*parts))

    def stage(self, batch: DataFrame) -> tuple[str, str, int, int] | None:
        """Writes the new rows of batch aside and gives their manifest line, None for no row.

        Raises DataConflictError where a key comes with two payloads; nothing is visible yet. Only
        parts whose time span touches the batch's are read.
        """
        assert_schema(batch, self.schema)
        lo, hi = batch.agg(F.min(self.time[0]), F.max(self.time[1])).first()
        if lo is None:
            return None
        got = classify(whole(batch), self.read(lo, hi + 1), self.key, self.payload).persist()
        try:
            bad = got.where("status = 'conflict'").limit(1).collect()
            if bad:
                raise DataConflictError(f"another payload for {[bad[0][k] for k in self.key]}")
            new = got.where("status = 'new'").select(*self.key, "row.*").select(*self.schema.names)
            if new.isEmpty():
                return None
            part = uuid.uuid4().hex
            new.write.parquet(f"{self.folder.path}/{self.name}/{part}")
            return self.name, part, lo, hi
        finally:
            got.unpersist()

    def write(self, batch: DataFrame) -> None:
        self.folder.commit(self.stage(batch))

    def scanned(self, start_us: int, end_us: int, **ids: str) -> DataFrame:
        """Rows with these ids and a time in [start_us, end_us), in no order."""
        check_range(start_us, end_us)
        rows = self.read(start_us, end_us)
        for name, value in ids.items():
            rows = rows.where(F.col(name) == value)
        time = F.col(self.time[0])
        return rows.where((time >= start_us) & (time < end_us))

    def query(self, start_us: int, end_us: int, **ids: str) -> DataFrame:
        """scanned(), in order of the key."""
        return self.scanned(start_us, end_us, **ids).orderBy(*[c for c in self.key if c not in ids])


def whole(df: DataFrame) -> DataFrame:
    """df, failing as corrupt at a null."""
    found = lambda f: F.raise_error(F.lit(f"DataCorruptionError: a null in {f.name}")).cast(f.dataType)
    return df.select(*[F.when(F.col(f.name).isNotNull(), F.col(f.name)).otherwise(found(f)).alias(f.name) for f in df.schema])


def check_range(start_us: int, end_us: int) -> None:
    if start_us >= end_us:
        raise ValueError("start must be before end")


def candle_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, CANDLES, CANDLE_KEY)


class FundingStore:
    """Funding events and the intervals they were asked for; one manifest takes both of a batch or neither."""

    def __init__(self, spark: SparkSession, path: str):
        folder = Folder(spark, path)
        self.spark, self.folder = spark, folder
        self.events = KeyedStore(spark, path, FUNDING, FUNDING_KEY, "events", folder, ("event_us", "event_us"))
        self.coverage = KeyedStore(spark, path, COVERAGE, tuple(COVERAGE.names), "coverage", folder, ("start_us", "end_us"))

    def write(self, batch: DataFrame, exchange: str, market_type: str, symbol: str, start_us: int, end_us: int) -> None:
        """Writes events of one partition within [start, end) and that interval, with events or without."""
        if not all(x.strip() for x in (exchange, market_type, symbol)):
            raise ValueError("names must not be blank")
        check_range(start_us, end_us)
        own = (F.col("exchange") == exchange) & (F.col("market_type") == market_type) & (F.col("symbol") == symbol)
        if not batch.where(~(own & (F.col("event_us") >= start_us) & (F.col("event_us") < end_us))).isEmpty():
            raise ValueError("an event is outside the partition or the interval")
        row = self.spark.createDataFrame([(exchange, market_type, symbol, start_us, end_us)], COVERAGE)
        self.folder.commit(self.events.stage(batch), self.coverage.stage(row))

    def write_many(self, batch: DataFrame, intervals: DataFrame) -> None:
        """Writes events of many partitions and the intervals (of COVERAGE) that they were asked for, all or nothing.

        Each event must be in an interval of its own partition; an interval may have none.
        """
        name = F.concat_ws("\x1f", "exchange", "market_type", "symbol").alias("of")
        points = batch.select(name, F.col("event_us").alias("s"), (F.col("event_us") + 1).alias("e"), "rate_type")
        spans = intervals.select(name, F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
        inside = scan.overlaps(points, spans, "of", DAY)
        if not points.join(inside.select("of", "s", "rate_type").distinct(), ["of", "s", "rate_type"], "left_anti").isEmpty():
            raise ValueError("an event is outside the intervals")
        self.folder.commit(self.events.stage(batch), self.coverage.stage(intervals))

    def query_events(self, exchange: str, market_type: str, symbol: str, start_us: int, end_us: int) -> DataFrame:
        """Events in [start_us, end_us) by time and rate type."""
        return self.events.query(start_us, end_us, exchange=exchange, market_type=market_type, symbol=symbol)

    def coverage_of(self, start_us: int, end_us: int, **ids: str) -> DataFrame:
        """Intervals with these ids that overlap [start_us, end_us), as they are, in no order."""
        check_range(start_us, end_us)
        rows = self.coverage.read(start_us, end_us)
        for name, value in ids.items():
            rows = rows.where(F.col(name) == value)
        return rows.where((F.col("end_us") > start_us) & (F.col("start_us") < end_us))

    def query_coverage(self, exchange: str, market_type: str, symbol: str, start_us: int, end_us: int) -> DataFrame:
        """Intervals that overlap [start_us, end_us), as they are, by start and end."""
        return self.coverage_of(start_us, end_us, exchange=exchange, market_type=market_type, symbol=symbol).orderBy("start_us", "end_us")
