"""Pages of a paged source: order, duplicates, conflicts, retries, and an offline data source."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

R = TypeVar("R")
#: Rows that one page has at most, and attempts for a page.
PAGE, ATTEMPTS = 1000, 3


def with_retry(operation: Callable[[], R], attempts: int = ATTEMPTS) -> R:
    """operation(), tried again on a ConnectionError only, without a pause."""
    if isinstance(attempts, bool) or not isinstance(attempts, int) or attempts < 1:
        raise ValueError("attempts must be a positive int")
    for left in range(attempts - 1, -1, -1):
        try:
            return operation()
        except ConnectionError:
            if not left:
                raise
    raise AssertionError


def paginate(fetch: Callable[[int, int], list], start: int, end: int, time_of: Callable[[object], int], step: int) -> list:
    """All rows in [start, end) of a source that gives pages from a cursor on.

    Times ascend in a page and none is before the cursor, which moves past the last by `step`; an empty
    page ends it, a short one does not. A page that does not get on is an error.
    """
    if start >= end:
        raise ValueError("start must be before end")
    out, cursor = [], start
    while cursor < end:
        page = with_retry(lambda at=cursor: fetch(at, end))
        if not page:
            break
        times = [time_of(r) for r in page]
        if times[0] < cursor or any(b <= a for a, b in zip(times, times[1:], strict=False)):
            raise ValueError("a page is out of order")
        if times[-1] + step <= cursor:
            raise ValueError("a page makes no progress")
        out += [r for r, t in zip(page, times, strict=True) if t < end]
        cursor = times[-1] + step
    return out


def funding_history(fetch: Callable[[int, int], list], start: int, end: int, key_of: Callable[[dict], tuple[int, str]], payload_of: Callable[[dict], object]) -> list:
    """All records in [start, end], both included, of a source that gives pages from a cursor on.

    The next page starts at the last time again, so records of one time may be split between pages.
    In a page times do not descend and keys (time, kind) are single; over pages a key seen with the
    same payload is dropped, with another it is an error, as is a full page without a new key. A page
    that is not full is the last.
    """
    if not 0 <= start <= end:
        raise ValueError("start must not be negative or after end")
    seen: dict[tuple[int, str], object] = {}
    out, cursor = [], start
    while True:
        page = with_retry(lambda at=cursor: fetch(at, end))
        if len(page) > PAGE:
            raise ValueError(f"a page has more than {PAGE} records")
        keys = [key_of(r) for r in page]
        times = [k[0] for k in keys]
        if any(not cursor <= t <= end for t in times):
            raise ValueError("a record is outside the range that was asked for")
        if any(b < a for a, b in zip(times, times[1:], strict=False)):
            raise ValueError("a page is out of order")
        if len(set(keys)) < len(keys):
            raise ValueError("a page has a key twice")
        new = []
        for k, r in zip(keys, page, strict=True):
            if k not in seen:
                new.append((k, r))
            elif seen[k] != payload_of(r):
                raise ValueError(f"key {k} came with two payloads")
        if len(page) == PAGE and not new:
            raise ValueError("a full page makes no progress")
        seen |= {k: payload_of(r) for k, r in new}
        out += [r for _, r in new]
        if len(page) < PAGE:
            return out
        cursor = times[-1]


def merged_pages(pages: DataFrame, key: list[str], payload: list[str], page: str = "page_no") -> DataFrame:
    """One row per key with `status`: ok, page_duplicate (twice in one page) or conflict."""
    by_page = pages.groupBy(*key, page).agg(F.count("*").alias("n"), F.min(F.struct(*payload)).alias("lo"), F.max(F.struct(*payload)).alias("hi"))
    got = by_page.groupBy(*key).agg(F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("pages"))
    status = F.when(F.col("most") > 1, "page_duplicate").when(F.col("lo") != F.col("hi"), "conflict").otherwise("ok")
    return got.select(*key, "pages", status.alias("status"))


def page_order_faults(pages: DataFrame, *key: str, page: str = "page_no", pos: str = "pos", strict: bool = True) -> DataFrame:
    """(page, faults): rows of a page whose key is not after (strict) or is before that of the row above them."""
    own = F.struct(*key)
    before = F.lag(own).over(Window.partitionBy(page).orderBy(pos))
    bad = before >= own if strict else before > own
    return pages.withColumn("_bad", bad).groupBy(page).agg(F.count_if("_bad").alias("faults"))


class FixturePages(DataSource):
    """Rows of JSON pages in a folder: spark.read.format("fixture_pages").load(folder).

    Each file is a page and a partition of its own; a row is one JSON array or object as text.
    """

    @classmethod
    def name(cls) -> str:
        return "fixture_pages"

    def schema(self) -> str:
        return "page_no int, pos int, raw string"

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path")
        if not path or not path.strip():
            raise ValueError("a path is needed")
        return _PageReader(path)


class _Page(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.files = sorted(str(p) for p in Path(path).glob("*.json"))

    def partitions(self):
        return [_Page(k, p) for k, p in enumerate(self.files)]

    def read(self, partition):
        def load():
            try:
                return json.loads(Path(partition.path).read_text())
            except OSError as e:
                raise ConnectionError(str(e)) from e

        rows = with_retry(load)
        if not isinstance(rows, list):
            raise ValueError("a page must be a JSON list")
        for k, r in enumerate(rows):
            yield partition.number, k, json.dumps(r)
