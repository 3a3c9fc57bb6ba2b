"""Periodic runs of words within texts, by repeated k-gram masking and the Main-Lorentz algorithm.

A run is a stretch of consecutive words that are equal q words apart, q the smallest such period, of
`least` words and `times` periods or more, that no neighbouring word extends. Shifted by its period a run
overlaps itself by its length less q, so by k words or more, with k the least of max(least, times * q) - q
over all q: each k-gram of a run occurs again in the document. Words outside repeated k-grams can join
no run; most texts end there. Stretches of words whose k-grams all occur again are the segments that are searched.

Main and Lorentz split a segment in the middle, find the runs across the middle from how far equal words
go on to both sides of it, and do the same in the halves. Here all segments of a slice of texts
are split together, level by level. Common extensions come from prefix hashes modulo two primes, and every run is
compared word by word in the end; words are numbered by their bytes, not by a hash alone.

A null text has no words; one without words has no runs and collapses to the empty text. Ties do not occur: runs differ in start or
period. Null ids, repeated rows and columns of other names pass as they are; an empty table gives
no rows. Very long texts are whole, in one slice. Rows are independent: there is no shuffle, and
memory is bounded by a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblock import EXACT_CODE, IS_WORD, column_bytes, mix, release, slices, words

#: Words that a run has at least, and periods.
LEAST, TIMES = 6, 4
_PRIMES = ((2147483647, 1315423911), (2147483629, 918273645))
#: Pairs of a middle and a period that are looked at together.
TOGETHER = 1 << 18
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def gram_size(least: int, times: int) -> int:
    """Words of the k-grams that every run repeats one by one."""
    k = min(max(least, times * q) - q for q in range(1, least + 1))
    if times < 2 or any(max(least, times * q) < 2 * q + k - 1 for q in range(1, least + k)):
        raise ValueError("runs this short need not repeat their k-grams")
    return k


class _Prefixes:
    """Equality of stretches of a sequence, and how far it goes."""

    def __init__(self, x: np.ndarray):
        n, self.sums = len(x), []
        for p, base in _PRIMES:
            power, at = np.ones(n + 1, np.int64), 1
            while at <= n:
                more = min(at, n + 1 - at)
                power[at : at + more] = power[:more] * (power[at - 1] * base % p) % p
                at += more
            value = (mix(x.astype(np.uint64) + np.uint64(p)) % np.uint64(p)).astype(np.int64)
            total = np.zeros(n + 1, np.int64)
            np.cumsum(value * power[:n] % p, out=total[1:])
            self.sums.append((p, power, total % p))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` from a and from b on are equal; a is before b."""
        out = np.ones(len(a), bool)
        for p, power, total in self.sums:
            out &= (total[a + size] - total[a]) % p * power[b - a] % p == (total[b + size] - total[b]) % p
        return out

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on are equal, `limit` at most; or, backwards, before a and b."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
        while step:
            can = np.flatnonzero(got + step <= limit)
            x, y = (a[can] + got[can], b[can] + got[can]) if forward else (a[can] - got[can] - step, b[can] - got[can] - step)
            got[can[self.same(x, y, np.full(len(can), step))]] += step
            step >>= 1
        return got


def find_runs(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs within each of the segments [lo, hi) of a sequence of numbers."""
    ahead = _Prefixes(x)
    found = [np.zeros((0, 3), np.int64)]
    l, r, sl, sr = lo.astype(np.int64), hi.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
    while True:
        big = r - l >= least
        l, r, sl, sr = l[big], r[big], sl[big], sr[big]
        if not len(l):
            break
        m, most = (l + r) // 2, (r - l) // times
        ends = np.cumsum(most)
        for a in range(0, int(ends[-1]), TOGETHER):
            pair = np.arange(a, min(a + TOGETHER, int(ends[-1])))
            node = np.searchsorted(ends, pair, "right")
            q = pair - (ends[node] - most[node]) + 1
            for side in (1, 0):
                # half of a run's periods are on one side of the middle: two whole ones there are equal
                one = m[node] if side else m[node] - 2 * q
                fits = one + 2 * q <= r[node] if side else one >= l[node]
                k = np.flatnonzero(fits)
                k = k[ahead.same(one[k], one[k] + q[k], q[k])]
                at, qq = node[k], q[k]
                left = m[at] if side else m[at] - qq
                back = ahead.common(left, left + qq, left - l[at], False)
                on = ahead.common(left, left + qq, r[at] - left - qq, True)
                s, e = left - back, left + qq + on
                k = np.flatnonzero(e - s >= np.maximum(least, times * qq))
                at, s, e, qq = at[k], s[k], e[k], qq[k]
                # what goes on beyond the node is found where it is whole
                on = (e < sr[at]) & (x[np.minimum(e, len(x) - 1)] == x[e - qq])
                on |= (s > sl[at]) & (x[np.maximum(s - 1, 0)] == x[s - 1 + qq])
                found.append(np.stack([s[~on], e[~on], qq[~on]], 1))
        l, r, sl, sr = np.concatenate([l, m]), np.concatenate([m, r]), np.concatenate([sl, sl]), np.concatenate([sr, sr])
    got = np.unique(np.concatenate(found), axis=0)
    # of one stretch the smallest period
    first = np.ones(len(got), bool)
    first[1:] = (got[1:, :2] != got[:-1, :2]).any(1)
    got = got[first]
    good = np.array([np.array_equal(x[s : e - q], x[s + q : e]) for s, e, q in got], bool)
    return tuple(got[good].T) if len(got) else (np.zeros(0, np.int64),) * 3


def segments(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of words whose k-grams all occur again in their text."""
    n = len(h) - k + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = of[:n].astype(np.uint64)
    for j in range(k):
        key = mix(key + h[j : j + n])
    inside = of[:n] == of[k - 1 :]
    order = np.argsort(key, kind="stable")
    order = order[inside[order]]
    equal = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n + 1, bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    # a stretch goes on while the next k-gram of the same text occurs again
    on = again[:n].copy()
    on[1:] &= again[: n - 1] & (of[1:n] == of[: n - 1])
    on[0] = False
    starts = np.flatnonzero(again[:n] & ~on)
    follows = np.append(on[1:], False)
    return starts, np.flatnonzero(again[:n] & ~follows) + k


def _numbers(data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes only."""
    _, once, row = np.unique(h, return_index=True, return_inverse=True)
    size = e - s
    equal = size == size[once[row]]
    if equal.all():
        first = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(first, size)
        equal = data[inner + np.repeat(s, size)] == data[inner + np.repeat(s[once[row]], size)]
    if not equal.all():  # a hash that two words share
        known: dict[bytes, int] = {}
        row = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(s, e, strict=True)])
    return row


def runs_of_texts(data: np.ndarray, offs: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(words, text of each run, its start, length and period in words, the words' mask of those kept)."""
    found = words(data, offs, EXACT_CODE)
    h, s, e, of = found
    k = gram_size(least, times)
    lo, hi = segments(h, of, k)
    kept = np.ones(len(h), bool)
    long = hi - lo >= least
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return found, *(np.zeros(0, np.int64),) * 4, kept
    size = hi - lo
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(lo - begin, size)
    x = _numbers(data, h[at], s[at], e[at])
    start, end, period = find_runs(x, begin, begin + size, least, times)
    start, end = at[start], at[end - 1] + 1
    if len(start):
        drop = np.zeros(len(h) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        kept = np.cumsum(drop[:-1]) == 0
    text = of[start]
    order = np.lexsort((period, start))
    first = np.searchsorted(of, text)
    return found, *(c[order] for c in (text, start - first, end - start, period)), kept


def collapsed(data: np.ndarray, n: int, found: tuple, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of n texts of the words kept, with one space between them."""
    _, s, e, of = found
    s, e, of = s[kept], e[kept], of[kept]
    # a word comes with the white space before it, unless it is its text's first
    s = s - np.append(False, of[1:] == of[:-1])[: len(s)]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    edge[e] -= 1
    out = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    out[~IS_WORD[out]] = 32
    return out, np.concatenate([[0], np.cumsum(np.bincount(of, e - s, n).astype(np.int64))])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id_col, runs, collapsed): each text's runs by start, then period, in words, and its words, one space apart,
    without those that any run has after its first period."""
    gram_size(least, times)
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            for a, b in slices(offs):
                part, n = data[offs[a] : offs[b]], b - a
                found, text, *cols, kept = runs_of_texts(part, offs[a : b + 1] - offs[a], least, times)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind)))
                out, at = collapsed(part, n, found, kept)
                new = pa.StringArray.from_buffers(n, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n), rows, new], names=[id_col, "runs", "collapsed"])

    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(f"runs array<{RUN}>, collapsed string").fields])
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id")).mapInArrow(run, schema)
