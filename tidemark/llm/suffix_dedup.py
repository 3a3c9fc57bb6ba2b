"""Removal of repeated byte strings, judged by merged Burrows-Wheeler transforms.

Texts are UTF-8 bytes in the order of their ids. A byte goes if a string of `length` bytes
that covers it also starts earlier.

1. Documents are dealt into blocks by a hash. Every window of `length` bytes has an anchor, its
   least `GRAM`-byte string under a hash, the leftmost of equals. Equal windows have equal
   anchors at equal places, so an anchor seen once in the corpus has no repeated window. Anchor
   hashes meet by range of the hash, as arrays; the hashes seen twice go back to their blocks.
2. The neighbouring windows of one anchor form a segment. An anchor seen more than HOT times has
   its segments cut in parts of PART windows, each keyed anew by what all its windows share, so
   a string in very many surroundings does not bring them all together. Equal segments collapse
   where they are found, byte by byte compared: all but the first are repeats as wholes, so a
   passage copied any number of times costs one segment for each block.
3. Segments of an anchor meet in one task. Those of different blocks are different shards, the
   shards' transforms are merged by interleave refinement, and in each repeated interval
   all windows but the earliest are repeats (bwt_merge). Where one key has more than WIDE bytes of
   them, as a string shorter than a window has in very many surroundings, they are cut again as in
   step 2, one range of places of the anchor after another and in ever shorter parts, until what
   meets is little or one string; no merge takes memory that grows with the corpus.
4. The repeats go back to the blocks, which hold the texts.

A null or empty text loses nothing and has no spans. Null ids come last. Rows of one id are
in the order of a hash of their text; of rows with the same id and text, those after the
first lose all, if they have `length` bytes, and the first only what also starts in other
documents or earlier in itself. An empty table gives no rows. Very long texts are cut in
overlapping slices for the search and are whole otherwise. Other columns are not read. Matches
never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_merge import repeated_intervals
from .common import text_or_empty
from .textblock import column_bytes, mix, runs, slices
from .textblock import _powers as powers

GRAM = 24
#: Anchors that one task of step 1 gets on average.
BUCKET_ANCHORS = 1 << 18
#: Shards whose transforms are merged at once, at most; blocks are dealt to them in turn.
SHARDS = 4
#: Bytes of text in a block, and the least number of blocks.
BLOCK_BYTES, BLOCKS = 8 << 20, 4
#: Occurrences of an anchor beyond which its segments are cut, and windows of a part.
HOT, PART = 4096, 20
#: Bytes of segments that are merged together; anchors are never split.
MERGE_BYTES = 56_000
#: Bytes of one key's segments beyond which they are cut again, and windows of a part, from cut to cut.
WIDE, FINER = 1 << 18, (PART, 4, 1)
#: A window's place in a slice has this many bits; longer texts are cut into overlapping slices.
PLACE_BITS = 24
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_B = 0x9E3779B97F4A7C15
NO_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place; GRAM is 16 + 8."""
    h = _BYTE[data]
    parts, width = {}, 1
    while width <= 16:
        parts[width] = h
        if width < 16:
            h = h[:-width] * np.uint64(pow(_B, width, 1 << 64)) + h[width:]
        width *= 2
    out = parts[16][: len(data) - GRAM + 1] * np.uint64(pow(_B, 8, 1 << 64)) + parts[8][16 : 16 + len(data) - GRAM + 1]
    return mix(out)


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, place of the anchor) of each run of windows with one anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    grams = gram_hashes(data)
    key = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span, width, least = length - GRAM + 1, 1, key
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.zeros(n - length + 2, np.int64)
    starts, lasts = offs[:-1], offs[1:] - length
    has = lasts >= starts
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, lasts[has] + 1, -1)
    valid = np.cumsum(valid)[: n - length + 1] > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none
    new = np.concatenate([[True], (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    # texts that touch: a window is never part of the run of another text's
    return grams[place[at[first]]].astype(np.int64), at[first], np.diff(np.concatenate([first, [len(at)]])), place[at[first]]


def text_slices(offs: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, from byte, to byte); a very long text comes in overlapping parts."""
    most = (1 << PLACE_BITS) - 1
    for a, b in slices(offs):
        lo, hi = int(offs[a]), int(offs[b])
        while hi - lo > most:
            yield a, b, lo, lo + most
            lo += most - length + 1
        yield a, b, lo, hi


def _local(offs: np.ndarray, a: int, b: int, lo: int, hi: int) -> np.ndarray:
    return np.clip(offs[a : b + 1], lo, hi) - lo


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + length) one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def _firsts(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whether a row is the first of its equals): rows sorted by `same`, then `order`."""
    by = np.lexsort((*order[::-1], *same[::-1]))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([c[by][1:] != c[by][:-1] for c in same], axis=0)
    return by, new


def _differ(data: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the strings at x and y, of equal lengths, differ."""
    out, filled, at = np.zeros(len(x), bool), np.cumsum(lengths), 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + (1 << 20), "right")))
        part = lengths[at:to]
        apart = data[_ranges(x[at:to], part)] != data[_ranges(y[at:to], part)]
        out[at:to] = np.logical_or.reduceat(apart, np.cumsum(part) - part)
        at = to
    return out


def _collapsed(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...], data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_firsts of strings whose hashes are `same`; one that differs from the first all the same is kept."""
    by, first = _firsts(order, same)
    if not len(by):
        return by, first
    head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    again = np.flatnonzero(~first)
    equal = lengths[by[again]] == lengths[head[again]]
    first[again[~equal]] = True
    again = again[equal]
    first[again] = _differ(data, at[by[again]], at[head[again]], lengths[by[again]])
    return by, first


_SEGMENTS = ("keys", "ids", "ties", "starts", "windows", "hashes", "data")


def _pack(bucket: int, kind: int, block: int, **cols: np.ndarray) -> dict:
    return {"bucket": bucket, "kind": kind, "block": block} | {c: cols[c].tobytes() if c in cols else b"" for c in _SEGMENTS}


_SCHEMA = "bucket int, kind int, block int, " + ", ".join(f"{c} binary" for c in _SEGMENTS)
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in _SEGMENTS)])


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ARROW)


def _column(table: pa.Table, name: str, rows: np.ndarray, dtype=np.int64) -> np.ndarray:
    col = table.column(name)
    return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(col[int(r)].as_py(), dtype) for r in rows]])


def _ids(table, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(0)
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), tie


def _row_keys(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.uint64)) + ties.astype(np.uint64))


def _part(c: int, size: int, key, start, windows, place, hashed, length: int) -> tuple[np.ndarray, ...]:
    """(whether it has one, key, start, windows) of each segment's part c of `size` windows."""
    lo, hi = np.maximum(start, place - (size * c + size - 1)), np.minimum(start + windows - 1, place - size * c)
    has = lo <= hi
    core = place[has] - size * c
    own = hashed(core, core + length - size + 1).astype(np.uint64)
    return has, mix(own + key[has].astype(np.uint64) * np.uint64(2 * c + 3)).astype(np.int64), lo[has], hi[has] - lo[has] + 1


def _parts(key, start, windows, place, hashed, length: int) -> tuple[np.ndarray, ...]:
    """(key, start, windows) of segments cut by where their windows have the anchor, keyed by the bytes that
    all windows of a part share; hashed: the hash of [start, end)."""
    out = [_part(c, PART, key, start, windows, place, hashed, length)[1:] for c in range(-(-(length - GRAM + 1) // PART))]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hasher(part: np.ndarray):
    """The hash of [start, end) of part, by arrays of both."""
    up, down = powers(len(part))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
    return lambda s, e: mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)).astype(np.int64)


def _finer(data: np.ndarray, at: np.ndarray, windows: np.ndarray, key: np.ndarray, size: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(segment, windows before it, windows, key, hash) of parts of one key's segments at `at`: those with
    the anchor in one range of places after another. Windows of different ranges are never equal."""
    ends = np.cumsum(windows + length - 1)
    cuts = [(a, b, np.concatenate([[0], ends[a:b] - (ends[a - 1] if a else 0)])) for a, b in slices(np.concatenate([[0], ends]), texts=len(at))]
    bytes_of = lambda a, b: data[_ranges(at[a:b], windows[a:b] + length - 1)]
    place = np.concatenate([anchors(bytes_of(a, b), own, length)[3] - own[:-1] for a, b, own in cuts])
    for c in np.unique(np.concatenate([(place - k) // size for k in range(0, int(windows.max()), size)] + [(place - windows + 1) // size])):
        if c < 0:
            continue
        got = []
        for a, b, own in cuts:
            has, k, lo, n = _part(int(c), size, key[a:b], own[:-1], windows[a:b], own[:-1] + place[a:b], hashed := _hasher(bytes_of(a, b)), length)
            got.append((a + np.flatnonzero(has), lo - own[:-1][has], n, k, hashed(lo, lo + n + length - 1)))
        yield tuple(np.concatenate(x) for x in zip(*got, strict=True))


def find_repeats(table: pa.Table, repeated: np.ndarray, hot: np.ndarray, length: int, buckets: int, block: int) -> list[dict]:
    """Step 2 for one block: segments for step 3 (kind 0) and repeats already sure (kind 1).

    repeated: anchors that occur more than once, ascending; hot: those of them to be cut."""
    ids, ties = _ids(table, table.column("tie").to_numpy())
    _, once = np.unique(_row_keys(ids, ties), return_index=True)
    once = np.sort(once)  # further rows of the same id and text lose all
    ids, ties = ids[once], ties[once]
    data, offs = column_bytes(table.column("text").take(pa.array(once)))
    got = []
    for a, b, lo, hi in text_slices(offs, length):
        part, own = data[lo:hi], _local(offs, a, b, lo, hi)
        key, start, windows, place = anchors(part, own, length)
        at = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        keep = repeated[at] == key if len(repeated) else np.zeros(len(key), bool)
        key, start, windows, place = key[keep], start[keep], windows[keep], place[keep]
        if not len(key):
            continue
        hashed = _hasher(part)
        cut = hot[at[keep]]
        if cut.any():
            parts = _parts(key[cut], start[cut], windows[cut], place[cut], hashed, length)
            key, start, windows = (np.concatenate([x[~cut], y]) for x, y in zip((key, start, windows), parts, strict=True))
        text = a + np.searchsorted(own, start, "right") - 1
        got.append((key, ids[text], ties[text], start + lo - offs[text], windows, hashed(start, start + windows + length - 1), start + lo))
    if not got:
        return []
    key, id_, tie, start, windows, hashed, at = (np.concatenate(c) for c in zip(*got, strict=True))
    by, first = _collapsed((id_, tie, start), (key, hashed), data, at, windows + length - 1)
    rows = []
    again = by[~first]
    if len(again):
        rows.append(_pack(int(key[again[0]] % buckets), 1, block, ids=id_[again], ties=tie[again], starts=start[again], windows=windows[again]))
    use = by[first]
    bucket = key[use] % buckets
    order = np.argsort(bucket, kind="stable")
    use, bucket = use[order], bucket[order]
    for s, e in runs(bucket):
        u = use[s:e]
        rows.append(_pack(int(bucket[s]), 0, block, keys=key[u], ids=id_[u], ties=tie[u], starts=start[u], windows=windows[u], hashes=hashed[u], data=data[_ranges(at[u], windows[u] + length - 1)]))
    return rows


def merge_segments(table: pa.Table, length: int) -> list[dict]:
    """Step 3 for one bucket: repeats by block."""
    kind, block = table.column("kind").to_numpy(), table.column("block").to_numpy()
    out = [(block[r], *(_column(table, c, np.array([r])) for c in ("ids", "ties", "starts", "windows"))) for r in np.flatnonzero(kind == 1)]
    rows = np.flatnonzero(kind == 0)
    key, id_, tie, start, windows, hashed = (_column(table, c, rows) for c in _SEGMENTS[:-1])
    data = _column(table, "data", rows, np.uint8)
    home = np.repeat(block[rows], [len(table.column("keys")[int(r)].as_py()) // 8 for r in rows]).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(windows + length - 1)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(seg, skip, wins, key, hashed, finer):
        """Finds repeats among parts of segments, each from the window `skip` on."""
        at, begin, lengths = offs[seg] + skip, start[seg] + skip, wins + length - 1
        by, first = _collapsed((id_[seg], tie[seg], begin), (key, hashed), data, at, lengths)
        again = by[~first]
        found.append((seg[again], begin[again], wins[again]))
        use = by[first]  # sorted by key
        several = np.bincount(np.cumsum(np.concatenate([[0], key[use][1:] != key[use][:-1]]))) if len(use) else np.zeros(0, int)
        use = use[np.repeat(several > 1, several)]  # a key with one segment has nothing to merge
        if not len(use):
            return
        filled = np.cumsum(lengths[use])
        group_end = np.append(np.flatnonzero(key[use][1:] != key[use][:-1]) + 1, len(use))
        done = 0
        while done < len(use):
            reach = filled[done - 1] if done else 0
            g = int(np.searchsorted(group_end, done, "right"))
            to = int(group_end[max(g, int(np.searchsorted(filled[group_end - 1], reach + MERGE_BYTES, "right")) - 1)])
            u, done = use[done:to], to
            sizes = [k for k in finer if k < wins[u].max() or k == 1]
            if sizes and filled[to - 1] - reach > WIDE:
                for part, on, n, k, h in _finer(data, at[u], wins[u], key[u], sizes[0], length):
                    meet(seg[u][part], skip[u][part] + on, n, k, h, sizes[1:])
                continue
            own = np.concatenate([[0], np.cumsum(lengths[u])])
            _, rank = np.unique(home[seg[u]], return_inverse=True)
            string, place, interval = repeated_intervals(data[_ranges(at[u], lengths[u])], own, rank % SHARDS, length)
            ok = place < wins[u][string]
            s, place, interval = u[string[ok]], place[ok], interval[ok]
            by, first = _firsts((id_[seg[s]], tie[seg[s]], begin[s] + place), (interval,))
            rest = by[~first]
            found.append((seg[s[rest]], begin[s[rest]] + place[rest], np.ones(len(rest), np.int64)))

    meet(np.arange(len(key)), np.zeros(len(key), np.int64), windows, key, hashed, FINER)
    seg, begin, count = (np.concatenate(c) for c in zip(*found, strict=True))
    out += [(k, id_[seg[m]], tie[seg[m]], begin[m], count[m]) for k in np.unique(home[seg]) for m in [home[seg] == k]]
    return [_pack(0, 2, int(k), ids=i, ties=t, starts=s, windows=w) for k, i, t, s, w in out if len(i)]


def removed_runs(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs that ranges cover, by row and start."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    if not len(rows):
        return rows, starts, ends
    # ranges of one row never reach the next one's: a running maximum over rows laid far apart
    wide = np.int64(ends.max() + 2)
    reach = np.maximum.accumulate(rows * wide + ends)
    new = np.concatenate([[True], rows[1:] * wide + starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rows)]]) - 1
    return rows[first], starts[first], reach[last] - rows[first] * wide


def apply_repeats(table: pa.Table, repeats: pa.Table, length: int, kept: bool) -> dict[str, list]:
    """Step 4 for one block: what is left of each text."""
    data, offs = column_bytes(table.column("text"))
    n = len(offs) - 1
    ids, ties = _ids(table, table.column("tie").to_numpy())
    every = np.arange(repeats.num_rows)
    rid, rtie, start, windows = (_column(repeats, c, every) for c in ("ids", "ties", "starts", "windows"))
    known, first, copy_of = np.unique(_row_keys(ids, ties), return_index=True, return_inverse=True)
    row = first[np.searchsorted(known, _row_keys(rid, rtie))] if len(rid) else rid
    copies = np.flatnonzero(first[copy_of] != np.arange(n))
    copies = copies[np.diff(offs)[copies] >= length]
    rows, starts, ends = removed_runs(
        np.concatenate([row, copies]),
        np.concatenate([start, np.zeros(len(copies), np.int64)]),
        np.concatenate([start + windows + length - 1, np.diff(offs)[copies]]),
    )
    size = np.diff(offs)
    out: dict[str, list] = {"n_bytes": size.tolist(), "n_removed": np.bincount(rows, ends - starts, minlength=n).astype(np.int64).tolist(), "n_spans": np.bincount(rows, minlength=n).tolist(), "left": []}
    cut = np.searchsorted(rows, np.arange(n + 1))
    for i in range(n):
        s, e = int(offs[i]), int(offs[i + 1])
        edges = [s, *(x for k in range(cut[i], cut[i + 1]) for x in (s + int(starts[k]), s + int(ends[k]))), e]
        rest = b"".join([data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)])
        out["left"].append(rest if kept else hashlib.sha256(rest).hexdigest())
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, kept: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for each document; with kept, the bytes
    left (kept) in place of their digest."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(BLOCKS, -(-size // block_bytes))
    buckets = max(1, size // (length - GRAM + 2) * 2 // BUCKET_ANCHORS)
    docs = docs.withColumn("tie", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)).cast("int"))

    def ask(batches):
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            home, keys, homes = batch.column(3).to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, lo, hi in text_slices(offs, length):
                own = _local(offs, a, b, lo, hi)
                key, start, _, _ = anchors(data[lo:hi], own, length)
                keys.append(key)
                homes.append(home[a + np.searchsorted(own, start, "right") - 1].astype(np.int64))
            key, at = np.concatenate(keys), np.concatenate(homes)
            order = np.lexsort((key, at, key % buckets))
            key, at = key[order], at[order]
            # a hash is sent for a block once, with how often the block has it, up to 255
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])) if len(key) else np.zeros(0, np.int64)
            count = np.minimum(np.diff(np.append(new, len(key))), 255).astype(np.uint8)
            key, at = key[new], at[new]
            cell = key % buckets * blocks + at
            rows = [(int(cell[s] // blocks), int(cell[s] % blocks), key[s:e].tobytes(), count[s:e].tobytes()) for s, e in runs(cell)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        block, every = table.column("block").to_numpy(), np.arange(table.num_rows)
        key, count = _column(table, "keys", every), _column(table, "counts", every, np.uint8)
        home = np.repeat(block, [len(x) // 8 for x in table.column("keys").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, home, count = key[order], home[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(key)))
        total = np.repeat(np.add.reduceat(count, first), sizes) if len(key) else count
        twice = total > 1
        key, home, hot = key[twice], home[twice], total[twice] > HOT
        order = np.lexsort((key, home))
        key, home, hot = key[order], home[order], hot[order]
        rows = [(int(home[s]), key[s:e].tobytes(), hot[s:e].tobytes()) for s, e in runs(home)]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        every = np.arange(right.num_rows)
        repeated, at = np.unique(_column(right, "keys", every), return_index=True)
        hot = _column(right, "hot", every, bool)[at]
        return _table(find_repeats(left, repeated, hot, length, buckets, int(left.column("block")[0].as_py())))

    def merge(table: pa.Table) -> pa.Table:
        return _table(merge_segments(table, length))

    last = "kept" if kept else "kept_sha256"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = apply_repeats(left, right, length, kept) if left.num_rows else {c: [] for c in ("n_bytes", "n_removed", "n_spans", "left")}
        cols = [left.column("id").combine_chunks() if left.num_rows else pa.array([], pa.int64()), *(pa.array(got[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(got["left"], pa.binary() if kept else pa.string())]
        return pa.Table.from_arrays(cols, names=["id", "n_bytes", "n_removed", "n_spans", last])

    texts = docs.repartition(blocks, "block")
    asked = texts.mapInArrow(ask, "bucket int, block int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, keys binary, hot binary")
    segments = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(find, _SCHEMA)
    repeats = segments.groupBy("bucket").applyInArrow(merge, _SCHEMA)
    done = texts.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(finish, f"id long, n_bytes long, n_removed long, n_spans long, {last} {'binary' if kept else 'string'}")
    return done.withColumnRenamed("id", id_col)
