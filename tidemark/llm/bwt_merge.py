"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a set of byte strings. Its transform lists, in the order of its suffixes, the
symbol before each suffix; a symbol here is several bytes, so a round goes that deep.
Shards are merged without sorting their suffixes anew: the interleave says for each rank of
the whole which shard it comes from; reading each shard's symbols in that order and sorting
them stably gives the interleave of contexts one symbol longer. The places where
neighbours differ are refined along with it: the round in which a place appears is the length
of the neighbours' common prefix, and where that reaches `depth` bytes they lie in one
repeated interval.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Suffix order and transform of a shard's strings, down to `depth` bytes or deeper."""

    def __init__(self, text: np.ndarray, codes: np.ndarray, last: np.ndarray, step: int, depth: int):
        """text: the positions of the shard's strings and their ends; codes: the symbol at each, 0
        at an end; last: the place in `text` where each position's string and ends stop."""
        n = len(codes)
        self.text, self.ends = text, int((codes == 0).sum())
        places, shift, rank = np.arange(n), step, codes
        order = np.argsort(rank, kind="stable")
        while shift < depth:
            # ranks by twice as many bytes, from those here and those `shift` bytes on
            on = places + shift
            after = np.where(on <= last, rank[np.minimum(on, n - 1)], 0)
            order = np.argsort(after, kind="stable")
            order = order[np.argsort(rank[order], kind="stable")]
            key, nxt = rank[order], after[order]
            new = np.zeros(n, np.int64)
            new[1:] = (key[1:] != key[:-1]) | (nxt[1:] != nxt[:-1])
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(new)
            rank = _narrow(dense)
            shift *= 2
        self.order = order
        before = order - step
        # a suffix has a symbol before it if that is in the same string, hence not an end
        self.symbols = np.where(before >= 0, codes[np.maximum(before, 0)], 0).astype(codes.dtype)


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the narrowest type; numpy sorts 16-bit numbers by radix."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


#: Bytes of a symbol at most where the strings are few enough for 16-bit ranks, and otherwise; at most 10.
STEP, SHORT_STEP = 10, 2
FEW = 1 << 16


def _dense(code: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.unique(code), code)


def symbol_codes(data: np.ndarray, offs: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, string, place) of all positions of the strings and `step` ends after each; codes are
    dense ranks of the next `step` bytes, 0 at an end."""
    n = len(offs) - 1
    lengths = np.diff(offs)
    total = len(data) + step * n
    at = np.arange(len(data)) + np.repeat(np.arange(n) * step, lengths)
    half = min(step, 5)
    wide = np.zeros(total + step, np.uint64)
    wide[at] = data.astype(np.uint64) + np.uint64(1)
    code = np.zeros(total, np.uint64)
    for k in range(half):
        code |= wide[k : k + total] << np.uint64(9 * (half - 1 - k))
    ends = np.ones(total, bool)
    ends[at] = False
    code[ends] = 0
    code = _dense(code)
    if step > half:
        rest = np.zeros(total, np.int64)
        rest[: total - (step - half)] = code[step - half :]
        code = code * (int(code.max(initial=0)) + 1) + rest
        code[ends] = 0
        code = _dense(code)
    string = np.repeat(np.arange(n), lengths + step)
    place = np.arange(total) - (offs[:-1] + np.arange(n) * step)[string]
    return _narrow(code), string, place


def _places(z: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each rank, where its shard's next suffix lies in the shards laid end to end."""
    out = np.empty(len(z), np.int64)
    for s, first in enumerate(base.tolist()):
        mine = np.flatnonzero(z == s)
        out[mine] = np.arange(first, first + len(mine))
    return out


def merged(shards: list[Shard], step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, common) by rank of the whole: where each suffix starts, and how many bytes it has in
    common with the one before it, in whole symbols and up to `depth`."""
    sizes = np.array([len(s.order) for s in shards])
    base = np.cumsum(sizes) - sizes
    symbols = _narrow(np.concatenate([s.symbols for s in shards]))
    start = np.concatenate([s.text[s.order] for s in shards])
    total = int(sizes.sum())
    # suffixes that start at an end: the empty context, first in every order
    ends = [s.ends for s in shards]
    shard_type = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards)), sizes).astype(shard_type)
    head = np.repeat(np.arange(len(shards)), ends).astype(shard_type)
    block = np.zeros(total, np.int64)
    common = np.full(total, depth, np.int32)
    common[: len(head) + 1] = 0  # suffixes at an end, and the first other one
    for turn in range(-(-depth // step)):
        place = _places(z, base)
        read = symbols[place]
        order = np.argsort(read, kind="stable")
        order = order[np.searchsorted(read[order], 1) :]  # symbol 0: no suffix before this one
        z = np.concatenate([head, z[order]])
        sym, blk = read[order], block[order]
        new = np.ones(len(order), np.int64)
        new[1:] = (sym[1:] != sym[:-1]) | (blk[1:] != blk[:-1])
        block = np.concatenate([np.zeros(len(head), np.int64), np.cumsum(new)])
        apart = common[len(head) :]
        apart[(new == 1) & (apart == depth)] = turn * step
    place = _places(z, base)
    return start[place], common


def repeated_intervals(data: np.ndarray, offs: np.ndarray, shard_of: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, interval) of the suffixes of at least `depth` bytes whose first `depth` bytes
    occur more than once in the strings."""
    n = len(offs) - 1
    most = STEP if len(data) + STEP * n < FEW else SHORT_STEP
    step = max(k for k in range(1, most + 1) if depth % k == 0)
    codes, string, place = symbol_codes(data, offs, step)
    shards = []
    owner, lengths = shard_of[string], np.diff(offs)
    for s in np.unique(shard_of):
        text = np.flatnonzero(owner == s)
        mine = string[text]
        stop = np.searchsorted(mine, mine, "right") - 1
        shards.append(Shard(text, codes[text], stop, step, depth))
    at, common = merged(shards, step, depth)
    interval = np.cumsum(common < depth)
    n = np.bincount(interval)
    keep = (n[interval] > 1) & (lengths[string[at]] - place[at] >= depth)
    at, interval = at[keep], interval[keep]
    return string[at], place[at], interval
