"""Byte-level BPE by prefix dynamic programming.

A byte string has one BPE encoding, and so has each of its prefixes. Stored per prefix
is the last token of that prefix's encoding: the one vocabulary token that ends there
and may follow the last token of the prefix before it. Two tokens may follow each other
if encoding their joined bytes gives back those two. The encoding of a whole is read
backwards from the last tokens, an append only adds entries, and an edit recomputes
entries from its place until as many equal ones follow as the longest token has bytes.

Many pieces of one length are encoded together in numpy; a long piece by itself.
Null texts are empty: no tokens. Ties cannot occur, as the encoding is unique. Repeated
rows give repeated results, an empty table gives none. Very long texts are encoded whole, a few at a time. Null ids pass as
they are; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textblock import KEPT, column_bytes, release, slices

#: Bytes that a worker's memory of chunks and pieces may take, about; beyond them it keeps those in use.
REMEMBERED = 96 << 20
#: What one entry takes besides its characters, and the characters of a chunk that is remembered.
ENTRY, SHORT = 320, 64
#: Pieces of more bytes are encoded one by one.
LONG_PIECE = 28
_B = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(0xD6E8FEB86659FD93)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _salt(n: int) -> np.uint64:
    """Set apart hashes of byte strings of different lengths."""
    return np.uint64(n * int(_S) & (1 << 64) - 1)


class _HashTable:
    """64-bit keys to int32 values in open addressing; looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = ((keys * _S) >> self.shift).astype(np.int64)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            self.probes += 1
            spot = at[left]
            free = self.values[spot] < 0
            _, first = np.unique(spot, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            self.keys[spot[wins]], self.values[spot[wins]] = keys[left[wins]], values[left[wins]]
            left = left[~wins]
            at[left] = (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where a key is unknown."""
        at = ((keys * _S) >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        live = None
        for _ in range(self.probes):
            found, value = self.keys[at], self.values[at]
            hit = (found == (keys if live is None else keys[live])) & (value >= 0)
            more = ~hit & (value >= 0)
            if live is None:
                out[hit] = value[hit]
                live = np.flatnonzero(more)
            else:
                out[live[hit]] = value[hit]
                live = live[more]
            if not len(live):
                break
            at = (at[more] + 1) & self.mask
        return out


def _hash_bytes(rows: np.ndarray) -> np.ndarray:
    """Prefix hashes, one column more than rows has."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    for i in range(rows.shape[1]):
        out[:, i + 1] = out[:, i] * _B + rows[:, i].astype(np.uint64) + np.uint64(1)
    return out


class Vocabulary:
    """Ranks, and for each token its two parts, found once on the driver."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, r in ranks.items():
            self.bytes[r] = b
        self.longest = max(map(len, ranks), default=1)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.whole = np.zeros(size, bool)  # encoding the token's bytes gives the token
        pairs: dict[tuple[int, int], int] = {}
        for rank in range(size):
            b = self.bytes[rank]
            if len(b) == 1:
                self.left[rank] = self.right[rank] = rank
                self.whole[rank] = True
            elif b:
                parts = self._merge(b, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    self.whole[rank] = True
                    pairs[parts[0], parts[1]] = rank
        self.pairs = pairs
        self.pair_left = np.array([a for a, _ in pairs], np.uint64)
        self.pair_right = np.array([b for _, b in pairs], np.uint64)
        self.pair_rank = np.array(list(pairs.values()), np.int32)

    def _merge(self, b: bytes, below: int) -> list[int]:
        """Ids of b by merges of lower rank than `below` only."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


class PrefixEncoder:
    """Encodes pieces by a Vocabulary; lives in a worker and is built once there."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.left, self.right = v.left, v.right
        self.fits_memo: dict[tuple[int, int], bool] = {}
        by_length: dict[int, list[int]] = {}
        for rank, b in enumerate(v.bytes):
            if b and v.whole[rank]:
                by_length.setdefault(len(b), []).append(rank)
        keys, values = [], []
        for n, ids in by_length.items():
            rows = np.frombuffer(b"".join(v.bytes[i] for i in ids), np.uint8).reshape(-1, n)
            keys.append(_hash_bytes(rows)[:, n] + _salt(n))
            values.append(np.array(ids, np.int32))
        self.tokens = _HashTable(np.concatenate(keys), np.concatenate(values))
        self.size_of = np.array([len(b) for b in v.bytes], np.int64)
        self.lengths = sorted(by_length)
        self.merges = _HashTable((v.pair_left << np.uint64(32)) | v.pair_right, v.pair_rank)
        self.seen_keys = np.full(1 << 20, (1 << 64) - 1, np.uint64)
        self.seen_fits = np.zeros(1 << 20, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of tokens a and b gives these two, elementwise."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((keys * _S) >> np.uint64(44)).astype(np.int64)
        out = self.seen_fits[at]
        new = np.flatnonzero(self.seen_keys[at] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            ok = self._fits((fresh >> np.uint64(32)).astype(np.int32), (fresh & np.uint64(0xFFFFFFFF)).astype(np.int32))
            spot = ((fresh * _S) >> np.uint64(44)).astype(np.int64)
            self.seen_keys[spot], self.seen_fits[spot] = fresh, ok
            # two fresh keys of one slot: numpy keeps the last of each assignment, so the slot stays consistent
            out[new] = ok[back]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges nearest to the border, the latest first; a merge across the
        border that would have come before the ones still standing means no fit."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), 1 << 40, np.int64)  # merges across the border of a lower rank would have won
        while len(live):
            across = self.merges.find((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            lost = (across >= 0) & (across < bound)
            out[live[lost]] = False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            # the later merge of the two is undone; on equal ranks the right token's comes later
            undo_a = ~whole_a & (whole_b | (a > b))
            undo_b = ~whole_b & ~undo_a
            go = ~lost & (undo_a | undo_b)
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            live, a, b, bound = live[go], a[go], b[go], bound[go]
        return out

    def fits_one(self, a: int, b: int) -> bool:
        got = self.fits_memo.get((a, b))
        if got is None:
            if len(self.fits_memo) > 500_000:
                self.fits_memo.clear()
            got = self.fits_memo[a, b] = bool(self.fits(np.array([a]), np.array([b]))[0])
        return got

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of data; `last` holds those of a first part."""
        last = [-1] if last is None else last
        ranks, whole, lengths = self.v.ranks, self.v.whole, self.lengths
        for i in range(len(last), len(data) + 1):
            found = -1
            for n in lengths:
                if n > i:
                    break
                t = ranks.get(data[i - n : i], -1)
                if t >= 0 and whole[t] and (n == i or last[i - n] >= 0 and self.fits_one(last[i - n], t)):
                    found = t
                    break
            last.append(found)
        return last

    def read(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(int(last[i]))
            i -= len(self.v.bytes[last[i]])
        return out[::-1]

    def encode_one(self, piece: bytes) -> list[int]:
        t = self.v.ranks.get(piece)
        return [t] if t is not None else self.read(self.last_tokens(piece))

    def edited(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """data with [start, end) replaced by new, and its last tokens, of which those
        before start and those after the effect of the edit are taken from `last`."""
        out = data[:start] + new + data[end:]
        shift, got, same = len(new) - (end - start), last[: start + 1], 0
        while len(got) <= len(out):
            i = len(got)
            self.last_tokens(out[:i], got)
            same = same + 1 if i - shift > end and got[i] == last[i - shift] else 0
            if same > self.v.longest:
                got += last[i - shift + 1 :]
        return out, got

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            t = self.v.ranks.get(p)
            if t is not None:
                out[k] = [t]
            elif len(p) > LONG_PIECE:
                out[k] = self.encode_one(p)
            elif p:
                groups.setdefault(len(p), []).append(k)
        for n, ks in groups.items():
            for got, k in zip(self._encode_rows(np.frombuffer(b"".join([pieces[k] for k in ks]), np.uint8).reshape(-1, n)), ks, strict=True):
                out[k] = got
        return out

    def _encode_rows(self, rows: np.ndarray) -> list[list[int]]:
        count, n = rows.shape
        prefix = _hash_bytes(rows)
        last = np.full((n + 1, count), -1, np.int32)
        power = [np.uint64(pow(int(_B), k, 1 << 64)) for k in range(n + 1)]
        for i in range(1, n + 1):
            open_ = np.arange(count)
            for size in self.lengths:
                s = i - size
                if s < 0 or not len(open_):
                    break
                t = self.tokens.find(prefix[open_, i] - prefix[open_, s] * power[size] + _salt(size))
                ok = t >= 0
                if s:
                    before = last[s, open_]
                    ok &= before >= 0
                    few = np.flatnonzero(ok)
                    ok[few] = self.fits(before[few], t[few])
                last[i, open_[ok]] = t[ok]
                open_ = open_[~ok]
        at, steps = np.full(count, n), []
        everyone = np.arange(count)
        while (at > 0).any():
            t = np.where(at > 0, last[at, everyone], -1)
            if ((t < 0) & (at > 0)).any():
                raise ValueError("a byte is missing from the vocabulary")
            steps.append(t)
            at = np.where(t >= 0, at - self.size_of[t], 0)
        # read backwards: the first token of a short encoding has places without one before it
        return [x[x.count(-1) :] for x in np.stack(steps[::-1], 1).tolist()]


_WORKER: dict[str, object] = {}
#: A space between two characters that are not white space always begins a piece.
_SPACE = re.compile(r"(?<!\s) (?!\s)")
#: White space beside a space, and rarer white space, for which a text is cut by _SPACE.
_RUNS = ("  ", *(x for c in "\n\t\r\x0b\x0c" for x in (c + " ", " " + c)))
_RARE = [chr(i) for i in range(0x1C, 0x3001) if chr(i).isspace() and i != 32]
#: Characters whose new pieces are encoded together.
TOGETHER = 4 << 20


def chunks(text: str) -> list[str]:
    """text cut at spaces that begin a piece; all but the first chunk have lost that space."""
    odd = any(x in text for x in _RUNS) or any(x in text for x in (_RARE[:4] if text.isascii() else _RARE))
    return _SPACE.split(text) if odd else text.split(" ")


class Memory:
    """Decimal ids and decoded bytes of strings, in one entry each, while they fit in a share of REMEMBERED."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[str, bytes]] = {}
        self.size = 0

    def put(self, x: str, got: tuple[str, bytes]) -> None:
        self.of[x] = got
        self.size += ENTRY + 2 * len(x) + len(got[0])

    def trim(self, used: set[str], most: int) -> None:
        """Beyond `most` bytes, forgets all but what is in use; if that alone is too much, all."""
        if self.size > most:
            of, self.of, self.size = self.of, {}, 0
            for x in used:
                if x in of:
                    self.put(x, of[x])
            if self.size > most:
                self.of, self.size = {}, 0


class ChunkCache:
    """Ids and decoded bytes of chunks of text, with and without the space before them, and of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.encoder, self.split = PrefixEncoder(vocabulary), regex.compile(pattern).findall
        self.first, self.later, self.pieces = Memory(), Memory(), Memory()
        self.decimal = [str(i) for i in range(len(vocabulary.bytes))]

    def learn(self, new: list[str], space: str, known: Memory) -> None:
        """Encodes chunks, each after `space`, and decodes their ids."""
        parts = [self.split(space + c) for c in new]
        used = set(chain.from_iterable(parts))
        self.pieces.trim(used, REMEMBERED // 4)
        of, put = self.pieces.of, self.pieces.put
        fresh = [p for p in used if p not in of]
        decimal, decoded = self.decimal.__getitem__, self.encoder.v.bytes.__getitem__
        for p, got in zip(fresh, self.encoder.encode_many([p.encode() for p in fresh]), strict=True):
            put(p, (",".join(map(decimal, got)), b"".join(map(decoded, got))))
        put = known.put
        for c, x in zip(new, parts, strict=True):
            if len(x) == 1:
                put(c, of[x[0]])
            else:
                both = [of[p] for p in x]
                put(c, (",".join([i for i, _ in both]), b"".join([k for _, k in both])))
        self.pieces.trim(set(), REMEMBERED // 4)

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(decimal ids, decoded bytes) of each text."""
        cuts = [chunks(t) for t in texts]
        heads = [c.pop(0) for c in cuts]
        long: list[tuple[Memory, str]] = []
        for known, used, space in ((self.first, set(heads), ""), (self.later, set().union(*cuts), " ")):
            known.trim(used, REMEMBERED // 2)
            new = [c for c in used if c not in known.of]
            self.learn(new, space, known)
            long += [(known, c) for c in new if len(c) > SHORT]
        first, later = self.first.of, self.later.of
        for head, cut in zip(heads, cuts, strict=True):
            parts = list(map(later.__getitem__, cut))
            if head:
                parts.insert(0, first[head])
            yield ",".join([i for i, _ in parts]), b"".join([k for _, k in parts])
        for known, c in long:
            known.size -= ENTRY + 2 * len(c) + len(known.of.pop(c)[0])


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector of cycles: texts make very many lists, which it would walk again and again, and no cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


KEPT["byte_bpe"] = _WORKER.clear


def _worker(vocabulary, pattern: str) -> ChunkCache:
    v = vocabulary.value
    if _WORKER.get("of") is not v or _WORKER.get("pattern") != pattern:
        _WORKER.update(of=v, pattern=pattern, cache=ChunkCache(v, pattern))
    return _WORKER["cache"]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Each document's ids under the vocabulary at ranks_path, each match of pattern by itself.

    Returns id_col, n_tokens and decoded (text of the decoded bytes) with ids (decimal, joined
    by commas), or, with digests, their SHA-256 in place of both. Rows are independent: no
    shuffle. The vocabulary, of a size the file bounds, is broadcast. The pattern must, as
    byte-level BPE patterns do, begin a piece at a space between two visible characters.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), *(T.StructField(x, T.StringType()) for x in names[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("byte_bpe")
        cache = _worker(vocabulary, pattern)
        for batch in batches:
            _, offs = column_bytes(batch.column(1))
            for at, to in slices(offs, TOGETHER):
                n, first, second = [], [], []
                with uncollected():
                    for ids, back in cache.texts([t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]):
                        n.append(ids.count(",") + 1 if ids else 0)
                        first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                        second.append(hashlib.sha256(back).hexdigest() if digests else back.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
