"""Language-model scores: prediction by partial matching over bytes, and a word base line.

The model is a trie of byte contexts up to ORDER bytes with the counts of what followed them
in the training documents, and an end mark after each text. A symbol is coded in the longest
known context; where it never followed, an escape is coded and the next shorter context tried,
from which the symbols that followed the longer one are excluded (escape method C: as
likely as the number of different symbols seen). Below order 0 the unseen symbols are equally
likely. The code length of a text is the sum over its bytes and its end mark, as log10.

The counts are those of all training documents, and every node is kept, so the trie grows
with the corpus and is nowhere held whole. Documents are dealt into blocks. A block sends each
of its codes (a symbol with the ORDER before it) and words once, with how often its training rows
have it, to the code's or word's bucket; that sums the counts of all blocks, and the answers go
back to the blocks that sent. Codes whose contexts share the last two symbols are in one bucket,
with all that orders two to ORDER need of each other; orders 0 and 1, of which there are at most
257 * 257 nodes, go along. A bucket prices each code of its contexts once. In a static trie the
symbols after a context also follow each shorter one, so exclusion is a sum stored per context
and whole arrays are priced without a loop over symbols. Codes and words travel as arrays.

A null or empty text has its end mark only. Rows without id count as training rows.
Repeated rows count repeatedly. An empty table gives no rows; without any training row all
counts are 0 and symbols are equally likely. Very long texts make blocks of their own size and are
never cut. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textblock import column_bytes, mix, runs, slices, words

ORDER = 4
END = 256
BITS = 9
#: Bytes of text in a block, and for which there is one bucket of codes and one of words; buckets at least.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 24 << 20, 8 << 20, 8
#: The end token's place among word hashes.
END_WORD = 0x5DEECE66D1234567
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


def symbol_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first code of each text): each byte and end mark with the ORDER symbols before it,
    nine bits each, its own lowest."""
    n = len(offs) - 1
    lengths = np.diff(offs)
    pad = ORDER + 1
    seq = np.full(len(data) + pad * n, END, np.uint64)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * pad + ORDER, lengths)
    seq[at] = data
    code = np.zeros(len(seq), np.uint64)
    for k in range(ORDER + 1):
        code[k:] |= seq[: len(seq) - k] << np.uint64(BITS * k)
    starts = offs[:-1] + np.arange(n) * pad
    keep = np.ones(len(seq), bool)
    for k in range(ORDER):
        keep[starts + k] = False
    return code[keep], offs[:-1] + np.arange(n)


def _merge(keys: np.ndarray, n: np.ndarray, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    if not ascending:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _merge(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *n]))


def low_orders(docs: DataFrame, text_col: str, training_col: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of orders 0 and 1 in training rows: symbols, and symbols with the one before them."""
    pair = END + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pair * pair, np.int64)
        for batch in batches:
            data, offs = column_bytes(batch.column(0).filter(batch.column(1)))
            for a, b in slices(offs):
                code = symbol_codes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])[0].astype(np.int64)
                total += np.bincount(((code >> BITS) & 511) * pair + (code & 511), minlength=pair * pair)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    # at most 257 * 257 rows
    got = docs.select(text_col, training_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    at, n = (got.column(k).to_numpy() for k in range(2))
    ones = (at // pair << BITS) + at % pair
    return [_merge((at % pair).astype(np.uint64), n), _merge(ones.astype(np.uint64), n)]


class Trie:
    """Counts by order, and what scoring needs of each context, as sorted arrays."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        """nodes: for each order the keys, ascending, and their counts."""
        self.keys = [k.astype(np.uint64) for k, _ in nodes]
        self.n = [n.astype(np.float64) for _, n in nodes]
        self.contexts, self.total, self.types = [], [], []
        for keys, n in zip(self.keys, self.n, strict=True):
            ctx = keys >> np.uint64(BITS)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            self.contexts.append(ctx[first])
            self.total.append(np.add.reduceat(n, first) if len(first) else n)
            self.types.append(np.diff(np.concatenate([first, [len(ctx)]])).astype(np.float64))
        self.escape = [np.log10(t / (n + t)) for t, n in zip(self.types, self.total, strict=True)]
        #: of a context: denominator and escape one order below, its own symbols excluded
        self.rest, self.rest_escape = [np.zeros(0)], [np.zeros(0)]
        for k in range(1, len(nodes)):
            below = self.find(self.keys[k - 1], self.keys[k] & self.mask(k))
            n = np.where(below >= 0, self.n[k - 1][below], 0.0) if len(below) else np.zeros(0)
            of = np.searchsorted(self.contexts[k], self.keys[k] >> np.uint64(BITS))
            out = np.bincount(of, n, minlength=len(self.contexts[k]))
            short = self.find(self.contexts[k - 1], self.contexts[k] & self.mask(k - 1))
            left = self.total[k - 1][short] - out if len(short) else np.zeros(0)
            new = self.types[k - 1][short] - self.types[k] if len(short) else np.zeros(0)
            self.rest.append(left + new)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.rest_escape.append(np.where(new > 0, np.log10(new / (left + new)), 0.0))

    @staticmethod
    def mask(symbols: int) -> np.uint64:
        return np.uint64((1 << BITS * symbols) - 1)

    @staticmethod
    def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where one is missing."""
        if not len(sorted_keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's lowest symbol after the others."""
        out = np.zeros(len(codes))
        live, before = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for k in range(len(self.keys) - 1, -1, -1):
            c = codes[live]
            here = self.find(self.contexts[k], (c >> np.uint64(BITS)) & self.mask(k))
            node = self.find(self.keys[k], c & self.mask(k + 1))
            known, top = here >= 0, before < 0
            below = np.zeros(len(c)), np.zeros(len(c))
            if k + 1 < len(self.keys) and len(self.contexts[k + 1]):
                below = self.rest[k + 1][before], self.rest_escape[k + 1][before]
            if len(self.contexts[k]):
                denominator = np.where(top, self.total[k][here] + self.types[k][here], below[0])
                escape = np.where(known, np.where(top, self.escape[k][here], below[1]), 0.0)
            else:
                denominator, escape = np.ones(len(c)), np.zeros(len(c))
            hit = node >= 0
            out[live[hit]] += np.log10(self.n[k][node[hit]] / denominator[hit])
            out[live[~hit]] += escape[~hit]
            live, before = live[~hit], here[~hit]
        unseen = END + 1 - (len(self.keys[0]) if self.keys else 0)
        out[live] -= np.log10(max(1, unseen))
        return out


class Prices:
    """Values of codes, the most frequent ones each in a slot of its own, the others by their order."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, values: np.ndarray, bits: int = _SLOT_BITS):
        """codes: ascending."""
        self.codes, self.all, self.bits = codes, values, bits
        by = np.argsort(n, kind="stable")  # the most frequent comes last and keeps the slot
        self.keys = np.full(1 << bits, (1 << 64) - 1, np.uint64)
        self.values = np.zeros(1 << bits)
        at = self.slot(codes[by])
        self.keys[at] = codes[by]
        held = self.keys[at] == codes[by]
        self.values[at[held]] = values[by[held]]

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each text, all of whose codes are here."""
        code, first = symbol_codes(data, offs)
        at = self.slot(code)
        value = self.values[at]
        miss = np.flatnonzero(self.keys[at] != code)
        value[miss] = self.all[np.searchsorted(self.codes, code[miss])]
        return np.add.reduceat(value, first)


#: What travels between blocks and buckets; buckets below the number of them are of codes, others of words.
_ROW = [("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]
_ANSWER = [("block", pa.int32()), ("is_code", pa.bool_()), ("keys", pa.binary()), ("values", pa.binary()), ("weights", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _schema(fields: list) -> str:
    return ", ".join(f"{name} {_KINDS[kind]}" for name, kind in fields)


def _rows(rows: list[tuple], fields: list) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, training, n_tokens, n_known, train_tokens, base_score, score) for each document.

    training marks the rows that the model and the word counts learn from.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    low = low_orders(docs, "text", "training")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(BUCKETS, -(-size // BUCKET_BYTES))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def token_slices(table, text: int):
        data, offs = column_bytes(table.column(text))
        for a, b in slices(offs):
            part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            h, _, _, of = words(part, own)
            yield a, b, part, own, h, of

    def sent(block: int, keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> list[tuple]:
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        return [(int(bucket[s]), block, keys[s:e].tobytes(), n[s:e].astype(np.uint32).tobytes()) for s, e in runs(bucket)]

    def gather(batches):
        for batch in batches:
            block, learn = batch.column(3).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for one in np.unique(block).tolist():
                mine = pa.array(np.flatnonzero(block == one))
                own_learn, codes, words_ = learn[block == one], ([], []), ([], [])
                for a, b, part, own, h, of in token_slices(pa.table({"t": batch.column(1).take(mine)}), 0):
                    code, lead = symbol_codes(part, own)[0], own_learn[a:b].astype(np.uint64)
                    # the lowest bit says whether the row trains
                    code = np.sort((code << np.uint64(1)) | np.repeat(lead, np.diff(own) + 1))
                    for found, (key, n) in ((codes, _merge(code >> np.uint64(1), (code & np.uint64(1)).astype(np.int64), True)), (words_, _merge(h, lead[of].astype(np.int64)))):
                        found[0].append(key)
                        found[1].append(n)
                words_[0].append(np.array([END_WORD], np.uint64))
                words_[1].append(np.array([own_learn.sum()], np.int64))
                key, n = _counted(*codes)
                context = (key >> np.uint64(BITS)) & Trie.mask(2)
                rows = sent(one, key, n, (mix(context) % np.uint64(buckets)).astype(np.int64))
                key, n = _counted(*words_)
                rows += sent(one, key, n, (key % np.uint64(buckets)).astype(np.int64) + buckets)
                yield pa.RecordBatch.from_arrays(_rows(rows, _ROW), names=[c for c, _ in _ROW])

    def answer(table: pa.Table) -> pa.Table:
        is_code = table.column("bucket")[0].as_py() < buckets if table.num_rows else False
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        key, total = _counted(parts, [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("n").to_pylist()])
        known = total > 0
        if is_code:
            high = [_merge(key[known] & Trie.mask(order + 1), total[known]) for order in range(2, ORDER + 1)]
            values = Trie([*low, *high]).log10(key)
        else:
            values = total.astype(np.float64)
        weight = np.log2(total + 1.0).astype(np.uint8)
        out = [] if is_code else [(-1, False, b"", b"", b"", int(total.sum()), int(known.sum()))]
        home = table.column("block").to_numpy()
        order = np.argsort(home, kind="stable")
        for s, e in runs(home[order]):
            # a block's batches may have asked for the same
            want = np.unique(np.concatenate([parts[k] for k in order[s:e]]))
            at = np.searchsorted(key, want)
            if not is_code:
                want, at = want[known[at]], at[known[at]]
            out.append((int(home[order[s]]), is_code, want.tobytes(), values[at].tobytes(), weight[at].tobytes(), 0, 0))
        return pa.Table.from_arrays(_rows(out, _ANSWER), names=[c for c, _ in _ANSWER])

    answers = docs.mapInArrow(gather, _schema(_ROW)).groupBy("bucket").applyInArrow(answer, _schema(_ANSWER))
    # a word is in one bucket, so these are all training tokens and all distinct ones
    sums = answers.where("block < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("vocabulary"))

    def sorted_answers(table: pa.Table, is_code: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = table.filter(pa.array(table.column("is_code").to_numpy(zero_copy_only=False) == is_code))
        kinds = (("keys", np.uint64), ("values", np.float64), ("weights", np.uint8))
        cols = [np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in got.column(c).to_pylist()]]) for c, t in kinds]
        order = np.argsort(cols[0], kind="stable")
        return tuple(c[order] for c in cols)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        prices = Prices(*(sorted_answers(right, True)[k] for k in (0, 2, 1)))
        key, c, _ = sorted_answers(right, False)
        c = np.append(c, 0.0)
        del right
        end = c[Trie.find(key, np.array([END_WORD], np.uint64))]
        cols = [[], [], [], []]
        for a, b, part, own, h, of in token_slices(left, 1):
            seen = c[Trie.find(key, h)]
            n = b - a
            cols[0].append(np.bincount(of, minlength=n) + 1)
            cols[1].append(np.bincount(of, seen > 0, minlength=n).astype(np.int64) + (end > 0))
            cols[2].append(np.bincount(of, np.log10(seen + 1.0), minlength=n) + np.log10(end + 1.0))
            cols[3].append(prices.score(part, own))
        return pa.Table.from_arrays([left.column(0), left.column(2), *[pa.array(np.concatenate(x)) for x in cols]], names=["id", "training", "n_tokens", "n_known", "base", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, training boolean, n_tokens long, n_known long, base double, score double"
    empty = docs.sparkSession.createDataFrame([], schema).toArrow()
    scored = docs.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(meet, schema)
    scored = scored.join(F.broadcast(sums), F.lit(True))  # one row
    base = F.col("base") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("vocabulary") + 1.0)
    return scored.select(F.col("id").alias(id_col), "training", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
