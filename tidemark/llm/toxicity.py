"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A step is a word: its own vector (frequent words of the sample; others share one) next to the
mean vector of its character trigrams, so unseen spellings still say something. Two gated
recurrent layers read a window forwards and backwards, attention weighs their states, a
logistic unit scores the window. Windows overlap by half and cover the whole text; a text
scores as its most toxic window. Training is in numpy in one task, by the window of
each text that scores highest (multiple-instance learning), on a bounded sample of labelled
texts: of each class the rows of least hash, at most SAMPLE rows and SAMPLE_BYTES bytes of texts
of at most TEXT_BYTES each. The task is the sample's size whatever the corpus has, is run
again if its executor is lost, and gives the weights back; everything is seeded.

A null text is empty; a text without words scores the sample's share of toxic rows. Without
labelled rows of both classes every text scores that share, or 0 without any. A row without an
id has no label and is scored; labels of one id count as toxic if any is. Repeated rows score
alike; equal hashes in the sample are ordered by id and text. Very long texts are scored whole, in one slice of
memory a few times their size. An empty table gives no rows. Columns of docs besides the
id and the text are passed on if kept and never read. Rows are independent: scoring has no
shuffle, and memory is bounded by a slice of texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .textblock import BYTE_CODE, column_bytes, mix, release, slices, words

#: Labelled rows of each class that training takes at most.
SAMPLE = {1: 2000, 0: 4000}
#: Bytes of text that they have at most, by class, and that one of them has at most.
SAMPLE_BYTES = {1: 12 << 20, 0: 24 << 20}
TEXT_BYTES = 1 << 20
WINDOW, STRIDE = 32, 16
WORD_DIM = CHAR_DIM = HIDDEN = ATTENTION = 8
TRIGRAMS = 4096
#: Sample texts that a word must be in to have a vector.
WORD_TEXTS = 4
ROUNDS, PASSES, BATCH, RATE = 7, 2, 256, 0.01
#: Steps of each round at least.
UPDATES = 60
#: Windows that are scored together, and words whose vectors are made together.
TOGETHER, WORDS_TOGETHER = 4096, 1 << 15


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, n of them."""
    out = np.empty((n, rows.shape[1]), np.float32)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(index, rows[:, k], minlength=n)
    return out


def text_windows(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of each window over texts whose words are numbered in a row."""
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    windows = np.where(count > 0, 1 + -(-np.maximum(count - WINDOW, 0) // STRIDE), 0)
    text = np.repeat(np.arange(n), windows)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[text] + turn * STRIDE
    return start, np.minimum(WINDOW, first[text] + count[text] - start), text


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first of each word): hashed character trigrams of words, their edges included."""
    size = end - start
    parts = [_trigrams(data, start[k : k + WORDS_TOGETHER], end[k : k + WORDS_TOGETHER]) for k in range(0, len(start), WORDS_TOGETHER)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(size) - size


def _trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    at = np.arange(total) + np.repeat(start - first, size)
    left = np.where(at == np.repeat(start, size), np.uint64(3), BYTE_CODE[data[np.maximum(at - 1, 0)]])
    right = np.where(at == np.repeat(end, size) - 1, np.uint64(5), BYTE_CODE[data[np.minimum(at + 1, n - 1)]])
    h = left * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODE[data[at]] * np.uint64(0xC2B2AE3D27D4EB4F) + right
    return (mix(h) % np.uint64(TRIGRAMS)).astype(np.int32)


class Network:
    """Weights, forward and backward passes."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray):
        """vocabulary: hashes of known words, ascending; odds: a first guess of how toxic each is."""
        rng = np.random.default_rng(5)
        self.vocabulary, self.share = vocabulary, 0.0

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        dim = WORD_DIM + CHAR_DIM
        word = draw(len(vocabulary) + 1, WORD_DIM, scale=0.05)
        word[1:, 0] += odds
        self.w = {"word": word, "char": draw(TRIGRAMS, CHAR_DIM, scale=0.1)}
        for d in "fb":
            self.w[f"x{d}"] = draw(dim, 3 * HIDDEN, scale=0.4)
            self.w[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
            self.w[f"u{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        self.w |= {"a": draw(2 * HIDDEN, ATTENTION, scale=0.3), "ac": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, scale=0.5), "o": draw(2 * HIDDEN, scale=0.3), "oc": np.array([-1.0], np.float32)}

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word's vector; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, number: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of words; every word has a trigram."""
        sizes = np.diff(np.append(first, len(grams)))
        chars = np.add.reduceat(self.w["char"][grams], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][number], chars], 1)

    def _run(self, px: list[np.ndarray], mask: np.ndarray, u: np.ndarray, steps: range, keep: list | None) -> list[np.ndarray]:
        h = np.zeros((len(mask), HIDDEN), np.float32)
        out = [h] * len(px)
        for t in steps:
            p, g = px[t], h @ u
            zr = _sigmoid(p[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(p[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new *= mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def windows(self, table: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; index: [windows, WINDOW] rows of the tables of projected inputs."""
        states = []
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            px = [table[d][index[:, t]] for t in range(WINDOW)]
            tape = [] if keep is not None else None
            states.append(self._run(px, mask, self.w[f"u{d}"], steps, tape))
            if keep is not None:
                keep[d] = tape
        h = np.stack([np.concatenate(x, 1) for x in zip(*states, strict=True)], 1)  # window, step, state
        e = np.tanh(h @ self.w["a"] + self.w["ac"])
        weight = np.exp(np.clip(e @ self.w["v"], -30, 30)) * mask
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, :, None] * h).sum(1)
        if keep is not None:
            keep.update(h=h, e=e, weight=weight, pooled=pooled)
        return pooled @ self.w["o"] + self.w["oc"][0]

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def tables(self, number: np.ndarray, grams: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """projected(inputs(...)), some words at a time: the trigrams' vectors are many times what comes out."""
        n, ends = len(number), np.append(first, len(grams))
        out = {d: np.empty((n, 3 * HIDDEN), np.float32) for d in "fb"}
        for k in range(0, n, WORDS_TOGETHER):
            to = min(k + WORDS_TOGETHER, n)
            part = self.projected(self.inputs(number[k:to], grams[ends[k] : ends[to]], first[k:to] - ends[k]))
            for d in "fb":
                out[d][k:to] = part[d]
        return out

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, wanted: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the mean loss, gradient by input vector)."""
        keep: dict = {}
        logit = self.windows(self.projected(x), index, mask, keep)
        d_logit = ((_sigmoid(logit) - wanted) / len(wanted)).astype(np.float32)
        h, e, weight, pooled = (keep[k] for k in ("h", "e", "weight", "pooled"))
        g = {"o": pooled.T @ d_logit, "oc": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.w["o"]
        d_weight = (h * d_pool[:, None, :]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_e = d_score[:, :, None] * self.w["v"] * (1 - e * e)
        g["v"] = (d_score[:, :, None] * e).sum((0, 1))
        g["a"] = h.reshape(-1, h.shape[2]).T @ d_e.reshape(-1, ATTENTION)
        g["ac"] = d_e.sum((0, 1))
        d_h = weight[:, :, None] * d_pool[:, None, :] + d_e @ self.w["a"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_u = self.w[f"u{d}"], np.zeros_like(self.w[f"u{d}"])
            carry = np.zeros((len(index), HIDDEN), np.float32)
            d_p = np.zeros((len(index), WINDOW, 3 * HIDDEN), np.float32)
            for t, before, z, r, n, gn in reversed(keep[d]):
                dh = (carry + d_h[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * mask[:, t, None]
                dz, dn = dh * (before - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                d_p[:, t] = np.concatenate([dz, dr, dn], 1)
                d_u += before.T @ dg
                carry = dh * z + dg @ u.T
            flat = d_p.reshape(-1, 3 * HIDDEN)
            rows = _summed(index.ravel(), flat, len(x))
            g |= {f"u{d}": d_u, f"x{d}": x.T @ rows, f"c{d}": flat.sum(0)}
            d_x += rows @ self.w[f"x{d}"].T
        return g, d_x


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.t = weights, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            self.w[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-7)


def _indexed(word_at: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word rows, mask) of windows."""
    step = np.arange(WINDOW)
    at = np.minimum(start[:, None] + np.minimum(step, size[:, None] - 1), len(word_at) - 1)
    return word_at[at], (step < size[:, None]).astype(np.float32)


def fit(texts: pa.Array | pa.ChunkedArray, toxic: np.ndarray) -> Network:
    """A network trained on texts and their labels (0 or 1)."""
    data, offs = column_bytes(texts)
    n = len(offs) - 1
    parts = [(a, words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])) for a, b in slices(offs)]
    h = np.concatenate([np.zeros(0, np.uint64), *[p[0] for _, p in parts]])
    # the sample is under 2 GB
    s, e = (np.concatenate([np.zeros(0, np.int32), *[(p[k] + offs[a]).astype(np.int32) for a, p in parts]]) for k in (1, 2))
    of = np.concatenate([np.zeros(0, np.int32), *[(p[3] + a).astype(np.int32) for a, p in parts]])
    del parts
    distinct, once, row = np.unique(h, return_index=True, return_inverse=True)
    del h
    row = row.astype(np.int32)
    pairs = np.unique(row.astype(np.int64) * max(n, 1) + of)
    in_toxic = np.bincount(pairs // max(n, 1), toxic[pairs % max(n, 1)], minlength=len(distinct))
    in_texts = np.bincount(pairs // max(n, 1), minlength=len(distinct))
    del pairs
    known = np.flatnonzero(in_texts >= WORD_TEXTS)
    share = float(toxic.mean()) if n else 0.0
    odds = np.log((in_toxic[known] + 1 * share) / (in_texts[known] - in_toxic[known] + 1 * (1 - share) + 1e-9) * (1 - share + 1e-9) / (share + 1e-9))
    net = Network(distinct[known], np.clip(odds, -3, 4).astype(np.float32) / 3)
    net.share = share
    if not 0 < share < 1 or not len(row):
        return net
    grams, first = trigrams(data, s[once], e[once])
    number = net.number(distinct)
    start, size, text = text_windows(of, n)
    del s, e, of
    guess = np.zeros(len(distinct))
    guess[known] = odds
    best = np.array([guess[row[a : a + k]].max() for a, k in zip(start, size, strict=True)])
    adam, rng = _Adam(net.w), np.random.default_rng(11)
    for turn in range(ROUNDS):
        if turn:
            best = score_windows(net, net.tables(number, grams, first), row, start, size)
        order = np.lexsort((-best, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        # the likeliest window of each text; of clean ones two, which must both be clean
        chosen = order[(rank == 0) | ((rank == 1) & (toxic[text[order]] == 0))]
        passes = max(PASSES, -(-UPDATES * BATCH // len(chosen)))
        for step in range(passes):
            mixed = rng.permutation(chosen)
            for k in range(0, len(mixed), BATCH):
                w = mixed[k : k + BATCH]
                at, mask = _indexed(row, start[w], size[w])
                used, index = np.unique(at, return_inverse=True)
                ends = np.append(first, len(grams))
                runs = ends[used + 1] - ends[used]
                begin = np.cumsum(runs) - runs
                g_at = np.arange(runs.sum()) + np.repeat(ends[used] - begin, runs)
                x = net.inputs(number[used], grams[g_at], begin)
                grads, d_x = net.gradients(x, index.reshape(at.shape), mask, toxic[text[w]].astype(np.float32))
                for name, rows, d in (("word", number[used], d_x[:, :WORD_DIM]), ("char", grams[g_at], np.repeat(d_x[:, WORD_DIM:] / runs[:, None].astype(np.float32), runs, axis=0))):
                    grads[name] = _summed(rows, d, len(net.w[name])) + 1e-5 * net.w[name]
                adam.step(grads, RATE * 0.7 ** (turn + step / passes))
    return net


def score_windows(net: Network, table: dict[str, np.ndarray], row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start))
    for k in range(0, len(start), TOGETHER):
        at, mask = _indexed(row, start[k : k + TOGETHER], size[k : k + TOGETHER])
        out[k : k + TOGETHER] = net.windows(table, at, mask)
    return out


def score_texts(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Score of each text, 0 to 1."""
    n = len(offs) - 1
    out = np.full(n, net.share)
    h, s, e, of = words(data, offs)
    if not len(h) or not 0 < net.share < 1:
        return out
    distinct, once, row = np.unique(h, return_index=True, return_inverse=True)
    grams, first = trigrams(data, s[once], e[once])
    table = net.tables(net.number(distinct), grams, first)
    start, size, text = text_windows(of, n)
    logit = score_windows(net, table, row, start, size)
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, logit)
    has = np.isfinite(top)
    out[has] = 1 / (1 + np.exp(-np.clip(top[has], -60, 60)))
    return out


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, mark, size): the labelled rows of docs that training takes, in one partition."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("mark")).where("mark IS NOT NULL")
    marks = marks.withColumn("order", F.xxhash64("id"))
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") <= TEXT_BYTES)
    out = None
    for mark, most in SAMPLE.items():
        # ids first, `most` at most; then as many rows, should an id have several
        ids = marks.where(F.col("mark") == mark).orderBy("order", "id").limit(most)
        took = rows.join(F.broadcast(ids), "id").withColumn("tie", F.xxhash64("text")).orderBy("order", "id", "tie").limit(most)
        size = F.sum(F.octet_length("text")).over(Window.partitionBy("mark").orderBy("order", "id", "tie").rowsBetween(Window.unboundedPreceding, 0))
        took = took.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES[mark]).select("text", F.col("mark").cast("long").alias("mark"), "size")
        out = took if out is None else out.union(took)
    return out.coalesce(1)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network from a bounded sample of the labelled rows of docs where `learn` holds, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        batches = list(batches)
        none = pa.table({"text": pa.array([], pa.string()), "mark": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})
        got = pa.Table.from_batches(batches) if batches else none
        order = pa.compute.sort_indices(got, sort_keys=[("mark", "ascending"), ("size", "ascending"), ("text", "ascending")])
        got = got.take(order)
        net = fit(got.column("text"), got.column("mark").to_numpy())
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    row = sample(docs, labels, learn, id_col, text_col, label_col).mapInArrow(run, "net binary").first()
    return pickle.loads(row[0]) if row else fit(pa.array([], pa.string()), np.zeros(0, np.int64))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs' columns `keep` (id_col if not given) and the score, as column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    keep = [id_col] if keep is None else keep
    if name in keep:
        raise ValueError(f"docs already have a column {name}")
    text = free_name("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            found = [score_texts(shared.value, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs)]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), pa.array(values)], names=[*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(F.col(text_col).alias(text), *keep).mapInArrow(run, schema)
