"""Language of a text by a bidirectional gated recurrent network over bytes.

A step is a byte, A-Z as a-z. Two gated recurrent layers read a word from both ends, words longer than
WINDOW bytes in pieces of that length; the states at each byte give it probabilities over the languages,
so every position is labelled. A text's probabilities are the mean over all its positions. A word's
positions do not depend on its neighbours, so words that a slice of texts repeats are read once.

Training is in numpy by backpropagation through time in one task, on a bounded sample of labelled rows: of
each of the LANGUAGES most frequent languages the rows of least hash, at most SAMPLE rows, none longer than
TEXT_BYTES and together at most SAMPLE_BYTES of all languages. From them it takes the WORDS most frequent distinct words, each
labelled at every position with the languages it occurs in. The task is the sample's size whatever the corpus
has, is run again if its executor is lost, and all is seeded.

A null text, one without a letter (Unicode L) and, where nothing was learnt, any text is `und` with score 0.
Otherwise the score is the probability of the language named; of equal ones the least by code point is. Rows
without an id or language are predicted and not learnt from (null ids: as the caller's condition says). Repeated
rows count once in the sample and are predicted alike. Very long texts are read whole, in one slice. An
empty table gives no rows. Other columns are never read. Rows are independent: predicting has no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblock import column_bytes, mix, release, slices, words
from .toxicity import _Adam, _sigmoid, _summed

#: Languages learnt at most, labelled rows of each, and bytes of one row and of all rows that training takes at most.
LANGUAGES, SAMPLE, TEXT_BYTES, SAMPLE_BYTES = 64, 400, 1 << 18, 16 << 20
#: Distinct words that training takes at most.
WORDS = 60_000
WINDOW, EMBED, HIDDEN = 24, 8, 8
PASSES, BATCH, RATE = 5, 256, 0.01
#: Windows that are labelled together.
TOGETHER = 8192
#: Rows whose hash passes, as a multiple of those wanted.
MARGIN = 3.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size) of each distinct window, and (window, text) of each use of one: a word or a piece of a long one."""
    h, s, e, of = words(data, offs)
    short = e - s <= WINDOW
    _, once, row = np.unique(h[short], return_index=True, return_inverse=True)
    begin, length = s[short][once], (e - s)[short][once]
    s, e, of_long = s[~short], e[~short], of[~short]
    pieces = -(-(e - s) // WINDOW)
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(s, pieces) + turn * WINDOW
    size = np.minimum(WINDOW, np.repeat(e, pieces) - at)
    return np.concatenate([begin, at]), np.concatenate([length, size]), np.concatenate([row, len(once) + np.arange(len(at))]), np.concatenate([of[short], np.repeat(of_long, pieces)])


class Tagger:
    """Weights, probabilities of windows of equal length, and their gradients."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(13)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.languages = languages
        self.w = {"e": draw(256, EMBED, scale=0.5)}
        for d in "fb":
            self.w |= {f"x{d}": draw(EMBED, 3 * HIDDEN, scale=0.4), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3)}
        self.w |= {"o": draw(2 * HIDDEN, len(languages), scale=0.3), "oc": np.zeros(len(languages), np.float32)}

    def tables(self) -> dict[str, np.ndarray]:
        """What each byte adds to the gates, by direction."""
        return {d: self.w["e"] @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def positions(self, tables: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities by step, window and language; ids: [windows, steps] bytes."""
        n, steps = ids.shape
        h_all = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for k, (d, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
            h, u, tape = np.zeros((n, HIDDEN), np.float32), self.w[f"u{d}"], []
            for t in order:
                p, g = tables[d][ids[:, t]], h @ u
                zr = _sigmoid(p[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(p[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                if keep is not None:
                    tape.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                h_all[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            if keep is not None:
                keep[d] = tape
        logit = h_all @ self.w["o"] + self.w["oc"]
        logit -= logit.max(2, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(2, keepdims=True)
        if keep is not None:
            keep["h"] = h_all
        return logit

    def gradients(self, ids: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over positions: wanted [windows, languages] shares, weight of each window."""
        keep: dict = {}
        p = self.positions(self.tables(), ids, keep)
        scale = (weight / (weight.sum() * ids.shape[1])).astype(np.float32)
        d_logit = (p - wanted[None]) * scale[None, :, None]
        h = keep["h"]
        g = {"o": h.reshape(-1, h.shape[2]).T @ d_logit.reshape(-1, d_logit.shape[2]), "oc": d_logit.sum((0, 1)), "e": np.zeros_like(self.w["e"])}
        d_h = d_logit @ self.w["o"].T
        for k, d in enumerate("fb"):
            u, d_u = self.w[f"u{d}"], np.zeros_like(self.w[f"u{d}"])
            carry = np.zeros((len(ids), HIDDEN), np.float32)
            d_p = np.zeros((len(ids), ids.shape[1], 3 * HIDDEN), np.float32)
            for t, before, z, r, new, gn in reversed(keep[d]):
                dh = carry + d_h[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dz, dn = dh * (before - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                d_p[:, t] = np.concatenate([dz, dr, dn], 1)
                d_u += before.T @ dg
                carry = dh * z + dg @ u.T
            rows = _summed(ids.ravel(), d_p.reshape(-1, 3 * HIDDEN), 256)
            g |= {f"u{d}": d_u, f"x{d}": self.w["e"].T @ rows, f"c{d}": rows.sum(0)}
            g["e"] += rows @ self.w[f"x{d}"].T
        return g

    def summed(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[windows, languages]: the sum of each window's probabilities over its positions."""
        tables, out = self.tables(), np.zeros((len(start), len(self.languages)), np.float32)
        order = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[order], np.arange(1, WINDOW + 2))
        for length, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
            for k in range(a, b, TOGETHER):
                rows = order[k : min(k + TOGETHER, b)]
                out[rows] = self.positions(tables, _LOWER[data[start[rows, None] + np.arange(length)]]).sum(0)
        return out


def fit(texts: pa.Array | pa.ChunkedArray, label: np.ndarray, languages: list[str]) -> Tagger:
    """A tagger trained on texts and the numbers of their languages."""
    net = Tagger(languages)
    data, offs = column_bytes(texts)
    start, size, row, of = windows(data, offs)
    if len(languages) < 2 or not len(start):
        return net
    count = np.stack([np.bincount(row[label[of] == k], minlength=len(start)) for k in range(len(languages))], 1)
    total = count.sum(1)
    place = mix(np.arange(len(start), dtype=np.uint64))
    chosen = np.lexsort((place, -total))[:WORDS]
    start, size, count, total = start[chosen], size[chosen], count[chosen], total[chosen]
    wanted, weight = (count / total[:, None]).astype(np.float32), np.sqrt(total).astype(np.float32)
    adam, rng = _Adam(net.w), np.random.default_rng(17)
    for turn in range(PASSES):
        batches = []
        for length in np.unique(size):
            same = rng.permutation(np.flatnonzero(size == length))
            batches += [same[k : k + BATCH] for k in range(0, len(same), BATCH)]
        for k, b in enumerate(rng.permutation(len(batches))):
            at = batches[b]
            ids = _LOWER[data[start[at, None] + np.arange(size[at[0]])]]
            adam.step(net.gradients(ids, wanted[at], weight[at]), RATE * 0.5 ** (turn + k / len(batches)))
    return net


def predict_texts(net: Tagger, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its language, probability of it) of each text; -1 and 0 for a text without words."""
    n = len(offs) - 1
    start, size, row, of = windows(data, offs)
    if not len(net.languages) or not len(start):
        return np.full(n, -1), np.zeros(n)
    each = net.summed(data, start, size)
    held = np.bincount(of, size[row], n)
    pooled = np.stack([np.bincount(of, each[row, k], n) for k in range(len(net.languages))], 1) / np.maximum(held, 1)[:, None]
    best = pooled.argmax(1)
    return np.where(held > 0, best, -1), np.where(held > 0, np.clip(pooled[np.arange(n), best], 0, 1), 0.0)


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    """((text, label) rows that training takes, in one partition; the languages by label)."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.where(learn & lang.isNotNull() & (F.octet_length(text) <= TEXT_BYTES)).select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("order"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return docs.sparkSession.createDataFrame([], "text string, label int"), []
    known = docs.sparkSession.createDataFrame([(r.lang, languages.index(r.lang), min(1.0, MARGIN * SAMPLE / r["count"])) for r in counts], "lang string, label int, share double")
    few = rows.join(F.broadcast(known), "lang").where(F.col("order").cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    few = few.dropDuplicates(["label", "order"])
    of_label = Window.partitionBy("label").orderBy("order")
    few = few.withColumn("rank", F.row_number().over(of_label)).where(F.col("rank") <= SAMPLE)
    few = few.withColumn("held", F.sum(F.octet_length("text")).over(of_label)).where(F.col("held") <= SAMPLE_BYTES // len(languages))
    return few.select("text", "label", "order").coalesce(1), languages


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger:
    """A tagger of the languages of the rows of docs where `learn` holds, fitted on a bounded sample in one task."""
    rows, languages = sample(docs, learn, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            got = pa.Table.from_batches(got).sort_by([("label", "ascending"), ("order", "ascending")])
            net = fit(got.column("text"), got.column("label").to_numpy(), languages)
            release()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    row = rows.mapInArrow(run, "net binary").first() if languages else None
    return pickle.loads(row[0]) if row else Tagger([])


def predict(docs: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = np.array([*shared.value.languages, "und"], object)
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            found = [predict_texts(shared.value, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs)]
            label, score = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
            lettered = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            label = np.where(lettered, label, -1)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(names[label], pa.string()), pa.array(np.where(label < 0, 0.0, score), pa.float64())], names=[id_col, "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(id_col).alias("id")).mapInArrow(run, schema)
