"""Merkle manifests, periodic runs and languages against brute force, with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, merkle, periodic_runs
from tidemark.llm.common import ship_package

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout=3):
    """(root, siblings of each leaf from the bottom up)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf, node in enumerate(at):
            run = node // fanout
            proofs[leaf] += [x for k, x in enumerate(runs[run]) if k != node % fanout]
            at[leaf] = run
        nodes = [digest(*r) for r in runs]
    return nodes[0], proofs


def brute_manifest(rows):
    """{(id, leaf): {(subroot, root, siblings)}} of rows (id, source, text)."""
    leaf = lambda r: digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1], bytes.fromhex(x[2])))]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = {}
    for g, up in zip(names, above, strict=True):
        ordered = sorted(groups[g], key=lambda x: (x[0], x[1], bytes.fromhex(x[2])))
        for x, siblings in zip(ordered, trees[g][1], strict=True):
            out.setdefault((x[3], x[2]), set()).add((trees[g][0], root, "".join(siblings + up)))
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_is_the_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ROWS", 30)
    rng = random.Random(3)
    sizes = {None: 4, "": 1, "a": 82, "é": 27, "z": 3, "Z": 2, "hot": 200}
    rows = [(rng.choice([None, k, k]), source, rng.choice([None, "", "é\n", "t" * k])) for source, n in sizes.items() for k in range(n)]
    rows += [rows[20]] * 5 + [(50, "hot", "long " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x")).repartition(5)
    got = merkle.manifest(df, merkle.digest_of(F.col("doc_id"), F.col("source"), F.col("text")), F.col("source"), size=F.length("text"))
    want, seen = brute_manifest(rows), 0
    for r in got.collect():
        assert (r.subroot, r.root, r.proof.hex()) in want[r.doc_id, r.leaf]
        assert merkle.fold(r.leaf, bytes(r.proof), [(p.idx, p.n) for p in r.path]) == r.root
        other = digest("other")
        assert (merkle.fold(other, bytes(r.proof), [(p.idx, p.n) for p in r.path]) == r.root) is False
        seen += 1
    assert seen == len(rows)


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    leaf = merkle.digest_of(F.col("doc_id"), F.col("text"))
    one = merkle.manifest(df, leaf, F.col("source")).first()
    assert one.leaf == one.subroot == one.root and len(one.proof) == 0
    assert merkle.manifest(df.limit(0), leaf, F.col("source")).count() == 0


def brute_runs(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def kept(words, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def texts_with_runs():
    rng = random.Random(7)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a A a A a A a A", "é é é é é é é", "x y " * 8]
    for _ in range(600):
        words = [rng.choice("abcA"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(60))]
        if words and rng.random() < 0.5:
            a, p = rng.randrange(len(words)), rng.randrange(1, 9)
            words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
        out.append(rng.choice([" ", "\n ", "\t"]).join(words) + rng.choice(["", " "]))
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out += [" ".join(fibonacci[-1]), " ".join("ab"[bin(k).count("1") % 2] for k in range(600)), ("p q r " * 40 + "s ") * 6, "w " * 700]
    return out + [out[12], out[12]]


@pytest.mark.parametrize("small", [True, False])
def test_runs_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(periodic_runs, "TOGETHER", 7)
    texts = texts_with_runs()
    df = spark.createDataFrame([(k if k % 50 else None, k, t) for k, t in enumerate(texts)], "doc_id long, runs int, text string").repartition(3)
    if small:
        data, offs = periodic_runs.column_bytes(pa.array(texts))
        _, text, *cols, _ = periodic_runs.runs_of_texts(data, offs)
        got = {}
        for t, *run in zip(text.tolist(), *[c.tolist() for c in cols], strict=True):
            got.setdefault(t, []).append(tuple(run))
        for k, t in enumerate(texts):
            assert got.get(k, []) == brute_runs(WORD.findall(t or ""))
        return
    for r in periodic_runs.runs(df.withColumn("k", F.col("runs")), id_col="k").collect():
        words = WORD.findall(texts[r.k] or "")
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == kept(words, want)


def test_runs_of_a_very_long_text():
    rng = random.Random(9)
    block = [f"w{rng.randrange(50)}" for _ in range(4000)]
    words = [f"u{k}" for k in range(300_000)] + block * 30 + ["end"]
    data, offs = periodic_runs.column_bytes(pa.array([" ".join(words)]))
    found, text, start, length, period, keep = periodic_runs.runs_of_texts(data, offs)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([300_000], [120_000], [4000])
    assert keep.sum() == 304_001
    with pytest.raises(ValueError, match="k-grams"):
        periodic_runs.gram_size(3, 2)


def test_words_of_one_hash_are_told_apart():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    same = periodic_runs._numbers(data, np.array([5, 5, 5], np.uint64), np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert same[0] == same[2] != same[1]


def test_query_of_runs_changes_every_tenth(spark, tmp_path):
    from tidemark.llm.queries import op12_periodic_runs

    rng = random.Random(10)
    rows = [(k, " ".join(rng.choice(["x", "y", "zz", "é"]) for _ in range(rng.randrange(90))) if k % 7 else None, 1) for k in range(120)] + [(None, "n " * 9, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r.collapsed_sha256 == digest(kept(words, runs))


def test_language_gradients():
    rng = np.random.default_rng(1)
    net = language.Tagger(["a", "b", "c"])
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    ids = rng.integers(97, 123, (5, 7)).astype(np.uint8)
    wanted, weight = rng.dirichlet([1, 1, 1], 5), rng.uniform(1, 2, 5)

    def loss():
        p = net.positions(net.tables(), ids).astype(np.float64)
        return -(wanted[None] * np.log(p)).sum(2).mean(0) @ weight / weight.sum()

    grads = net.gradients(ids, wanted, weight)
    for name, g in grads.items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(0 for _ in g.shape)]:
            kept_value, e = net.w[name][at], 1e-3
            net.w[name][at] = kept_value + e
            up = loss()
            net.w[name][at] = kept_value - e
            down = loss()
            net.w[name][at] = kept_value
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3 * max(1, abs(g[at]) * 10), name


def test_windows_cover_every_byte_once():
    texts = ["Abc de abc", "", "x" * 100, None, " é  " + "長い" * 30]
    data, offs = language.column_bytes(pa.array(texts))
    start, size, window, text = language.windows(data, offs)
    held = np.bincount(text, size[window], len(texts))
    assert held.tolist() == [sum(len(w.encode()) for w in WORD.findall(t or "")) for t in texts]
    assert size.max() <= language.WINDOW
    net = language.Tagger(["a", "b"])
    slow = net.positions(net.tables(), np.frombuffer(b"abc", np.uint8)[None])[:, 0].sum(0)
    assert np.allclose(net.summed(data, start, size)[window[0]], slow, atol=1e-5)


def invented(spark, n=400):
    rng = random.Random(12)
    parts = {"aa": ["ka", "to", "ri"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "ñe", "ll"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))).capitalize() for _ in range(rng.randrange(3, 30))), lang) for k in range(n) for lang in [rng.choice(list(parts))]]
    odd = [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34 !?", "cc"), (n + 3, "KA TORI", None), (None, "schung", "bb"), (n + 4, "katori " * 60_000, "aa"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(*r, 0.5, "y") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)


def test_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "PASSES", 8)
    docs = invented(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    said = language.predict(docs, language.train(docs, held != 0)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    right = [r.lang_pred == r.lang for r in said if r.lang and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) >= 0.97 * len(right) > 50
    by_id = {r.doc_id: r for r in said}
    assert [by_id[k].lang_pred for k in (400, 401, 402)] == ["und"] * 3 and by_id[400].score == 0
    assert by_id[403].lang_pred == by_id[404].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in said)
    assert language.predict(docs, language.train(docs, F.lit(False))).where("lang_pred <> 'und'").isEmpty()
    none = docs.limit(0)
    assert language.predict(none, language.train(none, F.lit(True))).count() == 0
    one = docs.where("lang = 'aa'")
    assert {r.lang_pred for r in language.predict(one, language.train(one, F.lit(True))).collect()} == {"aa", "und"}
