"""The registered queries themselves, over small tables with nulls, empty and long texts, repeats and further columns."""

import base64
import bz2
import gzip
import hashlib
import lzma
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import iblt, registry, secret_scan
from tidemark.llm.common import ship_package

WORD = re.compile(r"[^\x20\x09-\x0d]+")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, size long, `set` long"


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé<[\\") for _ in range(rng.randint(1, 7))) for _ in range(90)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [texts[3], texts[3] + " tail", "\n".join(texts[5].split(" ")), None, "", " \t\n", "one word", "x" * 700, "token=abcdefgh12 AKIA" + "Z" * 20 + " " + "0f" * 20]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(4000))]  # long beside the others
    return [(i, t, "en", (None, "b", "a", "é")[i % 4], 0, 0.5, 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    ship_package(spark)
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(12)
    docs = documents()
    vectors = [(k, [rng.gauss(0, 1) for _ in range(12)], 0) for k in range(60)]
    vectors += [(100 + k, [x + rng.gauss(0, 0.02) for x in vectors[k % 5][1]], 0) for k in range(15)]
    vectors += [(200, None, 0), (201, [0.0] * 12, 0), (202, [float("nan")] * 12, 0), (203, vectors[7][1], 0)]
    talks = [(c, t, role, text, "x") for c in range(12) for t, role, text in shape(c)]
    frames = {
        "documents": spark.createDataFrame(docs, DOCS),
        "labels": spark.createDataFrame([(i, 0, int(i % 5 == 2)) for i in range(0, 40)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
        "conversations": spark.createDataFrame(talks, "conv_id long, turn int, role string, text string, layout string"),
    }
    for name, df in frames.items():
        df.repartition(3).write.parquet(str(root / f"{name}.parquet"))
        df.limit(0).write.parquet(str(root / "none" / f"{name}.parquet"))
    return str(root)


def shape(c):
    """Conversations of all layouts, one with nulls, ties and repeated rows."""
    text = f"say {c} <|im_end|>\n [x] \\0"
    ask, reply = (0, "user", text), (1, "assistant", text + "!")
    return (
        [ask, reply],
        [(0, "system", "s"), (1, "user", text), (2, "assistant", "a")],
        [(0, "assistant", text)],
        [ask, reply, (2, "user", "q"), (3, "assistant", "")],
        [(0, "system", "s"), (1, "tool", text), (2, "human", "h"), (3, "assistant", None)],
        [(None, "user", text), (0, None, "z"), (0, "assistant", "b"), (0, "assistant", "b"), (None, "assistant", "late")],
    )[c % 6]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    have, want = QUERIES[name](spark, tables).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(have.columns)
    assert columns == sorted(want.columns)
    plain = lambda x: "null" if x is None or str(x) in ("nan", "<NA>") else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist())
    assert rows(have) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    got = QUERIES[name](spark, f"{tables}/none")
    assert got.count() == (1 if name == "op7_chat_format" else 0)  # conversation -1 is always there


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_columns(spark, tables):
    got = QUERIES["op1_toxicity"](spark, tables).collect()
    assert sorted(r.doc_id for r in got) == [d[0] for d in documents()]
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def base_spans(text):
    """The stated patterns by plain search from each place on."""
    rules = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    found = []
    for rank, (kind, rule, good) in enumerate(rules):
        at = 0
        while m := rule.search(text, at):
            at = m.end()
            if good(m):
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_secret_base_on_random_texts(spark, tables):
    rng = random.Random(13)
    parts = ["token", "API_KEY", "apikey", "secret", "passwd", "PASSWORD", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "\n", "x", "-_/", "zz..", "İ", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(24)))
        base, every = secret_scan.scan(text)
        assert [f"{k}:{s}:{e}" for k, s, e in base] == base_spans(text)
        assert set(base) <= set(every)
    for r in QUERIES["op2_secret_scan"](spark, tables).collect():
        want = base_spans(documents()[r.doc_id][1] or "")
        kinds = [x.split(":")[0] for x in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secret_scan.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


SECRET = b"password=hunter2hunter2 "


def percent(data):
    return "".join(f"%{b:02x}" for b in data)


def packed_forms():
    """Ways to pack a secret: long names in headers, small windows, bare deflate, other formats."""
    text = SECRET + b"and so on " * 40
    for size in (0, 240, 300, 1000, 40_000):
        plain = gzip.compress(text)
        yield f"gzip name {size}", plain[:3] + b"\x08" + plain[4:10] + b"n" * size + b"\0" + plain[10:]
    for bits in range(9, 16):
        for level in (1, 6, 9):
            d = zlib.compressobj(level, zlib.DEFLATED, bits)
            yield f"zlib {bits} {level}", d.compress(text) + d.flush()
    yield "bz2", bz2.compress(text)
    yield "xz", lzma.compress(text)
    yield "twice", gzip.compress(zlib.compress(text))
    yield "members", gzip.compress(b"first") + gzip.compress(text)


def kinds_in(text):
    return {k for k, _, _ in secret_scan.scan(text)[1]}


def test_packed_secrets_are_found():
    for name, data in packed_forms():
        assert kinds_in("a " + percent(data) + " b") == {"assign"}, name
        for before in (b"", b"\x01\x02\x03\x04"):
            coded = base64.b64encode(before + data).decode()
            assert kinds_in(f"a {coded} b") == {"assign"}, (name, before)
            assert "assign" not in kinds_in(secret_scan.redacted(coded, secret_scan.scan(coded)[1])), name
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    bare = d.compress(SECRET + b"x " * 30) + d.flush()
    assert kinds_in("a " + base64.b64encode(bare).decode() + " b") == {"assign"}
    assert kinds_in("a " + base64.b64encode(os.urandom(3000)).decode()) <= {"hex"}


def test_what_unpacks_to_much_is_a_stream(monkeypatch):
    """With pieces of 4000 bytes, all that is found with pieces of 8 MB is found, runs over many pieces included."""
    rng = random.Random(4)
    filler = lambda n: "".join(f"{rng.randrange(10**6)} " for _ in range(n // 7)).encode()
    inner = filler(30_000) + SECRET + filler(9000)
    stored = zlib.compressobj(0)
    loose = stored.compress(inner) + stored.flush()  # as long as what it holds
    cases = {
        "plain": inner,
        "base64": b"x " + base64.b64encode(zlib.compress(inner)) + b" y",
        "long base64": filler(5000) + base64.b64encode(loose) + b" " + filler(5000),
        "lines of base64": filler(5000) + base64.encodebytes(loose) + b" " + filler(5000),
        "packed in packed": filler(5000) + loose + filler(5000),
        "percent": filler(3000) + percent(loose).encode() + filler(3000),
        "percent of base64": filler(3000) + percent(base64.b64encode(loose)).encode() + filler(100),
        "escapes": filler(3000) + "".join(f"\\x{b:02x}" for b in base64.b64encode(loose)).encode() + filler(100),
        "utf-16": (filler(3000) + base64.b64encode(loose) + b" ").decode().encode("utf-16-le"),
        "three": base64.b64encode(zlib.compress(filler(9000) + base64.b64encode(loose) + b" ")) + b" ",
    }
    monkeypatch.setattr(secret_scan, "PIECE", 4000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 400)
    monkeypatch.setattr(secret_scan, "STEP", 700)
    for name, data in cases.items():
        text = base64.b64encode(zlib.compress(data)).decode()
        spans = secret_scan.scan(f"see {text} end")[1]
        assert ("assign", 4, 4 + len(text.rstrip("="))) in spans, name
    zeros = base64.b64encode(zlib.compress(bytes(3_000_000))).decode()
    assert kinds_in(zeros) == set()


def test_scores_know_their_fold(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op5_ppm_score"](spark, tables).collect()}
    tokens = {d[0]: len(WORD.findall(d[1] or "")) + 1 for d in documents()}
    assert {i: r.n_tokens for i, r in got.items()} == tokens
    assert all(r.held_out == (fold(i, 7) == 2) and r.score < 0 for i, r in got.items())
    assert {r.train_tokens for r in got.values()} == {sum(n for i, n in tokens.items() if fold(i, 7) != 2)}


def test_fingerprints_tell_edits_from_others(spark, tables):
    texts = {d[0]: d[1] or "" for d in documents()}
    order = sorted(texts, reverse=True)
    for r in QUERIES["op8_iblt_fingerprint"](spark, tables).collect():
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        text = texts[r.doc_id]
        k = len(text) // 3
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)


def test_large_differences_are_peeled(spark):
    rng = random.Random(14)
    a, b = ([f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (900, 1300))
    same = [f"s{k}" for k in range(50)]
    rows = spark.createDataFrame([(a + same, b + same)], "a array<string>, b array<string>")
    hashed = [F.transform(c, lambda x: F.xxhash64(x)) for c in "ab"]
    got = rows.select(iblt.difference(*hashed).alias("d"), *[h.alias(c) for h, c in zip(hashed, "ab", strict=True)]).first()
    assert {(x.key, x.n) for x in got.d} == {(x, 1) for x in set(got.a) - set(got.b)} | {(x, -1) for x in set(got.b) - set(got.a)}


def test_bpe_digests(spark, tables):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from tidemark.llm.byte_bpe import load_ranks

    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op10_byte_bpe"](spark, tables).collect():
        text = documents()[r.doc_id][1] or ""
        want = theirs.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_next_among_hot_and_null_ids(spark, monkeypatch):
    """Runs stay small where one id or no id has very many rows, and every row's next is the same."""
    monkeypatch.setattr(iblt, "RUN", 8)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abc") for _ in range(5))
    rows = [(rng.choice([None, 7, 7, 9, k, k + 400]), " ".join(word() for _ in range(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = df.withColumn("id", F.col("doc_id")).withColumn("tie", F.xxhash64("text")).withColumn("run", iblt._runs(df, "doc_id")).groupBy("run").count()
    assert sizes.agg(F.max("count")).first()[0] < 40
    ties = {r.text: r.tie for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    want = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    got = iblt.with_next(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(r.next.text == want[r.id, r.own.text] for r in got)
    assert iblt.with_next(df.where("doc_id IS NULL"), "doc_id", "text").count() == sum(r[0] is None for r in rows)


def test_likeness_without_a_size_that_peels(spark, monkeypatch):
    monkeypatch.setattr(iblt, "SIZES", (3,))
    monkeypatch.setattr(iblt, "FIRST", 6)
    rng = random.Random(22)
    pairs = [([rng.randrange(40) for _ in range(rng.randrange(60))], [rng.randrange(40) for _ in range(rng.randrange(60))]) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(*[F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))).alias(c) for c in "ab"])
    for r in rows.select("a", "b", iblt.likeness(F.col("a"), F.col("b"), iblt.difference(F.col("a"), F.col("b"))).alias("near")).collect():
        a, b = set(r.a), set(r.b)
        assert r.near == pytest.approx(len(a & b) / len(a | b) if a | b else 1)


def test_repeated_rows_are_scored_alike(spark, tmp_path):
    """Rows of equal id and text, and a text of a megabyte: each row is there once and like its copies."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(200)]
    rows = [(k % 25, " ".join(words[(k % 25) * 3 + j] for j in range(30)), "en", "s", 0) for k in range(75)]
    rows += [(100, " ".join(rng.choice(words) for _ in range(200_000)), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0, k % 2) for k in range(25)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op1_toxicity", "op2_secret_scan", "op5_ppm_score", "op8_iblt_fingerprint", "op10_byte_bpe", "op11_merkle_manifest", "op12_periodic_runs", "op13_language_id"):
        got = QUERIES[name](spark, str(tmp_path))
        one = [c for c in got.columns if c not in ("near_edited", "near_next", "edited_sha256", "edited_fingerprint", "proof_sha256", "folded_root")]
        assert got.count() == len(rows), name
        assert got.select(*one).distinct().count() == 26, name


def test_mix_with_very_many_copies_at_the_end(spark, monkeypatch, tmp_path):
    """Copies in shares give the totals that they give in order, whatever has nulls."""
    from tidemark.llm import mixing

    rng = random.Random(16)
    rows = [(k, "w " * rng.randrange(1, 9), "abc"[k % 3]) for k in range(60)]
    rows += [(7, "same words all over", "a")] * 150 + [(None, "no id and source", None)] * 120
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)

    def taken():
        got = mixing.mix(df, weights=(5, 2, 1), cap=3.0).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        return sorted((r.doc_id or -1, r.size, r.source_size, r.target, r.taken) for r in got)

    plain = taken()
    monkeypatch.setattr(mixing, "SHARE", 7)
    assert taken() == plain
