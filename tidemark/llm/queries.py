"""One query for each operator, over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracle import ORACLES


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows of other folds than the held-out one."""
    from .common import fold
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = score(docs, net)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document and in the layers encoded inside it."""
    from .secret_scan import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier in the corpus."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights; documents of plain words are likelier in a partial epoch."""
    from .mixing import mix, plainness

    return mix(table(spark, sf_dir, "documents"), quality=plainness(F.col("text")))


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and PPM scores of every document, learnt from those in other folds than the held-out one."""
    from .common import fold
    from .ppm import score

    scored = score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings whose cosine is 0.95 or more."""
    from .rotation_codes import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted; figures are read back from the output."""
    from . import chat_format as c

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long"), "id", F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1), F.lit("</s>[INST] ok [/INST]"))
    done = c.format_records(c.from_rows(rows.union(control))).withColumn("back", c.parsed(F.col("formatted")))
    said = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    done = done.withColumn("said", F.array_join(said, "")).withColumn("loss", c.under_mask(F.col("formatted"), F.col("loss_mask")))
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited version, and their likeness."""
    from .iblt import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard index of 0.75 or more."""
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding, as digests, of every document under the multilingual vocabulary."""
    import public_tokenizers

    from .byte_bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents by source, and whether tampered rows still lead to the root."""
    from . import merkle as m

    docs = table(spark, sf_dir, "documents")
    cols = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    text = F.col("text").cast("string")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
    changed = F.when(cut != text, F.unhex(m.digest_of(*cols(cut))))
    rows = m.manifest(docs, m.digest_of(*cols(text)), F.col("source"), changed=changed)
    again = m.folded(F.coalesce(F.lower(F.hex("changed")), "leaf"), F.col("proof"), F.col("path"))
    rows = rows.withColumn("folded_root", again).withColumn("proof_sha256", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, every tenth by hash of its id made periodic from a word on."""
    from .periodic_runs import runs

    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))

    def periodic(w):
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (1 + F.call_function("div", n - a, 3 + g % 8)).cast("int")
        rest = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, 1, a), rest), " ")

    word = r"[^\x20\x09-\x0D]+"
    changed = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(word), F.lit(0))), periodic), F.lit(0))
    found = runs(docs.select("doc_id", F.when((h % 10 == 0) & text.rlike(word), changed).otherwise(text).alias("text")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c")))), F.lit(0))
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.b").alias("start"),
        (-F.col("best.a")).alias("length"),
        F.col("best.c").alias("period"),
        F.call_function("div", -1000 * F.col("best.a"), F.col("best.c")).alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows of other folds than the held-out one."""
    from .common import fold
    from .language import predict, train

    docs = table(spark, sf_dir, "documents")
    said = predict(docs, train(docs, fold("doc_id", 5) != 0))
    return said.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_ppm_score": op5_ppm_score,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_iblt_fingerprint": op8_iblt_fingerprint,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}

__all__ = ["ORACLES", "QUERIES"]
