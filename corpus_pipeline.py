"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Documents that read as toxic go; of near-duplicate documents one stays; secrets are
masked; sources are mixed to their weights; what is left is encoded. Every stage but the last
returns the columns of documents and works on all rows that its predecessor kept.

Null texts are empty to every stage; empty tables pass through as empty. Rows without an id are kept like
others, but learn no label and link with nothing. Repeated rows (equal id and text) score alike; the second
stage leaves one of them, so later ones see none unless they have no id or word; the mix may take copies of a row in any order, with the same
totals. Ties: of near duplicates of one id the least text hash stays, equal keys of the mix go by id. Very long texts are whole in
every stage. Further columns of any name are kept by all stages but the last, which returns none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import encode
from tidemark.llm.common import discard, few, free_name, table, written
from tidemark.llm.mixing import mixed_documents, plainness
from tidemark.llm.ngram_join import component_rows
from tidemark.llm.secret_scan import redact_documents
from tidemark.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a network trained on the labelled ones."""
    net = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    mark = free_name("score", docs.columns)
    return score(docs, net, keep=docs.columns, name=mark).where(F.col(mark) < 0.5).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard index of 0.75 or more, the row of least id and text hash.

    Rows are told apart by id and text, so an id with several texts loses only what is a near
    duplicate; of rows equal in both one stays. Rows without an id or a word all stay.
    """
    tie = free_name("tie", docs.columns)
    docs = docs.withColumn(tie, F.xxhash64(F.coalesce("text", F.lit(""))))
    linked = written(component_rows(docs, extra=(tie,)).where("component IS NOT NULL").select("doc_id", tie, "component"))
    own = F.struct("doc_id", tie)
    heads = linked.groupBy("component").agg(F.min(own).alias("head"))
    gone = linked.join(heads, "component").where(own != F.col("head")).select("doc_id", tie).distinct()
    left = docs.join(few(gone), ["doc_id", tie], "left_anti")
    again = linked.groupBy("doc_id", tie).count().where("count > 1").drop("count")
    if not again.isEmpty():
        again = few(again)
        left = left.join(again, ["doc_id", tie], "left_anti").unionByName(left.join(again, ["doc_id", tie], "left_semi").dropDuplicates(["doc_id", tie]))
    return left.drop(tie).select(*[c for c in docs.columns if c != tie])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars that of the new text."""
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; plain ones are likelier in a partial epoch."""
    return mixed_documents(docs, quality=plainness(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document that is left, for each time it is taken."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Trained weights and hashed keys decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return docs
