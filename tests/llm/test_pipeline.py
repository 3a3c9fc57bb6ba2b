"""The pipeline's stages on a small table with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import ship_package, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    ship_package(spark)
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", f"s{i % 4}", 0) for i in range(200)]
    bad = {i for i in range(0, 200, 6)}
    rows = [(i, t + " grumbold" if i in bad else t, *rest) for i, t, *rest in rows]
    rows[1] = (1, rows[1][1] + " password=hunter2hunter2", *rows[1][2:])
    rows += [(300, rows[7][1], "en", "s0", 0), (301, rows[7][1] + " more", "en", "s1", 0), (302, None, "en", None, None), (303, "", "en", "s2", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i in bad)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        kept[name] = docs
    ids = {n: {r.doc_id for r in d.collect()} for n, d in kept.items()}
    assert ids["toxicity"] >= {302, 303}
    assert len(ids["toxicity"] & bad) <= 1
    assert len(set(range(200)) - bad - ids["toxicity"]) <= 4
    assert not ids["jaccard_join"] & {300, 301}
    assert 7 in ids["jaccard_join"]
    assert ids["toxicity"] - ids["jaccard_join"] <= {300, 301}
    assert ids["secret_scan"] == ids["jaccard_join"]
    assert kept["secret_scan"].where("doc_id = 1").first().text.endswith(" [SECRET]")
    for name in ("toxicity", "jaccard_join", "secret_scan", "source_mix"):
        assert kept[name].columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept["source_mix"].where(F.length("text") != F.col("n_chars")).count() == 0
    assert kept["byte_bpe"].columns == ["doc_id", "n_tokens", "ids"]
    assert kept["byte_bpe"].count() == kept["source_mix"].count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, tie int, component long, `row` string, size int, ids string"


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids with two texts."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([1, 4, 40])), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(None, text(30), None, None, None), (60, None, "en", "s1", 1), (61, "", "en", None, 0), (62, " \n", "en", "s2", 0)]
    rows += [rows[3], rows[3], (5, text(40), "en", "s0", 0), (63, text(200_000), "en", "s1", 0), (64, "x" * 300_000, "en", "s2", 0)]
    rows += [(65, "token=abcdefgh12 " * 3000, "en", "s2", 0), (None, None, None, None, None)]
    return [(*r, 0.5, 1, 2, "r", 3, "i") for r in rows]


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    ship_package(spark)
    spark.createDataFrame(odd_documents(), ODD).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(60)] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)))
        if name != "byte_bpe":
            assert docs.columns == before.columns, name
            assert docs.where("score = 0.5 AND tie = 1 AND component = 2 AND `row` = 'r' AND size = 3 AND ids = 'i'").count() == docs.count(), name
        if name == "jaccard_join":
            assert docs.where("doc_id = 3").count() <= 1  # of repeated rows one
            assert docs.where("doc_id IS NULL").count() == before.where("doc_id IS NULL").count()
        if name == "secret_scan":
            assert docs.count() == before.count() and docs.where("text LIKE '%abcdefgh12%'").isEmpty()
        if name == "source_mix":
            assert docs.where("length(trim(text)) = 0 OR text IS NULL").isEmpty()  # of no words, never wanted
        if name == "byte_bpe":
            assert docs.count() == before.count()


def test_empty_tables(spark, tmp_path):
    ship_package(spark)
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
