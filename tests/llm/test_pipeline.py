from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize
from tallyspark.llm.jaccard_join import jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "12 34 !!", None, None, 8), (-3, "Hello there the and of with", None, "src1", 27), (-3, "Hello there the and of with", None, "src1", 27)], docs.schema)
    docs = docs.unionByName(odd)
    (_, language), (_, dedupe), (_, blend), (_, packing) = corpus_pipeline.STAGES
    a = materialize(language(spark, docs, SF), "a")
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} - {r[0] for r in a.select("doc_id").distinct().collect()} == {-1, -2} and a.columns == docs.columns
    b = materialize(dedupe(spark, a, SF), "b")
    members, links = jaccard_join(b)
    assert links.count() == 0 and members.where("component is not null").groupBy("component").count().where("count > 1").count() == 0 and b.columns == docs.columns
    groups = jaccard_join(a)[0].groupBy(F.coalesce("component", "doc_id")).count().count()
    assert b.count() == groups
    c = materialize(blend(spark, b, SF), "c")
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert c.columns == docs.columns and abs(words(c) - words(b)) <= 0.02 * words(b) and c.where("text is null").count() == 0
    d = packing(spark, c, SF)
    assert d.select("sequence_id").distinct().count() > 0 and d.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_null_and_equal_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[2]), (8, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialize(corpus_pipeline.deduplicate(spark, docs, SF), "kept")
    want = sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])], key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want
    mixed = corpus_pipeline.blend(spark, kept, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in mixed), key=repr) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
