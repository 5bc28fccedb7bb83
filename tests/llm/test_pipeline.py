"""The corpus pipeline and its stages."""

import corpus_pipeline as p
from cases import CLASHING, DATA, documents, nothing, table
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, pii, quality, simhash


def test_stages_follow_their_operators(spark):
    docs = table(spark, "documents")
    kept = p.keep_quality(spark, docs, DATA)
    assert kept.columns == docs.columns
    keys, _, least = quality.sampled_keys(docs, table(spark, "labels"))
    want = {r["doc_id"] for r in keys.collect() if r["sample_key"] >= least}
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()
    clean = p.drop_leaks(spark, docs, DATA)
    leaks = {r["doc_id"] for r in decontaminate.with_leaks(docs, table(spark, "benchmark")).where(F.size("leaks") > 0).collect()}
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - leaks
    changed = p.replace_pii(spark, docs, DATA)
    assert changed.where(F.length("text") != F.col("n_chars")).count() == 0 and changed.count() == docs.count()
    single = p.drop_copies(spark, docs, DATA)
    assert 0 < single.count() < docs.count() and single.select("text").distinct().count() == single.count()


def test_run_and_its_pieces(spark):
    docs = table(spark, "documents")
    rows = p.run(spark, DATA)
    for stage in (p.keep_quality, p.drop_copies, p.drop_leaks, p.replace_pii):
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_awkward_rows(spark):
    for docs in (documents(spark).repartition(1), nothing(spark)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= docs.count()
            assert all(r[c] == "x" for r in out.collect() for c in CLASHING)  # the caller's columns come back as they were
        assert p.pack_sequences(spark, docs, DATA).count() >= docs.count()


def test_surrogates_and_copies_agree_with_their_operators(spark):
    docs = documents(spark)
    assert sorted(map(str, p.replace_pii(spark, docs, DATA).select("text").collect())) == sorted(map(str, pii.surrogates(docs).select("text").collect()))
    assert p.drop_copies(spark, docs.repartition(1), DATA).count() == simhash.without_copies(docs.repartition(1)).count()
