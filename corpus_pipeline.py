"""The corpus pipeline: each stage applies one training-data operator to all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a table; ``run`` stores each stage's
table as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, packing, pii, quality, simhash
from marlstone.llm.common import Shelf, free_name, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes.

    Null and empty texts weigh 1, so they stay unless the cut is above; repeated rows share
    their fate; ties of the last key all stay; without labels of both kinds nothing goes; an
    empty table stays empty. The columns are those of ``docs``, unchanged.
    """
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash and BK-trees over five-word shingles.

    The smallest doc_id stays, a null one only where a group has no other; of repeated rows one
    stays; null, empty and blank texts are copies of each other; an empty table stays empty.
    """
    return simhash.without_copies(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows share their fate; an empty benchmark drops
    nothing; an empty table stays empty.
    """
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(free_name(docs, "leaks")) == 0).select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their PII; n_chars follows the new text.

    Null texts become empty; repeated rows stay and get the same text; an empty table stays
    empty.
    """
    out = pii.checked_surrogates(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    Null and empty texts are one id, the end mark; repeated rows are packed each by itself; an
    empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", replace_pii),
    ("best-fit packing", pack_sequences),
]

#: Trained models, connected components and a tokenizer's ids are beyond SQL; tests/llm compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = shelf.put(stage(spark, docs, sf_dir))
        if last:
            shelf.drop(last)
        last = path
    return docs
