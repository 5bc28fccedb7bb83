"""Tables that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
CLASHING = "_row fingerprint label leaks row key component_id sequence_id log_weight sample_key entities piece score th good n vertex bytes held_out predicted text_key".split()
LONG = " ".join(f"word{i % 977} runs{i % 31}" for i in range(60_000))
TEXTS = [None, "", "  \n\t ", "one", LONG, "a b c d e f g h i j k l", "a b c d e f g h i j k l", "tie tie tie", "é ß Ω 漢字 🙂 plain", "<|endoftext|> as text"]


def documents(spark, texts=None):
    """The texts by number; one row twice, one with a null id, and columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS if texts is None else texts)]
    if texts is None:
        rows += [rows[5], (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def nothing(spark):
    return documents(spark).limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def table(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")
