"""Quality classification by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of the target text
(a bounded sample of documents labelled good) and one of all raw text, give every
document an importance weight: its log is the sum of the log ratios of its n-grams. Gumbel
noise on the log weights and taking the k largest keys samples documents without
replacement. k is asked for, or is the number of documents whose weight passes a cut
calibrated on labelled documents that the target model has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, whole

BUCKETS = 1 << 16
#: Labelled good documents that make the target model, and labelled documents of each kind that calibrate the cut, at most.
TARGET, CALIBRATE = 20_000, 3_000
FOLDS = 5
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the text's unigrams and bigrams; words and runs of punctuation are tokens."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(t) for t in _TOKEN.findall(text)], np.uint64) if text.isascii() else np.array([digest(t.encode("utf-8", "surrogatepass")) for t in _TOKEN.findall(text)], np.uint64)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([words, pairs * np.uint64(0x165667B19E3779F9)])
    return (both >> np.uint64(48)).astype(np.int64)


@dataclass
class Weights:
    """log p_target / p_raw of each bucket, the cut, and whether there is anything to go by."""

    ratio: np.ndarray
    cut: float = float("-inf")

    def log_weight(self, text: str) -> float:
        return float(self.ratio[gram_buckets(text)].sum())


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(FOLDS))


def drawn(labels: DataFrame, value: int, calibrate: bool, most: int) -> DataFrame:
    """Ids of up to ``most`` documents labelled ``value``, those of the smallest hash; one fold calibrates, the others are targets."""
    fold = _fold() == 0 if calibrate else _fold() != 0
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where((F.col("quality") == value) & fold)
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(value).alias("good"))


def gram_counts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the target's; each task sends its sums only."""
    marked = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(target), "doc_id", "left").select("text", F.col("good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(gram_buckets(text), minlength=BUCKETS)
                raw += counts
                if good:
                    aim += counts
        used = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(used), "raw": pa.array(raw[used]), "target": pa.array(aim[used])})

    sums = marked.mapInArrow(count, "bucket long, raw long, target long")
    return sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: pd.DataFrame) -> np.ndarray:
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], aim[counts["bucket"]] = counts["raw"], counts["target"]
    if not aim.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    prior = BUCKETS / 50  # pseudo-counts, dealt as the raw text deals its own
    p_target = (aim + prior * p_raw) / (aim.sum() + prior)
    return np.log(p_target / p_raw)


def calibrated_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut that loses the fewest good documents (ten times over) and keeps the fewest bad ones; midway between neighbours."""
    if not (good == 0).any() or not (good == 1).any():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.r_[0, np.cumsum(g == 1)] / (g == 1).sum()
    kept = 1 - np.r_[0, np.cumsum(g == 0)] / (g == 0).sum()
    edges = np.r_[w[0] - 1, (w[:-1] + w[1:]) / 2, w[-1] + 1]
    return float(edges[np.argmin(10 * lost + kept)])


def fit(docs: DataFrame, labels: DataFrame, target: int = TARGET, calibrate: int = CALIBRATE) -> Weights:
    """Both models and the cut. Without usable labels every weight is 0 and nothing is rejected."""
    counts = gram_counts(docs, drawn(labels, 1, False, target)).toPandas()
    weights = Weights(log_ratios(counts))
    ids = drawn(labels, 1, True, calibrate).unionByName(drawn(labels, 0, True, calibrate))
    sample = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(ids), "doc_id")
    # one row for each drawn id, whichever of its rows weighs least
    seen = sample.select("doc_id", "good", weight_udf(weights, docs)("text").alias("w")).groupBy("doc_id", "good").agg(F.min("w").alias("w")).toPandas()
    if len(seen):
        weights.cut = calibrated_cut(seen["w"].to_numpy(), seen["good"].to_numpy())
    return weights


def weight_udf(weights: Weights, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(T.DoubleType())
    def log_weight(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.log_weight(t) for t in texts], dtype="float64")

    return log_weight


def gumbel() -> Column:
    """Standard Gumbel noise that depends on the row's id alone."""
    unit = (F.pmod(F.xxhash64(F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def weighted(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight and sample_key (with underscores in front where ``docs`` has such columns)."""
    log_weight, key = free_name(docs, "log_weight"), free_name(docs, "sample_key")
    out = docs.withColumn(log_weight, weight_udf(weights, docs)(whole(text_col)))
    return out.withColumn(key, F.col(log_weight) + gumbel())


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of the column sample_key, by counting in ever finer bins; a few thousand counts reach the driver a round."""
    lo, hi, n = keys.agg(F.min("sample_key"), F.max("sample_key"), F.count("sample_key")).first()
    if not n or k >= n:
        return float("-inf")
    if k < 1:
        return float("inf")
    above = 0
    while True:
        width = (hi - lo) / bins
        part = keys.where(F.col("sample_key").between(lo, hi))
        if width <= 0 or lo + width == lo:
            return lo
        if part.count() <= bins:
            return sorted((r[0] for r in part.select("sample_key").collect()), reverse=True)[k - above - 1]
        counts = dict(part.groupBy(F.least(F.floor((F.col("sample_key") - lo) / width), F.lit(bins - 1)).alias("bin")).count().collect())
        for b in range(bins - 1, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        top = F.least(F.floor((F.col("sample_key") - lo) / width), F.lit(bins - 1)) == b
        lo, hi = part.where(top).agg(F.min("sample_key"), F.max("sample_key")).first()


def sampled_keys(docs: DataFrame, labels: DataFrame, k: int | None = None, target: int = TARGET) -> tuple[DataFrame, Weights, float]:
    """(doc_id, log_weight, sample_key) of every row, stored; the weights; and the k-th largest key.

    Without ``k`` it is the number of rows whose log weight passes the calibrated cut.
    """
    weights = fit(docs, labels, target)
    keys = cut(weighted(docs.select("doc_id", "text"), weights).select("doc_id", "log_weight", "sample_key"))
    if k is None:
        k = keys.where(F.col("log_weight") >= weights.cut).count()
    return keys, weights, kth_largest(keys.select("sample_key"), k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, target: int = TARGET) -> DataFrame:
    """The documents that importance resampling takes: the ``k`` largest keys, and ties of the last.

    Columns log_weight and sample_key are added (with underscores in front where ``docs``
    has such). Without ``k`` see ``sampled_keys``; without usable labels every weight is 1 and
    nothing is rejected. Null and empty texts weigh 1 (as likely in either model); repeated
    rows share their key; a null id draws noise like any other; other columns stay; an
    empty table gives an empty result.
    """
    _, weights, least = sampled_keys(docs, labels, k, target)
    key = free_name(docs, "sample_key")
    return weighted(docs, weights).where(F.col(key) >= least)


def op2_resampling(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    keys, _, least = sampled_keys(docs.select("doc_id", "text"), labels)
    return keys.where(F.col("sample_key") >= least)
