"""Toxicity by compression distance between two zstandard dictionaries.

Training works on a bounded sample of labelled documents: copies are thinned by
MinHash, words that mark toxic text (log-likelihood ratio) become the toxic dictionary,
frequent other words the ordinary one. A window is one word between spaces, every byte
of it spelt out as four fixed pseudo-random bytes, for else the few bytes of a frame
would drown the difference. A window is hot if the toxic dictionary alone compresses it
to at most ``longest`` bytes and by at least ``gain`` bytes more than the ordinary one;
both thresholds and the score's logistic curve are calibrated on labelled documents that
the dictionaries have not seen.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

FOLDS = 5
#: Labelled documents of each label that training takes at most, those of the smallest hash, and the longest that it takes (characters).
#: So the driver gets at most 2 * SAMPLE * LONGEST characters; every document is scored whole, whatever its length.
SAMPLE, LONGEST = 4000, 20_000
EDGE = ".,;:!?\"'()[]{}<>|*#$%&_-"
CODES = [random.Random(7).randbytes(1024)[4 * i : 4 * i + 4] for i in range(256)]
ORDINARY_WORDS, TOXIC_WORDS = 3000, 2000
CACHE = 400_000


def words_of(text: str) -> list[str]:
    return [w for w in (w.strip(EDGE) for w in text.lower().split()) if w]


def _spelt(text: str) -> bytes:
    return b"".join([CODES[c] for c in f" {text} ".encode("utf-8", "surrogatepass")])


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=20, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64,
        strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


@dataclass
class Model:
    """The two dictionaries and what was calibrated; a few hundred KB, whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    longest: int = 0
    gain: int = 0
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def lengths(self):
        """A function from a word to its two compressed lengths; the ordinary one only where the toxic one is short enough to matter."""
        plain, marked = _compressor(self.ordinary), _compressor(self.toxic)
        cache: dict[str, tuple[int, int]] = {}

        def measure(word: str, longest: int) -> tuple[int, int]:
            got = cache.get(word)
            if got is None:
                if len(cache) > CACHE:
                    cache.clear()
                window = _spelt(word)
                short = len(marked.compress(window))
                got = cache[word] = (len(plain.compress(window)) if short <= longest else short, short)
            return got

        return measure

    def features(self, hot: int, n: int) -> tuple[float, ...]:
        return 1.0, min(hot, 4), math.log1p(hot / max(n, 1) * 100)

    def scorer(self):
        measure = self.lengths()

        def score(text: str) -> float:
            words = words_of(text)
            hot = sum(1 for a, b in (measure(w, self.longest) for w in words) if b <= self.longest and a - b >= self.gain)
            z = float(np.dot(self.weights, self.features(hot, len(words))))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _distinct(texts: list[str]) -> list[bool]:
    """False for a text of which an earlier one is a near copy: three MinHashes over three-word shingles, one of them equal."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        marks = [(k, int((hashes * np.uint64(m)).min())) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))]
        out.append(not any(m in seen for m in marks))
        seen.update(marks)
    return out


def _dictionaries(sample: pd.DataFrame) -> Model:
    counts = {0: Counter(), 1: Counter()}
    n = {0: 0, 1: 0}
    for text, toxic in zip(sample["text"], sample["toxic"], strict=True):
        counts[toxic].update(set(words_of(text)))
        n[toxic] += 1
    found = []
    for w, a in counts[1].items():
        b = counts[0][w]
        e = (a + b) * n[1] / (n[0] + n[1])
        if a > 1 and a > e and len(w) > 2 and b * 2 < a:
            g = 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0))
            if g > 10:
                found.append((g, w))
    marks = [w for _, w in sorted(found, reverse=True)[:TOXIC_WORDS]]
    known = set(marks)
    plain = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if w not in known][:ORDINARY_WORDS]
    ordinary = b"".join(_spelt(w) for w in reversed(plain))
    toxic = b"".join(_spelt(w) for w in reversed(marks))
    noise = random.Random(11).randbytes(len(toxic))
    return Model(ordinary + noise, ordinary + toxic)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: pd.DataFrame) -> Model:
    """Train on rows (fold, text, toxic); one fold calibrates, the others make the dictionaries."""
    sample = sample[_distinct(sample["text"].tolist())] if len(sample) else sample
    last = sample["fold"] == FOLDS - 1
    if not len(sample) or sample.loc[~last, "toxic"].nunique() < 2 or not last.any():
        share = float(sample["toxic"].mean()) if len(sample) else 0.0
        return Model(b" ordinary ", b" ordinary ", weights=(math.log((share + 0.01) / (1.01 - share)), 0.0, 0.0))
    model = _dictionaries(sample[~last])
    measure = model.lengths()
    held, y = sample.loc[last, "text"].map(words_of).tolist(), sample.loc[last, "toxic"].to_numpy()
    pairs = [np.array([measure(w, 1 << 20) for w in words] or [(0, 1 << 20)]) for words in held]
    best = None
    for longest in (11, 12, 13, 14, 15):
        for gain in (2, 4, 6, 8):
            hot = np.array([((p[:, 1] <= longest) & (p[:, 0] - p[:, 1] >= gain)).sum() for p in pairs])
            x = np.array([model.features(h, len(w)) for h, w in zip(hot, held, strict=True)])
            w = _fit_curve(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -np.mean(np.log(np.where(y == 1, p, 1 - p)))
            if best is None or loss < best[0] - 1e-4:
                best = (loss, longest, gain, tuple(w))
    _, model.longest, model.gain, model.weights = best
    return model


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Up to ``sample`` documents of each label outside the held-out fold, of at most LONGEST characters: fold, text, toxic.

    The ids are drawn from the labels first, so only the sample's texts move.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).where("fold <> 0")
    drawn = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    return docs.select("doc_id", whole("text").alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * sample).select("fold", "text", "toxic").toPandas()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts get the score of a text without hot windows; repeated rows keep
    their number; other columns are ignored; without labels of both kinds every document gets
    the share of toxic labels; a null id isn't held out; an empty table gives an empty result.
    """
    model = fit(training_sample(docs, labels, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for part in texts:
            yield part.map(score).astype("float64")

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), scored(whole("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
