"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index is of the benchmark, in blocks of bounded size that Spark tasks build, one
broadcast a block; document frequencies and the mean length are those of the whole benchmark,
so that scores don't depend on how items were dealt. All documents pass by, cut into
overlapping passages that are the queries. A score is taken relative to the score that the
item's segment gives itself, so one threshold serves all. A passage first meets the block maxima of its rarer terms, over a whole batch
of documents at once; what could still reach the threshold is scored by WAND over the
postings. Every document with a passage above the threshold is then verified: the
question's and the answer's word n-grams must both be in it.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

_WORD = re.compile(r"\w+")
SEGMENT = 64
#: Items and characters that an index block holds on average at most; longer items are indexed in segments and verified whole.
ITEMS, CHARACTERS = 2000, 4_000_000
THRESHOLD = 0.6
#: Share of a segment's own score that its commonest terms, left out of the screen, may have.
COMMON = 0.3
POSTING_BLOCK = 4
NGRAM, OVERLAP = 4, 0.6
K1, B = 1.2, 0.75
LEAKS = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: around an answer mark or a question mark, else the first two thirds and the rest."""
    for mark in (r"\banswer\s*:", r"\?"):
        parts = re.split(mark, text, maxsplit=1, flags=re.IGNORECASE)
        if len(parts) == 2 and words_of(parts[0]) and words_of(parts[1]):
            return words_of(parts[0]), words_of(parts[1])
    words = words_of(text)
    at = max(1, len(words) * 2 // 3)
    return words[:at], words[at:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def coverage(part: list[str], text: dict[int, set]) -> float:
    """Share of the part's n-grams that the text has; a part without words is covered."""
    n = min(NGRAM, len(part))
    if not n:
        return 1.0
    wanted = grams(part, n)
    return len(wanted & text[n]) / len(wanted)


def segments_of(text: str) -> list[list[str]]:
    """The item's words in segments of SEGMENT; a short rest is left to the verification of the whole item."""
    words = words_of(text)
    return [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT) if len(words) - i >= SEGMENT // 4 or not i]


@dataclass
class Statistics:
    """Of all segments of a benchmark: how many, their mean length, and in how many each of some terms is."""

    segments: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        every = [s for t in texts for s in segments_of(t) if s]
        df = Counter(w for s in every for w in set(s))
        return cls(len(every), sum(map(len, every)) / max(1, len(every)), dict(df))


@dataclass
class Index:
    """The inverted index of some items; ``statistics`` are those of the benchmark they are from."""

    items: list[tuple[int, str]]
    statistics: Statistics | None = None
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.parts = [question_answer(text) for _, text in self.items]
        segments = [(n, s) for n, (_, text) in enumerate(self.items) for s in segments_of(text) if s]
        self.segment_item = [n for n, _ in segments]
        known = self.statistics or Statistics.of([text for _, text in self.items])
        df, mean = known.df, known.mean
        self.statistics = None
        terms = sorted({w for _, words in segments for w in words})
        self.vocabulary = {w: i for i, w in enumerate(terms)}
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        screen: list[dict[int, float]] = [{} for _ in terms]
        for s, (_, words) in enumerate(segments):
            impact = {}
            for w in set(words):
                tf = words.count(w)
                idf = math.log(1 + (known.segments - df[w] + 0.5) / (df[w] + 0.5))
                impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            own = sum(impact.values())
            left = COMMON
            for w in sorted(impact, key=lambda w: (-df[w], len(w), w)):
                share = impact[w] / own
                postings[self.vocabulary[w]].append((s, share))
                if left >= share:
                    left -= share
                else:
                    left = -1.0
                    block = screen[self.vocabulary[w]]
                    block[s // POSTING_BLOCK] = max(block.get(s // POSTING_BLOCK, 0.0), share)
        self.postings = postings
        self.block_max = []
        for p in postings:
            most: dict[int, float] = {}
            for s, share in p:
                most[s // POSTING_BLOCK] = max(most.get(s // POSTING_BLOCK, 0.0), share)
            self.block_max.append(most)
        self.term_max = [max((x for _, x in p), default=0.0) for p in postings]
        self.n_blocks = len(segments) // POSTING_BLOCK + 1
        count = np.array([len(x) for x in screen] + [0], np.int64)
        self.screen_from = np.r_[0, np.cumsum(count)]
        self.screen_block = np.array([b for x in screen for b in x], np.int64)
        self.screen_share = np.array([v for x in screen for v in x.values()])

    def wand(self, terms: list[int]) -> dict[int, float]:
        """Segments that score THRESHOLD or more for a set of terms: a pivot by term maxima, block maxima before any scoring."""
        cursors = [[self.postings[t], 0, t] for t in terms if self.postings[t]]
        found = {}
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.term_max[c[2]]
                if bound >= THRESHOLD - 1e-9:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                break
            block = pivot // POSTING_BLOCK
            inside = sum(self.block_max[c[2]].get(block, 0.0) for c in cursors if c[0][c[1]][0] <= pivot or c[0][c[1]][0] // POSTING_BLOCK == block)
            if inside >= THRESHOLD - 1e-9:
                score = sum(x for c in cursors for s, x in c[0][c[1] :] if s == pivot)
                if score >= THRESHOLD - 1e-9:
                    found[pivot] = score
                target = pivot + 1
            else:
                target = (block + 1) * POSTING_BLOCK
                # segments before the block's end that other cursors stand on are in the block too, and are bounded by it
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < target:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def search(self, words: list[list[str]]) -> list[list[tuple[int, float, float, float]]]:
        """For each text's words the leaked items: (item id, best passage score, question and answer overlap)."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in words]
        get, none = self.vocabulary.get, len(self.vocabulary)
        ids = np.array([get(w, none) for ws in words for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in words], np.int64)
        doc = np.repeat(np.arange(len(words)), sizes)
        start = np.r_[0, np.cumsum(sizes)]
        at = np.arange(len(ids)) - start[:-1][doc]
        count = self.screen_from[ids + 1] - self.screen_from[ids] if len(ids) else np.empty(0, np.int64)
        hit = np.flatnonzero(count)
        if not len(hit):
            return out
        row = np.repeat(hit, count[hit])
        entry = np.repeat(self.screen_from[ids[hit]] - np.r_[0, np.cumsum(count[hit])[:-1]], count[hit]) + np.arange(len(row))
        keys, sums = [], []
        widest = int(sizes.max()) // SEGMENT + 2
        for back in (0, 1):  # passages are two segments long and start every segment
            passage = at[row] // SEGMENT - back
            ok = passage >= 0
            key = ((doc[row][ok] * widest + passage[ok]) * self.n_blocks + self.screen_block[entry][ok]) * (none + 1) + ids[row][ok]
            keys.append(key)
            sums.append(self.screen_share[entry][ok])
        key, share = np.concatenate(keys), np.concatenate(sums)
        key, first = np.unique(key, return_index=True)  # a term counts once in a passage
        group = key // (none + 1)
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        total = np.add.reduceat(share[first], edge) if len(edge) else np.empty(0)
        live = np.unique(group[edge][total >= THRESHOLD - COMMON - 1e-9] // self.n_blocks)
        best: dict[tuple[int, int], float] = {}
        for x in live.tolist():
            d, passage = divmod(x, widest)
            part = ids[start[d] + passage * SEGMENT : min(start[d] + (passage + 2) * SEGMENT, start[d + 1])]
            for s, score in self.wand(sorted({t for t in part.tolist() if t != none})).items():
                k = (d, self.segment_item[s])
                best[k] = max(best.get(k, 0.0), score)
        have: dict[int, dict[int, set]] = {}
        for (d, n), score in sorted(best.items()):
            if d not in have:
                have[d] = {k: grams(words[d], k) for k in range(1, NGRAM + 1)}
            q, a = (coverage(p, have[d]) for p in self.parts[n])
            if q >= OVERLAP and a >= OVERLAP:
                out[d].append((self.items[n][0], round(score, 6), round(q, 6), round(a, 6)))
        return out


def index_blocks(benchmark: DataFrame, items: int = ITEMS, characters: int = CHARACTERS) -> DataFrame:
    """The benchmark's index in blocks: (block, index: a pickled Index). Tasks build them; the driver sees two counts."""
    usable = benchmark.where("item_id is not null and text is not null and text rlike '[^ ]'").select("item_id", "text").distinct()
    n_items, size = usable.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, math.ceil(n_items / items), math.ceil((size or 0) / characters))
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each item: its terms with the segments that have them, and, with a null term, its segments and words."""
        for frame in frames:
            rows = []
            for block, text in zip(frame["block"], frame["text"], strict=True):
                every = [s for s in segments_of(text) if s]
                rows.append((block, None, len(every), sum(map(len, every))))
                rows.extend((block, w, c, 0) for w, c in Counter(w for s in every for w in set(s)).items())
            yield pd.DataFrame(rows, columns=["block", "term", "segments", "words"])

    counted = dealt.mapInPandas(terms, "block int, term string, segments long, words long")
    total = counted.where("term is null").agg(F.sum("segments").alias("n"), (F.sum("words") / F.greatest(F.lit(1), F.sum("segments"))).alias("mean"))
    df = counted.where("term is not null").groupBy("term").agg(F.sum("segments").alias("df"))
    known = counted.where("term is not null").select("block", "term").distinct().join(df, "term").crossJoin(F.broadcast(total))  # one row

    def build(part: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"block": [], "index": []})
        part = part.sort_values(["item_id", "text"])
        statistics = Statistics(int(terms["n"].iloc[0]), float(terms["mean"].iloc[0]), dict(zip(terms["term"], terms["df"].tolist(), strict=True))) if len(terms) else Statistics(0, 1.0, {})
        index = Index(list(zip(part["item_id"].tolist(), part["text"], strict=True)), statistics)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "index": [pickle.dumps(index)]})

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(build, "block int, index binary")


def leaks(indexes: list[Broadcast], text: Column) -> Column:
    """The items of the broadcast index blocks that leaked into a text; its words are taken apart once."""

    @F.pandas_udf(LEAKS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blocks = [pickle.loads(x.value) for x in indexes]
        for part in parts:
            texts, out = part.tolist(), []
            for i in range(0, len(texts), 500):
                words = [words_of(t) for t in texts[i : i + 500]]
                every = [block.search(words) for block in blocks]
                out += [sorted(chain.from_iterable(x)) for x in zip(*every, strict=True)]
            yield pd.Series([[{"item_id": i, "score": s, "question": q, "answer": a} for i, s, q, a in x] for x in out])

    return found(F.coalesce(text, F.lit("")))


def with_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, text_col: str = "text") -> DataFrame:
    """``docs`` with a column leaks: (item_id, score, question, answer) of every item found, in order.

    If ``docs`` has a column of that name, it stays and the new one is called _leaks. Null
    and empty texts and items find nothing; repeated rows keep their number; other columns
    stay; an empty benchmark gives empty arrays.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(bytes(r["index"])) for r in index_blocks(benchmark, items).toLocalIterator()]
    found = leaks(blocks, F.col(text_col)) if blocks else F.array().cast(LEAKS)
    return docs.withColumn(free_name(docs, "leaks"), found)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.score", "l.question", "l.answer")
