"""Best-fit packing of tokenised documents, improved by swaps between underfull bins.

Tokenising is a map over the documents; what moves between machines is one row of a
few numbers a piece, never the ids. Full pieces are sequences of their own. The other
pieces are dealt by hash into shards of bounded size, each packed in a task of its own;
the bins a shard could not fill are then opened and packed again together with those
of other shards.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
END_ID = 2
#: Exchanges between other bins that emptying one bin may take, and the bins (those with the most room) among which they are sought.
EXCHANGES, EXCHANGE_BINS = 20, 24
#: Bins that the search fails to empty, one after the other, before it leaves a shard as it is.
FAILURES = 6
#: White space of this length goes through the JSON file's own tokenizer: the fast one's pattern recurses over it.
LONG_SPACE = 10_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoder(json_path: str):
    """A function from a text to its ids by the byte-level BPE of ``json_path``.

    The vocabulary is public as ranks too (the same name with .tiktoken), which encode
    the same ids several times faster; a text that spells a special token out, or has a
    very long run of white space, goes through the JSON file's own tokenizer.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    long_space = re.compile(rf"\s{{{LONG_SPACE}}}")

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= LONG_SPACE and long_space.search(text)):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, limit: int = 1024, json_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``limit`` ids: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 2 (an empty or null text: id 2 alone). Only longer
    documents are cut, from their end, so that the first piece is the short one.
    """
    place = json_path or vocabulary_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder(place)
        for frame in frames:
            ids, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                tokens = array("I", encode(text))
                tokens.append(END_ID)
                raw = np.frombuffer(tokens, np.uint32).astype("<u4", copy=False).tobytes()
                n = len(tokens)
                bounds = [0, *range(n % limit or limit, n + 1, limit)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    ids.append(doc_id)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pd.DataFrame({"doc_id": ids, "piece": pieces, "start": starts, "length": lengths, "ids_crc32": crcs})

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), whole(text_col).alias("text")).mapInPandas(run, PIECES)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still holds it. Bins are lists of positions."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
            free -= size
        else:
            b, free = len(bins), limit - size
            bins.append([i])
        if free:
            by_free[free].append(b)
            mask |= 1 << free
    return bins


def improve(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Empty the least full bins into the others, until FAILURES of them in a row can't be.

    Every step moves a piece, or exchanges one for one or two for one, between the bin
    being emptied and a fuller bin so that the fuller one gains. Where that gets stuck, two
    other underfull bins exchange, which gathers their room in the less full one. The sum of
    the squared fills only grows. A bin that still can't be emptied is left as it is.
    """
    bins = [list(b) for b in bins]
    least = -(-sum(lengths) // limit)
    stuck: set[int] = set()  # bins that couldn't be emptied, each by its first piece
    while len(bins) > least and len(stuck) < FAILURES:
        fill = [sum(lengths[i] for i in b) for b in bins]
        e = min((b for b in range(len(bins)) if bins[b][0] not in stuck), key=fill.__getitem__, default=None)
        if e is None:
            break
        others = [b for b in range(len(bins)) if b != e and fill[b] < limit]
        if sum(limit - fill[b] for b in others) < fill[e]:
            break
        trial = {b: list(bins[b]) for b in (*others, e)}
        free = {b: limit - fill[b] for b in others}
        moved, exchanges = True, 0
        while trial[e] and moved:
            moved = False
            for x in sorted(trial[e], key=lambda i: -lengths[i]):
                fits = [b for b in others if free[b] >= lengths[x]]
                if fits:
                    b = min(fits, key=free.__getitem__)
                    trial[e].remove(x)
                    trial[b].append(x)
                    free[b] -= lengths[x]
                    moved = True
                    break
                best = _exchange(trial, free, lengths, x, others)
                if best:
                    _, b, out = best
                    trial[e].remove(x)
                    trial[e].extend(out)
                    trial[b] = [i for i in trial[b] if i not in out] + [x]
                    free[b] -= lengths[x] - sum(lengths[i] for i in out)
                    moved = True
                    break
            if trial[e] and not moved and exchanges < EXCHANGES:
                exchanges += 1
                moved = _gather_room(trial, free, lengths, others)
        if trial[e]:
            stuck.add(bins[e][0])
            continue
        for b, items in trial.items():
            bins[b] = items
        del bins[e]
        stuck.clear()
    return bins


def _exchange(trial, free, lengths, x, others):
    """The exchange of ``x`` for one or two smaller pieces that fills some bin best: (room left, bin, pieces out)."""
    best = None
    for b in others:
        if not free[b]:
            continue
        small = sorted((i for i in trial[b] if lengths[i] < lengths[x]), key=lambda i: lengths[i])
        options = [(i,) for i in small] + [(i, j) for n, i in enumerate(small[:40]) for j in small[n + 1 : 40]]
        for out in options:
            gain = lengths[x] - sum(lengths[i] for i in out)
            if 0 < gain <= free[b] and (best is None or free[b] - gain < best[0]):
                best = (free[b] - gain, b, out)
        if best and best[0] == 0:
            break
    return best


def _gather_room(trial, free, lengths, others) -> bool:
    """One exchange between two underfull bins after which the fuller of them is fuller still; whether there was any."""
    roomy = sorted((b for b in others if free[b]), key=lambda b: -free[b])[:EXCHANGE_BINS]
    for n, donor in enumerate(roomy):
        for x in sorted(trial[donor], key=lambda i: -lengths[i]):
            best = _exchange(trial, free, lengths, x, roomy[n + 1 :])
            if best:
                _, b, out = best
                gain = lengths[x] - sum(lengths[i] for i in out)
                trial[donor] = [i for i in trial[donor] if i != x] + list(out)
                trial[b] = [i for i in trial[b] if i not in out] + [x]
                free[b] -= gain
                free[donor] += gain
                return True
    return False


def pack_shard(limit: int, loose_below: int):
    """Pack one shard's pieces; ``bin`` is the bin's number in the shard, ``loose`` marks the pieces of bins to be opened again."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        bins = improve(best_fit(lengths, limit), lengths, limit)
        where, offset, loose = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        for n, items in enumerate(bins):
            at = 0
            for i in items:
                where[i], offset[i] = n, at
                at += lengths[i]
            loose[items] = at < loose_below
        return frame.assign(bin=where, offset=offset, loose=loose)

    return run


def pack(docs: DataFrame, limit: int = 1024, shard_pieces: int = 3000, json_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows are packed each by itself; other columns are ignored; null texts count
    as empty; an empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, limit, json_path).withColumn("row", F.monotonically_increasing_id()))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == limit).select(*out, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < limit)
    shards = max(1, math.ceil(rest.count() / shard_pieces))
    schema = f"{PIECES}, shard long, bin long, offset long, loose boolean"
    packed = rest.select(*out, F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard"))
    first = cut(packed.groupBy("shard").applyInPandas(pack_shard(limit, limit - limit // 64), schema))
    kept = first.where("not loose").select(*out, (F.col("shard") * 2 * 2**31 + F.col("bin")).alias("sequence_id"), "offset")
    again = first.where("loose").drop("bin", "offset", "loose").withColumn("shard", F.floor(F.col("shard") / 64))
    second = again.groupBy("shard").applyInPandas(pack_shard(limit, 0), schema)
    later = second.select(*out, ((F.col("shard") * 2 + 1) * 2**31 + F.col("bin")).alias("sequence_id"), "offset")
    return full.unionByName(kept).unionByName(later).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
