"""Exact removal of repeated substrings by distributed prefix doubling.

Positions are ranked by what follows them, first over ``K`` bytes and then over the whole
``SPAN`` of 200, and whatever has a rank of its own leaves at once. Ranks are
fingerprints, so ranking is a shuffle and a sort by the fingerprint in Spark instead of a
global renumbering. Three things keep the rows few:

* Of the first ranks only anchors are sorted: each 200-byte window is represented by
  the K-gram in it with the smallest hash (the rightmost of equals), which depends on the
  window's bytes alone. Equal windows have equal anchors at equal places, and
  neighbouring windows mostly share theirs, so that some 2 % of the positions remain.
* An anchor comes with the fingerprint of all bytes that its windows cover. Where
  that repeats, all these windows repeat, and nothing is left to test.
* Only where an anchor repeats in different surroundings are its windows
  ranked one by one, from the bytes around the anchor.

Texts are UTF-8 bytes; equal texts are brought together first and handled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, whole

SPAN = 200
K = 64
_RNG = np.random.default_rng(20)
#: Random odd numbers for the bytes, and two multipliers of the polynomial fingerprints modulo 2**64.
_BYTES = _RNG.integers(0, 2**62, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15 & ~7 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 3)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Bytes that are fingerprinted at a time; a longer text takes longer steps of its own.
CHUNK = 1 << 18


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = pow(_BASE[which], -1, 1 << 64) if inverse else _BASE[which]
        have = np.r_[np.uint64(1), np.multiply.accumulate(np.full(size - 1, base, np.uint64))]
        _POWERS[which, inverse] = have
    return have


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum(_BYTES[which][data] * _powers(which, True, len(data))[: len(data)], dtype=np.uint64)]


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of the byte ranges [start, end), wherever they lie."""
    return _mixed((prefix[end] - prefix[start]) * _powers(which, False, len(prefix))[start])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position of its smallest, the rightmost of equals, by doubling."""
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size * 2 <= width:
        later = value[size:] <= value[:-size]
        value, place = np.where(later, value[size:], value[:-size]), np.where(later, place[size:], place[:-size])
        size *= 2
    n, rest = len(hashes) - width + 1, width - size
    later = value[rest : rest + n] <= value[:n]
    return np.where(later, place[rest : rest + n], place[:n])


def anchors(text: bytes, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, context fingerprint, first window, number of windows, anchor's place in the first) of each anchor of a text of ``span`` bytes or more."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    prefix = _prefix(data, 0)
    grams = _between(prefix, np.arange(n - k + 1), np.arange(k, n + 1), 0)
    at = window_anchors(grams, span - k + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    place = at[first]
    shape = ((place - first).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    context = _mixed(_between(prefix, first, first + count - 1 + span, 0) + shape * np.uint64(0x165667B19E3779F9))
    return grams[place], context, first, count, place - first


def _pack(first: np.ndarray, count: np.ndarray, off: np.ndarray, many: np.ndarray | bool) -> np.ndarray:
    return first.astype(np.int64) << 24 | count.astype(np.int64) << 12 | off.astype(np.int64) << 1 | np.asarray(many, np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 24, packed >> 12 & 0xFFF, packed >> 1 & 0x7FF, packed & 1


#: Marks a row whose windows are known to repeat; it needs no ranking. (A bit of the count, which stays below 2**11.)
DONE = 1 << 23
#: Anchors that a task gathers before it puts equal ones together.
GATHER = 200_000
_OCC = "anchor long, context long, th long, packed long"
_RANKED = "th long, packed long, anchor long"


def _find_anchors(span: int, k: int):
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "context", "th", "packed")])

    def combined(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Of equal anchors in equal surroundings one stays to be ranked, as many; the others are done, and are dealt out at random."""
        gram, context, th, packed = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((context, gram))
        g, c = gram[order], context[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
        run = np.cumsum(first) - 1
        several = np.bincount(run)[run] > 1
        packed = packed[order] | several | np.where(first, 0, DONE)
        spread = _mixed((th[order] ^ packed * 0x9E3779B1).view(np.uint64)).view(np.int64)
        return pa.record_batch([pa.array(x) for x in (np.where(first, g, spread), c, th[order], packed)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each anchor; the copies of a text count as many."""
        rows, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for th, text, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if len(text) >= span:
                        gram, context, first, count, off = anchors(text, span, k)
                        rows.append((gram.view(np.int64), context.view(np.int64), np.full(len(gram), th, np.int64), _pack(first, count, off, n > 1)))
                        size += len(gram)
                        if size >= GATHER:
                            yield combined(rows)
                            rows, size = [], 0
        if rows:
            yield combined(rows)

    return run


def _rank_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, context). Unique anchors go. (th, packed, anchor): anchor null where all windows repeat, else they are to be tested, and ``many`` says that they are known to repeat."""
    schema = pa.schema([("th", pa.int64()), ("packed", pa.int64()), ("anchor", pa.int64())])

    def known(th: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(th), pa.array(packed & ~DONE), pa.nulls(len(th), pa.int64())], schema=schema)

    def solve(a: np.ndarray, c: np.ndarray, th: np.ndarray, packed: np.ndarray) -> pa.RecordBatch | None:
        if not len(a):
            return None
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        group, run = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        many = (np.bincount(run)[run] > 1) | (np.bincount(run, packed & 1)[run] > 0)
        runs_in = np.bincount(group[new_c])[group]
        all_many = np.bincount(group, ~many)[group] == 0
        done = many
        test = (runs_in > 1) & ~all_many & (~many | new_c)  # one of each repeated context bears witness for the others
        if not (done.any() or test.any()):
            return None
        n_done = int(done.sum())
        return pa.record_batch(
            [
                pa.array(np.r_[th[done], th[test]]),
                pa.array(np.r_[packed[done], packed[test] & ~1 | many[test]]),
                pa.array(np.r_[a[done], a[test]], mask=np.r_[np.ones(n_done, bool), np.zeros(int(test.sum()), bool)]),
            ],
            schema=schema,
        )

    held = [np.empty(0, np.int64)] * 4
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        done = columns[3] & DONE > 0
        if done.any():
            yield known(columns[2][done], columns[3][done])
        held = [np.r_[h, x[~done]] for h, x in zip(held, columns, strict=True)]
        a = held[0]
        if len(a) and a[0] != a[-1]:
            cut = int(np.searchsorted(a, a[-1], "left"))
            found = solve(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
            if found is not None:
                yield found
    if len(held[0]):
        found = solve(*held)
        if found is not None:
            yield found


def _surroundings(span: int):
    schema = pa.schema([("anchor", pa.int64()), ("th", pa.int64()), ("packed", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that the windows to be tested cover."""
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out: tuple[list, ...] = ([], [], [], [])
                for th, text, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for mark in marks:
                        packed = mark["packed"]
                        first, count = packed >> 24, packed >> 12 & 0xFFF
                        for column, x in zip(out, (mark["anchor"], th, packed, text[first : first + count - 1 + span]), strict=True):
                            column.append(x)
                if out[0]:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def _test_windows(span: int):
    schema = pa.schema([("th", pa.int64()), ("packed", pa.int64()), ("anchor", pa.int64())])

    def solve(anchor: np.ndarray, th: np.ndarray, packed: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
        first, count, off, many = _unpack(packed)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
        row = np.repeat(np.arange(len(th)), count)
        step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        start = begin[row] + step
        keys = []
        for which in (0, 1):
            h = _between(_prefix(data, which), start, start + span, which)
            keys.append(_mixed(h + anchor[row].view(np.uint64) * np.uint64(3) + (off[row] - step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys[0], kind="stable")
        k0, k1 = keys[0][order], keys[1][order]
        run = np.cumsum(np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]) - 1
        repeats = np.empty(len(row), bool)
        repeats[order] = (np.bincount(run)[run] > 1) | (np.bincount(run, many[row][order])[run] > 0)
        repeats &= many[row] == 0
        edge = np.flatnonzero(np.diff(np.r_[0, (repeats * (row + 1)), 0]))  # runs of repeating windows, each of one row
        value = np.r_[repeats * (row + 1), 0]
        starts = np.r_[edge[value[edge] > 0]]
        if not len(starts):
            return None
        ends = edge[np.searchsorted(edge, starts, "right")]
        r = row[starts]
        return pa.record_batch([pa.array(th[r]), pa.array(_pack(first[r] + step[starts], ends - starts, np.zeros(len(r), np.int64), False)), pa.nulls(len(r), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; groups are solved some thousand rows at a time."""
        numbers, texts = [np.empty(0, np.int64)] * 3, []
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                numbers = [np.r_[x, part.column(i).to_numpy()] for i, x in enumerate(numbers)]
                texts += part.column(3).to_pylist()
                a = numbers[0]
                if a[0] != a[-1]:
                    cut = int(np.searchsorted(a, a[-1], "left"))
                    found = solve(*(x[:cut] for x in numbers), texts[:cut])
                    numbers, texts = [x[cut:] for x in numbers], texts[cut:]
                    if found is not None:
                        yield found
        if texts:
            found = solve(*numbers, texts)
            if found is not None:
                yield found

    return run


def removed_spans(marks: list[int], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal byte ranges that the repeating windows cover."""
    if not marks:
        return []
    first, count, _, _ = _unpack(np.array(marks, np.int64))
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((first + count - 1 + span)[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return list(zip(start[new].tolist(), end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]].tolist(), strict=True))


def _apply_spans(span: int):
    schema = pa.schema([("th", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out: tuple[list, ...] = ([], [], [], [], [])
                for th, text, a, b in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    spans = removed_spans((a or []) + (b or []), span)
                    kept, at = [], 0
                    for s, e in spans:
                        kept.append(text[at:s])
                        at = e
                    kept.append(text[at:])
                    for column, x in zip(out, (th, len(text), sum(e - s for s, e in spans), len(spans), b"".join(kept)), strict=True):
                        column.append(x)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def text_key(text: Column, seed: int = 0) -> Column:
    """A text's number; another ``seed`` numbers texts anew."""
    return F.xxhash64(text) if not seed else F.xxhash64(text, F.lit(seed))


def deduplicated(docs: DataFrame, text_col: str = "text", span: int = SPAN, k: int = K, digest: bool = False, seed: int = 0) -> DataFrame:
    """For each distinct text (th: its key): n_bytes, n_removed, n_spans, and kept, the bytes that stay (their SHA-256 if ``digest``).

    The text's exchange and the ranked anchors are used twice in one plan, so that
    Spark runs them once. Null texts count as empty; texts shorter than ``span`` lose
    nothing; an empty table gives an empty result. Two different texts of one key, which a
    second hash tells apart, are an error, not one text; another ``seed`` resolves it.
    """
    n = partitions(docs.sparkSession)
    text = whole(text_col)
    keyed = docs.select(text_key(text, seed).alias("th"), text.cast("binary").alias("bytes"), F.xxhash64(F.lit("other"), text).alias("h2"))
    grouped = keyed.groupBy("th").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    clash = F.raise_error(F.lit("two texts share a key: take another seed")).cast("binary")
    unique = grouped.select("th", F.when(F.col("lo") == F.col("hi"), F.col("bytes")).otherwise(clash).alias("bytes"), "n")
    found = unique.select("th", "bytes", "n").mapInArrow(_find_anchors(span, k), _OCC)
    ranked = found.repartition(n, "anchor").sortWithinPartitions("anchor", "context").mapInArrow(_rank_anchors, _RANKED)
    marks = ranked.groupBy("th").agg(
        F.collect_list(F.when(F.col("anchor").isNull(), F.col("packed"))).alias("done"),
        F.collect_list(F.when(F.col("anchor").isNotNull(), F.struct("anchor", "packed"))).alias("test"),
    )
    wanted = unique.select("th", "bytes").join(marks.where(F.size("test") > 0).select("th", "test"), "th")
    around = wanted.mapInArrow(_surroundings(span), "anchor long, th long, packed long, bytes binary")
    tested = around.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_test_windows(span), _RANKED)
    more = tested.groupBy("th").agg(F.collect_list("packed").alias("more"))
    every = unique.select("th", "bytes").join(marks.select("th", "done"), "th", "left").join(more, "th", "left").select("th", "bytes", "done", "more")
    out = every.mapInArrow(_apply_spans(span), "th long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("kept", F.sha2("kept", 256)) if digest else out


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = deduplicated(docs, digest=True)
    keyed = docs.select("doc_id", text_key(whole("text")).alias("th"))
    return keyed.join(found, "th").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def brute_force(texts: list[bytes], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """What ``deduplicated`` must give, by a table of all windows."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                cover[i : i + span] = b"\1" * span
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out
