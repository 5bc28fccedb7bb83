"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees.

Documents get a fingerprint; equal fingerprints collapse to one row. Fingerprints
that differ in at most ``radius`` bits must agree on some combination of bit blocks
(pigeonhole), so every combination deals the distinct fingerprints out to shards, and
each shard grows a BK-tree: children hang on the integer Hamming distance to
their parent, and a query follows only edges within ``radius`` of its own distance.
A shard returns a spanning set of links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, cut, free_name, partitions, whole
from .components import components

BITS = 64
SEED = 42
#: Distances that one step of a tree search may hold at once in a task.
FRONTIER = 1 << 18


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` lower-cased (A-Z) words; the whole text if it has fewer; none if it has no word."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *(ends[:-words]).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """SimHash of a text column as a long holding the 64 bits; null and empty texts give 0."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([majority(shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64))

    return simhash(whole(text))


def block_keys(fingerprints: Column, radius: int, blocks: int) -> Column:
    """One key for each combination of ``blocks - radius`` blocks: two fingerprints within the radius share one."""
    width = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    start = [sum(width[:i]) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, used = F.lit(0).cast("long"), 0
        for i in chosen:
            bits = F.shiftrightunsigned(fingerprints, start[i]).bitwiseAND(F.lit((1 << width[i]) - 1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bits, used))
            used += width[i]
        keys.append(key.bitwiseOR(F.lit(n << 48).cast("long")))
    return F.array(*keys)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _forest(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each group (sorted), all trees level by level: each print's root, and the edges (code, child) in order."""
    n, bits = len(prints), BITS * prints.shape[1]
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    first = np.r_[True, group[1:] != group[:-1]]
    root = np.flatnonzero(first)[np.cumsum(first) - 1]  # groups are sorted
    at, rest = root.copy(), np.flatnonzero(~first)
    while len(rest):
        gap = _gaps(prints[rest], prints[at[rest]])
        order = np.lexsort((rest, gap, at[rest]))
        rest, gap = rest[order], gap[order]
        new = np.r_[True, (at[rest][1:] != at[rest][:-1]) | (gap[1:] != gap[:-1])]
        heads = rest[new]
        parent[heads], edge[heads] = at[heads], gap[new]
        at[rest] = heads[np.cumsum(new) - 1]
        rest = rest[~new]
    code = np.where(parent >= 0, parent * (bits + 1) + edge, -1)
    by_code = np.argsort(code, kind="stable")
    return root, code[by_code], by_code


def _hits(prints: np.ndarray, radius: int, forest: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, node, distance) of all nodes within the radius in each query's tree; a query's hits come in one part."""
    root, codes, by_code = forest
    bits = BITS * prints.shape[1]
    sizes = np.bincount(root, minlength=len(prints))[root][queries]
    turn = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + FRONTIER, FRONTIER))
    for lo, hi in zip(turn[:-1], np.r_[turn[1:-1], len(queries)], strict=True):
        if lo == hi:
            continue
        query = queries[lo:hi]
        node = root[query]
        found = []
        while len(query):
            gap = _gaps(prints[query], prints[node])
            hit = gap <= radius
            found.append((query[hit], node[hit], gap[hit]))
            left = np.searchsorted(codes, node * (bits + 1) + np.maximum(gap - radius, 0), "left")
            right = np.searchsorted(codes, node * (bits + 1) + np.minimum(gap + radius, bits), "right")
            count = right - left
            query = np.repeat(query, count)
            node = by_code[np.repeat(left - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest_links(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Grow one BK-tree for each group of fingerprints and search each print in its tree.

    ``prints``: a row of one or more 64-bit words each; ``group`` is sorted.

    Returns index pairs (i, j), i < j, within the radius, enough of them to connect
    whatever is connected in a group.
    """
    n = len(prints)
    label = np.arange(n)
    for query, node, _ in _hits(prints, radius, _forest(group, prints), np.arange(n)):
        earlier = node < query
        a, b = node[earlier], query[earlier]
        while len(a):  # lower labels to a fixed point, so that a star for each component remains
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before[a], low)
            np.minimum.at(label, before[b], low)
            label = label[label]
            keep = label[a] != label[b]
            if not keep.any() and (label == label[label]).all():
                break
    while (label != label[label]).any():
        label = label[label]
    child = np.flatnonzero(label != np.arange(n))
    return label[child], child


def _sharded(solve, width: int):
    """``solve`` (key, rows) for whole groups of equal keys; batches come sorted by key, with ``width`` long columns after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last, perhaps unfinished, group waits for the next batch."""
        key, rows = np.empty(0, np.int64), np.empty((0, width), np.int64)
        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            rows = np.r_[rows, np.stack([batch.column(1 + i).to_numpy() for i in range(width)], axis=1)]
            if len(key) and key[0] != key[-1]:
                done = np.searchsorted(key, key[-1], "left")
                yield from solve(key[:done], rows[:done])
                key, rows = key[done:], rows[done:]
        if len(key):
            yield from solve(key, rows)

    return run


def _shard_links(radius: int, words: int):
    """Rows (key, vertex, one or more words of the fingerprint) come sorted by key; links of vertices go out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(start) - 1
        many = np.bincount(group)[group] > 1
        if many.any():
            rows = rows[many]
            i, j = forest_links(group[many], np.ascontiguousarray(rows[:, 1:]).view(np.uint64), radius)
            if len(i):
                yield pa.record_batch([pa.array(rows[i, 0]), pa.array(rows[j, 0])], schema=schema)

    return _sharded(solve, words + 1)


def _linked(keyed: DataFrame, radius: int, words: int) -> DataFrame:
    """Links of the table (key, vertex, fingerprint words): its shards are dealt out by key."""
    n = partitions(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "vertex").mapInArrow(_shard_links(radius, words), "a long, b long")


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fingerprint) within ``radius`` bits, directly or by way of others."""
    blocks = radius + 2
    keyed = prints.select(F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key"), F.col("fingerprint").alias("vertex"), "fingerprint")
    return _linked(keyed, radius, 1)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked by at most ``radius`` differing bits.

    Returns one row per document: id, fingerprint (long), component_id (smallest id
    reachable, itself included). Null and empty texts have fingerprint 0 and link like
    any other; repeated rows keep their number; other columns are ignored; an empty
    table gives an empty result.
    """
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fingerprint")))
    prints = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = cut(near_links(prints, radius).distinct())
    # vertices are in the order of their smallest id, so that a component's label brings the id with it
    named = prints.select("fingerprint", F.struct(F.col("least").isNull().alias("unknown"), "least", "fingerprint").alias("vertex"))
    by_id = lambda side: named.withColumnRenamed("fingerprint", side).withColumnRenamed("vertex", f"v_{side}")
    pairs = links.join(by_id("a"), "a").join(by_id("b"), "b").select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))
    label = components(pairs).select(F.col("v.fingerprint").alias("fingerprint"), F.col("label.least").alias("component"))
    ids = prints.join(label, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component_id"))
    return marked.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Near copies: a Jaccard similarity of at least SIMILAR (a fraction) of the sets of five-word shingles.
SIMILAR = (4, 5)
#: Candidates share one of BANDS keys of BAND_ROWS minima of the set each: 1 - (1 - 0.8^4)^20, or 0.99997, at a similarity of 0.8.
BANDS, BAND_ROWS = 20, 4
#: Words of the SimHash, and the bits in which what is linked first may differ: at 0.8 these are 39 of 256 on average. Pairs that are not linked
#: this way are found by their rarest shingles, whatever their SimHashes are.
COPY_WORDS, COPY_RADIUS = 4, 68
#: Words of 64 parity bits of a set.
PARITY_WORDS = 8
#: Pairs that one copy of a vertex's text serves.
PAIRS_PER_TEXT = 256
#: Vertices whose row numbers are broadcast.
MOST_BROADCAST = 1_000_000


def _remixed(h: np.ndarray, k) -> np.ndarray:
    """Further hashes of what was hashed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):  # modulo 2**64
        h = h + (np.asarray(k, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def copy_prints(text: str, words: int = 5) -> tuple[tuple[int, int], int, list[int], list[int]]:
    """(128-bit hash of the set of shingles, its size, SimHash words, band keys); an empty set has no keys."""
    shingles = shingle_set(text, words)
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes(), SEED)
    vertex = digest >> 64, digest & ((1 << 64) - 1)
    prints = [majority(_remixed(shingles, np.uint64(k))) for k in range(COPY_WORDS)]
    if not len(shingles):
        return vertex, 0, prints, []
    k = np.arange(COPY_WORDS, COPY_WORDS + BANDS * BAND_ROWS, dtype=np.uint64)[:, None]
    least = np.min([_remixed(shingles[i : i + 1024], k).min(axis=1) for i in range(0, len(shingles), 1024)], axis=0)
    return vertex, len(shingles), prints, [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def are_copies(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least SIMILAR."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)


def _crossing(radius: int, step: str):
    """Rows (key, vertex, label, size, words) come sorted by key and vertex; candidate pairs (a, b, gap) of different labels go out.

    Step "earlier": for each vertex the nearest one before it; "nearest": for each the
    nearest one.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gap", pa.int64())])

    def solve(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        # the members of a group's commonest label needn't ask: pairs among them are settled, and the others ask for them
        _, pair, count = np.unique(np.stack([group, rows[:, 1]], axis=1), axis=0, return_inverse=True, return_counts=True)
        pair = pair.reshape(-1)
        size = np.bincount(group)
        mixed = count[pair] < size[group]
        if not mixed.any():
            return
        group, rows, pair = group[mixed], rows[mixed], pair[mixed]
        order = np.lexsort((pair, -count[pair], group))
        head = order[np.r_[True, group[order][1:] != group[order][:-1]]]
        commonest = np.zeros(len(size), np.int64)
        commonest[group[head]] = pair[head]
        queries = np.arange(len(rows)) if step == "earlier" else np.flatnonzero(pair != commonest[group])
        prints = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        for query, node, gap in _hits(prints, radius, _forest(group, prints), queries):
            small, large = np.minimum(rows[query, 2], rows[node, 2]), np.maximum(rows[query, 2], rows[node, 2])
            keep = (rows[query, 1] != rows[node, 1]) & (SIMILAR[1] * small >= SIMILAR[0] * large)
            if step == "earlier":
                keep &= node < query
            query, node, gap = query[keep], node[keep], gap[keep]
            if len(query):
                order = np.lexsort((node, gap, query))
                order = order[np.r_[True, query[order][1:] != query[order][:-1]]]
                query, node, gap = query[order], node[order], gap[order]
            if len(query):
                yield pa.record_batch([pa.array(rows[query, 0]), pa.array(rows[node, 0]), pa.array(gap)], schema=schema)

    return _sharded(solve, 3 + COPY_WORDS)


def _shared(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of keys that more than one vertex has."""
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    many = np.bincount(group)[group] > 1
    if many.any():
        names = ["key", "vertex", "size", *(f"w{i}" for i in range(COPY_WORDS))]
        yield pa.record_batch([pa.array(c) for c in (key[many], *rows[many].T)], names=names)


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose texts (vertex, text) are copies; the text of a vertex in many pairs is given to several tasks."""

    @F.pandas_udf("boolean")
    def copies(a: pd.Series, b: pd.Series) -> pd.Series:
        last: dict[str, np.ndarray] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            for t in (x, y):
                if t not in last:
                    last = {k: v for k, v in last.items() if k in (x, y)} | {t: shingle_set(t, words)}
            out.append(are_copies(last[x], last[y]))
        return pd.Series(out, dtype=bool)

    def with_text(rows: DataFrame, side: str) -> DataFrame:
        often = cut(rows.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_PER_TEXT).cast("long").alias("salts")).where("salts > 1"))
        salts, text = F.coalesce("salts", F.lit(1).cast("long")), texts.select(F.col("vertex").alias(side), F.col("text").alias(f"text_{side}"))
        if often.isEmpty():
            return rows.join(text, side)
        given = text.join(F.broadcast(often), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
        salted = rows.join(F.broadcast(often), side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts)).drop("salts")
        return salted.join(given, [side, "salt"]).drop("salt")

    return with_text(with_text(pairs, "a"), "b").where(copies("text_a", "text_b")).select("a", "b")


def _shingled(words: int):
    """Rows (vertex, text) become (vertex, size, token), a row a shingle of the set."""
    names = ["vertex", "size", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vertex, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingle_set(text.as_py(), words).view(np.int64)
                for i in range(0, len(tokens), 1 << 16):
                    part = tokens[i : i + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(part), vertex)), pa.array(np.full(len(part), len(tokens))), pa.array(part)], names=names)

    return run


def _prefix_pairs(texts: DataFrame, label: DataFrame, shelf: Shelf, words: int) -> DataFrame:
    """All pairs (a, b) of differently labelled vertices of ``texts`` (vertex, text) that can be copies.

    Shingles are ordered by their number of vertices. Two sets of a similarity of SIMILAR share one among the first of
    each, and the first that they share stands so early that what follows is enough for the common part they need
    (prefix and position filter). Every shingle also flips one bit of its set's parity bits: two sets differ in at least as many shingles as bits, which
    bounds their similarity from above. So pairs that share only what is frequent are never made, nor most that are a little too far apart. All three bounds are exact. Members of a shingle's commonest label
    don't ask: the others ask them.
    """
    top, low = SIMILAR
    tokens, _ = shelf.put(texts.mapInArrow(_shingled(words), "vertex long, size long, token long"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # what one vertex has is shared with none, but stands first
    rarest = W.partitionBy("vertex").orderBy(F.coalesce("df", F.lit(1)), "token")
    ordered = tokens.join(counts, "token", "left").withColumn("pos", F.row_number().over(rarest))
    # of n shingles the first n - ceil(0.8 n) + 1
    first = ordered.where(F.col("df").isNotNull() & (F.col("pos") <= F.col("size") - F.ceil(F.col("size") * top / low) + 1))
    flip = F.expr("shiftleft(1L, cast(pmod(token, 64) as int))")
    word = F.pmod(F.shiftright("token", 6), F.lit(PARITY_WORDS))
    parity = tokens.groupBy("vertex").agg(*(F.bit_xor(F.when(word == i, flip).otherwise(F.lit(0).cast("long"))).alias(f"x{i}") for i in range(PARITY_WORDS)))
    bits = [f"x{i}" for i in range(PARITY_WORDS)]
    first = first.join(label.select(F.col("v").alias("vertex"), "label"), "vertex").join(parity, "vertex").select("token", "vertex", "label", "size", "pos", *bits)
    first, _ = shelf.put(first)
    common = first.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.count("*").alias("labels"))
    mixed = first.join(common.where("labels > 1").select("token", "common"), "token")
    side = lambda d, s: d.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("vertex", "label", "size", "pos", *bits)))
    differing = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in bits))
    need = (F.col("size_a") + F.col("size_b")) * top  # of the common part, times top + low
    fits = (
        (F.col("label_a") != F.col("label_b"))
        & (F.least("size_a", "size_b") * low >= F.greatest("size_a", "size_b") * top)
        & ((F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) + 1) * (top + low) >= need)
        & (differing * (top + low) <= (F.col("size_a") + F.col("size_b")) * (low - top))
    )
    a, b = side(mixed.where("label <> common"), "a"), side(mixed, "b")
    pairs = a.join(b, (a["token"] == b["token"]) & fits)
    return pairs.select(F.least("vertex_a", "vertex_b").alias("a"), F.greatest("vertex_a", "vertex_b").alias("b")).distinct()


def copy_groups(rows: DataFrame, words: int = 5, radius: int = COPY_RADIUS) -> DataFrame:
    """Groups of near copies of the table (row: long and unique, doc_id, text): (row, doc_id, label), one label a group.

    Two texts are linked if the Jaccard similarity of their sets of shingles is at least
    SIMILAR. Candidates share a band key. First a BK-tree finds each vertex's nearest candidate within
    ``radius`` bits of the SimHash, which links most of a large group at about one verification a
    copy; then all pairs of what is still apart that their rarest shingles allow are verified. Null and empty texts are copies of each other;
    very long texts are compared whole; an empty table gives an empty result. ``rows`` must give the same rows each time.
    """

    @F.pandas_udf("struct<h1:bigint,h2:bigint,size:bigint,print:array<bigint>,keys:array<bigint>>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        found = [copy_prints(t, words) for t in texts]
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        h1, h2 = signed([f[0][0] for f in found]), signed([f[0][1] for f in found])
        return pd.DataFrame({"h1": h1, "h2": h2, "size": [f[1] for f in found], "print": [signed(f[2]) for f in found], "keys": [signed(f[3]) for f in found]})

    n = partitions(rows.sparkSession)
    shelf = Shelf(rows.sparkSession, "copies")
    marked, _ = shelf.put(rows.select("row", "doc_id", prints(whole("text")).alias("p")).select("row", "doc_id", "p.*"))
    # a vertex is a set of shingles, by the number of its first row
    sets = marked.groupBy("h1", "h2").agg(F.min("row").alias("vertex"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("keys").alias("keys"))
    vertices, _ = shelf.put(sets)
    members = marked.select("row", "doc_id", "h1", "h2").join(vertices.select("h1", "h2", "vertex"), ["h1", "h2"]).select("row", "doc_id", "vertex")
    keyed = vertices.select(F.explode("keys").alias("key"), "vertex", "size", *(F.col("print")[i].alias(f"w{i}") for i in range(COPY_WORDS)))
    dealt = lambda d: d.repartition(n, "key").sortWithinPartitions("key", "vertex")
    shared, _ = shelf.put(dealt(keyed).mapInArrow(_sharded(_shared, 2 + COPY_WORDS), "key long, vertex long, size long, " + ", ".join(f"w{i} long" for i in range(COPY_WORDS))))
    involved, _ = shelf.put(shared.select("vertex").distinct())
    few = involved.count() <= MOST_BROADCAST
    numbered = involved.select(F.col("vertex").alias("row"))
    texts, _ = shelf.put(rows.select("row", whole("text").alias("text")).join(F.broadcast(numbered) if few else numbered, "row").select(F.col("row").alias("vertex"), "text"))

    label = involved.select(F.col("vertex").alias("v"), F.col("vertex").alias("label"))
    links = tested = None
    for step in ("earlier", "nearest", "rarest"):
        if step == "rarest":
            # vertices that share a band key with one of another label
            apart = shared.select("key", F.col("vertex").alias("v")).join(label, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))
            split = apart.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
            open_ones, _ = shelf.put(apart.join(split.select("key"), "key", "left_semi").select("v", "label").distinct())
            pairs = _prefix_pairs(texts.join(open_ones.select(F.col("v").alias("vertex")), "vertex", "left_semi"), open_ones, shelf, words)
        else:
            labelled = shared.join(label.withColumnRenamed("v", "vertex"), "vertex", "left").select(
                "key", "vertex", F.coalesce("label", "vertex").alias("label"), "size", *(f"w{i}" for i in range(COPY_WORDS))
            )
            found = dealt(labelled).mapInArrow(_crossing(radius, step), "a long, b long, gap long")
            nearest = found.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b"))
            pairs = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs, _ = shelf.put(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        good, _ = shelf.put(_verified(pairs, texts, words))
        if good.isEmpty():
            continue
        links = good if links is None else links.union(good)
        label = components(links)
    label = label.withColumnRenamed("v", "vertex")
    return members.join(label, "vertex", "left").select("row", "doc_id", F.coalesce("label", "vertex").alias("label"))


def without_copies(docs: DataFrame, words: int = 5, radius: int = COPY_RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the smallest doc_id.

    A fresh row number ties each row to its group, so repeated rows go too; all columns
    stay. ``docs`` must give its rows in the same order each time, as a stored table does.
    """
    row = free_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = copy_groups(numbered.select(F.col(row).alias("row"), "doc_id", "text"), words, radius)
    kept = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
