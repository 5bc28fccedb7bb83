"""Approximate nearest neighbours by shifted Hilbert orderings.

Every ordering rotates the vectors at random, projects them to a few dimensions, shifts
the grid and reads the cells off along a Hilbert curve. Sampled keys cut each ordering into
blocks of about equal size, by which Spark deals the rows out; a query goes to its own block
and to ``width`` blocks on both sides, each block returns its best, and the merged
candidates are ranked by the exact cosine. How many orderings and how wide a window
it takes is fitted on a sample of queries whose true neighbours are found by brute force.

Equal vectors are brought together first, with their smallest ids, so that thousands of
copies are one candidate and ties go to the smaller id exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions

ORDERINGS = 6
DIMENSIONS, CELL_BITS = 8, 7
#: Rows of a block on average, blocks at most, and sampled keys for each block: at most MOST_BLOCKS * KEYS_PER_BLOCK * ORDERINGS longs reach the driver.
BLOCK_ROWS, MOST_BLOCKS, KEYS_PER_BLOCK = 2048, 1 << 16, 16
#: Queries whose true neighbours are looked up to fit the window, and the recall the fit asks for (measured recall must reach 0.9).
FIT_QUERIES, FIT_RECALL = 256, 0.95
_BATCH = pa.schema([("query", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of integer coordinates (Skilling's transform, then interleaved bits)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return key


def ordering_keys(vectors: np.ndarray, ids: np.ndarray, ordering: int) -> np.ndarray:
    """The vectors' keys in one ordering; seven bits of a hash of the id split crowded cells."""
    rng = np.random.default_rng([ordering, 5])
    d = vectors.shape[1]
    basis = np.linalg.qr(rng.standard_normal((d, min(d, DIMENSIONS))))[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    z = unit @ basis * math.sqrt(d)
    u = 1 / (1 + np.exp(-1.702 * z))  # about the normal distribution function
    cells = np.minimum(((u * 0.75 + rng.random(basis.shape[1]) * 0.25) * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    return (hilbert(cells, CELL_BITS) << np.uint64(7) | spread).astype(np.int64)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of a query with some vectors in double precision, each summed by itself, in the order of the components."""
    dot = (vectors * query).sum(axis=1)
    return dot / (np.sqrt((vectors * vectors).sum(axis=1)) * math.sqrt(float((query * query).sum())))


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best ids for each query; a product of matrices selects, ``cosines`` scores."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    spare = min(len(ids), k + 4)
    for start in range(0, len(query_ids), 256):
        part = queries[start : start + 256]
        near = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
        top = np.argpartition(-near, spare - 1, axis=1)[:, :spare]
        found, scores = [], []
        for q, row in zip(part, top, strict=True):
            s = cosines(vectors[row], q)
            order = np.lexsort((ids[row], -s))[:k]
            found.append(ids[row][order])
            scores.append(s[order])
        n = [len(f) for f in found]
        yield pa.record_batch([pa.array(np.repeat(query_ids[start : start + 256], n)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], schema=_BATCH)


def _search_blocks(d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (ordering, block), candidates before queries; one block's candidates are held at a time."""
        at, ids, vectors, ready = None, [], [], None
        for batch in batches:
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cid, vector = batch.column(2).to_numpy(), _matrix(batch.column(3), d)
            edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(edge, np.r_[edge[1:], len(place)], strict=True):
                if place[s] != at:
                    at, ids, vectors, ready = place[s], [], [], None
                if kind[s] == 0:
                    ids.append(cid[s:e])
                    vectors.append(vector[s:e])
                elif ids:
                    ready = ready or (np.concatenate(ids), np.concatenate(vectors))
                    yield from best_of(*ready, cid[s:e], vector[s:e], k)

    return run


def _brute(d: int, k: int, query_ids: np.ndarray, queries: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from best_of(batch.column(0).to_numpy(), _matrix(batch.column(1), d), query_ids, queries, k)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.desc("score"), "found")
    return found.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def sampled_splits(classes: DataFrame, d: int, blocks: int, rows: int) -> list[np.ndarray]:
    """The keys that cut each ordering into ``blocks`` about equal parts, from the keys of a sample by hash; the vectors stay where they are."""
    share = min(1.0, KEYS_PER_BLOCK * blocks / max(1, rows))
    sample = classes.select("cid", "embedding").where(F.pmod(F.xxhash64(F.lit("split"), "cid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    names = [f"k{o}" for o in range(ORDERINGS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                yield pa.record_batch([pa.array(ordering_keys(vectors, ids, o)) for o in range(ORDERINGS)], names=names)

    keys = sample.mapInArrow(keyed, ", ".join(f"{n} long" for n in names)).toPandas()
    cuts = lambda k: np.unique(k[[len(k) * i // blocks for i in range(1, blocks)]]) if blocks > 1 and len(k) else np.empty(0, np.int64)
    return [cuts(np.sort(keys[n].to_numpy())) for n in names]


def fit_windows(classes: DataFrame, asked: DataFrame, splits: list[np.ndarray], d: int, k: int) -> tuple[int, int]:
    """(orderings, width): the cheapest windows that hold FIT_RECALL of a sample's true neighbours."""
    sample = asked.orderBy(F.xxhash64("cid"), "cid").limit(FIT_QUERIES).select("cid", "embedding").toPandas()
    if not len(sample):
        return 1, 0
    ids, vectors = sample["cid"].to_numpy(), np.stack(sample["embedding"].to_numpy()).astype(np.float64)
    found = classes.select("cid", "embedding").mapInArrow(_brute(d, k, ids, vectors), "query long, found long, score double")
    truth = _best(found, k)
    near = truth.join(classes.select(F.col("cid").alias("found"), "embedding"), "found").select("query", "found", "embedding").toPandas()
    own = {c: i for i, c in enumerate(ids)}
    at = near["query"].map(own).to_numpy()
    there = np.stack(near["embedding"].to_numpy()).astype(np.float64)
    gaps = []
    for o, split in enumerate(splits):
        a = np.searchsorted(split, ordering_keys(vectors, ids, o), "right")[at]
        gaps.append(np.abs(a - np.searchsorted(split, ordering_keys(there, near["found"].to_numpy(), o), "right")))
    blocks = max(len(s) for s in splits) + 1
    widths = sorted({0, *(int(1.3**i) for i in range(60) if 1.3**i < blocks), blocks})
    best = None
    for n in range(1, len(splits) + 1):
        least = np.min(gaps[:n], axis=0)
        w = next(w for w in widths if (least <= w).mean() >= FIT_RECALL)
        cost = n * min(blocks, 2 * w + 1)
        if best is None or cost < best[0]:
            best = (cost, n, w)
    return best[1], best[2]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", windows: tuple[int, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest other rows found for each row for which ``queries`` holds: query_id, rank, vec_id, score.

    Vectors that are null, zero, of another length than most, or have null or non-finite components take no
    part. Copies are each found; repeated rows of one id count as one; ties go to the smaller id; fewer rows than
    ``k`` give all; an empty table gives an empty result. ``windows``: (orderings, width)
    instead of fitting them. How narrow they can be depends on the vectors: where these fill all
    of their dimensions alike, every block has to be searched.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), queries.alias("asked")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    d = lengths["d"]
    keyed = rows.where(F.size("embedding") == d).select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    w = W.partitionBy("h1", "h2").orderBy("vec_id")
    few = keyed.withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= k + 1)
    classes = cut(few.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids")))
    wanted = cut(keyed.where("asked").select("h1", "h2", "vec_id").distinct())
    named = cut(wanted.join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid"))
    asked = classes.join(named.select("cid").distinct(), "cid", "left_semi").select("cid", "embedding")

    n_classes = classes.count()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(n_classes / block_rows)))
    splits = sampled_splits(classes, d, blocks, n_classes)
    orderings, width = windows or fit_windows(classes, asked, splits, d, k + 1)
    bounds = spark.sparkContext.broadcast(splits[:orderings])

    def deal(kind: int, reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                for o, split in enumerate(bounds.value):
                    block = np.searchsorted(split, ordering_keys(rows, ids, o), "right")
                    for step in range(-reach, reach + 1):
                        to = block + step
                        ok = np.flatnonzero((to >= 0) & (to <= len(split)))
                        if len(ok):
                            part = batch.take(pa.array(ok))
                            yield pa.record_batch([pa.array(o * (MOST_BLOCKS + 1) + to[ok]), pa.array(np.full(len(ok), kind, np.int32)), part.column(0), part.column(1)], names=["place", "kind", "cid", "embedding"])

        return run

    dealt = "place long, kind int, cid long, embedding array<double>"
    candidates = classes.select("cid", "embedding").mapInArrow(deal(0, 0), dealt)
    sent = asked.mapInArrow(deal(1, min(width, blocks)), dealt)
    n = partitions(spark)
    placed = candidates.unionByName(sent).repartition(n, "place").sortWithinPartitions("place", "kind")
    found = _best(placed.mapInArrow(_search_blocks(d, k + 1), "query long, found long, score double"), k + 1)
    members = found.join(classes.select(F.col("cid").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    pairs = named.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).join(lists, "query")
    others = pairs.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
