"""Whitening by principal components, found by FEAST contour integration.

Spark sums what the covariance needs, exactly, in integers; what is left is one matrix as wide as a
vector. Inertia counts of shifted matrices cut its spectrum into intervals; for each, a
quadrature along a circle through both ends, of solves with the complex shifted matrix, projects random vectors onto the
interval's eigenvectors, and Rayleigh-Ritz takes these out. Inertia says how many there have to be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries at or above this leave the longs when they are scaled, and count as not finite.
MOST = float(1 << 56)
#: Eigenvalues below this share of the largest row sum are 0 to double precision: there is nothing to whiten.
TINY = 1e-11
#: Points of the quadrature on half a circle, eigenvalues of one interval if they can be told apart, and rounds of refinement.
NODES, CROWD, ROUNDS = 12, 8, 40


def usable(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite entry; an empty one isn't usable."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))


def on_grid(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry c."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


# --- exact sums


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def gram(z: np.ndarray) -> np.ndarray:
    """The products of all pairs of columns of an integer matrix, summed exactly: floating-point products of slices whose sums stay below 2**53, or Python's integers."""
    d = z.shape[1]
    total = np.zeros((d, d), object)
    most = int(np.abs(z).max(initial=0))
    rows = len(z) if most == 0 else (1 << 53) // (most * most)
    if rows < 1:
        wide = z.astype(object)
        return wide.T @ wide
    for i in range(0, len(z), max(1, rows)):
        part = z[i : i + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def totals(rows: DataFrame, column: str, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows of what ``of`` makes of a batch (``width`` integers), added in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                total = total + of(_matrix(batch.column(0), d))
        kind = pa.decimal128(38, 0)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([Decimal(int(t)) for t in total], kind)], names=["i", "part"])

    sums = rows.select(column).mapInArrow(run, "i int, part decimal(38,0)").groupBy("i").agg(F.sum("part").alias("total")).collect()
    out = [0] * width
    for r in sums:
        out[r["i"]] = int(r["total"])
    return out


# --- eigenvectors of one symmetric matrix


def inertia(m: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, by its factors L D L' with pivots of one or two rows (Bunch and Parlett)."""
    a, n, k, negative = m.copy(), len(m), 0, 0
    bound = (1 + np.sqrt(17)) / 8
    while k < n:
        rest = np.abs(a[k:, k:])
        p, q = np.unravel_index(rest.argmax(), rest.shape)
        r = int(rest.diagonal().argmax())
        if rest[p, q] == 0:
            break
        if rest[r, r] >= bound * rest[p, q]:
            picks = [r]
        else:
            picks = sorted((int(p), int(q)))
        for to, pick in enumerate(picks):
            i, j = k + to, k + pick
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
        s = len(picks)
        block, side = a[k : k + s, k : k + s], a[k + s :, k : k + s].copy()
        negative += int(block[0, 0] < 0) if s == 1 else 1  # a pivot of two rows has one eigenvalue of either sign
        a[k + s :, k + s :] -= side @ np.linalg.solve(block, side.T)
        k += s
    return negative


def above(v: np.ndarray, t: float) -> int:
    """Eigenvalues of ``v`` greater than ``t``."""
    return inertia(t * np.eye(len(v)) - v)


def clear(v: np.ndarray, t: float, near: float) -> float:
    """A place at or about ``t`` with no eigenvalue within ``near``, as an end there would cut a cluster; ``t`` where all have some."""
    return next((x for x in (t + s * near for s in (0, 7, -13, 29, -53, 101, -199)) if above(v, x - near) == above(v, x + near)), t)


def cuts(v: np.ndarray, wanted: int, floor: float, roof: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues) from the roof downwards that hold the ``wanted`` largest eigenvalues: CROWD each, unless they can't be told apart, and no wider than four times their low end."""
    found: list[tuple[float, float, int]] = []

    def split(low: float, high: float, n_low: int, n_high: int) -> None:
        if n_low == n_high or n_high >= wanted:
            return
        if (n_low - n_high <= CROWD and high <= 4 * low) or high - low <= 1e-9 * high:
            found.append((low, high, n_low - n_high))
            return
        mid = clear(v, (low * high) ** 0.5 if high > 4 * low else (low + high) / 2, 1e-3 * (min(high, 4 * low) - low))
        n_mid = above(v, mid)
        split(mid, high, n_mid, n_high)
        split(low, mid, n_low, n_mid)

    split(floor, roof, above(v, floor), 0)
    return found


def feast(v: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in (low, high) and their unit eigenvectors, as columns; there are ``expected`` of them."""
    d, scale = len(v), float(np.abs(v).sum(axis=1).max())
    middle, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    points = radius * np.exp(0.5j * np.pi * (1 + x))
    eye = np.eye(d)
    rng = np.random.default_rng(11)
    y = rng.standard_normal((d, min(d, expected + max(4, expected // 2))))
    best, stale = None, 0
    for _ in range(ROUNDS):
        # half of the circle is enough: the other half gives the conjugates
        q = sum(0.5 * wi * (p * np.linalg.solve((middle + p) * eye - v, y)).real for wi, p in zip(w, points, strict=True))
        q = np.linalg.qr(q)[0]
        small = q.T @ v @ q
        values, turn = np.linalg.eigh((small + small.T) / 2)
        y = q @ turn
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) < expected:
            continue
        # directions that are not yet sorted out can show values inside as well: the true ones leave the least
        left = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
        inside = np.sort(inside[np.argsort(left)[:expected]])
        worst = float(np.sort(left)[expected - 1])
        if best is None or worst < best[0]:
            best, stale = (worst, values[inside], y[:, inside]), 0
        else:
            stale += 1
        if worst <= 1e-15 * scale or stale == 3:
            break
    if best is None or best[0] > 1e-9 * scale:
        raise RuntimeError(f"{expected} eigenvalues in ({low}, {high}) not found: {best and best[0]}")
    return best[1], best[2]


def principal(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; fewer where it has a lower rank."""
    roof = float(np.abs(v).sum(axis=1).max(initial=0.0)) * 1.001
    floor = clear(v, TINY * roof, 1e-3 * TINY * roof) if roof > 0 else 0.0
    wanted = min(most, above(v, floor) if roof > 0 else 0)
    if not wanted:
        return np.empty(0), np.empty((len(v), 0))
    parts = [feast(v, *cut) for cut in cuts(v, wanted, floor, roof)]
    # one more Rayleigh-Ritz over all intervals makes their vectors orthogonal to each other
    q = np.linalg.qr(np.concatenate([p[1] for p in parts], axis=1))[0]
    small = q.T @ v @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:wanted]
    values, vectors = values[order], (q @ turn)[:, order]
    gap = 1e-8 * roof
    if above(v, values[-1] - gap) < wanted or above(v, values[0] + gap):
        raise RuntimeError("eigenvalues are missing")
    return values, vectors


# --- the operator


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and each of the ``most`` first components.

    Vectors that are null, empty, of another length than most (ties: the shorter), or hold null, non-finite entries or
    such as leave the longs are dropped. Each distinct vector of the grid is fitted once, so copies weigh
    nothing, however many; every row, repeated ones and those with a null id too, is whitened. Components without
    variance aren't returned: none where all vectors are equal. An empty table gives an empty result.
    A ``deviation`` beyond a long is an error. Only matrices as wide as a vector reach the driver.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    lengths = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    gridded = fine.where(F.size("v") == d).select("vec_id", on_grid(F.col("v")).alias("x"))
    fits, _ = Shelf(spark, "whitening").put(gridded.select("x").distinct())

    def first(x: np.ndarray) -> np.ndarray:
        return np.append(x.astype(object).sum(axis=0), len(x))

    *sums, n = totals(fits, "x", d, d + 1, first)
    centre = np.array([round(Decimal(s) / n) for s in sums], np.int64)
    products = np.array(totals(fits, "x", d, d * d, lambda x: gram(x - centre).reshape(-1)), object).reshape(d, d)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)  # n times what the integer centre is off
    exact = n * products - np.outer(rest, rest)
    v = np.array([[int(e) / (n * n) for e in row] for row in exact], np.float64).reshape(d, d)
    values, vectors = principal(v, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)
    share = (values / float(np.trace(v))).tolist()

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S, exactly; x - S / n)"""
        z = x - centre
        wide = int(np.abs(z).max(initial=0)) * n + int(max(abs(r) for r in rest)) >= 1 << 53
        y = (z.astype(object) if wide else z) * n - (rest if wide else rest.astype(np.int64))
        return y, y.astype(np.float64) / n

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and products of the whitened fit list, a row a task."""
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = centred(_matrix(batch.column(0), d))[1] @ turn
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["i", "part"])

    parts = fits.mapInArrow(outer, "i int, part double").groupBy("i").agg(F.sum("part").alias("total")).collect()
    total = np.zeros((k + 1) * k)
    for r in parts:
        total[r["i"]] = r["total"]
    mean, square = total[:k] / n, total[k:].reshape(k, k) / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                y, x = centred(_matrix(batch.column(1), d))
                big = int(np.abs(y).max(initial=0)) ** 2 * d >= 1 << 63
                deviation = ((y.astype(object) if big else y.astype(np.int64)) ** 2).sum(axis=1)
                if big and max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation is beyond a long")
                m = batch.num_rows
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array((x @ turn).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return gridded.mapInArrow(project, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
