"""A stored vector index: vectors with their norms in cells about pivots, and a manifest that says what it was made of.

A search is exact. A cell's vectors lie within known angles of its pivot, so the
query's angle to the pivot bounds the best cosine that the cell can hold: the nearest cell is searched
first, and after that only cells that can still beat the k-th hit, by their directories.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifests
from . import rank

#: Pivots at most: so many vectors are known to the driver, and so many directories there are.
MOST_CELLS = 64


def path_digest(docs: DataFrame, column: str = "path") -> str:
    """A digest of the set of paths of a table, whatever their order and repetitions, from sums that tasks add up."""
    h = F.xxhash64(column)
    row = docs.select(column).distinct().agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), column).cast("decimal(38,0)")).alias("t")).first()
    return f"{row['n']}:{row['x'] or 0}:{row['s'] or 0}:{row['t'] or 0}"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


class VectorIndex:
    """Versions of an index of documents (path) under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.manifests = spark, Manifests(spark, folder)

    def build(self, docs: DataFrame, embedding: Column, dimensions: int) -> int:
        """Index documents (path and any other columns, which are kept) by an embedding; the new version.

        Rows without a path, or whose embedding is null, of another length, or without a finite length above 0, are left out of the search
        but count as indexed. Repeated paths are kept as they are.
        """
        given = docs.withColumn("embedding", embedding.cast("array<double>"))
        norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
        sound = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
        rows = given.where(F.col("path").isNotNull() & sound).withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
        staged = self.spark.read.parquet(self.manifests.stage("embedded", rows))
        sample = staged.select("path", "embedding", "norm").orderBy(F.xxhash64("path"), "path").limit(MOST_CELLS).collect()
        pivots = [[x / r["norm"] for x in r["embedding"]] for r in sample]
        if pivots:
            nearest = F.array_max(F.transform(F.array(*map(_literal, pivots)), lambda p, i: F.struct((_dot(F.col("embedding"), p) / F.col("norm")).alias("cos"), i.alias("cell"))))
            placed = staged.withColumn("_near", nearest).withColumns({"cell": F.col("_near.cell"), "cos": F.least(F.greatest(F.col("_near.cos"), F.lit(-1.0)), F.lit(1.0))}).drop("_near")
        else:
            placed = staged.withColumns({"cell": F.lit(0), "cos": F.lit(0.0)})
        # by cell and a hash of the path: a cell that holds most vectors is written by several tasks
        path = self.manifests.stage("vectors", placed.repartition("cell", F.pmod(F.xxhash64("path"), F.lit(8))), ("cell",) if pivots else ())
        reach = {r["cell"]: [r["a"], r["b"], r["n"]] for r in self.spark.read.parquet(path).groupBy("cell").agg(F.min("cos").alias("a"), F.max("cos").alias("b"), F.count("*").alias("n")).collect()} if pivots else {}
        cells = [{"cell": c, "pivot": pivots[c], "low": a, "high": b, "n": n} for c, (a, b, n) in sorted(reach.items())]
        notes = {"dimensions": dimensions, "digest": path_digest(docs), "cells": cells}
        return self.manifests.update(lambda base: ({"vectors": path}, notes))

    def notes(self) -> dict:
        return self.manifests.manifest(self.manifests.latest())["notes"]

    def usable(self, docs: DataFrame, dimensions: int) -> bool:
        """Whether the index was made of exactly these paths, with so many dimensions: by the manifest's digest, without reading the vectors."""
        notes = self.notes()
        return bool(notes) and notes["dimensions"] == dimensions and notes["digest"] == path_digest(docs)

    def bounds(self, query: list[float]) -> list[tuple[float, int, int]]:
        """(best cosine that a cell can hold, cell, vectors in it), best first."""
        length = math.sqrt(sum(x * x for x in query))
        out = []
        for c in self.notes()["cells"]:
            at = math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(c["pivot"], query, strict=True)) / length)))
            near, far = math.acos(c["high"]), math.acos(c["low"])
            out.append((math.cos(max(0.0, near - at, at - far)), c["cell"], c["n"]))
        return sorted(out, reverse=True)

    def search(self, query: list[float], k: int = 10, kind: Column | None = None) -> DataFrame:
        """The ``k`` nearest documents by cosine: the stored columns and score (six places), ties to the smaller path. ``kind`` filters before the ranking."""
        vectors = self.manifests.table("vectors")
        length = math.sqrt(sum(x * x for x in query))
        score = F.round(_dot(F.col("embedding"), _literal(query)) / (F.col("norm") * length), 6)
        rows = (vectors if kind is None else vectors.where(kind)).withColumn("score", score)
        order = self.bounds(query) if length > 0 else []
        if not order:
            return rows.limit(0).drop("embedding", "norm", "cell", "cos")
        held, first = 0, []
        for _, cell, n in order:  # the first cells that hold k vectors
            first.append(cell)
            held += n
            if held >= k:
                break
        scores = [r["score"] for r in rank.top(rows.where(F.col("cell").isin(*first)).select("path", "score"), k, "path").collect()]
        least = scores[-1] if len(scores) == k else -2.0
        cells = [cell for bound, cell, _ in order if bound >= least - 1e-6 or cell in first]
        return rank.top(rows.where(F.col("cell").isin(*cells)), k, "path").drop("embedding", "norm", "cell", "cos")
