import numpy as np
from cases import table
from pyspark.sql import functions as F

from marlstone.llm import neighbours as n


def asked():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    out = {}
    for i in sorted({i for i in ids.tolist() if i % 50 == 0}):
        s = n.cosines(v, v[ids.tolist().index(i)])
        near = sorted({(-round(float(x), 12), int(j)) for x, j in zip(s, ids, strict=True) if j != i})[:k]
        out[i] = [j for _, j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_wide_windows_are_exact_and_fitted_ones_reach_the_recall(spark):
    rows = table(spark, "embeddings", "/root/testdata/sf0.1")
    want = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert found(n.nearest(rows, asked(), windows=(1, n.MOST_BLOCKS))) == want
    got = found(n.nearest(rows, asked()))
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_narrow_windows_of_several_orderings(spark, monkeypatch):
    """Vectors of few inner dimensions in over 50 blocks: fitted windows are a part of the blocks, and hold the recall."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 32))
    points = np.tanh(rng.standard_normal((7000, 4)) @ base) + 0.01 * rng.standard_normal((7000, 32))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points.astype(np.float32))]
    seen = []
    real = n.fit_windows

    def fit(classes, asked, splits, d, k):
        out = real(classes, asked, splits, d, k)
        seen.append((len(splits[0]) + 1, *out))
        return out

    monkeypatch.setattr(n, "fit_windows", fit)
    got = found(n.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), asked(), block_rows=128))
    blocks, orderings, width = seen[0]
    want = brute(rows)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert blocks >= 50 and orderings >= 2 and orderings * (2 * width + 1) < 0.6 * blocks and recall >= 0.9, (seen, recall)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (100, [0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as cid", "3 as query", "4 as n", "5 as h1", "6 as place")
    assert found(n.nearest(df, asked())) == {0: [1, 2, 50], 50: [0, 1, 2]}
    assert n.nearest(df.limit(0), asked()).count() == 0
    assert n.nearest(df.where("vec_id in (3, 4)"), asked()).count() == 0
    assert n.nearest(df.where("vec_id = 1"), asked()).count() == 0


def test_copies_and_ties(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(300)]
    got = found(n.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), asked()))
    assert got[0] == [2, 4, 6, 8, 10] and got[50] == [0, 2, 4, 6, 8]


def test_hilbert_steps_are_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(n.hilbert(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
