"""Row numbers over ranges against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import places, rank


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_numbered(spark, ranges):
    draw = random.Random(ranges)
    rows = [(i, draw.choice([None, 0.5, 0.5, 0.5, draw.random()])) for i in range(500)]
    got = places.numbered(spark.createDataFrame(rows, "id long, score double"), [F.desc("score"), F.col("id")], "place", ranges)
    plain = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted((r["place"], r["id"], r["score"]) for r in got.collect()) == [(n, *r) for n, r in enumerate(plain, 1)]
    assert got.columns == ["id", "score", "place"] and dict(got.dtypes)["place"] == "bigint"
    assert places.numbered(spark.createDataFrame([], "id long, score double"), [F.desc("score"), F.col("id")], "place", ranges).isEmpty()


def test_fusion_of_whole_lists(spark):
    one = spark.createDataFrame([(i, float(i % 5), f"p{i}") for i in range(60)], "id long, score double, path string")
    two = spark.createDataFrame([(i, -float(i)) for i in range(40, 90)], "id long, score double")
    few, many = (rank.fuse([one, two], "id", detail=("path",), whole=w) for w in (False, True))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert [tuple(r) for r in rank.fuse([one, two], "id", 3, whole=True).collect()] == [tuple(r) for r in rank.fuse([one, two], "id", 3).collect()]
