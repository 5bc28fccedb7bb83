"""The stored vector index against brute force, and the enrich flow with one commit, also beside another writer."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import enrich, store
from marlstone.operators.vectors import VectorIndex, path_digest
from marlstone.sources.manifest import Manifests


def cosines(rows, q, k):
    q = np.array(q)
    best = sorted((-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6), p) for p, v in rows)
    return [(p, -s) for s, p in best[:k]]


def test_searches_equal_brute_force_and_skip_cells(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 4)) * 3
    rows = [(f"p{i:04d}", [float(x) for x in centres[i % 6] + rng.standard_normal(4) * 0.2]) for i in range(400)]
    odd = [("null", None), ("short", [1.0]), ("zero", [0.0] * 4), ("nan", [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([(p, "a" if i % 2 else "b", v) for i, (p, v) in enumerate(rows + odd)], "path string, kind string, v array<double>")
    own = VectorIndex(spark, f"{tmp_path}/v")
    assert own.build(df, F.col("v"), 4) == 1
    for q in ([1.0, 0, 0, 0], rows[7][1], [-1.0, 2, 0.5, 3]):
        got = [(r["path"], r["score"]) for r in own.search(q, 5).collect()]
        want = cosines(rows, q, 5)
        assert [p for p, _ in got] == [p for p, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    kinds = [r["path"] for r in own.search(rows[7][1], 5, F.col("kind") == "a").collect()]
    assert kinds == [p for p, _ in cosines([r for i, r in enumerate(rows) if i % 2], rows[7][1], 5)]
    # clustered vectors: a query near a cluster leaves the others' directories alone
    held = own.bounds(rows[7][1])
    assert held[0][0] > 0.99 and sum(b >= 0.99 for b, _, _ in held) < len(held)
    assert own.search([0.0] * 4).collect() == []
    assert own.usable(df.select("path"), 4) and own.usable(df.union(df), 4) and not own.usable(df, 5) and not own.usable(df.where("path <> 'p0001'"), 4)
    assert path_digest(df) == path_digest(df.repartition(5).union(df))


def test_an_index_of_nothing(spark, tmp_path):
    own = VectorIndex(spark, f"{tmp_path}/v")
    none = spark.createDataFrame([], "path string, v array<double>")
    own.build(none, F.col("v"), 3)
    assert own.search([1.0, 0, 0]).collect() == [] and own.usable(none, 3)


ENTRY = "rel_path string, file_hash string, hash_algorithm string, size_bytes long, mtime double, ctime double, summary string, content_description string, category string, tags array<string>, md string"


def entry(path, content, md=None, summary="about"):
    return (path, content, "a", len(content), 1.0, 1.0, summary and f"{summary} {content}", None, "c", ["t"], md)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_enrich_flow(spark, tmp_path):
    m = Manifests(spark, f"{tmp_path}/m")
    first = entries(spark, entry("d/a", "A", "# T\ntext of a"), entry("d/b", "B", "# T\n"), entry("d/e/c", "C"), entry("d/silent", "S", summary=None))
    meta = spark.createDataFrame([("d", "all of d", "desc", ["x"])], "rel_path string, summary string, description string, tags array<string>")
    report = enrich.enriched(m, "s1", first, meta, deep=True)
    assert report == {"version": 1, "added": 3, "updated": 0, "moved": 0, "deleted": 0, "enriched": 0, "unchanged": 0, "deep": {"documents": (1, 1), "empty_doc": (1, 0), "skipped_no_md": (1, 0)}}
    ids = {r["rel_path"]: r["resource_id"] for r in m.table("resources").collect()}
    assert set(ids) == {"d/a", "d/b", "d/e/c"} and len(set(ids.values())) == 3
    assert {(r["rel_path"], r["summary"], r["file_count"]) for r in m.table("folders").collect()} == {("d", "all of d", 2), ("d/e", None, 1)}
    again = enrich.enriched(m, "s1", first, meta)
    assert again["unchanged"] == 3 and m.table("vectors").count() == 4

    # a is changed, b moved, c gone, n new
    report = enrich.enriched(m, "s1", entries(spark, entry("d/a", "A2"), entry("q/b", "B"), entry("n", "N")))
    assert [report[a] for a in enrich.ACTIONS] == [1, 1, 1, 1, 0, 0] and report["version"] == 3
    rows = {r["rel_path"]: r for r in m.table("resources").collect()}
    assert rows["d/a"]["resource_id"] == ids["d/a"] and rows["d/a"]["prev_hashes"] == ["A"] and rows["q/b"]["resource_id"] == ids["d/b"] and rows["q/b"]["prev_hashes"] == []
    texts = {(r["resource_id"], r["level"]): r["full_text"] for r in m.table("vectors").collect()}
    assert "A2" in texts[ids["d/a"], "summary"] and (ids["d/e/c"], "summary") not in texts and (ids["d/b"], "summary") in texts
    assert {r["rel_path"]: r["file_count"] for r in m.table("folders").collect()} == {"d": 1, "d/e": 0, "q": 1, "": 1}
    # a path that was left and is used again is another resource
    enrich.enriched(m, "s1", entries(spark, entry("d/a", "A2"), entry("q/b", "B"), entry("n", "N"), entry("d/b", "new B")))
    rows = {r["rel_path"]: r["resource_id"] for r in m.table("resources").collect()}
    assert rows["d/b"] not in (ids["d/b"], rows["q/b"])
    # the first version is still whole
    assert m.table("resources", 1).count() == 3 and m.table("vectors", 1).count() == 4


def test_two_sources_at_once(spark, tmp_path):
    """Both flows commit, each once, and neither loses the other's rows."""
    m = Manifests(spark, f"{tmp_path}/m")
    failed = []

    def run(source):
        try:
            enrich.enriched(Manifests(spark, f"{tmp_path}/m"), source, entries(spark, entry("d/a", source), entry("d/b", f"{source} b")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(s,)) for s in ("s1", "s2")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and m.versions() == [1, 2]
    rows = m.table("resources")
    assert {(r["source_id"], r["count"]) for r in rows.groupBy("source_id").count().collect()} == {("s1", 2), ("s2", 2)}
    assert m.table("vectors").join(rows, "resource_id").count() == 4 and m.table("folders").count() == 2


def test_snapshots_of_two_writers(spark, tmp_path):
    a, b = store.Snapshots(spark, f"{tmp_path}/s"), store.Snapshots(spark, f"{tmp_path}/s")
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    threads = [threading.Thread(target=s.write, args=(one(i),)) for i, s in enumerate((a, b))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert a.versions() == [1, 2] and sorted(a.read(v).first()["x"] for v in (1, 2)) == [0, 1]
