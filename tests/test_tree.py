"""The directory listing as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources import tree


@pytest.fixture()
def root(tmp_path):
    files = {"a.TXT": 3, "x/b.md": 5, "x/.index/index.json": 7, "x/y/z/deep.txt": 11, "xx/c.txt": 0, "w/.hidden": 2, "w/no_ext": 1, "w/多.md": 4}
    for name, n in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"q" * n)
        os.utime(tmp_path / name, (n, 100 + n))
    (tmp_path / "empty").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.TXT")
    return tmp_path, files


def names(rows, root):
    return sorted(os.path.relpath(r["path"], root) for r in rows.select("path").collect())


@pytest.mark.parametrize("subtrees", [1, 2, 3, 256])
def test_every_file_once(spark, root, monkeypatch, subtrees):
    """However the tree is split."""
    folder, files = root
    monkeypatch.setattr(tree, "SUBTREES", subtrees)
    reader = tree.TreeReader({"path": str(folder), "content": "true"})
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted((os.path.relpath(r["path"], folder), r["size_bytes"], r["mtime"], len(r["content"])) for r in rows) == sorted((k, n, 100.0 + n, n) for k, n in files.items())
    assert all(r["ext"] == r["ext"].lower() for r in rows) and {r["ext"] for r in rows if r["name"] in ("a.TXT", ".hidden", "no_ext")} == {".txt", ""}


def test_in_spark_with_bounds(spark, root):
    folder, files = root
    rows = tree.tree(spark, str(folder))
    assert names(rows, folder) == sorted(files) and rows.where("content is not null").isEmpty()
    assert names(rows.where(F.col("ext") == ".txt"), folder) == ["a.TXT", "x/y/z/deep.txt", "xx/c.txt"]
    assert names(rows.where((F.col("size_bytes") > 10) | (F.col("name") == "c.txt")), folder) == ["x/y/z/deep.txt", "xx/c.txt"]
    few = tree.tree(spark, str(folder), begins=f"{folder}/x")
    assert names(few, folder) == ["x/.index/index.json", "x/b.md", "x/y/z/deep.txt", "xx/c.txt"]
    assert names(tree.tree(spark, str(folder), ends=".md", least=3, most=4), folder) == ["w/多.md"]
    both = rows.where("size_bytes > 6").union(few.where("size_bytes = 0"))
    assert names(both, folder) == ["x/.index/index.json", "x/y/z/deep.txt", "xx/c.txt"]
    asked = tree.tree(spark, str(folder), content=True, ends="/index.json").select(F.decode("content", "utf-8").alias("t")).collect()
    assert [r["t"] for r in asked] == ["q" * 7]
    assert tree.tree(spark, str(folder / "empty")).isEmpty() and tree.tree(spark, str(folder / "missing")).isEmpty()


def test_a_wanted_beginning_prunes_directories(root, monkeypatch):
    folder, _ = root
    reader = tree.TreeReader({"path": str(folder), "begins": f"{folder}/x/y"})
    seen = []
    whole = tree._entries
    monkeypatch.setattr(tree, "_entries", lambda d: seen.append(os.path.relpath(d, folder)) or whole(d))
    found = [r["name"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert found == ["deep.txt"] and set(seen) == {".", "x", "x/y", "x/y/z"}
