"""The automaton of many pieces against a plain search, and ranks of chunks against plain cosines."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as ft
from marlstone.operators import anchors, answer, chunks, rank
from marlstone.plans import inventory


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_occurrences_equal_plain_search(spark, most):
    """Pieces in each other, overlapping, of any letters, null and empty; one automaton and several."""
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abé漢🙂 ") for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["", None, "ab", "ab", "nowhere"]
    texts = [(i, f"k{i % 3}", None if i % 9 == 0 else "".join(rng.choice("abé漢🙂 ") for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(5, "k2", "ab")]
    df = spark.createDataFrame(texts, "id int, kind string, text string")
    got = sorted((r["id"], r["kind"], r["piece"]) for r in anchors.occurrences(df, spark.createDataFrame([(p,) for p in pieces], "piece string"), most=most).collect())
    assert got == sorted((i, k, p) for i, k, t in texts for p in {p for p in pieces if p} if t and p in t)


def test_no_pieces(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    none = anchors.occurrences(df, spark.createDataFrame([("",)], "piece string"))
    assert none.columns == ["id", "piece"] and none.collect() == []


def test_holders(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "concatenate"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "cat"), (8, "cat"), (9, "cat sat"), (10, None), (11, "")], "query_id long, want string")
    assert sorted(map(tuple, answer.holders(items, docs).collect())) == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (11, 1), (11, 2), (11, 4)]


def test_chunk_ranks_equal_cosines(spark):
    rng = np.random.default_rng(4)
    rows = [(c, i, [float(x) for x in rng.integers(-2, 3, 6)]) for c in "ab" for i in range(30)] + [("a", 99, None)]
    rows = [(c, i, v if v is None or any(v) else None) for c, i, v in rows]
    asked = [(q, [float(x) for x in rng.integers(1, 4, 6)]) for q in range(5)] + [(9, None)]
    df = spark.createDataFrame(rows, "config string, chunk_id long, embedding array<double>").repartition(3)
    got = {(r["config"], r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in answer.chunk_ranks(df, spark.createDataFrame(asked, "query_id int, embedding array<double>"), 4).collect()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for c in "ab":
        for q, v in asked[:-1]:
            best = sorted(((-cos(v, e), i) for k, i, e in rows if k == c and e is not None))[:4]
            assert [got[c, q, r + 1] for r in range(4)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]
    assert len(got) == 2 * 5 * 4


def test_settings_by_table_function(spark):
    pages = spark.createDataFrame([(1, "# A\n" + "word and more. " * 60), (2, None), (3, "")], "page_id long, md string")
    got = chunks.chunks_by_setting(pages, [("x", 200, 0.1), ("y", 5000, 0.0)]).collect()
    for config, limit, overlap in (("x", 200, 0.1), ("y", 5000, 0.0)):
        own = sorted((r["seq"], r["breadcrumb"], r["chunk"]) for r in got if r["config"] == config)
        assert own == chunks.chunk_markdown(pages.first()["md"], limit, overlap)


def test_hashed_embedding(spark):
    row = spark.sql("select array('a', 'b', 'a') as t, cast(array() as array<string>) as none")
    e = row.select(rank.hashed_embedding(F.col("t"), 8).alias("e"), rank.hashed_embedding(F.col("none"), 8).alias("n")).first()
    assert e["n"] is None and sum(abs(x) for x in e["e"]) in (1.0, 3.0)


def test_questions_in_parts(spark, monkeypatch):
    """More questions than go to the tasks at once are ranked as well, with the same result; ties go to the smaller chunk."""
    rng = np.random.default_rng(5)
    rows = [(c, i, [float(x) for x in rng.integers(1, 3, 4)]) for c in "ab" for i in range(200)]
    asked = [(q, [float(x) for x in rng.integers(1, 4, 4)]) for q in range(23)]
    df = spark.createDataFrame(rows, "config string, chunk_id long, embedding array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    ranks = lambda: sorted((r["config"], r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in answer.chunk_ranks(df, questions, 3).collect())
    want = ranks()
    monkeypatch.setattr(answer, "MOST_QUESTIONS", 4)
    for name, n in (("BLOCK", 32), ("WIDE", 3)):
        monkeypatch.setattr(rank, name, n)
    assert len(want) == 2 * 23 * 3 and ranks() == want
    for c, q, r, i, _ in want:
        dot = [(-round(float(np.dot(v, asked[q][1]) / (np.linalg.norm(v) * np.linalg.norm(asked[q][1]))), 6), k) for g, k, v in rows if g == c]
        assert sorted(dot)[r - 1][1] == i


def test_equal_anchors_are_joined_once(spark):
    """Many questions of one anchor don't multiply the chunks that hold it: its first chunk is known before the join."""
    made = spark.createDataFrame([("a", i, "the word") for i in range(20)] + [("b", 7, "a word")], "config string, chunk_id long, chunk string")
    asked = spark.createDataFrame([(q, "word") for q in range(30)] + [(99, "none")], "query_id long, anchor string")
    df = answer.first_anchors(asked, made)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join ") < plan.index("Aggregate [config")
    assert sorted(map(tuple, df.collect())) == sorted([("a", q, 0) for q in range(30)] + [("b", q, 7) for q in range(30)])


def test_chunks_of_few_pages_at_once(spark, monkeypatch):
    """What a task holds is bounded by characters, not by the rows of a batch."""
    texts = [None, "", *("# A\n" + f"word {i} and more. " * (i * 7) for i in range(30))]
    monkeypatch.setattr(chunks, "MOST_HELD", 500)
    got = chunks.chunks(spark.createDataFrame(list(enumerate(texts)), "page_id long, md string"), limit=300).collect()
    want = [(i, *c) for i, md in enumerate(texts) for c in chunks.chunk_markdown(md or "", 300)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_hashed_embeddings_of_a_table(spark):
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    want = {r["id"]: r["e"] for r in df.select("id", rank.hashed_embedding(tokens, 8).alias("e")).collect()}
    assert {r["id"]: r["embedding"] for r in rank.hashed_embeddings(df, ["id"], tokens, 8).collect()} == want


@pytest.mark.parametrize(("parts", "block"), [(1 << 17, 2048), (7, 16)])
def test_anchor_ranks_equal_ranks_of_all(spark, monkeypatch, parts, block):
    """The places of anchors, by counts, are those in the whole order: with ties, without vectors, with equal questions, in blocks and parts."""
    rng = np.random.default_rng(6)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 3)]
    rows = [(c, i, v if any(v) else None) for c in "abc" for i in range(300) for v in [vector()]]
    asked = [(q, v if any(v) else None) for q in range(60) for v in [vector()]]
    asked += [(q + 100, v) for q, v in asked[:20]]
    df = spark.createDataFrame(rows, "config string, chunk_id long, embedding array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    whole = [tuple(r) for r in answer.chunk_ranks(df, questions, 400).select("config", "query_id", "chunk_id", "rank").collect()]
    near = {(c, q): i for c, q, i, r in whole if r == q % 9 + 1}
    own = [(c, q, near.get((c, q), q)) for c in "ab" for q, _ in asked]
    for name, n in (("MOST_TARGETS", parts), ("MOST_CANDIDATES", block)):
        monkeypatch.setattr(answer, name, n)
    monkeypatch.setattr(rank, "BLOCK", block)
    got = answer.anchor_ranks(spark.createDataFrame(own, "config string, query_id int, chunk_id long"), df, questions, 5).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in whole if x[:3] in own and x[3] <= 5) and len(got) > 50


def test_questions_are_left_once_decided():
    """Most chunks are never scored for a question whose anchor is far from it."""
    rows = {"config": ["a"] * 2, "chunk_id": [500_000, 500_000], "asked": [[1.0, 0.0], [0.0, 1.0]], "embedding": [[1.0, 9.0]] * 2, "target": [0, 1]}
    own = answer._Targets(answer.pa.table(rows), 5)
    own.add(np.arange(10_000), np.array([[1.0, 1.0]] * 10_000))
    assert own.n.tolist() == [64, 0] and own.open.tolist() == [1]


def test_sweep_reads_no_pages_again(spark):
    """Chunks, embeddings and questions are stored, and ranks, anchors and counts read them: no page is cut again for each."""
    files = inventory.chunk_sweep(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "pages" in Path(f).parent.name + Path(f).name]


@pytest.mark.parametrize("most", [1 << 20, 30])
@pytest.mark.parametrize("rising", [True, False])
def test_first_holders_equal_least_of_all(spark, monkeypatch, most, rising):
    """Left-out pieces change nothing, whatever the order of ids, for groups that come late, null ids and null texts."""
    monkeypatch.setattr(anchors, "LEFT_OUT", (5, 20, 60))
    rng = random.Random(3)
    pieces = spark.createDataFrame([("".join(rng.choice("ab ") for _ in range(rng.randrange(0, 5))),) for _ in range(40)] + [(None,)], "piece string")
    rows = [("abc"[i % (2 + i // 70)], i, "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 9)))) for i in range(140)] + [("a", None, "ab"), ("d", None, "b"), ("b", 3, None)]
    if not rising:
        rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, id long, text string").coalesce(1)
    monkeypatch.setattr(anchors, "spread", lambda x: x)
    got = sorted(map(str, anchors.first_holders(df, pieces, "text", "piece", "kind", "id", most).collect()))
    assert got == sorted(map(str, anchors.occurrences(df, pieces, most=most).groupBy("kind", "piece").agg(F.min("id").alias("id")).collect()))
    machine = anchors._First(["ab", "b"])
    for i in range(100):
        machine.add("a", i, "ab")
    assert machine.least == {"a": {0: 0, 1: 0}} and [m is None for m, _ in machine.machines] == [False, True, True, True]


def test_tokens_of_arrays(spark):
    """Tokens cut out of bytes equal Spark's, also beside CJK, letters that become ASCII in lower case, empty and null rows."""
    rng = random.Random(4)
    texts = [None, "", " ", "İx", "2K_a", *("".join(rng.choice("aZk_9 é漢字—\u212aİß.℃🙂") for _ in range(rng.randrange(0, 12))) for _ in range(400)), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    want = {r["id"]: sorted(r["t"] or []) for r in df.select("id", ft.search_tokens(F.col("text")).alias("t")).collect()}
    for part in (ft.pa.array(texts), ft.pa.array(texts)[7:90], ft.pa.array(["", None])):
        row, tokens = ft.token_arrays(part)
        first = 7 if len(part) == 83 else 0
        for i in range(len(part)):
            assert sorted(t for r, t in zip(row, tokens.to_pylist(), strict=True) if r == i) == (want[first + i] if len(part) > 2 else [])
    vectors = [{r["id"]: r["embedding"] for r in x.collect()} for x in (rank.text_embeddings(df, ["id"], "text", 8), rank.hashed_embeddings(df, ["id"], ft.search_tokens(F.col("text")), 8))]
    assert vectors[0] == vectors[1]
