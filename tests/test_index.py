"""The stored inverted index against ranking over the corpus, cover density against a plain search for covers, and manifests under two writers."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from marlstone.operators import index, rank
from marlstone.sources.manifest import Conflict, Manifests

WORDS = [f"w{i}" for i in range(30)] + ["月租金", "多少", "Über", "İl"]


def texts(rng, ids):
    return [(i, None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def best(df):
    return sorted((r["query_id"], -r["score"], r["doc_id"]) for r in df.collect())


def test_index_ranks_as_the_corpus_after_changes(spark, tmp_path, monkeypatch):
    """Upserts, deletions, null texts, and segments that are made into one."""
    monkeypatch.setattr(index, "MOST_SEGMENTS", 2)
    rng = random.Random(1)
    own = index.InvertedIndex(spark, f"{tmp_path}/i")
    now = dict(texts(rng, range(60)))
    own.upsert(frame(spark, list(now.items())))
    queries = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["月租", "金"]), (3, ["none"]), (4, ["w3", "w3", "w29"])], "query_id int, terms array<string>")
    for step in range(3):
        gone = [step, 50 - step, 999]
        fresh = dict(texts(rng, rng.sample(range(80), 12)))
        fresh = {k: v for k, v in fresh.items() if k not in gone}
        now = {k: v for k, v in now.items() if k not in gone} | fresh
        assert own.upsert(frame(spark, list(fresh.items())), spark.createDataFrame([(g,) for g in gone], "doc_id long")) == step + 2
    corpus = frame(spark, list(now.items()))
    assert best(own.bm25(queries, 5)) == best(rank.bm25(corpus, queries, 5))
    kept = F.col("doc_id") % 2 == 0
    assert best(own.bm25(queries, 5, keep=corpus.where(kept))) == best(rank.bm25(corpus, queries, 5, keep=kept))
    monkeypatch.setattr(index, "MOST_TERMS", 1)  # too many terms to look up
    assert best(own.bm25(queries, 5)) == best(rank.bm25(corpus, queries, 5))
    count = {r["term"]: r["df"] for r in own.frequencies().collect()}
    assert count == {r["term"]: r["df"] for r in rank.document_frequencies(corpus).collect()}
    stats = own.statistics().first()
    assert stats["n"] == len(now) and stats["avgdl"] == pytest.approx(rank.corpus_stats(corpus).first()["avgdl"])
    assert len(own.manifests.manifest(own.manifests.latest())["notes"]["segments"]) <= 2
    # an older version still answers
    assert own.documents(1).count() == 60
    own.upsert(None, corpus.select("doc_id"))
    assert own.documents().count() == 0 and own.bm25(queries).collect() == []


def test_a_search_opens_the_files_of_its_terms_only(spark, tmp_path):
    rows = frame(spark, [(i, " ".join(f"{c}{i % 7}" for c in "abcdefghijklmnop")) for i in range(300)])
    own = index.InvertedIndex(spark, f"{tmp_path}/i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small for more than one file
    try:
        own.upsert(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every, some = own.files(), own.files(terms=["c3"])
    assert 0 < len(some) < len(every)
    read = own.postings(["c3"])
    assert read.count() == rows.where("doc_id % 7 = 3").count()
    assert {f.rsplit("/", 1)[-1] for f in read.inputFiles() if "postings" in f} == {f.rsplit("/", 1)[-1] for f in some}
    assert own.postings(["nothing"]).count() == 0


def covers(places, groups):
    """Cover density by looking for each cover forwards, then back."""
    total, start = 0.0, 0
    while True:
        seen, end = set(), None
        for e in range(start, len(places)):
            seen.add(places[e][1])
            if len(seen) == groups:
                end = e
                break
        if end is None:
            return total
        seen, begin = set(), end
        for b in range(end, start - 1, -1):
            seen.add(places[b][1])
            if len(seen) == groups:
                begin = b
                break
        total += 0.1 / (1 + (places[end][0] - places[begin][0]) - (end - begin))
        start = begin + 1


@pytest.mark.parametrize("groups", [1, 2, 3])
def test_cover_density(spark, groups):
    rng = random.Random(groups)
    rows = [(i, [(p, rng.randrange(groups)) for p in sorted(rng.sample(range(60), rng.randrange(0, 20)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, places array<struct<pos:int,g:int>>")
    got = {r["i"]: r["s"] for r in df.select("i", rank.cover_density(F.col("places"), groups).alias("s")).collect()}
    for i, places in rows:
        assert got[i] == pytest.approx(covers(places, groups)), places


def test_keyword_channel(spark, tmp_path):
    docs = frame(spark, [(1, "The rent, and the RENT."), (2, "rent far away from the"), (3, "月租金 多少 的"), (4, None), (5, ""), (6, "the-rent")])
    score = lambda df: {r["doc_id"]: round(r["score"], 6) for r in df.collect()}
    assert score(rank.keyword_top(docs, "the rent")) == {1: 0.4, 2: 0.2, 6: 0.2}
    # all terms: the stretches "the rent", "rent and the", "the rent"; "rent far away from the"; "the rent"
    assert score(rank.keyword_top(docs, "the rent", every=True)) == {1: round(0.1 + 0.05 + 0.1, 6), 2: 0.025, 6: 0.1}
    assert score(rank.keyword_top(docs, "月租金")) == {3: 0.2}
    assert score(rank.keyword_top(docs, " a !")) == {}
    own = index.keyword_index(spark, f"{tmp_path}/k")
    own.upsert(docs)
    for query, every in (("the rent", False), ("the rent", True), ("月租金", False), ("", True)):
        assert score(own.keywords(query, every=every)) == score(rank.keyword_top(docs, query, every=every))


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = Manifests(spark, f"{tmp_path}/m"), Manifests(spark, f"{tmp_path}/m")
    one = lambda x: spark.createDataFrame([(x,)], "x string")
    assert a.latest() == 0 and a.commit(0, {"r": a.stage("r", one("r1")), "v": a.stage("v", one("v1"))}) == 1
    base = a.latest()
    assert b.commit(base, {"v": b.stage("v", one("v2"))}, {"by": "b"}) == 2
    with pytest.raises(Conflict):
        a.commit(base, {"r": a.stage("r", one("lost"))})
    # with retry, both changes are there, and a version is seen whole
    assert a.update(lambda v: ({"r": one(f"r after {v}")}, {"by": "a"})) == 3
    assert [a.table(n).first()["x"] for n in "rv"] == ["r after 2", "v2"] and [a.table(n, 1).first()["x"] for n in "rv"] == ["r1", "v1"]
    assert a.manifest(3)["notes"] == {"by": "a"} and a.versions() == [1, 2, 3]


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    m = Manifests(spark, f"{tmp_path}/m")
    m.commit(0, {"log": m.stage("log", spark.createDataFrame([("start",)], "who string"))})

    def add(who):
        own = Manifests(spark, f"{tmp_path}/m")
        own.update(lambda v: ({"log": own.table("log", v).union(spark.createDataFrame([(who,)], "who string"))}, {}), tries=20)

    threads = [threading.Thread(target=add, args=(f"t{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["who"] for r in m.table("log").collect()) == ["start", "t0", "t1", "t2"]


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_pairs_of_documents_and_queries_are_no_rows(spark, tmp_path, monkeypatch, most):
    """Every query has a word of every document, but a task hands on the best of each query alone; small blocks and parts find the same."""
    rng = random.Random(3)
    rows = [(i, "same " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30)))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    corpus, asked = frame(spark, rows), [(q, ["same", *rng.sample(WORDS, 3)]) for q in range(60)]
    queries = spark.createDataFrame(asked, "query_id int, terms array<string>")
    for name, n in (("BLOCK", 64), ("WIDE", 7), ("DENSE", 5), ("MOST_PAIRS", most)):
        monkeypatch.setattr(rank, name, n, raising=False)
    handed, last = [], rank.top_in_group
    monkeypatch.setattr(rank, "top_in_group", lambda scores, *a: (handed.append(scores), last(scores, *a))[1])
    got = best(rank.bm25(corpus, queries, 3))
    assert handed[0].count() <= 3 * len(asked) * handed[0].rdd.getNumPartitions() < len(rows) * len(asked)
    tokens = {r["doc_id"]: r["t"] for r in corpus.select("doc_id", rank.search_tokens(F.col("text")).alias("t")).collect()}
    avg, df = sum(map(len, tokens.values())) / len(tokens), {}
    for t in tokens.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    want = []
    for q, terms in asked:
        score = lambda t: round(sum(math.log(1 + (len(tokens) - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x in terms if x in t), 6)
        want += sorted((-score(t), i) for i, t in tokens.items())[:3]
    assert [(s, i) for _, s, i in got] == [(pytest.approx(s, abs=2e-6), i) for s, i in want]
    own = index.InvertedIndex(spark, f"{tmp_path}/i")
    own.upsert(corpus)
    assert best(own.bm25(queries, 3)) == got


def test_each_text_is_tokenised_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return None if text is None else text.split()

    rows = [(i, None if i % 7 == 0 else "a b " * i) for i in range(50)]
    own = index.InvertedIndex(spark, f"{tmp_path}/i", cut)
    own.upsert(frame(spark, rows))
    assert seen.value == len(rows)
    assert {r["doc_id"]: r["dl"] for r in own.documents().collect()} == {i: None if t is None else len(t.split()) for i, t in rows}
    got = sorted((r["term"], r["doc_id"], r["tf"], r["positions"]) for r in own.postings().collect())
    assert got == sorted((t, i, x.split().count(t), [p for p, w in enumerate(x.split()) if w == t]) for i, x in rows if x for t in "ab")
