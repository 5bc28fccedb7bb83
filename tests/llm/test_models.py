"""The quality classifier, the toxicity classifier and decontamination."""

import numpy as np
import xxhash
from cases import LONG, TEXTS, documents, labels, nothing, table
from pyspark.sql import functions as F

from marlstone.llm import decontaminate as d
from marlstone.llm import quality as q
from marlstone.llm import toxicity as t

FOLDER = "/root/testdata/sf0.01"


def test_log_ratios_equal_plain_counts(spark):
    docs, given = table(spark, "documents"), table(spark, "labels")
    target = {r["doc_id"] for r in q.drawn(given, 1, False, 100).collect()}
    raw, aim = np.zeros(q.BUCKETS), np.zeros(q.BUCKETS)
    for r in docs.select("doc_id", "text").collect():
        counts = np.bincount(q.gram_buckets(r["text"] or ""), minlength=q.BUCKETS)
        raw += counts
        aim += counts * (r["doc_id"] in target)
    p = (raw + 1) / (raw.sum() + q.BUCKETS)
    want = np.log((aim + q.BUCKETS / 50 * p) / (aim.sum() + q.BUCKETS / 50) / p)
    np.testing.assert_allclose(q.fit(docs, given, 100).ratio, want)


def test_quality_on_labels(spark):
    docs, given = table(spark, "documents", FOLDER), table(spark, "labels", FOLDER)
    kept = q.resample(docs, given).select("doc_id").distinct().withColumn("kept", F.lit(1))
    share = {r["quality"]: r["s"] for r in given.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.3, share


def test_kth_largest(spark):
    keys = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("sample_key"))
    every = sorted((r[0] for r in keys.collect()), reverse=True)
    assert all(q.kth_largest(keys, k, bins=64) == every[k - 1] for k in (1, 2, 777, 19_999))
    assert q.kth_largest(keys, 20_000) == float("-inf")


def test_quality_awkward_rows(spark):
    docs = documents(spark)
    given = labels(spark, [(3, 1, 0), (None, 1, 1), (5, 0, None), (6, None, 0)])
    assert q.resample(docs, labels(spark)).count() == docs.count()  # nothing to go by: nothing is rejected
    kept = q.resample(docs, given)
    assert kept.columns == [*docs.columns, "_log_weight", "_sample_key"]
    assert {(r["log_weight"], r["sample_key"]) for r in kept.collect()} <= {("x", "x")}  # the caller's columns stay
    assert q.resample(nothing(spark), given).count() == 0


def test_top_k_equals_a_sorted_list(spark):
    """Sums of log ratios with Gumbel noise, computed plainly: the k largest are taken, and the k of the cut without one."""
    docs, given = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    keys, weights, least = q.sampled_keys(docs, given)
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", q.gumbel().alias("g")).collect()}
    want = {}
    for r in docs.collect():
        tokens = [xxhash.xxh3_64_intdigest(t.encode()) for t in q._TOKEN.findall(r["text"] or "")]
        grams = [(a * 0x165667B19E3779F9) % 2**64 >> 48 for a in ((x * 0x9E3779B97F4A7C15 ^ y * 0xC2B2AE3D27D4EB4F) % 2**64 for x, y in zip(tokens, tokens[1:]))]
        log_weight = sum(weights.ratio[x >> 48] for x in tokens) + sum(weights.ratio[x] for x in grams)
        want[r["doc_id"]] = (log_weight, log_weight + noise[r["doc_id"]])
    got = {r["doc_id"]: (r["log_weight"], r["sample_key"]) for r in keys.collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-6 for i in got for x, y in zip(got[i], want[i], strict=True))
    k = sum(w >= weights.cut for w, _ in want.values())
    order = sorted(want, key=lambda i: -want[i][1])
    assert {i for i, (_, key) in got.items() if key >= least} == set(order[:k]) and 0 < k < len(order)
    assert {r["doc_id"] for r in q.resample(docs, given, k=17).collect()} == set(order[:17])


def test_toxicity_held_out(spark):
    """At sf0.1: sf0.01 has only six toxic documents in the held-out fold."""
    folder = "/root/testdata/sf0.1"
    scored = t.toxicity(table(spark, "documents", folder), table(spark, "labels", folder)).where("held_out")
    rows = scored.join(table(spark, "labels", folder), "doc_id").select("toxic", "predicted").collect()
    found = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    assert found >= 0.9 and wrong <= 0.01, (found, wrong)


def test_toxicity_awkward_rows(spark):
    docs = documents(spark)
    for given in (labels(spark), labels(spark, [(i, 1, i % 2) for i in range(10)] + [(None, 1, 1), (3, 1, None)])):
        got = t.toxicity(docs, given).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None) and all(r["held_out"] is not None for r in got)
    assert t.toxicity(nothing(spark), labels(spark)).count() == 0


def exhaustive(index, text):
    """All segments scored against all passages, then the same verification."""
    ids = [index.vocabulary.get(w) for w in d.words_of(text)]
    best = {}
    for p in range(0, len(ids), d.SEGMENT):
        terms = {x for x in ids[p : p + 2 * d.SEGMENT] if x is not None}
        score = {}
        for x in terms:
            for s, share in index.postings[x]:
                score[s] = score.get(s, 0.0) + share
        for s, v in score.items():
            if v >= d.THRESHOLD - 1e-9:
                best[index.segment_item[s]] = max(best.get(index.segment_item[s], 0), v)
    words = d.words_of(text)
    have = {k: d.grams(words, k) for k in range(1, d.NGRAM + 1)}
    return sorted(index.items[n][0] for n in best if all(d.coverage(p, have) >= d.OVERLAP for p in index.parts[n]))


def test_wand_equals_exhaustive_scores(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", FOLDER).collect()]
    index = d.Index(items)
    texts = [r["text"] for r in table(spark, "documents", FOLDER).orderBy("doc_id").limit(300).collect()]
    texts += [f"{LONG[:5000]} {text.upper()} {LONG[:900]}" for _, text in items]
    found = [sorted(x[0] for x in row) for row in index.search([d.words_of(x) for x in texts])]
    assert found == [exhaustive(index, x) for x in texts]
    assert all(item in row for (item, _), row in zip(items, found[300:], strict=True))


def test_index_in_blocks_finds_the_same(spark):
    """Scores and items don't depend on how many blocks the benchmark is dealt into, and equal one index built in place."""
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    rows = lambda df: {r["doc_id"]: [tuple(x) for x in r["leaks"]] for r in df.collect()}
    one, many = rows(d.with_leaks(docs, items)), rows(d.with_leaks(docs, items, 7))
    assert d.index_blocks(items, 7).count() > 3 and any(one.values()) and one == many
    index = d.Index(sorted((r["item_id"], r["text"]) for r in items.collect()))
    texts = docs.orderBy("doc_id").collect()
    plain = index.search([d.words_of(r["text"] or "") for r in texts])
    assert {r["doc_id"]: sorted(x) for r, x in zip(texts, plain, strict=True)} == one


def test_decontamination_awkward_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, TEXTS[5]), (3, TEXTS[5]), (4, "zz ?")], "item_id long, text string").withColumn("leaks", F.lit(1))
    got = d.with_leaks(docs, items)
    assert got.count() == docs.count() and {r["leaks"] for r in got.collect()} == {"x"}  # the caller's column stays
    assert {r["doc_id"] for r in got.where(F.size("_leaks") > 0).collect()} == {5, 6}
    assert d.with_leaks(docs, items.limit(0)).where(F.size("_leaks") > 0).count() == 0
    assert d.with_leaks(nothing(spark), items).count() == 0
