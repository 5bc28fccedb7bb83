"""Whitening against a dense eigensolver, the Merkle manifest against a plain tree, the rule ledger against plain counts."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import TEXTS, documents, nothing, table
from pyspark.sql import functions as F

from marlstone.llm import merkle, rules, whitening

SF001 = "/root/testdata/sf0.01"


# --- op11


def grid(rows):
    return {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}


def check_whitening(out, rows, most=16):
    x = grid(rows)
    fits = np.array([list(t) for t in sorted({tuple(v) for v in x.values()})], np.int64)
    n, sums = len(fits), fits.sum(axis=0)
    z = fits - sums / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-11 * np.abs(v).sum(axis=1).max()).sum()))
    assert len(out) == len(rows) * k
    got = {(r["vec_id"], r["component"]): r for r in out}
    ids = sorted(x)
    for c in range(1, k + 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        want = np.array([(np.array(x[i]) - sums / n) @ u[:, c - 1] / np.sqrt(e[c - 1]) for i in ids])
        assert np.allclose(mine, want, atol=1e-7) or np.allclose(mine, -want, atol=1e-7)
        assert abs(got[ids[0], c]["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9
    for i in ids:
        r = got[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9


def test_whitening_equals_eigh(spark):
    rows = table(spark, "embeddings", SF001)
    vectors = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    check_whitening(whitening.op11_whitening(spark, SF001).collect(), vectors)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    base = [[float(c) for c in rng.standard_normal(6) * [3, 2, 1, 0.5, 0.3, 0]] for _ in range(40)]
    good = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(60)]  # a third and more of the rows are one vector
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (906, [1e30] * 6)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "v": F.lit(1), "x": F.lit(2), "component": F.lit(3)})
    out = whitening.whitened(df).collect()
    assert max(r["component"] for r in out) == 5  # one dimension is constant
    check_whitening(out, good)
    again = whitening.whitened(df.unionByName(df.where("vec_id = 3")).unionByName(df.where("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long"))), most=2).where("vec_id = 3 or vec_id is null").collect()
    assert len(again) == 6 and len({round(r["whitened"], 9) for r in again}) == 2
    assert whitening.whitened(df.where("vec_id >= 100 and vec_id < 900")).collect() == []  # equal vectors have no variance
    assert whitening.whitened(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whitened(spark.createDataFrame([(1, [1e12]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("values", [np.exp(-np.arange(40.0)), np.r_[np.full(10, 5.0), np.full(30, 1.0)], np.ones(20), np.r_[1 + 1e-9 * np.arange(20), np.full(20, 0.5)], np.arange(30.0), np.zeros(4)])
def test_contour_integration_finds_every_eigenvalue(values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.principal(v)
    want = np.sort(values)[::-1]
    want = want[want > 1e-11 * max(np.abs(v).sum(axis=1).max(), 1e-300)][:16]
    assert len(e) == len(want) and np.allclose(e, want, atol=1e-13 * max(1, values.max()), rtol=1e-12)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-13)
    assert np.abs(v @ u - u * e).max(initial=0) < 1e-13 * max(1, values.max())


def test_inertia_and_exact_products():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17):
        m = rng.standard_normal((n, n))
        assert whitening.inertia(m + m.T) == (np.linalg.eigvalsh(m + m.T) < 0).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    z = rng.integers(-(10**11), 10**11, (50, 3))
    for part in (z, z // 10**9, z * 0):
        wide = part.astype(object)
        assert (whitening.gram(part) == wide.T @ wide).all()


# --- op12


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def climb(nodes):
    """The root of a list of nodes, and for each the sibling runs on its way (own place, the others)."""
    at, ways, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            ways[i].append((p % 3, run[: p % 3] + run[p % 3 + 1 :]))
            at[i] = p // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], ways


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, upper = climb([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper, strict=True):
        for x, way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            r, path = x[3], way + up
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "")) if changed else x[2]
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            out.append((r["doc_id"], x[2], trees[s][0], root, h(*(o for _, others in path for o in others)), node, node == root))
    return sorted(out, key=str)


def got_manifest(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_equals_plain_tree(spark):
    rows = [r.asDict() for r in table(spark, "documents", SF001).collect()]
    out = got_manifest(merkle.op12_merkle(spark, SF001))
    assert out == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in out) < len(out)


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_over_many_layers_of_superblocks(spark, height):
    rows = [(i, f"line {i}\nnext", None, None if i < 3 else "hot" if i < 90 else f"s{i}" if i < 130 else "z", None) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got_manifest(merkle.manifest(merkle.tampered_rows(df), height)) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_awkward_rows(spark, tmp_path):
    df = documents(spark)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert got_manifest(merkle.op12_merkle(spark, f"{tmp_path}/a")) == plain_manifest([r.asDict() for r in df.collect()])
    df.limit(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert got_manifest(merkle.op12_merkle(spark, f"{tmp_path}/b")) == plain_manifest([r.asDict() for r in df.limit(1).collect()])
    nothing(spark).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert merkle.op12_merkle(spark, f"{tmp_path}/c").collect() == []


def test_manifest_matches_sql(tmp_path, spark):
    """The SQL against the plain tree, on a table and on awkward rows."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for place in (f"{SF001}/documents.parquet", f"{tmp_path}/documents.parquet/*.parquet"):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{place}'")
        rel = con.sql("select * from documents")
        rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
        assert sorted(con.sql(merkle.SQL).fetchall(), key=str) == plain_manifest(rows)


def test_paths_survive_packing():
    levels = merkle.tree([h(str(i)) for i in range(8)], 8, 7)
    for i in range(8):
        path = merkle.inner_path(levels, i)
        assert merkle.unpacked(merkle.packed(path)) == path and merkle.fold(levels[0][i], path) == levels[-1][0]


# --- op13


def plain_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_measures_equal_plain_counts(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, "documents", SF001).collect()}
    for i, t in [*rows.items(), *((-i - 1, t) for i, t in enumerate(TEXTS)), (-90, "a b c a b c a"), (-91, "x x x x"), (-92, "q r s t\n \n \n \n")]:
        assert rules.measured(t or "")[:5] == plain_measures(t), i
    out = {r["doc_id"]: r for r in rules.op13_rules(spark, SF001).collect()}
    assert set(out) == set(rows)
    for i, t in rows.items():
        words, chars, symbols, lines, repeats = plain_measures(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, lines, repeats)
        assert r["base_failed"] == (words < 50 or 100 * repeats > 50 * words)
        assert not (r["base_failed"] and r["kept"])


def test_windows_of_very_many_kinds_of_words():
    codes = np.array([1, 2, 3, 9, 1, 2, 3, 4])
    assert rules.repeated(codes, 10) == rules.repeated(codes, 1 << 22) == 6


def test_rules_by_labels(spark):
    """Good documents stay unless the base rules drop them; bad ones go."""
    out = rules.op13_rules(spark, "/root/testdata/sf0.1").join(table(spark, "labels", "/root/testdata/sf0.1").drop("toxic"), "doc_id")
    n = {(r["quality"], r["kept"], r["base_failed"]): r["count"] for r in out.groupBy("quality", "kept", "base_failed").count().collect()}
    assert n.get((1, False, False), 0) <= 0.005 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, True, False), 0) <= 0.05 * sum(v for k, v in n.items() if k[0] == 0)


def test_awkward_texts(spark):
    out = rules.decided(rules.ledger(documents(spark)), rules.POLICIES[rules.CURRENT]).collect()
    assert len(out) == documents(spark).count()
    none = [r for r in out if r["n_words"] == 0]
    assert len(none) == 4 and all(r["fail_bits"] & rules.BIT["few_words"] and not r["kept"] for r in none)
    assert rules.ledger(nothing(spark)).collect() == []


def test_policies_and_ablation_need_the_bits_only(spark):
    ledger = rules.ledger(table(spark, "documents", SF001)).select("doc_id", "fail_bits").withColumn("part", F.col("doc_id") % 3).cache()
    policy = rules.POLICIES["standard", 2]
    bits = {r["doc_id"]: r["fail_bits"] for r in ledger.collect()}

    def keeps(b, fatal, counted):
        return not b & rules.mask(fatal) and bin(b & rules.mask(counted)).count("1") <= policy.tolerated

    rows = rules.ablation(ledger, policy, ("part",)).collect()
    assert len(rows) == 3 * len((*policy.fatal, *policy.counted))
    for r in rows:
        own = [b for i, b in bits.items() if i % 3 == r["part"]]
        fatal, counted = (tuple(x for x in s if x != r["rule"]) for s in (policy.fatal, policy.counted))
        gone = [b for b in own if not keeps(b, policy.fatal, policy.counted)]
        assert (r["documents"], r["failing"], r["dropped"]) == (len(own), sum(bool(b & r["bit"]) for b in own), len(gone))
        assert r["dropped_alone"] == sum(keeps(b, fatal, counted) for b in gone)
    first, now = rules.POLICIES["standard", 1], policy
    got = {r["doc_id"] for r in rules.changed(ledger, first, now).collect()}
    assert got == {i for i, b in bits.items() if keeps(b, now.fatal, now.counted) != (not b & rules.mask(rules.BASE))}
    total = rules.summary(ledger).first()
    assert total["documents"] == len(bits) and total["any_failed"] == np.bitwise_or.reduce(list(bits.values())) and total["all_failed"] == np.bitwise_and.reduce(list(bits.values()))


def test_rules_match_sql(spark, tmp_path):
    df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(rules.SQL)
    got = rules.op13_rules(spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, rel.fetchall()))
