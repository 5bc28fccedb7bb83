"""Secrets, PII, packing, substrings and SimHash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import DATA, LONG, TEXTS, documents, nothing, table
from pyspark.sql import functions as F

from marlstone.llm import packing, pii, secrets, simhash, substrings


def test_secrets_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    rel = con.sql(secrets.SQL)
    got = secrets.op3_secrets(spark, DATA).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_secrets_awkward_rows(spark):
    texts = [None, "", 'API_KEY = "abc12"', "é🙂 token:  'abcdef' AKIA" + "A" * 16, "0" * 24 + " " + "f" * 23, "secret=" + "q" * 50_000, LONG, "token=abc token=abcdef"]
    got = {r["doc_id"]: r for r in secrets.scan(documents(spark, texts)).collect()}
    spans = {i: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for i, r in got.items()}
    assert spans[0] == spans[1] == spans[2] == spans[6] == []
    assert spans[3] == [("assign", 3, 18), ("access", 20, 40)]
    assert spans[4] == [("hex", 0, 24)] and spans[5] == [("assign", 0, 50_007)] and spans[7] == [("assign", 10, 22)]
    assert secrets.scan(nothing(spark)).count() == 0


def test_entropy_window(spark):
    key = "q7Zp2Lx9Vb4Kt8Rw1Nm5Jd3"
    rows = documents(spark, [f"see {key} here", "see " + "ab" * 15, "see 123e4567-e89b-12d3-a456-426614174000", "the " + "x" * 40])
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["entropy"]] for r in secrets.scan(rows).collect()}
    assert got == {0: [(4, 4 + len(key))], 1: [], 2: [], 3: []}


def test_secrets_in_very_long_candidates(spark):
    """A candidate of a million characters, and a text of 20,000 candidates: the spans are those of a plain count."""
    rng = random.Random(4)
    long = "".join(rng.choice(secrets.SYMBOLS) for _ in range(1_000_000))
    many = " ".join("".join(rng.choice(secrets.SYMBOLS[:62]) for _ in range(24)) for _ in range(20_000))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["entropy"]] for r in secrets.scan(documents(spark, [f"x {long}", many])).collect()}

    def bits(w):
        return round(-sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values()), 6)

    def hot(word):
        return [i for i in range(len(word) - secrets.WINDOW + 1) if bits(word[i : i + secrets.WINDOW]) >= secrets.CLASSES[1][2]]

    edges = hot(long[:200])[0], len(long) - 200 + hot(long[-200:])[-1]
    assert got[0] == [(2 + edges[0], 2 + edges[1] + secrets.WINDOW)]
    want = []
    for i, word in enumerate(many.split()):
        at = hot(word)
        if at and re.search("[0-9]", word):
            want.append((25 * i + at[0], 25 * i + at[-1] + secrets.WINDOW))
    assert [x for x in got[1] if re.search("[0-9]", many[x[0] : x[1]])] == [x for x in want if re.search("[0-9]", many[x[0] : x[1]])] and len(want) > 10_000


PRIVATE = "Mr James Smith, james.smith@example.com, +1 555 123 4567, 123-45-6789, card 4111 1111 1111 1111, 192.168.1.10; again James and james.smith@example.com."


def shape(s):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))


def test_surrogates_keep_type_and_format(spark):
    row = pii.checked_surrogates(documents(spark, [PRIVATE])).first()
    found = {(e["kind"], e["found"]): e["surrogate"] for e in row["_entities"]}
    assert {k for k, _ in found} == {"name", "email", "phone", "ssn", "card", "ip"}
    for (kind, value), new in found.items():
        assert new != value and value not in row["text"]
        if kind not in ("name", "ip"):
            assert shape(new) == shape(value), (value, new)
    card = [int(c) for c in re.sub(r"\D", "", found["card", "4111 1111 1111 1111"])]
    assert sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(card)) % 10 == 0
    assert row["text"].count(found["email", "james.smith@example.com"]) == 2
    assert found["name", "Mr James Smith"].split()[1] in pii.GIVEN_NAMES[0]
    assert all(0 <= int(x) < 256 for x in found["ip", "192.168.1.10"].split("."))


def test_surrogates_stay_distinct_and_awkward_rows(spark):
    people = documents(spark, [f"user{i}@mail{i % 7}.example.org and 555-010-{i:04d}" for i in range(500)])
    marked = pii.with_entities(people, "k")
    assert pii.collisions(marked.select(F.col("_entities").alias("entities"))).count() == 0
    assert marked.select(F.explode("_entities.surrogate")).distinct().count() == 1000
    got = pii.checked_surrogates(documents(spark))
    assert set(documents(spark).columns) <= set(got.columns) and got.count() == documents(spark).count()
    assert {r["text"] for r in got.where("doc_id in (0, 1)").collect()} == {""}
    assert got.where("doc_id = 4").first()["text"] == LONG
    assert pii.checked_surrogates(nothing(spark)).count() == 0


def test_names_stay_distinct_beside_the_listed_ones(spark):
    """All words of Anna's and Emma's shape, and other spellings: listed and permuted names never meet, and case makes no new person."""
    vowels, consonants = pii.ALPHABETS[1], pii.ALPHABETS[3]
    words = [f"{a.upper()}{b}{c}{d}" for a in vowels for b in consonants for c in consonants for d in vowels]
    every = documents(spark, ["; ".join(f"Mrs {w}" for w in words[i : i + 105]) for i in range(0, len(words), 105)])
    marked = pii.with_entities(every, "k")
    assert pii.collisions(marked.select(F.col("_entities").alias("entities"))).count() == 0
    assert marked.select(F.explode("_entities.surrogate")).distinct().count() == len(words)
    row = pii.checked_surrogates(documents(spark, ["Mrs Anna Weber, Mrs ANNA WEBER, Mrs \u212aaren, Mrs Karen, г-н Пётр, г-н ПЁТР"])).first()
    new = [e["surrogate"] for e in row["_entities"]]
    assert len(new) == 6 and new[1] == "Mrs " + new[0][4:].upper() and new[5] == "г-н " + new[4][4:].upper()
    assert new[4].split()[1] in pii.GIVEN_NAMES[2] and new[2].lower() != new[3].lower()


def unpacked(rows, limit=1024):
    """Checks offsets; returns pieces by document row."""
    seqs = {}
    for r in rows:
        assert 0 < r["length"] <= limit
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(seqs)


def test_packing_round_trip(spark):
    docs = table(spark, "documents")
    rows = packing.pack(docs).collect()
    n = unpacked(rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
    total = 0
    for d in docs.collect():
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        pieces = [by_doc[d["doc_id"]][k] for k in range(len(by_doc[d["doc_id"]]))]
        assert [p["start"] for p in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 1024 for p in pieces[1:])
        for p in pieces:
            assert zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
        total += len(ids)
    assert n <= total / 1024 * 1.02 + 1


def test_packing_awkward_rows(spark):
    rows = packing.pack(documents(spark)).collect()
    unpacked(rows)
    short = sorted(r["length"] for r in rows if r["doc_id"] in (0, 1))
    assert short == [1, 1] and sum(r["doc_id"] == 5 for r in rows) == 2
    assert packing.pack(nothing(spark)).count() == 0


def test_packing_very_long_runs(spark):
    """A million spaces, line ends, letters and mixed blanks: the ids are the tokenizer's own."""
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "a" * 1_000_000, "\t \u3000" * 300_000, "x" + " " * 9_999 + "y"]
    rows = packing.token_pieces(documents(spark, texts)).collect()
    tok = Tokenizer.from_file(packing.vocabulary_path())
    for n, text in enumerate(texts):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        pieces = sorted((r for r in rows if r["doc_id"] == str(n)), key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in pieces)


def test_search_goes_on_past_a_bin_that_stays():
    """The least full bin holds a piece that fits nowhere; the next ones can be emptied all the same."""
    lengths = [7, 5, 4, 6, 3, 3, 8]
    bins = packing.improve([[0], [6], [1, 2], [3], [4], [5]], lengths, 10)
    assert len(bins) <= 5 and sorted(i for b in bins for i in b) == list(range(7))


def test_swaps_empty_a_bin():
    lengths = [6, 6, 4, 4, 3, 3, 2, 2]
    bins = packing.improve([[0, 2], [1, 4], [3, 5, 6], [7]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(8))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)


def repeated_texts():
    rng = random.Random(3)
    words = [f"w{i:x}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(60 + 10 * i) for i in range(6)]
    texts = [f"{say(rng.randrange(80))} {rng.choice(shared)} {say(rng.randrange(80))}" for _ in range(120)]
    texts += [f"{shared[0][:k]}" for k in (199, 200, 201, 230)] + [texts[3], texts[3], "ab" * 400, "z" * 700, say(50), "", None, "é漢🙂" * 80]
    return texts


def test_substrings_equal_brute_force(spark):
    texts = repeated_texts()
    docs = documents(spark, texts)
    found = substrings.deduplicated(docs, digest=True)
    got = docs.select("doc_id", substrings.text_key(F.coalesce("text", F.lit(""))).alias("k")).join(found.withColumnRenamed("th", "k"), "k")
    want = substrings.brute_force([(t or "").encode() for t in texts])
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got.collect()) == [(i, *w) for i, w in enumerate(want)]


def test_texts_of_one_key_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(substrings, "text_key", lambda text, seed=0: F.lit(1).cast("long") if not seed else F.xxhash64(text))
    docs = documents(spark, ["one text", "another text", "one text"])
    with pytest.raises(Exception, match="share a key"):
        substrings.deduplicated(docs).collect()
    assert substrings.deduplicated(docs, seed=1).count() == 2


def test_substrings_awkward_rows(spark):
    got = substrings.deduplicated(documents(spark)).collect()
    assert {len(r["kept"]) + r["n_removed"] for r in got} >= {0, len(LONG)}
    assert substrings.deduplicated(nothing(spark)).count() == 0


def smallest_reachable(ids, prints, radius):
    least = dict(zip(range(len(ids)), ids, strict=True))
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    least[i], moved = least[j], True
    return least


def plain_print(text):
    import xxhash

    words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    texts = [r["text"] for r in table(spark, "documents").orderBy("doc_id").collect()] + ["a b C d e", "A b c", "", None, " x\x1cy\x0bz "]
    texts += [texts[0] + " more", texts[1].upper()]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i]["fingerprint"] % (1 << 64) for i in range(len(texts))] == prints
    want = smallest_reachable(list(range(len(texts))), prints, 4)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_forest_links_connect_what_is_near():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(300)]
    prints = [p % (1 << 64) for p in dict.fromkeys(prints)]
    i, j = simhash.forest_links(np.zeros(len(prints), np.int64), np.array(prints, np.uint64)[:, None], 4)
    label = list(range(len(prints)))
    for _ in prints:
        for a, b in zip(i, j, strict=True):
            label[a] = label[b] = min(label[a], label[b])
    assert label == list(smallest_reachable(list(range(len(prints))), prints, 4).values())


def test_simhash_awkward_rows(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs)
    assert got.count() == docs.count()
    assert {r["component_id"] for r in got.where("doc_id in (0, 1, 2)").collect()} == {0}
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    kept = simhash.without_copies(docs.repartition(1))
    assert {5, 3, 7} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (0, 1, 2)").count() == 1 and kept.where("doc_id in (5, 6)").count() == 1
    assert kept.columns == docs.columns and simhash.without_copies(nothing(spark)).count() == 0


def test_near_copies_at_a_similarity_of_0_8(spark):
    rng = random.Random(9)
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(3000)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(200)]
        near = list(text)
        for at in (20, 90, 160):  # three changed words: 15 of 196 shingles, a similarity of 0.86
            near[at] = rng.choice(words)
        texts += [" ".join(text), " ".join(near)]
    kept = {r["doc_id"] for r in simhash.without_copies(documents(spark, texts).repartition(1)).collect()}
    assert kept == set(range(0, 120, 2))


def test_copies_equal_brute_force_jaccard(spark):
    """Pairs on both sides of 0.8: changed words, appended text, and chains through a text that is near two others."""
    rng = random.Random(11)
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(4000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for n in (9, 30, 120, 400):
        for share in (0.01, 0.02, 0.022, 0.024, 0.026, 0.03, 0.035, 0.04, 0.05, 0.07):
            for _ in range(4):
                text = say(n)
                near = [rng.choice(words) if rng.random() < share else w for w in text]
                texts += [text, near, text + say(int(n * 0.24)), text + say(int(n * 0.3))]
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    least = list(range(len(texts)))
    moved = True
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in alike:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    between = [len(sets[i] & sets[i + k]) / len(sets[i] | sets[i + k]) for i in range(0, len(texts), 4) for k in (1, 2, 3)]
    assert sum(0.6 <= x < 0.8 for x in between) > 40 and sum(0.8 <= x < 0.86 for x in between) > 40
    kept = {r["doc_id"] for r in simhash.without_copies(documents(spark, [" ".join(t) for t in texts]).repartition(1)).collect()}
    assert kept == set(least)
    # the rarest shingles alone find every link as well
    docs = documents(spark, [" ".join(t) for t in texts]).repartition(1)
    assert {r["doc_id"] for r in simhash.without_copies(docs, radius=0).collect()} == set(least)


def test_a_large_group_takes_about_one_verification_a_copy(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = []
    for i in range(600):
        near = list(base)
        near[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(near))
    tested = []
    real = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: tested.append(pairs.count()) or real(pairs, *rest))
    assert simhash.without_copies(documents(spark, texts).repartition(1)).count() == 1
    assert sum(tested) < 2 * len(texts)


def test_a_step_of_a_tree_search_may_be_empty(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 3)
    i, j = simhash.forest_links(np.zeros(10, np.int64), np.arange(10, dtype=np.uint64)[:, None], 1)
    assert set(i.tolist()) == {0} and sorted(j.tolist()) == list(range(1, 10))
