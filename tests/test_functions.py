"""Expressions and chunking on small literal cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import files as ff
from marlstone.functions import text as ft
from marlstone.operators import answer, chunks, folders, rank, registry, reorganise, store, sync, walk
from marlstone.sources import tables
from marlstone.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("DeepSeek API", {"deepseek", "api"}),
        ("项目管理", {"项", "目", "管", "理", "项目", "目管", "管理"}),
        ("NAS 知识库 2026", {"nas", "2026", "知", "识", "库", "知识", "识库"}),
        ("", set()),
        ("Café", {"caf"}),
    ],
)
def test_search_tokens(spark, text, tokens):
    assert set(one(spark, ft.search_tokens(F.lit(text)))) == tokens


def test_keyword_terms(spark):
    assert one(spark, ft.keyword_terms(F.lit(""))) == []
    assert one(spark, ft.keyword_terms(F.lit("月租金 多少"))) == ["月租", "租金", "多少"]
    assert len(one(spark, ft.keyword_terms(F.lit(" ".join(f"w{i}" for i in range(100))), 8))) == 8


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ("", (None, None, True)),
        ("bytes=0-9", (0, 9, True)),
        ("bytes=90-", (90, 99, True)),
        ("bytes=-10", (90, 99, True)),
        ("bytes=-1000", (0, 99, True)),
        ("bytes=0-1000", (0, 99, True)),
        ("bytes=100-", (None, None, False)),
        ("bytes=-0", (None, None, False)),
        ("bytes=5-2", (None, None, False)),
        ("bytes=0-1,3-4", (None, None, True)),
        ("lines=0-1", (None, None, True)),
        (" BYTES=0-9 ", (0, 9, True)),
        ("bytes= 5 - 9", (5, 9, True)),
        ("bytes=abc", (None, None, True)),
        ("bytes=a-b", (None, None, True)),
        ("bytes=--5", (None, None, False)),
    ],
)
def test_ranges(spark, header, want):
    assert tuple(one(spark, ff.parsed_range(F.lit(header), F.lit(100)))) == want


def test_ranges_of_an_empty_file(spark):
    assert [tuple(one(spark, ff.parsed_range(F.lit(h), F.lit(0)))) for h in ("", "bytes=0-9", "bytes=-5")] == [(None, None, True), (None, None, False), (None, None, False)]


def test_sampled_fingerprint(spark):
    """Over 512 KiB the bytes of eight spans are hashed one after another."""
    data = bytes(i * 7 % 251 for i in range(700_000)).decode("latin-1").encode("ascii", "replace")
    starts = [i * (len(data) - 65536) // 7 for i in range(8)]
    df = spark.createDataFrame([(data.decode(),), ("short",)], "x string").select(ff.fingerprint(F.col("x")).alias("h"))
    assert {r["h"] for r in df.collect()} == {hashlib.sha256(b"".join(data[s : s + 65536] for s in starts)).hexdigest(), hashlib.sha256(b"short").hexdigest()}


def test_names_keep_cjk_and_schemas_keep_hosts_apart(spark):
    names = {"/资料/合同 (1).pdf/": "资料_合同_(1).pdf", "a\\b c.md": "a_b_c.md", "项目#1": "项目#1"}
    assert {k: one(spark, ft.safe_name(F.lit(k))) for k in names} == names
    schema = lambda host, user="": one(spark, ff.schema_name(ff.normalised_identity(F.lit("WebDAV"), F.lit(host), F.lit("80"), F.lit(user))))
    assert schema("NAS.local.") == "nas_webdav_nas_local_80_uanon" and schema("a--b") == "nas_webdav_a__b_80_uanon"
    long = "h" * 60
    assert schema(long) == "nas_" + hashlib.sha1(f"webdav|{long}|80|".encode()).hexdigest()[:24] != schema(long + "x")
    assert schema("h", "me").endswith("_u" + hashlib.sha1(b"me").hexdigest()[:12])


def test_meanings(spark):
    want = {"a.py": "Python 源代码", "x.ZIP": "ZIP 压缩包", "Dockerfile": "Docker 容器构建文件", ".env": "环境变量配置文件", "notes": "无扩展名文件", "a.qqq": ".qqq 类型文件", "go.mod": "Go 模块定义"}
    assert {k: one(spark, ff.meaning_of(F.lit(k))) for k in want} == want
    kinds = {"html": "代码", "svg": "图片", "heic": "图片", "wmv": "视频", "iso": "软件", "json": "代码", "ts": "视频", "bz2": "压缩包", "": "其他"}
    assert {k: one(spark, ff.category_of(F.lit(k))) for k in kinds} == kinds


def test_video_rules(spark):
    rule = (("媒体/家庭", "/family/", "full"),)
    kind = lambda p, s=None: tuple(one(spark, ff.video_policy(F.lit(p), F.lit(s).cast("double"), rule)))
    assert kind("/Family/movie.mp4") == ("媒体/家庭", "full") and kind("/x/Movie.1080p.mkv", 10.0) == ("媒体/影视/电影", "metadata_only")
    assert kind("/x/Course 1.mp4") == ("媒体/教学视频", "keyframes_only") and kind("/x/a.mp4", 5401.0) == ("媒体/影视", "metadata_only") and kind("/x/a.mp4") == ("媒体/个人录像", "full")


def test_packing_leaves_room_for_the_head(spark):
    hits = spark.createDataFrame([(1, 1, "/a", "x", "  " + "b" * 40 + "\n"), (1, 2, "/b", "", " \n"), (1, 3, "/c", "", "c" * 100), (1, 4, "/d", "k", "d")], "q int, rank int, path string, category string, body string")
    got = [(r["rank"], r["head"], r["taken"]) for r in answer.packed_context(hits, "q", 100).orderBy("rank").collect()]
    first, third = "[1] /a（x）", "[3] /c（未分类）"
    assert got == [(1, first, 40), (3, third, 100 - (len(first) + 40 + 2) - len(third))]


def test_due_and_access(spark):
    t0 = "2024-01-01 10:00:00"
    rows = spark.createDataFrame([(1, "2024-01-01 09:58:00", 1), (2, None, 60), (3, "2024-01-01 08:00:00", 60)], "id int, last string, interval_minutes int")
    state = rows.select("id", F.col("last").cast("timestamp").alias("last_scan"), "interval_minutes", F.lit(True).alias("auto"), F.lit(True).alias("enabled"), F.col("id").alias("created"))
    due = lambda df, **k: [r["id"] for r in registry.due(df, F.lit(t0).cast("timestamp"), **k).collect()]
    assert due(state) == [2] and due(state.where("id <> 2")) == [3] and due(state.where("id = 1")) == [] and due(state, busy=True) == []
    ok = lambda path, header, tokens=("good", "two"): one(spark, registry.allowed(F.lit(path), F.lit(header).cast("string"), tokens))
    assert ok("/api/x", "Bearer good") and ok("/api/x", "bearer  good ") and not ok("/api/x", "Bearer two") and not ok("/api/x", None) and ok("/api/x", None, ())
    assert ok("/", None) and ok("/static/a.js", None) and ok("/api/docs", None) and ok("/api/files/9/download", None) and not ok("/api/files/9", None)


def test_sample_spans(spark):
    assert one(spark, ff.sample_spans(F.lit(512 * 1024))) is None
    spans = one(spark, ff.sample_spans(F.lit(8 << 20)))
    assert [s[0] for s in spans][::7] == [0, (8 << 20) - 65536] and len(spans) == 8


def test_sizes_and_paths(spark):
    assert [one(spark, ff.human_size(F.lit(n))) for n in (0, 1024, 1536, 1 << 20)] == ["0B", "1.0KB", "1.5KB", "1.0MB"]
    roots = F.array(F.lit("standards"))
    assert one(spark, ff.under_root(F.lit("standards/a"), roots)) and not one(spark, ff.under_root(F.lit("standards_old/a"), roots))
    assert one(spark, ff.extension_of(F.lit("a/.env"))) == "" and one(spark, ff.category_of(F.lit("ts"))) == "视频"


def test_rrf(spark):
    v = spark.createDataFrame([("A", 3.0), ("B", 2.0), ("C", 1.0)], "id string, score double")
    k = spark.createDataFrame([("B", 2.0), ("D", 1.0)], "id string, score double")
    got = [(r[0], r[1]) for r in rank.fuse([v, k], "id", 10, k=10).collect()]
    assert got == [("B", round(1 / 12 + 1 / 11, 6)), ("A", round(1 / 11, 6)), ("D", round(1 / 12, 6)), ("C", round(1 / 13, 6))]


def inventory(spark, rows):
    return spark.createDataFrame([(p, h, 100, 1, c, "d") for p, h, c in rows], "rel_path string, file_hash string, size_bytes int, mtime int, ctime int, parent_dir string")


def test_sync(spark):
    old = inventory(spark, [("a", "1", 2), ("old/b", "2", 2), ("c", "3", 2), ("d", "4", 2)])
    new = inventory(spark, [("a", "1b", 2), ("new/b", "2", 2), ("d", "4", 2), ("e", "5", 2)])
    got = {r["rel_path"]: (r["action"], r["from_path"]) for r in sync.classified(old, new).collect()}
    assert got == {"a": ("updated", None), "new/b": ("moved", "old/b"), "c": ("deleted", None), "d": ("unchanged", None), "e": ("added", None)}
    levels = {r[0]: r[1] for r in sync.incremental_levels(old, inventory(spark, [("a", "1", 2), ("c", "3", 0), ("d", "9", 0)])).collect()}
    assert levels == {"a": "skip_stat", "c": "skip_hash", "d": "analyse"}


MD = "intro\n# 6\n## 6.3\nlead\n### 6.3.2\nbody\n```\n# no heading\n```\n## 6.4\n| a | b |\n| 1 | 2 |\n#\n"


def test_chunks():
    got = chunks.chunk_markdown(MD)
    assert [(n, b) for n, b, _ in got] == [(1, ""), (2, "6 ▸ 6.3"), (3, "6 ▸ 6.3 ▸ 6.3.2"), (4, "6 ▸ 6.4")]
    assert "# no heading" in got[2][2] and chunks.chunk_markdown(" \n") == []
    text = "".join(f"第{i}句话在这里。" for i in range(600))
    small, large = chunks.split_text(text, 400), chunks.split_text(text, 2000)
    assert len(small) > len(large) and max(map(len, small)) <= 400 and all(s.endswith("。") for s in small)
    # the last window is cut at a sentence end like the others
    assert chunks.split_text("a" * 60 + "。" + "b" * 30 + "。" + "c" * 25, 100, 0.0) == ["a" * 60 + "。" + "b" * 30 + "。", "c" * 25]
    assert chunks.split_text("x" * 101 + "y" * 30 + "。" + "z" * 9, 100, 0.0) == ["x" * 100, "x" + "y" * 30 + "。", "z" * 9]
    assert chunks.chunk_markdown("text | with pipe。" * 90)[1:]  # pipes inside lines make no table


def test_udtf_equals_function(spark):
    spark.udtf.register("markdown_chunks", chunks.MarkdownChunks)
    spark.createDataFrame([(1, MD), (2, None)], "id int, md string").createOrReplaceTempView("md_pages")
    got = [tuple(r) for r in spark.sql("select c.seq, c.breadcrumb, c.chunk from md_pages, lateral markdown_chunks(md, 1200, 0.12D) c").collect()]
    assert got == chunks.chunk_markdown(MD)


def test_reconcile_tolerance(spark):
    """An unknown ctime on both sides is equal, so a missing row of it comes back."""
    old = inventory(spark, [("a", "1", 0), ("b", "", 2), ("c", "3", 2), ("d", "4", 2)]).withColumn("status", F.when(F.col("rel_path") == "a", "missing_source").when(F.col("rel_path") == "c", "stale_source").otherwise("ok"))
    new = inventory(spark, [("a", "", 0), ("b", "2", 2), ("c", "", 2), ("d", "5", 3)])
    got = {r["rel_path"]: (r["status"], r["file_hash"], r["outcome"]) for r in sync.reconciled(old, new).collect()}
    assert got == {"a": ("ok", "1", "restored"), "b": ("ok", "2", "unchanged"), "c": ("stale_source", "3", "unchanged"), "d": ("stale_source", "4", "stale")}


def test_snapshots_and_unique_names(spark, tmp_path):
    shelf = store.Snapshots(spark, str(tmp_path / "s"))
    assert shelf.write(spark.range(3)) == 1 and shelf.write(spark.range(5)) == 2
    assert shelf.read().count() == 5 and shelf.read(1).count() == 3 and shelf.versions() == [1, 2]
    files = spark.createDataFrame([("d/a.txt",), ("d/a (1).txt",), ("d/a (2).txt",), ("d/b",), ("d/c (7).md",), ("d/c.md",)], "rel_path string")
    taken = files.where("rel_path not like '%(%'").select(F.col("rel_path").alias("to_path"))
    got = {r["to_path"]: r["free"] for r in reorganise.unique_names(taken, files).collect()}
    assert got == {"d/a.txt": "d/a (3).txt", "d/b": "d/b (1)", "d/c.md": "d/c (1).md"}


def test_repository_files(spark, tmp_path):
    """Light entries get their full data where its file is there; broken and foreign files are skipped."""
    root = tmp_path / "root"
    (root / "x/.index/files").mkdir(parents=True)
    (root / "y/.index").mkdir(parents=True)
    (root / "x/.index/index.json").write_text(json.dumps({"files": [{"path": "a.pdf", "summary": "light", "data_file": "a.pdf.json"}, {"path": "b.md", "summary": "only", "size_bytes": "many", "data_file": "gone.json"}]}))
    (root / "x/.index/files/a.pdf.json").write_text(json.dumps({"path": "a.pdf", "summary": "full", "ocr_text": "text"}))
    (root / "y/.index/index.json").write_text("[broken")
    (root / "index.json").write_text('{"files": [{"path": "no"}]}')
    (root / "w/.index").mkdir(parents=True)
    (root / "w/.index/index.json").write_bytes(b'{"files": [{"path": "\xff", "summary": 1}]')
    starts = set()
    for place in (str(root), f"file://{root}"):
        rows = tables.repository(spark, place).select(F.regexp_extract("rel_path", "/root/([xy]/.*)$", 1).alias("p"), "summary", "ocr_text").collect()
        assert sorted(tuple(r) for r in rows) == [("x/a.pdf", "full", "text"), ("x/b.md", "only", None)]
        starts.add(tables.repository(spark, place).first()["rel_path"].split(str(root))[0])
    assert len(starts) == 1, starts
    (root / "z.sidecar.json").write_text(json.dumps({"metadata": {"file_hash": "h", "size_bytes": 3}, "analysis": {"summary": "s", "tags": ["t"]}}))
    (root / "w.sidecar.json").write_text("{}")
    assert [(r["file_hash"], r["summary"]) for r in tables.sidecars(spark, str(root)).collect()] == [("h", "s")]
    sizes = {r["name"]: r["size_bytes"] for r in tables.listing(spark, str(root), most=10).collect()}
    assert sizes == {"w.sidecar.json": 2}
    (tmp_path / "q.json").write_text('{"questions": [{"q": "a", "expect": "b"}, {"q": "c"}]}')
    (tmp_path / "p.json").write_text('["x", "y"]')
    ask = lambda n: [tuple(r) for r in tables.questions(spark, str(tmp_path / n)).orderBy("idx").collect()]
    assert ask("q.json") == [(0, "a", "b"), (1, "c", "")] and ask("p.json") == [(0, "x", ""), (1, "y", "")]
    spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "path string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert tables.vector_index(spark, str(tmp_path / "v"), 2) is None
    store.audited(spark.createDataFrame([("move", "a")], "op string, path string"), str(tmp_path / "log"))
    store.audited(spark.createDataFrame([("copy", "b")], "op string, path string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_decoding(spark):
    df = spark.createDataFrame([(b"plain \xc3\xa9",), ("数据库中".encode("gbk"),), (b"\xff\xfe\x81",), (None,)], "b binary")
    assert [r[0] for r in df.select(walk.decoded(F.col("b"))).collect()] == ["plain é", "数据库中", "ÿþ\x81", None]


def test_headings_match_chunker(spark):
    heads = chunks.headings(spark.createDataFrame([(1, MD)], "page_id int, md string")).orderBy("line").collect()
    assert [(r["level"], r["title"]) for r in heads] == [(1, "6"), (2, "6.3"), (3, "6.3.2"), (2, "6.4")]


def test_holders_equal_brute_force(spark):
    wants = ["one two three", "wo two thr", "two", "", "é!", "漢字 über two", "absent word here", None, "x y"]
    texts = ["zone two threes", "One two three", "one two three", "", None, "é! 漢字 über two", "the 漢字 x yz", "two"]
    items = spark.createDataFrame(list(enumerate(wants)), "query_id long, want string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, answer.holders(items, docs).collect()))
    assert got == [(i, j) for i, x in enumerate(wants) for j, y in enumerate(texts) if x is not None and y is not None and x in y]


def test_a_holder_past_the_ranked_documents_counts(spark, tmp_path):
    rows = [(i, "delta gamma beta alpha", "en", "s", 22) for i in range(1100)] + [(1100, "alpha beta gamma delta " + "filler " * 5000, "en", "s", 35023)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["k"]: (r["recall"], r["questions"]) for r in catalog.recall_at_k(spark, str(tmp_path)).collect()}
    assert got == {1: (0.0, 1), 3: (0.0, 1), 5: (0.0, 1)}


def test_only_analysed_files_are_skipped(spark):
    """The chain of tests of an incremental walk, case by case."""
    stat = "rel_path string, file_hash string, size_bytes long, mtime double, ctime double, parent_dir string, hash_algorithm string, has_content boolean"
    old = spark.createDataFrame(
        [("same", "h", 1, 1.0, 1.0, "", "a", True), ("never", "h", 1, 1.0, 1.0, "", "a", False), ("old_print", "h", 1, 1.0, 1.0, "", None, True), ("touched", "h", 1, 1.0, 1.0, "", "a", True),
         ("changed", "h", 1, 1.0, 1.0, "", "a", True), ("other", "h", 1, 1.0, 1.0, "", "b", True), ("blank", "h", 1, 1.0, 1.0, "", "", True), ("no_ctime", "x", 1, 1.0, 0.0, "", "a", True)], stat)
    new = spark.createDataFrame(
        [("same", "x", 1, 1.0, 1.0, "", "a", None), ("never", "h", 1, 1.0, 1.0, "", "a", None), ("old_print", "h", 1, 1.0, 1.0, "", "a", None), ("touched", "h", 1, 2.0, 1.0, "", "a", None),
         ("changed", "n", 1, 2.0, 1.0, "", "a", None), ("other", "h", 1, 2.0, 1.0, "", "a", None), ("blank", "n", 2, 2.0, 1.0, "", "a", None), ("no_ctime", "y", 1, 1.0, 0.0, "", "a", None), ("new", "h", 1, 1.0, 1.0, "", "a", None)], stat)
    got = {r["rel_path"]: (r["level"], r["upgraded"]) for r in sync.incremental_levels(old, new).collect()}
    assert got == {
        "same": ("skip_stat", False), "never": ("analyse", False), "old_print": ("skip_stat", True), "touched": ("skip_hash", False), "changed": ("analyse", False),
        "other": ("analyse", False), "blank": ("skip_upgrade", True), "no_ctime": ("analyse", False), "new": ("analyse", False),
    }


def test_ignored_directories_are_those_a_walk_sees(spark):
    paths = ["d/Thumbs.db", "e/.git/x", "f/a.zip", "f/g/b.py", "h/~$x.docx", "h/a.zip", "h/b.pdf", "k/.index/files/a.json", "k/l/m.zip", "n.zip"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(F.col("p"), F.when(F.instr("p", "/") > 0, F.regexp_replace("p", "/[^/]*$", "")).otherwise("").alias("parent_dir"))
    got = {r["dir"] for r in folders.top_ignored(rows.select("parent_dir", walk.tree_class(F.col("p"), F.lit(1)).alias("class"))).collect()}
    assert got == {"", "k/l"}


def test_scan_report(spark):
    listing = spark.createDataFrame([("d/a.pdf", "1"), ("d/b.pdf", "2"), ("d/c.pdf", "3"), ("d/x.zip", "4"), ("d/Thumbs.db", "5"), ("d/~$a.pdf", "6"), ("e/Thumbs.db", "7")], "rel_path string, file_hash string")
    entries = spark.createDataFrame([("d/a.pdf", "1"), ("d/b.pdf", "old"), ("d/x.zip", "4"), ("d/gone.pdf", "8"), ("f/gone.pdf", "9")], "rel_path string, file_hash string")
    got = {r["parent_dir"]: (r["total"], r["valid"], r["missing"], r["stale"], r["ignored"], r["orphans"]) for r in folders.scan_report(listing, entries).collect()}
    assert got == {"d": (4, 1, 1, 1, 1, 1), "f": (0, 0, 0, 0, 0, 1)}
