"""Queries of the inventory: walks, snapshot changes, joined search, plans, registry; each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import text as ft
from ..operators import answer, chunks, enrich, folders, moves, rank, registry, reorganise, store, sync, walk
from ..operators.vectors import VectorIndex
from ..sources import tables as t
from ..sources.manifest import Manifests
from ..sources.shelf import Rounds, shared_folder
from .catalog import _BM25 as BM25_SQL
from .catalog import _FIXED as FIXED_SQL
from .catalog import _MOVES as _MOVES_SQL
from .catalog import _PAIR as _PAIR_SQL
from .catalog import ORACLES, docs, query

# --- walks

#: What the listing's paths look like, by the remainder of the file's number.
_WALK = """w as (select doc_id, source, lang, mtime, size_bytes, case doc_id % 9 when 0 then '.git/' || name when 1 then source || '/.cache/' || lang || '/' || name when 2 then '#RECYCLE/' || name when 3 then source || '/Thumbs.db' when 4 then source || '/~$' || name when 5 then source || '/.hidden' when 6 then source || '/node_modules/' || name
 when 7 then source || '/.index/index.json' else rel_path end as path, ext from files)"""


def _listing(spark, d):
    p = lambda *parts: F.concat(*(F.lit(x[1:]) if x.startswith("=") else F.col(x) for x in parts))
    paths = [p("=.git/", "name"), p("source", "=/.cache/", "category", "=/", "name"), p("=#RECYCLE/", "name"), p("source", "=/Thumbs.db"), p("source", "=/~$", "name"), p("source", "=/.hidden"), p("source", "=/node_modules/", "name"), p("source", "=/.index/index.json"), F.col("rel_path")]
    path = F.element_at(F.array(*paths), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    return t.files(spark, d).select("doc_id", path.alias("path"), "size_bytes", "mtime", "ctime")


@query(f"with __FILES__, {_WALK} select path as rel_path, regexp_extract(path, '[^/]*$') as name, mtime, size_bytes > 5 * 1048576 as too_big from w where doc_id % 9 in (5, 6, 8)")
def walk_source(spark, d):
    rows = walk.walked(_listing(spark, d), 5)
    return rows.select("rel_path", "name", "mtime", "too_big")


_CLASSES = f"""{_WALK}, c as (select path, case doc_id % 9 when 0 then 'hidden' when 1 then 'hidden' when 2 then 'excluded' when 3 then 'system' when 4 then 'system' when 5 then 'unsupported' when 6 then 'excluded' when 7 then 'repository'
 else case when ext in ('zip', 'py') then 'unsupported' when size_bytes > 1048576 then 'big' else 'supported' end end as class from w)"""


def _classes(spark, d):
    rows = _listing(spark, d)
    return rows.select("path", walk.tree_class(F.col("path"), F.col("size_bytes"), ("Node_Modules", "#recycle"), 1).alias("class"))


@query(f"with __FILES__, {_CLASSES} select class, count(*) as n from c group by 1")
def tree_classes(spark, d):
    return _classes(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query(f"with __FILES__, {_CLASSES} select count(*) filter (class in ('supported', 'unsupported', 'big')) as total, count(*) filter (class = 'supported') as supported, count(*) filter (class = 'unsupported') as unsupported, count(*) filter (class = 'big') as big, count(*) filter (class = 'excluded') as excluded from c")
def batch_counts(spark, d):
    return walk.batch_counts(_classes(spark, d))


@query("""with __FILES__, x as (select parent_dir as dir, lang <> 'de' or doc_id % 3 = 0 as junk, ext not in ('zip', 'py') as ok from files where lang in ('en', 'fr') and doc_id % 2 = 0 or ext in ('zip', 'py') or lang = 'es'),
k as (select dir, count(*) filter (ok) as ok from (select dir || '/only' as dir, ok from x where junk and not ok union all select dir, ok from x) group by 1) select dir from k where ok = 0 and regexp_replace(dir, '/[^/]*$', '') not in (select dir from k where ok = 0)""")
def top_ignored_dirs(spark, d):
    """Folders that hold archives and code only, beside system files, lock files and repositories, which a walk never sees, and folders of these alone."""
    rows = t.files(spark, d).where("(category in ('en', 'fr') and doc_id % 2 = 0) or ext in ('zip', 'py') or category = 'es'").select("parent_dir", "name", "rel_path", "ext", "size_bytes", "category", "doc_id")
    only = rows.where("ext in ('zip', 'py') and (category <> 'de' or doc_id % 3 = 0)").withColumn("parent_dir", F.concat("parent_dir", F.lit("/only")))
    unseen = rows.withColumns({"parent_dir": F.concat("parent_dir", F.lit("/junk")), "name": F.when(F.col("doc_id") % 3 == 0, "Thumbs.db").when(F.col("doc_id") % 3 == 1, "~$a.docx").otherwise(".index/files/x.json")})
    every = rows.unionByName(only).unionByName(unseen)
    path = F.concat("parent_dir", F.lit("/"), "name")
    parent = F.when(F.col("name").startswith(".index"), F.concat("parent_dir", F.lit("/.index/files"))).otherwise(F.col("parent_dir"))
    return folders.top_ignored(every.select(parent.alias("parent_dir"), walk.tree_class(path, F.col("size_bytes")).alias("class")))


@query("""with __FILES__, s as (select doc_id, case when doc_id % 4 = 0 then null else length(text) / 10000.0::double end as ratio, length(text) as n, doc_id % 3 as images from files)
select doc_id, case when ratio is null then true when n >= 500 then false else ratio < 0.3 end as ocr, images > 0 and n / 2.0 < 2000 as scanned from s""")
def needs_ocr(spark, d):
    n = F.length("text")
    ratio = F.when(F.col("doc_id") % 4 != 0, n / 10000.0)
    return t.files(spark, d).select("doc_id", ff.needs_ocr(ratio, n).alias("ocr"), ff.scan_like(F.col("doc_id") % 3, F.lit(2), n).alias("scanned"))


@query("with __FILES__ select doc_id, case when size_bytes > 3000 then 'larger than 3000' end as error from files")
def extract_size_gate(spark, d):
    rows = walk.extractable(t.files(spark, d), 3000)
    return rows.join(t.files(spark, d).select("rel_path", "doc_id"), "rel_path").select("doc_id", "error")


@query("with __FILES__ select rel_path, case when doc_id % 2 = 0 then file_hash when size_bytes <= 524288 then sha256(text) end as file_hash, case when doc_id % 2 = 0 then 'given' when size_bytes <= 524288 then 'sha256:full' end as hash_algorithm from files")
def missing_hashes(spark, d):
    """Every other file has a fingerprint."""
    files = t.files(spark, d)
    even = F.col("doc_id") % 2 == 0
    items = files.select("rel_path", "size_bytes", F.when(even, F.col("file_hash")).alias("file_hash"), F.when(even, "given").alias("hash_algorithm"))
    return walk.with_missing_hashes(items, files, 512).select("rel_path", "file_hash", "hash_algorithm")


@query("""with r as (select n_nationkey, s.i, (s.i * (octet_length(encode(big)) - 65536)) // 7 as start, big from (select n_nationkey, repeat(n_name || '-' || n_nationkey || ';', 60000) as big from nation) x, (select unnest(range(8)) as i) s)
select n_nationkey, sha256(string_agg(substr(big, start::bigint + 1, 65536), '' order by i)) as fingerprint, 'sha256:sample8x64k' as algorithm from r group by 1""")
def fingerprint_sampled(spark, d):
    """Texts over the size to which all bytes count."""
    rows = t.read(spark, d, "nation").select("n_nationkey", F.repeat(F.concat("n_name", F.lit("-"), "n_nationkey", F.lit(";")), F.lit(60000)).alias("big"))
    return rows.select("n_nationkey", ff.fingerprint(F.col("big")).alias("fingerprint"), ff.fingerprint_algorithm(F.octet_length("big")).alias("algorithm"))


@query("""with __FILES__ select doc_id, case when doc_id % 3 = 2 then '/Srv/Data/' || rel_path when doc_id % 3 = 1 then '' else rel_path end as rel from files where doc_id % 3 <> 2 union all select doc_id, rel_path from files where doc_id % 3 = 2""")
def rebase_paths(spark, d):
    """Absolute paths under a root, the root itself, and paths that spell it in another case."""
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/srv/data/"), "rel_path")).when(F.col("doc_id") % 3 == 1, "/srv/data").otherwise(F.concat(F.lit("/Srv/Data/"), "rel_path"))
    return t.files(spark, d).select("doc_id", ff.rebased(path, F.lit("/srv/data/")).alias("rel"))


@query("""select doc_id, case when strlen(text) >= 60 then sha256(substr(text, 1, 10) || substr(text, 51, 10)) end as h from documents where strlen(text) = length(text) union all select doc_id, null from documents where strlen(text) <> length(text)""")
def byte_ranges(spark, d):
    """Ten bytes at 0 and at 50 of ASCII texts; short ones have none."""
    text = F.col("text")
    part = ff.byte_ranges(text.cast("binary"), F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("length")), F.struct(F.lit(50).alias("start"), F.lit(10).alias("length"))))
    return docs(spark, d).select("doc_id", F.when(F.octet_length(text) == F.length(text), F.sha2(part, 256)).alias("h"))


@query("select doc_id, sha256(text) as h from documents")
def decode_text(spark, d):
    rows = docs(spark, d).select("doc_id", walk.decoded(F.col("text").cast("binary")).alias("text"))
    return rows.select("doc_id", F.sha2("text", 256).alias("h"))


@query("with __FILES__ select ext, case ext when 'txt' then 'text/plain' when 'md' then 'text/markdown' when 'pdf' then 'application/pdf' when 'jpg' then 'image/jpeg' when 'mp4' then 'video/mp4' when 'zip' then 'application/zip' when 'py' then 'text/x-python' else 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' end as mime, case ext when 'jpg' then 'image' when 'mp4' then 'video' when 'pdf' then 'pdf' when 'zip' then null when 'xlsx' then 'office' else 'text' end as view, count(*) as n from files group by all")
def mime_and_view(spark, d):
    name = F.col("name")
    return t.files(spark, d).groupBy("ext", ff.mime_of(name).alias("mime"), ff.view_of(F.col("ext")).alias("view")).agg(F.count("*").alias("n"))


@query("""with __FILES__ select doc_id, case doc_id % 4 when 0 then timestamp '2024-01-02 03:04:05' when 1 then timestamp '2024-01-02 00:00:00' end as at, doc_id % 2 = 0 as close, doc_id % 3 = 0 as document, sha1(source || ':r' || doc_id || ':' || file_hash || ':320')[1:24] as thumb,
 '&lt;b class=&quot;' || doc_id || '&quot;&gt;&amp;&lt;/b&gt;' as html from files""")
def small_scalars(spark, d):
    """Lenient times, closeness, names of pictures of documents, thumbnail keys, escaped text."""
    files = t.files(spark, d)
    text = F.element_at(F.array(F.lit("2024-01-02T03:04:05"), F.lit("2024-01-02"), F.lit("yesterday"), F.lit("")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    other = F.when(F.col("doc_id") % 2 == 0, F.col("mtime") + 1e-7).otherwise(F.col("mtime") + 0.5)
    picture = F.when(F.col("doc_id") % 3 == 0, "扫描/Invoice_2024.jpg").otherwise("扫描/beach.jpg")
    markup = F.concat(F.lit('<b class="'), F.col("doc_id").cast("string"), F.lit('">&</b>'))
    return files.select(
        "doc_id", ff.iso_time(text).cast("timestamp_ntz").alias("at"), ff.close_to(F.col("mtime"), other).alias("close"), ff.like_document(picture).alias("document"),
        ff.thumbnail_key(F.col("source"), F.concat(F.lit("r"), F.col("doc_id").cast("string")), F.col("file_hash"), F.lit(320)).alias("thumb"), ff.html_escaped(markup).alias("html"),
    )


@query("""select conv_id, turn, case when turn % 3 = 2 then null else length(text) end as n from conversations""")
def llm_json(spark, d):
    """Objects in answers: in a code fence, amid talk, and none at all."""
    body = F.to_json(F.struct(F.length("text").alias("n")))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is "), body, F.lit(" I think"))).otherwise("no idea")
    return t.read(spark, d, "conversations").select("conv_id", "turn", F.from_json(ft.json_part(said), "n long")["n"].alias("n"))


# --- entries and documents

_ENTRIES = """entries as (select rel_path, substr(text, 1, 200) as summary, lang as category, [lang, source] as tags, case when doc_id % 2 = 0 then substr(text, 201, 100) else '' end as content_description, case when doc_id % 3 = 0 then substr(text, 301, 50) end as transcription,
 case when doc_id % 5 = 0 then substr(text, 351, 50) else '' end as ocr_text, source, doc_id from files)"""


def _entries(spark, d):
    part = lambda a, n: F.substring("text", a, n)
    when = lambda k, v, other: F.when(F.col("doc_id") % k == 0, v).otherwise(other)
    return t.files(spark, d).select(
        "rel_path", part(1, 200).alias("summary"), "category", F.array("category", "source").alias("tags"), when(2, part(201, 100), F.lit("")).alias("content_description"),
        when(3, part(301, 50), F.lit(None)).alias("transcription"), when(5, part(351, 50), F.lit("")).alias("ocr_text"), "source", "doc_id",
    )


@query(f"""with __FILES__, {_ENTRIES}, p as (select rel_path, rel_path || chr(10) || case when summary = '' then '' else summary || chr(10) end || category || chr(10) || category || ' ' || source || case when content_description = '' then '' else chr(10) || content_description end as text,
 case when coalesce(transcription, '') = '' then '' else chr(10) || transcription end || case when ocr_text = '' then '' else chr(10) || ocr_text end as more from entries)
select rel_path as path, 'file' as kind, sha256(text) as text, sha256(text || more) as context from p
union all select source, 'folder', sha256('About ' || source || chr(10) || 'a b'), sha256('About ' || source || chr(10) || 'a b') from (select distinct source from files)""")
def collect_docs(spark, d):
    """Light entries joined with their full data, and folders, as retrieval documents."""
    light, full = store.split_entries(_entries(spark, d))
    about = t.files(spark, d).select("source").distinct().select(F.col("source").alias("rel_path"), F.concat(F.lit("About "), "source").alias("summary"), F.lit("").alias("description"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    rows = store.collected_docs(store.joined_entries(light, full), about)
    return rows.select("path", "kind", F.sha2("text", 256).alias("text"), F.sha2("context", 256).alias("context"))


@query(f"with __FILES__, {_ENTRIES} select rel_path, case when content_description <> '' or coalesce(transcription, '') <> '' or ocr_text <> '' then rel_path || '.json' end as data_file from entries")
def split_entries(spark, d):
    return store.split_entries(_entries(spark, d))[0].select("rel_path", "data_file")


@query(f"with __FILES__, {_ENTRIES} select rel_path from entries where (case when doc_id % 3 = 0 then ' ' else summary end || content_description) not in ('', ' ')")
def staging_docs(spark, d):
    rows = _entries(spark, d).withColumn("summary", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("summary")))
    return store.staged(rows).select("rel_path")


@query("with __FILES__ select rel_path, case when doc_id % 4 = 0 then 'new ' || doc_id else 'old' end as summary, case when doc_id % 4 = 0 then 3 else 1 end as version from files where doc_id % 7 > 0 or doc_id % 4 = 0")
def entries_upsert(spark, d):
    """A store of most files gets entries of every fourth, each twice; the newer one counts."""
    rows = t.files(spark, d)
    old = rows.where("doc_id % 7 > 0").select("rel_path", F.lit("old").alias("summary"), F.lit(1).alias("version"))
    new = rows.where("doc_id % 4 = 0").select("rel_path", F.explode(F.array(F.lit(2), F.lit(3))).alias("version"), "doc_id")
    new = new.select("rel_path", F.when(F.col("version") == 3, F.concat(F.lit("new "), F.col("doc_id").cast("string"))).otherwise("older").alias("summary"), "version")
    return store.upserted(old, new, ["rel_path"], "version")


@query("with __FILES__ select rel_path from files where doc_id % 3 > 0")
def entries_remove(spark, d):
    rows = t.files(spark, d).select("rel_path", "doc_id")
    gone = rows.where("doc_id % 3 = 0").select("rel_path").unionByName(spark.createDataFrame([("no/such",)], "rel_path string"))
    return store.removed(rows.select("rel_path"), gone, ["rel_path"])


@query("""with __FILES__ select case when source = 'src3' then 'moved/' || rel_path else rel_path end as rel_path, case when source <> 'src3' then 'x' when doc_id % 2 = 0 then rel_path else '/from/here' end as original_path,
 case when source <> 'src3' then 'a' when doc_id % 3 = 0 then 'a,' || rel_path else rel_path end as moved_from, case when source = 'src3' then 'now' else 'then' end as analyzed_at from files""")
def entries_move(spark, d):
    files = t.files(spark, d)
    moving = F.col("source") == "src3"
    entries = files.select(
        "rel_path", F.when(moving & (F.col("doc_id") % 2 == 1), "/from/here").otherwise("x").alias("original_path"),
        F.when(~moving | (F.col("doc_id") % 3 == 0), F.array(F.lit("a"))).otherwise(F.array("rel_path")).alias("moved_from"), F.lit("then").alias("analyzed_at"),
    )
    relocated = files.where("source = 'src3'").select(F.col("rel_path").alias("from_path"), F.concat(F.lit("moved/"), "rel_path").alias("to_path"))
    return store.moved(entries, relocated, F.lit("now")).withColumn("moved_from", F.array_join("moved_from", ","))


@query("with __FILES__ select text as file_hash, min(rel_path) as rel_path from (select file_hash as text, rel_path from files) group by 1")
def first_wins(spark, d):
    return store.first_wins(t.files(spark, d).select("file_hash", "rel_path"), ["file_hash"], "rel_path")


# --- resources and vectors

_QV = "qv as (select v as qv from vectors where resource_id = 'r7')"


def _store(spark, d):
    return t.resources(spark, d), t.vectors(spark, d)


def _asked(spark, d):
    return rank.vector_of(t.read(spark, d, "embeddings"), 7)


@query(f"""with __RESOURCES__, {_QV} select resource_id, rel_path, round(list_cosine_similarity(v, qv), 6) as score, status <> 'ok' as stale from vectors join resources using (resource_id), qv where level = 'summary' and source_id in ('src1', 'src4', 'src7') order by score desc, resource_id limit 10""")
def vector_search_sources(spark, d):
    resources, vectors = _store(spark, d)
    return rank.vector_search(vectors, resources, _asked(spark, d), 10, sources=("src1", "src4", "src7")).select("resource_id", "rel_path", "score", "stale")


@query(f"""with __RESOURCES__, {_QV}, s as (select resource_id, chunk_seq, round(list_cosine_similarity(v, qv), 6) as score from vectors join resources using (resource_id), qv where level = 'chunk' order by score desc, resource_id, chunk_seq limit 10) select * from s where score >= 0.2""")
def chunk_vector_search(spark, d):
    """The floor is tested on the top k."""
    resources, vectors = _store(spark, d)
    return rank.vector_search(vectors, resources, _asked(spark, d), 10, "chunk", score_min=0.2).select("resource_id", "chunk_seq", "score")


@query(f"""with __RESOURCES__, {_QV}, s as (select resource_id, rel_path, source_id, round(list_cosine_similarity(v, qv), 6) as score, status <> 'ok' as stale from vectors join resources using (resource_id), qv where level = 'summary' order by score desc, resource_id limit 50)
select resource_id, rel_path as path, score, stale from s where starts_with(rel_path, 'src1')""")
def hits_trimmed(spark, d):
    resources, vectors = _store(spark, d)
    return rank.trimmed_hits(rank.vector_search(vectors, resources, _asked(spark, d), 50), "src1")


@query("with __RESOURCES__ select source_id, count(*) as resources, count(v.resource_id) as with_vector from resources left join (select resource_id from vectors where level = 'summary') v using (resource_id) group by 1")
def has_vector(spark, d):
    resources, vectors = _store(spark, d)
    have = vectors.where("level = 'summary'").select("resource_id").distinct().withColumn("v", F.lit(1))
    return resources.join(have, "resource_id", "left").groupBy("source_id").agg(F.count("*").alias("resources"), F.count("v").alias("with_vector"))


@query(r"""with __RESOURCES__, a as (select 'v' as c, resource_id, level, rel_path, row_number() over (order by score desc, resource_id, level) as r from (select resource_id, level, rel_path, doc_id / 7.0 as score from vectors join resources using (resource_id) where doc_id % 4 < 2)),
b as (select 'k' as c, resource_id, 'summary' as level, 'keyword' as rel_path, row_number() over (order by doc_id desc, resource_id) as r from resources where doc_id % 4 in (1, 2)), u as (select * from a union all select * from b)
select resource_id, level, round(sum(1.0::double / (60 + r)), 6) as score, arg_max(rel_path, c) as rel_path from u group by all""")
def rrf_levels(spark, d):
    """Fusion by id and level; the path is the first list's."""
    resources, vectors = _store(spark, d)
    one = vectors.join(resources, "resource_id").where("doc_id % 4 < 2").select("resource_id", "level", "rel_path", (F.col("doc_id") / 7.0).alias("score"))
    two = resources.where("doc_id % 4 in (1, 2)").select("resource_id", F.lit("summary").alias("level"), F.lit("keyword").alias("rel_path"), F.col("doc_id").cast("double").alias("score"))
    return rank.fuse([one, two], ["resource_id", "level"], detail=("rel_path",), whole=True)


@query("""with __RESOURCES__, n as (select source_id, case when source_id = 'src3' and doc_id % 2 = 0 then 'moved/' || rel_path else rel_path end as rel_path, case when doc_id % 11 = 0 then 'x' || file_hash else file_hash end as h, resource_id, file_hash from resources where source_id in ('src3', 'src5', 'src6') and doc_id % 10 > 0),
o as (select * from resources where source_id in ('src3', 'src5', 'src6') and doc_id % 13 > 0), p as (select coalesce(o.source_id, n.source_id) as source_id, coalesce(o.rel_path, n.rel_path) as rel_path, o.rel_path is null as is_new, n.rel_path is null as is_gone, o.file_hash as oh, h, o.resource_id from o full join n on o.source_id = n.source_id and o.rel_path = n.rel_path),
g as (select source_id, oh, rel_path, row_number() over (partition by oh order by source_id || chr(1) || rel_path) as i from p where is_gone), c as (select source_id, h, rel_path, row_number() over (partition by h order by source_id || chr(1) || rel_path) as i from p where is_new),
m as (select g.source_id as gs, g.rel_path as from_path, c.source_id as cs, c.rel_path as to_path from g join c on g.oh = c.h and g.i = c.i)
select p.source_id, rel_path, case when m.to_path is not null then 'moved' when is_new then 'added' when is_gone then 'deleted' when oh <> h then 'updated' when resource_id in (select resource_id from vectors where level = 'summary') then 'unchanged' else 'enriched' end as action, m.from_path
from p left join m on m.cs = p.source_id and m.to_path = p.rel_path where (p.source_id, rel_path) not in (select (gs, from_path) from m)""")
def vector_sync(spark, d):
    """Three sources are synchronised; the others are left alone."""
    resources, vectors = _store(spark, d)
    mine = resources.where("source_id in ('src3', 'src5', 'src6') and doc_id % 10 > 0")
    path = F.when((F.col("source_id") == "src3") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path"))
    new = mine.withColumn("rel_path", path).withColumn("file_hash", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "file_hash")).otherwise(F.col("file_hash")))
    return sync.vector_sync(resources.where("doc_id % 13 > 0"), vectors, new)


def _chunk_sync(spark, d):
    resources, vectors = _store(spark, d)
    rows = resources.where("doc_id % 6 > 0")
    some = resources.select("source_id", "rel_path", (F.col("doc_id") % 5 > 0).alias("has_md"))
    parts = resources.where("doc_id % 5 > 0 and doc_id % 7 > 0").select("source_id", "rel_path", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"), F.lit("part").alias("chunk"))
    deep = ff.under_root(F.col("rel_path"), F.array(F.lit("src1"), F.lit("src2/en/"), F.lit("")))
    return store.chunks_synced(vectors.drop("embedding"), rows, some, deep, parts)


_SYNC = """cs as (select resource_id, doc_id, case when not (rel_path like 'src1/%' or rel_path like 'src2/en/%') then 'skipped_not_deep' when doc_id % 6 = 0 then 'skipped_no_resource' when doc_id % 5 = 0 then 'skipped_no_md' when doc_id % 7 = 0 then 'empty_doc' else 'documents' end as what from resources)"""


@query(f"with __RESOURCES__, {_SYNC} select what, count(*) as n, (case when what = 'documents' then 2 else 0 end * count(*))::bigint as chunks from cs group by 1")
def chunk_sync_counts(spark, d):
    return _chunk_sync(spark, d)[1]


@query(f"with __RESOURCES__, {_SYNC} select resource_id, level, chunk_seq, null as full_text from vectors where level <> 'chunk' or resource_id not in (select resource_id from cs where what = 'documents') union all select resource_id, 'chunk', i, 'part' from cs, (values (1), (2)) x(i) where what = 'documents'")
def chunk_sync(spark, d):
    return _chunk_sync(spark, d)[0].select("resource_id", "level", "chunk_seq", "full_text")


@query("with __RESOURCES__ select 'resources' as kind, count(*) as n from resources where source_id <> 'src4' union all select 'folders', count(*) from folders where source_id <> 'src4' union all select 'vectors', count(*) from vectors where resource_id not in (select resource_id from resources where source_id = 'src4')")
def source_delete(spark, d):
    resources, vectors = _store(spark, d)
    left = store.without_source(resources, t.folder_rows(spark, d), vectors, "src4")
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(left[0], "resources").unionByName(count(left[1], "folders")).unionByName(count(left[2], "vectors"))


@query("with __RESOURCES__ select resource_id, level, chunk_seq from vectors where level <> 'chunk' or resource_id not in (select resource_id from resources where source_id = 'src4')")
def chunks_delete(spark, d):
    """What turning a source's deep analysis off leaves."""
    resources, vectors = _store(spark, d)
    return store.without_chunks(vectors, resources, "src4").select("resource_id", "level", "chunk_seq")


@query("""with __RESOURCES__, m as (select source_id, rel_path, 'about ' || rel_path as s from folders where name = 'fr' union all select distinct source_id, source_id, 'the source' from folders)
select coalesce(f.source_id, m.source_id) as source_id, coalesce(f.rel_path, m.rel_path) as rel_path, coalesce(f.parent_dir, '') as parent_dir, coalesce(f.name, m.rel_path) as name, s as summary, coalesce(file_count, 0) as file_count from folders f full join m on f.source_id = m.source_id and f.rel_path = m.rel_path""")
def folders_upsert(spark, d):
    rows = t.folder_rows(spark, d)
    extra = lambda r, path, text: r.select("source_id", path.alias("rel_path"), text.alias("summary"), F.lit("d").alias("description"), F.array(F.lit("t")).alias("tags"))
    meta = extra(rows.where("name = 'fr'"), F.col("rel_path"), F.concat(F.lit("about "), "rel_path")).unionByName(extra(rows.select("source_id").distinct(), F.col("source_id"), F.lit("the source")))
    return store.folders_upserted(rows, meta).select("source_id", "rel_path", "parent_dir", "name", "summary", "file_count")


@query("with __RESOURCES__ select resource_id, case when doc_id % 3 = 0 then 'html/' || doc_id else 'old' end as html_path from resources")
def artifacts_upsert(spark, d):
    rows = t.resources(spark, d)
    made = lambda v: F.create_map(F.lit("html_path"), v)
    new = rows.where("doc_id % 3 = 0").select("resource_id", made(F.concat(F.lit("html/"), F.col("doc_id").cast("string"))).alias("artifacts"))
    out = store.artifacts_set(rows.withColumn("artifacts", made(F.lit("old"))), new)
    return out.select("resource_id", F.col("artifacts")["html_path"].alias("html_path"))


@query("""with __RESOURCES__ select source_id, parent_dir, count(*) as n, sha256(string_agg(name || ':' || file_hash, ',' order by name)) as entries from resources where status <> 'missing_source' group by all""")
def export_repo(spark, d):
    rows = store.exported_repository(t.resources(spark, d))
    return rows.select("source_id", "parent_dir", "n", F.sha2(F.array_join(F.transform("entries", lambda e: F.concat(e["path"], F.lit(":"), e["file_hash"])), ","), 256).alias("entries"))


@query("with __RESOURCES__ select 'added' as what, count(*) as n from resources where doc_id % 3 > 0 and source_id = 'src5' union all select 'known', count(*) from resources where doc_id % 3 = 0 and source_id = 'src5' union all select 'folders', count(distinct parent_dir) + 1 from resources where source_id = 'src5'")
def adopt_repo(spark, d):
    """A repository's documents are synchronised into a source that has a third of them, and its folders registered."""
    resources, vectors = _store(spark, d)
    own = resources.where("source_id = 'src5'")
    actions = sync.vector_sync(own.where("doc_id % 3 = 0"), vectors, own)
    counts = actions.groupBy(F.when(F.col("action") == "added", "added").otherwise("known").alias("what")).agg(F.count("*").alias("n"))
    dirs = folders.folder_set(own).agg(F.count("*").alias("n")).select(F.lit("folders").alias("what"), "n")
    return counts.unionByName(dirs)


@query("""with d as (select vec_id, embedding::double[] as v from embeddings where vec_id % 5 <> 2), qs as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (2, 7, 12)),
s as (select query_id, 'v' || vec_id as path, round(list_cosine_similarity(v, q), 6) as score from d, qs) select query_id, path, score from s qualify row_number() over (partition by query_id order by score desc, path) <= 10""")
def vector_index_topk(spark, d):
    """Exact searches in a stored index of cells."""
    rows = t.read(spark, d, "embeddings").where("vec_id % 5 <> 2").select(F.concat(F.lit("v"), "vec_id").alias("path"), "embedding")
    own = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    own.build(rows, F.col("embedding"), 64)
    every = t.read(spark, d, "embeddings")
    found = [own.search(rank.vector_of(every, q), 10).select(F.lit(q).cast("long").alias("query_id"), "path", "score") for q in (2, 7, 12)]
    return found[0].unionByName(found[1]).unionByName(found[2])


_ASKED = {"all": "select rel_path from files", "all twice": "select rel_path from files union all select rel_path from files", "without src1": "select rel_path from files where source <> 'src1'", "after the changes": "select rel_path from after", "before the changes": "select rel_path from before union all select rel_path from files where source = 'src1'"}


@query("with __FILES__, asked(what, path) as (" + " union all ".join(f"select '{n}', rel_path from ({q})" for n, q in _ASKED.items()) + "), w as (select distinct what from asked) select what, not exists (select rel_path from files except select path from asked a where a.what = w.what) and not exists (select path from asked a where a.what = w.what except select rel_path from files) as usable from w")
def index_usable(spark, d):
    """A vector index serves only exactly the documents it was made of, by the digest in its manifest; repetitions don't count."""
    rows = t.files(spark, d).select("rel_path", "source")
    path = lambda r: r.select(F.col("rel_path").alias("path"))
    own = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    own.build(path(rows), F.array(F.length("path").cast("double"), F.lit(1.0)), 2)
    asked = {"all": rows, "all twice": rows.unionByName(rows), "without src1": rows.where("source <> 'src1'"), "after the changes": t.after(spark, d), "before the changes": t.before(spark, d).select("rel_path", "source").unionByName(rows.where("source = 'src1'"))}
    return spark.createDataFrame([(what, own.usable(path(r), 2)) for what, r in asked.items()], "what string, usable boolean")


@query(f"""with {_PAIR_SQL}{_MOVES_SQL}, n as (select action, count(*) as n from cl group by 1) select what, coalesce(n, 0)::bigint as n from (values ('added'), ('updated'), ('moved'), ('deleted'), ('enriched'), ('unchanged')) w(what) left join n on n.action = what
union all select 'resources', count(*) from after union all select 'summary vectors', count(*) from after union all select 'chunk vectors', count(*) from after union all select 'folders', count(distinct parent_dir) from (select parent_dir from after union all select parent_dir from before) union all select 'files in folders', count(*) from after union all select 'remembered', count(*) from cl where action = 'updated' union all select 'version', 2""")
def enrich_flow(spark, d):
    """Two runs of the whole flow over both snapshots of the inventory as one source, each one commit: the second's report and what is stored then."""

    def entries(rows):
        md = F.concat(F.lit("# "), "name", F.lit("\n"), "file_hash")
        return rows.select("rel_path", "file_hash", "hash_algorithm", "size_bytes", "mtime", "ctime", F.concat(F.lit("file "), "name").alias("summary"), F.lit(None).cast("string").alias("content_description"), "category", F.array("category").alias("tags"), md.alias("md"))

    own = Manifests(spark, f"{shared_folder(spark)}/enrich-{uuid.uuid4().hex}")
    enrich.enriched(own, "all", entries(t.before(spark, d)), deep=True)
    report = enrich.enriched(own, "all", entries(t.after(spark, d)), deep=True)
    counted = spark.createDataFrame([(a, report[a]) for a in (*enrich.ACTIONS, "version")], "what string, n long")
    resources, stored, kept = (own.table(x) for x in ("resources", "vectors", "folders"))
    count = lambda name, rows, c=F.count("*"): rows.agg(c.alias("n")).select(F.lit(name).alias("what"), "n")
    more = [count("resources", resources), count("summary vectors", stored.where("level = 'summary' and embedding is not null")), count("chunk vectors", stored.where("level = 'chunk' and embedding is not null")), count("folders", kept), count("files in folders", kept, F.sum("file_count")), count("remembered", resources, F.count_if(F.size("prev_hashes") == 1))]
    for m in more:
        counted = counted.unionByName(m)
    return counted


# --- folders

_BELOW = "anc as (select parent_dir, name, unnest(range(1, len(string_split(parent_dir, '/')) + 1)) as i from after), dirs as (select array_to_string(string_split(parent_dir, '/')[1:i], '/') as dir, string_split(parent_dir, '/')[i + 1] as child, name from anc)"


@query(f"""with __FILES__, {_BELOW}, n as (select dir, string_agg(name, ',' order by name) as names from (select distinct dir, name from dirs qualify dense_rank() over (partition by dir order by name) <= 5) group by 1),
c as (select dir, string_agg(child, ',' order by child) as folders from (select distinct dir, child from dirs where child is not null qualify dense_rank() over (partition by dir order by child) <= 3) group by 1) select dir, names, folders from n left join c using (dir)""")
def folder_structure(spark, d):
    rows = folders.structure(t.after(spark, d), 3, 5)
    return rows.select("dir", F.array_join("names", ",").alias("names"), F.array_join("folders", ",").alias("folders"))


@query(f"with __FILES__, {_BELOW} select dir, row_number() over (order by len(string_split(dir, '/')), lower(dir)) as place from (select distinct dir from dirs)")
def folder_order(spark, d):
    """The order itself is what is asked for, of directories, which are few beside the files."""
    w = W.orderBy(F.size(F.split("dir", "/")), F.lower("dir"))
    return folders.in_tree_order(folders.folder_set(t.after(spark, d))).withColumn("place", F.row_number().over(w).cast("long"))


@query("with __RESOURCES__, asked as (select distinct source_id as rel_path from resources union select distinct parent_dir from resources) select rel_path, regexp_extract(rel_path, '[^/]*$') as name, coalesce(file_count, 0) as file_count, case when f.name is null then 'generated' else 'folders' end as source from asked left join folders f using (rel_path)")
def folder_entries(spark, d):
    rows = t.resources(spark, d)
    asked = rows.select(F.col("source_id").alias("rel_path")).union(rows.select("parent_dir")).distinct()
    return folders.entry_or_generated(asked, t.folder_rows(spark, d), rows).select("rel_path", "name", "file_count", "source")


@query("""with __FILES__, r as (select source as dir, count(*) as n, sum(size_bytes) as b, 1 as deep from files group by 1 union all select parent_dir, count(*), sum(size_bytes), 0 from files group by 1)
select dir, '目录 ' || dir || '：' || n || ' 个文件，共 ' || case when b < 1024 then b || 'B' when b < 1048576 then printf('%.1fKB', b / 1024.0::double) else printf('%.1fMB', b / 1048576.0::double) end || '，最深 ' || deep || ' 层' as summary from r""")
def folder_summaries(spark, d):
    rows = folders.rollup(t.files(spark, d))
    return rows.select("dir", walk.folder_summary(F.col("dir"), F.col("file_count"), F.col("total_size"), F.col("max_depth")).alias("summary"))


@query("with __FILES__ select distinct source as dir from files where source in ('src1', 'src2') union select distinct parent_dir from files where source in ('src1', 'src2')")
def folders_to_refresh(spark, d):
    return folders.refreshed(t.files(spark, d).where("source in ('src1', 'src2')"))


# --- plans

_FINAL = """__FILES__, p as (select row_number() over (order by doc_id) as idx, rel_path as from_path, case doc_id % 5 when 0 then rel_path when 1 then '' when 2 then 'other/' || name when 3 then 'src5/.index/' || name else 'src5/sorted/' || name end as to_path, source from files),
q as (select idx, from_path, to_path, case when source <> 'src5' then 'source outside root' when to_path not like 'src5/%' then 'target outside root' when contains(to_path, '/.index/') then 'repository internal' end as reason from p where to_path <> '' and to_path <> from_path)"""


def _proposal(spark, d):
    files = t.files(spark, d).drop("text")
    to = F.element_at(F.array(F.col("rel_path"), F.lit(""), F.concat(F.lit("other/"), "name"), F.concat(F.lit("src5/.index/"), "name"), F.concat(F.lit("src5/sorted/"), "name")), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return files.select(F.col("doc_id").alias("idx"), F.col("rel_path").alias("from_path"), to.alias("to_path")), files


@query(f"with {_FINAL} select from_path, to_path, reason from (select *, row_number() over (order by reason is not null, idx) as n from q) where reason is not null or n <= 4")
def plan_finalise(spark, d):
    plan, files = _proposal(spark, d)
    return reorganise.finalised(plan, "src5", files, 4).select("from_path", "to_path", "reason")


#: Deepest first, all are equally deep, so by path: German files swap places in pairs, English ones go to a new folder (some have changed since), Spanish
#: ones to a directory, French ones all to the place of the first of them; files of another root, and sources that don't exist.
_APPLY = """__FILES__, w as (select rel_path as from_path, doc_id, lang, name, file_hash, source, row_number() over (partition by source, lang order by rel_path) as i, doc_id % 2 = 1 as a from files where source in ('src5', 'src6')),
pr as (select x.from_path as p1, y.from_path as p2, x.file_hash = y.file_hash as same, x.a as a1, y.a as a2 from w x join w y on x.source = 'src5' and y.source = 'src5' and x.lang = 'de' and y.lang = 'de' and x.i % 2 = 1 and y.i = x.i + 1),
sw as (select p1 as from_path, p2 as to_path, case when same then 'noop' when not a2 then 'meta_only' else 'moved' end as result, case when not same and a2 then regexp_replace(p2, '[.]([^.]*)$', ' (1).\\1') end as target from pr
 union all select p2, p1, case when same then 'noop' when not a2 and not a1 then 'meta_only' else 'moved' end, case when not same then case when a2 then p1 when a1 then regexp_replace(p1, '[.]([^.]*)$', ' (1).\\1') end end from pr),
f1 as (select w.*, h.from_path as to_path, h.a as ta, w.file_hash <> h.file_hash as differs from w join w h on w.source = 'src5' and h.source = 'src5' and w.lang = 'fr' and h.lang = 'fr' and h.i = 1),
f2 as (select *, differs and not ta and coalesce(max(case when differs and a then 1 else 0 end) over (order by from_path rows between unbounded preceding and 1 preceding), 0) = 0 as meta from f1),
f3 as (select *, sum(case when differs and not meta then 1 else 0 end) over (order by from_path) as k from f2),
r as (select from_path, to_path, result, target from sw
 union all select from_path, 'src5/last/' || name, 'moved', 'src5/last/' || name from w where source = 'src5' and lang = 'de' and i % 2 = 1 and from_path not in (select p1 from pr)
 union all select from_path, 'src5/sorted/' || name, case when doc_id % 4 = 1 then 'stale_source' else 'moved' end, case when doc_id % 4 <> 1 then 'src5/sorted/' || name end from w where source = 'src5' and lang = 'en'
 union all select from_path, 'src5', 'conflict', null from w where source = 'src5' and lang = 'es'
 union all select from_path, to_path, case when not differs then 'noop' when meta then 'meta_only' else 'moved' end, case when differs and not meta then regexp_replace(to_path, '[.]([^.]*)$', ' (' || k || ').\\1') end from f3
 union all select from_path, 'elsewhere/' || name, 'rejected', null from w where source = 'src6'
 union all select 'src5/gone/' || doc_id, 'src5/x/' || doc_id, 'not_found', null from w where source = 'src5' and doc_id % 3 = 0)"""


def _applied(spark, d):
    files = t.files(spark, d).drop("text")
    by = W.partitionBy("source", "category").orderBy("rel_path")
    own = files.where("source in ('src5', 'src6')").withColumns({"i": F.row_number().over(by), "next": F.lead("rel_path").over(by), "last": F.lag("rel_path").over(by), "first": F.first("rel_path").over(by)})
    pair = F.when(F.col("i") % 2 == 0, F.col("last")).otherwise(F.coalesce("next", F.concat(F.lit("src5/last/"), "name")))
    to = (
        F.when(F.col("source") == "src6", F.concat(F.lit("elsewhere/"), "name"))
        .when(F.col("category") == "de", pair)
        .when(F.col("category") == "es", "src5")
        .when(F.col("category") == "fr", F.col("first"))
        .otherwise(F.concat(F.lit("src5/sorted/"), "name"))
    )
    gone = files.where("source = 'src5' and doc_id % 3 = 0").select(F.concat(F.lit("src5/gone/"), F.col("doc_id").cast("string")).alias("from_path"), F.concat(F.lit("src5/x/"), F.col("doc_id").cast("string")).alias("to_path"))
    plan = own.select(F.col("rel_path").alias("from_path"), to.alias("to_path")).unionByName(gone)
    then = own.where("category = 'en'").select("rel_path", F.when(F.col("doc_id") % 4 == 1, "changed since").otherwise(F.col("file_hash")).alias("file_hash"))
    return moves.applied(plan, then, files.withColumn("analysed", F.col("doc_id") % 2 == 1), "src5"), files


@query(f"with {_APPLY} select * from r")
def plan_apply(spark, d):
    return _applied(spark, d)[0]


@query(f"with {_APPLY} select count(*)::bigint as files, count(distinct target)::bigint as places from (select target from r where result = 'moved' union all select rel_path from files where rel_path not in (select from_path from r where result = 'moved')) where target is not null")
def plan_places(spark, d):
    """After a plan every file has a place of its own: as many places as files."""
    results, files = _applied(spark, d)
    gone = results.where("result = 'moved'")
    left = files.join(gone.select(F.col("from_path").alias("rel_path")), "rel_path", "left_anti").select(F.col("rel_path").alias("target"))
    return gone.select("target").unionByName(left).agg(F.count("*").alias("files"), F.count_distinct("target").alias("places"))


@query("with __FILES__ select parent_dir as dir from files where source in ('src5', 'src6') and lang in ('en', 'es') group by 1 having count(*) filter (lang = 'es' and doc_id % 2 = 0) = 0")
def plan_emptied_dirs(spark, d):
    """English files leave for one folder; of the Spanish ones, which go below the French ones' folder, those of even number stay."""
    files = t.files(spark, d).drop("text").withColumn("analysed", F.lit(True))
    go = files.where("source in ('src5', 'src6') and (category = 'en' or (category = 'es' and doc_id % 2 = 1))")
    to = F.when(F.col("category") == "en", F.concat("source", F.lit("/sorted/"), "name")).otherwise(F.concat("source", F.lit("/fr/x/"), "name"))
    plan = go.select(F.col("rel_path").alias("from_path"), to.alias("to_path"), "source")
    results = [moves.applied(plan.where(F.col("source") == root), files.select("rel_path", "file_hash"), files, root) for root in ("src5", "src6")]
    return reorganise.emptied(results[0].unionByName(results[1]), files)


@query("""with recursive __FILES__, u as (select *, row_number() over (partition by root order by lower(path)) as i from (select source as root, parent_dir as path, count(*) as n from files group by all)),
s as (select root, path, n, i, 0 as shard, n as held from u where i = 1 union all select u.root, u.path, u.n, u.i, s.shard + case when s.held > 0 and s.held + u.n > 20 then 1 else 0 end, case when s.held > 0 and s.held + u.n > 20 then u.n else s.held + u.n end from s join u on u.root = s.root and u.i = s.i + 1)
select root, path, n, shard from s""")
def plan_shards(spark, d):
    units = t.files(spark, d).groupBy(F.col("source").alias("root"), F.col("parent_dir").alias("path")).agg(F.count("*").alias("n"))
    return reorganise.shards(units, 20)


@query("with __FILES__ select source as plan_name, sha256('# ' || source || chr(10) || chr(10) || string_agg('- `' || rel_path || '` → `sorted/' || name || '`', chr(10) order by rel_path) || chr(10)) as md from files where doc_id % 9 = 0 group by 1")
def plan_markdown(spark, d):
    rows = t.files(spark, d).where("doc_id % 9 = 0").select(F.col("source").alias("plan_name"), F.col("rel_path").alias("from_path"), F.concat(F.lit("sorted/"), "name").alias("to_path"))
    return reorganise.plan_markdown(rows).select("plan_name", F.sha2("md", 256).alias("md"))


# --- registry

_SOURCES = """sup as (select s_suppkey as idx, case s_suppkey % 6 when 0 then 'bad alias!' when 1 then 'shared' else 'src-' || s_suppkey end as alias, case s_suppkey % 5 when 0 then 'ftp' when 1 then 'webdav' else 'local' end as protocol, case when s_suppkey % 7 = 0 then 'x' else 'rw' end as access_mode,
 case when s_suppkey % 4 = 0 then ' ' else '/data' end as root_path, case when s_suppkey % 11 = 1 then '' else 'http://h/' end as url, case s_suppkey % 3 when 0 then '1' when 1 then 'often' else '90' end as given from supplier)"""


def _sources(spark, d):
    k = F.col("s_suppkey")
    return t.read(spark, d, "supplier").select(
        k.alias("idx"), F.when(k % 6 == 0, "bad alias!").when(k % 6 == 1, "shared").otherwise(F.concat(F.lit("src-"), k.cast("string"))).alias("alias"),
        F.when(k % 5 == 0, "ftp").when(k % 5 == 1, "webdav").otherwise("local").alias("protocol"), F.when(k % 7 == 0, "x").otherwise("rw").alias("access_mode"),
        F.when(k % 4 == 0, " ").otherwise("/data").alias("root_path"), F.when(k % 11 == 1, "").otherwise("http://h/").alias("url"),
        F.when(k % 3 == 0, "1").when(k % 3 == 1, "often").otherwise("90").alias("interval_minutes"), F.lit("h").alias("host"), F.lit("0").alias("port"), F.lit("").alias("username"),
    )


@query(f"""with {_SOURCES} select idx, case given when '1' then 5 when '90' then 90 else 60 end as interval_minutes, case when protocol = 'local' then 'nas_local_local_0_uanon' else 'nas_' || protocol || '_h_0_uanon' end as schema_name,
 case when alias = 'bad alias!' then 'alias' when protocol = 'ftp' then 'protocol' when access_mode = 'x' then 'access_mode' when protocol = 'local' and root_path = ' ' then 'root_path' when protocol = 'webdav' and url = '' then 'url' when alias = 'src-2' or row_number() over (partition by alias order by idx) > 1 then 'alias exists' end as problem from sup""")
def source_create(spark, d):
    known = spark.createDataFrame([("src-2",)], "alias string")
    return registry.created(known, _sources(spark, d)).select("idx", "interval_minutes", "schema_name", "problem")


@query("select s_suppkey as source_id, case when s_suppkey % 2 = 0 then 'new' else s_name end as alias, case when s_suppkey % 3 = 0 then 'secret' else 'old' end as password, s_nationkey as owner from supplier")
def source_update(spark, d):
    """Aliases of every other source change, passwords of every third; a mask and a field that may not be set are ignored."""
    k = F.col("s_suppkey")
    rows = t.read(spark, d, "supplier")
    have = rows.select(k.alias("source_id"), F.col("s_name").alias("alias"), F.lit("old").alias("password"), F.col("s_nationkey").alias("owner"))
    changes = rows.select(k.alias("source_id"), F.when(k % 2 == 0, "new").alias("alias"), F.when(k % 3 == 0, "secret").when(k % 3 == 1, registry.MASK).alias("password"), F.lit(-1).alias("owner"))
    return registry.patched(have, changes, ("alias", "password"))


@query("""with i as (select distinct lower(n_name) as protocol, replace(lower(n_name), ' ', '-') as host, n_regionkey as port, case when n_nationkey % 2 = 0 then '' else 'U' end as username, n_nationkey % 3 = 0 as known from nation)
select protocol, host, port, username, case when known then 'old' else 'new' end as label from i""")
def tenants(spark, d):
    """A third of the identities are registered; asking for one twice, or in another case, adds none."""
    rows = t.read(spark, d, "nation").select(F.col("n_name").alias("protocol"), F.translate("n_name", " ", "-").alias("host"), F.col("n_regionkey").cast("string").alias("port"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("U").alias("username"), (F.col("n_nationkey") % 3 == 0).alias("known"))
    low = [F.lower("protocol").alias("protocol"), F.lower("host").alias("host"), F.col("port").cast("int").alias("port"), "username"]
    have = rows.where("known").select(*low, F.lit("x").alias("schema_name"), F.lit("old").alias("label"))
    asked = rows.withColumn("label", F.lit("new"))
    return registry.tenants(have, asked.unionByName(asked.withColumn("host", F.concat("host", F.lit("."))))).select("protocol", "host", "port", "username", "label")


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'smb' when 1 then 'webdav' else 'local' end as protocol, case s_suppkey % 3 when 0 then 'office' when 1 then 'dav.example.org' else 'local' end as host, case s_suppkey % 3 when 0 then 445 when 1 then case when s_suppkey % 2 = 0 then 8443 else 443 end else 0 end as port from supplier")
def identity_resolve(spark, d):
    k = F.col("s_suppkey")
    root = F.when(k % 3 == 1, F.concat(F.lit("https://me@DAV.example.org."), F.when(k % 2 == 0, ":8443").otherwise(""), F.lit("/x/"), k.cast("string"))).otherwise(F.concat(F.lit("/srv/"), k.cast("string")))
    asked = t.read(spark, d, "supplier").select(k, root.alias("root"), F.when(k % 3 == 0, "Office").alias("alias"), F.lit("me").alias("user"))
    configured = spark.createDataFrame([("Office", "SMB", "Office", "445", "u")], "alias string, protocol string, host string, port string, username string")
    rows = registry.resolved_identity(asked, configured)
    return asked.select("s_suppkey", "root").join(rows, "root").select("s_suppkey", "protocol", "host", "port")


@query("""select 'nas_' || lower(n_name) || '_x' as schema_name, n_regionkey from nation where false union all select 'nas_smb_' || lower(replace(n_name, ' ', '_')) || '_' || case when n_regionkey = 1 then '9' else '0' end || '_uanon', n_regionkey from nation""")
def rebind(spark, d):
    """The hosts of one region change their port."""
    n = t.read(spark, d, "nation").select(F.lit("smb").alias("protocol"), F.lower(F.translate("n_name", " ", "-")).alias("host"), F.lit(0).alias("port"), F.lit("").alias("username"), "n_regionkey")
    identity = F.struct("protocol", "host", "port", "username")
    have = n.withColumn("schema_name", ff.schema_name(identity))
    changes = n.where("n_regionkey = 1").select("protocol", "host", "port", "username", F.lit(None).cast("string").alias("new_host"), F.lit(9).alias("new_port"), F.lit(None).cast("string").alias("new_username"))
    rows = store.rebound(have.drop("n_regionkey"), changes)
    return rows.join(n.select("host", "n_regionkey"), "host").select("schema_name", "n_regionkey")


@query("""with __RESOURCES__ select 'nas_' || source_id as schema_name, case when source_id = 'src1' then 'First' else 'smb://' || source_id || ':445 (u)' end as label, count(*) as resources, count(*) filter (status = 'ok') as ok from resources group by source_id union all select 'nas_empty', 'smb://empty:445 (u)', null, null""")
def tenant_options(spark, d):
    rows = t.resources(spark, d)
    hosts = rows.select(F.col("source_id").alias("host")).distinct().unionByName(spark.createDataFrame([("empty",)], "host string"))
    have = hosts.select(F.lit("smb").alias("protocol"), "host", F.lit(445).alias("port"), F.lit("u").alias("username"), F.concat(F.lit("nas_"), "host").alias("schema_name"), F.when(F.col("host") == "src1", "First").otherwise("").alias("label"))
    return registry.options(have, rows.withColumn("schema_name", F.concat(F.lit("nas_"), "source_id"))).select("schema_name", "label", "resources", "ok")


@query("with __RESOURCES__ select resource_id, case when doc_id % 3 > 0 then rel_path end as rel_path, case when doc_id % 3 = 0 then 'not found' end as problem from resources union all select 'none', null, 'not found'")
def resource_fetch(spark, d):
    rows = t.resources(spark, d)
    other = F.when(F.col("doc_id") % 3 == 0, "another").otherwise(F.upper("source_id"))
    asked = rows.select("resource_id", other.alias("source_id")).unionByName(spark.createDataFrame([("none", "src1")], "resource_id string, source_id string"))
    return registry.fetched(asked, rows).select("resource_id", "rel_path", "problem")


@query("with __RESOURCES__ select resource_id, case when size_bytes <= 2000 then sha256(to_base64(encode(text))) end as data, '/api/files/' || resource_id || '/download?src=' || source_id as url from resources")
def document_meta(spark, d):
    rows = registry.document_meta(t.resources(spark, d), most_bytes=2000)
    return rows.select("resource_id", F.sha2("data", 256).alias("data"), "url")


@query("with __RESOURCES__ select resource_id, case ext when 'jpg' then 'image' when 'mp4' then 'video' when 'pdf' then 'pdf' when 'xlsx' then 'office' when 'zip' then null else 'text' end as viewable, ext in ('txt', 'md', 'py') and size_bytes > 4000 as truncated, case when ext = 'zip' then 'unsupported_type' end as reason from resources")
def preview_decision(spark, d):
    rows = t.resources(spark, d).select("resource_id", registry.preview(F.col("ext"), F.col("size_bytes"), 4000).alias("p"))
    return rows.select("resource_id", "p.viewable", "p.truncated", "p.reason")


@query("with __FILES__, s as (select source as root, case doc_id % 4 when 0 then 'missing' when 1 then 'stale' else 'valid' end as status from files) select root, count(*) as total, count(*) filter (status = 'valid') as valid, count(*) filter (status = 'missing') as missing, count(*) filter (status = 'stale') as stale from s group by rollup (root)")
def roots_status(spark, d):
    k = F.col("doc_id") % 4
    return registry.roots_status(t.files(spark, d).select(F.col("source").alias("root"), F.when(k == 0, "missing").when(k == 1, "stale").otherwise("valid").alias("status")))


@query("select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 0 else user_id end as size, case when event_id % 5 = 0 or event_id % 5 = 2 then '' else event_type end as category from events")
def record_codec(spark, d):
    """Records as JSON: broken, with a number of another type, with a field missing; they come back with defaults."""
    k = F.col("event_id") % 5
    whole = F.to_json(F.struct(F.col("user_id").alias("size"), F.col("event_type").alias("category")))
    line = F.when(k == 0, "[1, 2]").when(k == 1, F.to_json(F.struct(F.lit("many").alias("size"), F.col("event_type").alias("category")))).when(k == 2, F.to_json(F.struct(F.col("user_id").alias("size")))).otherwise(whole)
    rows = t.read(spark, d, "events").select("event_id", registry.from_json_records(line, "size long, category string").alias("r"))
    return rows.select("event_id", F.when(F.col("r").isNotNull(), F.coalesce("r.size", F.lit(0))).alias("size"), F.coalesce("r.category", F.lit("")).alias("category"))


@query("""select key, value from (values ('enabled', 'true'), ('target_chars', '800'), ('limit_chars', '1200'), ('overlap_ratio', '0.12'), ('direct_return', 'false'), ('direct_return_similarity', '0.9'), ('max_context_chars', '5000'), ('top_n', '7'), ('min_score', '0.6'), ('chunker_version', '1'), ('no_hit_mode', 'designated'), ('mine', 'x')) c(key, value)""")
def configuration(spark, d):
    return registry.configured(spark.createDataFrame([("enabled", "true"), ("top_n", "7"), ("mine", "x"), ("no_hit_mode", " ")], "key string, value string"), spark)


@query("with __RESOURCES__ select source_id, count(*) filter (doc_id % 4 = 0) as changed, count(*) filter (doc_id % 4 = 0 and doc_id % 3 > 0) as analysed from resources group by 1")
def confirm_changes(spark, d):
    """A confirmed scan: the inventory is reconciled and everything stale is analysed again, whatever was selected."""
    rows = t.resources(spark, d)
    old = rows.withColumn("status", F.lit("ok"))
    new = rows.withColumn("mtime", F.when(F.col("doc_id") % 4 == 0, F.col("mtime") + 5).otherwise(F.col("mtime"))).withColumn("file_hash", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("n"), "file_hash")).otherwise(F.col("file_hash")))
    state = sync.reconciled(old, new).join(rows.select("rel_path", "source_id", "doc_id"), "rel_path")
    stale = F.col("status") == "stale_source"
    return state.groupBy("source_id").agg(F.count_if(stale).alias("changed"), F.count_if(stale & (F.col("doc_id") % 3 > 0)).alias("analysed"))


# --- chunks and evaluation

#: The chunks of all pages (page_id, seq, breadcrumb, chunk) with a limit and an overlap.
_CHUNK_SQL = r"""with recursive __MARKDOWN__, pre as (select page_id, string_split(regexp_replace(replace(regexp_replace(md, '\r\n?', chr(10), 'g'), chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) as l from markdown),
lines as (select page_id, unnest(l) as x, generate_subscripts(l, 1) as i from pre), marked as (select *, sum(case when regexp_matches(x, '^\s*(```|~~~)') then 1 else 0 end) over (partition by page_id order by i) as fences from lines),
kinds as (select *, fences % 2 = 0 and not regexp_matches(x, '^\s*(```|~~~)') and regexp_matches(x, '^\s{0,3}#{1,6}\s+\S') and not regexp_matches(regexp_extract(x, '^\s{0,3}#{1,6}\s+(.+?)\s*$', 1), '^#*$') as head from marked),
nums as (select *, sum(case when head then 1 else 0 end) over (partition by page_id order by i) as sec from kinds), heads as (select page_id, sec, length(regexp_extract(x, '^\s{0,3}(#{1,6})\s', 1)) as level, regexp_extract(x, '^\s{0,3}#{1,6}\s+(.+?)\s*$', 1) as title from nums where head),
secs as (select page_id, sec, regexp_replace(string_agg(x, chr(10) order by i), '^\s+|\s+$', '', 'g') as text, count(*) filter (trim(x) <> '') as filled, count(*) filter (starts_with(ltrim(x), '|')) as pipes from nums where not head group by all),
crumbs as (select a.page_id, a.sec, string_agg(b.title, ' ▸ ' order by b.sec) as crumb from heads a join heads b on a.page_id = b.page_id and b.sec <= a.sec and not exists (select 1 from heads c where c.page_id = a.page_id and c.sec > b.sec and c.sec <= a.sec and c.level <= b.level) group by all),
body as (select page_id, sec, coalesce(crumb, '') as crumb, text, length(text) as n, pipes >= greatest(2, floor(filled * 0.5)) as heavy from secs left join crumbs using (page_id, sec) where text <> ''),
win as (select page_id, sec, crumb, text, n, 0 as pos, case when n <= __LIMIT__ or heavy then n else 0 end as ready from body
 union all select page_id, sec, crumb, text, n, pos + greatest(1, cut - (cut * __OVERLAP__)::double::int + case when (cut * __OVERLAP__)::double::int > cut * __OVERLAP__ then 1 else 0 end), 0 from (select *, case when hit = 0 then w else hit end as cut from (select *, least(__LIMIT__, n - pos) as w,
  coalesce(case when position('x' in regexp_replace(substr(text, pos + 1 + greatest(1, least(__LIMIT__, n - pos) // 2), least(__LIMIT__, n - pos) - greatest(1, least(__LIMIT__, n - pos) // 2)), '[。！？!?；;\n]', 'x')) = 0 and false then 0
   else nullif(length(regexp_extract(substr(text, pos + 1 + greatest(1, least(__LIMIT__, n - pos) // 2), least(__LIMIT__, n - pos) - greatest(1, least(__LIMIT__, n - pos) // 2)), '(?s)^(.*[。！？!?；;\n])', 1)), 0) + greatest(1, least(__LIMIT__, n - pos) // 2) end, 0) as hit from win where ready = 0)) where pos + cut < n),
cuts as (select page_id, sec, crumb, text, n, pos, case when ready > 0 then ready else (select case when h = 0 then w else h end from (select least(__LIMIT__, n - pos) as w, coalesce(nullif(length(regexp_extract(substr(text, pos + 1 + greatest(1, least(__LIMIT__, n - pos) // 2), least(__LIMIT__, n - pos) - greatest(1, least(__LIMIT__, n - pos) // 2)), '(?s)^(.*[。！？!?；;\n])', 1)), 0) + greatest(1, least(__LIMIT__, n - pos) // 2), 0) as h)) end as len from win)
select page_id, row_number() over (partition by page_id order by sec, pos) as seq, crumb as breadcrumb, substr(text, pos + 1, len) as chunk from cuts where regexp_matches(substr(text, pos + 1, len), '\S')"""


def _chunk_sql(limit: int, overlap: float) -> str:
    return _CHUNK_SQL.replace("__LIMIT__", str(limit)).replace("__OVERLAP__", str(overlap))


@query(f"select page_id, seq, breadcrumb, sha256(chunk) as chunk from ({_chunk_sql(300, 0.12)})")
def chunk_small(spark, d):
    """Chunks of at most 300 characters, so that most sections are split."""
    rows = chunks.chunks(t.markdown(spark, d), limit=300)
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), "breadcrumb", F.sha2("chunk", 256).alias("chunk"))


def _oracle(sql: str) -> str:
    return sql.replace("__MARKDOWN__", t.markdown_sql())


_CHUNKS = f"ch as ({_chunk_sql(1200, 0.12)})"
ORACLES["chunk_markdown"] = _oracle(f"with {_CHUNKS} select page_id, seq::int as seq, breadcrumb, chunk from ch")
_CHUNK_TOKENS = "tok as (select page_id || '#' || seq as doc_id, regexp_extract_all(lower(chunk), '[a-z0-9_]+') as toks from ch)"
ORACLES["chunk_topk"] = _oracle(f"with {_CHUNKS}, {_CHUNK_TOKENS}, {FIXED_SQL}, {BM25_SQL} select doc_id as chunk_id, score from sc where score > 0 order by score desc, doc_id limit 10")


_BLANK = r"[\s\p{Z}]+"


@query(rf"""with c as (with recursive {_CHUNK_SQL[len("with recursive "):_CHUNK_SQL.index("heads as (select")].rstrip().rstrip(",")} select page_id, coalesce(string_agg(x, chr(10) order by i) filter (not head), '') as t from nums group by 1)
select page_id, sha256(regexp_replace(t, '{_BLANK}', '', 'g')) as body from c""")
def chunk_cover(spark, d):
    """Without overlap the chunks of a page hold everything but its headings, once and in order (blanks aside)."""
    md = t.markdown(spark, d)
    parts = chunks.chunks(md, limit=300, overlap=0.0)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    body = parts.groupBy("page_id").agg(whole.alias("t"))
    return md.select("page_id").join(body, "page_id", "left").select("page_id", F.sha2(F.regexp_replace(F.coalesce("t", F.lit("")), _BLANK, ""), 256).alias("body"))


#: Settings of the sweep, and its questions: pieces of every eleventh page, their anchors inside them.
SETTINGS = (("a", 200, 0.12), ("b", 400, 0.0), ("c", 1200, 0.12))
DIMENSIONS = 32


def _sweep(spark, d):
    md = t.markdown(spark, d, 4 * spark.sparkContext.defaultParallelism)
    made = chunks.chunks_by_setting(md, list(SETTINGS), dealt=True).withColumn("chunk_id", F.col("page_id") * 1_000_000 + F.col("seq"))
    asked = md.where("page_id % 11 = 3").select(F.col("page_id").alias("query_id"), F.substring("md", 120, 160).alias("question"), F.trim(F.regexp_replace(F.substring("md", 160, 40), "(?s)\n.*", "")).alias("anchor"))
    return made, asked


_SETTINGS_SQL = " union all ".join(f"select '{c}' as config, * from ({_chunk_sql(n, o)})" for c, n, o in SETTINGS)
_SWEEP = rf"""c as (select config, page_id * 1000000 + seq as chunk_id, chunk from ({_SETTINGS_SQL})), q as (select page_id as query_id, substr(md, 120, 160) as question, trim(regexp_replace(substr(md, 160, 40), '(?s)
.*', '')) as anchor from (with __MARKDOWN__ select * from markdown) where page_id % 11 = 3),
a as (select config, query_id, min(chunk_id) as chunk_id from c join q on anchor <> '' and contains(chunk, anchor) group by all)"""
_EMBEDDED = f"""w as (select 'c' as k, config, chunk_id, unnest(regexp_extract_all(lower(chunk), '[a-z0-9_]+')) as x from c union all select 'q', null, query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_]+')) from q),
e as (select k, config, chunk_id, ('0x' || substr(md5(x), 1, 4))::int % {DIMENSIONS} as i, sum(case when ('0x' || substr(md5(x), 5, 4))::int % 2 = 0 then 1.0::double else -1 end) as v from w group by all having v <> 0),
n as (select k, config, chunk_id, sqrt(sum(v * v)) as l from e group by all),
cs as (select e.config, e.chunk_id, f.chunk_id as query_id, sum(e.v * f.v) as s from e join e f on e.k = 'c' and f.k = 'q' and e.i = f.i group by all),
sc as (select x.config, y.chunk_id as query_id, x.chunk_id, round(coalesce(s, 0) / (x.l * y.l), 6) as score from n x join n y on x.k = 'c' and y.k = 'q' left join cs on cs.config = x.config and cs.chunk_id = x.chunk_id and cs.query_id = y.chunk_id),
r as (select config, query_id, chunk_id, score, row_number() over (partition by config, query_id order by score desc, chunk_id) as rank from sc qualify rank <= 5)"""


@query(f"with {_SWEEP} select config, query_id, chunk_id from a")
def first_anchors(spark, d):
    """The first chunk that holds a question's anchor, in each setting: all anchors by one automaton."""
    made, asked = _sweep(spark, d)
    return answer.first_anchors(asked, made)


def _embedded(rows, c, *columns):
    return rank.text_embeddings(rows, list(columns), c, DIMENSIONS)


@query(f"with {_SWEEP}, {_EMBEDDED} select config, query_id, chunk_id, rank::int as rank from r")
def chunk_ranks(spark, d):
    """The nearest chunks of each question by an embedding of hashed tokens, in each setting."""
    made, asked = _sweep(spark, d)
    return answer.chunk_ranks(_embedded(made, "chunk", "config", "chunk_id"), _embedded(asked, "question", "query_id")).select("config", "query_id", "chunk_id", "rank")


@query(f"""with {_SWEEP}, {_EMBEDDED}, z as (select config, count(*) as n_chunks from c group by 1), h as (select config, query_id, rank from a left join r using (config, query_id, chunk_id)),
s as (select z.config, n_chunks, count(query_id) as scored, round(coalesce(avg(case when query_id is null then null when rank <= 3 then 1.0 else 0 end), 0), 4) as recall_3, round(coalesce(avg(case when query_id is null then null when rank <= 5 then 1.0 else 0 end), 0), 4) as recall_5 from z left join h using (config) group by all)
select *, row_number() over (order by recall_5 desc, recall_3 desc, n_chunks, config) = 1 as best from s""")
def chunk_sweep(spark, d):
    """Recall of the anchored chunks by setting, from real chunks and real ranks, and the best setting. Chunks and their embeddings are made once and stored in the shared folder, as are the questions and their anchors."""
    rounds = Rounds(spark, "sweep")
    made, asked = _sweep(spark, d)
    asked = rounds.put("asked", _embedded(asked, "question", "query_id", "anchor"))
    made = rounds.put("chunks", _embedded(made, "chunk", "config", "chunk_id", "chunk"))
    anchors = rounds.put("anchors", answer.first_anchors(asked, made))
    return answer.swept(anchors, answer.anchor_ranks(anchors, made, asked), made.groupBy("config").agg(F.count("*").alias("n_chunks")))


_QUESTION_TERMS = r"q as (select page_id as query_id, unnest(list_distinct(regexp_extract_all(lower(substr(md, 120, 160)), '[a-z0-9_]+'))) as term from (with __MARKDOWN__ select * from markdown) where page_id % 11 = 3)"
_TOP = "select query_id, doc_id, text, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc join tx using (doc_id) where score > 0 qualify rank <= 5"


@query(f"""with de as (with {_CHUNKS}, tx as (select 'page ' || lpad(page_id::varchar, 9, '0') || ' chunk ' || lpad(seq::varchar, 6, '0') as doc_id, chunk as text from ch), tok as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as toks from tx), {_QUESTION_TERMS}, {BM25_SQL} {_TOP}),
ba as (with tx as (select 'page ' || lpad(page_id::varchar, 9, '0') as doc_id, md as text from (with __MARKDOWN__ select * from markdown)), tok as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as toks from tx), {_QUESTION_TERMS}, {BM25_SQL} {_TOP}),
x as (select page_id as query_id, case when page_id % 3 = 0 then '' else 'page ' || lpad(page_id::varchar, 9, '0') || '|no such text' end as expect, 'page ' || lpad(page_id::varchar, 9, '0') as own from (with __MARKDOWN__ select * from markdown) where page_id % 11 = 3),
h as (select expect <> '' as scored, exists (select 1 from de where de.query_id = x.query_id and starts_with(de.doc_id, own)) as d, exists (select 1 from ba where ba.query_id = x.query_id and ba.doc_id = own) as b, exists (select 1 from de where de.query_id = x.query_id and rank = 1 and trim(text) <> '') as da, exists (select 1 from ba where ba.query_id = x.query_id and rank = 1 and trim(text) <> '') as ba from x)
select count(*) as total, count(*) filter (scored) as scored, count(*) filter (scored and d) as deep_hit, count(*) filter (scored and b) as base_hit, round(count(*) filter (da) / count(*), 4) as deep_answer_rate, round(count(*) filter (ba) / count(*), 4) as base_answer_rate from h""")
def two_path_eval(spark, d):
    """Questions answered from the best chunks and from the best pages, by two searches, evaluated side by side."""
    md = t.markdown(spark, d)
    name = lambda *seq: F.concat(F.lit("page "), F.lpad(F.col("page_id").cast("string"), 9, "0"), *(x for c in seq for x in (F.lit(" chunk "), F.lpad(F.col(c).cast("string"), 6, "0"))))
    asked = md.where("page_id % 11 = 3").select(F.col("page_id").alias("query_id"), ft.search_tokens(F.substring("md", 120, 160)).alias("terms"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(name(), F.lit("|no such text"))).alias("expect"))
    ways = (chunks.chunks(md).select(name("seq").alias("doc_id"), F.col("chunk").alias("text")), md.select(name().alias("doc_id"), F.col("md").alias("text")))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    deep, base = (rank.bm25(rows, asked, 5).withColumn("rank", F.row_number().over(by)).join(rows, "doc_id").select("query_id", "rank", F.col("doc_id").alias("path"), "text") for rows in ways)
    rows = answer.both_paths(deep, base, asked.select("query_id", "expect"), 5)
    return answer.evaluated(rows).select("total", "scored", "deep_hit", "base_hit", "deep_answer_rate", "base_answer_rate")


@query(f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as x from documents), e as (select doc_id, ('0x' || substr(md5(x), 1, 4))::int % 16 as i, sum(case when ('0x' || substr(md5(x), 5, 4))::int % 2 = 0 then 1 else -1 end) as v from w group by all having v <> 0)
select doc_id, string_agg(i || ':' || v, ' ' order by i) as embedding from e group by 1""")
def hashed_embedding(spark, d):
    """The embeddings of whole texts, place by place."""
    rows = rank.hashed_embeddings(t.spread(docs(spark, d).select("doc_id", "text")), ["doc_id"], ft.search_tokens(F.col("text")), 16).where("embedding is not null")
    marks = F.filter(F.transform("embedding", lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), v.cast("long").cast("string")))), lambda x: x.isNotNull())
    return rows.select("doc_id", F.array_join(marks, " ").alias("embedding"))
