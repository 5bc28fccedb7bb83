"""All queries of the reference's operators, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import text as ft
from ..operators import answer, chunks, folders, index, lifecycle, rank, registry, reorganise, store, sync
from ..sources import tables as t
from ..sources.shelf import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("__RESOURCES__", f"__FILES__, {t.RESOURCES_SQL}").replace("__FILES__", t.FILES_SQL).replace("__MARKDOWN__", t.markdown_sql())
        return f

    return add


def docs(spark, d):
    return t.read(spark, d, "documents")


# --- tokens and corpus statistics

_TOK = "tok as (select doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9_]+') as toks from documents)"


@query(f"with {_TOK} select doc_id, len(toks)::bigint as n_tokens, len(list_distinct(toks))::bigint as n_terms, coalesce(list_max(toks), '') as last_term from tok")
def tokens_a(spark, d):
    rows = docs(spark, d).select("doc_id", ft.search_tokens(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_terms"), F.coalesce(F.array_max("x"), F.lit("")).alias("last_term"))


@query(r"""select conv_id, turn, len(x)::bigint as n_tokens, array_to_string(list_filter(x, lambda p: length(p) >= 2)[1:32], ' | ') as terms
from (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda p: p <> '') as x from conversations)""")
def tokens_b(spark, d):
    rows = t.read(spark, d, "conversations").select("conv_id", "turn", ft.keyword_tokens(F.col("text")).alias("x"), ft.keyword_terms(F.col("text")).alias("q"))
    return rows.select("conv_id", "turn", F.size("x").cast("long").alias("n_tokens"), F.array_join("q", " | ").alias("terms"))


@query(f"with {_TOK} select count(*) as n, round(avg(len(toks)), 6) as avgdl, sum(len(toks))::bigint as tokens from tok")
def corpus_stats(spark, d):
    rows = docs(spark, d).select(F.size(ft.search_tokens(F.col("text"))).alias("dl"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("tokens"))


@query(f"""with {_TOK}, f as (select term, count(*) as df from (select distinct doc_id, unnest(toks) as term from tok) group by term)
select term, df, round(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)), 6) as idf from f""")
def term_idf(spark, d):
    df = rank.document_frequencies(docs(spark, d))
    n = docs(spark, d).agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(rank.inverse_frequency(F.col("n"), F.col("df")), 6).alias("idf"))


# --- ranking

TERMS = ("the", "retition", "of", "erent", "eaux")
_BM25 = """ dl as (select doc_id, len(toks) as dl from tok), st as (select count(*) as n, avg(dl) as avgdl from dl),
 tf as (select doc_id, term, count(*) as f from (select doc_id, unnest(toks) as term from tok) join (select distinct term from q) using (term) group by all),
 df as (select term, count(*) as c from tf group by all),
 sc as (select query_id, doc_id, round(sum(ln(1 + (n - c + 0.5) / (c + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (term) join dl using (doc_id) join q using (term) cross join st group by all)"""
_FIXED = "q(query_id, term) as (values " + ", ".join(f"(0, '{x}')" for x in TERMS) + ")"


def _fixed(spark):
    return spark.createDataFrame([(0, list(TERMS))], "query_id int, terms array<string>")


@query(f"with {_TOK}, {_FIXED}, {_BM25} select doc_id, score from sc where score > 0 order by score desc, doc_id limit 10")
def bm25_topk(spark, d):
    return rank.bm25(docs(spark, d), _fixed(spark), 10).select("doc_id", "score")


@query(f"""with {_TOK}, q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark), {_BM25}
select query_id, doc_id, score from sc where score > 0 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 3""")
def bm25_multi_query(spark, d):
    asked = t.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ft.search_tokens(F.col("text")).alias("terms"))
    return rank.bm25(docs(spark, d), asked, 3)


@query(f"with {_TOK}, {_FIXED}, {_BM25} select doc_id, score from sc join tok using (doc_id) where score > 0 and lang = 'fr' order by score desc, doc_id limit 10")
def bm25_kind_filter(spark, d):
    return rank.bm25(docs(spark, d), _fixed(spark), 10, keep=F.col("lang") == "fr").select("doc_id", "score")


_COS = """e as (select vec_id, label, embedding::double[] as v from embeddings), qv as (select v as qv from e where vec_id = 7),
 sc as (select vec_id, label, round(list_cosine_similarity(v, qv), 6) as score from e, qv)"""


def _vectors(spark, d):
    rows = t.read(spark, d, "embeddings")
    return rows, rank.vector_of(rows, 7)


@query(f"with {_COS} select vec_id, score from sc order by score desc, vec_id limit 10")
def cosine_topk(spark, d):
    return rank.cosine_top(*_vectors(spark, d))


@query(f"with {_COS} select vec_id, score from sc where label in (1, 3, 5) order by score desc, vec_id limit 10")
def cosine_topk_filtered(spark, d):
    return rank.cosine_top(*_vectors(spark, d), keep=F.col("label").isin(1, 3, 5))


@query(f"with {_COS} select vec_id, score from sc where score >= 0.2 order by score desc, vec_id limit 100")
def cosine_min_score(spark, d):
    return rank.cosine_top(*_vectors(spark, d), k=100, score_min=0.2)


@query(f"with {_COS} select label, vec_id, score from sc qualify row_number() over (partition by label order by score desc, vec_id) <= 5")
def fanout_per_schema(spark, d):
    return rank.fan_out(*_vectors(spark, d), "label", 5)


@query(f"with {_COS} select label, vec_id, score from (select * from sc qualify row_number() over (partition by label order by score desc, vec_id) <= 5) order by score desc, vec_id limit 10")
def fanout_global_topk(spark, d):
    return rank.top(rank.fan_out(*_vectors(spark, d), "label", 5), 10, "vec_id")


PHRASE = "idiot The eaux"
_WORDS = r"""words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents))"""
_KEY = f"""{_WORDS}, kw as (select doc_id as id, round(0.1 * count(*)::double, 6) as score from words where word in ('idiot', 'the', 'eaux') group by 1), kc as (select * from kw where score > 0 order by score desc, id limit 50)"""
_VC = "vc as (select vec_id as id, score from sc order by score desc, vec_id limit 50)"
_RRF = """fused as (select id, round(sum(1.0::double / (60 + r)), 6) as score from (
  select id, row_number() over (order by score desc, id) as r from vc union all select id, row_number() over (order by score desc, id) as r from kc) group by id)"""


def _channels(spark, d):
    vector = rank.cosine_top(*_vectors(spark, d), k=rank.CANDIDATES).withColumnRenamed("vec_id", "id")
    return [vector, rank.keyword_top(docs(spark, d), PHRASE).withColumnRenamed("doc_id", "id")]


@query(f"with {_KEY} select id as doc_id, score from kc")
def keyword_topk(spark, d):
    return rank.keyword_top(docs(spark, d), PHRASE)


#: Places of three terms, the last place of each so far, and the covers: they end where the earliest of these moves on.
_COVERS = f"""{_WORDS}, e as (select doc_id, pos, case word when 'the' then 1 when 'of' then 2 else 3 end as g, row_number() over (partition by doc_id order by pos) as i from words where word in ('the', 'of', 'and')),
l as (select doc_id, pos, i, max(case when g = 1 then i end) over w as a, max(case when g = 2 then i end) over w as b, max(case when g = 3 then i end) over w as c from e window w as (partition by doc_id order by i)),
f as (select *, case when a is not null and b is not null and c is not null then least(a, b, c) end as s from l),
cv as (select x.doc_id, x.i, x.pos, x.s, y.pos as p from (select *, lag(s) over (partition by doc_id order by i) as before from f) x join e y on y.doc_id = x.doc_id and y.i = x.s where x.s is not null and (x.before is null or x.s > x.before)),
ks as (select doc_id, round(sum(0.1::double / (1 + (pos - p) - (i - s))), 6) as score from cv group by 1)"""


@query(f"with {_COVERS} select doc_id, score from ks order by score desc, doc_id limit 20")
def keyword_covers(spark, d):
    """All of three terms, by cover density."""
    return rank.keyword_top(docs(spark, d), "The of and", 20, every=True)


@query(f"with {_COS}, {_KEY}, {_VC}, {_RRF} select id, score from fused")
def rrf_fusion(spark, d):
    return rank.fuse(_channels(spark, d), "id")


@query(f"with {_COS}, {_KEY}, {_VC}, {_RRF} select id, score from fused order by score desc, id limit 10")
def hybrid_topk(spark, d):
    return rank.fuse(_channels(spark, d), "id", 10)


@query(f"""with __FILES__, {_TOK}, {_FIXED}, {_BM25} select doc_id, score from (select * from sc where score > 0 order by score desc, doc_id limit 50) join files using (doc_id) where starts_with(rel_path, 'src1')""")
def prefix_filter_post_limit(spark, d):
    """The prefix is tested on the global top k, as text and not by folder."""
    hits = rank.bm25(docs(spark, d), _fixed(spark), 50)
    return hits.join(t.files(spark, d).where(F.col("rel_path").startswith("src1")).select("doc_id"), "doc_id").select("doc_id", "score")


@query("with __FILES__ select rel_path from files where rel_path like 'src1/%' or rel_path like 'src4/en/%'")
def deep_roots_filter(spark, d):
    roots = F.array(F.lit("src1"), F.lit("src4\\en/"))
    return t.files(spark, d).where(ff.under_root(F.col("rel_path"), roots)).select("rel_path")


# --- the stored index


def _index(spark, make=index.InvertedIndex, name="search"):
    return make(spark, f"{shared_folder(spark)}/index-{name}-{uuid.uuid4().hex}")


#: Documents after the changes that the index queries make: those of src1 are shortened, those of src2 forgotten.
_CHANGED = "tok as (select doc_id, lang, regexp_extract_all(lower(case when source = 'src1' then text[1:400] else text end), '[a-z0-9_]+') as toks from documents where source <> 'src2')"


def _changed_index(spark, d, make=index.InvertedIndex):
    own = _index(spark, make)
    rows = docs(spark, d)
    own.upsert(rows.select("doc_id", "text"))
    own.upsert(rows.where("source = 'src1'").select("doc_id", F.substring("text", 1, 400).alias("text")), rows.where("source = 'src2'"))
    return own


@query(f"with {_CHANGED}, {_FIXED}, {_BM25} select doc_id, score from sc where score > 0 order by score desc, doc_id limit 10")
def index_bm25_topk(spark, d):
    """From the stored postings of two segments; the corpus isn't read by the search."""
    return _changed_index(spark, d).bm25(_fixed(spark), 10).select("doc_id", "score")


@query(f"""with {_CHANGED}, q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark), {_BM25}
select query_id, doc_id, score from sc join tok using (doc_id) where score > 0 and lang = 'en' qualify row_number() over (partition by query_id order by score desc, doc_id) <= 3""")
def index_bm25_multi_query(spark, d):
    asked = t.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ft.search_tokens(F.col("text")).alias("terms"))
    return _changed_index(spark, d).bm25(asked, 3, keep=docs(spark, d).where("lang = 'en'"))


@query(f"""with {_CHANGED}, f as (select term, count(*) as df from (select distinct doc_id, unnest(toks) as term from tok) group by term)
select term, df, n, round(avgdl, 6) as avgdl from f, (select count(*) as n, avg(len(toks)) as avgdl from tok)""")
def index_frequencies(spark, d):
    own = _changed_index(spark, d)
    return own.frequencies().crossJoin(F.broadcast(own.statistics())).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {_COVERS} select doc_id, score from ks order by score desc, doc_id limit 20")
def index_covers(spark, d):
    own = _index(spark, index.keyword_index, "keywords")
    own.upsert(docs(spark, d).select("doc_id", "text"))
    return own.keywords("The of and", 20, every=True)


# --- fingerprints, names, sizes, identities, headers


@query("select doc_id, sha256(text) as fingerprint, case when strlen(text) <= 524288 then 'full' else 'sampled' end as algorithm from documents")
def fingerprint_full(spark, d):
    return docs(spark, d).select("doc_id", ff.fingerprint(F.col("text")).alias("fingerprint"), F.when(F.octet_length("text") <= ff.WHOLE, "full").otherwise("sampled").alias("algorithm"))


@query("""select p_partkey, i, (i * (size - 65536)) // 7 as start from (select p_partkey, (p_partkey * 1000 + 1)::bigint as size, unnest(range(8)) as i from part) where size > 524288""")
def fingerprint_sample_spans(spark, d):
    size = (F.col("p_partkey") * 1000 + 1).cast("long")
    rows = t.read(spark, d, "part").select("p_partkey", F.posexplode(ff.sample_spans(size)).alias("i", "s"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), F.col("s.start").alias("start"))


@query("select sha256(text) as file_hash, count(*) as n, min(doc_id) as keep from documents group by 1 having count(*) > 1")
def dup_groups(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")).where("n > 1")


@query("""with __FILES__ select case when ext in ('txt', 'md', 'pdf', 'xlsx') then '文档' when ext = 'jpg' then '图片' when ext = 'mp4' then '视频' when ext = 'zip' then '压缩包' when ext = 'py' then '代码' else '其他' end as category, ext, count(*) as n
from files group by all""")
def ext_category(spark, d):
    rows = t.files(spark, d).select(ff.extension_of(F.col("rel_path")).alias("ext"))
    return rows.groupBy(ff.category_of(F.col("ext")).alias("category"), "ext").agg(F.count("*").alias("n"))


@query("""with __FILES__, n as (select doc_id, case doc_id % 5 when 0 then name when 1 then 'Dockerfile' when 2 then '.gitignore' when 3 then 'notes' else 'a.RS' end as name, ext from files)
select doc_id, case doc_id % 5 when 1 then 'Docker 容器构建文件' when 2 then 'Git 忽略规则文件' when 3 then '无扩展名文件' when 4 then 'Rust 源代码' else case ext when 'zip' then 'ZIP 压缩包' when 'py' then 'Python 源代码' else '.' || ext || ' 类型文件' end end as meaning from n""")
def name_meaning(spark, d):
    kind = F.pmod("doc_id", F.lit(5))
    name = F.when(kind == 0, F.col("name")).when(kind == 1, "Dockerfile").when(kind == 2, ".gitignore").when(kind == 3, "notes").otherwise("a.RS")
    return t.files(spark, d).select("doc_id", ff.meaning_of(name).alias("meaning"))


@query("with __FILES__ select doc_id, case when size_bytes < 1024 then size_bytes || 'B' when size_bytes < 1048576 then printf('%.1fKB', size_bytes / 1024.0::double) else printf('%.1fMB', size_bytes / 1048576.0::double) end as size from files")
def human_size(spark, d):
    return t.files(spark, d).select("doc_id", ff.human_size(F.col("size_bytes")).alias("size"))


@query("""with __FILES__ select doc_id, case when contains(rel_path, 'src1/') or (lang <> 'de' and size_bytes > 5400) then '媒体/影视' when lang = 'de' then '媒体/教学视频' else '媒体/个人录像' end as kind,
 case when contains(rel_path, 'src1/') or (lang <> 'de' and size_bytes > 5400) then 'metadata_only' when lang = 'de' then 'keyframes_only' else 'full' end as mode from files""")
def video_policy(spark, d):
    """One folder rule, then words in the name (German files are named lectures), then the length."""
    path = F.when(F.col("category") == "de", F.concat("parent_dir", F.lit("/Lecture "), "name")).otherwise(F.col("rel_path"))
    rows = t.files(spark, d).select("doc_id", ff.video_policy(path, F.col("size_bytes"), (("媒体/影视", "src1/", "metadata_only"),)).alias("v"))
    return rows.select("doc_id", "v.kind", "v.mode")


_IDENTITY = """ident as (select s_suppkey, case when s_nationkey < 3 then 'local' else lower(n_name) end as protocol, case when s_nationkey < 3 then 'local' else lower(replace(n_name, ' ', '-')) || '.example.com' end as host,
  case when s_nationkey < 3 then 0 else 8000 + s_nationkey end as port, case when s_nationkey % 2 = 0 then '' else ' ' || s_name end as username from supplier join nation on s_nationkey = n_nationkey)"""


def _identities(spark, d):
    rows = t.read(spark, d, "supplier").join(F.broadcast(t.read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    protocol = F.when(F.col("s_nationkey") < 3, "Local").otherwise(F.col("n_name"))
    host = F.concat(F.upper(F.translate("n_name", " ", "-")), F.lit(".Example.com."))
    user = F.when(F.col("s_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "s_name"))
    return rows.select("s_suppkey", ff.normalised_identity(protocol, host, 8000 + F.col("s_nationkey"), user).alias("i"))


@query(f"with {_IDENTITY} select * from ident")
def identity_normalise(spark, d):
    return _identities(spark, d).select("s_suppkey", "i.*")


@query(f"""with {_IDENTITY}, n as (select s_suppkey, 'nas_' || protocol || '_' || regexp_replace(host, '[^a-z0-9]', '_', 'g') || '_' || port || '_u' || case when username = '' then 'anon' else sha1(username)[1:12] end as plain, protocol || '|' || host || '|' || port || '|' || username as whole from
 (select s_suppkey, protocol, username, port, case when s_suppkey % 3 = 0 then host || '.a-very-long-name-of-a-host.in-some-department.example.org' else host end as host from ident))
select s_suppkey, case when length(plain) > 63 then 'nas_' || sha1(whole)[1:24] else plain end as schema_name from n""")
def schema_name_for(spark, d):
    rows = _identities(spark, d)
    host = F.when(F.col("s_suppkey") % 3 == 0, F.concat("i.host", F.lit(".a-very-long-name-of-a-host.in-some-department.example.org"))).otherwise(F.col("i.host"))
    longer = F.struct(F.col("i.protocol").alias("protocol"), host.alias("host"), F.col("i.port").alias("port"), F.col("i.username").alias("username"))
    return rows.select("s_suppkey", ff.schema_name(longer).alias("schema_name"))


#: Range headers in the shapes that clients send.
HEADERS = ("", "bytes=0-99", "bytes=100-", "bytes=-50", "bytes=999999999-", "items=0-1", "bytes=0-1,5-6", "bytes=9-3", "bytes=-", "  BYTES= 5 - 9 ", "bytes=-0", "bytes=a-b", "bytes=7")


@query("""with __FILES__, h(header, kind, a, b) as (values ('', 'all', 0, 0), ('bytes=0-99', 'ab', 0, 99), ('bytes=100-', 'a', 100, 0), ('bytes=-50', 'last', 50, 0), ('bytes=999999999-', 'a', 999999999, 0), ('items=0-1', 'all', 0, 0), ('bytes=0-1,5-6', 'all', 0, 0),
 ('bytes=9-3', 'never', 0, 0), ('bytes=-', 'all?', 0, 0), ('  BYTES= 5 - 9 ', 'ab', 5, 9), ('bytes=-0', 'never', 0, 0), ('bytes=a-b', 'all?', 0, 0), ('bytes=7', 'all?', 0, 0)),
r as (select doc_id, header, kind, size_bytes as n, case kind when 'last' then greatest(0, size_bytes - a) else a end as f, case when kind in ('a', 'last') then size_bytes - 1 else least(b, size_bytes - 1) end as l from files, h)
select doc_id, header, case when n > 0 and kind in ('ab', 'a', 'last') and f < n then f end as first, case when n > 0 and kind in ('ab', 'a', 'last') and f < n then l end as last,
 kind = 'all' or (n > 0 and (kind = 'all?' or (kind <> 'never' and f < n))) as valid from r""")
def range_parse(spark, d):
    rows = t.files(spark, d).select("doc_id", "size_bytes", F.explode(F.array(*map(F.lit, HEADERS))).alias("header"))
    return rows.select("doc_id", "header", ff.parsed_range(F.col("header"), F.col("size_bytes")).alias("r")).select("doc_id", "header", "r.first", "r.last", "r.valid")


@query("""with __FILES__ select b.rel_path, '"' || b.file_hash || '"' as etag, a.rel_path is null or a.size_bytes <> b.size_bytes or a.mtime <> b.mtime as stale from before b left join after a using (rel_path)""")
def etag_stale(spark, d):
    now = t.after(spark, d).select("rel_path", F.col("size_bytes").alias("s"), F.col("mtime").alias("m"))
    rows = t.before(spark, d).join(now, "rel_path", "left")
    stale = F.col("s").isNull() | (F.col("s") != F.col("size_bytes")) | (F.col("m") != F.col("mtime"))
    return rows.select("rel_path", ff.etag(F.col("file_hash"), F.col("size_bytes"), F.col("mtime")).alias("etag"), stale.alias("stale"))


# --- change detection

_PAIR = "__FILES__, pair as (select rel_path, b.file_hash as bh, a.file_hash as ah, b.size_bytes as bs, a.size_bytes as sa, b.mtime as bm, a.mtime as am, b.ctime as bc, a.ctime as ac, b.doc_id is null as is_new, a.doc_id is null as is_gone from before b full join after a using (rel_path))"
_MOVES = """, g as (select bh, rel_path as from_path, row_number() over (partition by bh order by rel_path) as i from pair where is_gone),
c as (select ah, rel_path as to_path, row_number() over (partition by ah order by rel_path) as i from pair where is_new), mv as (select from_path, to_path from g join c on bh = ah and g.i = c.i),
cl as (select rel_path, case when m.to_path is not null then 'moved' when is_new then 'added' when is_gone then 'deleted' when ah = bh then 'unchanged' else 'updated' end as action, m.from_path
 from pair left join mv m on m.to_path = rel_path where rel_path not in (select from_path from mv))"""


@query(f"with {_PAIR} select rel_path, case when is_new then 'added' when is_gone then 'missing' when ah <> bh or am <> bm or sa <> bs then 'changed' else 'unchanged' end as change from pair")
def source_changes(spark, d):
    return sync.source_changes(t.before(spark, d), t.after(spark, d))


@query(f"with {_PAIR}{_MOVES} select rel_path, action, from_path from cl")
def sync_classify(spark, d):
    return sync.classified(t.before(spark, d), t.after(spark, d))


@query(f"with {_PAIR}{_MOVES} select from_path, to_path from mv")
def sync_moves(spark, d):
    return sync.moves(t.before(spark, d), t.after(spark, d))


@query(f"""with {_PAIR}{_MOVES} select cl.rel_path, a.file_hash, b.rel_path as version_of, case when b.file_hash <> a.file_hash then b.file_hash end as prev_hash
from cl join after a using (rel_path) left join before b on b.rel_path = coalesce(cl.from_path, cl.rel_path) where action <> 'deleted'""")
def sync_new_snapshot(spark, d):
    return sync.synced(t.before(spark, d), t.after(spark, d))


_RECON = f"""{_PAIR}, rc as (select p.rel_path, bh, ah, case when is_new then 'added' when is_gone then 'missing'
 when f.lang = 'fr' then case when sa = bs and abs(am - bm) < 1e-6 and abs(ac - bc) < 1e-6 then 'restored' else 'stale' end
 when (sa = bs and abs(am - bm) < 1e-6 and abs(ac - bc) < 1e-6) or ah = bh then 'unchanged' else 'stale' end as outcome, f.lang
 from pair p left join files f on f.rel_path = p.rel_path),
st as (select rel_path, coalesce(bh, ah) as file_hash, outcome, case outcome when 'added' then 'ok' when 'restored' then 'ok' when 'missing' then 'missing_source' when 'stale' then 'stale_source' else case when lang = 'fr' then 'missing_source' else 'ok' end end as status from rc)"""


def _reconciled(spark, d):
    """French files count as missing before the walk."""
    return sync.reconciled(t.before(spark, d), t.after(spark, d), F.when(F.col("category") == "fr", "missing_source").otherwise("ok"))


@query(f"with {_RECON} select rel_path, status, file_hash, outcome from st")
def reconcile_status(spark, d):
    return _reconciled(spark, d)


_PARENT = "regexp_replace(rel_path, '/[^/]*$', '')"
_ANC = "anc as (select *, unnest(range(1, len(string_split(parent_dir, '/')) + 1)) as i from {0}), dirs as (select *, array_to_string(string_split(parent_dir, '/')[1:i], '/') as dir, len(string_split(parent_dir, '/')) - i as below from anc)"


@query(f"with __FILES__, {_ANC.format('after')}, own as (select parent_dir as dir, count(*) as n from after group by 1) select dir, coalesce(n, 0) as file_count from (select distinct dir from dirs) left join own using (dir)")
def reconcile_folders(spark, d):
    return folders.direct_counts(t.after(spark, d))


@query("""with __FILES__, j as (select a.rel_path, b.rel_path is not null and b.doc_id % 4 > 0 as known, b.size_bytes = a.size_bytes and b.mtime = a.mtime and b.ctime = a.ctime and b.ctime <> 0 as same, b.doc_id % 5 <> 0 and b.file_hash = a.file_hash as hashed, b.doc_id % 5 = 0 as blank from after a left join before b using (rel_path)),
l as (select rel_path, case when not known then 'analyse' when same then 'skip_stat' when hashed then 'skip_hash' when blank then 'skip_upgrade' else 'analyse' end as level, blank from j) select rel_path, level, level <> 'analyse' and blank as upgraded from l""")
def incremental_levels(spark, d):
    """A quarter of the files was never analysed, and a fifth of the old fingerprints names no algorithm."""
    old = t.before(spark, d).withColumns({"has_content": F.col("doc_id") % 4 > 0, "hash_algorithm": F.when(F.col("doc_id") % 5 > 0, F.col("hash_algorithm"))})
    return sync.incremental_levels(old, t.after(spark, d))


_COUNTS = "count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'stale_source') as stale, count(*) filter (status = 'missing_source') as missing"


@query(f"with {_RECON} select {_COUNTS} from st")
def status_counts(spark, d):
    return folders.status_counts(_reconciled(spark, d))


@query(f"with {_RECON} select case when starts_with(rel_path, 'moved/') then string_split(rel_path, '/')[2] else string_split(rel_path, '/')[1] end as source_id, {_COUNTS} from st group by 1")
def source_stats(spark, d):
    source = F.element_at(F.split(F.regexp_replace("rel_path", "^moved/", ""), "/"), 1)
    return folders.status_counts(_reconciled(spark, d).withColumn("source_id", source), "source_id")


#: The second snapshot as a listing in which some files are system and lock files; entries are the first snapshot's.
_SCANNED = """n as (select case doc_id % 11 when 0 then parent_dir || '/Thumbs.db' when 1 then parent_dir || '/~$' || name else rel_path end as rel_path, parent_dir, ext, file_hash, doc_id % 11 < 2 as junk from after), m as (select rel_path, any_value(parent_dir) as parent_dir, any_value(ext) as ext, any_value(file_hash) as h, any_value(junk) as junk from n group by 1),
sc as (select coalesce(m.parent_dir, b.parent_dir) as parent_dir, case when m.rel_path is null then 'orphans' when junk then 'junk' when m.ext in ('zip', 'py') then 'ignored' when b.rel_path is null then 'missing' when b.file_hash = m.h then 'valid' else 'stale' end as s from m full join before b on m.rel_path = b.rel_path)"""


@query(f"with __FILES__, {_SCANNED} select parent_dir, count(*) filter (s not in ('orphans', 'junk')) as total, count(*) filter (s = 'valid') as valid, count(*) filter (s = 'missing') as missing, count(*) filter (s = 'stale') as stale, count(*) filter (s = 'ignored') as ignored, count(*) filter (s = 'orphans') as orphans from sc group by 1 having total + orphans > 0")
def scan_report(spark, d):
    k = F.col("doc_id") % 11
    path = F.when(k == 0, F.concat("parent_dir", F.lit("/Thumbs.db"))).when(k == 1, F.concat("parent_dir", F.lit("/~$"), "name")).otherwise(F.col("rel_path"))
    listing = t.after(spark, d).select(path.alias("rel_path"), "file_hash").dropDuplicates(["rel_path"])
    return folders.scan_report(listing, t.before(spark, d))


@query("with __RESOURCES__, c as (select resource_id, count(*) as n from vectors where level = 'chunk' group by 1) select source_id, count(*) as files, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'stale_source') as stale_source, count(*) filter (status = 'missing_source') as missing_source, count(*) filter (doc_id % 3 > 0 and text <> '') as analyzed, sum(coalesce(n, 0))::bigint as chunks from resources left join c using (resource_id) group by 1")
def source_counts(spark, d):
    """Of each source: files by status, those that were analysed and their chunks; a third has no summary."""
    return folders.source_stats(t.resources(spark, d).withColumn("summary", F.when(F.col("doc_id") % 3 > 0, F.col("summary"))), t.vectors(spark, d))


@query("with __RESOURCES__ select count(*) as resources, count(*) filter (status = 'ok' and doc_id % 7 > 0) as ok, count(*) filter (status = 'ok' and doc_id % 7 = 0) as stale_vector, count(*) filter (status = 'stale_source') as stale_source, (select count(*) from vectors) as vectors from resources")
def store_counts(spark, d):
    status = F.when((F.col("status") == "ok") & (F.col("doc_id") % 7 == 0), "stale_vector").otherwise(F.col("status"))
    return folders.store_stats(t.resources(spark, d).withColumn("status", status), t.vectors(spark, d))


@query(f"""with {_PAIR}{_MOVES} select 'add' as action, count(*) as n from pair where is_new union all select 'update', count(*) from pair where ah <> bh
union all select 'move', count(*) from mv union all select 'delete', (select count(*) from pair where is_gone) - (select count(*) from mv)""")
def consistency_report(spark, d):
    """Moves count among what is to be added, but not among what is to be deleted."""
    old, new = t.before(spark, d), t.after(spark, d)
    both = sync.paired(old, new).agg(
        F.count_if(F.col("o").isNull()).alias("a"), F.count_if(F.col("n").isNull()).alias("g"), F.count_if(F.col("o.file_hash") != F.col("n.file_hash")).alias("u")
    )
    rows = both.crossJoin(sync.moves(old, new).agg(F.count("*").alias("m")))
    named = F.array(*(F.struct(F.lit(k).alias("action"), v.alias("n")) for k, v in (("add", F.col("a")), ("update", F.col("u")), ("move", F.col("m")), ("delete", F.col("g") - F.col("m")))))
    return rows.select(F.explode(named).alias("x")).select("x.*")


@query("with __FILES__ select rel_path from before where rel_path not in (select rel_path from after)")
def orphans(spark, d):
    return t.before(spark, d).select("rel_path").join(t.after(spark, d).select("rel_path"), "rel_path", "left_anti")


# --- folders


@query(f"with __FILES__, {_ANC.format('after')} select dir, count(*) as file_count, sum(size_bytes)::bigint as total_size, max(below)::bigint as max_depth from dirs group by dir")
def folder_rollup(spark, d):
    return folders.rollup(t.after(spark, d))


@query(f"with __FILES__, {_ANC.format('after')} select dir, ext, n from (select dir, ext, count(*) as n from dirs group by all) qualify row_number() over (partition by dir order by n desc, ext) <= 20")
def ext_distribution(spark, d):
    return folders.extension_distribution(t.after(spark, d))


@query("""with __FILES__ select distinct 'folder' as kind, string_split(parent_dir, '/')[2] as name, null::bigint as size_bytes from after where starts_with(parent_dir, 'moved/')
union all select 'file', name, size_bytes from after where parent_dir = 'moved'""")
def list_dir(spark, d):
    return folders.list_dir(t.after(spark, d), "moved")


@query(f"with __FILES__, {_ANC.format('after')} select distinct dir, len(string_split(dir, '/'))::bigint as depth from dirs")
def ancestors(spark, d):
    return folders.folder_set(t.after(spark, d)).select("dir", ff.depth_of(F.col("dir")).cast("long").alias("depth"))


@query("with __FILES__ select parent_dir, rel_path, size_bytes, row_number() over (partition by parent_dir order by name) as place from after")
def tree_listing(spark, d):
    w = W.partitionBy("parent_dir").orderBy("name")
    return t.after(spark, d).select("parent_dir", "rel_path", "size_bytes", F.row_number().over(w).cast("long").alias("place"))


# --- chunks


@query(r"""with __MARKDOWN__, pre as (select page_id, string_split(regexp_replace(regexp_replace(md, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) as l from markdown),
lines as (select page_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as line from pre)
select page_id, line::bigint as line, length(regexp_extract(x, '^\s{0,3}(#{1,6})\s', 1))::bigint as level, regexp_extract(x, '^\s{0,3}#{1,6}\s+(.+?)\s*$', 1) as title from lines where regexp_matches(x, '^\s{0,3}#{1,6}\s+\S') and not regexp_matches(title, '^#*$')""")
def chunk_headings(spark, d):
    return chunks.headings(t.markdown(spark, d)).select("page_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "title")


@query(r"""with cut as (select doc_id, regexp_replace(text, '(?m)^([^|\n]*\|)', '|\1', 'g') as text from documents) select doc_id, p >= greatest(2, floor(n * 0.5)) as heavy from (select doc_id, len(l) as n, len(list_filter(l, lambda x: starts_with(ltrim(x), '|'))) as p
 from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from cut))""")
def chunk_table_heavy(spark, d):
    """Lines with a pipe are made to start with one, as tables do."""
    text = F.regexp_replace("text", "(?m)^([^|\n]*\\|)", "|$1")
    return docs(spark, d).select("doc_id", ft.table_heavy(text).alias("heavy"))


@query(r"""with __MARKDOWN__ select page_id, length(p) as n_chars, sha256(p) as md_hash from (select page_id, regexp_replace(replace(regexp_replace(md, '\r\n?', chr(10), 'g'), chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g') as p from markdown)""")
def chunk_preprocess(spark, d):
    rows = t.markdown(spark, d).select("page_id", ft.preprocessed(F.col("md")).alias("p"))
    return rows.select("page_id", F.length("p").cast("long").alias("n_chars"), F.sha2("p", 256).alias("md_hash"))


@query()
def chunk_markdown(spark, d):
    return chunks.chunks(t.markdown(spark, d))


@query()
def chunk_topk(spark, d):
    rows = chunks.chunks(t.markdown(spark, d)).select(F.concat_ws("#", "page_id", "seq").alias("doc_id"), "chunk")
    return rank.bm25(rows, _fixed(spark), 10, text="chunk").select(F.col("doc_id").alias("chunk_id"), "score")


# --- answers and evaluation

_TURNS = "h as (select conv_id, row_number() over (partition by conv_id order by turn) as rank, case when turn % 4 = 3 then '' else role end as category, 'conv/' || conv_id || '/' || turn as path, text as body from conversations)"


def _turns(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.read(spark, d, "conversations").select(
        "conv_id", F.row_number().over(w).cast("long").alias("rank"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")).alias("category"), F.concat(F.lit("conv/"), "conv_id", F.lit("/"), "turn").alias("path"), F.col("text").alias("body")
    )


_PACK = f"""{_TURNS}, r as (select conv_id, rank, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as body, '[' || rank || '] ' || path || '（' || case when category = '' then '未分类' else category end || '）' as head from h),
pk as (select conv_id, rank, head, body, 600 - coalesce(sum(length(head) + length(body) + 2) over (partition by conv_id order by rank rows between unbounded preceding and 1 preceding), 0) as lft from r where body <> '')"""


@query(f"with {_PACK} select conv_id, rank, head, least(greatest(0, lft - length(head)), length(body))::bigint as taken from pk where lft > 0")
def rag_context_pack(spark, d):
    return answer.packed_context(_turns(spark, d), "conv_id", 600)


@query(f"with {_PACK} select conv_id, string_agg(head, '; ' order by rank) as citations, count(*) as n from pk where lft > 0 group by 1")
def rag_citations(spark, d):
    packed = answer.packed_context(_turns(spark, d), "conv_id", 600)
    heads = F.array_sort(F.collect_list(F.struct("rank", "head")))
    return packed.groupBy("conv_id").agg(F.array_join(F.transform(heads, lambda x: x["head"]), "; ").alias("citations"), F.count("*").alias("n"))


_ASKED = "q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark)"
_SELF = "own as (select query_id, sum(ln(1 + (n - c + 0.5) / (c + 0.5)) * 2.5) as best from q join df using (term) cross join st group by 1)"


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings), c as (select label, embedding::double[] as qv from embeddings where vec_id = 7),
s as (select e.label, max(round(list_cosine_similarity(v, qv), 6)) as score from e, c group by e.label)
select label, score, case when score is null or score < 0.25 then 'no_hit_fallback' when score >= 0.9 then 'direct' else 'rag' end as mode from s""")
def rag_modes(spark, d):
    best = rank.fan_out(*_vectors(spark, d), "label", 1).select("label", "score")
    return answer.answer_modes(best, floor=0.25)


@query("""with r as (select case when quality = 1 then substr(text, 1, 200) else '' end as da, case when toxic = 0 then substr(text, 201, 200) else ' ' end as ba, quality = 1 and doc_id % 3 > 0 as ds, toxic = 0 and doc_id % 2 = 0 as bs, lang in ('en', 'de') as sc, source
 from labels join documents using (doc_id)), n as (select count(*) as total, count(*) filter (sc) as scored, count(*) filter (sc and (contains(da, 'the') or contains(da, 'der') or (ds and (contains(source, 'the') or contains(source, 'der'))))) as deep_hit,
 count(*) filter (sc and (contains(ba, 'the') or contains(ba, 'der') or (bs and (contains(source, 'the') or contains(source, 'der'))))) as base_hit, count(*) filter (trim(da, ' ' || chr(10)) <> '') as a1, count(*) filter (trim(ba, ' ' || chr(10)) <> '') as a2,
 count(*) filter (ds) as s1, count(*) filter (bs) as s2 from r)
select total, scored, deep_hit, base_hit, round(a1 / total, 4) as deep_answer_rate, round(s1 / total, 4) as deep_source_rate, round(deep_hit / scored, 4) as deep_hit_rate, round(a2 / total, 4) as base_answer_rate, round(s2 / total, 4) as base_source_rate, round(base_hit / scored, 4) as base_hit_rate from n""")
def eval_aggregate(spark, d):
    """Labels say which documents were answered, with their beginnings as answers and their sources as sources."""
    rows = t.read(spark, d, "labels").join(docs(spark, d), "doc_id")
    sources = lambda c: F.when(c, F.array("source")).otherwise(F.array().cast("array<string>"))
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    results = rows.select(
        F.when(good, F.substring("text", 1, 200)).otherwise("").alias("deep_answer"), F.when(clean, F.substring("text", 201, 200)).otherwise(" ").alias("base_answer"),
        sources(good & (F.col("doc_id") % 3 > 0)).alias("deep_sources"), sources(clean & (F.col("doc_id") % 2 == 0)).alias("base_sources"), F.when(F.col("lang").isin("en", "de"), "the | der").otherwise(" ").alias("expect"),
    )
    return answer.evaluated(results)


_TRUTH = "truth as (select item_id as query_id, doc_id from benchmark b join documents o on contains(o.text, b.text))"
_RANKED = f"""ranked as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0), found as (select query_id, min(rank) as rank from truth left join ranked using (query_id, doc_id) group by 1)"""


@query(f"""with {_TOK}, {_ASKED}, {_BM25}, {_TRUTH}, {_RANKED}
select k, round(avg(case when rank <= k then 1.0 else 0.0 end), 4) as recall, count(*) as questions from found, (values (1), (3), (5)) ks(k) group by k""")
def recall_at_k(spark, d):
    """A question's expected documents are all that hold the item's text, whether or not they are ranked."""
    items, corpus = t.read(spark, d, "benchmark"), docs(spark, d)
    asked = items.select(F.col("item_id").alias("query_id"), ft.search_tokens(F.col("text")).alias("terms"))
    hits = rank.bm25(corpus, asked, 5)  # what ranks lower is found at no k
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = hits.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))
    truth = answer.holders(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("want")), corpus)
    return answer.recall_at(ranked, truth, (1, 3, 5))


@query(f"""with {_COS}, g as (select label, score, row_number() over (partition by label order by score desc, vec_id) as r from sc),
p as (select label, round(avg(score) filter (r <= 3), 6) as r3, round(avg(score) filter (r <= 5), 6) as r5, count(*) as n from g group by 1) select label, r5, r3, n from p order by r5 desc, r3 desc, n, label limit 1""")
def param_sweep_best(spark, d):
    rows, query = _vectors(spark, d)
    w = W.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    g = rank.fan_out(rows, query, "label", 5).withColumn("r", F.row_number().over(w))
    mean = lambda k: F.round(F.avg(F.when(F.col("r") <= k, F.col("score"))), 6)
    best = g.groupBy("label").agg(mean(5).alias("r5"), mean(3).alias("r3"))
    return best.join(F.broadcast(rows.groupBy("label").agg(F.count("*").alias("n"))), "label").select("label", "r5", "r3", "n").orderBy(F.desc("r5"), F.desc("r3"), "n", "label").limit(1)


# --- planned moves

_PLAN = """__FILES__, plan as (select rel_path as from_path, case when category = 'de' then rel_path when category = 'es' then 'elsewhere/' || name when category = 'fr' then 'src5/.index/' || name else 'src5/sorted/' || name end as to_path from before),
v as (select from_path, to_path, case when from_path not like 'src5/%' then 'source outside root' when to_path <> 'src5' and to_path not like 'src5/%' then 'target outside root'
 when contains('/' || to_path || '/', '/.index/') then 'repository internal' when from_path not in (select rel_path from after) then 'unknown source' when from_path = to_path then 'no change' end as reason from plan)"""


def _plan(spark, d):
    to = F.when(F.col("category") == "de", F.col("rel_path")).when(F.col("category") == "es", F.concat(F.lit("elsewhere/"), "name")).when(F.col("category") == "fr", F.concat(F.lit("src5/.index/"), "name"))
    return t.before(spark, d).select(F.col("rel_path").alias("from_path"), F.coalesce(to, F.concat(F.lit("src5/sorted/"), "name")).alias("to_path"))


@query(f"with {_PLAN} select * from v")
def plan_validate(spark, d):
    return reorganise.validated(_plan(spark, d), "src5", t.after(spark, d))


@query(f"with {_PLAN} select coalesce(reason, 'move') as action, count(*) as n from v group by 1")
def plan_preview(spark, d):
    return plan_validate(spark, d).groupBy(F.coalesce("reason", F.lit("move")).alias("action")).agg(F.count("*").alias("n"))


@query(f"with {_PLAN} select len(string_split(from_path, '/'))::bigint as depth, row_number() over (order by len(string_split(from_path, '/')) desc, from_path) as place, from_path, to_path from v where reason is null or reason = 'no change'")
def plan_order(spark, d):
    rows = reorganise.ordered(plan_validate(spark, d).where("reason is null or reason = 'no change'"))
    return rows.select(F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"), "from_path", "to_path")


_CONFLICTS = """__FILES__, m as (select rel_path as from_path, file_hash as h1, case category when 'es' then 'src0/en' when 'en' then 'fresh/' || name when 'fr' then lead(rel_path, 1, rel_path) over (partition by parent_dir order by rel_path) else min(rel_path) over (partition by file_hash) end as to_path from files),
 cf as (select from_path, to_path, case when to_path in (select parent_dir from files) or to_path in (select source from files) then 'conflict' when y.rel_path is null then 'free' when h1 = y.file_hash then 'noop' when y.category = 'en' then 'rename' when y.doc_id % 2 = 0 then 'meta_only' else 'rename' end as decision
 from m left join files y on y.rel_path = to_path)"""


def _moves(spark, d):
    """Spanish files go onto a directory, English ones to a free place, French ones onto the next file, German ones onto the first of their content."""
    files = t.files(spark, d).drop("text")
    kind, w = F.col("category"), W.partitionBy("parent_dir").orderBy("rel_path")
    to = F.when(kind == "es", "src0/en").when(kind == "en", F.concat(F.lit("fresh/"), "name")).when(kind == "fr", F.coalesce(F.lead("rel_path").over(w), "rel_path")).otherwise(F.min("rel_path").over(W.partitionBy("file_hash")))
    known = files.withColumn("analysed", (kind == "en") | (F.col("doc_id") % 2 == 1))
    return files.select(F.col("rel_path").alias("from_path"), to.alias("to_path")), known


@query(f"with {_CONFLICTS} select from_path, to_path, decision, case when decision = 'rename' then regexp_replace(to_path, '[.]([^.]*)$', ' (1).\\1') else to_path end as target from cf")
def conflict_tristate(spark, d):
    return reorganise.conflicts(*_moves(spark, d))


@query("with __FILES__ select regexp_replace('资料/' || replace(rel_path, '/', '/ #(1)') , '[^A-Za-z0-9.#()\\x{4e00}-\\x{9fff}_-]+', '_', 'g') as safe from files")
def safe_name(spark, d):
    """Paths with CJK folders, blanks and brackets, and slashes at both ends."""
    path = F.concat(F.lit("/资料/"), F.replace("rel_path", F.lit("/"), F.lit("/ #(1)")), F.lit("/"))
    return t.files(spark, d).select(ft.safe_name(path).alias("safe"))


_MD = """md as (select regexp_replace(rel_path, '[^A-Za-z0-9.#()_-]+', '_', 'g') || '.md' as file_name, rtrim('---' || chr(10) || 'path: "' || rel_path || '"' || chr(10) || 'kind: file' || chr(10) || 'category: "' || lang || '"' || chr(10) || 'tags: ["' || lang || '", "' || source || '"]' || chr(10)
 || case when substr(text, 1, 200) <> '' then 'summary: "' || substr(text, 1, 200) || '"' || chr(10) else '' end || '---' || chr(10) || chr(10) || case when substr(text, 1, 200) <> '' then '## 摘要' || chr(10) || chr(10) || substr(text, 1, 200) || chr(10) || chr(10) else '' end
 || case when trim(text, ' ' || chr(10)) <> '' then '## 内容' || chr(10) || chr(10) || trim(text, ' ' || chr(10)) else '' end, ' ' || chr(10)) || chr(10) as md from files)"""


@query(f"with __FILES__, {_MD} select file_name, length(md) as n_chars, sha256(md) as md_hash from md")
def export_clean(spark, d):
    """The Markdown file that an export writes for each document."""
    out = store.exported_markdown(_export_docs(spark, d))
    return out.select(F.concat(ft.safe_name(F.col("path")), F.lit(".md")).alias("file_name"), F.length("md").cast("long").alias("n_chars"), F.sha2("md", 256).alias("md_hash"))


def _export_docs(spark, d):
    rows = t.files(spark, d)
    return rows.select(F.col("rel_path").alias("path"), F.lit("file").alias("kind"), "category", F.array("category", "source").alias("tags"), F.substring("text", 1, 200).alias("summary"), F.col("text").alias("context"), F.lit("").alias("text"))


@query(f"with __FILES__, {_MD} select count(*) as files, sum(length(md))::bigint as chars from md")
def export_totals(spark, d):
    return store.exported_markdown(_export_docs(spark, d)).agg(F.count("*").alias("files"), F.sum(F.length("md")).cast("long").alias("chars"))


@query("with __FILES__ select rel_path, case when source = 'src3' then 'moved/' || rel_path else rel_path end as new_path, source = 'src3' as changed from files")
def remap_paths(spark, d):
    """An index whose paths are spelt differently from those of the mapping."""
    files = t.files(spark, d).select("rel_path", "source")
    mapping = files.where("source = 'src3'").select(F.concat(F.lit("./"), F.replace("rel_path", F.lit("/"), F.lit("\\"))).alias("old"), F.concat(F.lit("moved/"), "rel_path").alias("new"))
    return store.remapped(files.select("rel_path", F.concat("rel_path", F.lit("/")).alias("path")), mapping).select("rel_path", F.regexp_replace("path", "/$", "").alias("new_path"), "changed")


@query(f"with {_TOK}, x as (select distinct unnest(toks) as term from tok), old as (select distinct unnest(toks) as term from tok where lang = 'en') select term from x where length(term) >= 3 and term not in (select term from old)")
def termbase_insert(spark, d):
    """Terms that the English term base lacks; they come with blanks around them, which don't count."""
    terms = lambda rows: rows.select(F.explode(F.array_distinct(ft.search_tokens(F.col("text")))).alias("term")).distinct()
    new = terms(docs(spark, d)).where("length(term) >= 3").select(F.concat(F.lit(" "), "term", F.lit(" ")).alias("term"))
    return store.terms_added(terms(docs(spark, d).where("lang = 'en'")), new.unionByName(spark.createDataFrame([("  ",)], "term string")))


# --- registry, jobs, access


@query("select s_suppkey as id, trim(s_name) as alias, case when s_acctbal < 0 then '' else '******' end as secret from supplier where s_suppkey = 5 limit 1")
def source_lookup(spark, d):
    rows = t.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.trim("s_name").alias("alias"), F.when(F.col("s_acctbal") < 0, "").otherwise("x").alias("secret"))
    return registry.lookup(rows, "5").select(F.col("id").cast("long").alias("id"), "alias", registry.masked(F.col("secret")).alias("secret"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as ts, count(*) as n_events from events group by 1")
def job_latest_status(spark, d):
    return registry.latest_status(t.read(spark, d, "events"))


@query("select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as place from events where event_type <> 'view'")
def job_status_list(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.read(spark, d, "events").where("event_type <> 'view'")
    return rows.select("user_id", "event_id", "event_type", F.row_number().over(w).cast("long").alias("place"))


def job_events(spark, d):
    """The events as those of jobs in a queue for each user: queue, event_id, event, progress, ts (microseconds)."""
    named = F.create_map(*map(F.lit, ("signup", "submit", "click", "start", "view", "progress", "purchase", "complete", "error", "fail")))
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return t.read(spark, d, "events").select(F.col("user_id").alias("queue"), "event_id", named[F.col("event_type")].alias("event"), F.least(F.lit(1.0), F.col("value") / 40).alias("progress"), micros.alias("ts"))


@query(f"""with recursive e as (select user_id as queue, event_id, epoch_us(ts) as ts, event_type, least(1.0, value / 40) as p, row_number() over (partition by user_id order by ts, event_id) as n, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as next, max(epoch_us(ts)) over () as now from events),
r as (select distinct queue, 0::bigint as n, 0::bigint as job, 'none' as status, 0::bigint as submitted, null::bigint as started, null::bigint as ended, 0.0::double as progress, 0::bigint as n_skipped, 0::bigint as last from e
 union all select queue, n, case when new then job + 1 else job end, case when new then 'pending' when is_open and event_type in ('click', 'view') then 'running' when is_open and event_type = 'purchase' then 'completed' when is_open and event_type = 'error' then 'failed' else status end,
  case when new then ts else submitted end, case when new then null when is_open and event_type in ('click', 'view') then coalesce(started, ts) else started end, case when new then null when is_open and event_type in ('purchase', 'error') then ts else ended end,
  case when new then 0 when is_open and event_type = 'view' then greatest(progress, coalesce(p, 0)) when is_open and event_type = 'purchase' then 1 else progress end, case when new then 0 when is_open and event_type = 'signup' then n_skipped + 1 else n_skipped end, case when new or is_open then ts else last end
  from (select y.*, event_type = 'signup' and not is_open as new from (select x.*, status in ('pending', 'running') as is_open from (select r.* replace (e.n as n, case when status in ('pending', 'running') and e.ts - last > {lifecycle.TIMEOUT * 1_000_000} then 'timed out' else status end as status, case when status in ('pending', 'running') and e.ts - last > {lifecycle.TIMEOUT * 1_000_000} then last + {lifecycle.TIMEOUT * 1_000_000} else ended end as ended), e.ts, e.event_type, e.p from r join e on e.queue = r.queue and e.n = r.n + 1) x) y) z),
f as (select r.*, status in ('pending', 'running') and coalesce(next, now) - last > {lifecycle.TIMEOUT * 1_000_000} as late from r join e using (queue, n) where job > 0 qualify row_number() over (partition by queue, job order by n desc) = 1)
select queue, job, case when late then 'timed out' else status end as status, submitted, started, case when late then last + {lifecycle.TIMEOUT * 1_000_000} else ended end as ended, progress, n_skipped from f""")
def job_history(spark, d):
    """All jobs of all queues as of the last event; the SQL replays each queue event by event."""
    events = job_events(spark, d)
    return lifecycle.job_history(events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))), F.col("now"))


_DUE = "s as (select user_id as id, max(ts) as last_scan, count(*) as interval_minutes, bool_or(event_type = 'purchase') as enabled from events group by 1)"


@query(f"with {_DUE} select id, last_scan from (select id, case when id % 2 = 0 then last_scan end as last_scan, interval_minutes, enabled from s) where enabled and (last_scan is null or date_diff('second', last_scan, timestamp '2024-01-31 00:00:00') >= 60 * greatest(5, interval_minutes)) order by id limit 1")
def due_sources(spark, d):
    """Sources with odd ids were never scanned."""
    rows = t.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_scan"), F.count("*").alias("interval_minutes"), F.expr("bool_or(event_type = 'purchase')").alias("enabled"))
    state = rows.withColumns({"auto": F.lit(True), "created": F.col("id"), "last_scan": F.when(F.col("id") % 2 == 0, F.col("last_scan"))})
    return registry.due(state, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("id", "last_scan")


@query("select user_id, event_type, count(*) as n, bool_and(event_type in ('login', 'view') or user_id % 3 = 0) as passed from events group by all")
def auth_decision(spark, d):
    """Pages and downloads are open; else the first of two tokens is wanted."""
    kind = F.col("event_type")
    path = F.when(kind == "login", "/login").when(kind == "view", "/api/files/7/download").otherwise(F.concat(F.lit("/api/"), kind))
    header = F.when(F.col("user_id") % 3 == 0, "bearer  good ").when(F.col("user_id") % 3 == 1, "Bearer second").otherwise(F.lit(None))
    rows = t.read(spark, d, "events").select("user_id", "event_type", registry.allowed(path, header, ("good", "second")).alias("ok"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.expr("bool_and(ok)").alias("passed"))


from . import inventory  # noqa: E402, F401  registers its queries here
