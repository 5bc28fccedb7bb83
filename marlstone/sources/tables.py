"""Adapters from the stored tables to the shapes that the operators work on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import fingerprint_algorithm
from .tree import tree

EXTENSIONS = ("txt", "md", "pdf", "jpg", "mp4", "zip", "py", "xlsx")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table below this may lie in one row group, which one task reads whatever the number of splits.
SMALL_TABLE = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the table is small (by Spark's own estimate); a large one stays as it is scanned.

    For operators that compute much on each row: dealing a small table out costs less than
    computing it in the one task that reads its only row group.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL_TABLE else rows


def listing(spark: SparkSession, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """A recursive file listing from any file system Spark reads: path, name, ext, size_bytes, mtime, ctime (0: unknown); contents are not opened. A size bound is pushed to the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(F.col("length") >= least) if most is None else files.where(F.col("length").between(least, most))
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))
    return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"), F.lit(0.0).alias("ctime"))


ENTRY = "path string, summary string, category string, tags array<string>, content_description string, transcription string, ocr_text string, data_file string, file_hash string, hash_algorithm string, size_bytes long, mtime double, ctime double"


def repository(spark: SparkSession, root: str, name: str = ".index") -> DataFrame:
    """All entries of the description repositories below a root, with their full data: rel_path and the fields of ENTRY.

    Every <folder>/<name>/index.json lists light entries; <name>/files/<data_file> has the
    full one. What is no object is skipped, and fields of other types are null. A root of the scheme file: is
    listed by the tasks, any other one by the driver.
    """
    place = F.regexp_extract("file", f"^(.*?)/?{re.escape(name)}/index[.]json$", 1)

    def text(part: str, end: str) -> DataFrame:
        """Files of the repositories, which are hidden folders that Spark's own look-up leaves out; those below a file: root are read by the tasks that list them."""
        if root.startswith("file:/"):
            found = tree(spark, "/" + root.removeprefix("file:").lstrip("/"), content=True, ends=end).where(F.col("path").contains(part))
            return found.select(F.concat(F.lit("file:"), "path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
        found = [p for p in _paths(spark, root) if part in p and p.endswith(end)]
        rows = spark.read.option("wholetext", True).text(found) if found else spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
        return rows.select(F.col("_metadata.file_path").alias("file"), "value")

    index = text(f"/{name}/index.json", "/index.json")
    light = index.select(place.alias("folder"), F.explode(F.from_json("value", f"files array<struct<{_typed(ENTRY)}>>")["files"]).alias("e")).select("folder", "e.*")
    inner = F.regexp_extract("file", f"^(.*?)/?{re.escape(name)}/files/(.*)$", 2)
    folder = F.regexp_extract("file", f"^(.*?)/?{re.escape(name)}/files/", 1)
    full = text(f"/{name}/files/", ".json").select(folder.alias("folder"), inner.alias("data_file"), F.from_json("value", ENTRY).alias("f"))
    rows = light.join(full, ["folder", "data_file"], "left")
    fields = [c.split()[0] for c in ENTRY.split(", ") if c.split()[0] not in ("path", "data_file")]
    whole = [F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return rows.select(F.concat_ws("/", F.nullif("folder", F.lit("")), "path").alias("rel_path"), "data_file", *whole)


def _paths(spark: SparkSession, root: str) -> list[str]:
    """All files below a root, by the file system's own listing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    out = []
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return out


def _typed(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split(maxsplit=1)[1]}" for c in schema.split(", "))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Entries of old description files (*.sidecar.json, one a file); those without a fingerprint are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sidecar.json").option("wholetext", True).text(root)
    fields = F.from_json("value", "metadata struct<file_hash: string, size_bytes: bigint>, analysis struct<summary: string, category: string, tags: array<string>>, provenance struct<original_path: string>")
    found = rows.select(F.regexp_replace(F.col("_metadata.file_path"), "[.]sidecar[.]json$", "").alias("path"), fields.alias("s"))
    return found.where("coalesce(s.metadata.file_hash, '') <> ''").select("path", "s.metadata.file_hash", "s.metadata.size_bytes", "s.analysis.summary", "s.analysis.category", "s.analysis.tags", "s.provenance.original_path")


def vector_index(spark: SparkSession, path: str, dimensions: int) -> DataFrame | None:
    """A stored vector index (path, embedding); none where a row lacks a path or a vector of this length."""
    rows = spark.read.parquet(path)
    bad = F.col("path").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dimensions)
    return None if not rows.where(bad).isEmpty() else rows


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, q, expect) of a JSON file: a list of texts, or an object whose questions have q and expect."""
    text = spark.read.option("wholetext", True).text(path)
    plain = F.transform(F.from_json("value", "array<string>"), lambda q: F.struct(q.alias("q"), F.lit("").alias("expect")))
    named = F.from_json("value", "questions array<struct<q: string, expect: string>>")["questions"]
    rows = text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), plain).otherwise(named)).alias("idx", "x"))
    return rows.select("idx", "x.q", F.coalesce("x.expect", F.lit("")).alias("expect"))


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """The files as resources of the sources they lie in: resource_id, source_id, status, summary, tags and the file's columns."""
    status = F.when(F.col("lang") == "fr", "missing_source").when(F.col("lang") == "es", "stale_source").otherwise("ok")
    rows = files(spark, folder).withColumn("lang", F.col("category"))
    return rows.select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("resource_id"), F.col("source").alias("source_id"), status.alias("status"), F.substring("text", 1, 200).alias("summary"),
        F.array("lang", "source").alias("tags"), "rel_path", "name", "parent_dir", "ext", "size_bytes", "mtime", "ctime", "file_hash", "hash_algorithm", "category", "text", "doc_id",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as vectors of the resources of the same number: every third is a chunk."""
    level = F.when(F.col("vec_id") % 3 == 0, "chunk").otherwise("summary")
    return read(spark, folder, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("resource_id"), level.alias("level"), (F.col("vec_id") % 5).cast("int").alias("chunk_seq"), "embedding")


def folder_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The files' direct folders, per source: source_id, rel_path, parent_dir, name, summary, description, tags, file_count."""
    rows = files(spark, folder).groupBy(F.col("source").alias("source_id"), F.col("parent_dir").alias("rel_path")).agg(F.count("*").alias("file_count"))
    none = F.lit(None).cast("string")
    return rows.select("source_id", "rel_path", F.col("source_id").alias("parent_dir"), F.substring_index("rel_path", "/", -1).alias("name"), none.alias("summary"), none.alias("description"), F.array().cast("array<string>").alias("tags"), "file_count")


RESOURCES_SQL = """resources as (select 'r' || doc_id as resource_id, source as source_id, case lang when 'fr' then 'missing_source' when 'es' then 'stale_source' else 'ok' end as status, substr(text, 1, 200) as summary,
  rel_path, name, parent_dir, ext, size_bytes, mtime, ctime, file_hash, hash_algorithm, category, text, doc_id from files),
vectors as (select 'r' || vec_id as resource_id, case when vec_id % 3 = 0 then 'chunk' else 'summary' end as level, (vec_id % 5)::int as chunk_seq, embedding::double[] as v from embeddings),
folders as (select source as source_id, parent_dir as rel_path, source as parent_dir, lang as name, count(*) as file_count from files group by all)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree: doc_id, rel_path, name, parent_dir, ext, size_bytes, mtime, ctime, file_hash, category."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    return read(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit("."), ext)).alias("rel_path"),
        F.concat(F.lit("doc_"), "doc_id", F.lit("."), ext).alias("name"),
        F.concat_ws("/", "source", "lang").alias("parent_dir"),
        ext.alias("ext"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.col("doc_id") * 60).alias("mtime"),
        F.when(F.col("lang") == "es", 0).otherwise(F.col("doc_id") * 60 + 1).alias("ctime"),
        F.sha2("text", 256).alias("file_hash"),
        fingerprint_algorithm(F.octet_length("text")).alias("hash_algorithm"),
        F.col("lang").alias("category"),
        "source",
        "text",
    )


#: What the two snapshots of the inventory differ in, by source: not yet there, gone, moved, changed.
ADDED, GONE, MOVED, CHANGED = "src1", "src2", "src3", "src4"

FILES_SQL = f"""files as (select doc_id, ['{"','".join(EXTENSIONS)}'][(doc_id % {len(EXTENSIONS)} + 1)::int] as ext, source, lang, text,
  source || '/' || lang as parent_dir, 'doc_' || doc_id || '.' || ext as name, source || '/' || lang || '/doc_' || doc_id || '.' || ext as rel_path,
  strlen(text)::bigint as size_bytes, doc_id * 60 as mtime, case when lang = 'es' then 0 else doc_id * 60 + 1 end as ctime, sha256(text) as file_hash, 'sha256:full' as hash_algorithm, lang as category from documents),
before as (select * from files where source <> '{ADDED}'),
after as (select doc_id, ext, source, case when source = '{MOVED}' then 'moved/' || parent_dir else parent_dir end as parent_dir, name,
  case when source = '{MOVED}' then 'moved/' || rel_path else rel_path end as rel_path, case when source = '{CHANGED}' then size_bytes + 1 else size_bytes end as size_bytes,
  case when source = '{CHANGED}' then mtime + 9 else mtime end as mtime, ctime, case when source = '{CHANGED}' then sha256(text || '!') else file_hash end as file_hash, category
  from files where source <> '{GONE}')"""


def before(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).where(F.col("source") != ADDED).drop("text")


def after(spark: SparkSession, folder: str) -> DataFrame:
    moved, changed = F.col("source") == MOVED, F.col("source") == CHANGED
    return (
        files(spark, folder)
        .where(F.col("source") != GONE)
        .withColumns(
            {
                "parent_dir": F.when(moved, F.concat(F.lit("moved/"), "parent_dir")).otherwise(F.col("parent_dir")),
                "rel_path": F.when(moved, F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path")),
                "size_bytes": F.when(changed, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")),
                "mtime": F.when(changed, F.col("mtime") + 9).otherwise(F.col("mtime")),
                "file_hash": F.when(changed, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("file_hash")),
            }
        )
        .drop("text")
    )


def markdown(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """Pages as Markdown (page_id, md): headings get their marks, list items a dash, other markup goes.

    With ``parts`` the pages are dealt out by page_id before their markup is read, however few tasks the table's files and row groups allow, and sorted in each part.
    """
    md = F.col("html")
    for pattern, put in MARKDOWN_RULES:
        md = F.regexp_replace(md, pattern, put)
    pages = read(spark, folder, "pages").select("page_id", "html")
    return (pages.repartition(parts, "page_id").sortWithinPartitions("page_id") if parts else pages).select("page_id", F.trim(md).alias("md"))


MARKDOWN_RULES = (
    ("(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>", ""),
    ("(?s)<!--.*?-->", ""),
    ("<h1[^>]*>", "\n# "),
    ("<h2[^>]*>", "\n## "),
    ("<h3[^>]*>", "\n### "),
    ("<li[^>]*>", "\n- "),
    ("</?(p|h1|h2|h3|article|footer|nav|div|ul)[^>]*>", "\n\n"),
    ("<[^>]*>", ""),
)


def markdown_sql() -> str:
    md = "html"
    for pattern, put in MARKDOWN_RULES:
        pattern, put = pattern.replace("'", "''"), put.replace("\n", "' || chr(10) || '")
        md = f"regexp_replace({md}, '{pattern}', '{put}', 'g')"
    return f"markdown as (select page_id, trim({md}) as md from pages)"
