"""Snapshots of an inventory and the changes that make the next one: every operator takes tables and returns tables.

Parquet has no update in place, so a change is a join of the old snapshot with what
changes; ``Snapshots`` keeps the versions in a folder and reads the last one that was written
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import name_of, normalised, normalised_identity, parent_of, schema_name
from ..sources.manifest import Manifests

LARGE = ("content_description", "transcription", "ocr_text", "images")


class Snapshots:
    """Versions of one table under a folder of any file system Spark reaches; of two writers of one version the second writes the next."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.manifests = Manifests(spark, folder)

    def versions(self) -> list[int]:
        """Versions that were committed, and so written whole."""
        return self.manifests.versions()

    def write(self, df: DataFrame) -> int:
        """Write the next version; a reader of the one before is not disturbed."""
        path = self.manifests.stage("rows", df)
        return self.manifests.update(lambda base: ({"rows": path}, {}), tries=100)

    def read(self, version: int | None = None) -> DataFrame:
        return self.manifests.table("rows", version)


def latest(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row for each key: the one whose ``newest`` is largest."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_x"))
    return best.select(*keys, *(f"_x.{c}" for c in rest)).select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return best.select(*keys, *(f"_x.{c}" for c in rest)).select(*rows.columns)


def upserted(entries: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The entries after ``new`` ones were set: of several of a key the newest of ``new`` counts, whatever was there before."""
    fresh = latest(new, keys, newest)
    return entries.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def removed(entries: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The entries without those of ``gone``; keys that no entry has are ignored."""
    return entries.join(gone.select(*keys).distinct(), keys, "left_anti")


def moved(entries: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """Entries (rel_path, original_path, moved_from, analyzed_at, ...) after ``moves`` (from_path, to_path).

    Where an entry came from is kept: its first path if that is none so far or a bare name, and
    every path it left, once each.
    """
    rows = entries.join(moves.select(F.col("from_path").alias("rel_path"), "to_path"), "rel_path", "left")
    hit, was = F.col("to_path").isNotNull(), F.col("rel_path")
    bare = F.coalesce(F.col("original_path"), F.lit("")).rlike("^[^/\\\\]*$")
    trail = F.coalesce(F.col("moved_from"), F.array().cast("array<string>"))
    changed = {
        "original_path": F.when(hit & bare, was).otherwise(F.col("original_path")),
        "moved_from": F.when(hit & ~F.array_contains(trail, was), F.concat(trail, F.array(was))).otherwise(trail),
        "analyzed_at": F.when(hit, at).otherwise(F.col("analyzed_at")),
        "rel_path": F.coalesce("to_path", "rel_path"),
    }
    return rows.withColumns(changed).select(*entries.columns)


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(light entries with data_file, the full ones of those that have any large field)."""
    large = [c for c in LARGE if c in entries.columns]
    any_large = F.lit(False)
    for c in large:
        any_large = any_large | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    marked = entries.withColumn("data_file", F.when(any_large, F.concat("rel_path", F.lit(".json"))))
    return marked.drop(*large), marked.where("data_file is not null")


def joined_entries(light: DataFrame, full: DataFrame) -> DataFrame:
    """Light entries with their full data where it is there; a light one stands for itself otherwise."""
    large = [c for c in full.columns if c not in light.columns]
    return light.join(full.select("data_file", *large), "data_file", "left")


def collected_docs(entries: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Retrieval documents (path, kind, text, context, summary, category) of entries and folders.

    The index text is path, summary, category, tags and description; the context has the
    transcription and the text of pictures as well. Empty parts are left out, and so are
    documents without any text.
    """
    parts = lambda cs: F.concat_ws("\n", *(F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in cs))
    tags = F.array_join("tags", " ")
    text = [F.col("rel_path"), F.col("summary"), F.col("category"), tags, F.col("content_description")]
    files = entries.select(
        F.col("rel_path").alias("path"), F.lit("file").alias("kind"), parts(text).alias("text"),
        parts([*text, F.col("transcription"), F.col("ocr_text")]).alias("context"), "summary", "category",
    )
    if folders is not None:
        about = parts([F.col("summary"), F.col("description"), tags])
        files = files.unionByName(folders.select(F.col("rel_path").alias("path"), F.lit("folder").alias("kind"), about.alias("text"), about.alias("context"), "summary", F.lit("目录").alias("category")))
    return files.where("trim(text) <> ''")


def staged(entries: DataFrame) -> DataFrame:
    """Entries of a staging repository that tell anything: a summary or a description."""
    return entries.where("coalesce(trim(summary), '') <> '' or coalesce(trim(content_description), '') <> ''")


def chunks_synced(vectors: DataFrame, resources: DataFrame, docs: DataFrame, deep: Column, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, counters) after the chunks of ``docs`` (source_id, rel_path, has_md) were written.

    ``chunks``: (source_id, rel_path, seq, chunk). A document outside the ``deep`` folders,
    without resource, without Markdown or without chunks is counted as such and left alone; of
    the others all chunk rows are replaced, so that a repetition changes nothing. Summary rows stay.
    """
    key = ["source_id", "rel_path"]
    count = chunks.groupBy(*key).agg(F.count("*").alias("n"))
    state = docs.select(*key, "has_md", deep.alias("deep")).join(resources.select(*key, "resource_id"), key, "left").join(count, key, "left")
    what = F.when(~F.col("deep"), "skipped_not_deep").when(F.col("resource_id").isNull(), "skipped_no_resource").when(~F.col("has_md"), "skipped_no_md").when(F.col("n").isNull(), "empty_doc").otherwise("documents")
    state = state.withColumn("what", what)
    counters = state.groupBy("what").agg(F.count("*").alias("n"), F.sum(F.when(F.col("what") == "documents", F.col("n")).otherwise(0)).alias("chunks"))
    done = state.where("what = 'documents'").select(*key, "resource_id")
    fresh = chunks.join(done, key).select("resource_id", F.lit("chunk").alias("level"), F.col("seq").alias("chunk_seq"), F.col("chunk").alias("full_text"))
    old = vectors.where("level = 'chunk'").join(done.select("resource_id"), "resource_id", "left_anti")
    kept = vectors.where("level <> 'chunk'").unionByName(old)
    return kept.unionByName(fresh, allowMissingColumns=True), counters


def without_source(resources: DataFrame, folders: DataFrame, vectors: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one source's rows; vectors go with their resources."""
    gone = resources.where(F.col("source_id") == source).select("resource_id")
    return resources.where(F.col("source_id") != source), folders.where(F.col("source_id") != source), vectors.join(gone, "resource_id", "left_anti")


def without_chunks(vectors: DataFrame, resources: DataFrame, source: str) -> DataFrame:
    """Vectors without one source's chunk rows."""
    own = resources.where(F.col("source_id") == source).select("resource_id", F.lit("chunk").alias("level"))
    return vectors.join(own, ["resource_id", "level"], "left_anti")


def folders_upserted(folders: DataFrame, meta: DataFrame) -> DataFrame:
    """Folders (source_id, rel_path, parent_dir, name, summary, description, tags, file_count) with ``meta``'s summary, description and tags; unknown ones are added."""
    key = ["source_id", "rel_path"]
    new = meta.select(*key, F.col("summary").alias("s"), F.col("description").alias("d"), F.col("tags").alias("t"), F.lit(True).alias("set"))
    rows = folders.join(new, key, "full_outer")
    pick = lambda a, b: F.when(F.col("set"), F.col(a)).otherwise(F.col(b))
    return rows.select(
        *key, F.coalesce("parent_dir", parent_of(F.col("rel_path"))).alias("parent_dir"), F.coalesce("name", name_of(F.col("rel_path"))).alias("name"),
        pick("s", "summary").alias("summary"), pick("d", "description").alias("description"), pick("t", "tags").alias("tags"), F.coalesce("file_count", F.lit(0)).alias("file_count"),
    )


def artifacts_set(resources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Resources with the column artifacts replaced where ``artifacts`` (resource_id, artifacts) has one."""
    new = artifacts.select("resource_id", F.col("artifacts").alias("_new"))
    return resources.join(new, "resource_id", "left").withColumn("artifacts", F.coalesce("_new", "artifacts")).drop("_new")


def rebound(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """(protocol, host, port, username, schema_name, changed): the registry after identities changed.

    ``changes``: the old identity and new_host, new_port, new_username, null where they stay.
    A change of an identity that isn't registered is an error.
    """
    key = ["protocol", "host", "port", "username"]
    rows = registry.select(*key, "schema_name").join(changes.withColumn("asked", F.lit(True)), key, "full_outer")
    new = normalised_identity(F.col("protocol"), F.coalesce("new_host", "host"), F.coalesce(F.col("new_port").cast("string"), F.col("port").cast("string")), F.coalesce("new_username", "username"))
    known = F.when(F.col("schema_name").isNull(), F.raise_error(F.concat(F.lit("no such identity: "), "host")).cast("string")).otherwise(F.col("schema_name"))
    name = F.when(F.col("asked"), schema_name(F.col("new"))).otherwise(known)
    return rows.withColumn("new", new).select("new.*", F.when(known.isNotNull(), name).alias("schema_name"), (F.coalesce("asked", F.lit(False)) & (name != known)).alias("changed"))


def terms_added(known: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms (term) that are new: trimmed, no blank, each once, none that is known."""
    return terms.select(F.trim("term").alias("term")).where("term <> ''").distinct().join(known.select("term"), "term", "left_anti")


def remapped(index: DataFrame, mapping: DataFrame) -> DataFrame:
    """The index (path, ...) with the paths of ``mapping`` (old, new) replaced, compared in a normal form; changed says where."""
    to = mapping.select(normalised(F.col("old")).alias("_key"), F.col("new").alias("_new"))
    rows = index.withColumn("_key", normalised(F.col("path"))).join(to, "_key", "left")
    return rows.withColumn("changed", F.col("_new").isNotNull() & (F.col("_new") != F.col("path"))).withColumn("path", F.coalesce("_new", "path")).drop("_key", "_new")


def exported_markdown(docs: DataFrame) -> DataFrame:
    """(path, md): a file for each document of kind file: front matter, summary and body.

    ``docs``: path, kind, category, tags, summary, context, text.
    """
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform("tags", quoted), ", "), F.lit("]")))
    body = F.regexp_replace(F.coalesce(F.nullif("context", F.lit("")), "text", F.lit("")), r"^\s+|\s+$", "")
    lines = [
        F.lit("---"), F.concat(F.lit("path: "), quoted(F.col("path"))), F.concat(F.lit("kind: "), F.coalesce(F.nullif("kind", F.lit("")), F.lit("file"))),
        F.when(has("category"), F.concat(F.lit("category: "), quoted(F.col("category")))), tags, F.when(has("summary"), F.concat(F.lit("summary: "), quoted(F.col("summary")))),
        F.lit("---"), F.lit(""), line("## 摘要\n\n", F.col("summary")), F.when(has("summary"), F.lit("")), F.when(body != "", F.lit("## 内容\n")), F.when(body != "", body),
    ]
    md = F.concat(F.regexp_replace(F.concat_ws("\n", *lines), r"\s+$", ""), F.lit("\n"))
    return docs.where("kind = 'file' and coalesce(path, '') <> ''").select("path", md.alias("md"))


def exported_repository(resources: DataFrame) -> DataFrame:
    """What an export of a source's tables writes for each folder: its entries in order; rows whose source is missing are left out."""
    entry = F.struct(name_of(F.col("rel_path")).alias("path"), "file_hash", "category", "summary")
    return resources.where("status <> 'missing_source'").groupBy("source_id", "parent_dir").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))


def audited(operations: DataFrame, folder: str) -> None:
    """Append operations to a log of JSON lines."""
    operations.write.mode("append").json(folder)
