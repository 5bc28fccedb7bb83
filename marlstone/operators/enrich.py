"""From analysed entries to a source's resources, vectors, chunks and folders, in one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import name_of, parent_of
from ..functions.text import search_tokens
from ..sources.manifest import Manifests
from . import chunks as parts
from . import rank, store, sync

RESOURCES = "resource_id string, source_id string, rel_path string, parent_dir string, name string, file_hash string, hash_algorithm string, size_bytes long, mtime double, ctime double, summary string, category string, tags array<string>, status string, prev_hashes array<string>"
VECTORS = "resource_id string, level string, chunk_seq int, full_text string, embedding array<double>"
FOLDERS = "source_id string, rel_path string, parent_dir string, name string, summary string, description string, tags array<string>, file_count long"
ACTIONS = ("added", "updated", "moved", "deleted", "enriched", "unchanged")


def embedded(text: Column) -> Column:
    return rank.hashed_embedding(search_tokens(text))


def resources_synced(resources: DataFrame, docs: DataFrame, actions: DataFrame, source: str, version: int) -> DataFrame:
    """The resources of one source after ``actions`` (rel_path, action, from_path) of its documents.

    A moved document keeps its number; an old fingerprint that changed is remembered. A new number is made of
    the path and the version, so that a path that was left and is used again gets another one.
    """
    was = resources.where(F.col("source_id") == source).select(F.col("rel_path").alias("was"), F.col("resource_id").alias("old_id"), F.col("file_hash").alias("old_hash"), "prev_hashes")
    rows = actions.where("action <> 'deleted'").withColumn("was", F.coalesce("from_path", "rel_path")).join(docs, "rel_path").join(was, "was", "left")
    fresh = F.sha1(F.concat_ws("\x01", F.lit(source), "rel_path", F.lit(str(version))))
    before = F.coalesce("prev_hashes", F.array().cast("array<string>"))
    changed = F.col("old_hash").isNotNull() & (F.col("old_hash") != "") & (F.col("old_hash") != F.col("file_hash"))
    own = rows.select(
        F.coalesce("old_id", fresh).alias("resource_id"), F.lit(source).alias("source_id"), "rel_path", parent_of(F.col("rel_path")).alias("parent_dir"), name_of(F.col("rel_path")).alias("name"), "file_hash", "hash_algorithm",
        F.col("size_bytes").cast("long").alias("size_bytes"), F.col("mtime").cast("double").alias("mtime"), F.col("ctime").cast("double").alias("ctime"), "summary", "category", "tags", F.lit("ok").alias("status"),
        F.when(changed, F.concat(before, F.array("old_hash"))).otherwise(before).alias("prev_hashes"),
    )
    return resources.where(F.col("source_id") != source).unionByName(own)


def enriched(manifests: Manifests, source: str, entries: DataFrame, folder_meta: DataFrame | None = None, deep: bool = False, embed: Callable[[Column], Column] = embedded) -> dict:
    """Synchronise a source with its analysed ``entries`` and commit resources, vectors and folders together; a report.

    ``entries``: rel_path, file_hash, hash_algorithm, size_bytes, mtime, ctime, summary, content_description, category, tags, md (Markdown or null). Entries that tell
    nothing don't count as documents; of several of one path the first by fingerprint does. New and changed documents, and those that lack one, get a summary vector; with
    ``deep`` the chunks of all documents are written anew. Folders of ``folder_meta`` (rel_path, summary, description, tags) are set. A repetition changes nothing.
    Where another writer commits first, all is worked out again from what is there then; no reader sees a part.
    """
    spark = entries.sparkSession
    report: dict = {}

    def change(base: int) -> tuple[dict, dict]:
        have = lambda name, schema: manifests.table(name, base) if base else spark.createDataFrame([], schema)
        resources, vectors, folders = have("resources", RESOURCES), have("vectors", VECTORS), have("folders", FOLDERS)
        docs = store.first_wins(store.staged(entries), ["rel_path"], "file_hash")
        actions_path = manifests.stage("actions", sync.vector_sync(resources, vectors, docs.withColumn("source_id", F.lit(source))).where(F.col("source_id") == source))
        actions = spark.read.parquet(actions_path)
        resources_path = manifests.stage("resources", resources_synced(resources, docs, actions, source, base + 1))
        now = spark.read.parquet(resources_path)
        own = now.where(F.col("source_id") == source)

        telling = actions.where("action in ('added', 'updated', 'enriched')").select("rel_path").join(own, "rel_path").join(docs.select("rel_path", "content_description"), "rel_path")
        text = F.concat_ws("\n", "rel_path", F.nullif("summary", F.lit("")), F.nullif("category", F.lit("")), F.nullif(F.array_join("tags", " "), F.lit("")), F.nullif("content_description", F.lit("")))
        fresh = telling.select("resource_id", F.lit("summary").alias("level"), F.lit(None).cast("int").alias("chunk_seq"), text.alias("full_text")).withColumn("embedding", embed(F.col("full_text")))
        left = vectors.join(now.select("resource_id"), "resource_id", "left_semi").join(fresh.select("resource_id", "level"), ["resource_id", "level"], "left_anti")
        after, counters = left.unionByName(fresh), None
        if deep:
            pieces = parts.chunks(docs.where("md is not null").select("rel_path", "md"), "rel_path").select(F.lit(source).alias("source_id"), "rel_path", "seq", parts.embedding_text(F.col("breadcrumb"), F.col("chunk")).alias("chunk"))
            after, counters = store.chunks_synced(after, own, docs.select(F.lit(source).alias("source_id"), "rel_path", F.col("md").isNotNull().alias("has_md")), F.lit(True), pieces)
            lacking = (F.col("level") == "chunk") & F.col("embedding").isNull()
            after = after.withColumn("embedding", F.when(lacking, embed(F.col("full_text"))).otherwise(F.col("embedding")))
        vectors_path = manifests.stage("vectors", after)

        if folder_meta is not None:
            folders = store.folders_upserted(folders, folder_meta.select(F.lit(source).alias("source_id"), "rel_path", "summary", "description", "tags"))
        counts = own.groupBy(F.col("parent_dir").alias("rel_path")).agg(F.count("*").alias("n")).withColumn("source_id", F.lit(source))
        known = folders.join(counts, ["source_id", "rel_path"], "left").withColumn("file_count", F.when(F.col("source_id") == source, F.coalesce("n", F.lit(0))).otherwise(F.col("file_count"))).drop("n")
        new = counts.join(folders.select("source_id", "rel_path"), ["source_id", "rel_path"], "left_anti")
        none = F.lit(None).cast("string")
        added = new.select("source_id", "rel_path", parent_of(F.col("rel_path")).alias("parent_dir"), name_of(F.col("rel_path")).alias("name"), none.alias("summary"), none.alias("description"), F.array().cast("array<string>").alias("tags"), F.col("n").alias("file_count"))
        folders_path = manifests.stage("folders", known.unionByName(added))

        done = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        report.clear()
        report.update({a: done.get(a, 0) for a in ACTIONS})
        if counters is not None:
            report["deep"] = {r["what"]: (r["n"], r["chunks"]) for r in counters.collect()}
        return {"resources": resources_path, "vectors": vectors_path, "folders": folders_path}, {}

    report["version"] = manifests.update(change)
    return report
