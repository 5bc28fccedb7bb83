"""Folder roll-ups, listings and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import SUPPORTED, extension_of, is_lock_file, is_system_file, name_of, parent_of


def with_ancestors(files: DataFrame) -> DataFrame:
    """A row for each file and directory above it: (dir, depth of the file below it) and the file's columns."""
    parts = F.split("parent_dir", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.withColumn("n_parts", F.size(parts)).select("*", F.posexplode(dirs).alias("at", "dir")).withColumn("below", F.col("n_parts") - F.col("at") - 1)


def folder_set(files: DataFrame) -> DataFrame:
    """All directories, those in between included."""
    return with_ancestors(files.select("parent_dir").distinct()).select("dir").distinct()


def rollup(files: DataFrame) -> DataFrame:
    """Of every directory and all below it: file_count, total_size, max_depth.

    Each directory's own files are summed first, so only directories, with their sums, go to those above them.
    """
    own = files.groupBy("parent_dir").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size"))
    return with_ancestors(own).groupBy("dir").agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"), F.max("below").cast("long").alias("max_depth"))


def extension_distribution(files: DataFrame, most: int = 20) -> DataFrame:
    """The commonest extensions of every directory: dir, ext, n; more first, then by name. Counted in each directory by itself first."""
    own = files.groupBy("parent_dir", "ext").agg(F.count("*").alias("n"))
    counts = with_ancestors(own).groupBy("dir", "ext").agg(F.sum("n").alias("n"))
    w = W.partitionBy("dir").orderBy(F.desc("n"), "ext")
    return counts.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).drop("i")


def direct_counts(files: DataFrame) -> DataFrame:
    """Files directly in each directory; directories without any count 0."""
    own = files.groupBy(F.col("parent_dir").alias("dir")).agg(F.count("*").alias("file_count"))
    return folder_set(files).join(own, "dir", "left").select("dir", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def list_dir(files: DataFrame, parent: str) -> DataFrame:
    """One level: sub-folders, then files, each by name."""
    prefix = f"{parent}/" if parent else ""
    folders = folder_set(files).where(F.col("dir").startswith(prefix) & ~F.substring("dir", len(prefix) + 1, 1 << 30).contains("/") & (F.col("dir") != parent))
    rows = folders.select(F.lit("folder").alias("kind"), F.substring_index("dir", "/", -1).alias("name"), F.lit(None).cast("long").alias("size_bytes"))
    own = files.where(F.col("parent_dir") == parent).select(F.lit("file").alias("kind"), "name", "size_bytes")
    return rows.unionByName(own).orderBy(F.desc("kind"), "name")


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by status: total, ok, stale, missing."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "stale_source").alias("stale"),
        F.count_if(F.col("status") == "missing_source").alias("missing"),
    )


def source_stats(resources: DataFrame, vectors: DataFrame) -> DataFrame:
    """Of each source: files, ok, stale_source, missing_source, analyzed (those with a summary) and chunks (its chunk vectors)."""
    own = vectors.where("level = 'chunk'").groupBy("resource_id").agg(F.count("*").alias("chunks"))
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return resources.join(own, "resource_id", "left").groupBy("source_id").agg(
        F.count("*").alias("files"), status("ok"), status("stale_source"), status("missing_source"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("analyzed"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks")
    )


def store_stats(resources: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of a whole store: resources, ok, stale_vector, stale_source, vectors."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return resources.agg(F.count("*").alias("resources"), status("ok"), status("stale_vector"), status("stale_source")).crossJoin(F.broadcast(vectors.agg(F.count("*").alias("vectors"))))


def scan_report(listing: DataFrame, entries: DataFrame) -> DataFrame:
    """What a scan reports of each directory and its direct files: (parent_dir, total, valid, missing, stale, ignored, orphans).

    ``listing``: rel_path, file_hash; ``entries``: rel_path, file_hash. System and lock files don't count at all;
    files of types that aren't analysed are ignored, whatever entry they have; without an entry a file
    is missing, with another fingerprint stale. Orphans are entries without a file, of any kind.
    """
    name, ext = name_of(F.col("rel_path")), extension_of(F.col("rel_path"))
    seen = listing.select("rel_path", F.coalesce("file_hash", F.lit("")).alias("now"), F.lit(True).alias("there"), (is_system_file(name) | is_lock_file(name)).alias("junk"), (~ext.isin(*SUPPORTED)).alias("other"))
    had = entries.select("rel_path", F.coalesce("file_hash", F.lit("")).alias("was"))
    rows = seen.join(had, "rel_path", "full_outer").withColumn("parent_dir", parent_of(F.col("rel_path")))
    state = F.when(F.col("there").isNull(), "orphans").when(F.col("junk"), "junk").when(F.col("other"), "ignored").when(F.col("was").isNull(), "missing").when(F.col("was") == F.col("now"), "valid").otherwise("stale")
    states = ("valid", "missing", "stale", "ignored", "orphans")
    counts = rows.withColumn("state", state).groupBy("parent_dir").agg(F.count_if(~F.col("state").isin("orphans", "junk")).alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in states))
    return counts.where("total + orphans > 0")


def structure(files: DataFrame, most_folders: int = 40, most_names: int = 60) -> DataFrame:
    """Of every directory and all below it: the first sub-folders and file names in order. Only the first of each are held while they are gathered."""
    rows = with_ancestors(files.select("parent_dir", "name"))
    below = F.split(F.call_function("substr", F.col("parent_dir"), F.length("dir") + 2), "/")[0]
    child = F.when(F.col("parent_dir") != F.col("dir"), below)
    seen = rows.select("dir", "name", child.alias("child"))

    def first(column: str, most: int, out: str) -> DataFrame:
        ranked = seen.where(f"{column} is not null").groupBy("dir", column).agg(F.count("*").alias("n"))
        w = W.partitionBy("dir").orderBy(column)
        return ranked.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).groupBy("dir").agg(F.array_sort(F.collect_list(column)).alias(out))

    return first("name", most_names, "names").join(first("child", most_folders, "folders"), "dir", "left")


def in_tree_order(dirs: DataFrame) -> DataFrame:
    """Directories (dir), the shallow ones first, then by name in any case."""
    return dirs.orderBy(F.size(F.split("dir", "/")), F.lower("dir"))


def entry_or_generated(asked: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, name, summary, file_count, source): what is known of each asked folder, else what its files tell."""
    direct = files.groupBy(F.col("parent_dir").alias("rel_path")).agg(F.count("*").alias("n"))
    known = folders.select("rel_path", "summary", "file_count", F.lit(True).alias("known"))
    rows = asked.join(known, "rel_path", "left").join(direct, "rel_path", "left")
    count = F.when(F.col("known"), F.col("file_count")).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select("rel_path", F.substring_index("rel_path", "/", -1).alias("name"), F.when(F.col("known"), F.col("summary")).alias("summary"), count.alias("file_count"), F.when(F.col("known"), "folders").otherwise("generated").alias("source"))


def refreshed(written: DataFrame) -> DataFrame:
    """Directories to describe anew after files of ``written`` (parent_dir) changed: these and all above them."""
    return with_ancestors(written.select("parent_dir").distinct()).select("dir").distinct()


def top_ignored(classes: DataFrame) -> DataFrame:
    """Directories (dir) with files of which none is supported, but for those whose parent is one too.

    ``classes``: parent_dir, class (of ``walk.tree_class``). Hidden, system and repository files are never seen by a
    walk, so they make no directory an ignored one.
    """
    seen = classes.where(~F.col("class").isin("hidden", "system", "repository"))
    per = seen.groupBy(F.col("parent_dir").alias("dir")).agg(F.count_if(F.col("class").isin("supported", "big")).alias("ok"))
    ignored = per.where("ok = 0").select("dir")
    above = ignored.select(F.col("dir").alias("up"), F.lit(True).alias("above"))
    up = F.when(F.col("dir") != "", parent_of(F.col("dir")))
    return ignored.withColumn("up", up).join(above, "up", "left").where("above is null").select("dir")
