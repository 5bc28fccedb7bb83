"""Walks over a listing: which files are registered, which analysed, and what a batch counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as ff

REPOSITORY = ".index"


def walked(listing: DataFrame, max_mb: int = 0) -> DataFrame:
    """Inventory items (rel_path, name, parent_dir, size_bytes, mtime, ctime, file_type, too_big) of a listing (path, size_bytes, mtime, ctime).

    Files below hidden and system folders, system files and lock files are left out; files
    over ``max_mb`` stay, marked, to be counted. Hidden files outside hidden folders stay.
    """
    path = F.translate("path", "\\", "/")
    name = ff.name_of(F.col("rel_path"))
    rows = listing.withColumn("rel_path", path)
    keep = ~ff.in_hidden_folder(F.col("rel_path")) & ~ff.in_folder_of(F.col("rel_path"), ff.WALK_EXCLUDED) & ~F.lower(name).isin(*ff.WALK_SYSTEM_FILES) & ~ff.is_lock_file(name)
    big = (F.col("size_bytes") > max_mb * 1024 * 1024) if max_mb else F.lit(False)
    return rows.where(keep).select("rel_path", name.alias("name"), ff.parent_of(F.col("rel_path")).alias("parent_dir"), "size_bytes", "mtime", "ctime", ff.extension_of(F.col("rel_path")).alias("file_type"), big.alias("too_big"))


def tree_class(path: Column, size: Column, excluded: tuple[str, ...] = (), max_mb: int = 0) -> Column:
    """What a tree analysis does with a file: repository, hidden, system, excluded, unsupported, big or supported; the first that fits."""
    name, ext = ff.name_of(path), ff.extension_of(path)
    big = (size > max_mb * 1024 * 1024) if max_mb else F.lit(False)
    return (
        F.when(F.array_contains(F.split(path, "/"), REPOSITORY), "repository")
        .when(ff.in_hidden_folder(path), "hidden")
        .when(ff.is_system_file(name) | ff.is_lock_file(name), "system")
        .when(ff.in_folder_of(path, tuple(x.lower() for x in excluded)), "excluded")
        .when(~ext.isin(*ff.SUPPORTED), "unsupported")
        .when(big, "big")
        .otherwise("supported")
    )


def batch_counts(classes: DataFrame) -> DataFrame:
    """One row of counters from the column class: total is what is supported, unsupported or too big."""
    n = lambda *c: F.count_if(F.col("class").isin(*c))
    return classes.agg(n("supported", "unsupported", "big").alias("total"), n("supported").alias("supported"), n("unsupported").alias("unsupported"), n("big").alias("big"), n("excluded").alias("excluded"))


def with_missing_hashes(items: DataFrame, contents: DataFrame, max_mb: int = 512) -> DataFrame:
    """Items (rel_path, size_bytes, file_hash, hash_algorithm) with the fingerprints that they lack, from contents (rel_path, text); larger files keep none."""
    wanted = (F.coalesce("file_hash", F.lit("")) == "") & (F.col("size_bytes") <= max_mb * 1024 * 1024)
    rows = items.join(contents.select("rel_path", "text"), "rel_path", "left")
    new = F.when(wanted & F.col("text").isNotNull(), ff.fingerprint(F.col("text")))
    return rows.withColumn("_new", new).select("rel_path", "size_bytes", F.coalesce("_new", "file_hash").alias("file_hash"), F.when(F.col("_new").isNotNull(), ff.fingerprint_algorithm(F.col("size_bytes"))).otherwise(F.col("hash_algorithm")).alias("hash_algorithm"))


def extractable(files: DataFrame, max_bytes: int) -> DataFrame:
    """(rel_path, error): files over the cap are refused before their contents are read."""
    return files.select("rel_path", F.when(F.col("size_bytes") > max_bytes, F.concat(F.lit("larger than "), F.lit(str(max_bytes)))).alias("error"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, else GBK, else Latin-1, the first that takes all of them. Spark decodes no GBK, so this is an Arrow batch function."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data):
            for encoding in ("utf-8", "gbk"):
                try:
                    return bytes(data).decode(encoding)
                except UnicodeDecodeError:
                    continue
            return bytes(data).decode("latin-1")

        for part in parts:
            yield part.map(one, na_action="ignore")

    return decode(content)


def folder_summary(path: Column, n: Column, size: Column, depth: Column) -> Column:
    """A folder's description that is made without a model."""
    return F.concat(F.lit("目录 "), path, F.lit("："), n.cast("string"), F.lit(" 个文件，共 "), ff.human_size(size), F.lit("，最深 "), depth.cast("string"), F.lit(" 层"))
