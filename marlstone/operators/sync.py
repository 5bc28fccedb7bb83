"""Change detection between two snapshots of an inventory, as one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import close_to, stat_unchanged

STAT = ("size_bytes", "mtime", "ctime")


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, o, n): the rows of both snapshots by path; o or n is null where one has none. A snapshot without hash_algorithm or status has blank ones; without has_content, all was analysed."""

    def pack(d: DataFrame, name: str) -> DataFrame:
        blank = [(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(c) for c in ("hash_algorithm", "status")]
        content = (F.coalesce("has_content", F.lit(False)) if "has_content" in d.columns else F.lit(True)).alias("has_content")
        return d.select("rel_path", F.struct("file_hash", *STAT, "parent_dir", *blank, content).alias(name))

    return pack(old, "o").join(pack(new, "n"), "rel_path", "full_outer")


def _stat(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in STAT}


def _same_hash() -> Column:
    """The same fingerprint by the same algorithm; an empty one is like none."""
    algorithms = F.coalesce("o.hash_algorithm", F.lit("")) == F.coalesce("n.hash_algorithm", F.lit(""))
    return F.coalesce((F.col("o.file_hash") == F.col("n.file_hash")) & (F.col("o.file_hash") != "") & algorithms, F.lit(False))


def source_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dry run: rel_path, change (added, missing, changed, unchanged). A fingerprint differs only where both are known; a stale row counts as changed."""
    known = (F.coalesce("o.file_hash", F.lit("")) != "") & (F.coalesce("n.file_hash", F.lit("")) != "")
    differs = (known & (F.col("o.file_hash") != F.col("n.file_hash"))) | ~close_to(F.col("o.mtime"), F.col("n.mtime")) | ~close_to(F.col("o.size_bytes"), F.col("n.size_bytes"))
    stale = F.coalesce(F.col("o.status") == "stale_source", F.lit(False))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "missing").when(differs | stale, "changed").otherwise("unchanged")
    return paired(old, new).select("rel_path", change.alias("change"))


def _moves(both: DataFrame) -> DataFrame:
    def side(other: str, s: str, path: str) -> DataFrame:
        rows = both.where(f"{other} is null").select(F.col(f"{s}.file_hash").alias("file_hash"), F.coalesce(f"{s}.hash_algorithm", F.lit("")).alias("algorithm"), F.col("rel_path").alias(path))
        return rows.where("file_hash <> ''").withColumn("i", F.row_number().over(W.partitionBy("file_hash", "algorithm").orderBy(path)))

    return side("n", "o", "from_path").join(side("o", "n", "to_path"), ["file_hash", "algorithm", "i"]).select("from_path", "to_path")


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(from_path, to_path): files that went from one path and came, with the same fingerprint by the same algorithm, at a new one.

    Several of one fingerprint are paired in the order of their paths. Only added paths
    are targets; an empty fingerprint never matches.
    """
    return _moves(paired(old, new))


def classified(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, action, from_path): added, updated, moved, deleted or unchanged."""
    both = paired(old, new)
    pairs = _moves(both)
    # a row for each place: a move's target, with its origin, and its origin, which goes
    marks = pairs.select(F.col("to_path").alias("rel_path"), "from_path").unionByName(pairs.select(F.col("from_path").alias("rel_path"), F.lit(None).cast("string").alias("from_path")))
    change = (
        F.when(F.col("from_path").isNotNull(), "moved")
        .when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "deleted")
        .when(_same_hash(), "unchanged")
        .otherwise("updated")
    )
    rows = both.join(marks.withColumn("marked", F.lit(True)), "rel_path", "left")
    return rows.where("marked is null or from_path is not null").select("rel_path", change.alias("action"), "from_path")


def vector_sync(resources: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """(source_id, rel_path, action, from_path): what a sync of ``docs`` does to the resources of the sources it names.

    As ``classified``, in each source by itself; a row whose content is the same but that has
    no summary vector is enriched. Resources of other sources are left alone. Of several
    documents of one path the first by name order counts.
    """
    scope = docs.select("source_id").distinct()
    with_vector = vectors.where("level = 'summary'").select("resource_id").distinct().withColumn("has_vector", F.lit(True))
    have = resources.join(F.broadcast(scope), "source_id", "left_semi").join(with_vector, "resource_id", "left")
    key = lambda d: d.withColumn("rel_path", F.concat_ws("\x01", "source_id", "rel_path"))
    flat = key(have).withColumn("parent_dir", F.col("source_id"))
    actions = classified(flat, key(docs).withColumn("parent_dir", F.col("source_id")))
    lacking = flat.where("has_vector is null").select("rel_path", F.lit(True).alias("lacking"))
    action = F.when((F.col("action") == "unchanged") & F.col("lacking"), "enriched").otherwise(F.col("action"))
    part = lambda c, i: F.split(c, "\x01")[i]
    return actions.join(lacking, "rel_path", "left").select(part("rel_path", 0).alias("source_id"), part("rel_path", 1).alias("rel_path"), action.alias("action"), part("from_path", 1).alias("from_path"))


def synced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new snapshot: rel_path, file_hash, version_of (the path it came from), prev_hash."""
    state = classified(old, new).where("action <> 'deleted'")
    hashes = new.select("rel_path", "file_hash")
    before = old.select(F.col("rel_path").alias("was"), F.col("file_hash").alias("prev_hash"))
    return (
        state.join(hashes, "rel_path")
        .withColumn("was", F.coalesce("from_path", "rel_path"))
        .join(before, "was", "left")
        .select("rel_path", "file_hash", F.when(F.col("prev_hash").isNotNull(), F.col("was")).alias("version_of"), F.when(F.col("prev_hash") != F.col("file_hash"), F.col("prev_hash")).alias("prev_hash"))
    )


def reconciled(old: DataFrame, new: DataFrame, old_status: Column | None = None) -> DataFrame:
    """(rel_path, status, file_hash, outcome) after a walk: the state machine of an inventory.

    New rows are ok. An equal stat (within 1e-6; a ctime unknown on both sides is equal) or
    fingerprint leaves a row as it is, and fills in a fingerprint that is missing; an equal
    stat alone brings a missing row back; anything else is stale and keeps its old fingerprint
    until it is analysed again; rows not walked are missing.
    """
    both = paired(old if old_status is None else old.withColumn("status", old_status), new)
    same_stat = close_to(F.col("o.mtime"), F.col("n.mtime")) & close_to(F.col("o.ctime"), F.col("n.ctime")) & (F.coalesce("o.size_bytes", F.lit(0)) == F.coalesce("n.size_bytes", F.lit(0)))
    was = F.coalesce("o.status", F.lit("ok"))
    missing = was == "missing_source"
    outcome = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "missing")
        .when(~missing & (same_stat | _same_hash()), "unchanged")
        .when(missing & same_stat, "restored")
        .otherwise("stale")
    )
    after = F.when(F.col("outcome").isin("added", "restored"), "ok").when(F.col("outcome") == "missing", "missing_source").when(F.col("outcome") == "stale", "stale_source").otherwise(was)
    filled = F.when(F.col("outcome") == "unchanged", F.coalesce(F.nullif("o.file_hash", F.lit("")), "n.file_hash", "o.file_hash")).otherwise(F.coalesce("o.file_hash", "n.file_hash"))
    return both.withColumn("outcome", outcome).select("rel_path", after.alias("status"), filled.alias("file_hash"), "outcome")


def has_content(entries: DataFrame) -> Column:
    """Whether an entry tells anything: a summary, a description, a transcription or a text of a picture."""
    out = F.lit(False)
    for c in ("summary", "content_description", "transcription", "ocr_text"):
        if c in entries.columns:
            out = out | (F.coalesce(F.col(c), F.lit("")) != "")
    return out


def incremental_levels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, level, upgraded): skip_stat, skip_hash, skip_upgrade or analyse.

    Only what was analysed before (has_content) is ever skipped: by an equal stat, by an equal fingerprint of the
    same algorithm, or where the old fingerprint names no algorithm and can't be compared. upgraded: such
    an old fingerprint is replaced by the new one, also where the stat is equal.
    """
    one = "hash_algorithm" not in old.columns and "hash_algorithm" not in new.columns  # where no one tells, there is one algorithm
    o_algorithm, n_algorithm = (F.lit("one") if one else F.coalesce(f"{s}.hash_algorithm", F.lit("")) for s in "on")
    n_hash = F.coalesce("n.file_hash", F.lit(""))
    known = F.coalesce(F.col("o.has_content"), F.lit(False))
    same = F.coalesce(stat_unchanged(_stat("o"), _stat("n")), F.lit(False))
    hashed = (n_algorithm != "") & (n_hash != "") & (o_algorithm == n_algorithm) & (F.coalesce("o.file_hash", F.lit("")) == n_hash)
    level = F.when(~known, "analyse").when(same, "skip_stat").when(hashed, "skip_hash").when(o_algorithm == "", "skip_upgrade").otherwise("analyse")
    rows = paired(old, new).where("n is not null").select("rel_path", level.alias("level"), (o_algorithm == "").alias("blank"))
    return rows.select("rel_path", "level", ((F.col("level") != "analyse") & F.col("blank")).alias("upgraded"))
