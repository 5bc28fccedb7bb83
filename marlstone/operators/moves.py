"""Application of plans whose moves depend on each other: chains, swaps, several moves to one place.

Moves are applied one after the other, deepest sources first. Two of them depend on each
other only through what both touch: the names of a family (``a.txt``, ``a (1).txt``, ...), a source, or a
directory that is also a target. In each round every move is decided that no earlier undecided one
can influence, all at once, and the files that they touch are brought up to date by joins. The
rounds grow with the longest chain of dependent moves and not with their number: moves to one free or
taken place are one batch, in which free names are dealt by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import depth_of, name_of, parent_of
from ..sources.shelf import Rounds
from .folders import with_ancestors
from .reorganise import validated

_NUMBER = r" \(([1-9][0-9]{0,8})\)$"


def split_name(path: Column) -> tuple[Column, Column]:
    """(stem, extension with its dot) of the last name of a path."""
    name = name_of(path)
    dotted = name.contains(".")
    return F.when(dotted, F.regexp_extract(name, "^(.*)[.][^.]*$", 1)).otherwise(name), F.when(dotted, F.regexp_extract(name, "([.][^.]*)$", 1)).otherwise(F.lit(""))


def in_folder(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def family(path: Column) -> Column:
    """The path without any numbers at the end of its stem: names that could be given in place of each other share it."""
    stem, ext = split_name(path)
    return in_folder(parent_of(path), F.concat(F.regexp_replace(stem, r"( \([1-9][0-9]{0,8}\))+$", ""), ext))


def _ancestors(path: Column) -> Column:
    """All directories above a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _inside() -> Column:
    """Whether a move's source lies below its target."""
    return F.col("from_path").startswith(F.concat("to_path", F.lit("/")))


def _touched(open_moves: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(key, mode, at): what each undecided move touches; moves of one key and mode don't disturb each other.

    ``doubtful``: paths (dir) that are, or may become, a file as well as a directory.
    """
    own = F.to_json("at")
    to_family, from_family = family(F.col("to_path")), family(F.col("from_path"))
    within = F.when(to_family == from_family, F.concat(F.lit("within "), own))
    fixed = F.array(
        F.struct(F.concat(F.lit("family "), to_family).alias("key"), F.coalesce(within, F.concat(F.lit("to "), F.col("to_path"))).alias("mode")),
        F.struct(F.concat(F.lit("family "), from_family).alias("key"), F.coalesce(within, F.lit("from")).alias("mode")),
        F.struct(F.concat(F.lit("source "), F.col("from_path")).alias("key"), own.alias("mode")),
    )
    plain = open_moves.select("at", F.explode(fixed).alias("t")).select("t.key", "t.mode", "at")
    places = open_moves.select("at", F.explode(F.array("from_path", "to_path")).alias("path"))
    below = places.select("at", F.explode(_ancestors(F.col("path"))).alias("dir")).join(doubtful, "dir").select(F.concat(F.lit("directory "), F.col("dir")).alias("key"), F.lit("below").alias("mode"), "at")
    # what lies below its own target finds a directory there as long as it lies there, whatever others do
    ends = F.array(F.struct(F.col("from_path").alias("dir"), own.alias("by")), F.struct(F.when(~_inside(), F.col("to_path")).alias("dir"), F.lit("to").alias("by")))
    there = open_moves.select("at", F.explode(ends).alias("e")).select("at", "e.*").join(doubtful, "dir").select(F.concat(F.lit("directory "), F.col("dir")).alias("key"), F.concat(F.lit("at "), F.col("by")).alias("mode"), "at")
    # a move that touches a directory in two ways, as one from d to d/e does, is like no other there
    several = below.unionByName(there).groupBy("key", "at").agg(F.min("mode").alias("mode"), F.count_distinct("mode").alias("n"))
    dirs = several.select("key", F.when(F.col("n") > 1, F.concat(F.lit("alone "), F.to_json("at"))).otherwise(F.col("mode")).alias("mode"), "at")
    return plain.unionByName(dirs).distinct()


def _ready(open_moves: DataFrame, touched: DataFrame) -> DataFrame:
    """The undecided moves that no earlier one can influence: on every key, all earlier ones have their mode. Of those to one target, only the ones before the first that has to wait."""
    modes = touched.groupBy("key", "mode").agg(F.min("at").alias("at"))
    first = modes.groupBy("key").agg(F.min_by("mode", "at").alias("first"))
    bound = modes.join(first, "key").where("mode <> first").groupBy("key").agg(F.min("at").alias("bound"))
    waiting = touched.join(bound, "key").where("at >= bound").select("at").distinct()
    barred = waiting.join(touched.where("mode like 'to %'"), "at").groupBy("mode").agg(F.min("at").alias("barred"))
    free = open_moves.join(waiting, "at", "left_anti").withColumn("mode", F.concat(F.lit("to "), F.col("to_path"))).join(barred, "mode", "left")
    return free.where("barred is null or at < barred").drop("mode", "barred")


def _numbers(names: DataFrame, files: DataFrame) -> DataFrame:
    """(at, free): the k-th free numbered name beside to_path for each row (at, to_path, k).

    The k-th number that isn't used is k and the used ones that have fewer than k free ones
    before them, which one pass over both in order counts.
    """
    stem, ext = split_name(F.col("rel_path"))
    used = files.select(parent_of(F.col("rel_path")).alias("d"), F.regexp_replace(stem, _NUMBER, "").alias("s"), ext.alias("e"), F.regexp_extract(stem, _NUMBER, 1).alias("n")).where("n <> ''")
    stem, ext = split_name(F.col("to_path"))
    wanted = names.select("at", "k", parent_of(F.col("to_path")).alias("d"), stem.alias("s"), ext.alias("e"))
    key = ["d", "s", "e"]
    gaps = used.join(wanted.select(*key).distinct(), key, "left_semi").select(*key, F.col("n").cast("long").alias("n"))
    gaps = gaps.withColumn("k", F.col("n") - F.row_number().over(W.partitionBy(*key).orderBy("n")) + 1)
    both = wanted.withColumn("is_used", F.lit(0)).unionByName(gaps.withColumns({"is_used": F.lit(1), "at": F.lit(None).cast(wanted.schema["at"].dataType)}).select(*wanted.columns, "is_used"))
    before = F.sum("is_used").over(W.partitionBy(*key).orderBy("k", F.desc("is_used"), "at").rowsBetween(W.unboundedPreceding, 0))
    name = F.concat("s", F.lit(" ("), (F.col("k") + before).cast("string"), F.lit(")"), "e")
    return both.select("at", "is_used", in_folder(F.col("d"), name).alias("free")).where("is_used = 0").drop("is_used")


def _decided(ready: DataFrame, files: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Ready moves with result, target and their source's hash and analysed."""
    source = files.select(F.col("rel_path").alias("from_path"), F.col("file_hash").alias("hash"), "analysed")
    there = files.select(F.col("rel_path").alias("to_path"), F.col("file_hash").alias("to_hash"), F.col("analysed").alias("to_analysed"), F.lit(True).alias("taken"))
    # a doubtful target with files below it is a directory; a target below a doubtful path that is a file has no place
    full = files.select(F.explode(_ancestors(F.col("rel_path"))).alias("dir")).distinct().join(doubtful, "dir").select(F.col("dir").alias("to_path"), F.lit(True).alias("is_dir"))
    solid = doubtful.join(files.select(F.col("rel_path").alias("dir")), "dir")
    blocked = ready.select("at", F.explode(_ancestors(F.col("to_path"))).alias("dir")).join(solid, "dir").select("at", F.lit(True).alias("blocked")).distinct()
    rows = ready.join(source, "from_path", "left").join(there, "to_path", "left").join(full, "to_path", "left").join(blocked, "at", "left")
    stale = (F.coalesce("h_then", F.lit("")) != "") & (F.col("h_then") != F.col("hash"))
    rows = rows.withColumn("early", F.when(F.col("hash").isNull(), "not_found").when(stale, "stale_source").when(F.col("is_dir") | F.col("blocked") | _inside(), "conflict"))

    group = W.partitionBy("to_path", F.col("early").isNull()).orderBy("at")
    so_far, earlier = group.rowsBetween(W.unboundedPreceding, 0), group.rowsBetween(W.unboundedPreceding, -1)
    lands = F.col("taken").isNull() & (F.row_number().over(group) == 1)  # the first to a free place
    rows = rows.withColumn("lands", lands)
    held = rows.withColumns({"h": F.coalesce("to_hash", F.first("hash").over(so_far)), "a": F.when(F.col("taken"), F.col("to_analysed")).otherwise(F.first("analysed").over(so_far))})
    held = held.withColumn("differs", ~F.col("lands") & ~((F.col("hash") == F.col("h")) & (F.col("hash") != "")))
    # a target without analysis takes that of the files that differ from it until one has any
    given = F.coalesce(F.max((F.col("differs") & F.col("analysed")).cast("int")).over(earlier), F.lit(0)) == 1
    held = held.withColumn("meta", F.col("differs") & ~F.col("a") & ~given)
    renamed = F.col("differs") & ~F.col("meta") & F.col("early").isNull()
    held = held.withColumns({"renamed": renamed, "k": F.sum(renamed.cast("long")).over(so_far)})
    free = _numbers(held.where("renamed").select("at", "to_path", "k"), files)
    result = F.coalesce("early", F.when(F.col("lands") | F.col("renamed"), "moved").when(F.col("meta"), "meta_only").otherwise("noop"))
    out = held.join(free, "at", "left").withColumn("result", result)
    return out.select("at", "from_path", "to_path", "result", F.when(F.col("result") == "moved", F.coalesce("free", "to_path")).alias("target"), "hash", "analysed")


def _after(files: DataFrame, decided: DataFrame) -> DataFrame:
    """The files (rel_path, file_hash, analysed) after the decided moves."""
    gone = decided.where("result = 'moved'")
    come = gone.select(F.col("target").alias("rel_path"), F.col("hash").alias("file_hash"), "analysed")
    told = decided.where("result = 'meta_only'").groupBy(F.col("to_path").alias("rel_path")).agg(F.max("analysed").alias("told"))
    left = files.join(gone.select(F.col("from_path").alias("rel_path")), "rel_path", "left_anti").join(told, "rel_path", "left")
    return left.select("rel_path", "file_hash", (F.col("analysed") | F.coalesce("told", F.lit(False))).alias("analysed")).unionByName(come)


def applied(moves: DataFrame, snapshot: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """What applying a plan does to each move, on the tables alone: (from_path, to_path, result, target).

    ``moves``: from_path, to_path and, if the plan has an order, idx; deeper sources go first, then by
    idx and paths; repeated rows count once. ``files``: rel_path, file_hash, analysed. Rejected: what ``validated`` rejects;
    not_found: no file is at the source when it is the move's turn; stale_source: its fingerprint then isn't that of ``snapshot``
    (rel_path, file_hash); conflict: a directory is at the target, or a file where a directory of its would be; noop: the same
    content is there; meta_only: a file without analysis is there, and takes the source's; else moved, to the target or, where
    that is taken, the first free ``stem (n).ext``. A source without fingerprint is never equal to anything. No two moves get one target.
    """
    spark = moves.sparkSession
    rounds = Rounds(spark, "moves")
    idx = F.col("idx").cast("long") if "idx" in moves.columns else F.lit(0).cast("long")
    rows = moves.select(idx.alias("idx"), "from_path", "to_path").distinct()
    checked = rows.join(validated(rows.select("from_path", "to_path").distinct(), root, files), ["from_path", "to_path"])
    at = F.struct((-depth_of(F.col("from_path"))).alias("d"), "idx", F.col("from_path").alias("f"), F.col("to_path").alias("t"))
    checked = rounds.put("checked", checked.withColumn("at", at))
    checked = checked.withColumn("reason", F.when((F.col("reason") == "unknown source") & (F.col("from_path") == F.col("to_path")), "no change").otherwise(F.col("reason")))
    refused = F.col("reason").isNotNull() & (F.col("reason") != "unknown source")
    out = checked.where(refused).select("from_path", "to_path", F.when(F.col("reason") == "no change", "noop").otherwise("rejected").alias("result"), F.lit(None).cast("string").alias("target"))

    then = snapshot.select(F.col("rel_path").alias("from_path"), F.col("file_hash").alias("h_then"))
    open_moves = rounds.put("open", checked.where(~refused).join(then, "from_path", "left").select("at", "from_path", "to_path", "h_then"))
    targets = open_moves.select(F.col("to_path").alias("dir")).distinct()
    have = files.select("rel_path", F.coalesce("file_hash", F.lit("")).alias("file_hash"), F.coalesce("analysed", F.lit(False)).alias("analysed"))
    folders = with_ancestors(files.select("parent_dir").distinct()).select("dir") if "parent_dir" in files.columns else files.select(F.explode(_ancestors(F.col("rel_path"))).alias("dir"))
    to_be = open_moves.select(F.explode(_ancestors(F.col("to_path"))).alias("dir")).distinct()
    mixed = targets.join(folders.unionByName(to_be).distinct(), "dir", "left_semi").unionByName(to_be.join(have.select(F.col("rel_path").alias("dir")), "dir", "left_semi"))
    doubtful = rounds.put("doubtful", mixed.distinct())
    # only files that a move can meet take part in the rounds
    families = open_moves.select(F.explode(F.array(family(F.col("from_path")), family(F.col("to_path")))).alias("family")).distinct()
    near = have.withColumn("family", family(F.col("rel_path"))).join(families, "family", "left_semi").drop("family")
    within = have.select("*", F.explode(F.concat(F.array("rel_path"), _ancestors(F.col("rel_path")))).alias("dir")).join(doubtful, "dir", "left_semi").drop("dir")
    state = rounds.put("state", near.unionByName(within).distinct())

    done = []
    while not open_moves.isEmpty():
        ready = rounds.put("ready", _ready(open_moves, rounds.put("touched", _touched(open_moves, doubtful))))
        decided = _decided(ready, state, doubtful)
        if ready.isEmpty():
            raise RuntimeError("no move can be decided")  # the first of all always can
        done.append(Rounds(spark, "decided").put("decided", decided))
        state = rounds.put("state", _after(state, done[-1]))
        open_moves = rounds.put("open", open_moves.join(done[-1].select("at"), "at", "left_anti"))
    for d in done:
        out = out.unionByName(d.select(*out.columns))
    return out
