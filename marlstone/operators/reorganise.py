"""Validation, preview and order of planned moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import depth_of, is_under, name_of, parent_of
from .folders import with_ancestors

REPO_DIR = ".index"


def validated(plan: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """(from_path, to_path, reason): why a move is rejected, null if it is not; reasons in a fixed order."""
    root_col = F.lit(root)
    inside = F.concat(F.lit("/"), "to_path", F.lit("/")).contains(f"/{REPO_DIR}/") | F.concat(F.lit("/"), "from_path", F.lit("/")).contains(f"/{REPO_DIR}/")
    sources = known.select(F.col("rel_path").alias("from_path")).distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when((F.coalesce("from_path", F.lit("")) == "") | (F.coalesce("to_path", F.lit("")) == ""), "empty path")
        .when(root_col == "", "empty root")
        .when(~is_under(root_col, F.col("from_path"), strict=True), "source outside root")
        .when(~is_under(root_col, F.col("to_path")), "target outside root")
        .when(inside, "repository internal")
        .when(F.col("_known").isNull(), "unknown source")
        .when(F.col("from_path") == F.col("to_path"), "no change")
    )
    return plan.join(sources, "from_path", "left").select("from_path", "to_path", reason.alias("reason"))


def finalised(plan: DataFrame, root: str, known: DataFrame, most: int = 100) -> DataFrame:
    """A plan (idx, from_path, to_path) as it is kept: (idx, from_path, to_path, reason), reason null for the moves.

    Malformed and idle entries are dropped, what ``validated`` rejects stays with its
    reason, and of the moves the first ``most`` stay.
    """
    rows = plan.where("coalesce(from_path, '') <> '' and coalesce(to_path, '') <> '' and from_path <> to_path")
    checked = rows.join(validated(rows.select("from_path", "to_path").distinct(), root, known), ["from_path", "to_path"])
    moves = checked.where("reason is null").orderBy("idx").limit(most)
    return moves.unionByName(checked.where("reason is not null")).select("idx", "from_path", "to_path", "reason")


def conflicts(moves: DataFrame, files: DataFrame) -> DataFrame:
    """What each move by itself would come to, as a preview (``moves.applied`` applies them together): (from_path, to_path, decision, target): conflict (a directory is there), free, noop (same content), meta_only (target without analysis), rename (to a free name)."""
    source = files.select(F.col("rel_path").alias("from_path"), F.col("file_hash").alias("h1"))
    target = files.select(F.col("rel_path").alias("to_path"), F.col("file_hash").alias("h2"), F.col("analysed"))
    dirs = with_ancestors(files.select("parent_dir").distinct()).select(F.col("dir").alias("to_path"), F.lit(True).alias("is_dir")).distinct()
    decision = (
        F.when(F.col("is_dir"), "conflict")
        .when(F.col("h2").isNull(), "free")
        .when((F.col("h1") == F.col("h2")) & (F.col("h1") != ""), "noop")
        .when(~F.col("analysed"), "meta_only")
        .otherwise("rename")
    )
    rows = moves.join(source, "from_path").join(target, "to_path", "left").join(dirs, "to_path", "left").select("from_path", "to_path", decision.alias("decision"))
    renamed = unique_names(rows.where("decision = 'rename'").select("to_path").distinct(), files)
    return rows.join(renamed, "to_path", "left").select("from_path", "to_path", "decision", F.when(F.col("decision") == "rename", F.col("free")).otherwise(F.col("to_path")).alias("target"))


def unique_names(taken: DataFrame, files: DataFrame) -> DataFrame:
    """(to_path, free): the first of ``stem (1).ext``, ``stem (2).ext``, ... that no file has.

    The numbers that a name's relatives use are gathered by a join on the part around the
    number; the smallest missing one is next to a used one, or 1.
    """
    name, parent = name_of(F.col("p")), parent_of(F.col("p"))
    dotted = name.rlike("^.*[.][^.]*$")
    stem = F.when(dotted, F.regexp_extract(name, "^(.*)[.][^.]*$", 1)).otherwise(name)
    ext = F.when(dotted, F.regexp_extract(name, "([.][^.]*)$", 1)).otherwise(F.lit(""))
    number = F.regexp_extract(stem, r" \(([1-9][0-9]{0,8})\)$", 1)
    have = files.select(F.col("rel_path").alias("p")).select(parent.alias("d"), F.regexp_replace(stem, r" \([1-9][0-9]{0,8}\)$", "").alias("s"), ext.alias("e"), number.alias("n")).where("n <> ''")
    used = have.groupBy("d", "s", "e").agg(F.array_distinct(F.array_sort(F.collect_set(F.col("n").cast("int")))).alias("used"))
    wanted = taken.select(F.col("to_path").alias("p")).select(F.col("p").alias("to_path"), parent.alias("d"), stem.alias("s"), ext.alias("e"))
    rows = wanted.join(used, ["d", "s", "e"], "left")
    numbers = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.concat(F.array(F.lit(1)), F.transform(numbers, lambda n: n + 1)), numbers))
    path = F.concat(F.when(F.col("d") == "", "").otherwise(F.concat("d", F.lit("/"))), "s", F.lit(" ("), free.cast("string"), F.lit(")"), "e")
    return rows.select("to_path", path.alias("free"))


def ordered(moves: DataFrame) -> DataFrame:
    """Children before their parents: (place, depth, from_path, to_path), deepest first and by path among equals.

    Places are counted over depths, of which there are few, and within one.
    """
    rows = moves.withColumn("depth", depth_of(F.col("from_path")))
    w = W.partitionBy("depth").orderBy("from_path")
    sizes = rows.groupBy("depth").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.depth") > F.col("a.depth"), "left").groupBy("a.depth").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.withColumn("i", F.row_number().over(w)).join(F.broadcast(before), "depth").select((F.col("i") + F.col("before")).alias("place"), "depth", "from_path", "to_path")


def emptied(results: DataFrame, files: DataFrame) -> DataFrame:
    """(dir): directories that held files before the moves and hold none, at any depth, after them."""
    gone = results.where("result = 'moved'")
    left = files.join(gone.select(F.col("from_path").alias("rel_path")), "rel_path", "left_anti").select("parent_dir")
    came = gone.select(parent_of(F.col("target")).alias("parent_dir"))
    full = with_ancestors(left.unionByName(came).distinct()).select("dir").distinct()
    was = with_ancestors(gone.select(parent_of(F.col("from_path")).alias("parent_dir")).distinct()).select("dir").distinct()
    return was.join(full, "dir", "left_anti")


def shards(units: DataFrame, most: int) -> DataFrame:
    """(path, n, shard): units (root, path, n files) in the order of their paths, filled into shards of at most ``most`` files; a larger unit is one by itself.

    A greedy fold is sequential, so each root's units, which are directories and not
    files, are folded in one row.
    """
    unit = F.struct(F.lower("path").alias("key"), "path", F.col("n").cast("long").alias("n"))
    lists = units.groupBy("root").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    start = F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<path:string,n:bigint,shard:int>>").alias("out"))

    def add(acc: Column, u: Column) -> Column:
        fresh = (acc["held"] > 0) & (acc["held"] + u["n"] > most)
        shard = acc["shard"] + F.when(fresh, 1).otherwise(0)
        held = F.when(fresh, u["n"]).otherwise(acc["held"] + u["n"])
        return F.struct(shard.alias("shard"), held.alias("held"), F.concat(acc["out"], F.array(F.struct(u["path"].alias("path"), u["n"].alias("n"), shard.alias("shard")))).alias("out"))

    return lists.select("root", F.explode(F.aggregate("units", start, add, lambda acc: acc["out"])).alias("x")).select("root", "x.path", "x.n", "x.shard")


def plan_markdown(moves: DataFrame) -> DataFrame:
    """One text a plan (plan_name, from_path, to_path): its moves as a Markdown list, in order."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- `"), "from_path", F.lit("` → `"), "to_path", F.lit("`"))))
    return moves.groupBy("plan_name").agg(F.concat(F.lit("# "), F.first("plan_name"), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("md"))
