"""Merkle manifests of a dataset, in superblocks.

Leaves of a group are numbered in order and cut into superblocks of FAN ** height leaves (height: LEVELS). One pass
reduces every superblock to its root; these are the leaves of the layer above, until each
group is one superblock, and the groups' roots go through the same. On the way back,
layer by layer, a superblock's leaves meet the outer nodes that they need (the path from the superblock's
root to the top) in one cogroup, which finishes the reduction inside, joins the proofs and folds
them. So a task holds one superblock, whatever a group's share of the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shelf, partitions, table

FAN, LEVELS = 3, 7


def item(c: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its length in bytes of UTF-8, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The hash of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(item, columns)), 256))


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def tree(nodes: list[str], size: int, height: int) -> list[list[str]]:
    """The levels of one superblock, its leaves first, of a layer with ``size`` nodes in its group: up to the root, or ``height`` of them if more superblocks follow."""
    levels = [nodes]
    while size > 1 and len(levels) <= height:
        levels.append([joined(levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
        size = math.ceil(size / FAN)
    return levels


def inner_path(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """(own place in its run, siblings from left to right) of a leaf, level by level."""
    path = []
    for level in levels[:-1]:
        start, place = at - at % FAN, at % FAN
        run = level[start : start + FAN]
        path.append((place, run[:place] + run[place + 1 :]))
        at //= FAN
    return path


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its proof give."""
    for place, siblings in path:
        node = joined([*siblings[:place], node, *siblings[place:]])
    return node


def packed(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([place, len(siblings)]) + bytes.fromhex("".join(siblings)) for place, siblings in path)


def unpacked(blob: bytes) -> list[tuple[int, list[str]]]:
    path, i = [], 0
    while i < len(blob):
        place, n = blob[i], blob[i + 1]
        path.append((place, [blob[j : j + 32].hex() for j in range(i + 2, i + 2 + 32 * n, 32)]))
        i += 2 + 32 * n
    return path


def numbered(rows: DataFrame, shelf: Shelf, group: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, their place in their group from 0, and size, the group's rows.

    Ranges of (group, order) are dealt out and sorted, each counts its groups, and the counts before a range
    are added to the places in it: no group is ever in one task.
    """
    keys = [group, *order]
    dealt, _ = shelf.put(rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    w = W.partitionBy(group)
    runs = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(w)})
    return dealt.join(runs, [group, "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before", "_n")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / FAN**height).cast("long"))


def _levels(rows: pd.DataFrame, height: int) -> list[list[str]]:
    """The levels of a superblock's rows, which are in order."""
    return tree([bytes(x).hex() for x in rows["node"]], int(rows["size"].iloc[0]), height)


def _reduced(nodes: DataFrame, height: int) -> DataFrame:
    """A layer's superblocks, by their roots, as the nodes of the next: (g, idx, size, node)."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        size = int(rows["size"].iloc[0])
        root = _levels(rows, height)[-1][0]
        return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "size": [math.ceil(size / FAN**height)], "node": [bytes.fromhex(root)]})

    return _blocks(nodes, height).select("g", "block", "idx", "size", "node").groupBy("g", "block").applyInPandas(reduce, "g string, idx long, size long, node binary")


@dataclass
class Forest:
    """The layers of the groups' trees, leaves first, and each group's root (g, node); finished: the groups whose uppermost layer each is."""

    layers: list[DataFrame]
    finished: list[DataFrame]
    roots: DataFrame


def forest(nodes: DataFrame, shelf: Shelf, height: int) -> Forest:
    """All superblocks reduced, layer by layer; ``nodes``: g, idx, size, node."""
    layers, finished = [nodes], []
    while True:
        up, _ = shelf.put(_reduced(layers[-1], height))
        finished.append(up.where("size = 1").select("g", "node"))
        more = up.where("size > 1")
        if more.isEmpty():
            break
        layers.append(more)
    roots = finished[0]
    for f in finished[1:]:
        roots = roots.unionByName(f)
    return Forest(layers, finished, roots)


_OUTER = "g string, block long, path binary, subroot binary, root binary"


def _exchanged(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """The outer nodes of each of a layer's nodes, which are superblocks of the layer below: their paths inside the superblock, then its own."""

    def exchange(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        levels = _levels(rows, height)
        above = known.iloc[0]
        paths = [packed(inner_path(levels, i)) + bytes(above["path"]) for i in range(len(rows))]
        return pd.DataFrame({"g": rows["g"].to_numpy(), "block": rows["idx"].to_numpy(), "path": paths, "subroot": [above["subroot"]] * len(rows), "root": [above["root"]] * len(rows)})

    return _blocks(nodes, height).select("g", "block", "idx", "size", "node").groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(exchange, _OUTER)


def _downwards(trees: Forest, tops: DataFrame, shelf: Shelf, height: int) -> DataFrame:
    """The outer nodes of the lowest layer's superblocks, from those of the groups (g, path, subroot, root)."""
    outer = None
    for layer in range(len(trees.layers) - 1, -1, -1):
        ended = trees.finished[layer].select("g").join(tops, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        outer = ended if outer is None else ended.unionByName(outer)
        if layer:
            outer, _ = shelf.put(_exchanged(trees.layers[layer], outer, height))
    return outer


def manifest(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """The Merkle manifest of ``rows`` (doc_id, grp: string, node: a leaf of 32 bytes, other: a leaf to verify or null).

    Per group, leaves stand in the order of doc_id (null first; equal ids by their leaves, so
    that equal rows may swap without a difference), groups in that of their name, null first. Returns
    for each row doc_id, leaf, subroot, root, proof_sha256 (hash of the proof: all siblings from the
    subroot's tree to the root's, left to right), folded_root (what the proof makes of ``other`` where it
    isn't null, else of the leaf) and verified (whether that is the root), hashes in hexadecimal.
    Repeated rows are leaves each; a single row's leaf is its subroot and a single group's
    subroot the root; long texts count by their hash; an empty table gives an empty manifest.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark, "merkle")
    # a name that orders as the group does and is never null
    named = rows.select("doc_id", "node", "other", F.when(F.col("grp").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("grp"))).alias("g"))
    hashed, _ = shelf.put(named)
    leaves, _ = shelf.put(numbered(hashed, shelf, "g", ["doc_id", "node"]))
    trees = forest(leaves.select("g", "idx", "size", "node"), shelf, height)

    groups = trees.roots.select(F.col("g").alias("name"), "node", F.lit("").alias("g"))
    subroots, _ = shelf.put(numbered(groups, shelf, "g", ["name"]))
    upper = forest(subroots.select("g", "idx", "size", "node"), shelf, height)
    top = upper.roots.select("g", F.lit(b"").alias("path"), F.col("node").alias("root"), F.lit(b"").alias("subroot"))
    to_root = _downwards(upper, top, shelf, height)

    def close(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Each group's own path to the root."""
        rows = rows.sort_values("idx")
        levels = _levels(rows, height)
        above = known.iloc[0]
        paths = [packed(inner_path(levels, i)) + bytes(above["path"]) for i in range(len(rows))]
        return pd.DataFrame({"g": rows["name"].to_numpy(), "path": paths, "subroot": rows["node"].to_numpy(), "root": [above["root"]] * len(rows)})

    tops, _ = shelf.put(_blocks(subroots, height).groupBy("g", "block").cogroup(to_root.groupBy("g", "block")).applyInPandas(close, "g string, path binary, subroot binary, root binary"))
    outer = _downwards(trees, tops, shelf, height)

    def finish(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_finished(rows.sort_values("idx"), known.iloc[0], height), columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    result = f"doc_id {dict(rows.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(leaves, height).groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(finish, result)


def _finished(rows: pd.DataFrame, known: pd.Series, height: int) -> Iterator[tuple]:
    """One superblock: its levels, each leaf's proof to the root, and what the proof folds to."""
    levels = _levels(rows, height)
    nodes = levels[0]
    outer = unpacked(bytes(known["path"]))
    outer_text = "".join(s for _, siblings in outer for s in siblings)
    subroot, root = bytes(known["subroot"]).hex(), bytes(known["root"]).hex()
    for i, (doc_id, other) in enumerate(zip(rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None), rows["other"], strict=True)):
        inner = inner_path(levels, i)
        proof = hashlib.sha256(("".join(s for _, siblings in inner for s in siblings) + outer_text).encode()).hexdigest()
        folded = fold(nodes[i] if other is None else bytes(other).hex(), [*inner, *outer])
        yield doc_id, nodes[i], subroot, root, proof, folded, folded == root


def tampered_rows(docs: DataFrame) -> DataFrame:
    """What ``manifest`` takes of documents: their leaves and, where an even CRC-32 of the id says so, the leaf of the text without line feeds (null ids have none)."""
    text = F.col("text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(even, leaf(*head, F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select("doc_id", F.col("source").alias("grp"), leaf(*head, text).alias("node"), other.alias("other"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(tampered_rows(table(spark, sf_dir, "documents")))


#: The trees level by level, each row's siblings on every level, and the folds of the proofs; the CRC-32 bit by bit.
SQL = r"""
with recursive rows_ as (select row_number() over () as r, * from documents),
hashed as (select r, doc_id, source, sha256(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end || case when source is null then '-' else strlen(source) || ':' || source end
  || case when lang is null then '-' else strlen(lang) || ':' || lang end || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
 sha256(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end || case when source is null then '-' else strlen(source) || ':' || source end
  || case when lang is null then '-' else strlen(lang) || ':' || lang end || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || case when text is null then '-' else strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') end) as other,
 list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, o: case when o >= 0 then xor(s, o) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) as crc from rows_),
leaves as (select r, doc_id, source, leaf, case when doc_id is not null and xor(crc, 4294967295) % 2 = 0 then other else leaf end as start, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from hashed),
up as (select source, 0 as lvl, idx, leaf as h, n from leaves union all select source, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from up where n > 1 group by source, lvl, idx // 3, n),
subs as (select source, h as subroot, lvl as height, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from up where n = 1),
top as (select 0 as lvl, idx, subroot as h, n from subs union all select lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from top where n > 1 group by lvl, idx // 3, n),
own as (select r, l.source, l.idx, l.start, subroot, height, s.idx as s_idx from leaves l join subs s on l.source is not distinct from s.source),
near as (select r, u.lvl as step, u.idx, u.idx < own.idx // (3 ** u.lvl)::bigint as is_left, h from own join up u on u.source is not distinct from own.source and u.n > 1 and u.idx // 3 = own.idx // (3 ** (u.lvl + 1))::bigint and u.idx <> own.idx // (3 ** u.lvl)::bigint
 union all select r, height + t.lvl, t.idx, t.idx < s_idx // (3 ** t.lvl)::bigint, h from own join top t on t.n > 1 and t.idx // 3 = s_idx // (3 ** (t.lvl + 1))::bigint and t.idx <> s_idx // (3 ** t.lvl)::bigint),
steps as (select r, step from own, range(0, 60) x(step) where step < height + (select max(lvl) from top)),
sibs as (select s.r, s.step, coalesce(string_agg(h, '' order by idx) filter (is_left), '') as before, coalesce(string_agg(h, '' order by idx) filter (not is_left), '') as behind from steps s left join near n on n.r = s.r and n.step = s.step group by all),
proofs as (select r, sha256(coalesce(string_agg(before || behind, '' order by step), '')) as proof from own left join sibs using (r) group by r),
fold as (select r, 0 as step, start as h from own union all select fold.r, fold.step + 1, sha256(before || h || behind) from fold join sibs on sibs.r = fold.r and sibs.step = fold.step),
ends as (select r, max_by(h, step) as folded from fold group by r)
select l.doc_id, l.leaf, own.subroot, (select h from top where n = 1) as root, proof as proof_sha256, folded as folded_root, folded = (select h from top where n = 1) as verified from leaves l join own using (r) join proofs using (r) join ends using (r)"""
