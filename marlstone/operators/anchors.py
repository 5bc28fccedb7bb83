"""Which texts hold which of many fixed pieces of text, in one pass: an automaton of all pieces."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: Characters of pieces that one automaton holds; more pieces are dealt out to several, each a pass over the texts.
MOST_CHARACTERS = 16 << 20


#: What a null id counts as.
LAST = (1 << 63) - 1
#: Texts after which a task leaves out the pieces whose first holder is known for later ones.
LEFT_OUT = (500, 10_000)


def _automaton(pieces: Iterable[str], values: Iterable | None = None) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p, v in zip(pieces, pieces if values is None else values, strict=True):
        made.add_word(p, v)
    made.make_automaton()
    return made


def _parts(pieces: DataFrame, piece: str, most: int) -> Iterator[list[str]]:
    """The different pieces, null and empty ones left out, in parts of about ``most`` characters."""
    wanted = pieces.select(F.col(piece).alias("piece")).where("piece <> ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // most))
    for part in range(parts):
        own = [r["piece"] for r in wanted.where(F.pmod(F.xxhash64("piece"), F.lit(parts)) == part).collect()]
        if own:
            yield own


def occurrences(texts: DataFrame, pieces: DataFrame, text: str = "text", piece: str = "piece", most: int = MOST_CHARACTERS) -> DataFrame:
    """(columns of ``texts`` but the text, piece): a row for each text and each different piece that it holds.

    Null and empty pieces and null texts hold nothing. The pieces' whole length is summed first; up to
    ``most`` characters are sent to the workers at once, and what is more is dealt out by hash, part by part, so that the driver and a worker never
    hold more than about a part. Each text is read through once for each part, whatever the number of pieces.
    """
    spark = texts.sparkSession
    others = [c for c in texts.columns if c != text]
    rows = spread(texts.where(F.col(text).isNotNull()).select(*others, F.col(text).alias("_text")))
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "_text"), "piece string"])
    out = None
    for own in _parts(pieces, piece, most):
        held = spark.sparkContext.broadcast(own)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine = _automaton(held.value)
            for batch in batches:
                at, names = [], []
                for i, t in enumerate(batch.column(len(others)).to_pylist()):
                    found = {p for _, p in machine.iter(t)}
                    at.extend([i] * len(found))
                    names.extend(found)
                kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(others))]
                yield pa.record_batch([*kept, pa.array(names, pa.string())], names=[*others, "piece"])

        hits = rows.mapInArrow(find, schema)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], schema) if out is None else out


class _First:
    """The smallest id of the texts that hold each piece, in each group.

    Pieces that are found in every group so far by an id are left out of the automaton for the texts of these groups with larger ids. That spares
    most of the matches where ids rise, as those of stored tables do, and changes no result where they don't.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.seen = pieces, 0
        self.least: dict[str, dict[int, int]] = {}
        self.bounds: list[int] = []
        self.machines = [(_automaton(pieces, range(len(pieces))), None)]

    def add(self, group: str, at: int, text: str) -> None:
        least = self.least.setdefault(group, {})
        machine, groups = self.machines[bisect_right(self.bounds, at)]
        if groups is not None and group not in groups:
            machine = self.machines[0][0]
        if machine:
            for _, p in machine.iter(text):
                if at < least.get(p, at + 1):
                    least[p] = at
        self.seen += 1
        if self.seen in LEFT_OUT and (not self.bounds or at > self.bounds[-1]):
            rest = [p for p in range(len(self.pieces)) if any(x.get(p, at) >= at for x in self.least.values())]
            self.bounds.append(at)
            self.machines.append((_automaton([self.pieces[p] for p in rest], rest) if rest else None, frozenset(self.least)))


def first_holders(texts: DataFrame, pieces: DataFrame, text: str, piece: str, group: str, id_col: str, most: int = MOST_CHARACTERS) -> DataFrame:
    """(group, piece, id): the smallest id of the texts that hold each piece, in each group of texts; pieces that no text of a group holds are left out.

    As the least of ``occurrences``, but a task gives out each piece once a group, not each text that holds it. Texts stay where they are, in their order.
    """
    spark = texts.sparkSession
    rows = texts.where(F.col(text).isNotNull()).select(group, id_col, F.col(text).alias("_text"))
    schema = f"`{group}` string, piece string, `{id_col}` long"
    out = None
    for own in _parts(pieces, piece, most):
        held = spark.sparkContext.broadcast(own)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            first = _First(held.value)
            for batch in batches:
                ids = pc.fill_null(batch.column(1), LAST).to_pylist()
                for row in zip(batch.column(0).to_pylist(), ids, batch.column(2).to_pylist(), strict=True):
                    first.add(*row)
            for name, least in first.least.items():
                columns = {group: pa.array([name] * len(least), pa.string()), "piece": pa.array([first.pieces[p] for p in least], pa.string()), id_col: pa.array([None if i == LAST else i for i in least.values()], pa.int64())}
                yield from pa.table(columns).to_batches(10_000)

        hits = rows.mapInArrow(find, schema)
        out = hits if out is None else out.unionByName(hits)
    found = spark.createDataFrame([], schema) if out is None else out
    return found.groupBy(group, "piece").agg(F.min(id_col).alias(id_col))
