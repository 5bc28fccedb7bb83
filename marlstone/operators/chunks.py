"""Markdown chunks: headings, breadcrumbs, sentence-aware splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preprocessed
from ..sources.tables import spread

LIMIT, OVERLAP = 1200, 0.12
SENTENCE_END = "。！？!?；;\n"
_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def headings(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, line, level, title) of the headings outside code fences; a fence mark of either kind opens or closes."""
    lines = pages.select(id_col, F.posexplode(F.split(preprocessed(F.col("md")), "\n")).alias("line", "text"))
    w = W.partitionBy(id_col).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    fenced = lines.withColumn("fences", F.count_if(F.col("text").rlike("^\\s*(```|~~~)")).over(w))
    heads = fenced.where((F.col("fences") % 2 == 0) & F.col("text").rlike("^\\s{0,3}#{1,6}\\s+\\S"))
    title = F.regexp_extract("text", "^\\s{0,3}#{1,6}\\s+(.+?)\\s*$", 1)
    return heads.select(id_col, "line", F.length(F.regexp_extract("text", "^\\s{0,3}(#{1,6})\\s", 1)).alias("level"), title.alias("title")).where("title not rlike '^#*$'")


def split_text(text: str, limit: int = LIMIT, overlap: float = OVERLAP) -> list[str]:
    """Windows of at most ``limit`` characters, cut behind the last sentence end of their second half, overlapping by a share.

    The last window is cut like any other, so a tail may fall into several pieces.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        window = text[at : at + limit]
        cut = max(window.rfind(c, max(1, len(window) // 2)) for c in SENTENCE_END) + 1 or len(window)
        if window[:cut].strip():
            out.append(window[:cut])
        if at + cut >= len(text):
            break
        shared = int(cut * overlap)
        at += max(1, cut - shared)
    return out


def _sections(md: str) -> list[tuple[str, str, bool]]:
    """(breadcrumb, text, whether it is mostly a table) of the sections that are not blank: each is the text from its heading to the next."""
    md = re.sub(r"\n{3,}", "\n\n", md.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", ""))
    sections: list[tuple[list[str], list[str]]] = [([], [])]
    stack: list[tuple[int, str]] = []
    fenced = False
    for line in md.split("\n"):
        if ("```" in line or "~~~" in line) and _FENCE.match(line):
            fenced = not fenced
        head = None if fenced or "#" not in line else _HEADING.match(line)
        title = head[2].strip() if head and head[2].strip("#") else ""
        if title:
            while stack and stack[-1][0] >= len(head[1]):
                stack.pop()
            stack.append((len(head[1]), title))
            sections.append(([t for _, t in stack], []))
        else:
            sections[-1][1].append(line)
    out = []
    for crumbs, lines in sections:
        text = "\n".join(lines).strip()
        if text:
            filled = [x for x in lines if x.strip()]
            out.append((" ▸ ".join(crumbs), text, sum(x.lstrip().startswith("|") for x in filled) >= max(2, int(0.5 * len(filled)))))
    return out


def _pieces(sections: list[tuple[str, str, bool]], limit: int, overlap: float) -> list[tuple[int, str, str]]:
    parts = ((crumbs, part) for crumbs, text, whole in sections for part in ([text] if whole else split_text(text, limit, overlap)))
    return [(n, crumbs, part) for n, (crumbs, part) in enumerate(parts, 1)]


def chunk_markdown(md: str, limit: int = LIMIT, overlap: float = OVERLAP) -> list[tuple[int, str, str]]:
    """(number from 1, breadcrumb, text) of the sections' pieces; tables stay whole."""
    return _pieces(_sections(md), limit, overlap)


#: Characters of pages whose chunks a task holds at once, a last page more.
MOST_HELD = 1 << 20


def chunks(pages: DataFrame, id_col: str = "page_id", limit: int = LIMIT, overlap: float = OVERLAP) -> DataFrame:
    """(id, seq, breadcrumb, chunk) of every page. The next window starts where the last was cut, so a page is split in Python, a few pages of an Arrow batch at a time."""
    return chunks_by_setting(pages, [("", limit, overlap)], id_col).drop("config")


def chunks_by_setting(pages: DataFrame, settings: list[tuple[str, int, float]], id_col: str = "page_id", dealt: bool = False) -> DataFrame:
    """(config, id, seq, breadcrumb, chunk) of every page in each setting (config, limit, overlap): every page is read once, and its sections are found once for all settings. Pages that are ``dealt`` out already stay where they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, md in enumerate(batch.column(1)):
                sections = _sections(text := md.as_py() or "")
                held += len(text)
                rows.extend((config, i, *piece) for config, limit, overlap in settings for piece in _pieces(sections, limit, overlap))
                if rows and (held >= MOST_HELD or i == batch.num_rows - 1):
                    config, at, seq, crumbs, part = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(config, pa.string()), batch.column(0).take(pa.array(at)), pa.array(seq, pa.int32()), pa.array(crumbs, pa.string()), pa.array(part, pa.string())], names=["config", id_col, "seq", "breadcrumb", "chunk"])
                    rows, held = [], 0

    rows = pages.select(id_col, "md")
    return (rows if dealt else spread(rows)).mapInArrow(split, f"config string, `{id_col}` {dict(pages.dtypes)[id_col]}, seq int, breadcrumb string, chunk string")


def embedding_text(breadcrumb: Column, chunk: Column) -> Column:
    """What is embedded of a chunk: its titles before its text."""
    return F.trim(F.concat(F.replace(breadcrumb, F.lit(" ▸ "), F.lit(" > ")), F.lit("\n"), chunk), F.lit(" \n\t\r"))


@F.udtf(returnType="seq int, breadcrumb string, chunk string")
class MarkdownChunks:
    """``chunk_markdown`` as a table function: select * from t, lateral markdown_chunks(t.md, 1200, 0.12)."""

    def eval(self, md: str, limit: int, overlap: float):
        yield from chunk_markdown(md or "", limit, overlap)
