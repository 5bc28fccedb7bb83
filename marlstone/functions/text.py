"""Tokenizers and Markdown tests as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4E00-\\u9FFF"
CJK_WIDE = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"


def _ngrams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def search_tokens(text: Column) -> Column:
    """Tokens for ranking: runs of ASCII letters, digits and underscores in lower case, and the characters and pairs of every CJK run. Other letters split words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    cjk = F.flatten(F.transform(runs, lambda r: F.concat(_ngrams(r, 1), _ngrams(r, 2))))
    return F.when(text.rlike(f"[{CJK}]"), F.concat(words, cjk)).otherwise(words)


#: The bytes of words in lower case; 0 for all others.
_LOWER = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _LOWER[[_c, *bytes([_c]).upper()]] = _c
_WORD, _RUN = re.compile("[a-z0-9_]+"), re.compile("[\u4e00-\u9fff]+")


def token_list(text: str) -> list[str]:
    """``search_tokens`` of one text."""
    runs = _RUN.findall(text)
    return _WORD.findall(text.lower()) + [t for r in runs for t in (*r, *(r[i : i + 2] for i in range(len(r) - 1)))]


def token_arrays(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``search_tokens`` of an array of texts: the row of each token, and the tokens.

    Words are cut out of the texts' bytes all at once; rows that may have CJK, and those with a letter that only becomes
    ASCII in lower case (K of Kelvin, I with a dot), are cut one by one.
    """
    texts = texts.cast(pa.string()).fill_null("")
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and len(texts) else np.zeros(0, np.uint8)
    ends = ends.astype(np.int64) - (ends[0] if len(texts) else 0)
    low = _LOWER[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    first[rows] = inside[rows]
    at = np.flatnonzero(first)
    row = np.searchsorted(ends, at, "right") - 1
    places = np.append(np.cumsum(inside)[at] - 1, inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(low[inside]))
    pair = data[:-1].astype(np.int32) << 8 | data[1:]
    odd = np.concatenate([np.flatnonzero((data >= 0xE4) & (data <= 0xE9)), np.flatnonzero((pair == 0xC4B0) | (pair == 0xE284))])
    if not len(odd):
        return row, words
    single = np.unique(np.searchsorted(ends, odd, "right") - 1)
    plain = ~np.isin(row, single)
    lists = [token_list(t) for t in texts.take(pa.array(single)).to_pylist()]
    more = pa.array([t for x in lists for t in x], pa.string())
    return np.concatenate([row[plain], np.repeat(single, [len(x) for x in lists])]), pa.concat_arrays([words.filter(pa.array(plain)), more])


def keyword_tokens(text: Column) -> Column:
    """Tokens for the keyword channel: white-space parts in lower case; a CJK run in them becomes its characters and pairs."""
    plain = lambda t: F.filter(F.split(t, "\\s+"), lambda p: p != "")
    spaced = F.regexp_replace(F.lower(text), f"([{CJK_WIDE}]+)", " $1 ")
    mixed = F.flatten(F.transform(plain(spaced), lambda p: F.when(p.rlike(f"^[{CJK_WIDE}]+$"), F.concat(_ngrams(p, 1), _ngrams(p, 2))).otherwise(F.array(p))))
    return F.when(text.rlike(f"[{CJK_WIDE}]"), mixed).otherwise(plain(F.lower(text)))


def keyword_words(text: Column) -> Column:
    """What stands in the keyword channel's vector, in order: the words, of letters and digits, of its tokens."""
    return F.regexp_extract_all(F.array_join(keyword_tokens(text), " "), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def keyword_terms(text: Column, most: int = 32) -> Column:
    """A query's terms for the keyword channel: tokens of two characters or more, the first ``most``."""
    return F.slice(F.filter(keyword_tokens(text), lambda t: F.length(t) >= 2), 1, most)


def preprocessed(md: Column) -> Column:
    """Unix line ends, no NUL, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(md, "\r\n?", "\n"), "\\x00", ""), "\n{3,}", "\n\n")


def table_heavy(text: Column) -> Column:
    """Whether at least two lines, and half of the lines that are not blank, start with a pipe."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(F.filter(lines, lambda x: x.rlike("^\\s*\\|"))) >= F.greatest(F.lit(2), F.floor(F.size(lines) * 0.5))


def safe_name(path: Column) -> Column:
    """A path as one file name: outer slashes go, and every run of what is no letter, digit, CJK character or one of . # ( ) _ - becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""), f"[^A-Za-z0-9.#(){CJK}_-]+", "_")


def json_part(text: Column) -> Column:
    """The JSON object in a model's answer: what a code fence holds, else from the first brace to the last."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, "(?s)```(?:json)?\\s*(\\{.*\\})\\s*```", 1)
    braced = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(t)
