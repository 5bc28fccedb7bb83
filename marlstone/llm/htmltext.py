"""HTML main text by differencing pages with the nearest URL of their host.

Every page becomes lines (its blocks) with a role: part of an explicit article, of a
boilerplate element, or open. Pages are sorted by host and path; each is paired with the
neighbour whose path has the longer common prefix with its own, the two pages' lines are
aligned by longest common subsequence, and lines that both pages have are deleted. Tags only
guard: boilerplate elements go in any case, a neighbour that has most of an article's text
counts as its copy, an article's headings stay, and its other lines go only where the neighbours on both
sides have them, at the same distance from its beginning or its end, since pages that quote one line are no template.

A page's neighbours are the nearest pages on both sides in that order whose lines differ
from its own; a run of copies has the same ones.

The sort is a range partition by keys sampled beforehand. To every range also goes, from
each side, the nearest page that differs from the page at its edge, so a page's
neighbours are the same however many ranges there are, and a host with a third of all pages
or of copies is spread like any other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, whole

#: Roles of lines; a heading is one inside an article.
ARTICLE, OPEN, BOILERPLATE, HEADING = 0, 1, 2, 3
#: Sampled keys for each range, and the characters of HTML that a range has on average at most.
KEYS_PER_RANGE, RANGE_CHARS = 64, 64_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|button|title|canvas|video|audio)\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul head".split()
)
_SPACES = frozenset("br td th wbr option caption img input".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no part of an article.
_DROPPED = frozenset("nav footer aside form menu dialog head fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|banner|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager"
    r"|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification|alert|disclaimer|newsletter|subscribe|subscription|signup|login"
    r"|popup|modal|overlay|comments?|commentlist|replies|respond|disqus|related|recommended|recommendations|share|sharing|social|widget|search|skip|hidden)(?:$|[\s_-])",
    re.I,
)
_CONTENT_CLASS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)[_-]?(?:body|text|content|header|title)?(?:$|\s)", re.I)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        if tag != "article":
            return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if tag == "article":
        return bool(re.search(r"(?:^|[\s_-])(?:comments?|reply|teaser|related|promo)(?:$|[\s_-])", names, re.I))
    if found.get("role", "").lower() in _ROLES or re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTRIBUTE.sub(" ", attributes)):
        return True
    if found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return bool(names and _CLASS.search(names) and not _CONTENT_CLASS.search(names))


def page_lines(source: str) -> list[tuple[int, str]]:
    """The page's blocks in order as (role, text); white space is one space, character references are decoded, empty blocks go."""
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    role_of = OPEN
    lower = source.lower()
    skip_tag, skip_depth = "", 0
    articles = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            lines.append((role_of, text))

    at = 0
    for token in chain(_TOKEN.finditer(source), (None,)):
        if token is None:
            parts.append(source[at:])
            break
        parts.append(source[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            if token[1]:
                parts.append(" ")
            continue
        closing = bool(token[2])
        if tag in _SPACES:
            parts.append(" ")
            continue
        if tag not in _BLOCKS and not (skip_tag or closing) and not (token[4] and _dropped(tag, token[4], bool(articles))):
            continue
        if tag in _BLOCKS or skip_tag == tag:
            flush()
        if skip_tag:
            if tag == skip_tag:
                skip_depth += -1 if closing else 1
                if skip_depth <= 0:
                    flush()
                    skip_tag = ""
            elif skip_tag == "p" and tag in _BLOCKS:
                skip_tag = ""
        elif not closing and tag not in _VOID and _dropped(tag, token[4], bool(articles)):
            # an element that is never closed hides what follows only where that is sure to be no article
            if lower.find(f"</{tag}", at) >= 0 or tag in ("footer", "aside"):
                flush()
                skip_tag, skip_depth = tag, 1
        if not skip_tag and tag in ("article", "main"):
            articles = max(0, articles + (-1 if closing else 1))
        heading = tag in _HEADINGS and not closing
        role_of = BOILERPLATE if skip_tag else (HEADING if heading else ARTICLE) if articles else OPEN
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit vectors over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found: set[int] = set()
    row, col = len(b), len(a)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not (row and not rows[row - 1] >> (col - 1) & 1):
                col -= 1
                found.add(col)
    return found


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _aligned(page: dict, near: list[dict]) -> set[int]:
    """The page's article lines that every neighbour's article has as well, as far from its beginning or as far from its end."""
    article = lambda p: [i for i, r in enumerate(p["roles"]) if r in (ARTICLE, HEADING)]
    own, others = article(page), [[p["hashes"][i] for i in article(p)] for p in near]
    same = lambda n, i: all(-len(o) <= n < len(o) and o[n] == page["hashes"][i] for o in others)
    return {i for n, i in enumerate(own) if same(n, i) or same(n - len(own), i)}


def main_text(page: dict, before: dict | None, after: dict | None) -> str:
    """The page's lines outside boilerplate elements that its nearest neighbour lacks.

    A neighbour that has all of them, or most of the text of the page's articles, is a
    copy or another version, which tells nothing about templates; the other one is
    taken then, and without any the page keeps all these lines. Of an article, only lines that both neighbours have, as far
    from its beginning or its end, go, and no heading; with one neighbour it stays whole.
    """
    roles = page["roles"]
    lines = [i for i, r in enumerate(roles) if r != BOILERPLATE]
    texts = dict(zip(lines, page["texts"], strict=True))
    inside = {i for i in lines if roles[i] in (ARTICLE, HEADING)}
    length = lambda some: sum(len(texts[i]) for i in some if i in inside)
    near = [p for p in (before, after) if p is not None and p["host"] == page["host"]]
    near.sort(key=lambda p: -_prefix(p["path"], page["path"]))
    shared = [{lines[i] for i in common_lines([page["hashes"][i] for i in lines], p["hashes"])} for p in near]
    gone: set[int] = set()
    for found in shared:
        own = [i for i in lines if i not in found]
        if own and 2 * length(own) >= length(lines):
            both = set.intersection(*shared) & _aligned(page, near) if len(shared) > 1 else set()
            gone = {i for i in found if i not in inside or (i in both and roles[i] != HEADING)}
            break
    return "\n\n".join(texts[i] for i in lines if i not in gone)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; a url without a host is all path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    return host, path


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def signature(host: str, lines: list[tuple[int, str]]) -> int:
    """What copies have in common: the host and the lines outside boilerplate elements."""
    return _hash("\x01".join([host, *(f"{r}{_hash(t):x}" for r, t in lines if r != BOILERPLATE)]))


def _salts(spark, n: int) -> list[int]:
    """A number for each of ``n`` ranges that Spark's hash puts into a partition of its own, so that no two ranges meet in one task."""
    places = spark.range(64 * n + 64).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), "id")
    found = {r["p"]: r["id"] for r in places.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(i, i) for i in range(n)]


def _ranges(keys: DataFrame, n: int) -> tuple[list[str], dict[str, list[int]]]:
    """Split points of about equal ranges of the table (key, sig), and for the pages that other ranges need as neighbours, which these are."""
    sampled = sorted(r[0] for r in keys.orderBy(F.xxhash64("key"), "key").limit(KEYS_PER_RANGE * n).select("key").collect())
    splits = sorted({sampled[len(sampled) * i // n] for i in range(1, n)}) if sampled else []
    bounds = keys.sparkSession.sparkContext.broadcast(splits)

    @F.pandas_udf("int")
    def bucket(part: pd.Series) -> pd.Series:
        return part.map(lambda k: bisect_right(bounds.value, k)).astype("int32")

    page = F.struct("key", "sig")
    dealt = keys.withColumn("bucket", bucket("key"))
    edges = cut(dealt.groupBy("bucket").agg(F.min(page).alias("first"), F.max(page).alias("last")))
    inner = dealt.join(F.broadcast(edges), "bucket").groupBy("bucket").agg(
        F.first("first").alias("first"),
        F.first("last").alias("last"),
        F.min(F.when(F.col("sig") != F.col("first.sig"), F.col("key"))).alias("second"),
        F.max(F.when(F.col("sig") != F.col("last.sig"), F.col("key"))).alias("second_last"),
    )
    found = inner.orderBy("bucket").collect()
    wanted: dict[str, list[int]] = {}

    def ask(bucket: int, sig: int, beyond: Iterator, edge: str, other: str) -> None:
        for e in beyond:
            key = e[edge]["key"] if e[edge]["sig"] != sig else e[other]
            if key is not None:
                wanted.setdefault(key, []).append(bucket)
                return

    for i, e in enumerate(found):
        ask(e["bucket"], e["first"]["sig"], reversed(found[:i]), "last", "second_last")
        ask(e["bucket"], e["last"]["sig"], iter(found[i + 1 :]), "first", "second")
    return splits, wanted


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text.

    Null html counts as empty (text ""); a null url sorts as the empty one; repeated
    rows keep their number; other columns are ignored; an empty table gives an empty
    result; very long pages are differenced whole, by one task. Of neighbours whose paths share equally long prefixes, the one before counts. A page without a neighbour on its host, or whose neighbours are copies of it,
    keeps all lines outside boilerplate elements.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("given"), whole(url_col).alias("url"), whole(html_col).alias("html"))
    key = F.concat_ws("\x01", host, path, F.lpad(F.coalesce("page_id", F.lit("")), 20, "0"))
    columns = base.select("page_id", "given", host.alias("host"), path.alias("path"), key.alias("key"), "html")

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            signs = [signature(h, page_lines(x)) for h, x in zip(frame["host"], frame["html"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "sig": signs, "size": frame["html"].str.len()}, columns=["key", "sig", "size"])

    signed = cut(columns.select("key", "host", "html").mapInPandas(sign, "key string, sig long, size long"))
    n = max(n, -(-(signed.agg(F.sum("size")).first()[0] or 0) // RANGE_CHARS))
    splits, wanted = _ranges(signed.select("key", "sig"), n)
    shared = spark.sparkContext.broadcast((splits, wanted, _salts(spark, n)))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits, wanted, salts = shared.value
        for frame in frames:
            out = []
            for page_id, given, host, path, key, source in frame.itertuples(index=False, name=None):
                lines = page_lines(source)
                row = (key, signature(host, lines), page_id, given, host, path, [r for r, _ in lines], [_hash(t) for _, t in lines], [t for r, t in lines if r != BOILERPLATE])
                place = bisect_right(splits, key)
                out.append((salts[place], place, False, *row))
                out.extend((salts[bucket], bucket, True, *row) for bucket in wanted.get(key, ()))
            yield pd.DataFrame(out, columns=["salt", "bucket", "halo", "key", "sig", "page_id", "given", "host", "path", "roles", "hashes", "texts"])

    kind = dict(pages.dtypes)[id_col]
    lined = columns.mapInPandas(parse, "salt int, bucket int, halo boolean, key string, sig long, page_id string, given string, host string, path string, roles array<int>, hashes array<long>, texts array<string>")
    dealt = lined.repartition(n, "salt").sortWithinPartitions("bucket", "key", "sig", "halo").drop("salt")

    def difference(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict | None]:
            for frame in frames:
                for r in frame.to_dict("records"):
                    r["hashes"], r["roles"], r["texts"] = r["hashes"].tolist(), r["roles"].tolist(), list(r["texts"])
                    yield r
            yield None

        def finish(run: list[tuple], page: dict, before: dict | None, after: dict | None) -> Iterator[tuple]:
            """The pages (page_id, given, path) of a run of copies; their texts differ only by which neighbour is nearer."""
            near = [p if p is not None and p["bucket"] == page["bucket"] else None for p in (before, after)]
            texts: dict[bool, str] = {}
            for page_id, given, path in run:
                later = all(near) and near[1]["host"] == page["host"] and _prefix(near[1]["path"], path) > _prefix(near[0]["path"], path)
                if later not in texts:
                    texts[later] = main_text(page | {"path": path}, *near)
                yield page_id, given, texts[later]

        before, page, latest, run, out = None, None, None, [], []
        for r in rows():
            if page is not None and (r is None or (r["bucket"], r["sig"]) != (page["bucket"], page["sig"])):
                for row in finish(run, page, before, r):
                    out.append(row)
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=["page_id", "url", "text"])
                        out = []
                before, page, run = latest, None, []
            if r is not None:
                page, latest = page or r, r
                if not r["halo"]:
                    run.append((r["page_id"], r["given"], r["path"]))
        yield pd.DataFrame(out, columns=["page_id", "url", "text"])

    return dealt.mapInPandas(difference, "page_id string, url string, text string").withColumn("page_id", F.col("page_id").cast(kind))


def op1_htmltext(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
