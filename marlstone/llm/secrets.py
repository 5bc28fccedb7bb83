"""Secret scan: keyed assignments, access ids, hex runs, and windows of high entropy.

Everything is SQL functions on one row at a time: no shuffle, no Python. Candidate
strings get a sliding window whose symbol counts, packed into a few longs, are kept up to
date as a character enters and another leaves; the sum of c*log2(c) changes by two terms a
step, and the entropy of the window is log2(w) - sum / w.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole
from .matches import bound, match_spans

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: An assignment stays if what it assigns has six characters.
ASSIGN_KEEP = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class of a candidate, by the first pattern it has in itself, and the bits a window needs.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 3.0), ("mixed", "^(?=.*[0-9])(?=.*[A-Za-z])", 3.9), ("letters", "", 4.1))
#: Candidates that are no secrets: identifiers in dashed groups, rulers, numbers.
ALLOW = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^[-_=+/]+$",
    "^[0-9]+$",
)
#: A candidate without any of this is plain words or a path of plain words, and no secret either.
ODD = "[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"
KINDS = ("assign", "access", "hex", "entropy")


#: The symbols of a candidate; the others count as one more. Counts up to WINDOW take COUNT_BITS each, some of them in one long.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
COUNT_BITS = 5
PER_LONG = 12
LONGS = len(SYMBOLS) // PER_LONG + 1


def _codes(candidate: Column) -> Column:
    """The candidate's characters as numbers: one pass over the string."""
    a = lambda c: F.ascii(c)
    return F.transform(
        F.filter(F.split(candidate, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), a(c) - 48)
        .when(c.between("a", "z"), a(c) - 87)
        .when(c.between("A", "Z"), a(c) - 29)
        .when(c == "+", 62)
        .when(c == "/", 63)
        .when(c == "_", 64)
        .when(c == "=", 65)
        .when(c == "-", 66)
        .otherwise(67),
    )


def _gain(n: Column) -> Column:
    """n * log2(n) - (n - 1) * log2(n - 1), from a table of the few counts there are."""
    weight = [n * math.log2(n) if n else 0.0 for n in range(1 << COUNT_BITS)]
    return F.element_at(F.array(*(F.lit(weight[n] - weight[n - 1]) for n in range(1, 1 << COUNT_BITS))), n)


def hot_range(candidate: Column, window: int, least: Column) -> Column:
    """(first, last): the starts of the first and the last window of at least so many bits; nulls if there is none.

    The counts are packed into a few longs, so that a step adds to one field and takes
    from another whatever the alphabet's size; the characters are an array, read in order.
    A window is judged a step late, when its sum is a plain field. Windows of up to 31
    characters.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError("a window has 1 to 31 characters")
    names = [f"c{j}" for j in range(LONGS)]
    zero, none, nothing = F.lit(0).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("struct<code:int,j:int,shift:int,one:bigint>")
    state = F.struct(*(zero.alias(n) for n in names), F.lit(0.0).alias("total"), F.lit(0).alias("i"), none.alias("first"), none.alias("last"))

    def symbol(code: Column) -> Column:
        """Where a symbol is counted: the long, the place in it, and a one at that place."""
        shift = F.pmod(code, F.lit(PER_LONG)) * COUNT_BITS
        one = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
        return F.struct(code.alias("code"), F.floor(code / PER_LONG).cast("int").alias("j"), shift.alias("shift"), one.alias("one"))

    def count(acc: Column, x: Column) -> Column:
        field = acc[names[-1]]
        for j in range(LONGS - 2, -1, -1):
            field = F.when(x["j"] == j, acc[names[j]]).otherwise(field)
        return F.call_function("shiftright", field, x["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def judged(acc: Column, need: Column) -> tuple[Column, Column]:
        near = (acc["i"] >= window) & (acc["total"] <= (F.lit(math.log2(window)) - need) * window + 0.001)
        hot = near & (F.round(F.lit(math.log2(window)) - acc["total"] / window, 6) >= need)
        at = acc["i"] - window
        return F.when(acc["first"].isNull() & hot, at).otherwise(acc["first"]), F.when(hot, at).otherwise(acc["last"])

    def step(acc: Column, x: Column, need: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        gone = leaves.isNotNull()
        more = count(acc, enters) + F.when(gone & (leaves["code"] == enters["code"]), 0).otherwise(1)
        total = acc["total"] + _gain(more) - F.when(gone, _gain(count(acc, leaves))).otherwise(0.0)
        first, last = judged(acc, need)
        fields = [acc[n] + F.when(enters["j"] == j, enters["one"]).otherwise(zero) - F.when(leaves["j"] == j, leaves["one"]).otherwise(zero) for j, n in enumerate(names)]
        return F.struct(*(f.alias(n) for f, n in zip(fields, names, strict=True)), total.alias("total"), (acc["i"] + 1).alias("i"), first.alias("first"), last.alias("last"))

    def folded(both: Column) -> Column:
        def done(acc: Column) -> Column:
            first, last = judged(acc, both["need"])
            return F.struct(first.alias("first"), last.alias("last"))

        symbols = both["symbols"]
        leaves = F.slice(F.concat(F.array_repeat(nothing, window), symbols), 1, F.size(symbols))
        steps = F.arrays_zip(symbols.alias("enters"), leaves.alias("leaves"))
        return F.aggregate(steps, state, lambda acc, x: step(acc, x, both["need"]), done)

    return bound(F.struct(F.transform(_codes(candidate), symbol).alias("symbols"), least.alias("need")), folded)


def entropy_spans(text: Column, base: Column, window: int = WINDOW, allow=ALLOW, classes=CLASSES) -> Column:
    """Stretches of hot windows, one in a candidate at most, that no allow-list pattern names and no base span overlaps."""

    def allowed(s: Column) -> Column:
        out = ~s.rlike(ODD)
        for pattern in allow:
            out = out | s.rlike(pattern)
        return out

    def least(s: Column) -> Column:
        out = F.lit(classes[-1][2])
        for _, pattern, bits in reversed(classes[:-1]):
            out = F.when(s.rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    candidates = F.filter(
        match_spans(text, CANDIDATE),
        lambda s: ~allowed(s["found"]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    hot = F.transform(
        candidates,
        lambda s: bound(hot_range(s["found"], window, least(s["found"])), lambda h: F.struct((s["start"] + h["first"]).alias("start"), (s["start"] + h["last"] + window).alias("end"))),
    )
    return F.filter(hot, lambda s: s["start"].isNotNull())


def _labelled(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of every document: doc_id, base (array), entropy (array), with start, order, end and kind.

    Null and empty texts give empty arrays; repeated rows keep their number; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select(
        "doc_id",
        "text",
        F.concat(
            _labelled(match_spans(text, ASSIGN, ASSIGN_KEEP), "assign"),
            _labelled(match_spans(text, ACCESS), "access"),
            _labelled(match_spans(text, HEX), "hex"),
        ).alias("base"),
    )
    entropy = F.when(text.rlike(CANDIDATE), _labelled(entropy_spans(text, F.col("base")), "entropy")).otherwise(F.filter(F.col("base"), lambda s: F.lit(False)))
    return found.select("doc_id", "base", entropy.alias("entropy"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("base")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """Per document, the spans of one kind as rows."""
    n, p = KINDS.index(kind), pattern.replace("'", "''")
    return f"""
  select doc_id, {n} as ord, '{kind}' as kind, gap_to + done as s, gap_to + done + len as e, f as found
  from (
    select doc_id, f, length(f) as len,
      sum(length(g)) over w as gap_to,
      coalesce(sum(length(f)) over (partition by row_id order by i rows between unbounded preceding and 1 preceding), 0) as done
    from (
      select doc_id, row_id, unnest(f) as f, unnest(g[1:len(f)]) as g, generate_subscripts(f, 1) as i
      from (select doc_id, row_id, regexp_extract_all(t, '{p}') as f, string_split_regex(t, '{p}') as g from docs))
    window w as (partition by row_id order by i)
  ) where regexp_matches(f, '{keep.replace("'", "''")}')"""


SQL = f"""
with docs as materialized (select doc_id, row_number() over () as row_id, coalesce(text, '') as t from documents),
base as materialized ({" union all ".join((_sql_spans("assign", ASSIGN, ASSIGN_KEEP), _sql_spans("access", ACCESS, ""), _sql_spans("hex", HEX, "")))}),
cand as materialized (select row_number() over () as cid, c.* from ({_sql_spans("entropy", CANDIDATE, "")}) c
  where regexp_matches(found, '{ODD}') and not ({" or ".join(f"regexp_matches(found, '{p}')" for p in ALLOW)})
  and not exists (select 1 from base b where b.doc_id = c.doc_id and b.s < c.e and c.s < b.e)),
win as (select cid, i, substr(found, i::int, {WINDOW}) as w from (select cid, found, unnest(generate_series(1, length(found) - {WINDOW} + 1)) as i from cand)),
chars as (select cid, i, c, count(*) as n from (select cid, i, unnest(string_split(w, '')) as c from win) where c <> '' group by all),
bits as (select cid, i, round(-sum(n / {WINDOW}.0::double * log2(n / {WINDOW}.0::double)), 6) as h from chars group by all),
hot as (select cid, min(i) as a, max(i) as b from bits join cand using (cid)
  where h >= case when regexp_matches(found, '{CLASSES[0][1]}') then {CLASSES[0][2]} when regexp_matches(found, '[0-9]') and regexp_matches(found, '[A-Za-z]') then {CLASSES[1][2]} else {CLASSES[2][2]} end group by cid),
every as (select doc_id, s, ord, e, kind from base union all select doc_id, s + a - 1, ord, s + b - 1 + {WINDOW}, kind from hot join cand using (cid)),
said as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3), '') as b,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans from every group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join said using (doc_id)
"""
