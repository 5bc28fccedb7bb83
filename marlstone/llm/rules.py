"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger stores for each document what was measured and one
long with a bit for each rule that it fails; policies are versioned sets of rules applied to
the stored bits alone, and ablations count bit patterns, so that neither reads a text again.
Rules compare integers, so SQL gives the same bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, table, whole

SYMBOLS = "#*$%&|<>"
#: What is measured, in the order of the ledger's columns; all are counts.
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_alpha_words n_upper_words n_marks n_bullet_lines n_cut_lines".split()
#: Rules by bit: a name and the condition, over the measures, under which a document fails. Bits keep their meaning; new rules come last.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("no_letters", "100 * n_alpha_words < 70 * n_words"),
    ("upper_case", "100 * n_upper_words > 60 * n_words"),
    ("marks", "10 * n_marks > 4 * n_words"),
    ("bullets", "n_lines >= 4 and 100 * n_bullet_lines > 90 * n_lines"),
    ("cut_lines", "n_lines >= 4 and 100 * n_cut_lines > 50 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

_LETTER, _UPPER, _LOWER = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_BULLET = (b"-", b"*", "•".encode(), "‣".encode(), "▪".encode())
_CUT = (b"...", "…".encode())


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules: a document goes if it fails one of ``fatal`` or more than ``tolerated`` of ``counted``."""

    name: str
    version: int
    fatal: tuple[str, ...]
    counted: tuple[str, ...] = ()
    tolerated: int = 0

    def without(self, rule: str) -> Policy:
        return Policy(self.name, self.version, tuple(r for r in self.fatal if r != rule), tuple(r for r in self.counted if r != rule), self.tolerated)

    def keeps(self, bits: Column) -> Column:
        fatal = bits.bitwiseAND(F.lit(mask(self.fatal)).cast("long")) == 0
        return fatal & (F.bit_count(bits.bitwiseAND(F.lit(mask(self.counted)).cast("long"))) <= self.tolerated) if self.counted else fatal


def mask(rules: tuple[str, ...]) -> int:
    return reduce(lambda m, r: m | BIT[r], rules, 0)


#: The first version knew the base rules only.
POLICIES = {
    ("standard", 1): Policy("standard", 1, BASE),
    ("standard", 2): Policy("standard", 2, (*BASE, "symbols", "duplicate_lines", "no_letters", "upper_case", "marks"), ("short_words", "long_words", "bullets", "cut_lines"), 1),
}
CURRENT = ("standard", 2)


def repeated(codes: np.ndarray, kinds: int) -> int:
    """Words (by number, below ``kinds``) that lie in a window of three that stands twice or more."""
    if len(codes) < 4:
        return 0
    if kinds < 1 << 21:
        key = (codes[:-2] * kinds + codes[1:-1]) * kinds + codes[2:]
    else:  # three numbers don't fit into one: number the pairs first
        pair = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1]
        key = pair[:-1] * kinds + codes[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    often = n[at] > 1
    covered = np.zeros(len(codes), bool)
    for i in range(3):
        covered[i : i + len(often)] |= often
    return int(covered.sum())


def measured(text: str) -> tuple[int, ...]:
    """The measures of one text, in their order."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the six blanks of ASCII
    codes: dict[bytes, int] = {}
    at = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    times = np.bincount(at, minlength=len(codes))
    kinds = [w.decode("utf-8", "surrogatepass") for w in codes]
    total = lambda held: int(sum(n for n, x in zip(times.tolist(), held, strict=True) if x))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        sum(n * len(w) for n, w in zip(times.tolist(), kinds, strict=True)),
        sum(text.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated(at, len(codes)),
        len(lines),
        total(_LETTER.search(w) for w in kinds),
        total(len(w) > 1 and _UPPER.search(w) and not _LOWER.search(w) for w in kinds),
        text.count("!") + text.count("?"),
        sum(x.lstrip().startswith(_BULLET) for x in lines),
        sum(x.rstrip().endswith(_CUT) for x in lines),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the MEASURES, fail_bits): one row a document, every rule evaluated once over its whole text.

    Null texts count as empty: all measures are 0 and ``few_words`` fails. A very long text is
    held by its task alone, with one number a word. Repeated rows keep their number, null ids stay, other columns are
    ignored, and an empty table gives an empty ledger.
    """

    @F.pandas_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in texts], columns=MEASURES)

    rows = docs.select(F.col(id_col).alias("doc_id"), measure(whole(text_col)).alias("m")).select("doc_id", "m.*")
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule), BIT[name]).otherwise(0).cast("long") for name, rule in RULES))
    return rows.withColumn("fail_bits", bits)


def decided(entries: DataFrame, policy: Policy) -> DataFrame:
    """A ledger's rows with base_failed, kept and policy (name@version), from the bits alone."""
    bits = F.col("fail_bits")
    return entries.withColumns({"base_failed": bits.bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0, "kept": policy.keeps(bits), "policy": F.lit(f"{policy.name}@{policy.version}")})


def ablation(entries: DataFrame, policy: Policy, by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of a policy does: (*by, rule, bit, documents, failing, dropped, dropped_alone).

    ``dropped_alone``: documents that the policy drops and would keep without the rule. Equal
    bit patterns are counted first, so what is spread over the rules is bounded by patterns and not by
    documents; a hot value of ``by`` is summed before it is shuffled. Null values of ``by`` are a group.
    """
    patterns = entries.groupBy(*by, "fail_bits").agg(F.count("*").alias("docs"))
    bits, rules = F.col("fail_bits"), (*policy.fatal, *policy.counted)
    of = lambda r: F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), policy.without(r).keeps(bits).alias("otherwise"))
    rows = patterns.withColumn("gone", ~policy.keeps(bits)).select(*by, "fail_bits", "docs", "gone", F.explode(F.array(*map(of, rules))).alias("r"))
    count = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0))
    return rows.groupBy(*by, F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum("docs").alias("documents"),
        count(bits.bitwiseAND(F.col("r.bit")) != 0).alias("failing"),
        count(F.col("gone")).alias("dropped"),
        count(F.col("gone") & F.col("r.otherwise")).alias("dropped_alone"),
    )


def summary(entries: DataFrame, *by: str) -> DataFrame:
    """(*by, documents, any_failed, all_failed): the rules that some and that all documents of a group fail, as bits."""
    return entries.groupBy(*by).agg(F.count("*").alias("documents"), F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed"))


def changed(entries: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """(doc_id, kept_old, kept_new) of the documents on which two policies differ."""
    bits = F.col("fail_bits")
    rows = entries.select("doc_id", old.keeps(bits).alias("kept_old"), new.keeps(bits).alias("kept_new"))
    return rows.where("kept_old <> kept_new")


def op13_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents, stored once, and the current policy's verdict from its bits."""
    stored, _ = Shelf(spark, "ledger").put(ledger(table(spark, sf_dir, "documents")))
    return decided(stored, POLICIES[CURRENT])


_BITS = " | ".join(f"(case when {rule} then {BIT[name]} else 0 end)" for name, rule in RULES)
_NOW = POLICIES[CURRENT]
SQL = rf"""
with words as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
windows as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from words)),
often as (select r, i from windows qualify count(*) over (partition by r, a, b, c) > 1),
repeats as (select r, count(distinct p)::bigint as n from (select r, unnest([i, i + 1, i + 2]) as p from often) group by r),
measures as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  len(l)::bigint as n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::bigint as n_alpha_words,
  len(list_filter(w, lambda x: length(x) > 1 and regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '\p{{Ll}}')))::bigint as n_upper_words,
  (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪]')))::bigint as n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$')))::bigint as n_cut_lines from words left join repeats using (r)),
bits as (select *, ({_BITS})::bigint as fail_bits from measures)
select *, fail_bits & {mask(BASE)} <> 0 as base_failed, fail_bits & {mask(_NOW.fatal)} = 0 and bit_count(fail_bits & {mask(_NOW.counted)}) <= {_NOW.tolerated} as kept, '{_NOW.name}@{_NOW.version}' as policy from bits"""
