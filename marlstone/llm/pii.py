"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Detection and replacement are SQL functions on one row at a time. Names are found after a
title, and where a listed given name stands before a capitalised word; what a text has as
a person's name is a name wherever else that text has it alone. The replacements are
keyed permutations, so two entities of a kind and shape never get the same one, and one entity
gets the same one wherever it occurs, without a table that documents would have to be
joined with: a Feistel network shifts each symbol inside its own alphabet (digits stay
digits, vowels vowels, capitals capitals, Cyrillic Cyrillic), by a hash of the other half.
``collisions`` checks that over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole

#: Symbols that may take each other's place. Upper and lower case rows run in parallel.
ALPHABETS = (
    "0123456789",
    "aeiou", "AEIOU",
    "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ",
    "àâäáãéèêëíìîïóòôöõúùûü", "ÀÂÄÁÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ",
    "ñçß", "ÑÇẞ",
    "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ",
    "бвгджзклмнпрстфхцчшщ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "йьъ", "ЙЬЪ",
    "αεηιουω", "ΑΕΗΙΟΥΩ",
    "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)

#: Given names by gender and script; a name of a row is replaced by another of it.
GIVEN_NAMES = (
    (
        "Adam", "Albert", "Alexander", "Andrew", "Antonio", "Arthur", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Felix", "Francisco",
        "Frank", "George", "Hans", "Henry", "Jack", "Jacques", "James", "Javier", "John", "Joseph", "Juan", "Karl", "Klaus", "Louis", "Luis", "Martin", "Matthew", "Michael",
        "Miguel", "Nicolas", "Oliver", "Otto", "Paul", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Samuel", "Stefan", "Thomas", "William", "Wolfgang",
    ),
    (
        "Alice", "Amelia", "Andrea", "Anna", "Barbara", "Camille", "Carmen", "Caroline", "Catherine", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Eva",
        "Greta", "Hannah", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Julia", "Karen", "Laura", "Linda", "Lucy", "Margaret", "Maria", "Marie", "Mary", "Monika",
        "Nancy", "Olivia", "Patricia", "Paula", "Petra", "Rachel", "Rosa", "Ruth", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula",
    ),
    ("Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей"),
    ("Анна", "Вера", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
)
TITLE = "(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr|г-н|г-жа)\\.? ){1,2}"
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}{1,30}(?:['’-](?!s(?!\p{L}))\p{L}{1,30})?"
LISTED = rf"(?=\p{{Lu}})(?:{'|'.join(n for names in GIVEN_NAMES for n in names)})(?!\p{{L}})"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried at a place; what a match of the whole pattern is, is told by the first that it fits.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|(?<![0-9.,/-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{TITLE}{WORD}(?: \p{{Lu}}\.)?(?: {WORD}){{0,2}}|{LISTED}(?:-{WORD}|(?: \p{{Lu}}\.)?(?: {WORD}){{1,2}}))",
}
PATTERN = "|".join(PATTERNS.values())
#: What every text with a match has somewhere: a cheap test that most texts fail.
HINT = r"[0-9@]|::"
NAME_HINT = rf"(?<!\p{{L}})(?:{TITLE}\p{{Lu}}|{LISTED}[ -]\p{{Lu}})"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(s: str) -> str:
    """SQL: ``s`` with the capitals of the alphabets made small; other letters keep their case, since no shift pairs them."""
    return f"translate({s}, '{''.join(ALPHABETS[2::2])}', '{''.join(ALPHABETS[1::2])}')"


def _shifted(c: str, by: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """SQL: symbol ``c`` moved by ``by`` places inside its alphabet; other symbols stay.

    All alphabets are one string; two tables say where a place's alphabet starts and how long it is.
    """
    joined = "".join(alphabets)
    starts = [sum(map(len, alphabets[:i])) for i, a in enumerate(alphabets) for _ in a]
    sizes = [len(a) for a in alphabets for _ in a]
    table = lambda values: f"element_at(array({', '.join(map(str, values))}), p)"
    return f"transform(array(instr('{joined}', {c})), p -> if(p = 0, {c}, substr('{joined}', {table(starts)} + cast(pmod(p - 1 - {table(starts)} + {by}, {table(sizes)}) as int) + 1, 1)))[0]"


def permuted(symbols: str, key: str, tweak: str, rounds: int = 6, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """SQL: a keyed permutation of an array of symbols that keeps each in its alphabet, whichever case it is written in."""
    by = "cast(conv(substr(h, cast(pmod(i, 15) as int) * 4 + 1, 4), 16, 10) as int)"
    digest = f"sha2(concat_ws('|', {_sql(key)}, {tweak}, r, lower(array_join(a.r, ''))), 256)"
    return f"""aggregate(sequence(1, {rounds}),
      named_struct('l', slice({symbols}, 1, cast(floor(size({symbols}) / 2) as int)), 'r', slice({symbols}, cast(floor(size({symbols}) / 2) as int) + 1, size({symbols}))),
      (a, r) -> named_struct('l', a.r, 'r', transform(array({digest}), h -> transform(a.l, (x, i) -> {_shifted("x", by, alphabets)}))[0]),
      a -> concat(a.l, a.r))"""


def _chars(s: str) -> str:
    return f"filter(split({s}, ''), x -> x <> '')"


def _redigit(s: str, digits: str, skip: str = "0") -> str:
    """SQL: ``s`` with its digits after the first ``skip`` replaced, in order, by the array ``digits``."""
    nth = f"length(regexp_replace(substr({s}, 1, i), '[^0-9]', ''))"
    return f"array_join(transform({_chars(s)}, (x, i) -> if(x between '0' and '9' and {nth} >= {skip}, {digits}[cast({nth} - {skip} as int)], x)), '')"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of an array of digits to which a check digit is still to be added, modulo 10."""
    return f"""cast(pmod(aggregate(transform(reverse({digits}), (x, i) -> if(i % 2 = 0, cast(x as int) * 2 - if(cast(x as int) > 4, 9, 0), cast(x as int))), 0, (a, x) -> a + x), 10) as int)"""


#: What a phone number keeps: the country's code, or the zero before an area.
PREFIX = r"^(?:\+[0-9]{1,3}(?=[ .(-])|0(?=[1-9]))"


def _mod97(body: str, country: str) -> str:
    """SQL: the check digits that an IBAN of this body and country ought to have, as a number from 2 to 98."""
    digit = "if(x between '0' and '9', a * 10 + cast(x as int), a * 100 + ascii(x) - 55)"
    return f"(98 - aggregate({_chars(f"concat(replace({body}, ' ', ''), {country}, '00')")}, 0, (a, x) -> cast(pmod({digit}, 97) as int)))"


def _surrogate_sql(key: str) -> str:
    """SQL: the surrogate of an entity e (kind, found)."""
    f = "e.found"
    bound = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    tail = rf"regexp_replace(e.found, {_sql(PREFIX)}, '')"
    digits = lambda s: _chars(f"regexp_replace({s}, '[^0-9]', '')")
    phone = bound(tail, "t", f"concat(substr({f}, 1, length({f}) - length(t)), {bound(permuted(digits('t'), key, _sql('phone')), 'd', _redigit('t', 'd'))})")
    ssn = bound(permuted(digits(f), key, _sql("ssn")), "d", _redigit(f, "d"))
    body = f"slice({digits(f)}, 1, length(regexp_replace({f}, '[^0-9]', '')) - 1)"
    check = f"cast(right(regexp_replace({f}, '[^0-9]', ''), 1) as int)"
    last = f"cast(pmod({check} + {_luhn(body)} - {_luhn('p')}, 10) as string)"
    card = bound(permuted(body, key, _sql("card")), "p", bound(f"concat(p, array({last}))", "d", _redigit(f, "d")))
    octet = "cast(conv(substr(h, cast(i as int) * 4 + 1, 4), 16, 10) as int)"
    ip = f"""array_join(transform(aggregate(sequence(1, 6),
        named_struct('l', slice(transform(split({f}, '[.]'), x -> cast(x as int)), 1, 2), 'r', slice(transform(split({f}, '[.]'), x -> cast(x as int)), 3, 2)),
        (a, r) -> named_struct('l', a.r, 'r', transform(array(sha2(concat_ws('|', {_sql(key)}, 'ip', r, array_join(a.r, '.')), 256)), h -> transform(a.l, (x, i) -> cast(pmod(x + {octet}, 256) as int)))[0]),
        a -> concat(a.l, a.r)), x -> cast(x as string)), '.')"""
    # valid check digits become valid ones, and others miss theirs by as much; those that no IBAN can have stay
    old = f"cast(substr({f}, 3, 2) as int)"
    missed = f"cast(pmod({_mod97('b', f'substr({f}, 1, 2)')} - 2 + {old} - {_mod97(f'substr({f}, 5)', f'substr({f}, 1, 2)')}, 97) as int) + 2"
    check2 = f"if({old} between 2 and 98, lpad(cast({missed} as string), 2, '0'), substr({f}, 3, 2))"
    iban = bound(f"array_join({permuted(_chars(f'substr({f}, 5)'), key, _sql('iban'))}, '')", "b", f"concat(substr({f}, 1, 2), {check2}, b)")
    small = permuted(_chars(f"lower({f})"), key, _sql("ipv6"), alphabets=("0123456789abcdef",))
    ipv6 = bound(f"array_join({small}, '')", "v", f"if({f} = upper({f}), upper(v), v)")
    email = f"""concat(array_join({permuted(_chars(f"split({f}, '@')[0]"), key, f"lower(split({f}, '@')[1])")}, ''), '@',
        array_join({permuted(_chars(f"regexp_extract(split({f}, '@')[1], '^(.*)[.]([^.]*)$', 1)"), key, _sql("domain"))}, ''), '.', regexp_extract(split({f}, '@')[1], '[^.]*$', 0))"""
    row = lambda names: f"array({', '.join(_sql(n) for n in names)})"
    given = " ".join(
        f"when array_contains({row(n.lower() for n in names)}, {_folded('w')}) then {row(names)}[cast(pmod(array_position({row(n.lower() for n in names)}, {_folded('w')}) + pmod(conv(substr(sha2(concat({_sql(key)}, 'given{i}'), 256), 1, 6), 16, 10), {len(names) - 1}), {len(names)}) as int)]"
        for i, names in enumerate(GIVEN_NAMES)
    )
    listed = [n.lower() for names in GIVEN_NAMES for n in names]
    # a word that the permutation takes to a listed name is permuted on until it leaves the list, so that both stay one to one
    walk = f"aggregate(sequence(1, {len(listed) + 1}), w, (v, k) -> if(k = 1 or array_contains({row(listed)}, {_folded('v')}), array_join({permuted(_chars('v'), key, _sql('name'))}, ''), v))"
    word = f"transform(array(case {given} end), g -> if(g is null, {walk}, if(w = upper(w), upper(g), g)))[0]"
    title = f"regexp_extract({f}, {_sql('^' + TITLE)}, 0)"
    name = bound(title, "t", f"concat(t, array_join(transform(split(substr({f}, length(t) + 1), ' '), w -> {word}), ' '))")
    return f"case e.kind when 'email' then {email} when 'ip' then {ip} when 'ipv6' then {ipv6} when 'iban' then {iban} when 'card' then {card} when 'ssn' then {ssn} when 'phone' then {phone} else {name} end"


def _kind_sql(found: str) -> str:
    cases = " ".join(f"when {found} rlike {_sql(f'^(?:{p})$')} then '{k}'" for k, p in PATTERNS.items() if k != "name")
    return f"case {cases} else 'name' end"


def person_words(text: Column) -> Column:
    """The words of all names that a text has with a title or after a listed given name; no titles, no initials."""
    names = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    words = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(n, f"^{TITLE}", ""), "[ -]")))
    return F.when(text.rlike(NAME_HINT), F.array_distinct(F.filter(words, lambda w: w.rlike(rf"^{WORD}$")))).otherwise(F.array().cast("array<string>"))


def pattern_of(words: Column) -> Column:
    """The pattern of a text's entities: the fixed one, and its persons' words by themselves."""
    bare = F.concat(F.lit(rf"{PATTERN}|(?<!\p{{L}})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(words) > 0, bare).otherwise(F.lit(PATTERN))


def _with_surrogates(docs: DataFrame, key: str, text_col: str, replace: bool) -> DataFrame:
    words, pattern, found, kinds = (free_name(docs, f"_{n}") for n in ("words", "pattern", "found", "kinds"))
    entities = free_name(docs, "entities")
    text = F.col(text_col)
    hinted = (F.size(words) > 0) | text.rlike(HINT)
    marked = (
        docs.withColumn(text_col, whole(text_col))
        .withColumn(words, person_words(text))
        .withColumn(pattern, pattern_of(F.col(words)))
        .withColumn(found, F.when(hinted, F.regexp_extract_all(text, F.col(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        .withColumn(kinds, F.expr(f"transform({found}, f -> named_struct('kind', {_kind_sql('f')}, 'found', f))"))
        .withColumn(entities, F.expr(f"transform({kinds}, e -> named_struct('kind', e.kind, 'found', e.found, 'surrogate', {_surrogate_sql(key)}))"))
    )
    if replace:
        woven = F.zip_with(F.split(text, F.col(pattern), -1), F.col(entities), lambda gap, e: F.concat(gap, F.coalesce(e["surrogate"], F.lit(""))))
        marked = marked.withColumn(text_col, F.when(F.size(entities) > 0, F.array_join(woven, "")).otherwise(text))
    return marked.drop(words, pattern, found, kinds)


def with_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column entities (_entities where it has one): each text's entities in order as an array of (kind, found, surrogate)."""
    return _with_surrogates(docs, key, text_col, False)


def surrogates(docs: DataFrame, key: str = "marlstone", text_col: str = "text") -> DataFrame:
    """``docs`` with the PII of ``text_col`` replaced; further columns stay as they are.

    Null texts become empty; repeated rows keep their number; an empty table gives an
    empty result. The column entities (kind, found, surrogate) is added, as _entities where
    ``docs`` has one of that name.
    """
    return _with_surrogates(docs, key, text_col, True)


def canonical(kind: Column, value: Column) -> Column:
    """What two spellings of one entity have in common."""
    digits = F.regexp_replace(F.regexp_replace(value, PREFIX, ""), "[^0-9]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).otherwise(F.translate(value, "".join(ALPHABETS[2::2]), "".join(ALPHABETS[1::2])))


def collisions(marked: DataFrame) -> DataFrame:
    """Surrogates (kind, surrogate) that two different entities got, or two that one entity got. Should be empty.

    ``marked`` has the column entities. Counts are pre-aggregated by (entity,
    surrogate), so a frequent entity is one row a task.
    """
    pairs = (
        marked.where(F.size("entities") > 0)
        .select(F.explode("entities").alias("e"))
        .select("e.kind", canonical(F.col("e.kind"), F.col("e.found")).alias("entity"), canonical(F.col("e.kind"), F.col("e.surrogate")).alias("surrogate"))
        .distinct()
    )
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind", "surrogate")
    split = pairs.groupBy("kind", "entity").agg(F.count("*").alias("n"), F.min("surrogate").alias("surrogate")).where("n > 1").select("kind", "surrogate")
    return shared.union(split)


def checked_surrogates(docs: DataFrame, key: str = "marlstone", text_col: str = "text", tries: int = 5) -> DataFrame:
    """``surrogates`` under the first key (``key``, then variants of it) for which no two entities of the whole table share one.

    An error if there is none among ``tries`` keys.
    """
    for n in range(tries):
        used = f"{key}#{n}" if n else key
        columns = docs.select(text_col)
        if collisions(with_entities(columns, used, text_col)).isEmpty():
            return surrogates(docs, used, text_col)
    raise ValueError(f"two entities share a surrogate under each of {tries} keys")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = checked_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"))
