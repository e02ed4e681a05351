"""Column builders: cleaning, mapping, classification, extraction and derived measures.

All of them are built-in Spark expressions, so they stay inside the JVM and its generated code. Null in gives
null out unless a docstring says otherwise. Rules, words, ranges and weights are arguments.
"""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
Rules = Sequence[tuple[str, Sequence[str]]]


def alternation(words: Sequence[str], whole_word: bool = False) -> str:
    """A pattern that finds any of the plain words."""
    body = "|".join(re.escape(w) for w in words)
    return rf"\b({body})\b" if whole_word else f"({body})"


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    """True where one of the patterns is found; null counts as the empty text."""
    return F.coalesce(c, F.lit("")).rlike("|".join(f"({p})" for p in patterns))


# -- cleaning

def to_number(c: Column) -> Column:
    """Text to double; what isn't a finite decimal number becomes null."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_measure(c: Column) -> Column:
    """'about 5', '<5', '5-9' (mean, 2 digits), '5 nm': a number, or null."""
    s = F.trim(F.regexp_replace(F.trim(c), r"^(~|≈|≤|≥|<|>|about |ca\. ?|\s)+", ""))
    a = F.regexp_extract(s, r"^([0-9]+\.?[0-9]*)\s*[-–]\s*([0-9]+\.?[0-9]*)", 1)
    b = F.regexp_extract(s, r"^([0-9]+\.?[0-9]*)\s*[-–]\s*([0-9]+\.?[0-9]*)", 2)
    first = F.regexp_extract(s, r"^(\S+)", 1)
    return F.when(a != "", F.round((a.try_cast("double") + b.try_cast("double")) / 2, 2)).otherwise(to_number(first))


def null_outside(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def clean_null(c: Column, words: Sequence[str]) -> Column:
    """Trimmed text; placeholder words (any case) and blanks become null."""
    s = F.trim(c)
    return F.when((s != "") & ~F.lower(s).isin([w.lower() for w in words]), s)


def canonical_scalar(c: Column) -> Column:
    """Numbers as text: whole ones without a fraction, others with 4 digits at most; other text trimmed. Blanks, NaN, infinities and 'none' in any case are null."""
    s = F.trim(c.cast("string"))
    x = to_number(c)
    return (F.when(s.isNull() | (s == "") | F.lower(s).rlike(r"^([+-]?(nan|inf|infinity)|none)$"), F.lit(None))
            .when(x.isNull(), s)
            .when(x == F.floor(x), x.cast("long").cast("string"))
            .otherwise(F.round(x, 4).cast("string")))


def normalize_key(c: Column, prefixes: Sequence[str]) -> Column:
    """Lower case, trimmed, without a resolver prefix; an empty key becomes null."""
    s = F.regexp_replace(F.lower(F.trim(c)), "^(" + "|".join(prefixes) + ")", "")
    return F.when(s != "", s)


def key_to_stem(c: Column, charset: str, lower: bool = True) -> Column:
    """A key as a file stem: characters of charset become '_'."""
    s = F.lower(c) if lower else c
    return F.regexp_replace(s, f"[{re.escape(charset)}]", "_")


def fold_text(c: Column, letters: Mapping[str, str]) -> Column:
    """Characters mapped one by one (each to one character), then white space squeezed and trimmed."""
    s = F.translate(c, "".join(letters), "".join(letters.values()))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def decode_entities(c: Column) -> Column:
    """HTML entities decoded once: all names of the HTML standard, decimal and hexadecimal numbers; unknown ones stay. No-break spaces become spaces."""
    named = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")
    entity = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def one(x: Column) -> Column:
        common = F.when(x == "amp", "&").when(x == "lt", "<").when(x == "gt", ">").when(x == "quot", '"').when(x == "nbsp", "\xa0").when(x == "apos", "'")
        number = F.when(F.lower(x).startswith("#x"), F.conv(F.substring(x, 3, 6), 16, 10)).when(x.startswith("#"), F.substring(x, 2, 7)).try_cast("int")
        code = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), number)
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        # a map is gone through name by name: the common ones are told before
        return F.coalesce(common, F.when(x.startswith("#"), wide).otherwise(F.try_element_at(named, x)), F.concat(F.lit("&"), x, F.lit(";")))

    def decoded(t: Column) -> Column:
        outside, inside = F.split(t, entity), F.regexp_extract_all(t, F.lit(entity), F.lit(1))
        return F.array_join(F.zip_with(outside, F.transform(inside, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # in a lambda, so that only texts that may have an entity are split
    return F.translate(F.when(F.contains(c, F.lit("&")), F.transform(F.array(c), decoded)[0]).otherwise(c), "\xa0", " ")


def clean_html(c: Column) -> Column:
    """Tags removed, entities decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), r"\s+", " "))


def join_first(c: Column, n: int, sep: str) -> Column:
    """The first n members of an array, joined."""
    return F.array_join(F.slice(c, 1, n), sep)


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_token(c: Column, sep: str = ";") -> Column:
    """First member of a separated list, trimmed, lower case; empty becomes null."""
    s = F.lower(F.trim(F.get(F.split(c, re.escape(sep)), F.lit(0))))
    return F.when(s != "", s)


def to_unit(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """value times the factor of its unit; unknown units give null."""
    out = reduce(lambda acc, kv: acc.when(F.lower(F.trim(unit)) == kv[0], value * F.lit(float(kv[1]))), list(factors.items())[1:],
                 F.when(F.lower(F.trim(unit)) == next(iter(factors)), value * F.lit(float(next(iter(factors.values()))))))
    return out


# -- mapping and classification

def map_values(c: Column, mapping: Mapping[str, str], fallback: str = "keep") -> Column:
    """The canonical name of a value (any case, trimmed); unknown values stay ('keep') or become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in (kv[0].lower(), kv[1])]
    hit = F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c)))
    return F.coalesce(hit, c) if fallback == "keep" else hit


def classify_regex(c: Column, rules: Rules, invalid: Sequence[str] = (), default: str | None = None) -> Column:
    """Label of the first rule with a pattern that is found; invalid words give null; no hit gives default, or the text itself."""
    out = F.when(F.lower(F.trim(c)).isin([w.lower() for w in invalid]), F.lit(None)) if invalid else None
    for label, patterns in rules:
        hit = any_of(c, patterns)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(default) if default is not None else c))


def classify_tokens(c: Column, rules: Rules, split: str = "[;,]") -> Column:
    """Token by token: the label of the first token that any rule takes; patterns never cross tokens."""
    def one(token: Column) -> Column:
        out = None
        for label, patterns in rules:
            hit = any_of(F.trim(token), patterns)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out

    return F.get(F.array_compact(F.transform(F.split(c, split), one)), F.lit(0))


def fill_by_keywords(c: Column, hay: Column, rules: Rules) -> Column:
    """c where it isn't null, else the label of the first rule with a keyword in hay (lower-cased)."""
    out = None
    for label, words in rules:
        hit = F.coalesce(F.lower(hay), F.lit("")).rlike(alternation(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.coalesce(c, out)


def fill_by_pattern(c: Column, hay: Column, rules: Rules) -> Column:
    """c where it isn't null, else the label of the first pattern found; patterns carry their own case flags."""
    out = None
    for label, patterns in rules:
        hit = any_of(hay, patterns)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.coalesce(c, out)


def tag_keywords(c: Column, rules: Rules) -> Column:
    """All labels with a keyword in the text, in rule order; an empty array for none and for null."""
    low = F.coalesce(F.lower(c), F.lit(""))
    return F.array_compact(F.array(*[F.when(low.rlike(alternation(words)), label) for label, words in rules]))


def fill_multilabel(c: Column, hay: Column, rules: Rules) -> Column:
    """c where it isn't null, else the labels found, joined by '; ' (null for none)."""
    return F.coalesce(c, F.nullif(F.array_join(tag_keywords(hay, rules), "; "), F.lit("")))


def extract_labels(c: Column, rules: Rules, generic: Sequence[str], cap: int) -> Column:
    """Labels found; generic ones go when others are there; at most cap of them."""
    found = tag_keywords(c, rules)
    special = F.array_except(found, F.array(*map(F.lit, generic)))
    return F.slice(F.when(F.size(special) > 0, special).otherwise(found), 1, cap)


def is_class(c: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    low = F.coalesce(F.lower(c), F.lit(""))
    return low.rlike(alternation(include)) & ~low.rlike(alternation(exclude))


def topic_mask(columns: Sequence[Column], words: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).rlike(alternation(words, whole_word=True))


def null_unless_any(c: Column, patterns: Sequence[str], split: str = "[;, ]+") -> Column:
    return F.when(F.exists(F.split(c, split), lambda x: any_of(x, patterns)), c)


def null_if_in(c: Column, words: Sequence[str]) -> Column:
    return F.when(~F.lower(F.trim(c)).isin([w.lower() for w in words]), c)


# -- text extraction

def extract_number(c: Column, patterns: Sequence[str], low: float, high: float) -> Column:
    """First group of the first match of each pattern in turn; a value out of range passes on to the next pattern."""
    tries = [F.regexp_extract(c, p, 1).try_cast("double") for p in patterns]
    return F.coalesce(*[null_outside(x, low, high) for x in tries])


def extract_first(c: Column, patterns: Sequence[str]) -> Column:
    """The whole match of the first pattern that is found."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in patterns])


def drop_sentences(c: Column, pattern: str) -> Column:
    """Sentences in which pattern is found go; the rest are joined by a space."""
    return F.array_join(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(pattern)), " ")


def section(c: Column, headers: Sequence[str], n: int) -> Column:
    """n characters from the first header (in the given order) that occurs; the text's head without one."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.instr(low, h.lower()) > 0, c.substr(F.instr(low, h.lower()), F.lit(n))) for h in headers], F.substring(c, 1, n))


def sections_budget(c: Column, first: str, second: str, n: int, share: float = 0.45) -> Column:
    """share of n characters from the first section and the rest from the second; one section gets three quarters, with none the head gets all."""
    low = F.lower(c)
    a, b = F.instr(low, first), F.instr(low, second)
    na, n34 = int(n * share), n * 3 // 4
    both = F.concat(c.substr(a, F.lit(na)), F.lit("\n"), c.substr(b, F.lit(n - na)))
    return (F.when((a > 0) & (b > 0), both).when(a > 0, c.substr(a, F.lit(n34))).when(b > 0, c.substr(b, F.lit(n34)))
            .otherwise(F.substring(c, 1, n)))


def sections_with_ends(c: Column, first: str, second: str, n: int, end: str | None = None, both: float = 0.45, first_only: float = 0.6, second_only: float = 0.6, head: float = 0.75) -> Column:
    """At most n characters: all of a short text; else two sections; else one section with the text's tail (first) or head (second); else head and tail.

    end: a pattern at whose first match, behind the sections' start, the text ends before anything is taken.
    """
    text = c if end is None else F.when(F.length(F.get(F.split(c, end, 2), F.lit(0))) > 0, F.get(F.split(c, end, 2), F.lit(0))).otherwise(c)
    low, size = F.lower(text), F.length(text)
    a, b = F.instr(low, first), F.instr(low, second)
    part = lambda at, k: text.substr(at, F.lit(k))
    tail = lambda k: text.substr(size - k + 1, F.lit(k))
    join = lambda x, y: F.concat(x, F.lit("\n"), y)
    na, n1, n2, nh = int(n * both), int(n * first_only), int(n * second_only), int(n * head)
    return (F.when(size <= n, text).when((a > 0) & (b > 0), join(part(a, na), part(b, n - na))).when(a > 0, join(part(a, n1), tail(n - n1)))
            .when(b > 0, join(part(F.lit(1), n - n2), part(b, n2))).otherwise(join(part(F.lit(1), nh), tail(n - nh))))


def reconstruct_text(c: Column) -> Column:
    """The text of an inverted index (map of word to positions)."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def within_chars(c: Column, a: str, b: str, n: int) -> Column:
    """True where the two patterns are found with at most n characters between them, in either order."""
    return F.coalesce(c, F.lit("")).rlike(f"(?is)({a}).{{0,{n}}}({b})|({b}).{{0,{n}}}({a})")


def bare_text(c: Column) -> Column:
    """Letters and digits of a text in lower case; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def presence(bare: Column, tokens: Column, least: int = 3, stem: int = 5, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """True when each ';' token (letters and digits only, at least `least` of them), its first characters or one of its aliases occur in a text as bare_text() gives it."""
    parts = F.filter(F.transform(F.split(F.coalesce(tokens, F.lit("")), ";"), bare_text), lambda x: F.length(x) >= least)
    others = None
    if aliases:
        clean = {re.sub("[^a-z0-9]", "", k.lower()): [re.sub("[^a-z0-9]", "", a.lower()) for a in v] for k, v in aliases.items()}
        others = F.create_map(*[x for k, v in clean.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def found(x: Column) -> Column:
        hit = F.contains(bare, x) | F.contains(bare, F.substring(x, 1, stem))
        if others is not None:
            hit = hit | F.exists(F.coalesce(F.try_element_at(others, x), F.array(F.lit(None).cast("string"))), lambda a: F.coalesce(F.contains(bare, a), F.lit(False)))
        return hit

    return F.forall(parts, found)


# -- derived measures

def coalesce_with_source(sources: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """First value that isn't null, and the label of where it came from."""
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for c, name in sources])
    return F.coalesce(*[c for c, _ in sources]), label


def backfill_label(label: Column, rules: Sequence[tuple[Column, str]]) -> Column:
    """The label, or the name of the first rule that holds."""
    return F.coalesce(label, *[F.when(rule, F.lit(name)) for rule, name in rules])


def row_label(parts: Sequence, sep: str = " · ") -> Column:
    """The known parts, joined."""
    return F.concat_ws(sep, *parts)


def extract_cascade(steps: Sequence[Column]) -> Column:
    """The first of several extractions that finds something."""
    return F.coalesce(*steps)


def overlay(first: Column, second: Column) -> Column:
    """first where it is known, else second: a careful extraction laid over a lenient one."""
    return F.coalesce(first, second)


def null_if_inconsistent(a: Column, b: Column, ratio: float) -> Column:
    """a, unless it is over ratio times a known b."""
    return F.when(b.isNull() | (a <= b * ratio), a)


def safe_ratio(a: Column, b: Column, low: float, high: float) -> Column:
    return null_outside(F.try_divide(a, b), low, high)


def log_clip(c: Column, floor: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(floor))))


def present(c: Column, words: Sequence[str] = ()) -> Column:
    return clean_null(c.cast("string"), words).isNotNull().cast("int")


def completeness(weights: Mapping[str, float]) -> Column:
    """Share of the summed weight whose column isn't null, in percent with one digit."""
    have = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items()])
    return F.round(have / sum(weights.values()) * 100, 1)


def quality_flags(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """'col=value(range:lo-hi)' of every value out of its range, joined by '; '."""
    parts = [F.when(~F.col(c).between(lo, hi), F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit(f"(range:{lo}-{hi})"))) for c, (lo, hi) in ranges.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def summary_text(templates: Sequence[tuple[str, str]]) -> Column:
    """Templates (column, text with {}) of the filled columns, joined by '; '."""
    parts = []
    for c, text in templates:
        a, b = text.split("{}")
        parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))))
    return F.concat_ws("; ", *parts)


def filled_map(columns: Sequence[str]) -> Column:
    """Map of the filled columns' names to their values as text."""
    whole = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def norm_categorical(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))


def resolve_range(point: Column, is_range: Column, low: Column, high: Column) -> Column:
    return F.when(is_range & low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(point)
