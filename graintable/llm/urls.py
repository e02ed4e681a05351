"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, and allow and block rules over hosts and paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import reachable, table

#: One hit rejects a url.
STRICT = ("casino", "porn", "porno", "pornography", "xxx", "hentai", "escort", "escorts", "viagra", "cialis", "malware", "phishing", "warez", "keygen", "spam", "jackpot", "camgirls", "sexcams")
#: Several different ones reject it.
SOFT = ("adult", "ads", "adserver", "affiliate", "banner", "bet", "bets", "betting", "bingo", "bonus", "cams", "cheap", "click", "clicks", "coupon", "coupons", "crack", "cracked", "dating", "deals", "discount", "farm", "free",
        "gambling", "hack", "hot", "loan", "loans", "lottery", "nude", "payday", "pills", "poker", "popup", "promo", "replica", "roulette", "sex", "singles", "slots", "sponsored", "torrent", "track", "tracker", "win", "winner", "x")
#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


class Vocabulary:
    """Strict and soft terms in one automaton; a term counts where no letter or digit of a-z, 0-9 stands beside it."""

    def __init__(self, terms: Mapping[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, kind in terms.items():
            self.automaton.add_word(term, (term, kind == "strict"))
        if terms:
            self.automaton.make_automaton()
        self.some = bool(terms)

    def hits(self, url: str | None) -> tuple[list[str], list[str]]:
        """The different strict and soft terms of a url up to its first ? or #, in order."""
        found: dict[tuple[str, bool], None] = {}
        if url and self.some:
            low = re.match("[^?#]*", url)[0].encode("utf-8", "replace").lower().decode("utf-8")  # A-Z only
            for end, (term, strict) in self.automaton.iter(low):
                before, after = low[end - len(term):end - len(term) + 1] if end >= len(term) else "", low[end + 1:end + 2]
                if not (_word(before) or _word(after)):
                    found[term, strict] = None
        return sorted(t for t, s in found if s), sorted(t for t, s in found if not s)


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Rules:
    """Rules by host; of those that fit a url the longest holds, of equally long ones that with the longer host, of equal ones block."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            if not host or not slash or verdict not in ("allow", "block"):
                raise ValueError(f"a rule is allow or block and host/path, not {verdict} {rule}")
            self.by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        labels, best = host.split("."), None
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for start, rule, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or (len(rule), len(name), verdict == "block") > best[0]):
                    best = (len(rule), len(name), verdict == "block"), rule, verdict
        return (best[1], best[2]) if best else (None, None)


def vocabulary(strict: Sequence[str], soft: Sequence[str]) -> dict[str, str]:
    """Terms in lower case with their kind; a term of both lists is strict, empty ones are none."""
    low = lambda t: t.translate(str.maketrans(UPPER, LOWER))
    return {low(t): "soft" for t in soft if t} | {low(t): "strict" for t in strict if t}


def judge(terms: Mapping[str, str], rules: Sequence[tuple[str, str]], soft_limit: int) -> Callable[[Column, Column, Column], Column]:
    """A column function of url, host and path: rule, verdict, strict, soft."""
    kind = "struct<rule:string,verdict:string,strict:array<string>,soft:array<string>>"
    made: list[tuple[Vocabulary, Rules]] = []
    Rules(rules)  # a fault shows here, not in a task

    @F.arrow_udf(kind)
    def run(url: pa.Array, host: pa.Array, path: pa.Array) -> pa.Array:
        if not made:
            made.append((Vocabulary(terms), Rules(rules)))
        words, known = made[0]
        rows = []
        for u, h, p in zip(url.to_pylist(), host.to_pylist(), path.to_pylist(), strict=True):
            rule, verdict = known.find(h, p)
            strict, soft = words.hits(u)
            rows.append({"rule": rule, "verdict": verdict or ("block" if strict or len(soft) >= soft_limit else "allow"), "strict": strict, "soft": soft})
        text = pa.list_(pa.string())
        return pa.array(rows, pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("strict", text), ("soft", text)]))

    return run


def filter_urls(pages: DataFrame, url_col: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host_, path_, rule_, verdict_, strict_ and soft_ (the different terms found); columns of these names are replaced.

    The longest rule that fits a url decides; without one a strict term blocks it, or soft_limit different soft terms.
    Terms are looked for in the url up to its first ? or # (what follows is mostly trackers' marks), A-Z lower-cased, also in one
    without ://; beside a term there may be no ASCII letter or digit. A rule (host/path) fits its host and all subdomains if the path, which begins with its slash, starts with the
    rule's; a port or user name is part of the host. Null and empty urls have no host, no path and no hit and are allowed. Repeated rows are
    judged alike; an empty table gives an empty one. There is no shuffle, and only url, host and path go to Python. Terms and rules are
    arguments, so what each task holds grows with them, not with the table.
    """
    reachable(pages.sparkSession)
    new = ("host_", "path_", "rule_", "verdict_", "strict_", "soft_")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(*rest, F.col(url_col).alias("_url_"), host.alias("_host_"), path.alias("_path_"))
    found = parts.withColumn("_found_", judge(vocabulary(strict, soft), rules, soft_limit)("_url_", "_host_", "_path_"))
    return found.select(*rest, F.col("_host_").alias("host_"), F.col("_path_").alias("path_"), *[F.col(f"_found_.{c}").alias(f"{c}_") for c in ("rule", "verdict", "strict", "soft")])


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with host, path, rule, verdict, and the terms found in the url; odd rows: see filter_urls."""
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("rule_").alias("rule"), F.col("verdict_").alias("verdict"),
                        F.array_join("strict_", " ").alias("strict_terms"), F.array_join("soft_", " ").alias("soft_terms"))


def _sql() -> str:
    """The same rows in SQL: one pattern a term, rules from the longest on."""
    hit = lambda t: f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])') THEN '{t}' END"
    terms = vocabulary(STRICT, SOFT)
    listed = lambda kind: f"concat_ws(' ', {', '.join(hit(t) for t in sorted(terms) if terms[t] == kind)})"
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    ordered = sorted(RULES, key=lambda x: (-len(x[1]), -len(x[1].partition("/")[0])))
    return f"""WITH r AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^[^?#]*'), ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, low, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
f AS (SELECT page_id, host, path, {listed('strict')} AS strict_terms, {listed('soft')} AS soft_terms, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered)} ELSE CASE WHEN strict_terms <> '' OR len(string_split(soft_terms, ' ')) >= 2 THEN 'block' ELSE 'allow' END END AS verdict, strict_terms, soft_terms FROM f"""


SQL = _sql()
