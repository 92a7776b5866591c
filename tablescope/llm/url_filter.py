"""URL filters: rules of hosts and paths, then a weighted vocabulary.

Terms are found with an Aho-Corasick automaton in one pass over the URL. A hit counts only
between word boundaries: the characters next to it are neither ASCII letters nor digits.
Every different strict term weighs ``STRICT``, every different soft term ``SOFT``, and a URL
whose terms weigh ``LIMIT`` or more is blocked: one strict term is enough, soft terms need
company. Repeats of a term are counted but weigh nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

STRICT, SOFT, LIMIT = 2, 1, 2

STRICT_TERMS = (
    "porn", "porno", "xxx", "casino", "viagra", "cialis", "warez", "escorts", "camgirls", "hentai",
    "malware", "phishing", "keygen", "spam-farm", "cheap-pills",
)
SOFT_TERMS = (
    "adult", "sex", "nude", "bet", "betting", "poker", "slots", "jackpot", "bonus", "loan", "loans",
    "payday", "pills", "pharmacy", "cheap", "free", "win", "winner", "crack", "torrent", "spam",
    "farm", "clickbait", "dating", "hot",
)
# (verdict, host, path) of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
BOUNDARY_BREAKERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
COLUMNS = (
    "host string, path string, rule string, verdict string, "
    "strict_hits long, soft_hits long, strict_terms long, soft_terms long, weight long"
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [at for at in map(rest.find, "/?#") if at >= 0]
    end = min(ends, default=len(rest))
    host, rest = rest[:end].translate(ASCII_LOWER), rest[end:]
    ends = [at for at in map(rest.find, "?#") if at >= 0]
    return host, rest[: min(ends, default=len(rest))]


class Rules:
    """Rules by host; the longest that fits wins, then the one of the longer host, then a block."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        suffix = host
        while suffix:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    rank = (len(suffix) + len(start), len(suffix), verdict == "block")
                    if best is None or rank > best[0]:
                        best = rank, suffix + start, verdict
            suffix = suffix.partition(".")[2]
        return best and best[1:]


class Vocabulary:
    """The automaton of all terms."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):  # a term in both is strict
            for term in terms:
                term = term.translate(ASCII_LOWER)
                self.automaton.add_word(term, (term, kind))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> list[tuple[str, str]]:
        """(term, kind) of every hit between boundaries; overlapping hits all count."""
        if not len(self.automaton):
            return []
        text = url.translate(ASCII_LOWER)
        found = []
        for last, (term, kind) in self.automaton.iter(text):
            first = last - len(term) + 1
            before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
            if before not in BOUNDARY_BREAKERS and after not in BOUNDARY_BREAKERS:
                found.append((term, kind))
        return found


def filter_urls(
    df: DataFrame,
    key: str,
    url: str,
    rules: Iterable[tuple[str, str, str]] = (),
    strict: Iterable[str] = STRICT_TERMS,
    soft: Iterable[str] = SOFT_TERMS,
) -> DataFrame:
    """One row per row of ``df``: its key, host, path, rule, verdict and counts.

    Only ``key`` and ``url`` are read, so further columns may have any names. A null or empty
    URL has empty host and path, no rule, and is allowed. Repeated rows each give a row; an
    empty frame gives none. There is no shuffle. Rules and vocabulary travel with the task.
    """
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[url].alias("url"))

    def judged(batches):
        by_rule, vocabulary = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            out = []
            for address in batch["url"]:
                address = address if isinstance(address, str) else ""
                host, path = host_and_path(address)
                rule = by_rule.find(host, path)
                hits = vocabulary.hits(address)
                different = {term: kind for term, kind in hits}
                strict_terms = sum(kind == "strict" for kind in different.values())
                soft_terms = len(different) - strict_terms
                weight = STRICT * strict_terms + SOFT * soft_terms
                verdict = rule[1] if rule else "block" if weight >= LIMIT else "allow"
                strict_hits = sum(kind == "strict" for _, kind in hits)
                out.append(
                    (host, path, rule[0] if rule else None, verdict, strict_hits, len(hits) - strict_hits)
                    + (strict_terms, soft_terms, weight)
                )
            names = [part.split()[0] for part in COLUMNS.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "key", batch["key"].to_numpy())
            yield frame

    judged_rows = rows.mapInPandas(judged, f"key {kind}, {COLUMNS}")
    return judged_rows.withColumnRenamed("key", key)


def oracle(rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS) -> str:
    """DuckDB SQL for the query over ``pages``: every rule and term is tried on its own."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def values(rows):
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

    terms = [(t, "strict") for t in strict] + [(t, "soft") for t in soft if t not in strict]
    return f"""
    WITH rules(verdict, host, path) AS (VALUES {values(rules)}),
    terms(term, kind) AS (VALUES {values(terms)}),
    split AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
    parts AS (SELECT page_id, low,
        translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM split),
    fitting AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC,
          r.verdict DESC) AS place
        FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)),
    hits AS (SELECT page_id, kind,
        (SELECT count(*) FROM generate_series(1, length(low)) AS s(pos)
          WHERE substr(low, pos, length(term)) = term AND NOT regexp_matches(substr(' ' || low, pos, 1), '[a-z0-9]')
          AND NOT regexp_matches(substr(low || ' ', pos + length(term), 1), '[a-z0-9]')) AS n
        FROM parts JOIN terms ON contains(low, term)),
    counts AS (SELECT page_id, sum(n) FILTER (kind = 'strict') AS strict_hits, sum(n) FILTER (kind = 'soft') AS soft_hits,
        count(*) FILTER (kind = 'strict' AND n > 0) AS strict_terms,
        count(*) FILTER (kind = 'soft' AND n > 0) AS soft_terms FROM hits GROUP BY page_id)
    SELECT p.page_id, p.host, p.path, f.rule,
      coalesce(f.verdict, CASE WHEN {STRICT} * coalesce(c.strict_terms, 0) + {SOFT} * coalesce(c.soft_terms, 0) >= {LIMIT}
        THEN 'block' ELSE 'allow' END) AS verdict,
      coalesce(c.strict_hits, 0)::BIGINT AS strict_hits, coalesce(c.soft_hits, 0)::BIGINT AS soft_hits,
      coalesce(c.strict_terms, 0) AS strict_terms, coalesce(c.soft_terms, 0) AS soft_terms,
      {STRICT} * coalesce(c.strict_terms, 0) + {SOFT} * coalesce(c.soft_terms, 0) AS weight
    FROM parts p LEFT JOIN (FROM fitting WHERE place = 1) f USING (page_id) LEFT JOIN counts c USING (page_id)
    """
