"""URL filters: weighted vocabulary on top of host and path rules.

An Aho-Corasick automaton counts strict and soft terms in the lower-cased url; a hit counts where no ASCII
letter or digit touches it. A term of weight 1 or more is strict and rejects the url alone; the weights of the
distinct soft terms that hit are added, and a sum of 1 or more rejects it: two at the default weight. The vocabulary
is a parameter, from a list or a table of (term, weight); the default one is short. Rules come first: a rule fits its
host and all subdomains where the path begins as the rule's, the longest wins, and of equal ones the first given.

Null urls and urls without ``://`` have an empty host and path, no rule, and are judged by their terms (null:
allowed). A url of any length is one string in memory, read in linear time. Repeated rows give a row each; an empty
table gives an empty result; columns besides page_id and url, whatever their names, are left out. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes

STRICT_TERMS = ("adult", "porn", "xxx", "casino", "viagra", "escort", "malware", "phishing", "warez")
SOFT_TERMS = ("free", "bets", "bet", "cheap", "pills", "spam", "farm", "win", "ads", "track", "loan", "crypto", "bonus", "pharma", "hot", "deals")
#: Weights of the default terms, and the sum that rejects a url.
STRICT_WEIGHT, SOFT_WEIGHT, REJECTED = 1.0, 0.5, 1.0
#: Terms that a vocabulary table may have; it is read by every worker.
MOST_TERMS = 200_000
DEFAULT = tuple((t, STRICT_WEIGHT) for t in STRICT_TERMS) + tuple((t, SOFT_WEIGHT) for t in SOFT_TERMS)
#: (host, path, verdict) of the query's contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split(url: bytes) -> tuple[bytes, bytes]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    end = min((i for i in (rest.find(c) for c in (b"/", b"?", b"#")) if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in (b"?", b"#")) if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


class Vocabulary:
    """The automaton over weighted terms, and the decision by them; of a term's several weights the greatest holds."""

    def __init__(self, terms: Sequence[tuple[str, float]] = DEFAULT) -> None:
        self.weight: dict[str, float] = {}
        for term, weight in terms:
            low = term.encode().translate(_LOWER).decode("latin-1")
            if low:
                self.weight[low] = max(weight, self.weight.get(low, weight))
        self.automaton = ahocorasick.Automaton()
        for term in self.weight:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def counts(self, url: bytes) -> tuple[int, int, float]:
        """Strict hits, distinct soft terms, and the sum of these terms' weights."""
        text = url.translate(_LOWER).decode("latin-1")
        strict, soft = 0, set()
        for last, term in self.automaton.iter(text) if self.weight else ():
            first = last - len(term) + 1
            if (first and text[first - 1] in _WORD) or (last + 1 < len(text) and text[last + 1] in _WORD):
                continue
            if self.weight[term] >= REJECTED:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft), sum(self.weight[t] for t in sorted(soft))

    def rejects(self, url: bytes) -> bool:
        strict, _, weight = self.counts(url)
        return strict > 0 or weight >= REJECTED


def vocabulary_of(table: DataFrame, most: int = MOST_TERMS) -> list[tuple[str, float]]:
    """The terms of a table (term, weight); null terms and weights are left out, more than ``most`` rows are an error."""
    rows = table.where("term IS NOT NULL AND weight IS NOT NULL").select("term", F.col("weight").cast("double").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has over {most} terms")
    return sorted((r.term, r.weight) for r in rows)


class HostRules:
    """Rules by host and then path; a lookup tries a host's suffixes, so its cost doesn't grow with the rules."""

    def __init__(self, rules: Sequence[tuple[str, str, str]] = RULES) -> None:
        self.by_host: dict[bytes, list[tuple[bytes, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.encode(), []).append((path.encode(), host + path, verdict))

    def find(self, host: bytes, path: bytes) -> tuple[str, str] | None:
        best = None
        labels = host.split(b".")
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(b".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


class _Judged:
    def __init__(self, terms: Sequence[tuple[str, float]], rules: Sequence[tuple[str, str, str]]) -> None:
        self.terms, self.rules = terms, rules

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_host = Vocabulary(self.terms), HostRules(self.rules)
        for b in batches:
            out = []
            for url in as_bytes(b.column(1)):
                host, path = split(url)
                found = by_host.find(host, path)
                strict, soft, weight = words.counts(url)
                verdict = found[1] if found else "block" if strict or weight >= REJECTED else "allow"
                out.append((host.decode(errors="replace"), path.decode(errors="replace"), found[0] if found else None, verdict, strict, soft, weight))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()], strict=True))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"],
            )


def judge(pages: DataFrame, terms: Sequence[tuple[str, float]] = DEFAULT, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms and soft_weight of each row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(
        pages.select("page_id", F.col("url").cast("string").alias("url")), _Judged(tuple(terms), tuple(rules)),
        f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_terms long, soft_weight double",
    )


def op3(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _terms(terms: Sequence[str]) -> str:
    return "(^|[^a-z0-9])(" + "|".join(terms) + ")([^a-z0-9]|$)"


def _sql() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [
        (host + path, verdict, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')")
        for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    rule = "CASE " + " ".join(f"WHEN {cond} THEN '{rule}'" for rule, _, cond in fits) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{v}'" for rule, v, _ in fits) + f" ELSE CASE WHEN strict_hits > 0 OR soft_terms * {SOFT_WEIGHT} >= {REJECTED} THEN 'block' ELSE 'allow' END END"
    # A term between two others shares its border with both, so strict hits are counted term by term over doubled borders.
    strict = " + ".join(f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '{_terms((t,))}'))" for t in STRICT_TERMS)
    soft = " + ".join(f"CAST(regexp_matches(low, '{_terms((t,))}') AS BIGINT)" for t in SOFT_TERMS)
    return f"""
WITH cut AS (
  SELECT page_id, {lower} AS low,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, {rule} AS rule, CAST({strict} AS BIGINT) AS strict_hits, CAST({soft} AS BIGINT) AS soft_terms FROM parts
)
SELECT page_id, host, path, rule, {verdict} AS verdict, strict_hits, soft_terms, CAST(soft_terms * {SOFT_WEIGHT} AS DOUBLE) AS soft_weight FROM ruled
"""


ORACLE_SQL = _sql()
