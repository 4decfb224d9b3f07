"""URL filter: host rules first, then a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton finds every term of the vocabulary in the lower-cased url in one
pass. A hit counts only with a boundary on both sides: the neighbouring character is no ASCII
letter or digit. A term's weight says how strict it is: from ``strict_from`` on it rejects a url
on its own, below that it is soft, and ``soft_limit`` *different* soft terms reject one.

Defined results: a null url has no hits and is allowed; an empty one likewise; a url without
``://`` has an empty host and path and no rule, but its terms count. Of two rules of equal length
that fit, the one that was given first decides. Repeated rows are each judged. Other columns of the input are untouched
unless they have the name of a result column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import ascii_lower, ship

#: Default terms and their weights.
TERMS = {
    "porn": 4.0, "xxx": 4.0, "casino": 3.0, "spam": 3.0, "malware": 4.0, "phishing": 4.0, "warez": 3.0, "escort": 3.0,
    "free": 0.5, "cheap": 1.0, "win": 0.5, "bets": 1.0, "bet": 1.0, "pills": 1.5, "farm": 0.5, "bonus": 1.0, "poker": 1.5,
    "loan": 1.0, "deals": 0.5, "click": 0.5, "hot": 0.5, "adult": 1.5, "dating": 1.0, "crack": 1.0, "torrent": 1.0,
    "viagra": 2.0, "replica": 1.0, "jackpot": 1.5,
}
#: Most terms that are read from a table: an automaton is built in each worker.
MOST_TERMS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    terms: dict[str, float] = field(default_factory=lambda: dict(TERMS))
    strict_from: float = 3.0
    soft_limit: int = 2

    @property
    def strict(self) -> dict[str, float]:
        return {t: w for t, w in self.terms.items() if w >= self.strict_from}

    @property
    def soft(self) -> dict[str, float]:
        return {t: w for t, w in self.terms.items() if w < self.strict_from}

    def key(self) -> tuple:
        return tuple(sorted(self.strict.items())), tuple(sorted(self.soft.items()))


def read_vocabulary(terms: DataFrame, strict_from: float = 3.0, soft_limit: int = 2) -> Vocabulary:
    """A vocabulary from a table of (term, weight): lower-cased, the greatest weight of each term.

    Null and empty terms and null weights are left out; more than MOST_TERMS are an error.
    """
    rows = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("double").alias("weight"))
    rows = rows.where("term <> '' AND weight IS NOT NULL").groupBy("term").agg(F.max("weight").alias("weight"))
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return Vocabulary({r["term"]: r["weight"] for r in found}, strict_from, soft_limit)


@lru_cache(maxsize=4)
def _automaton(key: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for strict, terms in ((False, key[1]), (True, key[0])):  # a term of both kinds is strict
        for term, weight in terms:
            found.add_word(term, (term, strict, weight))
    if len(found):
        found.make_automaton()
    return found


def _edge(text: str, at: int) -> bool:
    return not 0 <= at < len(text) or not (text[at].isascii() and text[at].isalnum())


def count_terms(text: str | None, automaton) -> tuple[int, int, float]:
    """Different strict terms, different soft terms, and the sum of their weights, of a lower-cased url."""
    if not text or not len(automaton):
        return 0, 0, 0.0
    hits = {hit for end, hit in automaton.iter(text) if _edge(text, end + 1) and _edge(text, end - len(hit[0]))}
    strict = sum(hit[1] for hit in hits)
    return strict, len(hits) - strict, float(sum(sorted(hit[2] for hit in hits)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host and path) that fits, and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the longest is asked first
        of, slash, below = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + below)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def filter_urls(
    pages: DataFrame, url: str = "url", vocabulary: Vocabulary | None = None, rules: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft, weight and verdict (allow or block) to each row."""
    vocabulary = vocabulary or Vocabulary()
    key = vocabulary.key()
    ship(pages.sparkSession)

    @F.pandas_udf("n_strict int, n_soft int, weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key)
        for urls in batches:
            counted = [count_terms(u, automaton) for u in urls]
            yield pd.DataFrame(counted, columns=["n_strict", "n_soft", "weight"])

    address = F.col(f"`{url}`")
    rows = pages.withColumns({"host": host_of(address), "path": path_of(address), "__hits": hits(ascii_lower(address))})
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("__hits.n_strict") >= 1) | (F.col("__hits.n_soft") >= vocabulary.soft_limit)
    judged = rows.withColumns(
        {
            "rule": rule,
            "n_strict": F.col("__hits.n_strict"),
            "n_soft": F.col("__hits.n_soft"),
            "weight": F.col("__hits.weight"),
            "verdict": F.coalesce(action, F.when(bad, "block").otherwise("allow")),
        }
    )
    return judged.drop("__hits")
