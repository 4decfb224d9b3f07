"""Quality rules as a short-circuit cascade of native expressions.

A document passes if it passes every rule, so the order of the rules never changes a result,
only its cost. ``order_rules`` measures on a sample how long each rule takes and how much it
rejects, and asks the rule with the most rejections per second first; ``CASE`` then stops at
the first rule that fails. What a rule alone needs (capitals, ends of lines, bullets) is part of
its expression, so it is computed only for the documents that get there; the measures that are
results themselves are computed for all. A cost is the shortest of ``TIMES`` runs over the sample,
less that of a run without a rule; the first run of each, which compiles it, doesn't count.

Everything is a DataFrame expression. Windows of five words are compared by 64-bit hashes
within one text.

Defined results: a null text counts as an empty one; a text without words has zero counts and
fails the base rule. Repeated rows are each judged; the order of rows is of no matter. Texts of any
length are judged whole. Columns with the name of a result (or of one of the helpers ``__body``,
``__words``, ``__lines``, ``__hashed``, ``__windows``, ``__ranked``) are replaced, others stay.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import SEPARATORS

WINDOW = 5
#: Rows of the sample on which costs and rejections are measured, and runs of each rule over it.
SAMPLE_ROWS, TIMES = 1000, 3


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document to be rejected; it may use the columns of ``measured``."""

    name: str
    fails: Column


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _windows(n: Column, hashed: Column) -> Column:
    """A hash of each window of WINDOW words, from the words' hashes."""
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)])
    )


def _repeated_starts(ranked: Column) -> Column:
    """Where the windows that are found twice or more begin, in order; ``ranked`` is sorted by hash."""
    again = F.transform(
        ranked,
        lambda x, k: F.when((x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["i"]),
    )
    return F.array_sort(F.array_compact(again))


def _covered(starts: Column) -> Column:
    """Words in windows that begin at these places."""
    summed = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
        ),
    )
    return summed["n"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words to each row.

    What a lambda looks up (``__hashed``, ``__ranked``) is a column of its own: an expression
    in its place would be computed anew for each element.
    """
    rows = docs.withColumn("__body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = rows.withColumn("__words", words_of(F.col("__body")))
    rows = rows.withColumns(
        {
            "__lines": F.filter(F.split("__body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__hashed": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    rows = rows.withColumn("__windows", _windows(F.size("__words"), F.col("__hashed")))
    ranked = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct("__windows")) == F.size("__windows")
    rows = rows.withColumn("__ranked", F.when(~unique, ranked))
    return rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__body", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_repeat_words": F.coalesce(_covered(_repeated_starts(F.col("__ranked"))), F.lit(0)).cast("long"),
        }
    )


def default_rules() -> list[Rule]:
    n, body = F.col("n_words"), F.col("__body")
    capitals = F.length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))
    ellipsis = F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
    bullets = F.size(F.filter("__lines", lambda x: x.rlike(r"^\s*[•*-] ")))
    return [
        Rule("words_too_short", F.col("word_chars") < 2 * n),
        Rule("words_too_long", F.col("word_chars") > 20 * n),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("capitals", 2 * capitals > F.col("word_chars")),
        Rule("ellipsis_lines", 10 * ellipsis > 3 * F.col("n_lines")),
        Rule("bullet_lines", 10 * bullets > 9 * F.col("n_lines")),
    ]


def base_fails() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS, total: int | None = None) -> list[Rule]:
    """The rules by rejections per second of cost, as measured on a sample of about ``rows`` rows.

    The sample is drawn by row over the whole table, twice ``rows`` at most; it decides the order only.
    """
    total = docs.count() if total is None else total
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    few = docs.select(body.alias("__text")).sample(min(1.0, rows / max(total, 1)), seed=17).limit(2 * rows)
    sample = measured(few, "__text").cache()

    def run(fails: Column) -> tuple[int, float]:
        took = []
        for _ in range(TIMES):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(fails)).first()[0]
            took.append(time.perf_counter() - began)
        return rejected, min(took[1:])

    try:
        seen = max(sample.count(), 1)
        nothing = run(F.col("n_words") < 0)[1]
        found = [run(rule.fails) for rule in rules]
    finally:
        sample.unpersist()
    scored = [(-(rejected / seen) / max(cost - nothing, 1e-4), place) for place, (rejected, cost) in enumerate(found)]
    return [rules[place] for _, place in sorted(scored)]


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, ordered: bool = False) -> DataFrame:
    """Add the measures, base_failed and kept to each row; ``ordered``: the rules come in their order."""
    rules = default_rules() if rules is None else list(rules)
    if not ordered:
        rules = order_rules(docs, rules, text)
    passes = F.when(F.col("base_failed"), False)
    for rule in rules:
        passes = passes.when(rule.fails, False)
    rows = measured(docs, text).withColumn("base_failed", base_fails())
    return rows.withColumn("kept", passes.otherwise(True)).drop("__body", "__words", "__lines", "__hashed", "__windows", "__ranked")
