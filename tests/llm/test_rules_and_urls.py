from collections import Counter

import pytest

from cairnfield.llm import quality_rules, url_filter
from cairnfield.llm.queries import URL_RULES


def _measure(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark, odd_docs):
    got = quality_rules.judge(odd_docs.selectExpr("*", "'old' AS kept", "'old' AS __words", "1 AS base_failed")).collect()
    assert len(got) == 12
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _measure(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rule_order_never_changes_results(spark, odd_docs):
    rules = quality_rules.default_rules()
    a = quality_rules.judge(odd_docs, rules=rules, ordered=True).select("doc_id", "kept").collect()
    b = quality_rules.judge(odd_docs, rules=rules[::-1], ordered=True).select("doc_id", "kept").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_order_asks_the_strict_rule_first(spark):
    from pyspark.sql import functions as F

    docs = spark.range(400).select(F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"))
    rules = [quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("always", F.col("n_words") >= 0)]
    assert [r.name for r in quality_rules.order_rules(docs, rules)][0] == "always"


def test_rules_on_an_empty_table(no_docs):
    assert quality_rules.judge(no_docs).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://Blog.EXAMPLE.org/es/12?x=1", "blog.example.org", "/es/12", "example.org/es/", "block"),
        (2, "http://example.org/en/17#top", "example.org", "/en/17", "example.org/en/1", "block"),
        (3, "http://example.org/en/27", "example.org", "/en/27", "org/", "allow"),
        (4, "http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        (5, "http://a.com/fr/casino", "a.com", "/fr/casino", "com/fr/", "allow"),
        (6, "http://casino-win.net/en", "casino-win.net", "/en", None, "block"),
        (7, "http://free-bets.net/en", "free-bets.net", "/en", None, "block"),
        (8, "http://freebets.net/casinos", "freebets.net", "/casinos", None, "allow"),
        (9, "http://free.net/free/free", "free.net", "/free/free", None, "allow"),
        (10, None, "", "", None, "allow"),
        (11, "no scheme casino", "", "", None, "block"),
        (12, "http://notorg/x", "notorg", "/x", None, "allow"),
        (13, "http://x.org", "x.org", "", None, "allow"),
        (14, "http://İCASİNO.net/xxx", "İcasİno.net", "/xxx", None, "block"),
        (14, "http://İCASİNO.net/xxx", "İcasİno.net", "/xxx", None, "block"),
        (15, "", "", "", None, "allow"),
        (16, "http://long.net/" + "a/" * 50_000 + "casino", "long.net", "/" + "a/" * 50_000 + "casino", None, "block"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u, *_ in rows], "page_id long, url string, host string")
    got = url_filter.filter_urls(df, rules=URL_RULES).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_a_vocabulary_may_be_empty(spark):
    df = spark.createDataFrame([(1, "http://casino.net")], "page_id long, url string")
    assert url_filter.filter_urls(df, vocabulary=url_filter.Vocabulary({})).first().verdict == "allow"


def test_a_vocabulary_from_a_table(spark):
    rows = [("Bad", 5.0), ("bad", 1.0), ("so", 1.0), ("mild", 2.9), ("", 9.0), (None, 9.0), ("none", None)]
    found = url_filter.read_vocabulary(spark.createDataFrame(rows, "term string, weight double"), soft_limit=2)
    assert found.strict == {"bad": 5.0} and found.soft == {"so": 1.0, "mild": 2.9}
    df = spark.createDataFrame([(1, "http://bad.net"), (2, "http://so.net/mild"), (3, "http://so.net/so"), (4, "http://none.net")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, vocabulary=found).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(spark.createDataFrame([(c, 1.0) for c in "abc"], "term string, weight double"))


def test_of_equal_rules_the_first_decides(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    for rules in ([("allow", "net/x"), ("block", "a.net")], [("block", "net/x"), ("allow", "a.net")]):
        assert url_filter.filter_urls(df, rules=rules).first().verdict == rules[0][0]
