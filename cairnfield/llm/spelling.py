"""Spelling variants: words that one edit turns into a far commoner word, found by errata-trie merging.

The trie of all words is cut into heavy paths: from each node the edge into the largest subtree
(ties: the smaller character) is heavy, the others are light. A word has no more light edges than
the logarithm of the number of words. An errata trie at a node is its light subtrees merged, the
small ones into the large one, after their first character is skipped or replaced; where terminals
of merged subtrees coincide, their words are one edit apart. As tables, a subtree's terminals are
the rows (what stands before the edge, what stands behind it), and merging is a join of them:

* skipped: a light edge is left out, and the rest must be a word;
* put in: the heavy character is put before a light edge, or behind the last character;
* replaced, against the large one: a light edge becomes the heavy one, and that must be a word;
* replaced, among the light ones: light edges of one node with the same rest are one group.

Of two words one edit apart, exactly one of these finds the pair, once: at the node where they
part, one of the two edges at least is light, and of a run of equal characters the last counts as the
one that is skipped. So near words are counted without sorting out repeats, and a table of words makes
rows in the order of words times the logarithm of their number.

Defined cases: null texts have no words; a row without an id is written with an empty id; repeated
rows count each time; ties of n go to the smaller word in code-point order; an empty table gives no rows;
extra columns are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import ascii_lower, written

#: Letters of a word, and the share of occurrences that lose a code point.
LETTERS, DROP_ONE_IN = "A-Za-zÀ-ÿ", 199
#: Least code points and occurrences of a word; how many times commoner a form is.
LEAST_LENGTH, LEAST_N, COMMONER = 6, 5, 5
#: Nodes this deep at most come as a broadcast: the 90 letters that are left after lower-casing make 8,190 of them.
SHALLOW = 2
#: Stands for the replaced character; no letter.
ANY = "*"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = LEAST_LENGTH, least: int = LEAST_N) -> DataFrame:
    """(word, n): every word of enough code points that occurs often enough, after the planned losses."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    each = docs.select(name.alias("id"), F.explode(found).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = each.withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    lost = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, lost).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _before(i: Column) -> Column:
    return F.col("word").substr(F.lit(1), i)


def _behind(i: Column) -> Column:
    """What follows the character at ``i``, from 0."""
    return F.col("word").substr(i + 2, F.char_length("word"))


def light_edges(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, i, heavy): every light edge of every word, its place from 0 and the heavy character there;
    and (node, heavy): the heavy character below each node."""
    i = F.col("i")
    edges = vocabulary.select("word", "n", F.posexplode(F.sequence(F.lit(1), F.char_length("word"))).alias("i", "depth"))
    edges = edges.select("word", "n", "i", _before(F.col("depth")).alias("node"))
    size = edges.groupBy("node").agg(F.count("*").alias("size"))
    depth = F.char_length("node")
    sized = written(size.select("node", F.col("node").substr(F.lit(1), depth - 1).alias("parent"), F.col("node").substr(depth, F.lit(1)).alias("first"), "size"), "trie")
    heavy = sized.groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("size"), "first"))["first"].alias("heavy"), F.count("*").alias("children"))
    shallow, deep = F.char_length("node") <= SHALLOW, F.char_length("node") > SHALLOW
    light = sized.join(heavy.where("children > 1"), "parent").where("first <> heavy").select("node", "heavy")
    found = edges.where(i < SHALLOW).join(F.broadcast(light.where(shallow)), "node").union(edges.where(i >= SHALLOW).join(light.where(deep), "node"))
    return found.select("word", "n", "i", "heavy"), heavy.select(F.col("parent").alias("node"), "heavy")


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of words one edit away, and (n, form) of the commonest of them.

    ``vocabulary`` is (word, n) with different words; it is read several times. Words without near ones have no row.
    """
    light, heavy = light_edges(vocabulary)
    light = written(light, "light")
    i = F.col("i")
    alone = (i + 1 == F.char_length("word")) | (F.col("word").substr(i + 1, F.lit(1)) != F.col("word").substr(i + 2, F.lit(1)))
    probes = F.array(
        F.when(alone, F.concat(_before(i), _behind(i))),
        F.concat(_before(i), "heavy", _behind(i)),
        F.concat(_before(i), "heavy", _behind(i - 1)),
    )
    longer = vocabulary.join(heavy, F.col("word") == F.col("node")).select("word", "n", F.concat("word", "heavy").alias("probe"))
    probed = light.select("word", "n", F.explode(probes).alias("probe")).where("probe IS NOT NULL").union(longer)
    met = probed.join(vocabulary.select(F.col("word").alias("probe"), F.col("n").alias("other_n")), "probe")
    ends = [("word", "probe", "other_n"), ("probe", "word", "n")]
    both = F.array(*[F.struct(F.col(a).alias("word"), F.struct((-F.col(m)).alias("n"), F.col(b).alias("form")).alias("best")) for a, b, m in ends])
    pairs = met.select(F.explode(both).alias("p")).select("p.word", F.lit(1).cast("long").alias("k"), "p.best")

    # a group has at most one word for each letter of the alphabet
    member = F.struct((-F.col("n")).alias("n"), F.col("word").alias("form"))
    groups = light.groupBy(F.concat(_before(i), F.lit(ANY), _behind(i)).alias("rest")).agg(F.sort_array(F.collect_list(member)).alias("all"))
    merged = groups.where(F.size("all") > 1).select("all", F.explode("all").alias("own"))
    first, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    best = F.when(first["form"] == F.col("own.form"), second).otherwise(first)
    among = merged.select(F.col("own.form").alias("word"), (F.size("all") - 1).cast("long").alias("k"), best.alias("best"))

    found = pairs.union(among).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.form").alias("form")).alias("best"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): the last form that (word, form) leads to, over chains of at most 2 ** rounds steps."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variants(vocabulary: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its commonest near word, if that is ``commoner`` times as common; forms
    of forms are ever commoner, so a chain has no more steps than the greatest n has powers.
    """
    top = vocabulary.agg(F.max("n")).first()[0] or 1
    steps, n = 1, 1
    while n * commoner <= top:
        steps, n = steps + 1, n * commoner
    found = near(vocabulary).select(F.col("word").alias("of"), "n_near", "best")
    joined = vocabulary.join(found, F.col("word") == F.col("of"), "left")
    formed = F.col("best.n") >= F.lit(commoner) * F.col("n")
    judged = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")),
        "forms",
    )
    last = roots(judged.where("form IS NOT NULL"), ceil(log2(steps)) if steps > 1 else 0).withColumnRenamed("word", "of")
    return judged.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spelling variants among the words of ``docs``."""
    return variants(written(words(docs, key, text), "words"))
