"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

import string

from cairnfield.llm import url_filter


def _op2() -> str:
    vocabulary = url_filter.Vocabulary()
    from cairnfield.llm.queries import URL_RULES

    def hit(term: str) -> str:
        return f"CASE WHEN regexp_matches(lower_url, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') THEN 1 ELSE 0 END"

    strict = " + ".join(hit(t) for t in vocabulary.strict)
    soft = " + ".join(hit(t) for t in vocabulary.soft)
    weight = " + ".join(f"{w!r} * ({hit(t)})" for t, w in (vocabulary.strict | vocabulary.soft).items())
    rules = []
    for action, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        rules.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')", rule, action))
    by_rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in rules) + " END"
    by_action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in rules) + " END"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(translate(url, '{upper}', '{lower}'), '') AS lower_url
  FROM pages),
hits AS (
  SELECT page_id, host, path, {by_rule} AS rule, {by_action} AS by_rule,
    CAST({strict} AS INTEGER) AS n_strict, CAST({soft} AS INTEGER) AS n_soft,
    CAST({weight} AS DOUBLE) AS weight
  FROM parts)
SELECT page_id, host, path, rule,
  coalesce(by_rule, CASE WHEN n_strict >= 1 OR n_soft >= {vocabulary.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft, weight
FROM hits"""


OP3 = r"""
WITH body AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(words) - 4)) AS i, words FROM body WHERE len(words) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 5], ' ') AS w FROM windows),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM keyed) WHERE n >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, body, lines,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM body b LEFT JOIN covered c ON b.doc_id = c.doc_id),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
     OR 2 * n_dup_lines > len(lines)
     OR 2 * length(regexp_replace(body, '[^\p{Lu}]+', '', 'g')) > word_chars
     OR 10 * len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) > 3 * len(lines)
     OR 10 * len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[•*-] '))) > 9 * len(lines)) AS fails
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT fails) AS kept
FROM judged"""


#: crc32 of a text's bytes: ``crc_table`` has the 256 steps of a byte, ``crc(x)`` folds them.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS steps)"""


def crc(text: str) -> str:
    """SQL for the unsigned crc32 of ``text``, where ``steps`` is at hand."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


OP11 = """
WITH rows AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS NOT FALSE),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) <= 10"""


def _op12() -> str:
    from cairnfield.llm import sharding
    from cairnfield.llm.queries import GROWN, SHARDS

    def place(shards: int, out: str) -> str:
        """Shards by three levels of least draws; the tree is a list of rows."""
        leaves = sharding.planned(shards)
        weights: dict[str, float] = {}
        for x in leaves:
            for node in (x.region, f"{x.region}/{x.rack}"):
                weights[node] = weights.get(node, 0.0) + x.weight
        rows = sorted({(1, "", x.region, weights[x.region], -1) for x in leaves})
        rows += sorted({(2, x.region, f"{x.region}/{x.rack}", weights[f"{x.region}/{x.rack}"], -1) for x in leaves})
        rows += [(3, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}", x.weight, x.shard) for x in leaves]
        values = ", ".join(repr(r) for r in rows)
        draw = f"-ln(CAST(concat('0x', substr(md5(concat(t.name, ':', k.name)), 1, 8)) AS BIGINT) / 4294967296.0 + {sharding.HALF!r}) / t.weight"

        def level(n: int, above: str, parent: str) -> str:
            return f"""{out}_{n} AS (
  SELECT k.name, arg_min(t.name, {draw}) AS node, arg_min(t.shard, {draw}) AS shard
  FROM {above} k JOIN {out}_tree t ON t.level = {n} AND t.parent = {parent} GROUP BY k.name)"""

        return f"""{out}_tree(level, parent, name, weight, shard) AS (VALUES {values}),
{level(1, "names", "''")},
{level(2, f"{out}_1", "k.node")},
{level(3, f"{out}_2", "k.node")}"""

    return f"""
WITH {CRC_TABLE},
rows AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
    CAST(octet_length(encode(coalesce(text, ''))) + {sharding.ROW_BYTES} AS BIGINT) AS size,
    CAST({crc("coalesce(text, '')")} AS BIGINT) AS text_crc32
  FROM documents, crc_table),
names AS (SELECT DISTINCT name FROM rows),
{place(SHARDS, "now")},
{place(GROWN, "later")},
parts AS (
  SELECT r.*, {crc("concat(name, ':', text_crc32)")} % {sharding.SLICES} AS part FROM rows r, crc_table)
SELECT p.doc_id, size, text_crc32, 'key' AS law, CAST(n.shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY n.shard ORDER BY part, p.doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(l.shard AS INTEGER) AS grown_shard
FROM parts p JOIN now_3 n ON n.name = p.name JOIN later_3 l ON l.name = p.name"""


def _op13() -> str:
    from cairnfield.llm import spelling

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[{spelling.LETTERS}]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, n, {crc("concat(id, ':', run)")} AS h FROM counted, crc_table),
lost AS (
  SELECT n, CASE WHEN h % {spelling.DROP_ONE_IN} = 0
    THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= {spelling.LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_N}),
cuts AS (
  SELECT word, i, concat(substring(word, 1, i), substring(word, i + 2)) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.rest FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT c.rest, c.word FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (
  SELECT p.word, p.other, w.n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS r,
    count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON w.word = p.other),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.n >= {spelling.COMMONER} * w.n THEN r.other END AS form,
    CASE WHEN r.n >= {spelling.COMMONER} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (
  SELECT word, word AS root FROM formed
  UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed g ON g.word = c.root AND g.form IS NULL"""


def sql() -> dict[str, str]:
    return {"op2_url_filter": _op2(), "op3_quality_rules": OP3, "op11_dual_tree": OP11, "op12_hash_tree": _op12(), "op13_errata_trie": _op13()}
