"""SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

import string

from .quality_rules import RepetitionRules
from .spelling import Settings

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Ends in ``crc``, whose list ``t`` is the table of crc32.
_CRC_TABLE = """WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),"""

_SHARDS = f"""{_CRC_TABLE}
d AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents, crc),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, size, text_crc32) - 0.5::DOUBLE) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM r),
s AS (SELECT *, (24 * (p + 1) - 1) // n AS s FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard, CAST(p - (s * n) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM s
"""

_SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
s AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS s FROM i),
x AS (SELECT k, i FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
g AS (SELECT k, list(DISTINCT p) AS gone FROM (SELECT k, unnest(range(i, i + 35)) AS p FROM x) GROUP BY k),
e AS (SELECT d.k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.k, string_agg(word, ' ' ORDER BY e.p) AS text FROM e LEFT JOIN (SELECT k, unnest(gone) AS p FROM g) q ON q.k = e.k AND q.p = e.p WHERE q.p IS NULL GROUP BY e.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.k = d.k LEFT JOIN kept ON kept.k = d.k
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, (SELECT min(b) FROM c WHERE c.a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM c WHERE c.a = vec_id) AS kept FROM embeddings
"""


def _rules(rules: RepetitionRules) -> str:
    sizes = [3, *(n for n, _ in rules.max_ngram_chars_pct)]
    marks = ", ".join(
        f"""m{n} AS (SELECT k, list(DISTINCT p) AS p FROM (SELECT k, unnest(range(i, i + {n})) AS p FROM (
  SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM (SELECT k, i, array_to_string(w[i : i + {n - 1}], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))) WHERE c > 1) GROUP BY k)"""
        for n in sizes
    )
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.k = d.k" for n in sizes)
    cover = ", ".join(f"coalesce(list_sum(list_transform(m{n}.p, lambda q: CAST(length(w[q]) AS BIGINT))), 0)::BIGINT AS c{n}" for n in sizes[1:])
    within = " AND ".join(f"100 * c{n} <= {pct} * word_chars" for n, pct in rules.max_ngram_chars_pct)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
{marks},
lines AS (SELECT k, line, n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT k, line FROM lines QUALIFY row_number() OVER (PARTITION BY k, line ORDER BY n) > 1),
dl AS (SELECT k, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS BIGINT) AS dup_line_chars FROM dup GROUP BY k),
r AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    CAST(coalesce(len(m3.p), 0) AS BIGINT) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {cover}
  FROM d {joins} LEFT JOIN dl ON dl.k = d.k),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words_pct} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {", ".join(f"c{n} AS dup_{n}gram_chars" for n in sizes[1:])}, base_failed,
  NOT base_failed AND {within} AND 100 * dup_line_chars <= {rules.max_dup_line_chars_pct} * word_chars AS kept FROM b
"""


def _spelling(s: Settings) -> str:
    crc = f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""
    return f"""
{_CRC_TABLE}
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{s.letters}]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS c FROM u WHERE length(run) >= {s.min_length} GROUP BY ALL),
h AS (SELECT run, c, {crc} AS h FROM r, crc),
w AS (SELECT CASE WHEN h % {s.thin} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= {s.min_length} GROUP BY word HAVING sum(c) >= {s.min_count}),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS hole FROM i),
d AS (SELECT DISTINCT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS gone FROM i),
e AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM x a JOIN x b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.gone = v.word
  UNION ALL SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.gone = v.word),
b AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM e GROUP BY word, n),
f AS (SELECT word, other AS form, m FROM b WHERE m >= {s.ratio} * n),
p AS (SELECT word, word AS at FROM v UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.at)
SELECT v.word, f.form, p.at AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.m AS form_n
FROM v JOIN p ON p.word = v.word AND p.at NOT IN (SELECT word FROM f) LEFT JOIN b ON b.word = v.word LEFT JOIN f ON f.word = v.word
"""


ORACLE_SQL = {
    "op1_sharding": _SHARDS,
    "op3_substring_dedup": _SUBSTRINGS,
    "op5_embedding_dedup": _EMBEDDINGS,
    "op6_quality_rules": _rules(RepetitionRules()),
    "op12_spelling_variants": _spelling(Settings()),
}
