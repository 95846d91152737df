"""DuckDB statements for the numbered operators' queries that SQL can express.

The others learn a model, place rows by a hash that DuckDB lacks, use a
tokenizer or write sketches; tests hold them against brute force.
"""

from __future__ import annotations

from .licenses import CONTAINMENT, SHINGLE, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"regexp_extract_all({text}, {pattern})"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words('text', SPACED, True)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
       least(w.doc_id, coalesce(min(reach.other), w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(min(reach.other), w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id
GROUP BY w.doc_id
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         role AS r0, text AS t0 FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant',
                    '</s>[INST] ok [/INST]')),
seen AS (
  SELECT *, row_number() OVER o AS k, lag(role, 1, '') OVER o AS before,
         length(regexp_replace(text, '([\\<>\[])', '\\\1', 'g')) AS chars,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 9
           ELSE 18 + length(regexp_replace(role, '([\\<>\[])', '\\\1', 'g')) END AS marks
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST,
                         t0 NULLS FIRST))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(chars + marks)::BIGINT AS formatted_chars,
       bool_and(before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant',
                                          'assistant>user'))
         AND arg_max(role, k) IN ('user', 'assistant') AS valid
FROM seen GROUP BY conv_id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_words('text', SPACED, False)} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM windows)
  WHERE (doc_id, i) <> first),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS t(j)),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

CONTAMINATION = f"""
WITH w AS (SELECT doc_id, {_words('text', ALNUM, True)} AS ws FROM documents),
item AS (
  SELECT item_id, ws, least(10, len(ws)) AS n
  FROM (SELECT item_id, {_words('text', ALNUM, True)} AS ws FROM benchmark) WHERE len(ws) > 0),
phrase AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM item, unnest(range(1, len(ws) - n + 2)) AS t(i)),
windows AS (
  SELECT doc_id, s.n, i, array_to_string(ws[i:i + s.n - 1], ' ') AS k
  FROM w, (SELECT DISTINCT n FROM phrase) s, unnest(range(1, len(ws) - s.n + 2)) AS t(i)
  WHERE len(ws) >= s.n),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrase USING (n, k)),
hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS t(j)
  GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSES = f"""
WITH template(template, license, text) AS (VALUES {', '.join(
    f'({i}, {_literal(name)}, {_literal(text)})' for i, (name, text) in enumerate(TEMPLATES))}),
t AS (SELECT template, license, {_words('text', ALNUM, True)} AS ws FROM template),
part AS (
  SELECT DISTINCT template, license, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM t, unnest(range(1, len(ws) - {SHINGLE - 2})) AS r(i) WHERE len(ws) >= {SHINGLE}),
size AS (SELECT template, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT doc_id, {_words('text', ALNUM, True)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM w, unnest(range(1, len(ws) - {SHINGLE - 2})) AS r(i) WHERE len(ws) >= {SHINGLE}),
shared AS (
  SELECT doc_id, template, license, count(*) AS c FROM s JOIN part USING (g) GROUP BY ALL)
SELECT doc_id, license, max(c / n) AS containment
FROM shared JOIN size USING (template) GROUP BY ALL HAVING max(c / n) >= {CONTAINMENT}
"""

COLLOCATIONS = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
s AS (
  SELECT lang, word AS w1, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM s WHERE w3 IS NOT NULL
  GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
halves AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head,
         array_to_string(ws[j + 1:], ' ') AS tail
  FROM c, unnest(range(1, k)) AS u(j)),
cut AS (
  SELECT halves.lang, halves.phrase, a, j, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM halves LEFT JOIN f x ON x.lang = halves.lang AND x.phrase = head
  LEFT JOIN f y ON y.lang = halves.lang AND y.phrase = tail),
least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS pick FROM cut),
longer AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most
  FROM c, unnest([1, 2]) AS u(i) WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score,
         row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, x.phrase) AS rank
  FROM least x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE pick = 1 AND (y.most IS NULL OR 100 * y.most < 50 * x.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS id, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.id AS anchor, a.vec_id AS anchor_id, b.id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.id
                          ORDER BY n.score DESC, n.vec_id, n.id)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor = p.anchor AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES = {"op1_neardup": NEAR_DUPLICATES, "op3_chat": CHAT, "op5_substrings": SUBSTRINGS,
           "op6_decontaminate": CONTAMINATION, "op7_licenses": LICENSES,
           "op11_collocations": COLLOCATIONS, "op13_hard_negatives": HARD_NEGATIVES}
