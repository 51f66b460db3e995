"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from urbanweave.llm import licenses, secret_ledger

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_ascii, len(regexp_replace(text, '[^!-@\[-`{-~]', '', 'g')) AS n_others
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > n_ascii OR 10 * n_others > 4 * word_chars) AS kept
FROM m
"""

ORACLES["op9_decontamination"] = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), items AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sizes AS (
  SELECT DISTINCT n FROM items
), grams AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN items ON g.n = items.n AND g.w = items.w
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_spans(table: str = "documents") -> str:
    """Statement of all spans of a table: doc_id, place, kind, s, e."""
    parts = []
    for place, rule in enumerate(secret_ledger.RULES):
        pattern = _quoted(rule.pattern)
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, s, s + len(hit) AS e
  FROM (
    SELECT doc_id, hits[i] AS hit, judged[i] AS part,
           list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS s
    FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS hits, regexp_extract_all(text, {pattern}, {rule.group}) AS judged,
                   string_split_regex(text, {pattern}) AS gaps FROM {table} WHERE regexp_matches(text, {pattern}))
    )
  )
  WHERE len(part) >= {rule.shortest}""")
    return "\n  UNION ALL".join(parts)


_BASE = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE_RULES)
_KINDS = ", ".join(f"'{r.kind}'" for r in secret_ledger.BASE_RULES)
_SPAN = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place)"
ORACLES["op2_secret_ledger"] = f"""
WITH spans AS ({secret_spans()}
), found AS (
  SELECT doc_id, {_BASE}, {_SPAN} FILTER (kind IN ({_KINDS})) AS base, {_SPAN} AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_ledger.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def _license_places(rules: str, label: str) -> str:
    """Statement of the places of the patterns of ``rules``: doc_id, label, priority, s, e in words."""
    return f"""
  SELECT doc_id, {label} AS label, priority, s // 2 AS s, (s + spaces) // 2 AS e
  FROM (
    SELECT doc_id, label, priority, len(hits[i]) - len(replace(hits[i], ' ', '')) AS spaces,
           list_sum(list_transform(gaps[1:i], lambda x: len(x) - len(replace(x, ' ', ''))))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x) - len(replace(x, ' ', '')))), 0) AS s
    FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, label, priority, regexp_extract_all(norm, pattern) AS hits, string_split_regex(norm, pattern) AS gaps
            FROM norms, ({rules}) WHERE contains(norm, keyword))
    )
  )"""


_RULES = "VALUES " + ", ".join(
    f"({_quoted(r.label)}, {_quoted(f' {r.keyword} ')}, {_quoted(r.pattern)}, {r.priority})" for r in licenses.signatures()
)
_PHRASES = "VALUES " + ", ".join(
    f"({_quoted(label)}, {_quoted(licenses.words(phrase))}, {_quoted(licenses.words(phrase))}, {licenses.BARE})" for phrase, label in licenses.BASE
)
_COLUMNS = "(label, keyword, pattern, priority)"
ORACLES["op5_licenses"] = f"""
WITH norms AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN '' ELSE ' ' || array_to_string(ws, '  ') || ' ' END AS norm, len(ws) AS n_words
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents)
), base AS ({_license_places(f"SELECT * FROM ({_PHRASES}) r{_COLUMNS}", "label")}
), found AS ({_license_places(f"SELECT * FROM ({_RULES}) r{_COLUMNS}", "label")}
), ranked AS (
  SELECT DISTINCT doc_id, label, priority, s, e FROM found
), kept AS (
  SELECT * FROM ranked a WHERE NOT EXISTS (
    SELECT 1 FROM ranked b WHERE a.doc_id = b.doc_id AND b.priority >= a.priority AND b.s <= a.s AND b.e >= a.e
      AND (b.s < a.s OR b.e > a.e OR b.priority > a.priority OR b.label < a.label))
), b AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) / {float(licenses.PRIORITIES)} AS score
  FROM (SELECT doc_id, label, priority FROM kept UNION ALL SELECT doc_id, label, priority FROM base) GROUP BY doc_id
)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM norms n LEFT JOIN b ON n.doc_id = b.doc_id LEFT JOIN l ON n.doc_id = l.doc_id
"""

ORACLES["op8_parity_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), reached AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reached.doc_id, l.b FROM reached JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reached.r
)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

ORACLES["op11_collocations"] = r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)
), f AS MATERIALIZED (
  SELECT lang, size, ws[i:i + size - 1] AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM piece, (VALUES (1), (2), (3)) s(size) WHERE len(ws) >= size)
  GROUP BY ALL
), cand AS MATERIALIZED (
  SELECT * FROM f WHERE size > 1 AND f >= 10
), cut AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, x.f AS l, y.f AS r, k, 1000000 * c.f * c.f // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (SELECT lang, unnest([phrase[1:2], phrase[2:3]]) AS part, f FROM cand WHERE size = 3) GROUP BY lang, part
), kept AS (
  SELECT b.*, array_to_string(b.phrase, ' ') AS joined FROM best b LEFT JOIN longer ON longer.lang = b.lang AND longer.part = b.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * b.a
), words AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, joined) AS rank, joined AS phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept k JOIN words ON words.lang = k.lang QUALIFY rank <= 2000
"""

# The checksum byte by byte, from the table of its polynomial; two-byte letters begin with 195.
ORACLES["op12_spelling"] = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t
), run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM run, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION
  SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), led AS MATERIALIZED (
  SELECT v.word, best.form, best.form_n FROM v JOIN best ON v.word = best.word WHERE form_n >= 5 * v.n
), path AS (
  SELECT word, word AS root FROM v
  UNION
  SELECT path.word, led.form FROM path JOIN led ON led.word = path.root
)
SELECT v.word, led.form, path.root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, led.form_n::BIGINT AS form_n
FROM v LEFT JOIN best ON best.word = v.word LEFT JOIN led ON led.word = v.word
JOIN path ON path.word = v.word WHERE path.root NOT IN (SELECT word FROM led)
"""
