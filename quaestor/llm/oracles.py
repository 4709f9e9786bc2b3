"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quaestor.llm.licence_templates import TEMPLATES

LINE_DEDUP = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w)
  WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS i FROM later, (SELECT unnest([0, 1, 2]) AS o)
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(d.lines), 0) - CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n, 0) END AS BIGINT) AS n_removed
FROM d LEFT JOIN kept k USING (doc_id)
"""

_SHINGLES = r"""
  SELECT DISTINCT id, concat_ws(' ', w, w1, w2, w3, w4) AS h FROM (
    SELECT id, i, w, len(ws) AS n, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3,
      lead(w, 4) OVER o AS w4
    FROM (
      SELECT id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM {table})
    ) WINDOW o AS (PARTITION BY id ORDER BY i)
  ) WHERE i <= greatest(n - 4, 1)
"""

DECONTAMINATION = f"""
WITH ih AS (SELECT *, count(*) OVER (PARTITION BY id) AS size FROM ({_SHINGLES.format(
    lower="lower(text)", table="(SELECT item_id AS id, text FROM benchmark)")})),
dh AS ({_SHINGLES.format(lower="lower(text)", table="(SELECT doc_id AS id, text FROM documents)")})
SELECT dh.id AS doc_id, ih.id AS item_id, count(*) AS matched, count(*) / size AS containment
FROM dh JOIN ih USING (h) GROUP BY dh.id, ih.id, size HAVING 10 * count(*) >= 8 * size
"""

_COMPONENTS = f"""
WITH RECURSIVE e AS (
  SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({_SHINGLES.format(
    lower="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    table="(SELECT doc_id AS id, text FROM documents)")})
), l AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.h = b.h AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= %d * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a
)
SELECT doc_id, (SELECT count(*) FROM e WHERE e.id = doc_id) AS n_shingles, min(c) AS component_id
FROM r GROUP BY doc_id
"""

NGRAM_JACCARD = _COMPONENTS % 80

BAYES_MINHASH = f"SELECT *, doc_id = component_id AS kept FROM ({_COMPONENTS % 85})"

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(payload)) AS n, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS digest,
    max(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

# CRC-32 of an id's decimal text, bit by bit.
_CRC = """xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, byte: list_reduce(
        list_concat([xor(c, byte)], list_transform(range(8), lambda k: 0::BIGINT)),
        lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"""

PREFIX_TRIE = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS b FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, o.i, k, w FROM c JOIN o ON o.conv_id = c.b AND o.i <= h
  UNION ALL SELECT c.conv_id, o.i, k, w FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > h
), p AS (
  SELECT conv_id, row_number() OVER a AS d, string_agg(k, '') OVER a AS path, w FROM r WINDOW a AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT path, d, w, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL
), m AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND starts_with(x.path, n.path)) AS n_children FROM n
), s AS (
  SELECT a.path, sum((b.n_convs - 1) * b.w) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
  FROM m a JOIN m b ON starts_with(b.path, a.path) GROUP BY a.path
), e AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN m q ON q.d = m.d - 1 AND q.path = left(m.path, 32 * q.d)
"""

_TEMPLATES = ", ".join("('%s', '%s')" % (name, text.replace("'", "''")) for name, _, text in TEMPLATES)

LICENCES = rf"""
WITH u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[\x20\t\r]*\n\s*')), NULL FROM documents
  UNION ALL SELECT doc_id, text, NULL FROM documents
), uw AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u
), ub AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM uw
), tw AS (
  SELECT n AS licence, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
  FROM (VALUES {_TEMPLATES}) AS v(n, t)
), tb AS (
  SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw
), m AS (
  SELECT doc_id, licence, line, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM ub JOIN tb ON 3 * len(a) >= 2 * len(b) AND 3 * len(b) >= 2 * len(a) AND len(a) > 0
)
SELECT doc_id, licence, max(dice) AS dice, CAST(min(line) AS BIGINT) AS line
FROM m WHERE dice >= 0.8 - 1e-9 GROUP BY doc_id, licence
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP,
        "op3_ngram_jaccard": NGRAM_JACCARD,
        "op4_licences": LICENCES,
        "op5_decontamination": DECONTAMINATION,
        "op8_warc": WARC,
        "op11_bayes_minhash": BAYES_MINHASH,
        "op12_prefix_trie": PREFIX_TRIE,
    }
