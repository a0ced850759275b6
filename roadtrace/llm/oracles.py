"""DuckDB SQL that gives the rows of contract queries."""

from __future__ import annotations

from roadtrace.llm import audit, collocations, linededup, sharding

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, s + 1, s + 13), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS s FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s + 1, s + size), ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS s FROM docs, (SELECT DISTINCT size FROM windows) z WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, s, size, item_id FROM places JOIN windows USING (size, words)
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS word FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> {}) & 31) AS INTEGER), 1)"
_BASE32 = " || ".join(_DIGIT.format(k) for k in (15, 10, 5, 0))

#: Five hexadecimal digits are four digits of base 32.
WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages
), digits AS (
  SELECT page_id, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest
  FROM (SELECT page_id, i, ('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT AS v FROM (SELECT page_id, sha1(p) AS h, unnest(range(8)) AS i FROM payloads)) GROUP BY 1
)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM payloads JOIN digits USING (page_id)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s + 1, s + 5), ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS s FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(x, ',' ORDER BY x)) AS key FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 5 * m >= 4 * (p.n + q.n - m)
), twoway AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id, doc_id AS root FROM docs
  UNION
  SELECT b, root FROM reach JOIN twoway ON a = reach.doc_id
)
SELECT d.doc_id, min(root) AS class_id, (SELECT count(*) FROM twoway WHERE a = d.doc_id) AS n_links,
       coalesce((SELECT min(o.doc_id) FROM sizes o JOIN sizes s ON s.doc_id = d.doc_id AND o.key = s.key), d.doc_id) AS copy_id
FROM docs d JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op3_warc": WARC,
    "op4_line_dedup": linededup.ORACLE,
    "op6_jaccard_join": JACCARD,
    "op8_extendible_hashing": sharding.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
