"""DuckDB SQL for the registered queries of the subpackage, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT doc_id, words, len(words) AS n_words FROM w),
windows AS (
    SELECT doc_id, start, md5(array_to_string(words[start:start + 49], ' ')) AS h
    FROM n, LATERAL (SELECT unnest(range(1, greatest(n_words - 48, 1))) AS start)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT DISTINCT doc_id, start FROM windows JOIN firsts USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS pos FROM hits),
cut AS (SELECT doc_id, count(*) AS n_removed, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT n.doc_id, n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(
           words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)
"""

SQL["op8_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
suffixes AS MATERIALIZED (
    SELECT doc_id, start, hash(substr(x, 2 * start + 1, 200)) AS h
    FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS start FROM d)),
firsts AS (
    SELECT h, min(doc_id) AS first, arg_min(start, (doc_id, start)) AS first_start
    FROM suffixes GROUP BY h HAVING count(*) > 1),
hits AS (
    SELECT doc_id, start FROM suffixes JOIN firsts USING (h) WHERE first < doc_id OR first_start < start),
edges AS (
    SELECT doc_id, start, lag(start) OVER w AS before, lead(start) OVER w AS after
    FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
heads AS (
    SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k
    FROM edges WHERE before IS NULL OR start > before + 100),
tails AS (
    SELECT doc_id, start + 100 AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k
    FROM edges WHERE after IS NULL OR after > start + 100),
spans AS (
    SELECT doc_id, start, stop, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next
    FROM heads JOIN tails USING (doc_id, k)),
cut AS (
    SELECT doc_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans,
           substr(any_value(x), 1, 2 * min(start)) || string_agg(
               substr(x, 2 * stop + 1, 2 * (coalesce(next, length(x) // 2) - stop)), '' ORDER BY start) AS kept
    FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

SQL["op3_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[start:start + size - 1], ' ') AS h
    FROM (SELECT item_id, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
         LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS start)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
    SELECT doc_id, size, start, array_to_string(w[start:start + size - 1], ' ') AS h
    FROM d, sizes, LATERAL (SELECT unnest(range(1, greatest(len(w) - size + 2, 1))) AS start)),
hits AS (
    SELECT doc_id, x.size, start, item_id FROM doc_windows AS x JOIN item_windows AS y ON x.size = y.size AND x.h = y.h),
covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(start, start + size)) AS pos FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op9_warc"] = r"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size,
           sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (
    SELECT digest, min(page_id) AS first_id, arg_min(url, (page_id, url)) AS first_url
    FROM p WHERE size >= 100 GROUP BY digest HAVING count(*) > 1),
l AS (SELECT p.*, first_id, first_url, coalesce(first_id <> page_id, false) AS again FROM p LEFT JOIN firsts USING (digest)),
ids AS (SELECT *, md5(page_id || ' ' || url) AS h, md5(first_id || ' ' || first_url) AS g FROM l),
named AS (
    SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS id,
           '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] || '>' AS first_record,
           chr(13) || chr(10) AS eol FROM ids)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to,
       sha256('WARC/1.1' || eol || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || eol
              || 'WARC-Record-ID: ' || id || eol || 'WARC-Target-URI: ' || url || eol
              || 'WARC-Date: 2024-01-01T00:00:00Z' || eol || 'WARC-Payload-Digest: sha256:' || digest || eol
              || CASE WHEN again THEN 'WARC-Refers-To: ' || first_record || eol
                     || 'WARC-Refers-To-Target-URI: ' || first_url || eol
                     || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || eol ELSE '' END
              || 'Content-Type: text/html' || eol || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE size END || eol || eol
              || CASE WHEN again THEN '' ELSE html END || eol || eol) AS record_sha256
FROM named
"""
