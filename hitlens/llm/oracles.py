"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_URL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), host AS (
  SELECT page_id, url, tail, regexp_extract(tail, '^[^/?#]*', 0) AS raw FROM cut
), part AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(tail, length(raw) + 1) AS rest FROM host
), split AS (
  SELECT page_id, url, host, regexp_extract(rest, '^[^?#]*', 0) AS path,
    list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')) AS params
  FROM part
), keyed AS (
  SELECT page_id, url, host, path, CASE WHEN host = '' THEN '' ELSE
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM split
), listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE key <> '' AND regexp_matches(url, '^[^:]*://([^/?#]*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT page_id, host, path, key IN (SELECT key FROM listed) AS listed,
    (SELECT max_by(h || p || ' ' || verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM keyed
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  coalesce(split_part(best, ' ', 2), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""

_CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations
), a AS (
  SELECT *, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM t WHERE role = 'assistant'
), last AS (
  SELECT conv_id, max(i) AS i, arg_max(text, i) AS text, arg_max(previous, i) AS previous FROM a GROUP BY conv_id
), cut AS (
  SELECT t.conv_id, t.i, t.role, t.text, CASE WHEN t.i = last.i THEN last.previous ELSE t.text END AS other,
    CASE WHEN last.text <> last.previous THEN last.i END AS first
  FROM t LEFT JOIN last USING (conv_id)
), shown AS (
  SELECT conv_id, i, coalesce(i < first, true) AS common, first IS NOT NULL AND i = first AS learned,
    '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
    replace(text, '<|', '< |') || '<|im_end|>' AS said, replace(other, '<|', '< |') || '<|im_end|>' AS said_else
  FROM cut
)
SELECT conv_id AS pair_id, CAST(count_if(common) AS INTEGER) AS n_common,
  coalesce(string_agg(head || said || chr(10), '' ORDER BY i) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || said || chr(10), '' ORDER BY i) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg(head || said_else || chr(10), '' ORDER BY i) FILTER (NOT common), '') AS rejected,
  coalesce(max(length(head) || '-' || (length(head) + length(said))) FILTER (learned), '') AS chosen_spans,
  coalesce(max(length(head) || '-' || (length(head) + length(said_else))) FILTER (learned), '') AS rejected_spans,
  NOT bool_and(common) AS differs
FROM shown GROUP BY conv_id
"""

_BM25 = r"""
WITH words AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM documents
), tf AS (
  SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL
), size AS (
  SELECT doc_id, count(*) AS len FROM words GROUP BY 1
), corpus AS (
  SELECT count(*) AS n, (SELECT count(*) FROM words) / count(*) AS mean FROM documents
), idf AS (
  SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, corpus GROUP BY w, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM tf q JOIN idf USING (w) JOIN tf d USING (w) JOIN size ON size.doc_id = d.doc_id, corpus
  WHERE q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLES: dict[str, str] = {"op8_topk_search": _BM25, "op4_preference_format": _CHAT, "op10_url_filter": _URL}
