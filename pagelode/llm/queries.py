"""The registered queries of this subpackage and, where SQL expresses them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, html_text, near_dedup, quality, recompress, sharding, spelling, suffix_dedup, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_query,
    "op2_token_files": token_files.op2_query,
    "op3_byte_bpe": bpe.op3_query,
    "op4_near_dedup": near_dedup.op4_query,
    "op5_html_text": html_text.op5_query,
    "op6_substring_dedup": recompress.op6_query,
    "op7_decontamination": decontam.op7_query,
    "op8_quality_rules": quality.op8_query,
    "op9_warc": warc.op9_query,
    "op10_sharding": sharding.op10_query,
    "op11_spelling_variants": spelling.op11_query,
    "op12_multiprobe_neighbours": ann.op12_query,
}

#: DuckDB has no crc32: its table of remainders, as one row `remainders`(r), and the step from a list of byte values.
_REMAINDERS = """remainders AS (SELECT list(c ORDER BY n) AS r FROM (
  SELECT n, list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(n)))"""
_CRC = "xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, r[(xor(c, y) & 255) + 1])), 4294967295)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS rk, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (
  SELECT rk, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(generate_series(0, n - 50)) AS i FROM d WHERE n >= 50)),
least_of AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT rk, i FROM win JOIN least_of USING (g) WHERE m < doc_id),
cov AS (SELECT DISTINCT rk, unnest(generate_series(i, i + 49)) AS p FROM gone),
spans AS (
  SELECT rk, count(*) AS n FROM (SELECT rk, p, lag(p) OVER (PARTITION BY rk ORDER BY p) AS q FROM cov) WHERE q IS NULL OR q < p - 1 GROUP BY rk),
byte AS (SELECT rk, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT rk, h, unnest(generate_series(0, n - 1)) AS p FROM d WHERE n > 0)),
kept AS (SELECT rk, string_agg(x, '' ORDER BY p) AS t, count(*) AS n FROM byte ANTI JOIN cov USING (rk, p) GROUP BY rk)
SELECT doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(d.n - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (rk) LEFT JOIN kept USING (rk)""",
    "op4_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, w.b FROM reach r JOIN way w ON w.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
    # for pages whose markup is that of the driver's tables: one article of paragraphs, headings and lists
    "op5_html_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|\z)', 1) AS x FROM pages),
b AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(b|i|a)( [^>]*)?>', '', 'g'), '</?(p|h1|h2|div|ul|li)( [^>]*)?>') AS l FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(l, lambda s:
    trim(regexp_replace(regexp_replace(replace(s, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM b)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM c""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rk, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT rk, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT rk, i FROM (SELECT rk, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT rk, unnest(generate_series(i, i + 34)) AS p FROM dup),
word AS (SELECT rk, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT rk, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (rk, p) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rk)""",
    "op7_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rk, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rk, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rk, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT rk, grams.n, i, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
hit AS (SELECT rk, count(DISTINCT p) AS n FROM (SELECT rk, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY rk),
items AS (SELECT rk, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rk, item FROM found) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.l, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rk) LEFT JOIN items USING (rk)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS g, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY g) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f""",
    # crc32 by a table of 256 remainders; slots by md5; the map by taking slots from the largest on, each to the lightest shard
    "op10_sharding": """
WITH RECURSIVE remainders AS (SELECT list(c ORDER BY n) AS r FROM (
  SELECT n, list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(n))),
hexed AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, size, list_transform(generate_series(1, size - 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT) AS x FROM hexed),
d AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, r[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM bytes, remainders),
slotted AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, crc, 0)), 1, 8))::BIGINT % 4096 AS vslot FROM d),
sizes AS (
  SELECT s.vslot, coalesce(sum(size), 0) AS b, count(size) AS n, row_number() OVER (ORDER BY coalesce(sum(size), 0) DESC, s.vslot) AS i
  FROM range(4096) s(vslot) LEFT JOIN slotted USING (vslot) GROUP BY s.vslot),
dealt(i, loads, shard) AS (
  SELECT 0::BIGINT, list_transform(range(16), lambda k: 0::HUGEINT), 0::BIGINT
  UNION ALL
  SELECT s.i, list_transform(loads, lambda l, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN l + s.b ELSE l END), list_position(loads, list_min(loads)) - 1
  FROM dealt JOIN sizes s ON s.i = dealt.i + 1),
placed AS (SELECT s.vslot, shard, sum(n) OVER (PARTITION BY shard ORDER BY s.vslot) - n AS before FROM dealt JOIN sizes s USING (i))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(before + row_number() OVER (PARTITION BY vslot ORDER BY doc_id, crc) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(vslot AS INTEGER) AS vslot
FROM slotted JOIN placed USING (vslot)""",
    "op8_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rk, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rk, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rk, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT rk, i FROM (SELECT rk, i, count(*) OVER (PARTITION BY rk, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rk, count(DISTINCT p) AS n FROM (SELECT rk, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rk),
raw_lines AS (SELECT rk, source, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (
  SELECT rk, source, l, regexp_extract_all(translate(l, '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS lw
  FROM raw_lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT rk, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rk),
keyed AS (SELECT rk, source, array_to_string(lw, ' ') AS k, sum(len(lw)) AS words FROM lines GROUP BY ALL),
frequent AS (SELECT source, k FROM keyed GROUP BY source, k HAVING count(*) > 10),
hit AS (
  SELECT h.rk, sum(h.words) AS words FROM keyed h JOIN frequent f ON h.k = f.k AND h.source IS NOT DISTINCT FROM f.source GROUP BY h.rk),
base AS (
  SELECT d.doc_id, len(d.w) AS n_words,
         coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS word_chars,
         length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(d.w) - coalesce(hit.words, 0) AS n_left
  FROM d LEFT JOIN dl USING (rk) LEFT JOIN rep USING (rk) LEFT JOIN hit USING (rk))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.5 * n_words AS kept,
       CAST(n_left AS BIGINT) AS n_left
FROM base""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_REMAINDERS},
runs AS (SELECT doc_id, translate(run, '{_UP}', '{_LOW}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
own AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS h FROM runs WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (SELECT w, n, list_transform(generate_series(1, len(h) // 2), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT) AS x FROM own),
hashed AS (SELECT w, n, {_CRC} AS h FROM bytes, remainders),
v AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
places AS (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM v),
wild AS (SELECT w, n, w[:i - 1] || '*' || w[i + 1:] AS g FROM places),
cut AS (SELECT DISTINCT w, n, w[:i - 1] || w[i + 1:] AS s FROM places),
near AS (
  SELECT a.w, b.w AS o, b.n AS o_n FROM wild a JOIN wild b ON a.g = b.g AND a.w <> b.w
  UNION ALL SELECT c.w, v.w, v.n FROM cut c JOIN v ON v.w = c.s
  UNION ALL SELECT v.w, c.w, c.n FROM cut c JOIN v ON v.w = c.s),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, max(o_n) AS o_n FROM near GROUP BY w),
forms AS (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * n THEN o END AS form, CASE WHEN o_n >= 10 * n THEN o_n END AS form_n
  FROM v LEFT JOIN best USING (w)),
chain(w, root, i) AS (SELECT w, w, 0 FROM forms UNION ALL SELECT c.w, f.form, i + 1 FROM chain c JOIN forms f ON f.w = c.root WHERE f.form IS NOT NULL),
last_of AS (SELECT w, last(root ORDER BY i) AS root FROM chain GROUP BY w)
SELECT w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN last_of USING (w)""",
}
