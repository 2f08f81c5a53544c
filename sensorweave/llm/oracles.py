"""DuckDB counterparts of the registered queries."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT *, '.' || host AS dotted,
    (dotted LIKE '%.net' AND starts_with(path, '/')) AS a, (dotted LIKE '%.example.net' AND starts_with(path, '/en/')) AS b,
    (dotted LIKE '%.example.com' AND starts_with(path, '/de/')) AS c, (dotted LIKE '%.org' AND starts_with(path, '/fr/')) AS d FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  CASE WHEN b THEN 'example.net/en/' WHEN c THEN 'example.com/de/' WHEN d THEN 'org/fr/' WHEN a THEN 'net/' END AS rule,
  CASE WHEN b THEN 'allow' WHEN c THEN 'block' WHEN d THEN 'allow' WHEN a THEN 'block'
    WHEN regexp_matches(host || path, '/ads\.txt$|^([^/]*\.)?responsible-gambling\.', 'is') THEN 'allow'
    WHEN regexp_matches(host || path,
      '^([^/]*\.)?((ad|ads|adserver|adservice|track|tracker|tracking|pixel|bet|bets|casino|poker|porn|xxx|viagra)\.|(ads|casino|jackpot|poker|slots|escort|porn|xxx|viagra)-)', 'is')
      OR regexp_matches(host || path, '^([^/]*\.)?((cheap-pills|casino-bonus|free-followers|payday-loans|replica-watches|spam-farm)\.|essay-writing.*\.)', 'is')
      OR regexp_matches(host || path, '-(ads|track|tracker|bets|betting|casino|jackpot|poker|escorts|porn)\.|/(ads|adserver|banners|casino|sportsbook|porn)/', 'is')
      OR regexp_matches(host || path, '/popunder([^A-Za-z0-9_.%-]|$)', 'is')
      OR regexp_matches(host || path, '[^A-Za-z0-9_.%-](cheap[^A-Za-z0-9_.%-]pills|spam[^A-Za-z0-9_.%-]farm)([^A-Za-z0-9_.%-]|$)', 'is')
    THEN 'block' ELSE 'allow' END AS verdict
FROM fit"""

OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
isl AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM again)),
sp AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY ALL),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id),
pc AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s, a AS e FROM sp
  UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * s + 1)::BIGINT, (2 * (coalesce(e, n) - s))::BIGINT), '' ORDER BY s) AS h
  FROM pc JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
c AS (
  SELECT rid, doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS marks, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper FROM d),
b AS (
  SELECT c.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM c LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 10 * marks > 3 * n_words OR 2 * n_dup_lines > len(lines) OR 2 * upper > word_chars) AS kept
FROM v"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
v AS (
  SELECT page_id, url, html, strlen(html)::BIGINT AS n, sha1(html) AS s, max(page_id) OVER (PARTITION BY html) AS newest FROM p),
g AS (
  SELECT *, list_transform(range(8), lambda k: list_sum(list_transform(range(5),
    lambda j: (strpos('0123456789abcdef', s[k * 5 + j + 1]) - 1) * (1 << (4 * (4 - j)))))::BIGINT) AS v5 FROM v),
r AS (
  SELECT *, array_to_string(list_transform(range(32), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v5[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1]), '') AS digest, page_id = newest AS own,
    chr(13) || chr(10) AS nl FROM g)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN own THEN NULL ELSE newest END AS refers_to,
  sha256('WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN own THEN 'response' ELSE 'revisit' END || nl || 'WARC-Record-ID: <urn:page:' || page_id
    || '>' || nl || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl || 'WARC-Payload-Digest: sha1:' || digest || nl
    || CASE WHEN own THEN '' ELSE 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl
      || 'WARC-Refers-To: <urn:page:' || newest || '>' || nl END
    || 'Content-Type: text/html' || nl || 'Content-Length: ' || CASE WHEN own THEN n ELSE 0 END || nl || nl
    || CASE WHEN own THEN html ELSE '' END || nl || nl) AS record_sha256
FROM r"""

#: The checksum steps through the bytes with the table of its polynomial, which is made bit by bit.
OP10 = r"""
WITH RECURSIVE steps(n, c, k) AS (
  SELECT n, n, 0 FROM (SELECT unnest(range(256))::BIGINT AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (
  SELECT doc_id, size, list_transform(range(strlen(text)), lambda i:
    (16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) AS bytes FROM d),
s AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, crc),
o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole,
    row_number() OVER (ORDER BY doc_id, text_crc32) AS r FROM s),
q AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * whole))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY r) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q"""

#: Prefixes are named by a chain of digests; totals come from each node's path, taken from its smallest member.
OP12 = r"""
WITH RECURSIVE steps(n, c, k) AS (
  SELECT n, n, 0 FROM (SELECT unnest(range(256))::BIGINT AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS s FROM (SELECT DISTINCT conv_id FROM own)),
h AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(s)), lambda i: ascii(s[i + 1])::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc),
built AS (
  SELECT h.conv_id, pos, role, text FROM h JOIN own ON own.conv_id = h.base WHERE pos < h
  UNION ALL
  SELECT h.conv_id, pos - h + least(h, coalesce(n, 0)), role, text
  FROM h JOIN own USING (conv_id) LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM own GROUP BY conv_id) USING (base) WHERE pos >= h),
chain(conv_id, d, id, up, bytes) AS (
  SELECT conv_id, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM h
  UNION ALL
  SELECT c.conv_id, d + 1, sha256(id || strlen(role)::VARCHAR || ':' || role || text), id, strlen(text)::BIGINT
  FROM chain c JOIN built b ON b.conv_id = c.conv_id AND b.pos = c.d),
long AS (SELECT conv_id, max(d) AS n FROM chain GROUP BY conv_id),
node AS (SELECT id, min(conv_id) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n_convs, min(bytes) AS bytes FROM chain GROUP BY id),
kids AS (SELECT up AS id, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
fact AS (SELECT node.*, coalesce(n, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM node LEFT JOIN kids USING (id)),
total AS (
  SELECT c.id, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved FROM fact f JOIN chain c ON c.conv_id = f.conv_id AND c.d <= f.depth
  GROUP BY c.id),
ends AS (SELECT id, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS s FROM chain JOIN long USING (conv_id) WHERE d = n GROUP BY id)
SELECT f.conv_id::BIGINT AS conv_id, f.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.s, '')) AS ends_sha256
FROM fact f JOIN total t USING (id) LEFT JOIN node p ON p.id = f.up LEFT JOIN ends ON ends.id = f.id"""

ORACLES = {"op12_prefix_trie": OP12, "op2_url_filter": OP2, "op4_substrings": OP4, "op7_quality": OP7, "op9_warc": OP9, "op10_sharding": OP10}
