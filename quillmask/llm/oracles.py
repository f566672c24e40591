"""SQL (DuckDB) that computes the results of operators in another way: all pairs, windows and recursion instead of sketches,
bitmaps and pointer jumping."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, text, CASE WHEN turn > 0 THEN turn - CASE WHEN (conv_id + turn) % 3 = 0 AND turn > 1 THEN 2 ELSE 1 END END AS answers FROM conversations),
messages AS (
  SELECT s.conv_id, s.turn, concat(
      CASE WHEN b.text IS NOT NULL THEN regexp_replace(b.text, '(^|\n)', '\1> > ', 'g') || chr(10) ELSE '' END,
      CASE WHEN a.text IS NOT NULL THEN regexp_replace(a.text, '(^|\n)', '\1> ', 'g') || chr(10) ELSE '' END, coalesce(s.text, '')) AS text
  FROM said s LEFT JOIN said a ON a.conv_id = s.conv_id AND a.turn = s.answers LEFT JOIN said b ON b.conv_id = s.conv_id AND b.turn = a.answers),
split AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS i FROM messages),
marked AS (SELECT conv_id, turn, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS marks FROM split),
lines AS (
  SELECT conv_id, turn, i, line, length(translate(marks, ' ' || chr(9), '')) AS level,
         trim(lower(regexp_replace(substr(line, length(marks) + 1), '\s+', ' ', 'g'))) AS passage FROM marked),
own AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS own_text FROM lines GROUP BY ALL),
originals AS (SELECT conv_id, passage, min(turn) AS original FROM lines WHERE level = 0 AND passage <> '' GROUP BY ALL),
votes AS (
  SELECT conv_id, q.turn, level, original, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, level, passage FROM lines WHERE level > 0) q JOIN originals USING (conv_id, passage)
  WHERE original < q.turn GROUP BY ALL),
parents AS (SELECT conv_id, turn, original AS parent FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, original DESC) = 1),
nodes AS (SELECT conv_id, turn, parent FROM own LEFT JOIN parents USING (conv_id, turn)),
tree AS (
  SELECT conv_id, turn, parent, turn AS root, 0 AS depth FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.conv_id, n.turn, n.parent, t.root, t.depth + 1 FROM nodes n JOIN tree t ON n.conv_id = t.conv_id AND n.parent = t.turn)
SELECT conv_id, turn, parent AS parent_turn, root AS root_turn, depth::BIGINT AS reply_depth, sha256(own_text) AS own_sha256 FROM tree JOIN own USING (conv_id, turn)
"""

OP4 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
headers AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex,
         count(*) OVER (PARTITION BY payload) AS n, max(page_id) OVER (PARTITION BY payload) AS largest FROM payloads)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM headers
"""

OP5 = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
places AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM words, unnest(range(1, len(ws) - 1)) AS r(i)),
often AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, unnest([0, 1, 2]) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, text, ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, len(string_split(text, chr(10))) AS n_lines FROM words),
measured AS (
  SELECT doc_id, text, n_lines, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM lines LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR 10 * len(regexp_extract_all(text, '[A-Z]')) > 3 * word_chars OR 4 * len(regexp_extract_all(text, '!')) > n_words OR 5 * len(regexp_extract_all(text, '[0-9]')) > word_chars
            OR 10 * len(regexp_extract_all(text, '\p{{L}}')) < 6 * word_chars OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-*•][ \t]')) > 9 * n_lines) AS kept
FROM failed
"""

OP9 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM words WHERE len(ws) > 0),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets GROUP BY ALL),
items AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
links AS MATERIALIZED (
  SELECT a.rep AS p, b.rep AS q FROM items a JOIN items b ON a.x = b.x AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT p, q FROM links UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
least_ AS (SELECT p AS rep, min(q) AS m FROM reach GROUP BY p),
named AS (SELECT s.doc_id, len(s.s) AS n, least(c.rep, coalesce(m, c.rep)) AS component_id FROM sets s JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN least_ USING (rep))
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN named USING (doc_id)
"""


def product_quantised(rounds: int = 4) -> str:
    """SQL of op11: each round is a table of codebooks. Distances are exact in double precision at these sizes."""
    nearest = """
a{k} AS MATERIALIZED (
  SELECT i.row, i.p, any_value(i.v) AS v, min({{'d': list_inner_product(i.v, i.v) - 2 * list_inner_product(i.v, b.v) + list_inner_product(b.v, b.v), 'e': e}}) AS best
  FROM parts i JOIN b{k} b ON i.p = b.p GROUP BY i.row, i.p),"""
    moved = """
m{k} AS (SELECT p, best.e AS e, j, floor(sum(v[j]) / count(*)) AS c FROM a{k}, range(1, 17) AS r(j) GROUP BY ALL),
n{k} AS (SELECT p, e, list(c ORDER BY j) AS v FROM m{k} GROUP BY p, e),
b{l} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN n{k} n ON b.p = n.p AND b.e = n.e),"""
    steps = "".join(nearest.format(k=k) + moved.format(k=k, l=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, x[16 * p + 1:16 * p + 16] AS v FROM kept, range(4) AS r(p)),
b0 AS (SELECT p, row - 1 AS e, v FROM parts WHERE row <= 256),{steps}
whole AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, j, v[j] AS c FROM b{rounds}, range(1, 17) AS r(j)))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN kept USING (row), books
"""


OP12 = r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
parted AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
listed AS (SELECT page_id, max({'n': length(h || p), 'rule': h || p, 'v': v}) AS r FROM parted JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
tokened AS MATERIALIZED (
  SELECT page_id, host, path, r.rule AS rule, r.v AS v, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x))) AS ts
  FROM parted LEFT JOIN listed USING (page_id)),
size AS (SELECT (count(*) + 99) // 100 AS least FROM tokened WHERE v IS NOT NULL),
known AS (SELECT page_id, v, unnest(ts) AS t FROM tokened WHERE v IS NOT NULL),
often AS (SELECT min(t) AS t FROM (SELECT t, list(page_id ORDER BY page_id) AS ids FROM known GROUP BY t HAVING count(*) >= (SELECT least FROM size)) GROUP BY ids),
items AS MATERIALIZED (SELECT page_id, v, t FROM known JOIN often USING (t)),
sets AS (
  SELECT v, [t] AS ts FROM items
  UNION ALL SELECT a.v, [a.t, b.t] FROM items a JOIN items b ON a.page_id = b.page_id AND a.t < b.t
  UNION ALL SELECT a.v, [a.t, b.t, c.t] FROM items a JOIN items b ON a.page_id = b.page_id AND a.t < b.t JOIN items c ON a.page_id = c.page_id AND b.t < c.t),
counted AS (SELECT ts, label, count(*) AS n_of, count(*) FILTER (v = label) AS n_right FROM sets, (VALUES ('allow'), ('block')) AS l(label) GROUP BY ts, label),
sure AS (SELECT * FROM counted WHERE n_right >= (SELECT least FROM size) AND n_right >= 0.9::DOUBLE * n_of),
pruned AS (SELECT * FROM sure r WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.label = r.label AND len(s.ts) < len(r.ts) AND list_has_all(r.ts, s.ts) AND s.n_right * r.n_of >= r.n_right * s.n_of)),
best AS (
  SELECT page_id, label FROM tokened JOIN pruned r ON v IS NULL AND list_has_all(tokened.ts, r.ts)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_right / n_of DESC, n_right DESC, label DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, label, 'allow') AS verdict FROM tokened LEFT JOIN best USING (page_id)
"""

OP13 = r"""
WITH crcs AS (
  SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
hashed AS (SELECT doc_id, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g, ws, len(ws)::BIGINT AS n FROM crcs),
planted AS (SELECT doc_id, n, ws, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM hashed),
words AS MATERIALIZED (SELECT doc_id, n, i, ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM planted, unnest(range(n)) AS r(i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, i, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, min(i) AS start, d, count(*) + d AS length FROM islands GROUP BY doc_id, d, island HAVING count(*) + d >= greatest(6, 4 * d)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(d) AS period FROM stretches GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM runs GROUP BY doc_id),
again AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN again USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
