"""SQL for those queries of this folder that SQL expresses, for an independent engine."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A class body of a regular expression: ASCII white space.
WS = r"\x20\x09-\x0D"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[{WS}]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN ws[1] ELSE ws[i] || chr(1) || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
k AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN k ON k.u = d.doc_id
"""

OP3 = rf"""
WITH p AS (
  SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(action, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, (SELECT arg_max(h || q, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
  coalesce((SELECT arg_max(action, length(h || q)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""

OP5 = """
WITH weights(source, weight) AS (VALUES ('src0', 1.0::DOUBLE), ('src1', 3.0), ('src2', 3.0), ('src3', 3.0)),
sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS listed, sum(weight) AS weights FROM sizes JOIN weights USING (source) WHERE size > 0),
rates AS (
  SELECT s.source, CASE WHEN size = 0 THEN 0 WHEN weight IS NULL THEN size / size ELSE weight * listed / weights / size END AS rate
  FROM sizes s LEFT JOIN weights w ON w.source = s.source CROSS JOIN total
), parts AS (SELECT source, rate / greatest(ceil(rate / 32), 1) AS m, greatest(ceil(rate / 32), 1)::INT AS parts FROM rates),
cdf AS (
  SELECT source, k, sum(CASE WHEN m = 0 THEN (k = 0)::INT ELSE exp(k * ln(m) - m - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, (SELECT unnest(range(0, 128)) AS k)
), cdfs AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, list_sum([len(list_filter(cs, lambda c: c <= u)) FOR u IN
    [(('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, '')) || '|' || k::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 FOR k IN range(1, parts + 1)]])::INT AS n
  FROM documents d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source JOIN cdfs c ON c.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS copy FROM drawn WHERE n > 0
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[{WS}]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) x(j) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{WS}]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN covered c ON c.doc_id = d.doc_id
), lines AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(t) AS th, x FROM (
    SELECT doc_id, source, t, trim(regexp_replace(lower(unnest(string_split(t, chr(10)))), '[{WS}]+', ' ', 'g')) AS x FROM d) WHERE x <> ''
), frequent AS (
  SELECT source, x, min(doc_id) AS first FROM lines GROUP BY source, x HAVING count(DISTINCT th) > 50
), lost AS (
  SELECT doc_id, sum(len(string_split(x, ' ')))::BIGINT AS n FROM lines JOIN frequent USING (source, x) WHERE doc_id <> first GROUP BY doc_id
), judged AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lost.n, 0)::BIGINT AS n_lost
  FROM base LEFT JOIN lost ON lost.doc_id = base.doc_id
)
SELECT *, NOT base_failed AND n_words - n_lost >= 0.5 * n_words AS kept FROM judged
"""


#: A table of CRC-32 by its rule, as column ``t`` of one row.
CRC_TABLE = "crcs AS MATERIALIZED (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k))"


def crc(x: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, where ``crcs`` is joined."""
    return f"xor(list_reduce(list_prepend(4294967295, [('0x' || y)::BIGINT FOR y IN regexp_extract_all(hex(encode({x})), '..')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def leaf(**other: str) -> str:
    """A row's leaf, with other values for some columns."""
    values = [f"({other.get(c, c)})::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


def fold(name: str, start: str, nodes: str, keys: str) -> str:
    """Recursive folding of ``node`` along its siblings in the tree ``nodes``, ``sib`` collecting them."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.* REPLACE (f.l + 1 AS l, f.i // 2 AS i, (f.n + 1) // 2 AS n, f.sib || coalesce(s.h, '') AS sib,
    sha256(CASE WHEN s.h IS NULL THEN f.node WHEN f.i % 2 = 1 THEN s.h || f.node ELSE f.node || s.h END) AS node)
  FROM {name} f LEFT JOIN {nodes} s ON s.l = f.l AND s.i = xor(f.i, 1) {keys} WHERE f.n > 1
)"""


OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
lf AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf()} AS leaf, CASE WHEN {crc("doc_id::VARCHAR")} % 7 = 0 THEN {leaf(n_chars="n_chars + 1")} END AS forged FROM documents, crcs),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM lf),
t AS (
  SELECT g, 0 AS l, i, n, leaf AS h FROM rk
  UNION ALL
  SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, l + 1, i // 2, (n + 1) // 2
), subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS l, i, n, subroot AS h FROM subs
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l + 1, i // 2, (n + 1) // 2
),
{fold("f", "SELECT doc_id, g, leaf, 0 AS l, i, n, coalesce(forged, leaf) AS node, '' AS sib FROM rk", "t", "AND s.g = f.g")},
{fold("top", "SELECT f.doc_id, f.leaf, subs.subroot, 0 AS l, subs.i, subs.n, f.node, f.sib FROM f JOIN subs ON subs.g = f.g WHERE f.n = 1", "u", "")}
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, node AS folded_root, node = h AS verified FROM top, (SELECT h FROM u WHERE n = 1) WHERE top.n = 1
"""


def after(state: int, cost: str, letter: str, role: str) -> str:
    """What an edit makes of a state's cheapest way: its cost, letters and the roles that it sets."""
    return f"{{'c': v{state}.c + {cost}, 'l': v{state}.l || '{letter}', 'o': v{state}.o || '{role}'}}"


def kept_or_reroled(state: int, role: str) -> list[str]:
    keep = f"CASE WHEN ini = '{role}' AND NOT must THEN {after(state, 'more', 'K', '-')} END"
    return [keep] if role == "s" else [keep, f"CASE WHEN NOT must THEN {after(state, '1 + more', 'R', role)} END"]


def least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
n0 AS (SELECT conv_id, turn, coalesce('=' || conv_id, '') AS g, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crcs),
d AS (SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM n0 WHERE fault <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, right(regexp_replace(text, '[{WS}]+$', ''), 1) AS z FROM d),
r AS (
  SELECT *, left(role, 1) AS ini, blank OR again AS must, CASE WHEN NOT (blank OR again) AND z NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY k) || left(role, 1) AS pair
  FROM (SELECT *, z = '' AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 AS again FROM e)
), s AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (more = 5) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts
  FROM r GROUP BY g
), w AS (
  SELECT g, 0::BIGINT AS k, {{'c': 0::BIGINT, 'l': '', 'o': ''}} AS v0, {{'c': 1000000000000, 'l': '', 'o': ''}} AS v1, {{'c': 1000000000000, 'l': '', 'o': ''}} AS v2, {{'c': 1000000000000, 'l': '', 'o': ''}} AS v3 FROM s
  UNION ALL
  SELECT g, k + 1, {after(0, "2", "D", "-")}, {least(after(1, "2", "D", "-"), *kept_or_reroled(0, "s"))},
    {least(after(2, "2", "D", "-"), *kept_or_reroled(0, "u"), *kept_or_reroled(1, "u"), *kept_or_reroled(3, "u"))}, {least(after(3, "2", "D", "-"), *kept_or_reroled(2, "a"))}
  FROM (
    SELECT g, k, v0, v1, v2, {least("v3", after(2, "5", "I", "a"))} AS v3, ini, must, more FROM (
      SELECT w.g, w.k, v0, v1, {least("v2", after(0, "5", "I", "u"), after(1, "5", "I", "u"), after(3, "5", "I", "u"))} AS v2, v3, ini, must, more FROM w JOIN r ON r.g = w.g AND r.k = w.k + 1))
), last AS (
  SELECT s.*, {least("v0", "v3", after(2, "5", "I", "a"), "{'c': v0.c + 10, 'l': v0.l || 'II', 'o': v0.o || 'ua'}", "{'c': v1.c + 10, 'l': v1.l || 'II', 'o': v1.o || 'ua'}")} AS v FROM w JOIN s ON s.g = w.g AND s.n = w.k
), steps AS (
  SELECT g, i, substr(v.l, i, 1) AS l, substr(v.o, i, 1) AS o, length(replace(left(v.l, i), 'I', '')) AS pos, roles, texts FROM (SELECT *, unnest(range(1, length(v.l) + 1)) AS i FROM last)
), fixed AS (
  SELECT g, string_agg(CASE o WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE roles[pos] END || ':' || CASE WHEN l = 'I' THEN '' ELSE texts[pos] END, chr(10) ORDER BY i) AS lines FROM steps WHERE l <> 'D' GROUP BY g
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.l, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM n0) c LEFT JOIN last ON last.g = c.g LEFT JOIN fixed ON fixed.g = c.g
"""

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {crc("coalesce(text, '')")}::BIGINT AS text_crc32,
    ('0x' || left(md5(coalesce(text, '')), 15))::BIGINT AS k0, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS k1 FROM documents, crcs
), c AS (SELECT *, sum(size) OVER (ORDER BY k0, k1 ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
total AS (SELECT sum(size)::BIGINT AS bytes FROM d),
intervals AS (
  SELECT l, CASE WHEN l <= 6 THEN k0 >> (60 - 10 * l) ELSE k0 END AS p, CASE WHEN l <= 6 THEN 0 ELSE k1 >> (120 - 10 * l) END AS q, min(upto - size) AS low, max(upto) AS high, count(*) AS n
  FROM c, range(1, 13) r(l) GROUP BY ALL
), hit AS (SELECT j, l, n, j * bytes - low * 40 AS before, high * 40 - j * bytes AS after, low, high, bytes FROM intervals, total, range(1, 40) g(j) WHERE low * 40 < j * bytes AND j * bytes <= high * 40),
bounds AS (SELECT j, arg_min(CASE WHEN before <= after THEN low ELSE high END, l) AS cut FROM hit WHERE n = 1 OR l = 12 OR least(before, after) * 1000000 <= 1000 * bytes GROUP BY j),
s AS (SELECT *, (SELECT count(*) FROM bounds WHERE cut <= upto - size)::INT AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1 >> 54, k0, k1) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

SQL = {"op1_near_dedup": OP1, "op3_url_filters": OP3, "op5_mix_sources": OP5, "op9_quality_rules": OP9, "op11_merkle_manifest": OP11, "op12_conversation_repair": OP12, "op13_sharding": OP13}
