"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from marquee.llm import chat, quality_rules, sharding

_W = r"[^\x20\x09-\x0D]+"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_count = lambda text, pattern: f"len(regexp_extract_all({text}, {_q(pattern)}))"

_N = _count("l", _W)
_SYM, _BANG, _BAR = _count("l", r"[#*$%&<>]"), _count("l", "!"), _count("l", "[|»›•·]")
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ENDED = lambda x: f"contains({_q(quality_rules.LINE_ENDS)}, right(rtrim({x}, {_BLANKS}), 1))"
_CHARS = lambda lines: f"coalesce(list_sum(list_transform({lines}, lambda x: length(x))), 0)"
_PUNCTUATED = f"2 * {_CHARS('list_filter(lines, lambda x: ' + _ENDED('x') + ')')} >= {_CHARS('lines')}"
_STOCK = _q(quality_rules.stock_pattern())
LINE_FAILS = f"""(({_SYM} >= 3 AND 2 * {_SYM} >= {_N}) OR ({_BANG} >= 6 AND 2 * {_BANG} >= {_N}) OR ({_BAR} >= 3 AND 3 * {_BAR} >= {_N})
    OR (punctuated AND NOT {_ENDED("l")} AND {_N} <= 3)
    OR (regexp_matches(l, {_STOCK}) AND {quality_rules.STOCK_SHARE} * (length(l) - length(regexp_replace(l, {_STOCK}, '', 'g'))) >= length(l)))"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_W}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
i AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, sum(length(l)) AS line_chars, sum(CASE WHEN {LINE_FAILS} THEN length(l) ELSE 0 END) AS removed FROM (SELECT rid, {_PUNCTUATED} AS punctuated, unnest(lines) AS l FROM w) GROUP BY rid),
b AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_count('text', '[#*$%&|<>]')} AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed <= 50 * line_chars AS kept FROM b
"""

_ESCAPED = "|".join(["\\\\", *(c.replace("[", "\\[").replace("]", "\\]") for c in chat.CONTROL)])
_ESC_LEN = lambda x: f"(length({x}) + {_count(x, _ESCAPED)})"
_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
_ROLE = "coalesce(role, '')"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, {_ROLE} AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(CASE role {_MARKS} ELSE {sum(map(len, chat.OTHER))} + {_ESC_LEN('role')} END + {_ESC_LEN('text')}) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{_B32}', CAST(((CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST({_count("coalesce(text, '')", _W)} AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0 * CAST(coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
v AS (SELECT coalesce((SELECT arg_min(level, k) FROM c WHERE CAST(2 * source_size AS DOUBLE) > level * w), 0) AS level),
t AS (SELECT source, source_size, CASE WHEN CAST(2 * source_size AS DOUBLE) <= v.level * w THEN CAST(2 * source_size AS DOUBLE) ELSE v.level * w END AS target FROM s, v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken FROM r
"""

#: CRC-32 by its table, a byte at a time over the hexadecimal digits of a blob.
CRC_TABLE = "SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)"
_crc = lambda data: f"xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex({data}), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, h: xor(c >> 8, t[(xor(c, h) & 255) + 1])), 4294967295)"


def _cube(x: str, key: int) -> str:
    t = f"(({x} + {key}) % {sharding.PRIME})"
    return f"({t} * {t} % {sharding.PRIME} * {t} % {sharding.PRIME})"


def _pass(rows: str, seed: int) -> str:
    """One pass of the network: p of each of ``rows`` (with the radixes a, b and the count n) becomes its image."""
    kept = "doc_id, size, text_crc32, a, b, n"
    q = f"SELECT {kept}, p // b AS x, p % b AS y FROM {rows}"
    for i, j in sharding.round_keys(seed):
        q = f"SELECT {kept}, (x + {_cube('y', i)}) % a AS x, y FROM ({q})"
        q = f"SELECT {kept}, x, (y + {_cube('x', j)}) % b AS y FROM ({q})"
    return f"SELECT {kept}, x * b + y AS p FROM ({q})"


SHARDING = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_crc("encode(coalesce(text, ''))")} AS text_crc32,
  row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM documents, crc),
k AS (SELECT greatest(1, CAST(floor(sqrt(max(n))) AS BIGINT)) AS root, max(n) AS n FROM d),
r AS MATERIALIZED (SELECT a, (n + a - 1) // a AS b FROM k, range(greatest(root // 2 + 1, root - {sharding.TRIED - 1}), root + 1) g(a) ORDER BY (n + a - 1) // a * a - n, a DESC LIMIT 1),
w AS ({_pass("(SELECT d.*, a, b FROM d, r)", 13)} UNION ALL {_pass("(SELECT * FROM w WHERE p >= n)", 13)})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 24 AS INT) AS shard, p // 24 AS slot, CAST(NULL AS INT) AS grown_shard FROM w WHERE p < n
"""

_TURN = "length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')"
TRIE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5({_TURN})) AS pos, md5({_TURN}) AS turn_md5, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS own FROM t GROUP BY c),
v AS MATERIALIZED (SELECT n.c, n.c - n.c % 5 AS base, {_crc("encode(CAST(n.c AS VARCHAR))")} % 9 AS h, own FROM n, crc),
b AS (SELECT v.c, base, h, least(h, coalesce(n.own, 0)) AS taken, greatest(0, v.own - h) AS rest FROM v LEFT JOIN n ON n.c = base),
r AS MATERIALIZED (SELECT b.c, pos, turn_md5, bytes FROM b JOIN t ON t.c = base AND pos <= h UNION ALL SELECT b.c, pos - h + taken, turn_md5, bytes FROM b JOIN t ON t.c = b.c AND pos > h),
m AS MATERIALIZED (SELECT c, pos AS depth, md5(string_agg(turn_md5, '' ORDER BY pos) OVER w) AS key, bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT c, 0, '', 0 FROM b),
p AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = taken + rest AS ends FROM m JOIN b USING (c)),
g AS MATERIALIZED (SELECT key, min(c) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT m.key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * g.bytes) AS saved FROM g LEFT JOIN k USING (key) JOIN m ON m.c = g.conv_id AND m.depth <= g.depth GROUP BY m.key)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN g u ON u.key = g.parent LEFT JOIN k ON k.key = g.key JOIN s ON s.key = g.key
"""

ORACLES = {"op2_quality_rules": QUALITY, "op4_chat_formatting": CHAT, "op7_warc": WARC, "op9_mixing": MIXING, "op12_prefix_trie": TRIE, "op13_sharding": SHARDING}
