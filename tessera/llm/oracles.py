"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .line_duplicates import EDITS, MIN_CHARS
from .mixing import BITS, BUDGET_PERCENT, MAX_REPEAT, ROUNDS, WEIGHTS
from .quality import MAX_REPEATED_PERCENT, MIN_WORDS, STOP_WORDS, THRESHOLDS

_PROBE = "</s>[INST] ok [/INST]"


def _chat() -> str:
    added = lambda x: f"(length({x}) + length({x}) - length(translate({x}, '\\<[', '')))"  # noqa: E731  each of the three takes one more character
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
s AS (SELECT *, contains(text, '</s>') OR contains(role, '</s>') OR contains(role, '[/INST]') AS conflict FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(CASE WHEN conflict THEN 21 + {added('role')} + {added('text')} ELSE 20 + length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _quality() -> str:
    stops = {w for words in STOP_WORDS.values() for w in words}
    listed = ", ".join(f"'{w}'" for w in sorted(stops | {w.capitalize() for w in stops} | {w.upper() for w in stops}))
    held = " AND ".join(f"{name} {op} {value}" for name, (low, high) in THRESHOLDS.items() for op, value in ((">=", low), ("<=", high)) if value is not None)
    return f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \\t-\\r]+') AS words, string_split(text, chr(10)) AS all_lines FROM d),
l AS (SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM w),
u AS (SELECT row_no, unnest(words) AS one, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT row_no, pos, one || ' ' || lead(one, 1) OVER o || ' ' || lead(one, 2) OVER o || ' ' || lead(one, 3) OVER o || ' ' || lead(one, 4) OVER o AS win FROM u WINDOW o AS (PARTITION BY row_no ORDER BY pos)),
h AS (SELECT row_no, pos, count(*) OVER (PARTITION BY row_no, win) AS n FROM g WHERE win IS NOT NULL),
p AS (SELECT row_no, count(DISTINCT place) AS n FROM (SELECT row_no, unnest(range(pos, pos + 5)) AS place FROM h WHERE n >= 2) GROUP BY row_no),
q AS (SELECT row_no, count(*) AS n FROM u WHERE one IN ({listed}) GROUP BY row_no),
c AS (SELECT l.row_no, doc_id, len(words) AS n_words, length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(q.n, 0) AS n_stops, len(all_lines) AS n_lines, len(lines) AS n_word_lines FROM l LEFT JOIN p USING (row_no) LEFT JOIN q USING (row_no)),
r AS (SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars, n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio, (n_stops + 1)::DOUBLE / greatest(n_words, 1) AS stop_word_ratio,
n_dup_lines::DOUBLE / greatest(n_word_lines, 1) AS duplicate_line_ratio, n_word_lines::DOUBLE / greatest(n_lines, 1) AS word_line_ratio, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {held} AS kept FROM r"""


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_SHARDS = f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc), d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), lambda s, b: xor(s >> 8, crc[CAST((xor(s, b) & 255) + 1 AS BIGINT)])), 4294967295::BIGINT) AS text_crc32 FROM d, t),
b AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT doc_id, size, text_crc32, CAST(least(23, floor((before + size / 2.0::DOUBLE) * 24 / total)) AS INT) AS shard FROM b)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('{_ALPHABET}', CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""


def _mix() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS * ROUNDS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{weights}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS weight FROM d GROUP BY source),
c AS (SELECT *, {float(MAX_REPEAT)}::DOUBLE * source_size AS cap, {float(MAX_REPEAT)}::DOUBLE * source_size / weight AS cap_level, CAST(sum(source_size) OVER () AS DOUBLE) * {BUDGET_PERCENT} / 100.0::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level_here FROM c WINDOW w AS (ORDER BY cap_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level_here, cap_level) FILTER (level_here < cap_level) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l, v),
e AS (SELECT *, floor(target / greatest(source_size, 1)) AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, d.h, e.*, target - epochs * source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
b AS (SELECT *, max(CASE WHEN size > 0 AND before <= rest THEN h END) OVER (PARTITION BY source) AS last_h FROM r)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN h < last_h OR (h = last_h AND 2 * (rest - before) >= size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM b"""


def _lines() -> str:
    if EDITS != 1:
        raise ValueError("this SQL is for one edit")
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
o AS (SELECT row_no, doc_id, CAST(place - 1 AS INT) AS line_no, line FROM (SELECT row_no, doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS place FROM d) WHERE regexp_matches(line, '[^ \\t-\\r]')),
n AS (SELECT line, row_number() OVER (ORDER BY line) AS node, length(line) AS n FROM (SELECT DISTINCT line FROM o)),
f AS (SELECT * FROM n WHERE n >= {MIN_CHARS}),
x AS (SELECT node, line, n, n - less AS m FROM f, (SELECT unnest([0, 1]) AS less)),
p AS (SELECT DISTINCT x.node AS a, y.node AS b, x.line AS u, y.line AS v FROM x JOIN f y ON x.m = y.n AND left(x.line, y.n // 2) = left(y.line, y.n // 2) WHERE x.node <> y.node
UNION SELECT DISTINCT x.node, y.node, x.line, y.line FROM x JOIN f y ON x.m = y.n AND right(x.line, y.n - y.n // 2) = right(y.line, y.n - y.n // 2) WHERE x.node <> y.node),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, length(v) + 1), lambda i: u[i] = v[i]), false), length(v) + 1) AS place FROM p),
l AS (SELECT a, b FROM q WHERE substr(u, place + 1) = CASE WHEN length(u) = length(v) THEN substr(v, place + 1) ELSE substr(v, place) END),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
g AS (SELECT node, min(other) AS class FROM (SELECT * FROM r UNION SELECT node, node FROM n) GROUP BY node),
w AS (SELECT o.row_no, o.doc_id, o.line_no, g.class, coalesce(k.n_links, 0) AS n_links FROM o JOIN n USING (line) JOIN g USING (node) LEFT JOIN k ON k.a = n.node)
SELECT doc_id, line_no, first_value(doc_id) OVER c AS class_doc, first_value(line_no) OVER c AS class_line, CAST(n_links AS BIGINT) AS n_links, row_number() OVER c > 1 AS duplicate FROM w WINDOW c AS (PARTITION BY class ORDER BY doc_id, row_no, line_no)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": _chat(),
        "op5_pivot_top_k": _TOP_K,
        "op6_quality_rules": _quality(),
        "op7_segment_edit_join": _lines(),
        "op8_prefix_sum_shards": _SHARDS,
        "op9_chunked_warc": _WARC,
        "op10_weighted_mix": _mix(),
    }
