"""Registered queries of the text operators, each over its whole table, with check SQL where DuckDB can state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, conversation_repair, decontaminate, html_text, near_dup, pii, quality, secret_scan, sharding, token_align, token_counts, tool_calls, url_filter
from marquee.llm.common import table

SHARDS = 40
TOKEN_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def _count_kind(spans: Column, kind: int | str) -> Column:
    """Spans of one kind. The function given to ``filter`` takes the element alone; a second argument would be its index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.exchanges(table(spark, sf_dir, "conversations")), repeats=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.histogram_sort(table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "doc_id", sharding.size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base")).alias("base_failed"),
        quality.passes("v1").alias("kept"), "n_lines", "n_exclaims", "n_echo_words", "failed",
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKEN_FILE))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count_kind(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKEN_FILE), public_tokenizers.path(PIECE_FILE))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_sharding, op3_quality, op4_token_counts, op5_html_text, op6_url_filter, op7_decontamination, op8_pii, op9_bpe,
    op10_near_duplicates, op11_conversation_repair, op12_token_alignment, op13_secret_scan,
)}

ORACLES: dict[str, str] = {}

# Runs of other characters than blanks, by the code points of the contract.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op1_tool_calls"] = """
WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, min(text) AS text FROM m WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(turn) AS result_turn, min(coalesce(text, '')) AS content
      FROM m WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.text, r.result_turn, r.content
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, CASE WHEN turn IS NOT NULL THEN 'reply' END AS name, turn, result_turn,
       CASE WHEN turn IS NOT NULL THEN 0 END AS level,
       CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN text = '' THEN ['text: empty'] ELSE []::VARCHAR[] END AS problems,
       '{"arguments":' || CASE WHEN turn IS NULL THEN '{"text":null}' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END
         || ',"id":' || to_json(call_id) || ',"name":' || CASE WHEN turn IS NULL THEN 'null' ELSE '"reply"' END
         || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM j
"""

ORACLES["op3_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pairs AS (SELECT r, i, w[i:i+4] AS win, len(w) AS n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE i + 4 <= len(w)),
twice AS (SELECT r, i FROM pairs QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
echo AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(w[:len(w)-1]) AS a, unnest(w[2:]) AS b FROM d) WHERE a = b GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
      length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims, coalesce(echo.n, 0)::BIGINT AS n_echo_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN echo USING (r)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
      + 8 * (100 * n_exclaims > 30 * n_words)::BIGINT + 16 * (100 * n_echo_words > 30 * n_words)::BIGINT
      + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (word_chars > 12 * n_words)::BIGINT + 128 * (n_words > 100000)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept,
       n_lines, n_exclaims, n_echo_words, failed
FROM f
"""

# Words are what is left after everything else became a blank.
_FOLDED = r"""[x FOR x IN string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') IF x <> '']"""

ORACLES["op7_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_FOLDED} AS w FROM benchmark),
t AS (SELECT DISTINCT item, least(10, len(w)) AS k, w[i:i+least(10, len(w))-1] AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, k, i, w[i:i+k-1] AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
h AS (SELECT p.r, p.i, p.k, t.item FROM p JOIN t ON p.k = t.k AND p.s = t.s),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS q FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i:i+1] ELSE w END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

# CRC-32 by its table; then the least (cost, audit, text) of each state, row by row. State 0: nothing, 1: after system,
# 2: after user, 3: after assistant.
ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([v] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t FROM range(256) r(v)),
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT m.*, xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(k, '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM m, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) c(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS c, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM f),
e AS (SELECT *, fault IN ('blank', 'duplicate') AS go, (fault = 'truncated')::BIGINT AS cut FROM g),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id),
p(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 'r': ''}, {'c': 1000000000::BIGINT, 'a': '', 'r': ''}, {'c': 1000000000::BIGINT, 'a': '', 'r': ''},
         {'c': 1000000000::BIGINT, 'a': '', 'r': ''} FROM n
  UNION ALL
  SELECT conv_id, i, {'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r},
    list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r}, CASE WHEN c = 's' AND NOT go THEN {'c': s0.c + cut, 'a': s0.a || 'K', 'r': s0.r || line} END]),
    list_min([{'c': t2.c + 3, 'a': t2.a || 'D', 'r': t2.r}]
      || [CASE WHEN c = 'u' AND NOT go THEN {'c': x.c + cut, 'a': x.a || 'K', 'r': x.r || line} END FOR x IN [s0, s1, t3]]
      || [CASE WHEN NOT go THEN {'c': x.c + 2 + cut, 'a': x.a || 'R', 'r': x.r || 'user:' || text || chr(10)} END FOR x IN [s0, s1, t3]]),
    list_min([{'c': t3.c + 3, 'a': t3.a || 'D', 'r': t3.r}, CASE WHEN c = 'a' AND NOT go THEN {'c': t2.c + cut, 'a': t2.a || 'K', 'r': t2.r || line} END,
      CASE WHEN NOT go THEN {'c': t2.c + 2 + cut, 'a': t2.a || 'R', 'r': t2.r || 'assistant:' || text || chr(10)} END])
  FROM (SELECT *, list_min([s3, {'c': t2.c + 2, 'a': t2.a || 'I', 'r': t2.r || 'assistant:' || chr(10)}]) AS t3
        FROM (SELECT p.*, e.i AS j, e.c, e.go, e.cut, e.text, e.role || ':' || e.text || chr(10) AS line,
              list_min([s2] || [{'c': x.c + 2, 'a': x.a || 'I', 'r': x.r || 'user:' || chr(10)} FOR x IN [s0, s1, s3]]) AS t2
              FROM (SELECT conv_id, i + 1 AS i, s0, s1, s2, s3 FROM p) p JOIN e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.i = e.i))),
w AS (SELECT n.*, list_min([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || 'assistant:' || chr(10)},
      {'c': s1.c + 4, 'a': s1.a || 'II', 'r': s1.r || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS b
      FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n),
u AS (SELECT DISTINCT conv_id FROM conversations)
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.r, greatest(length(b.r) - 1, 0)), '')) AS repaired_sha256
FROM u LEFT JOIN w ON u.conv_id IS NOT DISTINCT FROM w.conv_id
"""
