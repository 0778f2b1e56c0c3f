"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import BIT, POLICIES

OP2 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM docs),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n_repeat_words
        FROM (SELECT DISTINCT doc_id, i + k AS at FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
ln AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
lines AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines FROM ln GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 3 * n_bangs > n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END))::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

#: The checksum is computed byte by byte from its polynomial.
OP4 = """
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
b AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])),
        4294967295) AS text_crc32 FROM b, tab),
p AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_byte FROM c),
s AS (SELECT *, (((2 * first_byte + size) * 16) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

_RULES = ", ".join(f"('{p.name}', {p.version}, {p.mask}, '{r}', {BIT[r]})" for p in POLICIES for r in p.rules)
ABLATIONS = f"""
SELECT policy, version, rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS n_failed, count(*) FILTER (WHERE (failed & mask) = bit) AS n_failed_alone,
       count(*) FILTER (WHERE (failed & mask) = 0) AS n_kept
FROM ({OP2}), (VALUES {_RULES}) AS p(policy, version, mask, rule, bit) GROUP BY policy, version, rule
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_CRC_TABLE = """bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def _op13() -> str:
    """Edits as strings, ten digits of cost before the letters, so that the least string is the cheapest and then the least audit."""

    def plus(f: str, cost: str, letters: str) -> str:
        return f"CASE WHEN {f} IS NOT NULL THEN lpad((substr({f}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({f}, 11) || '{letters}' END"

    def when(condition: str, x: str) -> str:
        return f"CASE WHEN {condition} THEN {x} END"

    inserted = (
        "f0 AS g0, f1 AS g1, least(f2, " + ", ".join(plus(f, "5", "I") for f in ("f0", "f1", "f3")) + ") AS g2, least(f3, " + plus("f2", "5", "I") + ", "
        + plus("f0", "10", "II") + ", " + plus("f1", "10", "II") + ") AS g3"
    )  # fmt: skip
    stays, before = "NOT blank AND NOT duplicate", "least(g0, g1, g3)"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS initial FROM d),
s AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen,
        NOT regexp_matches(text, '[.!?][ 	-]*\z') AS unended, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM o),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, k, initial, pair, blank, seen AND NOT blank AS duplicate, unended AND NOT seen AND NOT blank AS truncated,
        CASE WHEN unended AND NOT seen AND NOT blank THEN 5 ELSE 0 END AS pen FROM s),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS k, '0000000000' AS f0, NULL::VARCHAR AS f1, NULL::VARCHAR AS f2, NULL::VARCHAR AS f3 FROM n
  UNION ALL SELECT conv_id, k, {plus("g0", "2", "D")}, least({plus("g1", "2", "D")}, {when(f"{stays} AND initial = 's'", plus("g0", "pen", "K"))}),
    least({plus("g2", "2", "D")}, {when(f"{stays} AND initial = 'u'", plus("b", "pen", "K"))}, {when(stays, plus("b", "pen + 1", "R"))}),
    least({plus("g3", "2", "D")}, {when(f"{stays} AND initial = 'a'", plus("g2", "pen", "K"))}, {when(stays, plus("g2", "pen + 1", "R"))})
  FROM (SELECT *, {before} AS b FROM (SELECT r.*, {inserted} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.k = dp.k + 1))),
e AS (SELECT conv_id, least(g0, g3) AS best FROM (SELECT dp.conv_id, {inserted} FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.rows = dp.k)),
a AS (SELECT conv_id, substr(best, 1, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM e),
p AS (SELECT conv_id, generate_subscripts(edits, 1) AS k, unnest(edits) AS edit FROM (SELECT conv_id, regexp_extract_all(audit || '.', 'I*[DKR.]') AS edits FROM a)),
q AS (SELECT p.conv_id, p.k, length(edit) - 1 AS ins, right(edit, 1) AS op, role, text FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k),
v AS (SELECT *, coalesce(sum(ins + CASE WHEN op IN ('K', 'R') THEN 1 ELSE 0 END) OVER before, 0) AS emitted,
        coalesce(sum(CASE WHEN op = 'K' AND starts_with(role, 's') THEN 1 ELSE 0 END) OVER before, 0) AS sys
      FROM q WINDOW before AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT conv_id, k, j, CASE WHEN j < ins THEN NULL WHEN op = 'K' THEN role END AS own, CASE WHEN j < ins THEN '' ELSE text END AS text, emitted - sys + j AS nth
      FROM (SELECT *, unnest(range(0, ins + CASE WHEN op IN ('K', 'R') THEN 1 ELSE 0 END)) AS j FROM v)),
t AS (SELECT conv_id, string_agg(coalesce(own, CASE WHEN nth % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k, j) AS repaired FROM l GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLES: dict[str, str] = {"op2_quality_ledger": OP2, "quality_ablations": ABLATIONS, "op4_byte_shards": OP4, "op12_stream_dedup": OP12, "op13_turn_fold": _op13()}
