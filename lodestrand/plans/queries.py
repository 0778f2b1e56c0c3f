"""Registered queries of the extraction, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import detect as D
from ..operators import histories as H
from ..operators import normalize as N
from ..operators import strategies as S
from ..sources import block_files, derived, dims, snippets
from ..sources.documents import read_files, spread
from ..sources.tables import fresh_path, partitions
from .extract import EMPTY, NO_FILE, NOTHING, block_rows, extract, observed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.corpus(spread(table(spark, sf_dir, "documents")))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL of the shared pieces -------------------------------------------------------------------------------------

q = derived.quoted


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(T.EDGES)}, '', 'g')"


def sql_normalize(x: str) -> str:
    line = "l"
    for pattern, to in N.LINE_RULES:
        line = f"regexp_replace({line}, {q(pattern)}, {q(to.replace(chr(92), ''))}, 'g')"
    each = f"list_transform(string_split({x}, chr(10)), lambda l: {sql_trim(line)})"
    return sql_trim(f"array_to_string(list_filter({each}, lambda l: NOT regexp_matches(l, {q(N.PAGE_NUMBER)}) AND NOT starts_with(l, '##')), chr(10))")


def sql_drop(x: str) -> str:
    bare = f"regexp_replace(l, {q(T.LEFT_EDGE)}, '')"
    return sql_trim(f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT starts_with({bare}, '##')), chr(10))")


def counted_weights() -> dict[str, tuple[int, ...]]:
    """The detector's weights from plain counts of the training snippets."""
    found = [(lang, re.findall(D.TOKEN, text)) for lang, text in snippets.training()]
    spread_ = Counter(t for _, tokens in found for t in set(tokens))
    counts = {name: Counter() for name in (*D.LANGUAGES, snippets.NONE)}
    for lang, tokens in found:
        counts[lang].update(t for t in tokens if spread_[t] >= D.LEAST)
    kept = [t for t, n in spread_.items() if n >= D.LEAST]
    likely = {name: {t: log((c[t] + 1) / (c.total() + len(kept))) for t in kept} for name, c in counts.items()}
    return {t: tuple(round(D.TENTHS * (likely[name][t] - likely[snippets.NONE][t])) for name in D.LANGUAGES) for t in kept}


WEIGHTS = ", ".join(f"({q(t)}, {', '.join(map(str, w))})" for t, w in counted_weights().items())


def sql_detected(source: str, code: str = "code") -> str:
    """A query: source's columns and the detected language as `found`."""
    names, places = f"[{', '.join(map(q, D.LANGUAGES))}]", [f"w{k}" for k in range(len(D.LANGUAGES))]
    return (
        f"WITH s AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM (SELECT *, {sql_normalize(code)} AS clean FROM ({source}))), "
        f"g AS (SELECT rid, [{', '.join(f'sum({w})' for w in places)}] AS scores FROM (SELECT rid, unnest(regexp_extract_all(clean, {q(D.TOKEN)})) AS token FROM s) "
        f"JOIN (VALUES {WEIGHTS}) AS w(token, {', '.join(places)}) USING (token) GROUP BY rid) "
        f"SELECT s.* EXCLUDE (clean, rid), CASE WHEN length({sql_trim(code)}) < {D.SHORTEST} OR scores IS NULL OR list_max(scores) < {D.THRESHOLD * D.TENTHS} THEN 'unknown' "
        f"ELSE {names}[list_position(scores, list_max(scores))] END AS found FROM s LEFT JOIN g USING (rid)"
    )


CORPUS = derived.corpus_sql()
ANCHOR_RE2 = S.ANCHOR.replace("++", "+").replace("*+", "*")
ANCHORS = f"""
SELECT doc_id, nth, {sql_trim(f"CASE WHEN len(p) > 1 THEN p[1] ELSE substring(r, 1, {S.REACH}) END")} AS code FROM (
  SELECT doc_id, i - 1 AS nth, r,
         regexp_split_to_array(r, {q(S.ANCHOR_END)}) AS p FROM (
    SELECT doc_id, i, substring(text, 1 + CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT)) AS r
    FROM (SELECT doc_id, text, s, m, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, text, regexp_split_to_array(text, {q(ANCHOR_RE2)}) AS s, regexp_extract_all(text, {q(ANCHOR_RE2)}) AS m FROM ({CORPUS})))))
"""
ANCHOR_CLEAN = f"SELECT doc_id, nth, {sql_normalize('code')} AS code FROM (SELECT doc_id, nth, {sql_drop('code')} AS code FROM ({ANCHORS}) WHERE length(code) >= {D.SHORTEST}) WHERE length(code) >= {D.SHORTEST}"
ANCHOR_BLOCKS = f"SELECT doc_id, nth, found AS lang, code FROM ({sql_detected(ANCHOR_CLEAN)}) WHERE found <> 'unknown'"
FENCES = f"""
SELECT doc_id, nth, lower(coalesce(nullif(a, ''), c, '')) AS hint, {sql_trim("coalesce(nullif(b, ''), d, '')")} AS code FROM (
  SELECT doc_id, generate_subscripts(x1, 1) AS nth, unnest(x1) AS a, unnest(x2) AS b, unnest(x3) AS c, unnest(x4) AS d FROM (
    SELECT doc_id, {', '.join(f"regexp_extract_all(text, {q(S.FENCE)}, {k}) AS x{k}" for k in (1, 2, 3, 4))} FROM ({CORPUS})))
"""
FENCES = f"SELECT * FROM ({FENCES}) WHERE length(code) >= {D.SHORTEST}"
KNOWN = ", ".join(map(q, (*D.LANGUAGES, *D.ALIASES)))
FENCE_BLOCKS = f"SELECT doc_id, nth, CASE WHEN hint IN ({KNOWN}) THEN hint ELSE found END AS lang, code FROM ({sql_detected(FENCES)})"
NOTEBOOKS = f"""
SELECT doc_id, nth, {sql_trim("array_to_string(CAST(src AS VARCHAR[]), '')")} AS code FROM (
  SELECT doc_id, generate_subscripts(cells, 1) AS nth, unnest(cells) ->> '$.cell_type' AS kind, unnest(cells) -> '$.source' AS src FROM (
    SELECT doc_id, CAST(json_extract(CASE WHEN json_valid(text) THEN text END, '$.cells') AS JSON[]) AS cells FROM ({CORPUS})
    WHERE contains(text, '"source"') AND contains(text, '"cell_type"') AND json_valid(text))) WHERE kind = 'code'
"""
NOTEBOOKS = f"SELECT * FROM ({NOTEBOOKS}) WHERE length(code) >= {D.SHORTEST}"
NOTEBOOK_BLOCKS = f"SELECT doc_id, nth, found AS lang, code FROM ({sql_detected(NOTEBOOKS)}) WHERE found <> 'unknown'"
BLOCKS = f"""
WITH a AS ({ANCHOR_BLOCKS}), f AS ({FENCE_BLOCKS}), n AS ({NOTEBOOK_BLOCKS}),
u AS (SELECT * FROM a UNION ALL SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM a)
      UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM f))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INTEGER) AS index, lang, code,
       CAST(len(string_split(code, chr(10))) AS INTEGER) AS lines FROM u
"""


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_rows(extract(corpus(spark, sf_dir)))


def exploded(df: DataFrame, column, *fields: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(column).alias("nth", "x")).select("doc_id", F.col("nth").cast("bigint").alias("nth"), *(f"x.{f}" for f in fields))


# --- scalars ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, printf('%.1f', round(strlen(text) / 1024.0, 1)) AS kb FROM documents")
def size_kb(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.size_kb(F.octet_length("text")).alias("kb"))


@query("SELECT doc_id, CASE WHEN trim(n) <> '' THEN trim(n) WHEN string_split(m, '@')[1] <> '' THEN string_split(m, '@')[1] ELSE 'Pengguna' END AS shown FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || source || ' ' ELSE '  ' END AS n, CASE WHEN doc_id % 2 = 0 THEN lang || '@' || source ELSE '@x' END AS m FROM documents)")
def display_name(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise("  ")
    mail = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("@"), "source")).otherwise("@x")
    return table(spark, sf_dir, "documents").select("doc_id", T.display_name(name, mail).alias("shown"))


@query("SELECT event_id, coalesce(try_cast(regexp_extract(c, 'splash_at=([0-9]+)', 1) AS BIGINT), 0) AS last_millis, 9000000 - coalesce(try_cast(regexp_extract(c, 'splash_at=([0-9]+)', 1) AS BIGINT), 0) > 3600000 AS expired FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a=1; splash_at=' || (event_id * 1000) || '; b=2' ELSE 'a=1' END AS c FROM events)")
def splash_expired(spark, sf_dir):
    cookie = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a=1; splash_at="), (F.col("event_id") * 1000).cast("string"), F.lit("; b=2"))).otherwise("a=1")
    last = T.cookie_millis(cookie)
    return table(spark, sf_dir, "events").select("event_id", last.alias("last_millis"), T.expired(last, F.lit(9_000_000)).alias("expired"))


@query("SELECT event_id, day(ts) || ' ' || (['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agu','Sep','Okt','Nov','Des'])[month(ts)] || ' ' || year(ts) AS shown FROM events")
def date_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.display_date(F.col("ts")).alias("shown"))


@query(f"SELECT doc_id, lower(string_split(filename, '.')[-1]) AS ext, regexp_matches(filename, {q(T.ACCEPTED)}) AS accepted FROM ({CORPUS})")
def accepted_files(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", T.file_ext(F.col("filename")).alias("ext"), T.accepted(F.col("filename")).alias("accepted"))


# --- corpus and strategies ----------------------------------------------------------------------------------------


@query(CORPUS)
def derived_corpus(spark, sf_dir):
    return corpus(spark, sf_dir)


@query(f"SELECT doc_id, {sql_normalize('text')} AS code, CAST(len(string_split({sql_normalize('text')}, chr(10))) AS INTEGER) AS lines FROM ({CORPUS})")
def normalize_code(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("doc_id", N.normalize(F.col("text")).alias("code"))
    return docs.select("doc_id", "code", T.line_count(F.col("code")).alias("lines"))


@query(ANCHORS)
def anchor_candidates(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    found = docs.select("doc_id", F.posexplode(S.anchor_candidates(F.col("text"))).alias("nth", "code"))
    return found.select("doc_id", F.col("nth").cast("bigint").alias("nth"), "code")


@query(f"SELECT doc_id, nth - 1 AS nth, hint, code FROM ({FENCES})")
def fence_sections(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return exploded(docs, S.fence_sections(F.col("text")), "hint", "code")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS BIGINT) AS nth, lang, code FROM ({FENCE_BLOCKS})")
def fence_blocks(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return exploded(docs, S.fence_blocks(F.col("text")), "lang", "code")


@query(f"SELECT doc_id, found AS lang FROM ({sql_detected(CORPUS, 'text')})")
def detect_lang(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", D.detect(F.col("text")).alias("lang"))


LANG, SNIPPET = snippets.measured_sql("doc_id")


@query(f"SELECT doc_id, lang, code, found FROM ({sql_detected(f'SELECT doc_id, {LANG} AS lang, {SNIPPET} AS code FROM documents')})")
def detector_measured(spark, sf_dir):
    """A snippet for each document that the weights never saw: its language, and what is detected."""
    lang, code = snippets.measured(F.col("doc_id"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", lang.alias("lang"), code.alias("code"))
    return docs.withColumn("found", D.detect(F.col("code")))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (found = lang) AS n_found FROM ({ORACLES['detector_measured']}) GROUP BY lang")
def detector_recall(spark, sf_dir):
    return detector_measured(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("found") == F.col("lang")).alias("n_found"))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS BIGINT) AS nth, code FROM ({NOTEBOOKS})")
def notebook_cells(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    found = docs.select("doc_id", F.posexplode(S.notebook_codes(F.col("text"))).alias("nth", "code"))
    return found.select("doc_id", F.col("nth").cast("bigint").alias("nth"), "code")


#: What stands behind a notebook's JSON, by document: blanks only, or something that makes it none.
BEHIND = ("", " \n", " {}", "x", '"a"', "]", "\u00a0", ",")
STRICT = f"SELECT doc_id, text || ([{', '.join(map(q, BEHIND))}])[doc_id // 6 % {len(BEHIND)} + 1] AS text FROM ({CORPUS})"


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS BIGINT) AS nth, code FROM ({NOTEBOOKS.replace(CORPUS, STRICT)})")
def strict_notebooks(spark, sf_dir):
    """Cells of notebooks of which some have more than one JSON value."""
    behind = F.element_at(F.array(*map(F.lit, BEHIND)), (F.floor(F.col("doc_id") / 6) % len(BEHIND) + 1).cast("int"))
    docs = corpus(spark, sf_dir).withColumn("text", F.concat("text", behind))
    found = docs.select("doc_id", F.posexplode(S.notebook_codes(F.col("text"))).alias("nth", "code"))
    return found.select("doc_id", F.col("nth").cast("bigint").alias("nth"), "code")


#: Labels with emoji around the shortest length and around the reach; each emoji is two units.
EMOJI = (
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Kode a: ' || repeat('😀', 4) || repeat('z', 1 + CAST(doc_id // 4 % 3 AS INTEGER)) "
    "ELSE 'Syntax : ' || substr(coalesce(text, ''), 1, 1975 + doc_id % 20) || repeat('😀', CAST(doc_id % 13 AS INTEGER)) || coalesce(text, '') END AS text FROM documents"
)
_PAIRS = f"regexp_replace(r, '{T.ASTRAL}', chr(1) || chr(2), 'g')"
_REACH = f"replace(regexp_replace(substring({_PAIRS}, 1, {S.REACH}), '\\x01\\z', ''), chr(1) || chr(2), '😀')"


@query(
    f"SELECT doc_id, nth, code, n AS units FROM (SELECT *, length(code) + length(regexp_replace(code, '{T.ASTRAL.replace('[', '[^')}', '', 'g')) AS n "
    f"FROM ({ANCHORS.replace(CORPUS, EMOJI).replace(f'substring(r, 1, {S.REACH})', _REACH)})) WHERE n >= {D.SHORTEST}"
)
def unit_candidates(spark, sf_dir):
    """Labelled texts with characters of two units: what is long enough, and where the reach ends."""
    emoji = lambda n: F.repeat(F.lit("😀"), n)
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    short = F.concat(F.lit("Kode a: "), emoji(F.lit(4)), F.repeat(F.lit("z"), (F.floor(k / 4) % 3 + 1).cast("int")))
    long = F.concat(F.lit("Syntax : "), F.substr(text, F.lit(1), (1975 + k % 20).cast("int")), emoji((k % 13).cast("int")), text)
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.when(k % 4 == 0, short).otherwise(long).alias("text"))
    found = docs.select("doc_id", F.posexplode(S.anchor_candidates(F.col("text"))).alias("nth", "code")).where(T.has_units(F.col("code"), D.SHORTEST))
    return found.select("doc_id", F.col("nth").cast("bigint").alias("nth"), "code", T.units(F.col("code")).cast("bigint").alias("units"))


@query(BLOCKS)
def extract_blocks(spark, sf_dir):
    return rows_of(spark, sf_dir)


STATUS = f"""
SELECT doc_id, filename, size, CASE WHEN w <> 0 THEN w WHEN n > 0 THEN 200 ELSE 404 END AS status,
       CASE WHEN w = 400 THEN {q(NO_FILE)} WHEN w = 422 THEN {q(EMPTY)} WHEN n > 0 THEN NULL ELSE {q(NOTHING)} END AS error,
       CASE WHEN w = 0 AND n > 0 THEN CAST(n AS INTEGER) END AS total
FROM (SELECT c.doc_id, c.filename, c.size, coalesce(b.n, 0) AS n, CASE WHEN c.filename IS NULL THEN 400 WHEN {sql_trim('c.text')} = '' OR c.text IS NULL THEN 422 ELSE 0 END AS w
      FROM (SOURCE) c LEFT JOIN (SELECT doc_id, count(*) AS n FROM (BLOCKS_OF) GROUP BY doc_id) b USING (doc_id))
"""
#: Some documents without a name and some without a text, so that every status comes up.
FAULTY = f"SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN NULL ELSE filename END AS filename, size, CASE WHEN doc_id % 13 = 5 THEN ' ' || chr(10) ELSE text END AS text FROM ({CORPUS})"


def faulty(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "filename": F.when(F.col("doc_id") % 17 != 3, F.col("filename")),
        "text": F.when(F.col("doc_id") % 13 == 5, " \n").otherwise(F.col("text")),
    })


@query(STATUS.replace("SOURCE", FAULTY).replace("BLOCKS_OF", BLOCKS))
def extract_status(spark, sf_dir):
    return extract(faulty(corpus(spark, sf_dir))).select("doc_id", "filename", "size", "status", "error", "total")


@query(f"SELECT doc_id, 404 AS status, {q(NOTHING)} AS error FROM documents")
def raw_documents_status(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.lit("x.txt").alias("filename"), F.lit(1).alias("size"), "text")
    return extract(docs).select("doc_id", "status", "error")


# --- block lists --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, lang, min(index) AS first_index FROM ({BLOCKS}) GROUP BY doc_id, lang")
def langs_first_seen(spark, sf_dir):
    return B.langs_first_seen(rows_of(spark, sf_dir))


@query(f"SELECT * FROM ({BLOCKS}) WHERE lang = 'r'")
def filter_lang(spark, sf_dir):
    return B.filter_lang(rows_of(spark, sf_dir), "r")


CHOICE = "(['python', 'r', 'sql', 'java'])[doc_id % 4 + 1]"


@query(f"SELECT doc_id, {CHOICE} AS selected, arg_min(index, CASE WHEN lang = {CHOICE} THEN 0 ELSE 1000000 END + index) AS index, arg_min(lang, CASE WHEN lang = {CHOICE} THEN 0 ELSE 1000000 END + index) AS lang FROM ({BLOCKS}) GROUP BY doc_id")
def active_block(spark, sf_dir):
    docs = extract(corpus(spark, sf_dir)).where("status = 200")
    selected = F.element_at(F.array(*map(F.lit, ("python", "r", "sql", "java"))), (F.col("doc_id") % 4 + 1).cast("int"))
    chosen = docs.select("doc_id", selected.alias("selected"), B.active_block(F.col("blocks"), selected).alias("b"))
    return chosen.select("doc_id", "selected", "b.index", "b.lang")


VISIBLE = f"""
SELECT d.doc_id, d.filter, b.index, b.lang FROM (SELECT doc_id, (['all', 'python', 'sql', 'r'])[doc_id % 4 + 1] AS filter, doc_id % 3 AS wanted FROM documents) d
JOIN ({BLOCKS}) b USING (doc_id) WHERE d.filter IN ('all', b.lang)
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY CASE WHEN b.index = d.wanted THEN 0 ELSE 1 END, b.index) = 1
"""


@query(VISIBLE)
def active_visible(spark, sf_dir):
    docs = extract(corpus(spark, sf_dir)).where("status = 200")
    lang = F.element_at(F.array(*map(F.lit, ("all", "python", "sql", "r"))), (F.col("doc_id") % 4 + 1).cast("int"))
    chosen = docs.select("doc_id", lang.alias("filter"), B.active_visible(F.col("blocks"), lang, (F.col("doc_id") % 3).cast("int")).alias("b"))
    return chosen.where("b IS NOT NULL").select("doc_id", "filter", "b.index", "b.lang")


@query(f"SELECT lang, count(*) AS n_blocks FROM ({BLOCKS}) GROUP BY lang")
def filter_all(spark, sf_dir):
    return B.filter_lang(rows_of(spark, sf_dir), "all").groupBy("lang").agg(F.count("*").alias("n_blocks"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'MENUNGGU' WHEN 1 THEN 'GAGAL' WHEN 2 THEN 'MENUNGGU' ELSE (doc_id % 5 + 1) || ' BLOK' END AS state FROM documents")
def result_labels(spark, sf_dir):
    """All states: blocks found, an error, and neither (an error text that is empty is none)."""
    k = F.col("doc_id") % 4
    n_blocks = F.when(k == 3, F.col("doc_id") % 5 + 1).otherwise(0)
    error = F.when(k == 1, NOTHING).when(k == 2, "")
    return table(spark, sf_dir, "documents").select("doc_id", B.result_state(n_blocks, error).alias("state"))


DIM = f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in dims.LANGUAGES)}) AS t(id, label, emoji, color, ext))"


@query(f"SELECT doc_id, index, lang, coalesce(label, lang) AS label, coalesce(emoji, '📄') AS emoji, coalesce(ext, 'txt') AS ext FROM ({BLOCKS}) b LEFT JOIN {DIM} d ON b.lang = d.id")
def lang_lookup(spark, sf_dir):
    return B.with_language(rows_of(spark, sf_dir).select("doc_id", "index", "lang"), dims.languages(spark))


@query(f"SELECT doc_id, index, coalesce((SELECT first(ext) FROM {DIM} d WHERE d.id = {CHOICE}), 'py') AS ext, 'blocks_' || lang || '.' || coalesce((SELECT first(ext) FROM {DIM} d WHERE d.id = {CHOICE}), 'py') AS filename FROM ({BLOCKS})")
def download_names(spark, sf_dir):
    selected = F.element_at(F.array(*map(F.lit, ("python", "r", "sql", "java"))), (F.col("doc_id") % 4 + 1).cast("int"))
    ext = B.language_or_default(selected, 4, dims.LANGUAGES)
    return rows_of(spark, sf_dir).select("doc_id", "index", ext.alias("ext"), B.download_name(F.col("lang"), ext).alias("filename"))


TOGGLES = """
SELECT doc_id, len(v) > 0 AND list_has_all(s, v) AS every, array_to_string(list_sort(CASE WHEN len(v) > 0 AND list_has_all(s, v)
  THEN list_filter(s, lambda x: NOT list_contains(v, x)) ELSE list_distinct(list_concat(s, v)) END), ',') AS all_toggled,
  array_to_string(list_sort(CASE WHEN list_contains(s, 1) THEN list_filter(s, lambda x: x <> 1) ELSE list_append(s, 1) END), ',') AS one_toggled
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN []::INT[] WHEN 1 THEN [0, 1] ELSE [1, 2, 7] END AS s,
             CASE doc_id % 4 WHEN 0 THEN []::INT[] WHEN 1 THEN [0] WHEN 2 THEN [0, 1, 2] ELSE [7] END AS v FROM documents)
"""


@query(TOGGLES)
def toggle_selection(spark, sf_dir):
    ints = lambda *xs: F.array(*map(F.lit, xs)).cast("array<int>")
    k, j = F.col("doc_id") % 3, F.col("doc_id") % 4
    sel = F.when(k == 0, ints()).when(k == 1, ints(0, 1)).otherwise(ints(1, 2, 7))
    visible = F.when(j == 0, ints()).when(j == 1, ints(0)).when(j == 2, ints(0, 1, 2)).otherwise(ints(7))
    docs = table(spark, sf_dir, "documents").select("doc_id", sel.alias("s"), visible.alias("v"))
    text = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return docs.select(
        "doc_id", B.all_selected(F.col("v"), F.col("s")).alias("every"), text(B.toggle_all(F.col("v"), F.col("s"))).alias("all_toggled"),
        text(B.toggle(F.col("s"), F.lit(1))).alias("one_toggled"),
    )


@query(f"SELECT doc_id, index, lang FROM ({BLOCKS}) WHERE index IN (0, doc_id % 3)")
def selected_blocks(spark, sf_dir):
    sel = table(spark, sf_dir, "documents").select("doc_id", F.array(F.lit(0), (F.col("doc_id") % 3).cast("int")).alias("sel"))
    return B.selected_rows(rows_of(spark, sf_dir), sel).select("doc_id", "index", "lang")


@query(f"SELECT doc_id, lang, min(index) AS first_index, count(*) AS n_blocks, string_agg(code, {q(B.SEPARATOR)} ORDER BY index) AS content FROM ({BLOCKS}) GROUP BY doc_id, lang")
def merge_by_lang(spark, sf_dir):
    return B.merge_by_lang(rows_of(spark, sf_dir))


@query(
    f"SELECT doc_id, coalesce('blocks_' || lang || '.' || ext, 'blocks_' || lang || '.txt') AS filename, lang, content FROM (SELECT doc_id, lang, "
    f"string_agg(code, {q(B.SEPARATOR)} ORDER BY index) AS content FROM ({BLOCKS}) GROUP BY doc_id, lang) m LEFT JOIN {DIM} d ON m.lang = d.id"
)
def merged_files(spark, sf_dir):
    """The files of the merged download, written and read back."""
    path = fresh_path(spark, "merged")
    B.write_merged(rows_of(spark, sf_dir), dims.languages(spark), path)
    return spark.read.schema("doc_id bigint, filename string, content string, lang string").parquet(path)


@query(f"SELECT doc_id, CASE WHEN n > 0 THEN n || ' BLOK' ELSE 'GAGAL' END AS state, CASE WHEN n > 0 THEN CASE WHEN lang <> 'unknown' THEN lang ELSE 'python' END ELSE 'python' END AS next_lang, CAST(langs AS INTEGER) AS n_langs FROM (SELECT d.doc_id, coalesce(n, 0) AS n, b.lang AS lang, coalesce(langs, 0) AS langs FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, arg_min(lang, index) AS lang, count(DISTINCT lang) AS langs FROM ({BLOCKS}) GROUP BY doc_id) b USING (doc_id))")
def result_states(spark, sf_dir):
    docs = extract(corpus(spark, sf_dir))
    return docs.select(
        "doc_id", B.result_state(F.coalesce("total", F.lit(0)), F.col("error")).alias("state"), B.next_language(F.col("blocks"), F.lit("python")).alias("next_lang"),
        F.coalesce(F.when(F.col("blocks").isNotNull(), F.size(B.distinct_langs(F.col("blocks")))), F.lit(0)).alias("n_langs"),
    )


TOGGLED = f"""
WITH RECURSIVE a AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN event_id // 5 % 6 END AS i, CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id % 4 + 1 END AS v,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
h AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS k, []::BIGINT[] AS s, 0::BIGINT AS v FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL SELECT user_id, event_id, k, CASE WHEN i IS NOT NULL THEN CASE WHEN list_contains(s, i) THEN list_filter(s, lambda x: x <> i) ELSE list_append(s, i) END
    WHEN v > 0 AND list_has_all(s, range(v)) THEN list_filter(s, lambda x: x >= v) ELSE list_distinct(list_concat(s, range(v))) END, v
  FROM (SELECT a.*, h.s FROM h JOIN a ON a.user_id IS NOT DISTINCT FROM h.user_id AND a.k = h.k + 1))
SELECT event_id, len(s)::BIGINT AS n_selected, v > 0 AND list_has_all(s, range(v)) AS every FROM h WHERE k > 0
"""


@query(TOGGLED)
def selection_history(spark, sf_dir):
    """Events as clicks in a panel for each user: one in five toggles all visible blocks, the others one of six."""
    e, u = F.col("event_id"), F.col("user_id")
    index = F.when(e % 5 != 0, F.floor(e / 5) % 6)
    n_visible = F.when(u % 7 == 0, 0).otherwise(u % 4 + 1)
    events = table(spark, sf_dir, "events").select(u.alias("panel"), "ts", "event_id", index.alias("index"), (index < n_visible).alias("visible"), n_visible.alias("n_visible"))
    return H.selection_history(events, "ts", "event_id").select("event_id", "n_selected", "every")


SHOWN = """
WITH RECURSIVE v AS (SELECT event_id, user_id, epoch_ms(ts) AS t FROM events),
s AS (SELECT user_id, min(t) AS t FROM v GROUP BY user_id
  UNION ALL SELECT user_id, t FROM (SELECT s.user_id, min(v.t) AS t FROM s JOIN v ON v.user_id IS NOT DISTINCT FROM s.user_id AND v.t > s.t + 3600000 GROUP BY s.user_id)),
f AS (SELECT user_id, t, min(event_id) AS event_id FROM v JOIN s USING (user_id, t) GROUP BY user_id, t)
SELECT event_id, user_id, f.event_id IS NOT NULL AS shown FROM v LEFT JOIN f USING (event_id, user_id)
"""


@query(SHOWN)
def splash_shows(spark, sf_dir):
    """Events as visits: at which of them a user sees the splash screen."""
    visits = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))
    return H.splash_shows(visits).select(F.col("id").alias("event_id"), F.col("user").alias("user_id"), "shown")


@query(ORACLES["merged_files"])
def block_files_roundtrip(spark, sf_dir):
    """The files of the merged download as real text files, one for each document and language, and read back from them."""
    path = fresh_path(spark, "block-files")
    # So many tasks in any case: by their bytes, which are few, all files would be those of one or two tasks.
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism)
    rows = rows_of(spark, sf_dir).repartition(tasks, "doc_id", "lang")
    block_files.write_files(B.merged(rows, dims.languages(spark)), path)
    return block_files.read_files(spark, path, folders=1)


@query(
    f"SELECT 'status' AS kind, CAST(status AS VARCHAR) AS name, count(*) AS n FROM ({ORACLES['extract_status']}) GROUP BY status "
    f"UNION ALL SELECT 'lang', lang, count(*) FROM ({BLOCKS.replace(CORPUS, FAULTY)}) WHERE doc_id % 17 <> 3 AND doc_id % 13 <> 5 GROUP BY lang"
)
def observed_counts(spark, sf_dir):
    """Documents by status and blocks by language, counted while the results are written: no job of their own."""
    found, counts = observed(extract(faulty(corpus(spark, sf_dir))), (*D.LANGUAGES, *D.ALIASES, "unknown"))
    found.write.parquet(fresh_path(spark, "extracted"))
    return spark.createDataFrame(counts(), "kind string, name string, n bigint")


# --- static tables ------------------------------------------------------------------------------------------------


@query(f"SELECT id, label, emoji, color, ext, coalesce(n, 0) AS n_blocks FROM {DIM} d LEFT JOIN (SELECT lang, count(*) AS n FROM ({BLOCKS}) GROUP BY lang) b ON d.id = b.lang")
def languages(spark, sf_dir):
    """All languages of the static table, with the number of blocks that the corpus has in each."""
    counts = rows_of(spark, sf_dir).groupBy(F.col("lang").alias("id")).agg(F.count("*").alias("n"))
    return dims.languages(spark).join(counts, "id", "left").select("id", "label", "emoji", "color", "ext", F.coalesce("n", F.lit(0)).alias("n_blocks"))


@query(
    f"WITH b AS ({BLOCKS}) SELECT label, val, color FROM (VALUES {', '.join('(' + ', '.join(map(q, (r[0], r[2]))) + ')' for r in dims.STATS)}) AS t(label, color) JOIN ("
    f"SELECT {q(dims.STATS[0][0])} AS label, format('{{:,}}', count(*)) AS val FROM documents UNION ALL SELECT {q(dims.STATS[1][0])}, format('{{:,}}', count(*)) FROM b "
    f"UNION ALL SELECT {q(dims.STATS[2][0])}, format('{{:,}}', count(DISTINCT lang)) FROM b "
    f"UNION ALL SELECT {q(dims.STATS[3][0])}, printf('%.1f%%', floor(1000.0 * count(*) FILTER (found = lang) / count(*) + 0.5) / 10) FROM ({ORACLES['detector_measured']})) USING (label)"
)
def stats(spark, sf_dir):
    """The figures of the static table, counted instead of stated: documents, blocks, their languages, and what the detector gets right."""
    found = rows_of(spark, sf_dir).agg(F.count("*").alias("a"), F.count_distinct("lang").alias("b"))
    right = detector_measured(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("found") == F.col("lang")).alias("r"))
    share = F.format_string("%.1f%%", F.floor(1000.0 * F.col("r") / F.col("n") + 0.5) / 10)
    figure = lambda k, val: F.struct(F.lit(dims.STATS[k][0]).alias("label"), val.alias("val"))
    some = lambda df, *figures: df.select(F.inline(F.array(*figures)))
    # Both figures of the blocks come from one extraction.
    parts = (
        some(table(spark, sf_dir, "documents").agg(F.count("*").alias("n")), figure(0, F.format_number("n", 0))),
        some(found, figure(1, F.format_number("a", 0)), figure(2, F.format_number("b", 0))), some(right, figure(3, share)),
    )
    values = reduce(DataFrame.unionByName, parts)
    return dims.stats(spark).drop("val").join(values, "label").select("label", "val", "color")


RECENT = f"""
SELECT s.doc_id, coalesce(s.filename, '-') AS nama, upper(string_split(s.filename, '.')[-1]) AS jenis, coalesce(label, lang, '-') AS bahasa,
       CASE WHEN s.status = 200 THEN '✅ Berhasil' ELSE '❌ Gagal' END AS badge
FROM ({ORACLES['extract_status']}) s LEFT JOIN (SELECT doc_id, arg_min(lang, index) AS lang FROM ({BLOCKS.replace(CORPUS, FAULTY)}) GROUP BY doc_id) b ON b.doc_id = s.doc_id AND s.status = 200
LEFT JOIN {DIM} d ON d.id = b.lang
"""


@query(RECENT)
def recent_files(spark, sf_dir):
    """Documents as the list of recent files: name, type, language of the first block, and how it went."""
    found = extract(faulty(corpus(spark, sf_dir)))
    rows = found.select("doc_id", F.coalesce("filename", F.lit("-")).alias("nama"), F.upper(T.file_ext(F.col("filename"))).alias("jenis"), F.try_element_at("blocks", F.lit(1))["lang"].alias("first"), "status")
    ok = F.col("status") == 200
    named = B.with_language(rows, dims.languages(spark), "first")
    return named.select("doc_id", "nama", "jenis", F.coalesce("label", F.lit("-")).alias("bahasa"), B.status_badge(ok, F.when(ok, "Berhasil").otherwise("Gagal")).alias("badge"))


@query(f"SELECT * FROM ({RECENT}) ORDER BY doc_id DESC LIMIT 3")
def recent_limit(spark, sf_dir):
    """The three that came last."""
    return recent_files(spark, sf_dir).orderBy(F.desc("doc_id")).limit(3)


@query()
def read_binary(spark, sf_dir):
    """The table files themselves as uploads: none is text, so each is an error row."""
    files = read_files(spark, f"{sf_dir}/region.parquet").select("filename", "size", "text", "error")
    return extract(files.withColumn("doc_id", F.lit(0))).select("filename", "size", "status", "error")
