"""Queries over the driver's tables, by name, and the SQL that gives the same rows. Those over payloads, notes and single functions are in modules of their own.

Each query maps a table to what an operator takes: pages to fetched pages; documents to the pages of as many decks as benchmark has seeds, lines of documents to slides and to concepts with their
relations; conversations to transcripts; events to calls and view events; orders to log records. All run over whole tables.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import calls, chunk, concepts, extract, log, merge, notes, relevance
from notemill.plans.registry import ORACLE_SQL, QUERIES, query, sql_at_sentence, sql_key, sql_linked, sql_page_text, sql_sanitized, sql_trim
from notemill.sources.files import kept, table
from notemill.streaming import events as view

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

HOSTS = ("www.thering.example.org", "m.therat.example.com", "blog.therat.example.com", "thther.example.org")
GAP_MS = 600_000
DELAY_US = 60_000_000
N_KEYS = 3
TRUNCATED, CHUNK_TOKENS = 1000, 256

_HOST_LIST = ", ".join(f"'{h}'" for h in HOSTS)


@query(
    rf"""
SELECT page_id, title, host, host IN ({_HOST_LIST}) AS allowed, note_id, CASE WHEN title <> '' THEN 'full' ELSE 'partial' END AS quality
FROM (SELECT page_id,
  {sql_trim("replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39))")} AS title,
  regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  coalesce(nullif(list_extract(string_split(url, '/'), -1), ''), 'unknown') AS note_id FROM pages)
"""
)
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    title = T.trimmed(T.decoded(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    host = F.try_parse_url("url", F.lit("HOST"))
    df = table(spark, d, "pages").select("page_id", title.alias("title"), host.alias("host"), T.allowed_host(F.col("url"), HOSTS).alias("allowed"), T.id_from_url(F.col("url")).alias("note_id"))
    return df.withColumn("quality", F.when(F.col("title") != "", "full").otherwise("partial"))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(extract.linked_pages(F.col("html"))).alias("link"))


@query(
    r"""
SELECT p_partkey, CASE WHEN code <> '' THEN upper(regexp_replace(code, '\s+', '', 'g')) ELSE regexp_extract(title, '^([^\s_-]*)', 1) END AS subject
FROM (SELECT p_partkey, title, regexp_extract(title, '(?i)([A-Z]{2,}[\s-]?[0-9]{2,})', 1) AS code FROM (SELECT p_partkey, replace(p_brand, '#', ' ') AS title FROM part))
"""
)
def subject_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.suggested_subject(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("subject"))


@query(f"SELECT name, {sql_sanitized('name')} AS file_name, {sql_key('name')} AS key FROM (SELECT p_name AS name FROM part UNION SELECT unnest(regexp_split_to_array(text, '[ \n]')) FROM documents)")
def concept_key(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[ \n]")).alias("name"))
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(words).distinct()
    return names.select("name", T.sanitized(F.col("name")).alias("file_name"), T.concept_key(F.col("name")).alias("key"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    """
SELECT doc_id, CASE WHEN t.conv_id IS NULL THEN 'keep' WHEN length(text) < 500 THEN 'generate' WHEN length(text) >= 2500 THEN 'skip' ELSE 'enhance' END AS action
FROM documents LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) t ON doc_id = t.conv_id
"""
)
def summary_action(spark: SparkSession, d: str) -> DataFrame:
    has = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("there").alias("transcript")).distinct()
    return table(spark, d, "documents").join(has, "doc_id", "left").select("doc_id", T.summary_action(F.col("text"), F.col("transcript")).alias("action"))


@query(
    f"""
SELECT doc_id, length(cut) AS n_chars, md5(cut) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= {TRUNCATED} THEN text
  ELSE substring(text, 1, {int(TRUNCATED * 0.7)}) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, {int(TRUNCATED * 0.3)}) END AS cut FROM documents)
"""
)
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", T.head_and_tail(F.col("text"), TRUNCATED).alias("cut"))
    return cut.select("doc_id", F.length("cut").cast("long").alias("n_chars"), F.md5(F.col("cut").cast("binary")).alias("digest"))


@query(
    rf"""
SELECT doc_id, length(cut) AS n_chars, md5(cut) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= {TRUNCATED} THEN text
  WHEN length(whole) - 1 > 0.6 * {TRUNCATED} THEN {sql_trim("whole")} ELSE {sql_trim("part")} END AS cut
  FROM (SELECT doc_id, text, substring(text, 1, {TRUNCATED}) AS part, regexp_extract(substring(text, 1, {TRUNCATED}), '(?s)^(.*[.?!]) ', 1) AS whole FROM documents))
"""
)
def sentence_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", T.at_sentence(F.col("text"), TRUNCATED).alias("cut"))
    return cut.select("doc_id", F.length("cut").cast("long").alias("n_chars"), F.md5(F.col("cut").cast("binary")).alias("digest"))


@query(
    """
SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, length(text) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n
  FROM documents WHERE length(text) > 200 AND (contains(text, '##') OR contains(text, '**'))) WHERE n = 1
"""
)
def longest_candidate(spark: SparkSession, d: str) -> DataFrame:
    return extract.longest(table(spark, d, "documents"), "source", "doc_id")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return extract.joined_texts(table(spark, d, "conversations"), "conv_id", "turn")


_TRANSCRIPTS = f"SELECT conv_id, string_agg(t, ' ' ORDER BY turn, t) AS transcript, count(*) AS n FROM (SELECT conv_id, turn, {sql_trim('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id"


@query(f"SELECT conv_id, transcript FROM ({_TRANSCRIPTS})")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).select("conv_id", "transcript")


@query(
    f"""
SELECT conv_id, CAST(i AS INTEGER) AS slide, nullif({sql_trim("substring(transcript, CAST(i * size + 1 AS BIGINT), size)")}, '') AS slice
FROM (SELECT conv_id, transcript, CAST(ceil(length(transcript) / n) AS BIGINT) AS size, unnest(range(n)) AS i FROM ({_TRANSCRIPTS}))
"""
)
def transcript_even_split(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).select("conv_id", F.posexplode(chunk.even_slices(F.col("transcript"), F.col("n"))).alias("slide", "slice"))


_TERMS = """(SELECT item_id, list(t ORDER BY pos)[1:40] AS terms FROM (SELECT item_id, t, min(i) AS pos FROM (SELECT item_id, unnest(found) AS t, generate_subscripts(found, 1) AS i FROM (
  SELECT item_id, list_transform(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9-]{3,}|[가-힣]{3,})', 1), lambda x: lower(x)) AS found FROM benchmark)) WHERE length(t) >= 4 GROUP BY item_id, t) GROUP BY item_id)"""


@query(f"SELECT item_id, array_to_string(terms, ',') AS terms FROM {_TERMS}")
def seed_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", relevance.seed_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    return rows.select("item_id", F.array_join("terms", ",").alias("terms"))


def _deck_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of as many decks as benchmark has items, dealt round, and each deck's seed."""
    seeds = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("deck_id"), F.col("text").alias("seed"))
    n = max(1, seeds.count())
    docs = table(spark, d, "documents").select((F.col("doc_id") % n).alias("deck_id"), F.floor(F.col("doc_id") / n).cast("int").alias("at"), "text")
    return docs.select("deck_id", (F.col("at") + 1).alias("page_num"), "text"), seeds


_PAGES = "(SELECT doc_id % n AS deck_id, CAST(doc_id // n + 1 AS INTEGER) AS page_num, text FROM documents, (SELECT count(*) AS n FROM benchmark))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Without the texts, which are long: they aren't needed to rank pages."""
    return relevance.scored_pages(*_deck_pages(spark, d)).select("deck_id", "page_num", "score")


_SCORED = rf"""(SELECT p.deck_id, page_num, text, least(length(text) / 80, 20.0) + 4 * len(list_filter(coalesce(terms, []), lambda t: contains(lower(text), t)))
  + CASE WHEN regexp_matches(lower(text), '{relevance.KEYWORDS}') THEN 8 ELSE 0 END + CASE WHEN page_num <= 3 THEN 5 ELSE 0 END AS score
  FROM (SELECT deck_id, page_num, {sql_page_text("text")} AS text FROM {_PAGES}) p LEFT JOIN {_TERMS} s ON s.item_id = p.deck_id WHERE text <> '')"""


@query(f"SELECT deck_id, page_num, CAST(score AS DOUBLE) AS score FROM {_SCORED}")
def page_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("deck_id", "page_num", F.col("score").cast("double").alias("score"))


_SELECTED = f"""(SELECT deck_id, page_num, text, score FROM (SELECT deck_id, page_num, text, score, row_number() OVER (PARTITION BY deck_id ORDER BY page_num) AS place FROM (
  SELECT deck_id, page_num, text, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, page_num) AS best FROM {_SCORED}) WHERE best <= 14 OR page_num <= 3) WHERE place <= 14)"""


@query(f"SELECT deck_id, page_num, score FROM {_SELECTED}")
def page_select(spark: SparkSession, d: str) -> DataFrame:
    return relevance.selected_pages(_scores(spark, d)).select("deck_id", "page_num", F.col("score").cast("double").alias("score"))


_LEFT = "greatest(least(900, 12000 - a.used), 0)"


@query(
    f"""
SELECT deck_id, array_to_string(f.lines, chr(10)) AS text, f.used AS used_chars, page_count, extracted_chars, extracted_chars > f.used AS truncated
FROM (SELECT deck_id, list_reduce(list({{'p': page_num, 't': text}} ORDER BY page_num), lambda a, x: CASE
    WHEN 12000 - a.used > 0 AND {sql_at_sentence("x.t", _LEFT)} <> '' THEN {{'used': CAST(a.used + length('[p.' || x.p || '] ' || {sql_at_sentence("x.t", _LEFT)}) AS INTEGER), 'lines': list_append(a.lines, '[p.' || x.p || '] ' || {sql_at_sentence("x.t", _LEFT)})}}
    ELSE a END, {{'used': CAST(0 AS INTEGER), 'lines': []::VARCHAR[]}}) AS f FROM {_SELECTED} GROUP BY deck_id)
JOIN (SELECT deck_id, max(page_num) AS page_count, sum(length({sql_page_text("text")})) AS extracted_chars FROM {_PAGES} GROUP BY deck_id) USING (deck_id)
"""
)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    pages, _ = _deck_pages(spark, d)
    chosen = relevance.with_page_texts(relevance.selected_pages(_scores(spark, d)), pages)
    return relevance.packed_context(chosen, relevance.deck_totals(pages))


@query(f"SELECT deck_id, max(page_num) AS page_count, CAST(sum(length({sql_page_text('text')})) AS BIGINT) AS extracted_chars FROM {_PAGES} GROUP BY deck_id")
def deck_totals(spark: SparkSession, d: str) -> DataFrame:
    return relevance.deck_totals(_deck_pages(spark, d)[0])


@query(f"SELECT deck_id, page_num, md5(t) AS digest FROM (SELECT deck_id, page_num, {sql_page_text('text')} AS t FROM {_PAGES}) WHERE t <> ''")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return relevance.page_rows(_deck_pages(spark, d)[0]).select("deck_id", "page_num", F.md5(F.col("text").cast("binary")).alias("digest"))


_PIECES = rf"""flatten(list_transform(string_split(text, chr(10)), lambda p: CASE WHEN ceil(length(p) / 4.0) > {CHUNK_TOKENS}
    THEN list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s, i: {{'t': s, 'g': ' ', 'need': ceil(length(CASE WHEN i = 1 THEN p ELSE s END) / 4.0)}}) ELSE [{{'t': p, 'g': chr(10), 'need': ceil(length(p) / 4.0)}}] END))"""


@query(
    f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, c AS text FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM (
  SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= {CHUNK_TOKENS} THEN [text] WHEN {sql_trim("f.now")} <> '' THEN list_append(f.out, {sql_trim("f.now")}) ELSE f.out END AS chunks FROM (
    SELECT doc_id, text, list_reduce({_PIECES}, lambda a, p: CASE WHEN a.tokens + p.need > {CHUNK_TOKENS} AND a.now <> ''
        THEN {{'now': p.t || p.g, 'tokens': CAST(ceil(length(p.t) / 4.0) AS BIGINT), 'out': list_append(a.out, {sql_trim("a.now")})}}
        ELSE {{'now': a.now || p.t || p.g, 'tokens': CAST(a.tokens + ceil(length(p.t) / 4.0) AS BIGINT), 'out': a.out}} END,
      {{'now': '', 'tokens': CAST(0 AS BIGINT), 'out': []::VARCHAR[]}}) AS f FROM documents)))
"""
)
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_rows(table(spark, d, "documents"), "doc_id", "text", CHUNK_TOKENS, paragraph="\n", gap="\n")


MODEL_TOKENS = 400
_LONG_PIECES = rf"""string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"""


def _sql_answer(prompt: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array({prompt}, '\s+'), lambda w: w <> '')[1:24], ' ') || ' #' || left(sha1(chr(0) || {prompt}), 8)"


@query(
    f"""
SELECT doc_id, {_sql_answer("said")} AS summary FROM (SELECT doc_id, string_agg({_sql_answer("c")}, chr(10) || chr(10) ORDER BY i) AS said FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM (
  SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= {int(0.8 * MODEL_TOKENS)} THEN [text] WHEN {sql_trim("f.now")} <> '' THEN list_append(f.out, {sql_trim("f.now")}) ELSE f.out END AS chunks FROM (
    SELECT doc_id, text, list_reduce({_LONG_PIECES}, lambda a, p: CASE WHEN a.tokens + ceil(length(p) / 4.0) > {int(0.6 * MODEL_TOKENS)} AND a.now <> ''
        THEN {{'now': p || ' ', 'tokens': CAST(ceil(length(p) / 4.0) AS BIGINT), 'out': list_append(a.out, {sql_trim("a.now")})}}
        ELSE {{'now': a.now || p || ' ', 'tokens': CAST(a.tokens + ceil(length(p) / 4.0) AS BIGINT), 'out': a.out}} END,
      {{'now': '', 'tokens': CAST(0 AS BIGINT), 'out': []::VARCHAR[]}}) AS f FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)))) GROUP BY doc_id)
"""
)
def summarized_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts on one line, so that only sentences part them; the offline provider summarises chunks, and then their summaries."""
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return calls.summarized(rows, calls.OfflineProvider(max_input_tokens=MODEL_TOKENS), "doc_id").select("doc_id", "summary")


SUBJECT_TOKENS = 2000
_PARTS = r"""(SELECT source, doc_id, regexp_replace(text, '^\n+|\n+$', '', 'g') AS t FROM documents)"""
_PART_PIECES = rf"""flatten(list_transform(regexp_split_to_array(text, '\n\n+'), lambda p: CASE WHEN ceil(length(p) / 4.0) > {int(0.6 * SUBJECT_TOKENS)}
    THEN list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s, i: {{'t': s, 'g': ' ', 'need': ceil(length(CASE WHEN i = 1 THEN p ELSE s END) / 4.0)}})
    ELSE [{{'t': p, 'g': chr(10) || chr(10), 'need': ceil(length(p) / 4.0)}}] END))"""


def _sql_level(texts: str) -> str:
    """A level of summaries over texts (source, text, n_levels): those that are too long become the joined summaries of their chunks."""
    return f"""(SELECT source, string_agg({_sql_answer("c")}, chr(10) || chr(10) ORDER BY i) AS text, any_value(n_levels) + 1 AS n_levels FROM (SELECT source, n_levels, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM (
  SELECT source, n_levels, CASE WHEN {sql_trim("f.now")} <> '' THEN list_append(f.out, {sql_trim("f.now")}) ELSE f.out END AS chunks FROM (
    SELECT source, n_levels, list_reduce({_PART_PIECES}, lambda a, p: CASE WHEN a.tokens + p.need > {int(0.6 * SUBJECT_TOKENS)} AND a.now <> ''
        THEN {{'now': p.t || p.g, 'tokens': CAST(ceil(length(p.t) / 4.0) AS BIGINT), 'out': list_append(a.out, {sql_trim("a.now")})}}
        ELSE {{'now': a.now || p.t || p.g, 'tokens': CAST(a.tokens + ceil(length(p.t) / 4.0) AS BIGINT), 'out': a.out}} END,
      {{'now': '', 'tokens': CAST(0 AS BIGINT), 'out': []::VARCHAR[]}}) AS f FROM {texts} WHERE ceil(length(text) / 4.0) > {int(0.8 * SUBJECT_TOKENS)}))) GROUP BY source
  UNION ALL SELECT source, text, n_levels FROM {texts} WHERE ceil(length(text) / 4.0) <= {int(0.8 * SUBJECT_TOKENS)})"""


@query(
    f"""
WITH level0 AS (SELECT source, string_agg(t, chr(10) || chr(10) ORDER BY doc_id) AS text, 0 AS n_levels FROM {_PARTS} WHERE t <> '' GROUP BY source),
level1 AS MATERIALIZED (FROM {_sql_level("level0")}), level2 AS MATERIALIZED (FROM {_sql_level("level1")}), level3 AS MATERIALIZED (FROM {_sql_level("level2")})
SELECT source, {_sql_answer("text")} AS summary, CAST(n_levels AS INTEGER) AS n_levels FROM level3
"""
)
def subject_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents summarised by the offline provider in as many levels as they need, in chunks that are cut across documents."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.btrim("text", F.lit("\n")).alias("text"))
    return calls.summarized_parts(docs, calls.OfflineProvider(max_input_tokens=SUBJECT_TOKENS), "source", "doc_id", kept).select("source", "summary", "n_levels")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return rows.select("doc_id", "ord", (F.col("ord") + 1).alias("slide_num"), T.content_hash(F.col("line")).alias("hash"))


_LINES = "(SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CAST(i AS INTEGER) AS slide_num, left(sha1(line), 8) AS hash FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"


@query(f"SELECT doc_id, slide_num, hash, left(sha1(doc_id || ':' || slide_num), 8) AS numbered FROM {_LINES}")
def slide_hash(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "slide_num", "hash", T.numbered_hash(F.col("doc_id").cast("string"), F.col("slide_num")).alias("numbered"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """A document's lines as the old deck, those of the document with the next id as the new one."""
    lines = _lines(spark, d)
    return merge.matched_sections(lines.withColumnRenamed("doc_id", "note"), lines.withColumn("note", F.col("doc_id") - 1))


_MATCHES = f"""(WITH l AS (FROM {_LINES}),
o AS (SELECT doc_id AS note, ord AS old_ord, slide_num AS old_slide, hash AS old_hash, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ord) AS k FROM l),
n AS (SELECT doc_id - 1 AS note, ord AS new_ord, slide_num AS new_slide, hash AS new_hash, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ord) AS k FROM l),
h AS (SELECT o.note, old_ord, old_slide, old_hash, new_ord, new_slide, new_hash FROM o JOIN n ON o.note = n.note AND old_hash = new_hash AND o.k = n.k),
ro AS (SELECT *, row_number() OVER (PARTITION BY note, old_slide ORDER BY old_ord) AS j FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.note = o.note AND h.old_ord = o.old_ord)),
rn AS (SELECT *, row_number() OVER (PARTITION BY note, new_slide ORDER BY new_ord) AS j FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.note = n.note AND h.new_ord = n.new_ord)),
f AS (SELECT coalesce(ro.note, rn.note) AS note, old_ord, old_slide, old_hash, new_ord, new_slide, new_hash FROM ro FULL JOIN rn ON ro.note = rn.note AND old_slide = new_slide AND ro.j = rn.j)
SELECT CASE WHEN old_slide <> new_slide THEN 'reorder' ELSE 'same' END AS kind, * FROM h UNION ALL
SELECT CASE WHEN old_ord IS NULL THEN 'insertion' WHEN new_ord IS NULL THEN 'deletion' ELSE 'drift' END AS kind, * FROM f)"""


@query(f"SELECT * FROM {_MATCHES}")
def slide_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


@query(
    f"""
SELECT *, n_old > 0 AND n_deletion > 0.5 * n_old AS replaced FROM (SELECT note, count(old_ord) AS n_old, count(new_ord) AS n_new, count(*) FILTER (kind = 'same') AS n_same, count(*) FILTER (kind = 'reorder') AS n_reorder,
  count(*) FILTER (kind = 'drift') AS n_drift, count(*) FILTER (kind = 'insertion') AS n_insertion, count(*) FILTER (kind = 'deletion') AS n_deletion FROM {_MATCHES} GROUP BY note)
"""
)
def deck_replaced(spark: SparkSession, d: str) -> DataFrame:
    return merge.deck_changes(_matches(spark, d))


@query(
    f"""
WITH l AS (SELECT doc_id, {sql_trim("line")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
c AS (SELECT DISTINCT doc_id AS note, line FROM l), n AS (SELECT doc_id - 1 AS note, line FROM l WHERE line <> '')
SELECT d.note, count(x.line) AS changed FROM (SELECT doc_id - 1 AS note FROM documents) d LEFT JOIN (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.note = n.note AND c.line = n.line)) x ON x.note = d.note GROUP BY d.note
"""
)
def line_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return merge.changed_lines(docs.select(F.col("doc_id").alias("note"), "text"), docs.select((F.col("doc_id") - 1).alias("note"), "text"))


def _concepts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first word of each line of documents as a concept that relates to the line's other words, and first words of benchmark as existing names."""
    lines = table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    # a line is split once, and only where its other words are used
    space = F.instr("said", " ")
    words = F.when(space > 0, F.split(F.substring("said", space + 1, F.length("said")), " ")).otherwise(F.array().cast("array<string>"))
    docs = lines.select(F.lit("all").alias("subject"), (F.col("doc_id") * (1 << 20) + F.col("line")).alias("ord"), F.substring_index("said", " ", 1).alias("name"), F.when(F.length("said") > 100, F.col("source")).otherwise("").alias("definition"), words.alias("related_concepts"), F.nullif(F.col("lang"), F.lit("en")).alias("example"), F.lit("").alias("caution"), F.lit(None).cast("string").alias("lecture_context"))
    existing = table(spark, d, "benchmark").select(F.lit("all").alias("subject"), F.col("item_id").alias("ord"), F.get(F.split("text", r"[ \n]"), 0).alias("name"))
    return docs, existing


_CONCEPTS = f"""existing AS (SELECT item_id AS ord, regexp_extract(text, '^([^ \n]*)', 1) AS name FROM benchmark),
canon AS (SELECT {sql_key("name")} AS k, arg_max(name, ord) AS canonical FROM existing GROUP BY 1),
lines AS (SELECT doc_id * 1048576 + i - 1 AS ord, source, lang, said, string_split(said, ' ') AS words FROM (SELECT doc_id, source, lang, unnest(l) AS said, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents))),
raw AS (SELECT ord, {sql_trim("words[1]")} AS raw, words[2:] AS rel, CASE WHEN length(said) > 100 THEN source ELSE '' END AS definition, nullif(lang, 'en') AS example FROM lines),
named AS (SELECT coalesce(canonical, raw) AS name, ord, rel, definition, example FROM raw LEFT JOIN canon ON {sql_key("raw")} = k WHERE raw <> ''),
merged AS (SELECT name, min(ord) AS first, coalesce(arg_min(definition, ord) FILTER (definition <> ''), '') AS definition, arg_min(example, ord) FILTER (example <> '') AS example, flatten(list(rel ORDER BY ord)) AS rel FROM named GROUP BY name)"""


@query(f"WITH {_CONCEPTS} SELECT name, first AS ord, definition, example, md5(array_to_string(rel, ' ')) AS related FROM merged")
def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = concepts.merged_concepts(*_concepts(spark, d))
    return merged.select("name", "ord", "definition", "example", F.md5(F.array_join("related_concepts", " ").cast("binary")).alias("related"))


_REL_KEY = sql_key("related")
_ALLOWED = f"SELECT lower(name) FROM names UNION SELECT lower({sql_sanitized('name')}) FROM names UNION SELECT {sql_key('name')} FROM names"


@query(
    f"""
WITH {_CONCEPTS},
each AS (SELECT name, r, min(i) AS place FROM (SELECT name, unnest(rel) AS r, generate_subscripts(rel, 1) AS i FROM merged) GROUP BY name, r),
named2 AS (SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY place) - 1 AS INTEGER) AS pos, coalesce(canonical, r) AS related FROM each LEFT JOIN canon ON {sql_key("r")} = k),
names AS (SELECT name FROM merged UNION SELECT name FROM existing), allowed AS ({_ALLOWED})
SELECT name, pos, related FROM named2 WHERE {_REL_KEY} <> {sql_key("name")} AND (lower(related) IN (FROM allowed) OR lower({sql_sanitized("related")}) IN (FROM allowed) OR {_REL_KEY} IN (FROM allowed))
"""
)
def relation_filter(spark: SparkSession, d: str) -> DataFrame:
    docs, existing = _concepts(spark, d)
    return concepts.filtered_relations(docs, existing, kept).select("name", "pos", "related")


@query("SELECT o_orderkey AS seq, o_custkey AS path FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY o_orderkey DESC LIMIT 20")
def valid_recent(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path"))
    return log.still_there(table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("path")), files)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC LIMIT 50")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return log.latest(table(spark, d, "events"), "user_id", "ts").orderBy(F.desc("ts")).limit(log.LOG_MOST).select("user_id", "event_id", "event_type")


_RECORDS = """(SELECT o_orderkey AS seq, CASE WHEN (o_orderkey // 7) % 3 > 0 THEN 'i' || (o_custkey % 97) END AS record_id, CASE WHEN (o_orderkey // 11) % 4 = 0 THEN '' ELSE 'u' || (o_custkey % 61) END AS url,
  'p' || (o_custkey % 83) AS path FROM orders)"""
_SAME_KEY = "coalesce(e.record_id, nullif(e.url, ''), e.path) = coalesce(r.record_id, nullif(r.url, ''), r.path)"


_HIT = """coalesce(list_position(list_transform(a.entries, lambda e: CASE WHEN e.record_id IS NOT NULL AND r.record_id IS NOT NULL THEN e.record_id = r.record_id
  WHEN e.url <> '' AND r.url <> '' THEN e.url = r.url ELSE e.path = r.path END), true), 0)"""


@query(
    f"""
WITH folded AS (SELECT list_reduce(list({{'seq': seq, 'record_id': record_id, 'url': url, 'path': path}} ORDER BY seq),
    lambda a, r: {{'entries': ([r] || list_filter(a.entries, lambda e, i: i <> {_HIT} AND NOT ({_SAME_KEY})))[1:50], 'updates': list_append(a.updates, {{'seq': r.seq, 'was_update': {_HIT} > 0}})}},
    {{'entries': []::STRUCT(seq BIGINT, record_id VARCHAR, url VARCHAR, path VARCHAR)[], 'updates': []::STRUCT(seq BIGINT, was_update BOOLEAN)[]}}) AS f FROM {_RECORDS})
SELECT u.seq AS seq, u.was_update AS was_update, list_position(seqs, u.seq) AS place FROM (SELECT unnest(f.updates) AS u, list_transform(f.entries, lambda e: e.seq) AS seqs FROM folded)
"""
)
def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records that have an id, a url or neither: which are updates, and their places in the last log."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda name, n: F.concat(F.lit(name), c % n)
    rows = table(spark, d, "orders").select(i.alias("seq"), F.when(F.floor(i / 7) % 3 > 0, part("i", 97)).alias("record_id"), F.when(F.floor(i / 11) % 4 == 0, "").otherwise(part("u", 61)).alias("url"), part("p", 83).alias("path"))
    updates, left = log.upserts(rows.limit(0), rows, kept)
    places = F.array_position(F.array(*map(F.lit, left)).cast("array<long>"), F.col("seq"))
    return updates.select("seq", "was_update", F.nullif(places.cast("int"), F.lit(0)).alias("place"))


@query("SELECT o_orderpriority AS subject, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS none FROM orders GROUP BY 1")
def period_counts(spark: SparkSession, d: str) -> DataFrame:
    return log.period_counts(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "subject"), period="o_orderstatus", first="F", second="O")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.lit("---\ntags: [x, "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n---\n"), F.col("text"))
    return table(spark, d, "documents").where(notes.in_period(content, "en")).select("doc_id")


_FIRST_WORD = "regexp_extract(text, '^([^ \n]*)', 1)"


@query(rf"SELECT doc_id, {sql_linked('text', _FIRST_WORD)} AS text, CAST(regexp_matches('[[' || {_FIRST_WORD} || ']]', '\[\[[^\]|#\n]+(\|[^\]]+)?\]\]') AS INTEGER) AS links FROM documents WHERE {_FIRST_WORD} <> ''")
def link_inject(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first word is a name that is linked wherever it stands."""
    word = F.regexp_extract("text", r"^([^ \n]*)", 1)
    docs = table(spark, d, "documents").where(word != "")
    return docs.select("doc_id", notes.linked(F.col("text"), F.array(word)).alias("text")).withColumn("links", F.size(notes.links(F.col("text"))))


class Moody(calls.OfflineProvider):
    """Refuses, fails or answers as the prompt's length says."""

    def generate_text(self, prompt: str, system: str = "") -> str:
        if len(prompt) % 5 == 1:
            raise calls.RateLimited("429")
        if len(prompt) % 5 == 2:
            raise calls.CallFailed("404")
        return super().generate_text(prompt, system)


@query(
    """
WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
o AS (SELECT *, CASE length(line) % 5 WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'fatal' ELSE 'success' END AS outcome FROM l),
r AS (SELECT *, sum(CAST(outcome = 'success' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
n AS (SELECT *, sum(CAST(outcome = 'rate_limit' AS INTEGER)) OVER (PARTITION BY doc_id, run ORDER BY i) AS hits FROM r),
s AS (SELECT *, min(CASE WHEN hits >= 3 THEN i END) OVER (PARTITION BY doc_id) AS stop FROM n)
SELECT doc_id AS deck_id, count(*) AS n_rows, count(*) FILTER (outcome = 'success') AS n_slides, sum(CASE WHEN outcome = 'rate_limit' THEN 2 ELSE 1 END)::BIGINT AS n_calls, max(stop)::INTEGER AS stopped_at FROM s WHERE stop IS NULL OR i <= stop GROUP BY doc_id
"""
)
def stopped_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs over documents' lines with a provider that refuses some: how many calls were really made, and where a deck was stopped."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("deck_id"), F.posexplode(F.split("text", "\n")).alias("at", "prompt")).select("deck_id", (F.col("at") + 1).alias("slide_num"), "prompt")
    said = calls.generated(rows, Moody(), ["deck_id", "slide_num"], in_order=("deck_id", "slide_num"), sleep=_no_wait, stamps=True)
    kind = F.when(F.col("error").isNull(), "success").otherwise(T.error_kind(F.col("error")))
    last = F.max_by(kind, "slide_num")
    each = said.groupBy("deck_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("answer").alias("n_slides"), F.sum(F.size("calls")).alias("n_calls"), F.max("slide_num").alias("last"), last.alias("kind"))
    whole = rows.groupBy("deck_id").agg(F.max("slide_num").alias("all"))
    refused = F.transform(F.sort_array(F.collect_list(F.struct("slide_num", kind.alias("k")))), lambda x: x["k"])
    runs = said.groupBy("deck_id").agg(F.aggregate(refused, F.lit(0), lambda n, k: F.when(k == "success", 0).otherwise(n + (k == "rate_limit").cast("int"))).alias("hits"))
    return each.join(whole, "deck_id").join(runs, "deck_id").select("deck_id", "n_rows", "n_slides", "n_calls", F.when(F.col("hits") >= calls.BREAK_AFTER, F.col("last")).alias("stopped_at"))


class Stubborn(calls.OfflineProvider):
    """Gives JSON only when it has been asked often enough, as the prompt's length says."""

    def __init__(self) -> None:
        super().__init__()
        object.__setattr__(self, "asked", [0])

    def generate_text(self, prompt: str, system: str = "") -> str:
        self.asked[0] += 1
        return f'```json\n{{"n": {len(prompt)}}}\n```' if self.asked[0] > len(prompt) % 4 else "Let me think."


def _with_key(key: str) -> Stubborn:
    return Stubborn()


def _checked(answer: dict[str, int]) -> dict[str, int]:
    """The answer, which has to have a number that isn't divisible by 7."""
    if answer["n"] % 7 == 0:
        raise ValueError("divisible by 7")
    return answer


@query("SELECT doc_id, CASE WHEN length(text) % 4 < 3 AND length(text) % 7 > 0 THEN '{\"n\": ' || length(text) || '}' END AS answer, NOT (length(text) % 4 < 3 AND length(text) % 7 > 0) AS failed FROM documents")
def checked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as prompts of a provider with two keys, whose answers are parsed, checked and asked for again."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    said, _ = calls.observed(calls.generated(rows, _with_key, ["doc_id"], validate=_checked, keys=("a", "b"), delay_s=0.0, sleep=_no_wait), "checked")
    return said.select("doc_id", "answer", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT doc_id, {_sql_answer('p')} AS answer FROM (SELECT doc_id, source || left(sha1(lang), 8) || left(sha1(text), 8) AS p FROM documents)")
def picture_answers(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that come with pictures (here the bytes of a document's language and text)."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("prompt"), F.array(F.col("lang").cast("binary"), F.col("text").cast("binary")).alias("images"))
    return calls.generated(rows, calls.provider("offline"), ["doc_id"], images_col="images").select("doc_id", "answer")


def _no_wait(seconds: float) -> None:
    """The waits of a run that nobody has to wait for."""


_BOOK = r"(SELECT name, min(ord) AS ord FROM (SELECT unnest(w) AS name, item_id * 1000 + generate_subscripts(w, 1) AS ord FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM benchmark)) WHERE length(name) >= 7 GROUP BY name)"


@query(
    f"""
WITH book AS MATERIALIZED (SELECT list({{'ord': ord, 'name': name}} ORDER BY ord) AS names FROM {_BOOK}),
found AS (SELECT doc_id, text, list_transform(list_filter(names, lambda n: contains(lower(text), n.name)), lambda n: n.name) AS names FROM documents, book)
SELECT doc_id, md5(list_reduce(names, lambda a, n: replace(replace(replace(replace(
    regexp_replace(a, '(?i)' || n, chr(5) || n || chr(6), 'g'), '[[' || chr(5) || n || chr(6), '[[' || n), chr(5) || n || chr(6) || ']]', n || ']]'), chr(5), '[['), chr(6), ']]'), text)) AS digest FROM found
"""
)
def link_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The long words of all benchmark texts, linked wherever they stand in documents."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("at", "name")).where("length(name) >= 7")
    book = words.select("name", (F.col("item_id") * 1000 + F.col("at") + 1).alias("ord"))
    return notes.linked_texts(table(spark, d, "documents").select("doc_id", "text"), book, "doc_id", "text", "name", "ord").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "rate_limit").when(kind == "purchase", "success").otherwise("other")
    return table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), outcome.alias("outcome"))


_CALLS = "(SELECT user_id, event_id, epoch_us(ts) AS arrival, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'purchase' THEN 'success' ELSE 'other' END AS outcome FROM events)"


@query(
    f"""
SELECT user_id, event_id, outcome, stop IS NOT NULL AS stopped FROM (SELECT *, min(CASE WHEN n >= 3 THEN arrival END) OVER (PARTITION BY user_id) AS stop FROM (
  SELECT *, sum(CAST(outcome = 'rate_limit' AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY arrival) AS n FROM (
    SELECT *, sum(CAST(outcome = 'success' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY arrival) AS run FROM {_CALLS}))) WHERE stop IS NULL OR arrival <= stop
"""
)
def breaker(spark: SparkSession, d: str) -> DataFrame:
    return calls.until_break(_calls(spark, d), "user_id", "arrival", kept).select("user_id", "event_id", "outcome", "stopped")


@query(
    f"""
SELECT user_id, event_id, CAST(i * {DELAY_US} + max(arrival - i * {DELAY_US}) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival, event_id) - 1 AS i FROM {_CALLS})
"""
)
def rate_spacing(spark: SparkSession, d: str) -> DataFrame:
    return calls.spaced(_calls(spark, d), "user_id", "arrival", DELAY_US, "event_id", kept).select("user_id", "event_id", "start")


@query(
    f"""
SELECT user_id, event_id, CAST(coalesce(sum(CAST(outcome = 'rate_limit' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % {N_KEYS} AS INTEGER) AS key_index FROM {_CALLS}
"""
)
def key_rotation(spark: SparkSession, d: str) -> DataFrame:
    return calls.rotated(_calls(spark, d), "user_id", "arrival", N_KEYS, kept).select("user_id", "event_id", "key_index")


@query(f"SELECT user_id, event_id FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) WHERE gap IS NULL OR gap >= {GAP_MS * 1000}")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return view.debounced(table(spark, d, "events"), ["user_id"], "ts", "event_id", kept, GAP_MS).select("user_id", "event_id")


_DEBOUNCED = f"(SELECT user_id, event_id, ts, CAST(value AS INTEGER) % 7 AS page FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM (SELECT user_id, event_id, ts, CAST(trunc(value) AS INTEGER) AS value FROM events)) WHERE gap IS NULL OR gap >= {GAP_MS * 1000})"


@query(
    f"""
SELECT user_id, x.id AS event_id, x.ts AS ts, x.page AS page FROM (SELECT user_id, unnest(f.out) AS x FROM (
  SELECT user_id, list_reduce(list({{'us': epoch_us(ts), 'id': event_id, 'ts': ts, 'page': page}} ORDER BY ts, event_id), lambda a, e: CASE
      WHEN e.us >= a.quiet AND e.page IS NOT NULL AND e.page <> 0 AND e.page IS DISTINCT FROM a.last THEN {{'last': e.page, 'quiet': e.us + {3 * GAP_MS * 1000}, 'out': list_append(a.out, e)}} ELSE a END,
    {{'last': CAST(NULL AS INTEGER), 'quiet': CAST(-4611686018427387904 AS BIGINT), 'out': []::STRUCT(us BIGINT, id BIGINT, ts TIMESTAMP, page INTEGER)[]}}) AS f FROM {_DEBOUNCED} GROUP BY user_id))
"""
)
def debounce_suppress(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value").cast("int") % 7).alias("page"))
    return view.suppressed(view.debounced(page, ["user_id"], "ts", "event_id", kept, GAP_MS), ["user_id"], "ts", "page", "event_id", 3 * GAP_MS)


_SIDES = "CASE WHEN event_type IN ('click', 'view') THEN 'l' ELSE 'r' END"
_FIRE = f"""CASE WHEN least(coalesce(a.ldue, {1 << 62}), coalesce(a.rdue, {1 << 62})) > e.us OR (a.ldue IS NULL AND a.rdue IS NULL) THEN a
  WHEN coalesce(a.ldue, {1 << 62}) <= coalesce(a.rdue, {1 << 62}) THEN {{'cur': a.lpage, 'quiet': CASE WHEN a.lpage IS DISTINCT FROM a.cur THEN a.ldue + {3 * GAP_MS * 1000} ELSE a.quiet END, 'ldue': NULL, 'lpage': NULL, 'lid': NULL, 'rdue': a.rdue, 'rpage': a.rpage, 'rid': a.rid,
    'out': CASE WHEN a.lpage IS DISTINCT FROM a.cur THEN list_append(a.out, {{'id': a.lid, 'due': a.ldue}}) ELSE a.out END}}
  ELSE {{'cur': a.rpage, 'quiet': CASE WHEN a.rpage IS DISTINCT FROM a.cur THEN a.rdue + {3 * GAP_MS * 1000} ELSE a.quiet END, 'ldue': a.ldue, 'lpage': a.lpage, 'lid': a.lid, 'rdue': NULL, 'rpage': NULL, 'rid': NULL,
    'out': CASE WHEN a.rpage IS DISTINCT FROM a.cur THEN list_append(a.out, {{'id': a.rid, 'due': a.rdue}}) ELSE a.out END}} END"""
_TAKE = f"""CASE WHEN e.us < a.quiet OR e.page IS NULL OR e.page = 0 OR e.page IS NOT DISTINCT FROM a.cur THEN a
  WHEN e.side = 'l' THEN {{'cur': a.cur, 'quiet': a.quiet, 'ldue': e.us + {GAP_MS * 1000}, 'lpage': e.page, 'lid': e.id, 'rdue': a.rdue, 'rpage': a.rpage, 'rid': a.rid, 'out': a.out}}
  ELSE {{'cur': a.cur, 'quiet': a.quiet, 'ldue': a.ldue, 'lpage': a.lpage, 'lid': a.lid, 'rdue': e.us + {GAP_MS * 1000}, 'rpage': e.page, 'rid': e.id, 'out': a.out}} END"""


@query(
    f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id AS id, {_SIDES} AS side, CAST(trunc(value) AS INTEGER) % 7 AS page FROM events),
steps AS (SELECT *, 0 AS step FROM e UNION ALL SELECT *, 1 FROM e UNION ALL SELECT *, 2 FROM e
  UNION ALL SELECT DISTINCT user_id, {1 << 61}::BIGINT, NULL, NULL, NULL, 0 FROM e UNION ALL SELECT DISTINCT user_id, {1 << 61}::BIGINT, NULL, NULL, NULL, 1 FROM e)
SELECT user_id, x.id AS event_id, x.due AS fired_at FROM (SELECT user_id, unnest(f.out) AS x FROM (
  SELECT user_id, list_reduce(list({{'us': us, 'id': id, 'side': side, 'page': page, 'step': step}} ORDER BY us, id, step), lambda a, e: CASE WHEN e.step < 2 THEN {_FIRE} ELSE {_TAKE} END,
    {{'cur': CAST(NULL AS INTEGER), 'quiet': CAST(-4611686018427387904 AS BIGINT), 'ldue': CAST(NULL AS BIGINT), 'lpage': CAST(NULL AS INTEGER), 'lid': CAST(NULL AS BIGINT), 'rdue': CAST(NULL AS BIGINT), 'rpage': CAST(NULL AS INTEGER), 'rid': CAST(NULL AS BIGINT),
      'out': []::STRUCT(id BIGINT, due BIGINT)[]}}) AS f FROM steps GROUP BY user_id))
"""
)
def view_sync(spark: SparkSession, d: str) -> DataFrame:
    """Events as those of a viewer with two sides: what becomes current, each side waiting for itself."""
    side = F.when(F.col("event_type").isin("click", "view"), "l").otherwise("r")
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", side.alias("side"), (F.col("value").cast("int") % 7).alias("page"))
    return view.synced(rows, ["user_id"], "side", "ts", "page", "event_id", GAP_MS, 3 * GAP_MS).select("user_id", "event_id", "fired_at")


@query(
    "SELECT source, count(*) AS n_lectures, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS digest, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM documents GROUP BY source"
)
def subject_rollup_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("subject"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    rolled = notes.exam_text(docs)
    sizes = docs.groupBy("subject").agg(F.ceil(F.sum(F.length("content")) / 4).alias("tokens"))
    return rolled.join(sizes, "subject").select(F.col("subject").alias("source"), "n_lectures", F.md5(F.col("text").cast("binary")).alias("digest"), "tokens")


from notemill.plans import notebooks, payloads, scalars  # noqa: E402,F401  they add their queries
