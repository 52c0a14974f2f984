"""Queries over single functions: names, dates, bytes, errors, settings, addresses, answers of models, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import extract, prompts
from notemill.plans.registry import query, sql_sanitized, sql_trim
from notemill.sources.files import fetched_pages, table

#: A name with everything that a file's name must not have.
_ODD = """'  ' || p_name || ' <a>:"' || p_brand || '|?*' || chr(9) || '  ' || p_type || '\\/. ... '"""


@query(
    rf"""
SELECT p_partkey, {sql_sanitized("x")} AS file_name, {sql_trim(rf"regexp_replace(regexp_replace({sql_trim('x')}, '[<>:{chr(34)}/\\|?*]', '', 'g'), '\s+', ' ', 'g')")} AS slug,
  lower({sql_sanitized("x")}) AS subject_key, {sql_trim("lower(x)")} AS lock_key FROM (SELECT p_partkey, {_ODD} AS x FROM part)
"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("  "), "p_name", F.lit(' <a>:"'), "p_brand", F.lit("|?*\t  "), "p_type", F.lit("\\/. ... "))
    return table(spark, d, "part").select("p_partkey", T.sanitized(x).alias("file_name"), T.slug(x).alias("slug"), T.subject_key(x).alias("subject_key"), T.lock_key(x).alias("lock_key"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def utc_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.utc_date(F.col("ts")).alias("day"))


@query("SELECT doc_id, md5(text) AS digest, left(sha1(text), 8) AS hash FROM documents")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Texts as base64 data URLs, and back."""
    coded = F.base64(F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.data_url_bytes(F.concat(F.lit("data:text/plain;base64,"), coded))).alias("digest"), T.base64_hash(coded).alias("hash"))


_MESSAGE = "event_type || ' HTTP ' || (400 + event_id % 120) || CASE event_id % 9 WHEN 0 THEN ' model overload' WHEN 1 THEN ' quota exceeded' ELSE '' END"


@query(
    f"""
SELECT event_id, CASE WHEN regexp_matches(m, '429|quota|한도 초과') THEN 'rate_limit' WHEN regexp_matches(m, '502|503|overload|UNAVAILABLE') THEN 'overload' WHEN regexp_matches(m, '401|403|404') THEN 'fatal' ELSE 'other' END AS kind
FROM (SELECT event_id, {_MESSAGE} AS m FROM events)
"""
)
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    code = (F.lit(400) + F.col("event_id") % 120).cast("string")
    which = F.col("event_id") % 9
    message = F.concat("event_type", F.lit(" HTTP "), code, F.when(which == 0, " model overload").when(which == 1, " quota exceeded").otherwise(""))
    return table(spark, d, "events").select("event_id", T.error_kind(message).alias("kind"))


@query(
    r"""
SELECT event_id, greatest(coalesce(nullif(TRY_CAST(regexp_extract(x, '^\s*([-+]?[0-9]{1,9})', 1) AS INTEGER), 0), 4000), 1000) AS delay, least(1024.0 / (1 + event_id % 3000), 2.0) AS scale, least(greatest(value / 20, 0.6), 3.0) AS zoom
FROM (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' || event_id || 'ms' WHEN 2 THEN '-' || event_id WHEN 3 THEN '0' ELSE CAST(event_id * 7 AS VARCHAR) END AS x FROM events)
"""
)
def settings_limits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x = F.when(i % 5 == 0, "abc").when(i % 5 == 1, F.concat(F.lit(" "), i.cast("string"), F.lit("ms"))).when(i % 5 == 2, F.concat(F.lit("-"), i.cast("string"))).when(i % 5 == 3, "0").otherwise((i * 7).cast("string"))
    return table(spark, d, "events").select("event_id", T.rate_delay(x).alias("delay"), T.render_scale(1 + i % 3000).alias("scale"), T.zoom(F.col("value") / 20).alias("zoom"))


@query(r"SELECT page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS pattern, true AS matches FROM pages")
def escaped_patterns(spark: SparkSession, d: str) -> DataFrame:
    pattern = T.escaped_pattern(F.col("url"))
    return table(spark, d, "pages").select("page_id", pattern.alias("pattern"), F.regexp_like("url", F.concat(F.lit("^"), pattern, F.lit("$"))).alias("matches"))


@query(
    r"""
SELECT page_id, (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en') AS allowed
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
"""
)
def note_addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.allowed_note_url(F.col("url"), "example.org", "/en").alias("allowed"))


@query(
    r"""
SELECT page_id, CASE WHEN ok THEN md5(html) END AS digest, CASE WHEN NOT ok THEN 'host not allowed' END AS error
FROM (SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) IN ('thther.example.org', 'm.ththth.example.net') AS ok FROM pages)
"""
)
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = fetched_pages(table(spark, d, "pages"), ("thther.example.org", "m.ththth.example.net"))
    return rows.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"), "error")


@query("SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' AS value FROM part")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return extract.as_json_lines(rows).select(F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"), "value")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model: two concepts for each document, in code fences; every seventh isn't JSON."""
    concept = lambda name, related: F.struct(name.alias("name"), F.substring("text", 1, 100).alias("definition"), related.alias("relatedConcepts"), F.nullif(F.col("lang"), F.lit("en")).alias("example"), F.lit("").alias("caution"))
    none = F.array().cast("array<string>")
    both = F.array(concept(F.col("source"), F.array("lang")), concept(F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).otherwise(none)))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(both.alias("concepts"), F.array("lang").alias("tags"))), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "no JSON at all").otherwise(answer).alias("answer"))


@query(
    """
SELECT doc_id, i AS place, CASE i WHEN 0 THEN source ELSE '' END AS name, left(text, 100) AS definition, CASE WHEN i = 0 THEN lang WHEN doc_id % 2 = 0 THEN source ELSE '' END AS related,
  nullif(lang, 'en') AS example, CAST(NULL AS VARCHAR) AS caution, lang AS tags, length(text) < 80 AS short_definition, doc_id % 2 <> 0 AS unrelated
FROM documents, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 7 <> 0
"""
)
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).select("doc_id", extract.concept_answer(F.col("answer")).alias("a")).select("doc_id", "a.concepts", "a.tags").where("concepts is not null")
    rows = extract.weak_answers(rows)
    each = rows.select("doc_id", F.posexplode("concepts").alias("place", "c"), "tags", "short_definition", "unrelated")
    return each.select("doc_id", "place", "c.name", "c.definition", F.array_join("c.related_concepts", ",").alias("related"), "c.example", "c.caution", F.array_join("tags", ",").alias("tags"), "short_definition", "unrelated")


def _cut(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE substring({x}, 1, {int(most * 0.7)}) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right({x}, {int(most * 0.3)}) END"


_FORM = '{"concepts": [{"name": "", "definition": "", "relatedConcepts": [], "example": "", "caution": "", "lectureContext": ""}], "tags": []}'


@query(
    f"""
SELECT doc_id, md5('Write lecture notes in Markdown from this transcript.' || chr(10) || 'Title: ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Summary so far: ' || lang || chr(10) ELSE '' END || 'Transcript:' || chr(10) || substring(text, 1, 15000)) AS transcript,
  md5('Improve these lecture notes by the pages below. Cite pages as [p.N].' || chr(10) || 'Title: ' || source || chr(10) || 'Known concepts: ' || names || chr(10) || 'Pages:' || chr(10) || {_cut("text", 12000)}) AS material,
  md5('Explain this slide to a student in a few sentences.' || chr(10) || 'Lecture: ' || source || chr(10) || 'Slide ' || doc_id || ' of ' || (doc_id + 1) || chr(10) || 'Known concepts: ' || names || chr(10) || 'Said: ' || lang) AS slide,
  md5('List the concepts of this text as JSON, and nothing else, in this form:' || chr(10) || '{_FORM}' || chr(10) || 'Use these names where they fit: ' || names || chr(10) || 'Text:' || chr(10) || {_cut("text", 12000)}) AS concepts,
  md5('Write a summary to learn from for an exam.' || chr(10) || 'Subject: ' || source || chr(10) || CASE WHEN lang <> 'en' THEN 'Period: ' || lang || chr(10) ELSE '' END || 'Notes:' || chr(10) || text) AS exam
FROM (SELECT *, array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:100], ', ') AS names FROM documents)
"""
)
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    names = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    digest = lambda x, name: F.md5(x.cast("binary")).alias(name)
    i, text, title = F.col("doc_id"), F.col("text"), F.col("source")
    return table(spark, d, "documents").select(
        "doc_id",
        digest(prompts.transcript_prompt(title, text, F.when(i % 2 == 0, F.col("lang")).otherwise("")), "transcript"),
        digest(prompts.material_prompt(title, text, names), "material"),
        digest(prompts.slide_prompt(title, i, i + 1, F.col("lang"), names), "slide"),
        digest(prompts.concepts_prompt(text, names), "concepts"),
        digest(prompts.exam_prompt(title, F.nullif(F.col("lang"), F.lit("en")), text), "exam"),
    )
