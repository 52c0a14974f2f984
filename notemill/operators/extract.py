"""Fields of fetched pages: serialized payloads, Open Graph tags, and what is chosen from them (PAR-1 to PAR-17, PAR-25, PAR-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import MEMO_ENTITIES, blank_to_null, decoded, id_from_url, trimmed

# The patterns that pages are searched with, and the limits.
PUSH = r"self\.__next_f\.push\(\s*(\[[\s\S]*?\])\s*\)"
PUSH_MARK = "self.__next_f.push"
CHUNK = r'^\[\s*\d+\s*,\s*"([\s\S]*)"\s*\]$'
BUILD = r"/_next/static/([^/]+)/"
TITLE = r'"noteTitle"\s*:\s*"([^"]+)"'
CREATED = r'"createdAt"\s*:\s*"(\d{4}-[^"]+)"'
MEMO = r'"memo"\s*:\s*"((?:[^"\\]|\\.)++)"'
SLIDES = r'"slides_url"\s*:\s*"([^"]+)"'
SLIDES_HOSTS = r"""(https?://(?:[a-z0-9-]+\.supabase\.co/storage/v1/object/sign|[a-z0-9-]+\.r2\.cloudflarestorage\.com)/[^\s"'\\]+)"""
NOTE_ID = r'"token"\s*:\s*"([0-9a-f-]{36})"'
LONG_STRING = r'"((?:[^"\\]|\\.){100,}+)"'
#: The same by the characters between the quotes, of which an escape has two: none of the first hundred ends the string.
LONG_RAW_STRING = r'"(?=(?:[^"]|(?<=[^\\](?:\\\\){0,50}\\)"){100})((?:[^"\\]|\\.)++)"'
SEGMENT_TEXT = r'"text"\s*:\s*"((?:[^"\\]|\\.){5,}+)"'
OG_TITLE = r'(?i)<meta\s+property="og:title"\s+content="([^"]*?)"\s*/?>'
OG_DESCRIPTION = r'(?i)<meta\s+property="og:description"\s+content="([^"]*?)"\s*/?>'
NOT_CONTENT = ("/_next/", "chunks/", ".js?dpl=", "$Sreact", "I[")
NOT_CONTENT_RAW = ("/_next/", "chunks/")
SUMMARY_LEAST = 200
SEGMENTS = "array<struct<segments:array<struct<text:string>>>>"


def json_string(inner: Column) -> Column:
    """The string that inner is between JSON's quotes; null if it is none."""
    return F.get(F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>"), 0)


def _replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescaped_chunk(raw: Column) -> Column:
    """PAR-2: the text of one chunk: decoded as JSON, else by four replacements; what is no chunk stays as it is."""
    inner = F.regexp_extract(raw, CHUNK, 1)
    by_hand = _replaced(inner, ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\"))
    return F.when(raw.rlike(CHUNK), F.coalesce(json_string(inner), by_hand)).otherwise(raw)


def clean_url(url: Column) -> Column:
    """PAR-8."""
    return F.regexp_replace(_replaced(url, ("\\u0026", "&"), ('\\"', "")), '"+$', "")


def first(pattern: str, text: Column) -> Column:
    """The first match's group, or null."""
    return blank_to_null(F.regexp_extract(text, pattern, 1))


def _contains_none(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~F.contains(x, F.lit(w))
    return out


def long_strings(payload: Column, pattern: str = LONG_STRING) -> Column:
    """PAR-9: decoded strings of 100 characters or more that look like content, the longest first. An escape is one character, or two with LONG_RAW_STRING."""
    found = F.regexp_extract_all(payload, F.lit(pattern), F.lit(1))
    as_struct = F.transform(found, lambda x, i: F.struct(json_string(x).alias("json"), _replaced(x, ("\\n", "\n"), ('\\"', '"')).alias("raw"), i.alias("i")))
    kept = F.filter(as_struct, lambda s: F.when(s["json"].isNotNull(), _contains_none(s["json"], NOT_CONTENT)).otherwise(_contains_none(s["raw"], NOT_CONTENT_RAW)))
    ranked = F.sort_array(F.transform(kept, lambda s: F.struct((-F.length(F.coalesce(s["json"], s["raw"]))).alias("n"), s["i"].alias("i"), F.coalesce(s["json"], s["raw"]).alias("text"))))
    return F.transform(ranked, lambda s: s["text"])


def longest(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """PAR-10, AGG-6 over a table: (key, order, n_chars) of each key's longest text that can be a summary, the first of equal ones."""
    rows = texts.where(may_be_summary(F.col(text)))
    best = rows.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("at"))).alias("b"))
    return best.select(key, (-F.col("b.at")).alias(order), F.col("b.n").cast("long").alias("n_chars"))


def may_be_summary(x: Column) -> Column:
    """PAR-10: whether a text is long and marked up enough to be a summary."""
    return (F.length(x) > SUMMARY_LEAST) & (F.contains(x, F.lit("##")) | F.contains(x, F.lit("**")))


def joined_texts(rows: DataFrame, key: str, order: str, text: str = "text", gap: str = " ") -> DataFrame:
    """AGG-5: (key, transcript, n): a key's trimmed texts that aren't empty, in order, as one. A key's texts meet in one row: keys are talks."""
    said = rows.withColumn("__t", trimmed(F.col(text))).where(F.col("__t") != "")
    return said.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "__t"))), lambda x: x["__t"]), gap).alias("transcript"), F.count(F.lit(1)).cast("int").alias("n"))


def linked_pages(html: Column) -> Column:
    """The different addresses that a page links to, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))


def transcript_of(chunks: Column) -> Column:
    """PAR-11: the texts of all transcript chunks, joined by a space; null if there are none."""
    is_transcript = lambda c: c.startswith("[{") & F.contains(c, F.lit('"segments"')) & F.contains(c, F.lit('"text"'))

    def pieces(c: Column) -> Column:
        parsed = F.from_json(c, SEGMENTS)
        texts = F.filter(F.transform(F.flatten(F.filter(F.transform(parsed, lambda g: g["segments"]), lambda s: s.isNotNull())), lambda s: trimmed(s["text"])), lambda t: t.isNotNull() & (t != ""))
        decoded_texts = F.filter(F.transform(F.regexp_extract_all(c, F.lit(SEGMENT_TEXT), F.lit(1)), json_string), lambda t: t.isNotNull() & (F.length(t) > 5) & ~F.contains(t, F.lit("/_next/")))
        return F.when(parsed.isNotNull(), texts).otherwise(F.transform(decoded_texts, trimmed))

    return blank_to_null(F.array_join(F.flatten(F.transform(F.filter(chunks, is_transcript), pieces)), " "))


def slides_url(unescaped: Column, raw: Column) -> Column:
    """PAR-7: the named field, else of the storage addresses in either payload the first that looks like slides, else the first."""
    here = F.regexp_extract_all(unescaped, F.lit(SLIDES_HOSTS), F.lit(1))
    urls = F.transform(F.when(F.size(here) > 0, here).otherwise(F.regexp_extract_all(raw, F.lit(SLIDES_HOSTS), F.lit(1))), clean_url)
    slides = F.filter(urls, lambda u: F.contains(u, F.lit("slides")) | F.contains(u, F.lit(".pdf")))
    return F.coalesce(blank_to_null(clean_url(first(SLIDES, unescaped))), F.get(slides, 0), F.get(urls, 0))


def parse_payload(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with the serialized payload's fields: summary, pdf_url, transcript, memo, title, created_at, note_id (PAR-1 to PAR-13).

    All null where the page has no payload. Row-local: no shuffle, no Python.
    """
    df = pages.withColumn("__raw", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(PUSH), F.lit(1)))
    df = df.withColumn("__chunks", F.transform("__raw", unescaped_chunk))
    df = df.withColumn("__payload", F.array_join("__chunks", "\n")).withColumn("__raw", F.array_join("__raw", "\n"))
    payload = F.col("__payload")
    candidates = F.filter(long_strings(payload), may_be_summary)
    raw_memo = first(MEMO, payload)
    memo = decoded(F.coalesce(json_string(raw_memo), _replaced(raw_memo, ("\\n", "\n"), ('\\"', '"'))), MEMO_ENTITIES)
    df = df.withColumn("summary", F.get(candidates, 0))
    df = df.withColumns(
        {
            "pdf_url": slides_url(payload, F.col("__raw")),
            "transcript": transcript_of(F.col("__chunks")),
            "memo": memo,
            "title": F.coalesce(first(TITLE, payload), trimmed(first(r"(?m)^#\s+(.+)$", F.col("summary")))),
            "created_at": first(CREATED, payload),
            "note_id": first(NOTE_ID, payload),
        }
    )
    return df.drop("__raw", "__chunks", "__payload")


def parse_meta(pages: DataFrame) -> DataFrame:
    """pages with og_title and og_summary, entities decoded (PAR-14), has_push and build_id (PAR-15)."""
    html = F.coalesce("html", F.lit(""))
    return pages.withColumns(
        {
            "og_title": F.when(html.rlike(OG_TITLE), decoded(F.regexp_extract(html, OG_TITLE, 1))),
            "og_summary": F.when(html.rlike(OG_DESCRIPTION), decoded(F.regexp_extract(html, OG_DESCRIPTION, 1))),
            "has_push": F.contains(html, F.lit(PUSH_MARK)),
            "build_id": first(BUILD, html),
        }
    )


def resolve(pages: DataFrame, suffix: str = "Notes", untitled: str = "Note ") -> DataFrame:
    """One row per page: the note's fields, chosen in the fixed order, its parse_quality, and error where nothing was found (PAR-16).

    The suffix after a bar is taken off the Open Graph title on the full path only.
    """
    df = parse_meta(parse_payload(pages))
    note_id = F.coalesce(blank_to_null(F.col("note_id")), id_from_url(F.col("url")))
    og = blank_to_null(trimmed(F.regexp_replace("og_title", rf"\s*\|\s*{suffix}$", "")))
    best = F.coalesce(blank_to_null(F.col("summary")), blank_to_null(F.col("memo")), F.lit(""))
    full = (best != "") | (F.coalesce("transcript", F.lit("")) != "")
    found = F.coalesce(blank_to_null(F.col("og_title")), blank_to_null(F.col("og_summary"))).isNotNull()
    df = df.withColumns({"__id": note_id, "__og": og, "__best": best, "__full": full, "__found": found})
    name = F.concat(F.lit(untitled), F.col("__id"))
    only_full = lambda c: F.when(F.col("__full"), F.col(c))
    return df.select(
        "url",
        F.col("__id").alias("note_id"),
        F.when(F.col("__full"), F.coalesce("__og", blank_to_null(F.col("title")), name)).when(F.col("__found"), F.coalesce(blank_to_null(F.col("og_title")), name)).alias("title"),
        F.when(F.col("__full"), F.col("__best")).when(F.col("__found"), F.coalesce("og_summary", F.lit(""))).alias("summary"),
        only_full("pdf_url").alias("pdf_url"),
        only_full("transcript").alias("transcript"),
        only_full("created_at").alias("created_at"),
        F.lit(None).cast("string").alias("visibility"),
        F.when(F.col("__full"), "full").when(F.col("__found"), "partial").alias("parse_quality"),
        F.when(~F.col("__full") & ~F.col("__found"), "no note data on the page").alias("error"),
    )


def as_json_lines(notes: DataFrame) -> DataFrame:
    """SRC-12: one JSON object per row."""
    return notes.select(F.to_json(F.struct(*notes.columns)).alias("value"))


def model_json(text: Column, schema: str) -> Column:
    """PAR-25: a model's answer without code fences, parsed; null if it is no JSON of the schema."""
    return F.from_json(trimmed(F.regexp_replace(text, r"```(?:json)?\s*", "")), schema)


CONCEPTS = "struct<concepts:array<struct<name:string,definition:string,relatedConcepts:array<string>,example:string,caution:string,lectureContext:string>>,tags:array<string>>"


def concept_answer(text: Column) -> Column:
    """PAR-26: concepts and tags from a model's answer: missing texts empty, empty optional ones null; null if concepts or tags are no arrays."""
    parsed = model_json(text, CONCEPTS)
    concepts = F.transform(
        parsed["concepts"],
        lambda c: F.struct(
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(c["definition"], F.lit("")).alias("definition"),
            F.coalesce(c["relatedConcepts"], F.array().cast("array<string>")).alias("related_concepts"),
            blank_to_null(c["example"]).alias("example"),
            blank_to_null(c["caution"]).alias("caution"),
            blank_to_null(c["lectureContext"]).alias("lecture_context"),
        ),
    )
    return F.when(parsed["concepts"].isNotNull() & parsed["tags"].isNotNull(), F.struct(concepts.alias("concepts"), parsed["tags"].alias("tags")))


def weak_answers(answers: DataFrame, short: int = 80) -> DataFrame:
    """FLT-4: answers (concepts: array) with short_definition and unrelated flags. They warn; no row is dropped."""
    short_one = F.exists("concepts", lambda c: F.length(c["definition"]) < short)
    alone = (F.size("concepts") >= 2) & F.exists("concepts", lambda c: F.size(c["related_concepts"]) == 0)
    return answers.withColumns({"short_definition": F.coalesce(short_one, F.lit(False)), "unrelated": F.coalesce(alone, F.lit(False))})
