"""Column builders for text: names, keys, dates, hosts, hashes, entities, truncation. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names must not have, the entities that are decoded and their order, and limits.
FORBIDDEN_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]'
FORBIDDEN_IN_SLUGS = r'[<>:"/\\|?*]'
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
MEMO_ENTITIES = (("&amp;#x20;", " "), ("&#x20;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
ERROR_KINDS = (("rate_limit", "429|quota|한도 초과"), ("overload", "502|503|overload|UNAVAILABLE"), ("fatal", "401|403|404"))
CHARS_PER_TOKEN = 4
HEAD_SHARE, TAIL_SHARE = 0.7, 0.3
SENTENCE_SHARE = 0.6
TRANSCRIPT_MOST = 15_000
RATE_DELAY_DEFAULT, RATE_DELAY_LEAST = 4000, 1000


def trimmed(x: Column) -> Column:
    """x without Unicode white space at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    """The empty string as null, for coalesce()."""
    return F.nullif(x, F.lit(""))


def sanitized(name: Column) -> Column:
    """SCL-1: a name that can be a file's: forbidden characters and trailing dots removed, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(name, FORBIDDEN_IN_NAMES, ""), r"\.+$", ""))


def slug(text: Column) -> Column:
    """SCL-2: forbidden characters removed, white space as one space, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), FORBIDDEN_IN_SLUGS, ""), r"(?U)\s+", " "))


def concept_key(name: Column) -> Column:
    """SCL-6: the key under which spellings of one concept meet."""
    return key_of_sanitized(sanitized(name))


def key_of_sanitized(name: Column) -> Column:
    """concept_key() of a name that is sanitized already."""
    return F.regexp_replace(F.lower(name), r"(?U)[\s_-]+", "")


def subject_key(subject: Column) -> Column:
    """SCL-7."""
    return F.lower(sanitized(subject))


def lock_key(name: Column) -> Column:
    """SCL-8: the key that a concept's writers share."""
    return trimmed(F.lower(name))


def utc_date(ts: Column) -> Column:
    """SCL-3: yyyy-MM-dd; the session's time zone should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd")


def data_url_bytes(url: Column) -> Column:
    """SCL-4: the bytes of a base64 data URL."""
    return F.try_to_binary(F.split_part(url, F.lit(","), F.lit(2)), F.lit("base64"))


def token_estimate(text: Column) -> Column:
    """SCL-9: a token for each four characters, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def content_hash(data: Column) -> Column:
    """SCL-10: the first 8 hexadecimal digits of the SHA-1 of bytes or text."""
    return F.substring(F.sha1(data.cast("binary")), 1, 8)


def base64_hash(data: Column) -> Column:
    """SCL-10 of base64 text."""
    return F.substring(F.sha1(F.try_to_binary(data, F.lit("base64"))), 1, 8)


def numbered_hash(note_id: Column, number: Column) -> Column:
    """SCL-11: the hash of a note's id and a slide's number."""
    return content_hash(F.concat_ws(":", note_id, number.cast("string")))


def page_text(text: Column) -> Column:
    """SCL-12: white space as one space, words joined that a hyphen parts, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def decoded(text: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """SCL-14: entities replaced one after the other, ampersands first, so that twice-encoded text is decoded twice."""
    for name, value in entities:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def escaped_pattern(text: Column) -> Column:
    """SCL-15: text as a pattern that matches it alone."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escaped_replacement(text: Column) -> Column:
    """text as a replacement that stands for itself."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def error_kind(message: Column) -> Column:
    """SCL-16: what a provider's error message is about."""
    found = F.lit("other")
    for kind, pattern in reversed(ERROR_KINDS):
        found = F.when(message.rlike(pattern), kind).otherwise(found)
    return found


def kind_of_error(message: str) -> str:
    """SCL-16 for a message that Python holds."""
    return next((kind for kind, pattern in ERROR_KINDS if re.search(pattern, message)), "other")


def rate_delay(text: Column) -> Column:
    """SCL-19: a delay in milliseconds from user input: the leading integer, the default if there is none or 0, and the least value."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*([-+]?\d{1,9})", 1), F.lit("S999999999")).cast("int")
    return F.greatest(F.coalesce(F.nullif(number, F.lit(0)), F.lit(RATE_DELAY_DEFAULT)), F.lit(RATE_DELAY_LEAST))


def render_scale(width: Column, most: float = 1024) -> Column:
    """SCL-18: the scale at which a page of this width is drawn: no wider than most, no larger than twice."""
    return F.least(F.lit(float(most)) / width, F.lit(2.0))


def zoom(level: Column) -> Column:
    """SCL-18: a zoom level within its limits."""
    return F.least(F.greatest(level, F.lit(0.6)), F.lit(3.0))


def head_and_tail(text: Column, most: int, gap: str = "\n\n[...]\n\n") -> Column:
    """PRJ-3: the first 70 and last 30 hundredths of what may stay, with a mark between them."""
    head, tail = int(most * HEAD_SHARE), int(most * TAIL_SHARE)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(gap), F.right(text, F.lit(tail))))


def at_sentence(text: Column, most: Column | int) -> Column:
    """PRJ-4: text cut to its last sentence within the limit, if that keeps more than 60 hundredths; else cut there."""
    most = F.lit(most) if isinstance(most, int) else most
    part = F.substring(text, F.lit(1), most)
    whole = F.regexp_extract(part, r"(?s)^(.*[.?!]) ", 1)
    return F.when(F.length(text) <= most, text).when(F.length(whole) - 1 > SENTENCE_SHARE * most, trimmed(whole)).otherwise(trimmed(part))


def suggested_subject(title: Column) -> Column:
    """PRJ-1: a course code in the title, or what stands before its first space, hyphen or underscore."""
    code = F.regexp_extract(title, r"(?i)([A-Z]{2,}[\s-]?[0-9]{2,})", 1)
    return F.when(code != "", F.upper(F.regexp_replace(code, r"\s+", ""))).otherwise(F.get(F.split(title, r"[\s_-]"), 0))


def summary_action(summary: Column, transcript: Column, short: int = 500, long: int = 2500) -> Column:
    """PRJ-2: what is to be done with a note's summary."""
    n = F.length(F.coalesce(summary, F.lit("")))
    return F.when(F.coalesce(transcript, F.lit("")) == "", "keep").when(n < short, "generate").when(n >= long, "skip").otherwise("enhance")


def capped_transcript(transcript: Column, most: int = TRANSCRIPT_MOST) -> Column:
    """PRJ-2: what of a transcript is put in a prompt."""
    return F.substring(transcript, 1, most)


def allowed_host(url: Column, hosts: tuple[str, ...]) -> Column:
    """FLT-1: whether the URL's host is exactly one of hosts; false for what isn't a URL."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False))


def allowed_note_url(url: Column, domain: str, folder: str = "/note/") -> Column:
    """FLT-2: whether the URL is on the domain or below it, and its path in the folder."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(((host == domain) | host.endswith("." + domain)) & path.startswith(folder), F.lit(False))


def id_from_url(url: Column) -> Column:
    """PAR-17: what stands after the last slash, query and all."""
    return F.coalesce(blank_to_null(F.element_at(F.split(url, "/"), -1)), F.lit("unknown"))
