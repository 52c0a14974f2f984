"""Parsing and building of Markdown notes (PAR-18 to PAR-24, PRJ-5 to PRJ-10, PRJ-12).

Marker names and headings are parameters in Labels, so that any note dialect of this form can be read and written.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import blank_to_null, escaped_pattern, escaped_replacement, trimmed
from notemill.sources.files import kept


@dataclass(frozen=True)
class Labels:
    """What a note's dialect calls things. The words of headings and fields are fixed values of the note format."""

    tag: str = "note"
    id_field: str = "note_id"
    created_field: str = "note_created"
    slide: str = "📚 슬라이드"
    memo: str = "내 메모"
    orphans: str = "🗑️ 삭제된 슬라이드 (orphan)"
    failed: str = "⚠️ 처리 실패 슬라이드"
    failed_item: str = "슬라이드"
    backup: str = "이전 노트 백업"
    backup_note: str = "이 내용은 관리 구간이 도입되기 전의 기존 노트입니다."
    no_summary: str = "내용을 추출할 수 없습니다."
    definition: str = "**정의:**"
    context: str = "**강의 맥락:**"
    example: str = "**예시:**"
    caution: str = "**주의:**"
    lectures: str = "**관련 강의:**"
    related: str = "**관련 개념:**"

    @property
    def start(self) -> str:
        return f"<!-- {self.tag}:start -->"

    @property
    def end(self) -> str:
        return f"<!-- {self.tag}:end -->"

    @property
    def marker(self) -> str:
        return rf"<!-- {re.escape(self.tag)}:slide:(\d+) hash:([0-9a-f]{{8}})(?: dup:(\d+))? (start|end) -->"

    @property
    def heading(self) -> str:
        return rf"(^|\n)## {re.escape(self.slide)} \d+"


LABELS = Labels()
FRONTMATTER = r"^---\n[\s\S]*?\n---\n*"
LINK = r"\[\[([^\]|#\n]+?)(?:\|[^\]]+)?\]\]"


def frontmatter(content: Column) -> Column:
    """PAR-18: the leading block between three hyphens, with the line ends after it."""
    return F.regexp_extract(content, FRONTMATTER, 0)


def split_managed(content: Column, labels: Labels = LABELS) -> Column:
    """PAR-19: struct of frontmatter, before, managed, after; the last three are empty where the markers are missing or inverted."""
    front = frontmatter(content)
    a, b = F.locate(labels.start, content), F.locate(labels.end, content)
    whole = (a > 0) & (b > 0) & (b >= a)
    stop = b + len(labels.end)
    part = lambda start, size: F.when(whole, F.substring(content, start, size)).otherwise("")
    return F.struct(
        F.regexp_replace(front, r"(?U)\s+$", "").alias("frontmatter"),
        part(F.length(front) + 1, F.greatest(a - F.length(front) - 1, F.lit(0))).alias("before"),
        F.regexp_replace(part(a, stop - a), r"(?U)\s+$", "").alias("managed"),
        part(stop, F.length(content)).alias("after"),
    )


def has_sections(content: Column, labels: Labels = LABELS) -> Column:
    """PAR-21: whether any slide marker is there."""
    return content.rlike(labels.marker)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once; a column of its own would be put in wherever it is used when a filter is pushed down."""
    return F.get(F.transform(F.array(value), f), 0)


def _until_heading(x: Column, labels: Labels) -> Column:
    """x up to the first slide heading."""
    return F.when(x.rlike(labels.heading), F.regexp_extract(x, rf"^([\s\S]*?(^|\n))(?=## {re.escape(labels.slide)} \d)", 1)).otherwise(x)


def orderly_sections(content: Column, labels: Labels = LABELS) -> Column:
    """PAR-20 in the JVM, for a note in which each start is directly followed by its own end: a struct as of paired_sections; null for other notes."""
    until_heading = lambda x: _until_heading(x, labels)
    none = F.array().cast("array<struct<ord:int,slide_num:int,hash:string,dup:int,managed:string,after:string>>")

    def split(front: Column, body: Column, marks: Column, parts: Column) -> Column:
        starts = F.when(F.size(marks) >= 2, F.sequence(F.lit(0), F.size(marks) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        paired = F.forall(starts, lambda k: F.get(marks, k).endswith(" start -->") & (F.regexp_replace(F.get(marks, k), " start -->$", " end -->") == F.get(marks, k + 1)))
        field = lambda k, group: F.regexp_extract(F.get(marks, k), labels.marker, group)
        section = lambda k, i: F.struct(
            i.alias("ord"),
            field(k, 1).cast("int").alias("slide_num"),
            field(k, 2).alias("hash"),
            blank_to_null(field(k, 3)).cast("int").alias("dup"),
            F.get(parts, k + 1).alias("managed"),
            until_heading(F.get(parts, k + 2)).alias("after"),
        )
        whole = F.struct(front.alias("frontmatter"), F.when(F.size(marks) == 0, body).otherwise(until_heading(F.get(parts, 0))).alias("preamble"), F.when(F.size(marks) == 0, none).otherwise(F.transform(starts, section)).alias("sections"))
        return F.when((F.size(marks) % 2 == 0) & paired, whole)

    rest = lambda front: F.substring(content, F.length(front) + 1, F.length(content))
    marks_of = lambda body: F.regexp_extract_all(body, F.lit(f"({labels.marker})"), F.lit(1))
    with_marks = lambda front, body: let(marks_of(body), lambda marks: let(F.split(body, labels.marker), lambda parts: split(front, body, marks, parts)))
    return let(frontmatter(content), lambda front: let(rest(front), lambda body: with_marks(front, body)))


def paired_sections(content: Column, labels: Labels = LABELS) -> Column:
    """PAR-20 for any note: each start is paired with the first later free end of equal slide, hash and dup; what has no pair is dropped.

    An end is free for a start if fewer ends than starts of its identity came before, not counting ends that no start was open for: a running balance and how often it would have gone below nothing. The j-th start then
    belongs to the j-th end that counts. One fold over the marks in order of identity, and two sorts.
    """
    name = "struct<slide:string,hash:string,dup:string"
    mark = lambda m, k: F.struct(*[F.regexp_extract(m, labels.marker, g).alias(c) for g, c in ((1, "slide"), (2, "hash"), (3, "dup"))], k.alias("k"), m.endswith(" end -->").alias("is_end"))
    same = lambda x, y: (x["slide"] == y["slide"]) & (x["hash"] == y["hash"]) & (x["dup"] == y["dup"])
    zero, no = F.lit(0), F.lit(None).cast("string")
    start = F.struct(no.alias("slide"), no.alias("hash"), no.alias("dup"), zero.alias("s"), zero.alias("e"), zero.alias("u"), F.array().cast(f"array<{name},j:int,is_end:boolean,k:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s, e, u = (F.when(F.coalesce(same(acc, x), F.lit(False)), acc[c]).otherwise(0) for c in "seu")
        free = x["is_end"] & (s - e + u <= 0)
        j = F.when(x["is_end"], F.when(free, None).otherwise(e + 1 - u)).otherwise(s + 1).cast("int")
        out = F.struct(x["slide"], x["hash"], x["dup"], j.alias("j"), x["is_end"].alias("is_end"), x["k"].alias("k"))
        count = lambda c, more: (c + more.cast("int"))
        return F.struct(x["slide"], x["hash"], x["dup"], count(s, ~x["is_end"]).alias("s"), count(e, x["is_end"]).alias("e"), count(u, free).alias("u"), F.when(free, acc["out"]).otherwise(F.concat(acc["out"], F.array(out))).alias("out"))

    def pairs(marks: Column) -> Column:
        folded = F.aggregate(F.sort_array(F.transform(marks, mark)), start, add)["out"]
        nothing = F.array().cast("array<struct<start:int,end:int>>")
        end = lambda all_, x, i: F.when(~x["is_end"] & F.get(all_, i + 1)["is_end"] & same(x, F.get(all_, i + 1)) & (x["j"] == F.get(all_, i + 1)["j"]), F.get(all_, i + 1)["k"])
        both = lambda all_: F.filter(F.transform(all_, lambda x, i: F.struct(x["k"].alias("start"), end(all_, x, i).alias("end"))), lambda p: p["end"].isNotNull())
        return F.when(F.size(marks) == 0, nothing).otherwise(F.sort_array(let(F.sort_array(folded), both)))

    def begins(marks: Column, parts: Column) -> Column:
        """Where each mark begins."""
        at = lambda acc, k: acc["at"] + F.length(F.get(parts, k))
        step = lambda acc, k: F.struct((at(acc, k) + F.length(F.get(marks, k))).alias("at"), F.concat(acc["out"], F.array(at(acc, k))).alias("out"))
        numbers = F.when(F.size(marks) > 0, F.sequence(F.lit(0), F.size(marks) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def split(front: Column, body: Column, marks: Column, at: Column, found: Column) -> Column:
        stop = lambda k: F.get(at, k) + F.length(F.get(marks, k))
        field = lambda p, group: F.regexp_extract(F.get(marks, p["start"]), labels.marker, group)
        until = lambda i: F.coalesce(F.get(at, F.get(found, i + 1)["start"]), F.length(body))
        section = lambda p, i: F.struct(
            i.alias("ord"),
            field(p, 1).cast("int").alias("slide_num"),
            field(p, 2).alias("hash"),
            blank_to_null(field(p, 3)).cast("int").alias("dup"),
            F.substring(body, stop(p["start"]) + 1, F.get(at, p["end"]) - stop(p["start"])).alias("managed"),
            _until_heading(F.substring(body, stop(p["end"]) + 1, F.greatest(until(i) - stop(p["end"]), F.lit(0))), labels).alias("after"),
        )
        preamble = F.when(F.size(found) == 0, body).otherwise(_until_heading(F.substring(body, F.lit(1), F.get(at, F.get(found, 0)["start"])), labels))
        return F.struct(front.alias("frontmatter"), preamble.alias("preamble"), F.transform(found, section).alias("sections"))

    rest = lambda front: F.substring(content, F.length(front) + 1, F.length(content))
    marks_of = lambda body: F.regexp_extract_all(body, F.lit(f"({labels.marker})"), F.lit(1))
    placed = lambda front, body, marks: let(begins(marks, F.split(body, labels.marker)), lambda at: let(pairs(marks), lambda found: split(front, body, marks, at, found)))
    return let(frontmatter(content), lambda front: let(rest(front), lambda body: let(marks_of(body), lambda marks: placed(front, body, marks))))


def sections_of(text: Column, labels: Labels = LABELS) -> Column:
    """PAR-20: a note's frontmatter, preamble and sections as a struct."""
    return F.coalesce(orderly_sections(text, labels), paired_sections(text, labels))


def with_sections(notes: DataFrame, content: str = "content", labels: Labels = LABELS) -> DataFrame:
    """notes with frontmatter, preamble and sections (array) of each. Notes whose markers are in order, as all are that nobody has cut up, need no pairing."""
    text = F.coalesce(F.col(content), F.lit(""))
    return notes.withColumn("__s", sections_of(text, labels)).select(*notes.columns, "__s.frontmatter", "__s.preamble", "__s.sections")


def headings(body: Column) -> Column:
    """PAR-22: the different headings in order."""
    return F.array_distinct(F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^#{1,6}\s+.+$")), lambda x: trimmed(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1))))


def links(body: Column) -> Column:
    """PAR-23: the different names that are linked to, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)), trimmed))


def cited(body: Column, names: Column) -> Column:
    """PAR-24: the links that are existing names."""
    return F.array_intersect(links(body), names)


def linked(body: Column, names: Column, safe: bool = False) -> Column:
    """PRJ-8: each name, in order, made a link wherever it stands and isn't directly after [[ or before ]].

    safe also leaves alone what is anywhere inside a link. An empty name is none (as a pattern it would stand between all characters).
    """
    after = r"(?![^\[\]\n]*\]\])" if safe else r"(?!\]\])"
    # what stands before is looked at where the name was found, not at every character
    def link(text: Column, name: Column, pattern: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit("(?iu)"), pattern, F.lit(r"(?<!\[\["), pattern, F.lit(")" + after)), F.concat(F.lit("[["), escaped_replacement(name), F.lit("]]")))

    def all_linked(names: Column, pattern: Callable[[Column], Column]) -> Column:
        return F.aggregate(names, body, lambda text, name: F.when(name == "", text).otherwise(link(text, name, pattern(name))))

    # Java takes an i with and one without a dot for one letter
    turkish = lambda x: F.contains(x, F.lit("ı")) | F.contains(x, F.lit("İ"))
    apart = lambda name: F.regexp_replace(F.regexp_replace(escaped_pattern(name), "([iI])", "(?-u:$1)"), "([ıİ])", "(?-i:$1)")
    return let(names, lambda names: F.when(turkish(body) | F.exists(names, turkish), all_linked(names, apart)).otherwise(all_linked(names, escaped_pattern)))


def folded_case(x: Column) -> Column:
    """x with letters that match each other whatever their case made one. (Signs between the two steps also keep the optimizer from taking them for one.)"""
    any_text = F.replace(F.lower(F.translate(F.upper(F.translate(x, "ẞİ", "ßi")), "\u212a\u212b\u2126", "kåω")), F.lit("ς"), F.lit("σ"))
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(any_text)  # ASCII takes one step


def linked_texts(docs: DataFrame, names: DataFrame, doc: str, text: str, name: str, order: str) -> DataFrame:
    """PRJ-8 for a dictionary of any size: docs with text linked as linked() does with all names in order, but each text is only searched for names that it may have.

    A name's anchor is its longest run without white space and brackets: where the name stands, the anchor stands inside a word. Words are taken from all texts once; anchors are found in them by their rarest
    run of three characters (an equi-join over the vocabulary, not over the texts), and the names come back to the texts by equal words. So the cost is that of the texts' words and of the hits. What has no
    anchor (brackets and white space only) is no name. A null text stays null; rows that are alike in id and text get the same.
    """
    breaks = r"[\s\p{Z}\[\]]+"
    run = lambda x: F.filter(F.split(folded_case(x), breaks), lambda w: w != "")
    longest = lambda words: F.get(F.array_sort(words, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), 0)
    own = names.where(F.col(name) != "").groupBy(F.col(name).alias("__name")).agg(F.min(order).alias("__order")).withColumn("__anchor", longest(run(F.col("__name")))).where(F.col("__anchor").isNotNull())
    grams = lambda w, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - size + 1, F.lit(1))), lambda i: F.substring(w, i, size)))
    size = F.least(F.length("__anchor"), F.lit(3))

    rows = docs.withColumn("__doc", F.xxhash64(doc, text))
    words = kept(rows.select("__doc", F.array_distinct(run(F.col(text))).alias("__words"))).select("__doc", F.explode("__words").alias("__word"))
    vocabulary = words.select("__word").distinct()
    anchors = own.select("__anchor").distinct()
    # how many anchors have a run of characters tells how common it is; each anchor is looked up by its rarest one
    each = anchors.select("__anchor", F.explode(grams(F.col("__anchor"), size)).alias("__gram"))
    rarest = each.join(each.groupBy("__gram").agg(F.count(F.lit(1)).alias("n")), "__gram").groupBy("__anchor").agg(F.min_by("__gram", F.struct("n", "__gram")).alias("__gram"))
    sizes = F.array(*[F.lit(r[0]) for r in own.select(size).distinct().collect()]).cast("array<int>")  # of 1, 2 and 3
    of_words = vocabulary.select("__word", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda k: grams(F.col("__word"), k))))).alias("__gram"))
    having = of_words.join(rarest, "__gram").where(F.contains("__word", "__anchor")).select("__word", "__anchor").join(own, "__anchor").select("__word", "__order", "__name", (folded_case(F.col("__name")) != F.col("__anchor")).alias("__more"))
    found = words.join(kept(having), "__word").select("__doc", F.struct("__order", "__name", "__more").alias("n"))  # written, it is of a known size: the texts' words only move where it is large
    some = found.groupBy("__doc").agg(F.collect_set("n").alias("__some"))
    bare = lambda x: folded_case(F.regexp_replace(x, r"[\[\]]", ""))  # noqa: E731  links that are made change nothing else
    # a name that is more than its anchor is looked for first; the text is folded once for all of them
    checked = let(bare(F.col(text)), lambda whole: F.filter("__some", lambda n: ~n["__more"] | F.contains(whole, bare(n["__name"]))))
    there = F.sort_array(F.when(F.exists("__some", lambda n: n["__more"]), checked).otherwise(F.col("__some")))
    out = rows.join(some, "__doc", "left")
    return out.withColumn(text, F.when(F.col("__some").isNull(), F.col(text)).otherwise(linked(F.col(text), F.transform(there, lambda n: n["__name"])))).select(*docs.columns)


def marker(slide: Column, digest: Column, dup: Column, kind: str, labels: Labels = LABELS) -> Column:
    """PRJ-10."""
    return F.concat(F.lit(f"<!-- {labels.tag}:slide:"), slide.cast("string"), F.lit(" hash:"), digest, F.when(dup.isNotNull(), F.concat(F.lit(" dup:"), dup.cast("string"))).otherwise(""), F.lit(f" {kind} -->"))


def slide_section(slide: Column, digest: Column, commentary: Column, names: Column, labels: Labels = LABELS) -> Column:
    """PRJ-6: heading, markers around the linked commentary, and an empty memo."""
    none = F.lit(None).cast("int")
    return F.concat_ws("\n", F.concat(F.lit(f"## {labels.slide} "), slide.cast("string")), F.lit(""), marker(slide, digest, none, "start", labels), linked(commentary, names), marker(slide, digest, none, "end", labels), F.lit(""), F.lit(f"> [!note] {labels.memo}"), F.lit("> "))


def _frontmatter_lines(lines: list[Column]) -> Column:
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n"))


def _field(name: str, value: Column) -> Column:
    """A quoted line of frontmatter; null where value is."""
    return F.concat(F.lit(f'{name}: "'), value, F.lit('"'))


def _tags(subject: Column, tags: Column | None) -> Column:
    all_tags = F.array(F.lower(subject)) if tags is None else F.concat(F.array(F.lower(subject)), tags)
    return F.concat(F.lit("tags: ["), F.array_join(all_tags, ", "), F.lit("]"))


def page_anchored_note(notes: DataFrame, slides: DataFrame, errors: DataFrame, source: str = "notemill", labels: Labels = LABELS) -> DataFrame:
    """PRJ-5: (note_id, content) for notes (note_id, title, subject, tags, names, date, created_at) with slides (note_id, slide_num, hash, commentary) in order
    and a list of errors (note_id, slide_num, reason)."""
    ordered = lambda rows, *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    s = slides.groupBy("note_id").agg(ordered(slides, "slide_num", "hash", "commentary").alias("slides"))
    e = errors.groupBy("note_id").agg(ordered(errors, "slide_num", "reason").alias("errors"))
    df = notes.join(s, "note_id").join(e, "note_id", "left")
    body = F.array_join(F.transform("slides", lambda x: slide_section(x["slide_num"], x["hash"], x["commentary"], F.col("names"), labels)), "\n\n")
    failed = F.concat(F.lit(f"\n\n## {labels.failed}\n\n"), F.array_join(F.transform("errors", lambda x: F.concat(F.lit(f"- {labels.failed_item} "), x["slide_num"].cast("string"), F.lit(": "), x["reason"])), "\n"), F.lit("\n"))
    front = _frontmatter_lines([_field("title", F.col("title")), _field("subject", F.col("subject")), _tags(F.col("subject"), F.col("tags")), _field("date", F.col("date")), F.lit(f'source: "{source}"'), F.concat(F.lit("slide_count: "), F.size("slides").cast("string")), _field(labels.created_field, F.col("created_at")), _field(labels.id_field, F.col("note_id"))])
    return df.select("note_id", F.concat(front, F.lit("# "), F.col("title"), F.lit("\n\n"), body, F.coalesce(failed, F.lit("")), F.lit("\n")).alias("content"))


def single_block_note(notes: DataFrame, source: str = "notemill", labels: Labels = LABELS) -> DataFrame:
    """PRJ-7: (note_id, content) of full and partial notes (note_id, title, subject, tags, names, date, created_at, summary, processed, parse_quality)."""
    partial = F.col("parse_quality") == "partial"
    head = [_field("title", F.col("title")), _field("subject", F.col("subject"))]
    full_front = _frontmatter_lines([*head, _tags(F.col("subject"), F.col("tags")), _field("date", F.col("date")), F.lit(f'source: "{source}"'), _field(labels.created_field, F.col("created_at")), _field(labels.id_field, F.col("note_id"))])
    partial_front = _frontmatter_lines([*head, _tags(F.col("subject"), None), _field("date", F.col("date")), F.lit(f'source: "{source}"'), F.lit('parse_quality: "partial"')])
    text = trimmed(linked(F.coalesce(blank_to_null(F.col("processed")), F.col("summary")), F.col("names")))
    warning = "> [!warning] Partial import\n> The page's format may have changed. Only title and description were extracted.\n\n"
    body = F.when(partial, F.concat(F.lit(warning), F.coalesce(blank_to_null(F.col("summary")), F.lit(labels.no_summary)))).otherwise(text)
    return notes.select("note_id", F.concat(F.when(partial, partial_front).otherwise(full_front), F.lit(f"{labels.start}\n# "), F.col("title"), F.lit("\n\n"), body, F.lit(f"\n{labels.end}\n\n## {labels.memo}\n")).alias("content"))


def concept_note(name: Column, definition: Column, related: Column, lectures: Column, context: Column, example: Column, caution: Column, labels: Labels = LABELS) -> Column:
    """PRJ-9: a concept's note: its lines without any blank one."""
    as_links = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{label} "), value))
    lines = F.array(F.lit("---"), F.lit("tags: [concept]"), F.lit("---"), F.concat(F.lit("# "), name), F.concat(F.lit(f"{labels.definition} "), definition), line(labels.context, context), line(labels.example, example), line(labels.caution, caution), line(labels.lectures, as_links(lectures)), line(labels.related, as_links(related)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def exam_note(exams: DataFrame, source: str = "notemill") -> DataFrame:
    """PRJ-12: exams (subject, title, period, n_lectures, date, body) with the note's content and path."""
    front = _frontmatter_lines([_field("title", F.col("title")), _field("subject", F.col("subject")), F.when(F.col("period").isNotNull(), F.concat(F.lit("tags: [exam, "), F.col("period"), F.lit("]"))).otherwise("tags: [exam]"), _field("date", F.col("date")), F.lit(f'source: "{source}"'), F.concat(F.lit("lecture_count: "), F.col("n_lectures").cast("string"))])
    return exams.select("subject", "title", F.concat(front, F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("content"), F.concat(F.lit("Exam/"), F.col("title"), F.lit(".md")).alias("path"))


def in_period(content: Column, period: str) -> Column:
    """FLT-3: whether the first list of tags has the period."""
    tags = F.transform(F.split(F.regexp_extract(content, r"tags:\s*\[([^\]]*)\]", 1), ","), trimmed)
    return F.array_contains(tags, period)


def exam_text(notes: DataFrame, period: str | None = None, gap: str = "\n\n---\n\n") -> DataFrame:
    """A subject's notes (subject, ord, content) as one text in order, with their number; of one period if given."""
    rows = notes if period is None else notes.where(in_period(F.col("content"), period))
    return rows.groupBy("subject").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), gap).alias("text"), F.count(F.lit(1)).alias("n_lectures"))


