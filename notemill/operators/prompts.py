"""Prompts for a language model, as columns (PRJ-11, SRT-7). Their wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.text import blank_to_null, capped_transcript, head_and_tail

#: Names that a prompt lists at most, and characters of a text in it.
NAMES_MOST, TEXT_MOST = 100, 12_000


def listed(names: Column, most: int = NAMES_MOST) -> Column:
    """SRT-7: the first names, or a dash."""
    return F.coalesce(blank_to_null(F.array_join(F.slice(names, 1, most), ", ")), F.lit("-"))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _named(name: str, value: Column) -> Column:
    """A labelled line; left out if value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def transcript_prompt(title: Column, transcript: Column, summary: Column) -> Column:
    """Turn a talk's transcript, up to its limit, into notes; with the summary that is there, if any."""
    return _lines("Write lecture notes in Markdown from this transcript.", _named("Title", title), _named("Summary so far", blank_to_null(summary)), "Transcript:", capped_transcript(transcript))


def material_prompt(title: Column, context: Column, names: Column) -> Column:
    """Improve notes by the pages that matter; names of known concepts may be linked."""
    return _lines("Improve these lecture notes by the pages below. Cite pages as [p.N].", _named("Title", title), _named("Known concepts", listed(names)), "Pages:", head_and_tail(context, TEXT_MOST))


def slide_prompt(title: Column, slide: Column, slides: Column, said: Column, names: Column) -> Column:
    """Explain one slide, with what was said about it."""
    place = F.concat(F.lit("Slide "), slide.cast("string"), F.lit(" of "), slides.cast("string"))
    return _lines("Explain this slide to a student in a few sentences.", _named("Lecture", title), place, _named("Known concepts", listed(names)), _named("Said", blank_to_null(said)))


def concepts_prompt(text: Column, names: Column) -> Column:
    """Concepts of a text, as JSON of a fixed form."""
    form = '{"concepts": [{"name": "", "definition": "", "relatedConcepts": [], "example": "", "caution": "", "lectureContext": ""}], "tags": []}'
    return _lines("List the concepts of this text as JSON, and nothing else, in this form:", form, _named("Use these names where they fit", listed(names)), "Text:", head_and_tail(text, TEXT_MOST))


def exam_prompt(subject: Column, period: Column, text: Column) -> Column:
    """A summary for an exam from all notes of a subject."""
    return _lines("Write a summary to learn from for an exam.", _named("Subject", subject), _named("Period", period), "Notes:", text)
