"""Pages that matter for a seed text: terms, scores, selection, packing (SCL-13, SCR-1, SRT-2, SRT-3, SRT-5, PCK-1, SRC-3, SRC-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import at_sentence, page_text

# Words that mark an important page, what a term looks like, and the limits.
KEYWORDS = "definition|theorem|algorithm|formula|example|정의|정리|알고리즘|공식|예시"
TERM = "([A-Za-z][A-Za-z0-9-]{3,}|[가-힣]{3,})"
TERM_LEAST, TERMS_MOST = 4, 40
PAGES_MOST, CHARS_MOST, PAGE_CHARS_MOST, FIRST_PAGES = 14, 12_000, 900, 3


def seed_terms(seed: Column) -> Column:
    """SCL-13, SRT-5: the first 40 different terms, in lower case."""
    found = F.transform(F.regexp_extract_all(seed, F.lit(TERM), F.lit(1)), F.lower)
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t) >= TERM_LEAST)), 1, TERMS_MOST)


def page_score(text: Column, terms: Column, page: Column) -> Column:
    """SCR-1. The text in lower case is bound once, in an array of one, or it would be made again for each term."""
    words = F.get(F.transform(F.array(F.lower(text)), lambda lower: 4 * F.size(F.filter(terms, lambda t: F.contains(lower, t))) + F.when(lower.rlike(KEYWORDS), 8).otherwise(0)), 0)
    return F.least(F.length(text) / 80, F.lit(20.0)) + words + F.when(page <= FIRST_PAGES, 5).otherwise(0)


def page_rows(pages: DataFrame) -> DataFrame:
    """SRC-3: pages (deck_id, page_num, text) with their text normalised; empty pages are dropped."""
    return pages.withColumn("text", page_text(F.col("text"))).where(F.col("text") != "")


def with_page_texts(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """The few selected pages (deck_id, page_num) with their texts, which needn't be carried through the ranking."""
    return page_rows(pages.join(selected.select("deck_id", "page_num"), ["deck_id", "page_num"], "left_semi"))


def scored_pages(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """pages (deck_id, page_num, text) with text normalised and score; empty pages are dropped. seeds: (deck_id, seed); a deck without one has no terms.

    Terms are made once for each deck, before the join.
    """
    terms = seeds.select("deck_id", seed_terms(F.col("seed")).alias("terms"))
    none = F.array().cast("array<string>")
    return page_rows(pages).join(terms, "deck_id", "left").withColumn("score", page_score(F.col("text"), F.coalesce("terms", none), F.col("page_num"))).drop("terms")


def selected_pages(scored: DataFrame, most: int = PAGES_MOST) -> DataFrame:
    """SRT-2, SRT-3: each deck's best pages and its first ones, in page order, cut to the limit. Both ranks share one exchange."""
    by_score = Window.partitionBy("deck_id").orderBy(F.desc("score"), "page_num")
    by_page = Window.partitionBy("deck_id").orderBy("page_num")
    chosen = scored.withColumn("__best", F.row_number().over(by_score)).where((F.col("__best") <= most) | (F.col("page_num") <= FIRST_PAGES))
    return chosen.withColumn("__at", F.row_number().over(by_page)).where(F.col("__at") <= most).drop("__best", "__at")


def packed_context(selected: DataFrame, totals: DataFrame, most: int = CHARS_MOST, page_most: int = PAGE_CHARS_MOST) -> DataFrame:
    """PCK-1: (deck_id, text, used_chars, page_count, extracted_chars, truncated). totals: (deck_id, page_count, extracted_chars).

    At most 14 pages are gathered for a deck; each is cut at a sentence to what is left.
    """
    pages = selected.groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("pages"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("lines"))

    def add(acc: Column, p: Column) -> Column:
        left = F.lit(most) - acc["used"]
        text = at_sentence(p["text"], F.greatest(F.least(F.lit(page_most), left), F.lit(0)))
        line = F.concat(F.lit("[p."), p["page_num"].cast("string"), F.lit("] "), text)
        on = (left > 0) & (text != "")
        return F.struct((acc["used"] + F.when(on, F.length(line)).otherwise(0)).alias("used"), F.when(on, F.concat(acc["lines"], F.array(line))).otherwise(acc["lines"]).alias("lines"))

    df = pages.withColumn("__p", F.aggregate("pages", start, add)).join(totals, "deck_id")
    used = F.col("__p.used")
    return df.select("deck_id", F.array_join("__p.lines", "\n").alias("text"), used.alias("used_chars"), "page_count", "extracted_chars", (F.col("extracted_chars") > used).alias("truncated"))


def deck_totals(pages: DataFrame) -> DataFrame:
    """SRC-4, AGG-4: (deck_id, page_count, extracted_chars): the highest page number, and the normalised characters."""
    return pages.groupBy("deck_id").agg(F.max("page_num").alias("page_count"), F.sum(F.length(page_text(F.col("text")))).alias("extracted_chars"))
