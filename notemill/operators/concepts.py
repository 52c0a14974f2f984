"""Concepts: canonical names, merging, relations, and their notes (JOIN-6, JOIN-7, AGG-1, AGG-2, MRG-2)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import concept_key, key_of_sanitized, sanitized, trimmed
from notemill.operators.notes import LABELS, Labels

#: Bounds of how many relations of one name a row may have.
LEAST_BLOCK, MOST_BLOCK = 50_000, 500_000


def canonical_names(existing: DataFrame) -> DataFrame:
    """(subject, key, canonical) from existing (subject, ord, name): of names with one key the last counts."""
    return existing.groupBy("subject", concept_key(F.col("name")).alias("key")).agg(F.max_by("name", "ord").alias("canonical"))


def named_concepts(concepts: DataFrame, existing: DataFrame) -> DataFrame:
    """JOIN-6: concepts with names trimmed and made those of existing concepts of their key; nameless ones are left out."""
    named = concepts.withColumn("name", trimmed(F.col("name"))).where(F.col("name") != "").withColumn("__key", concept_key(F.col("name")))
    names = canonical_names(existing).select(F.col("subject").alias("__s"), F.col("key").alias("__k"), "canonical")
    named = named.join(names, (F.col("subject") == F.col("__s")) & (F.col("__key") == F.col("__k")), "left").withColumn("name", F.coalesce("canonical", "name"))
    return named.drop("__s", "__k", "__key", "canonical")


def merged_concepts(concepts: DataFrame, existing: DataFrame, relations: bool = True) -> DataFrame:
    """AGG-1: concepts (subject, ord, name, definition, related_concepts, example, caution, lecture_context) merged under canonical names.

    Relations are put together in order; each text is the first that isn't empty; ord is that of the first concept. New names that differ only in case stay apart. Without relations no row gathers a name's; relation_rows() has
    them one by one.
    """
    early = lambda c: F.expr(f"min_by({c}, ord) FILTER (WHERE {c} <> '')")
    related = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "related_concepts"))), lambda x: x["related_concepts"])).alias("related_concepts")
    return named_concepts(concepts, existing).groupBy("subject", "name").agg(
        F.min("ord").alias("ord"),
        F.coalesce(early("definition"), F.min_by("definition", "ord")).alias("definition"),
        *([related] if relations else []),
        *[early(c).alias(c) for c in ("example", "caution", "lecture_context")],
    )


def allowed_names(concepts: DataFrame, existing: DataFrame) -> DataFrame:
    """(subject, form): the three forms of every name that a relation may have."""
    names = concepts.select("subject", "name").unionByName(existing.select("subject", "name")).distinct()
    name = F.col("name")
    return names.select("subject", F.explode(F.array_distinct(F.array(F.lower(name), F.lower(sanitized(name)), concept_key(name)))).alias("form")).distinct()


def relation_rows(named: DataFrame, counted: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """AGG-1, AGG-2: (subject, name, key, raw, pos): the different relations of each merged name (and its key) as they were written, numbered in the order in which they first came. named is what named_concepts() gives,
    counted (subject, name, ord, n) how many relations its concepts have.

    Concepts, not relations, are shuffled to their names. A name with more than most relations (else a share of a task's, between LEAST_BLOCK and MOST_BLOCK) is cut to blocks of concepts that follow one another; of what its
    blocks have in common the first stays, and a block's places begin where those of the blocks before it end. So no row and no task gathers such a name.
    """
    ranges = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = keep(counted.groupBy("subject", "name").agg(F.sum("n").alias("n")))
    all_of, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = most or max(LEAST_BLOCK, min(MOST_BLOCK, all_of // (4 * ranges)))
    some = named.where(F.col("related_concepts").isNotNull()).select("subject", "name", "ord", "related_concepts")
    if largest > most:
        n = min(2 * -(-largest // most), 10_000)
        hot = F.broadcast(sizes.where(F.col("n") > most).select(F.col("subject").alias("__s"), F.col("name").alias("__n")))
        mine = (F.col("subject") == F.col("__s")) & (F.col("name") == F.col("__n"))
        cuts = keep(counted.join(hot, mine).groupBy("__s", "__n").agg(F.percentile_approx("ord", [k / n for k in range(1, n)], 10 * n).alias("__cuts")))
        # equal ords are never cut apart
        some = some.join(F.broadcast(cuts), mine, "left").withColumn("block", F.when(F.col("__cuts").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("ord")))))
    else:
        some = some.withColumn("block", F.lit(-1))
    in_order = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "related_concepts"))), lambda x: x["related_concepts"]))
    each = some.groupBy("subject", "name", "block").agg(F.array_distinct(in_order).alias("raw")).withColumn("key", concept_key(F.col("name")))
    each = keep(each.select("subject", "name", "key", "block", F.posexplode("raw").alias("pos", "raw")))
    rows = each.where("block = -1").select("subject", "name", "key", "raw", "pos")
    if largest <= most:
        return rows
    # a place is one number for its block and its place there; numbers, unlike structs, are aggregated by hash
    first = each.where("block >= 0").groupBy("subject", "name", "key", "raw").agg(F.min(F.shiftleft(F.col("block").cast("long"), 32) + F.col("pos")).alias("at")).withColumn("block", F.shiftright("at", 32))
    first = keep(first.withColumn("pos", F.row_number().over(Window.partitionBy("subject", "name", "block").orderBy("at"))))
    before = F.sum("n").over(Window.partitionBy("subject", "name").orderBy("block")) - F.col("n")
    begins = first.groupBy("subject", "name", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).drop("n")
    return rows.unionByName(first.join(F.broadcast(begins), ["subject", "name", "block"]).select("subject", "name", "key", "raw", (F.col("before") + F.col("pos") - 1).cast("int").alias("pos")))


def filtered_relations(concepts: DataFrame, existing: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """JOIN-7, AGG-2: (subject, name, pos, related): relations made distinct, then canonical, kept if they name a known concept that isn't the concept itself.

    Distinct comes first, so two spellings of one concept both stay. What becomes of a spelling is found once for each different one, not for each relation that has it: its canonical name, and whether one of its three forms
    is allowed. concepts needn't be merged. keep writes a table and reads it back. A name with more than most relations is dealt to several tasks.
    """
    named = named_concepts(concepts, existing)
    counted = keep(named.select("subject", "name", "ord", F.size(F.coalesce("related_concepts", F.array().cast("array<string>"))).cast("long").alias("n")))
    rows = relation_rows(named, counted, keep, most)
    # a canonical name has the key of what it stands for; patterns are what is dear here, so each is looked for once
    spelled = rows.select("subject", "raw").distinct().withColumn("__clean", sanitized(F.col("raw"))).withColumn("__key", key_of_sanitized(F.col("__clean")))
    names = canonical_names(existing).select(F.col("subject").alias("__s"), F.col("key").alias("__k"), "canonical", sanitized(F.col("canonical")).alias("__c"))
    spelled = spelled.join(names, (F.col("subject") == F.col("__s")) & (F.col("__key") == F.col("__k")), "left")
    spelled = spelled.select("subject", "raw", "__key", F.coalesce("canonical", "raw").alias("related"), F.coalesce("__c", "__clean").alias("__clean"))
    forms = spelled.withColumn("form", F.explode(F.array_distinct(F.array("__key", F.lower("related"), F.lower("__clean")))))
    known = forms.join(allowed_names(counted, existing), ["subject", "form"], "left_semi").groupBy("subject", "raw").agg(F.first("related").alias("related"), F.first("__key").alias("__key"))
    known = known.select(F.col("subject").alias("__s"), F.col("raw").alias("__r"), "related", "__key")
    both = rows.join(known.hint("shuffle_hash"), (F.col("subject") == F.col("__s")) & (F.col("raw") == F.col("__r")))
    return both.where(F.col("__key") != F.col("key")).select("subject", "name", "pos", "related")


def normalized_concepts(concepts: DataFrame, existing: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The merged concepts with their filtered relations, in order."""
    merged = merged_concepts(concepts, existing, relations=False)
    related = filtered_relations(concepts, existing, keep).groupBy("subject", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "related"))), lambda x: x["related"]).alias("__r"))
    return merged.join(related, ["subject", "name"], "left").withColumn("related_concepts", F.coalesce("__r", F.array().cast("array<string>"))).drop("__r")


def _line(label: str, text: Column) -> tuple[Column, Column, Column, Column]:
    """(whether a line begins with label, what stands before the first such line, what follows the label there, what stands after the line)."""
    start = F.regexp_instr(text, F.lit(rf"(?m)^{re.escape(label)}"))
    rest = F.substring(text, start, F.length(text))
    whole = F.regexp_extract(rest, rf"^{re.escape(label)}\s*[^\n]*", 0)
    return start > 0, F.substring(text, F.lit(1), start - 1), F.substring(whole, len(label) + 1, F.length(whole)), F.substring(rest, F.length(whole) + 1, F.length(rest))


def _with_links(label: str, text: Column, links: Column, otherwise: Column) -> Column:
    """text with links (an array) that the label's line lacks put at its end, or what otherwise is if no line has the label."""
    there, before, now, after = _line(label, text)
    new = F.filter(links, lambda x: ~F.contains(now, x))
    parts = F.filter(F.array(trimmed(now), F.array_join(new, ", ")), lambda x: x != "")
    return F.when(~there, otherwise).when(F.size(new) == 0, text).otherwise(F.concat(before, F.lit(f"{label} "), F.array_join(parts, ", "), after))


def _trimmed_end(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def _with_field(lectures: str, label: str, value: Column) -> Callable[[Column], Column]:
    """Puts a labelled value before the line of lectures, or at the end, unless the value is empty or the label is there."""

    def put(x: Column) -> Column:
        at, line = F.locate(lectures, x), F.concat(F.lit(f"{label} "), value)
        before = F.concat(F.substring(x, F.lit(1), at - 1), line, F.lit("\n\n"), F.substring(x, at, F.length(x)))
        return F.when((F.coalesce(value, F.lit("")) == "") | F.contains(x, F.lit(label)), x).when(at > 0, before).otherwise(F.concat(_trimmed_end(x), F.lit("\n\n"), line, F.lit("\n")))

    return put


def updated_note(content: Column, lecture: Column, context: Column, example: Column, caution: Column, related: Column, labels: Labels = LABELS) -> Column:
    """MRG-2: the lecture's link, missing fields and missing related links are added; nothing is taken away. Each step's text is bound once, as an array of one."""
    step = lambda text, f: F.get(F.transform(F.array(text), f), 0)
    link = F.concat(F.lit("[["), lecture, F.lit("]]"))
    text = step(content, lambda x: F.when(F.contains(x, link), x).otherwise(_with_links(labels.lectures, x, F.array(link), F.concat(x, F.lit(f"\n{labels.lectures} "), link, F.lit("\n")))))
    for label, value in ((labels.context, context), (labels.example, example), (labels.caution, caution)):
        text = step(text, _with_field(labels.lectures, label, value))
    links = F.transform(F.coalesce(related, F.array().cast("array<string>")), lambda r: F.concat(F.lit("[["), r, F.lit("]]")))
    return step(text, lambda x: F.when(F.size(links) == 0, x).otherwise(_with_links(labels.related, x, links, F.concat(_trimmed_end(x), F.lit(f"\n{labels.related} "), F.array_join(links, ", "), F.lit("\n")))))


def upserted_concept_notes(current: DataFrame, incoming: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """SNK-3, JOIN-11: a full join of current notes (path, content) and incoming ones (path, fresh, lecture, lecture_context, example, caution, related_concepts): what is
    new is inserted as fresh, what is there is updated, the rest stays."""
    both = current.join(incoming, "path", "full")
    there, new = F.col("content").isNotNull(), F.col("fresh").isNotNull()
    update = updated_note(*[F.col(c) for c in ("content", "lecture", "lecture_context", "example", "caution", "related_concepts")], labels)
    merged = F.when(there & new, update).when(there, F.col("content")).otherwise(F.col("fresh"))
    return both.select("path", merged.alias("content"), F.when(there & new, "updated").when(there, "kept").otherwise("inserted").alias("action"))


def concept_edges(concepts: DataFrame, lectures: DataFrame) -> DataFrame:
    """(src, dst, kind) of concepts (name, related_concepts) and lectures (lecture, name)."""
    related = concepts.select(F.col("name").alias("src"), F.explode("related_concepts").alias("dst"), F.lit("related").alias("kind"))
    return related.unionByName(lectures.select(F.col("name").alias("src"), F.col("lecture").alias("dst"), F.lit("lecture").alias("kind"))).distinct()


def path_of(name: Column, folder: str) -> Column:
    """A concept note's path."""
    return F.concat(F.lit(f"{folder}/"), sanitized(name), F.lit(".md"))
