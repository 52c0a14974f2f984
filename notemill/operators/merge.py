"""Re-import: matching of sections, merged notes, and what changed (JOIN-1 to JOIN-5, MRG-1, MRG-3 to MRG-6, SET-1, AGG-7, AGG-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.functions.text import trimmed
from notemill.operators.notes import LABELS, Labels, has_sections, headings, let, links, marker, sections_of, split_managed, with_sections
from notemill.sources.files import kept, updated_table

DIFF_MOST, REPLACED_SHARE = 8, 0.5


def matched_sections(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each section (note, ord, slide_num, hash) of either side: kind is same, reorder, drift, insertion or deletion.

    The k-th incoming section of a hash takes the k-th existing one; of what is left, the k-th of a slide number takes the k-th there. Columns: note, kind,
    old_ord, old_slide, old_hash, new_ord, new_slide, new_hash. Two ranked equi-joins and their anti-joins; sections are narrow, texts needn't come along.
    """
    side = lambda df, p: df.select("note", F.col("ord").alias(f"{p}_ord"), F.col("slide_num").alias(f"{p}_slide"), F.col("hash").alias(f"{p}_hash"))
    old, new = side(existing, "old"), side(incoming, "new")
    ranked = lambda df, p, by: df.withColumn("k", F.row_number().over(Window.partitionBy("note", f"{p}_{by}").orderBy(f"{p}_ord")))

    def paired(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
        a = ranked(old, "old", by).withColumn("by", F.col(f"old_{by}"))
        b = ranked(new, "new", by).withColumn("by", F.col(f"new_{by}"))
        return a.join(b, ["note", "by", "k"], "full").drop("by", "k")

    by_hash = paired(old, new, "hash")
    columns = ["note", "old_ord", "old_slide", "old_hash", "new_ord", "new_slide", "new_hash"]
    both = F.col("old_ord").isNotNull() & F.col("new_ord").isNotNull()
    same = by_hash.where(both).withColumn("kind", F.when(F.col("old_slide") != F.col("new_slide"), "reorder").otherwise("same"))
    left_old = by_hash.where(F.col("new_ord").isNull()).select("note", "old_ord", "old_slide", "old_hash")
    left_new = by_hash.where(F.col("old_ord").isNull()).select("note", "new_ord", "new_slide", "new_hash")
    rest = paired(left_old, left_new, "slide").withColumn("kind", F.when(both, "drift").when(F.col("old_ord").isNull(), "insertion").otherwise("deletion"))
    return same.select("kind", *columns).unionByName(rest.select("kind", *columns))


def deck_changes(matches: DataFrame) -> DataFrame:
    """(note, n_old, n_new, n_same, n_reorder, n_drift, n_insertion, n_deletion, replaced): AGG-8 among the counts of one pass."""
    kinds = ("same", "reorder", "drift", "insertion", "deletion")
    counts = matches.groupBy("note").agg(F.count("old_ord").alias("n_old"), F.count("new_ord").alias("n_new"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    return counts.withColumn("replaced", (F.col("n_old") > 0) & (F.col("n_deletion") > REPLACED_SHARE * F.col("n_old")))


def new_lines(current: Column, following: Column) -> Column:
    """AGG-7 in a row: how many lines of following, repeated ones each, aren't among current's."""
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), trimmed), lambda s: s != "")
    # the lines are taken once, not once for each line; what both have is found by hash, and most often it is little
    return let(lines(following), lambda new: let(F.array_intersect(new, lines(current)), lambda both: F.size(F.filter(new, lambda s: ~F.array_contains(both, s)))))


def changed_lines(current: DataFrame, following: DataFrame) -> DataFrame:
    """AGG-7 over tables (note, text): (note, changed) by an anti-join of lines, for texts too long for new_lines(). Lines move as 128 bits of hash."""
    own = lambda df: df.select("note", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", trimmed(F.col("line"))).where(F.col("line") != "")
    lines = lambda df: own(df).select("note", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    left = lines(following).join(lines(current).distinct(), ["note", "h", "g"], "left_anti").groupBy("note").agg(F.count(F.lit(1)).alias("changed"))
    return following.select("note").distinct().join(left, "note", "left").select("note", F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))


def capped_difference(a: Column, b: Column, most: int = DIFF_MOST) -> Column:
    """SET-1, SRT-4: what a has and b hasn't, in a's order, the first few."""
    return F.slice(F.array_except(a, b), 1, most)


def merged_single(current: Column, following: Column, labels: Labels = LABELS) -> Column:
    """MRG-1: the new managed block between the old text before and after it; a note without one is kept as a backup."""
    old, new = split_managed(current, labels), split_managed(following, labels)
    parts = F.filter(F.array(new["frontmatter"], trimmed(old["before"]), new["managed"], trimmed(old["after"])), lambda x: x != "")
    end = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    backup = F.concat(end(following), F.lit(f"\n\n## {labels.backup}\n\n> [!note]\n> {labels.backup_note}\n\n"), trimmed(current), F.lit("\n"))
    return F.when(old["managed"] != "", F.concat(end(F.array_join(parts, "\n\n")), F.lit("\n"))).when(current.rlike(rf"(^|\n)## {labels.backup}\s*\n"), following).otherwise(backup)


def _ranked_pairs(old: Column, new: Column, by: str) -> Column:
    """Array of (new, old) ords: the k-th section of new with a value of by takes the k-th of old that has it. One fold over the sections in order of the value, and two sorts."""
    value = {"hash": "string", "slide_num": "int"}[by]
    tagged = lambda a, is_new: F.transform(a, lambda x: F.struct(x[by].alias("v"), F.lit(is_new).alias("is_new"), x["ord"].alias("ord")))
    kind = f"array<struct<v:{value},k:int,is_new:boolean,ord:int>>"
    start = F.struct(F.lit(None).cast(value).alias("v"), F.lit(False).alias("is_new"), F.lit(0).alias("k"), F.array().cast(kind).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        again = acc["v"].eqNullSafe(x["v"]) & (acc["is_new"] == x["is_new"]) & (F.size(acc["out"]) > 0)
        k = F.when(again, acc["k"] + 1).otherwise(0)
        return F.struct(x["v"], x["is_new"], k.alias("k"), F.concat(acc["out"], F.array(F.struct(x["v"], k.alias("k"), x["is_new"], x["ord"]))).alias("out"))

    def pairs(all_: Column) -> Column:
        after = lambda i: F.get(all_, i + 1)
        taken = lambda x, i: F.when(~x["is_new"] & after(i)["is_new"] & x["v"].eqNullSafe(after(i)["v"]) & (x["k"] == after(i)["k"]), after(i)["ord"])
        return F.filter(F.transform(all_, lambda x, i: F.struct(taken(x, i).alias("new"), x["ord"].alias("old"))), lambda p: p["new"].isNotNull())

    return let(F.sort_array(F.aggregate(F.sort_array(F.concat(tagged(old, False), tagged(new, True))), start, add)["out"]), pairs)


def _matched(old: Column, new: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(for each section of new its old ord or null, ords of the old that nothing took): JOIN-1 to JOIN-4 within a row; first by hash, then what is left by slide."""
    ords = lambda a: F.transform(a, lambda x: x["ord"])
    left = lambda a, taken: F.filter(a, lambda x: ~F.array_contains(taken, x["ord"]))
    side = lambda pairs, name: F.transform(pairs, lambda p: p[name])

    def by_slide(first: Column) -> Column:
        return let(left(old, side(first, "old")), lambda o: let(left(new, side(first, "new")), lambda n: let(_ranked_pairs(o, n, "slide_num"), lambda second: ended(F.concat(first, second)))))

    def ended(pairs: Column) -> Column:
        alone = F.transform(F.array_except(ords(new), side(pairs, "new")), lambda k: F.struct(k.alias("new"), F.lit(None).cast("int").alias("old")))
        return let(side(F.sort_array(F.concat(pairs, alone)), "old"), lambda taken: then(taken, F.array_except(ords(old), side(pairs, "old"))))

    return let(_ranked_pairs(old, new, "hash"), by_slide)


def merged_sections(notes: DataFrame, labels: Labels = LABELS, keep_legacy: bool = True) -> DataFrame:
    """MRG-3, MRG-4: (note_path, merged) of notes (note_path, current, next) with sections: the next note with the matched sections' own text after them, and what no
    section took at the end. With keep_legacy an old note without sections is kept as a backup at the end; without it, it is replaced. Both notes are in a row, and so is all that is made of them: nothing moves.
    """
    rows = with_sections(notes.select("note_path", "current", "next"), "current", labels).withColumnRenamed("sections", "olds").drop("frontmatter", "preamble")
    rows = with_sections(rows, "next", labels).withColumnRenamed("sections", "news")
    memo = F.lit(f"\n\n> [!note] {labels.memo}\n> \n\n")

    def section(s: Column, old: Column) -> Column:
        after = F.when(trimmed(F.coalesce(old["after"], F.lit(""))) != "", old["after"]).otherwise(memo)
        number = s["slide_num"]
        return F.concat_ws("\n", F.concat(F.lit(f"## {labels.slide} "), number.cast("string")), F.lit(""), marker(number, s["hash"], s["dup"], "start", labels), trimmed(s["managed"]), marker(number, s["hash"], s["dup"], "end", labels), F.regexp_replace(after, r"^\n", ""))

    def orphan(o: Column) -> Column:
        dup = F.when(o["dup"].isNotNull(), F.concat(F.lit(" dup:"), o["dup"].cast("string"))).otherwise("")
        return F.concat(F.lit(f"<!-- {labels.tag}:orphan slide:"), o["slide_num"].cast("string"), F.lit(" hash:"), o["hash"], dup, F.lit(" -->\n"), trimmed(o["after"]))

    def emitted(taken: Column, orphans: Column) -> Column:
        body = F.array_join(F.transform("news", lambda s, i: section(s, F.get(F.col("olds"), F.get(taken, i)))), "\n")
        footer = F.when(F.size(orphans) > 0, F.concat(F.lit(f"\n\n## {labels.orphans}\n\n"), F.array_join(F.transform(orphans, lambda k: orphan(F.get(F.col("olds"), k))), "\n\n"), F.lit("\n"))).otherwise("")
        return F.concat("frontmatter", "preamble", body, footer)

    # an old note whose only content is of the single kind
    replaced = F.col("next") if not keep_legacy else F.when(trimmed(F.coalesce("current", F.lit(""))) == "", F.col("next")).otherwise(F.concat(F.regexp_replace("next", r"(?U)\s+$", ""), F.lit(f"\n\n## {labels.backup}\n\n"), trimmed(F.col("current")), F.lit("\n")))
    return rows.select("note_path", F.when(F.size("olds") == 0, replaced).otherwise(_matched(F.col("olds"), F.col("news"), emitted)).alias("merged"))


def merged_notes(notes: DataFrame, labels: Labels = LABELS, keep_legacy: bool = True) -> DataFrame:
    """SNK-2, MRG-5: (note_path, merged) of notes (note_path, current, next): new notes as they are, notes with sections on either side by sections, others by their block."""
    fresh = notes.where(F.col("current").isNull()).select("note_path", F.col("next").alias("merged"))
    there = notes.where(F.col("current").isNotNull())
    sectioned = has_sections(F.col("current"), labels) | has_sections(F.col("next"), labels)
    single = there.where(~sectioned).select("note_path", merged_single(F.col("current"), F.col("next"), labels).alias("merged"))
    return fresh.unionByName(single).unionByName(merged_sections(there.where(sectioned), labels, keep_legacy))


def reimported(spark: SparkSession, folder: str, incoming: DataFrame, labels: Labels = LABELS, keep_legacy: bool = True) -> tuple[int, DataFrame]:
    """SNK-2: a table of notes (path, content) after incoming ones (one for each path) were merged into it: (number of its version, all rows, with came (in this import) and was_update).

    Reads the newest version, merges, writes a new one and commits it; if another import was faster, it begins again with that one's notes. Notes that don't come in stay as they are.
    """
    flags = lambda df, came, there: df.withColumn("was_update", there).withColumn("came", F.lit(came))

    def merge(current: DataFrame | None) -> DataFrame:
        new = incoming.select(F.col("path").alias("note_path"), F.col("content").alias("next"))
        if current is None:
            return flags(new.select(F.col("note_path").alias("path"), F.col("next").alias("content")), True, F.lit(False))
        old = current.select(F.col("path").alias("note_path"), F.col("content").alias("current"))
        both = new.join(old, "note_path", "left")
        made = merged_notes(both.select("note_path", "current", "next"), labels, keep_legacy).join(both.select("note_path", F.col("current").isNotNull().alias("there")), "note_path")
        stay = current.join(incoming.select("path"), "path", "left_anti").select("path", "content")
        return flags(made.select(F.col("note_path").alias("path"), F.col("merged").alias("content"), "there"), True, F.col("there")).drop("there").unionByName(flags(stay, False, F.lit(False)))

    return updated_table(spark, folder, merge)


def _marks(content: Column, labels: Labels) -> Column:
    """What matching needs of a note's sections: array of (ord, slide_num, hash)."""
    narrow = lambda x: F.transform(x["sections"], lambda s: F.struct(s["ord"].alias("ord"), s["slide_num"].alias("slide_num"), s["hash"].alias("hash")))
    return let(F.coalesce(content, F.lit("")), lambda text: narrow(sections_of(text, labels)))


def update_summary(notes: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """MRG-6: what a re-import would change, for notes (note_path, current, next, concept_names)."""
    cur, nxt = F.col("current"), F.col("next")
    own = lambda x: F.coalesce(F.nullif(split_managed(x, labels)["managed"], F.lit("")), x)
    is_update = cur.isNotNull()
    df = kept(notes.select("note_path", "concept_names", is_update.alias("is_update"), own(cur).alias("__c"), own(nxt).alias("__n"), has_sections(cur, labels).alias("__cs"), has_sections(nxt, labels).alias("__ns"), F.when(is_update & has_sections(nxt, labels), _marks(cur, labels)).alias("__old"), F.when(is_update & has_sections(nxt, labels), _marks(nxt, labels)).alias("__new")))
    is_update = F.col("is_update")
    only = lambda x, other: F.when(is_update, x).otherwise(other)
    none = F.array().cast("array<string>")
    flat = df.select(
        "note_path",
        "is_update",
        only(capped_difference(headings(F.col("__n")), headings(F.col("__c"))), none).alias("added_sections"),
        only(capped_difference(headings(F.col("__c")), headings(F.col("__n"))), none).alias("removed_sections"),
        only(capped_difference(F.array_distinct("concept_names"), links(F.col("__c"))), F.col("concept_names")).alias("added_concepts"),
        only(capped_difference(links(F.col("__c")), F.col("concept_names")), none).alias("removed_concepts"),
        only(new_lines(F.col("__c"), F.col("__n")), F.lit(0)).alias("changed_line_count"),
        (is_update & F.col("__ns") & ~F.col("__cs")).alias("becomes_sectioned"),
    )
    each = lambda c: df.select(F.col("note_path").alias("note"), F.explode(c).alias("s")).select("note", "s.*")
    matches = matched_sections(each("__old"), each("__new"))
    in_order = lambda kind, by, x: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col(by), x.alias("x"))))), lambda s: s["x"])
    slides = matches.groupBy("note").agg(
        in_order("reorder", "new_ord", F.struct(F.col("old_slide").alias("from"), F.col("new_slide").alias("to"), F.col("new_hash").alias("hash"))).alias("slide_reorders"),
        in_order("insertion", "new_ord", F.col("new_slide")).alias("slide_insertions"),
        in_order("deletion", "old_ord", F.struct(F.col("old_slide").alias("slide_num"), F.col("old_hash").alias("hash"))).alias("slide_deletions"),
        in_order("drift", "new_ord", F.struct(F.col("new_slide").alias("slide_num"), F.col("old_hash").alias("old_hash"), F.col("new_hash").alias("new_hash"))).alias("slide_drifts"),
        ((F.count("old_ord") > 0) & (F.count_if(F.col("kind") == "deletion") > REPLACED_SHARE * F.count("old_ord"))).alias("confirm_deck_replacement"),
    )
    return flat.join(slides, F.col("note_path") == F.col("note"), "left").drop("note")
