import random
import re

import pytest
from pyspark.sql import functions as F

from notemill.operators import calls, concepts, log, merge, notes, ranks
from notemill.sources.files import kept as files_kept

L = notes.LABELS


def sections_of(content, labels=L):
    """One note, mark by mark: starts are paired with the first later free end of equal slide, hash and dup; what has no pair is dropped."""
    content = content or ""
    front = m.group() if (m := re.match(notes.FRONTMATTER, content)) else ""
    body = content[len(front) :]
    marks = [(m, m.group(1, 2, 3)) for m in re.finditer(labels.marker, body, re.ASCII)]
    free_ends = {}
    for k, (m, identity) in enumerate(marks):
        if m.group(4) == "end":
            free_ends.setdefault(identity, []).append(k)
    found = []
    for k, (m, identity) in enumerate(marks):
        if m.group(4) == "start":
            ends = free_ends.get(identity, [])
            at = next((e for e in ends if e > k), None)
            if at is not None:
                ends.remove(at)
                found.append((m, marks[at][0]))
    cut = lambda text: text[: h.start() + len(h.group(1))] if (h := re.search(labels.heading, text)) else text
    if not found:
        return {"frontmatter": front, "preamble": body, "sections": []}
    sections = []
    for k, (s, e) in enumerate(found):
        stop = found[k + 1][0].start() if k + 1 < len(found) else len(body)
        sections.append({"ord": k, "slide_num": int(s.group(1)), "hash": s.group(2), "dup": int(s.group(3)) if s.group(3) else None, "managed": body[s.end() : e.start()], "after": cut(body[e.end() : stop] if stop >= e.end() else "")})
    return {"frontmatter": front, "preamble": cut(body[: found[0][0].start()]), "sections": sections}


def block(n, digest, text, memo="", dup=""):
    m = f"<!-- {L.tag}:slide:{n} hash:{digest}{dup} "
    return f"## {L.slide} {n}\n\n{m}start -->\n{text}\n{m}end -->\n{memo}"


def note(*blocks, front="---\nt: 1\n---\n\n", head="# T\n\n"):
    return front + head + "\n".join(blocks)


A, B, C, D = ("a" * 8, "b" * 8, "c" * 8, "d" * 8)


def test_sections():
    text = note(block(1, A, "one", "mine\n"), block(2, B, "two"), "<!-- note:slide:9 hash:cccccccc start -->", block(3, C, "x", dup=" dup:2"))
    got = sections_of(text)
    assert [(s["slide_num"], s["hash"], s["dup"], s["managed"].strip()) for s in got["sections"]] == [(1, A, None, "one"), (2, B, None, "two"), (3, C, 2, "x")]
    assert got["preamble"] == "# T\n\n" and got["sections"][0]["after"].strip() == "mine"
    assert sections_of(None) == {"frontmatter": "", "preamble": "", "sections": []}
    assert sections_of("plain")["preamble"] == "plain"


def merged(spark, current, following, **how):
    df = spark.createDataFrame([("p", current, following)], "note_path string, current string, next string")
    return merge.merged_notes(df, **how).first().merged


def test_merge_keeps_own_text(spark):
    old = note(block(1, A, "one", "\nmemo of a\n"), block(2, B, "two", "\nmemo of b\n"), block(3, C, "three", "\nmemo of c\n"))
    new = note(block(1, B, "two!"), block(2, D, "new"), head="# New\n\n")
    got = merged(spark, old, new)
    assert got.startswith("---\nt: 1\n---\n\n# New\n\n")
    sections = sections_of(got)["sections"]
    assert [(s["hash"], s["after"].strip().split("\n")[0]) for s in sections] == [(B, "memo of b"), (D, f"> [!note] {L.memo}")]
    assert "memo of a" in got and "memo of c" in got and L.orphans in got
    assert merged(spark, old, old).count("memo of a") == 1


def test_merge_of_legacy_and_new(spark):
    new = note(block(1, A, "one"))
    assert merged(spark, None, new) == new
    assert "own words" in merged(spark, "own words", new)
    assert merged(spark, "own words", new, keep_legacy=False) == new
    single = f"---\na: 1\n---\nbefore\n{L.start}\nold\n{L.end}\nafter\n"
    got = merged(spark, single, single.replace("old", "NEW").replace("before", "x").replace("after", "y"))
    assert got == f"---\na: 1\n---\n\nbefore\n\n{L.start}\nNEW\n{L.end}\n\nafter\n"
    backup = merged(spark, "mine", single)
    assert L.backup in backup and "mine" in backup
    assert merged(spark, backup.replace(L.start, "").replace(L.end, ""), single) == single


def passes(old, new):
    """The four passes, step by step."""
    used, found = set(), {}
    for key in ("hash", "slide"):
        for i, n in enumerate(new):
            if i not in found:
                at = next((j for j, o in enumerate(old) if j not in used and o[key == "slide"] == n[key == "slide"]), None)
                if at is not None:
                    used.add(at)
                    found[i] = (at, key)
    return found, used


def test_matching_against_the_passes(spark):
    import random

    rng = random.Random(3)
    olds, news, want = [], [], {}
    for k in range(60):
        old = [(rng.choice("abc"), rng.randrange(4)) for _ in range(rng.randrange(6))]
        new = [(rng.choice("abc"), rng.randrange(4)) for _ in range(rng.randrange(6))]
        olds += [(k, i, s, h) for i, (h, s) in enumerate(old)]
        news += [(k, i, s, h) for i, (h, s) in enumerate(new)]
        found, used = passes(old, new)
        for i, (j, how) in found.items():
            want[k, i, j] = ("same" if old[j][1] == new[i][1] else "reorder") if how == "hash" else "drift"
        want |= {(k, i, None): "insertion" for i in range(len(new)) if i not in found}
        want |= {(k, None, j): "deletion" for j in range(len(old)) if j not in used}
    schema = "note int, ord int, slide_num int, hash string"
    got = merge.matched_sections(spark.createDataFrame(olds, schema), spark.createDataFrame(news, schema)).collect()
    assert {(r.note, r.new_ord, r.old_ord): r.kind for r in got} == want


def test_sections_matched_in_a_row_are_those_of_the_joins(spark):
    rng = random.Random(21)
    rows = []
    for n in range(60):
        deck = lambda: [(rng.randrange(1, 7), rng.choice([A, B, C, D])) for _ in range(rng.randrange(7))]
        old, new = deck(), deck()
        text = lambda d, own: note(*[block(k, h, f"text {i}", f"\n{own} {i}\n" if own else "") for i, (k, h) in enumerate(d)])
        rows.append((str(n), text(old, f"own{n}."), text(new, "")))
    df = spark.createDataFrame(rows, "note_path string, current string, next string")
    plan = merge.merged_sections(df)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString() and "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    merged = {r.note_path: r.merged for r in plan.collect()}
    each = lambda c: notes.with_sections(df, c).select(F.col("note_path").alias("note"), F.explode("sections").alias("s")).select("note", "s.*")
    matches = {}
    for r in merge.matched_sections(each("current"), each("next")).collect():
        matches.setdefault(r.note, []).append(r)
    for n, current, following in rows:
        olds, news = sections_of(current)["sections"], sections_of(following)["sections"]
        got = sections_of(merged[n])["sections"]
        if not olds:
            continue
        assert [(s["slide_num"], s["hash"], s["managed"].strip()) for s in got] == [(s["slide_num"], s["hash"], s["managed"].strip()) for s in news]
        taken = {m.new_ord: m.old_ord for m in matches.get(n, []) if m.new_ord is not None}
        for i, s in enumerate(got):
            own = olds[taken[i]]["after"].strip() if taken[i] is not None else ""
            assert (own in s["after"]) if own else ("own" not in s["after"].split("orphan")[0].split(L.orphans)[0])
        gone = [m.old_ord for m in matches.get(n, []) if m.kind == "deletion"]
        assert merged[n].count(":orphan slide:") == len(gone) and all(olds[k]["after"].strip() in merged[n] for k in gone)


def test_update_summary(spark):
    old = note(block(1, A, "one [[x]]"), block(2, B, "two"), block(3, C, "three"))
    new = note(block(1, B, "two"), block(2, D, "new\nnew"))
    df = spark.createDataFrame([("p", old, new, ["y"]), ("q", None, new, ["y"])], "note_path string, current string, next string, concept_names array<string>")
    got = {r.note_path: r for r in merge.update_summary(df).collect()}
    p = got["p"]
    assert (p.is_update, p.added_concepts, p.removed_concepts, p.slide_insertions, len(p.slide_deletions), p.confirm_deck_replacement) == (True, ["y"], ["x"], [2], 2, True) or p.slide_drifts
    assert got["q"].added_concepts == ["y"] and not got["q"].is_update


def test_links(spark):
    df = spark.createDataFrame([("Graph and graph of [[Graph]] c++ cost $1",)], "x string")
    got = df.select(notes.linked(F.col("x"), F.array(F.lit("graph"), F.lit("c++"), F.lit("$1")))).first()[0]
    assert got == "[[graph]] and [[graph]] of [[Graph]] [[c++]] cost [[$1]]"
    nested = spark.createDataFrame([("[[deep graph theory]]",)], "x string")
    assert nested.select(notes.linked(F.col("x"), F.array(F.lit("graph")))).first()[0] == "[[deep [[graph]] theory]]"
    assert nested.select(notes.linked(F.col("x"), F.array(F.lit("graph")), safe=True)).first()[0] == "[[deep graph theory]]"
    row = spark.createDataFrame([("# A\n## B \n[[x|y]] [[x]] [[z#k]] [[w]]",)], "x string").select(notes.headings(F.col("x")), notes.links(F.col("x")), notes.cited(F.col("x"), F.array(F.lit("w")))).first()
    assert tuple(row) == (["A", "B"], ["x", "w"], ["w"])


def test_names_that_are_no_letters_or_look_alike(spark):
    rows = [("ab a", ["", "a"], "[[a]]b [[a]]"), ("ab", [""], "ab"), ("", ["", "a"], ""), ("I i İ ı", ["i"], "[[i]] [[i]] İ ı"), ("I i İ ı", ["İ"], "I i [[İ]] ı"), ("isi ısı ISI", ["ısı", "ISI"], "[[ISI]] [[ısı]] [[ISI]]"), ("É é K k K", ["é", "k"], "[[é]] [[é]] [[k]] [[k]] [[k]]")]
    df = spark.createDataFrame(rows, "x string, names array<string>, want string")
    for r in df.select("want", notes.linked(F.col("x"), F.col("names")).alias("got")).collect():
        assert r.got == r.want


def test_links_of_a_large_dictionary_are_those_of_the_fold(spark):
    rng = random.Random(8)
    syllable = lambda: rng.choice(["gra", "ph", "the", "ory", "Ma", "x", "ß", "İ", "ſ", "Σας", "é", "K", "c++", "$1", "l(a)", "."])
    word = lambda: "".join(syllable() for _ in range(rng.randrange(1, 4)))
    names = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(1500)] + ["a[b", "x]] y", "[[gra", "Graph Theory", "graph", "GRAPH", "th", "p", "[[", " "]
    change = lambda w: rng.choice([w, w.upper(), w.lower(), w.title()])
    texts = [" ".join(change(rng.choice([*names, word(), "[[graph]]", "para-graph", "\n\n"])) for _ in range(rng.randrange(12))) for _ in range(25)] + ["", None]
    df = spark.createDataFrame([(i, t, 1, "o") for i, t in enumerate(texts)], "id int, text string, __n int, other string").repartition(3)
    book = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string").repartition(2)
    got = {r.id: r.text for r in notes.linked_texts(df, book, "id", "text", "name", "ord").collect()}
    wanted = [n for n in names if n.strip(" []")]
    want = {r.id: r.t for r in df.select("id", notes.linked(F.col("text"), F.array(*map(F.lit, wanted))).alias("t")).collect()}
    assert got == want
    assert notes.linked_texts(df, book.limit(0), "id", "text", "name", "ord").count() == len(texts)


def test_summaries_in_levels(spark):
    model = calls.OfflineProvider(max_input_tokens=60, words=4)
    parts = [("long", i, f"Lecture {i}. " + "word " * 40) for i in range(90)] + [("short", 0, "a b"), ("short", 1, None), ("empty", 0, "")]
    df = spark.createDataFrame(parts, "subject string, at int, body string").repartition(4)
    got = {r.subject: r for r in calls.summarized_parts(df, model, "subject", "at", files_kept, "body").collect()}
    assert got["short"].summary == model.generate_text("a b") and got["short"].n_levels == 0 and got["empty"].summary == model.generate_text("")
    assert got["long"].n_levels > 1 and got["long"].error is None and got["long"].n_failed == 0

    class Wordy(calls.OfflineProvider):
        def generate_text(self, prompt, system=""):
            return prompt + " and more"

    with pytest.raises(ValueError, match="too long"):
        calls.summarized_parts(df, Wordy(60), "subject", "at", files_kept, "body", levels=2)


def test_built_notes(spark):
    n = spark.createDataFrame([("id", "T", "CS", ["t"], ["graph"], "2026-01-01", None, "sum", "", "full"), ("p", "P", "CS", ["t"], ["graph"], "2026-01-01", "c", "", "", "partial")], "note_id string, title string, subject string, tags array<string>, names array<string>, date string, created_at string, summary string, processed string, parse_quality string")
    s = spark.createDataFrame([("id", 2, B, "a graph"), ("id", 1, A, "one")], "note_id string, slide_num int, hash string, commentary string")
    e = spark.createDataFrame([("id", 3, "429")], "note_id string, slide_num int, reason string")
    got = notes.page_anchored_note(n, s, e).first().content
    assert got.startswith('---\ntitle: "T"\nsubject: "CS"\ntags: [cs, t]\n') and "note_created" not in got and "slide_count: 2" in got
    assert got.index(A) < got.index(B) and "[[graph]]" in got and got.rstrip().endswith("3: 429")
    single = {r.note_id: r.content for r in notes.single_block_note(n).collect()}
    assert "Partial import" in single["p"] and L.no_summary in single["p"] and single["id"].count(L.start) == 1
    c = notes.concept_note(F.lit("N"), F.lit("D"), F.array(F.lit("r")), F.array(F.lit("l")), F.lit(""), F.lit(None), F.lit("c"))
    assert spark.range(1).select(c).first()[0] == f"---\ntags: [concept]\n---\n# N\n{L.definition} D\n{L.caution} c\n{L.lectures} [[l]]\n{L.related} [[r]]"
    exam = spark.createDataFrame([("CS", "X", "final", 2, "d", "body")], "subject string, title string, period string, n_lectures int, date string, body string")
    assert notes.exam_note(exam).first().path == "Exam/X.md"


def test_normalized_concepts(spark):
    schema = "subject string, ord int, name string, definition string, related_concepts array<string>, example string, caution string, lecture_context string"
    rows = [("s", 0, "Deep Learning", "", ["SGD", "deep-learning", "none", "sgd"], None, None, None), ("s", 1, " deep learning ", "d", ["SGD", "Loss"], "e", None, None), ("s", 2, "Loss", "l", ["DEEP LEARNING"], None, None, None), ("s", 3, " ", "x", [], None, None, None)]
    existing = spark.createDataFrame([("s", 0, "deep-learning"), ("s", 1, "sgd")], "subject string, ord int, name string")
    got = {r.name: r for r in concepts.normalized_concepts(spark.createDataFrame(rows, schema), existing, files_kept).collect()}
    assert set(got) == {"deep-learning", "Loss"}
    assert (got["deep-learning"].definition, got["deep-learning"].example, got["deep-learning"].related_concepts) == ("d", "e", ["sgd", "sgd", "Loss"])
    assert got["Loss"].related_concepts == ["deep-learning"]


@pytest.mark.parametrize("seed", range(2))
def test_relations_of_a_hot_name(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["W1", "w-2", "HOT", "w 3"]
    rows = [("s", i, rng.choice(["hot", "hot", *words]), "d", [rng.choice(words) for _ in range(rng.randrange(9))], None, None, None) for i in range(300)] + [("t", 0, "w1", "d", ["w1", "w2"], None, None, None), ("t", 1, "w2", "", None, None, None, None)]
    df = spark.createDataFrame(rows, "subject string, ord int, name string, definition string, related_concepts array<string>, example string, caution string, lecture_context string").repartition(3)
    old = spark.createDataFrame([("s", 0, "w-2"), ("s", 1, "Extra")], "subject string, ord int, name string")
    key = lambda x: re.sub(r"[\s_-]+", "", x.lower())
    want = set()
    for subject in ("s", "t"):
        known = {key(n): n for s, _, n in [("s", 0, "w-2"), ("s", 1, "Extra")] if s == subject}
        relations = {}
        for _, _, name, _, related, *_ in sorted((r for r in rows if r[0] == subject), key=lambda r: r[1]):
            relations.setdefault(known.get(key(name), name), []).extend(related or [])
        names = {*relations, *known.values()}
        allowed = {f for n in names for f in (n.lower(), key(n))}
        for name, related in relations.items():
            for pos, raw in enumerate(dict.fromkeys(related)):
                canonical = known.get(key(raw), raw)
                if key(canonical) != key(name) and {canonical.lower(), key(canonical)} & allowed:
                    want.add((subject, name, pos, canonical))
    got = [(r.subject, r.name, r.pos, r.related) for r in concepts.filtered_relations(df, old, files_kept).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [None, 5, 40])
def test_relations_are_shuffled_with_their_concepts(spark, most):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [("s", rng.randrange(10**6) * 1000 + i, "hot" if i % 3 else rng.choice(words), "d", rng.choices(words, k=rng.randrange(6)), None, None, None) for i in range(240)]
    df = spark.createDataFrame(rows, "subject string, ord long, name string, definition string, related_concepts array<string>, example string, caution string, lecture_context string").repartition(3)
    old = spark.createDataFrame([("s", 0, w) for w in words], "subject string, ord long, name string")
    plans, blocks = [], []

    def keep(x):
        plans.append(x._jdf.queryExecution().toString())
        x = files_kept(x)
        if "pos" in x.columns and "block" in x.columns and "at" not in x.columns:
            blocks.extend(r["count"] for r in x.where("name = 'hot'").groupBy("block").count().collect())
        return x

    relations = {}
    for _, _, name, _, related, *_ in sorted(rows, key=lambda r: r[1]):
        relations.setdefault(name, []).extend(related)
    want = {(name, pos, raw) for name, related in relations.items() for pos, raw in enumerate(dict.fromkeys(related)) if raw != name}
    how = {"most": most} if most else {}
    got = [(r.name, r.pos, r.related) for r in concepts.filtered_relations(df, old, keep, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any("InArrow" in p or "InPandas" in p for p in plans)
    assert len(blocks) == 1 if most is None else len(blocks) > 4


def test_concept_note_update(spark):
    text = f"# N\n{L.lectures} [[a]]\n{L.related} [[x]]"
    column = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    update = lambda *a: spark.range(1).select(concepts.updated_note(*map(column, a))).first()[0]
    got = update(text, "b$1", "ctx", None, "", ["x", "y"])
    assert got == f"# N\n{L.context} ctx\n\n{L.lectures} [[a]], [[b$1]]\n{L.related} [[x]], [[y]]"
    assert update(got, "b$1", "other", None, "", ["x"]) == got
    assert update("# N \n", "b", "c", None, "", ["y"]) == f"# N \n\n{L.context} c\n\n{L.lectures} [[b]]\n\n{L.related} [[y]]\n".replace("\n\n" + L.related, "\n" + L.related)
    assert update(f"x {L.lectures} inside\n{L.lectures}\nnext", "b", None, None, None, []) == f"x {L.lectures} inside\n{L.lectures} next, [[b]]"
    cur = spark.createDataFrame([("p", text), ("k", "keep")], "path string, content string")
    new = spark.createDataFrame([("p", "fresh", "b", None, None, None, ["y"]), ("n", "fresh", "b", None, None, None, ["y"])], "path string, fresh string, lecture string, lecture_context string, example string, caution string, related_concepts array<string>")
    got = {r.path: (r.action, r.content) for r in concepts.upserted_concept_notes(cur, new).collect()}
    assert got["n"] == ("inserted", "fresh") and got["k"] == ("kept", "keep") and got["p"][0] == "updated" and "[[b]]" in got["p"][1]


LOG = "seq long, url string, record_id string, path string"


def test_log(spark):
    keep = files_kept
    old = spark.createDataFrame([(1, "u", "", "p"), (2, "v", "i", "q")], LOG)
    new = spark.createDataFrame([(3, "u", None, "z"), (4, "w", "i", "q"), (5, "", "", "r")], LOG)
    assert [(r.seq, r.was_update) for r in log.upserted_log(old, new, keep).collect()] == [(5, False), (4, True), (3, True)]
    # a record with an id, and one without that has the same url: one entry, and the newest isn't merged with others by their keys alone
    old = spark.createDataFrame([(1, "u1", "A", "p1")], LOG)
    new = spark.createDataFrame([(2, "u1", None, "p2")], LOG)
    assert [(r.seq, r.was_update) for r in log.upserted_log(old, new, keep).collect()] == [(2, True)]
    files = spark.createDataFrame([("q",)], "path string")
    assert [r.seq for r in log.still_there(spark.createDataFrame([(1, "p"), (2, "q")], "seq long, path string"), files).collect()] == [2]
    decks = spark.createDataFrame([("a.pdf",)], "path string")
    assert [r.deck_path for r in log.with_deck(spark.createDataFrame([("a.md",), ("b.md",)], "path string"), decks).orderBy("path").collect()] == ["a.pdf", None]


def log_by_force(before, records, most):
    """The log one record after the other: [(seq, was_update)], and the seqs that are left."""
    entries, out = list(before), []
    for r in records:
        same = lambda e, r=r: e[2] == r[2] if e[2] and r[2] else e[1] == r[1] if e[1] and r[1] else e[3] == r[3]
        at = next((i for i, e in enumerate(entries) if same(e)), None)
        out.append((r[0], at is not None))
        if at is not None:
            entries.pop(at)
        seen, left = set(), []
        for e in [r, *entries]:
            key = e[2] or e[1] or e[3]
            if key not in seen:
                seen.add(key)
                left.append(e)
        entries = left[:most]
    return out, [e[0] for e in entries]


@pytest.mark.parametrize("seed,most,n,kinds", [(1, 5, 200, 9), (2, 5, 150, 3), (3, 50, 900, 60), (4, 8, 300, 300), (5, 50, 120, 200), (6, 4, 260, 2), (7, 1, 40, 4)])
def test_log_is_the_fold(spark, seed, most, n, kinds):
    rng = random.Random(seed)
    some = lambda name: rng.choice([None, "", *[f"{name}{rng.randrange(kinds)}"] * 3])
    rows = [(i, some("u"), some("i"), f"p{rng.randrange(kinds)}") for i in range(n)]
    before, after = rows[: n // 6], rows[n // 6 :]
    _, seqs = log_by_force([], before, most)
    history = [r for r in before if r[0] in seqs]
    want, left = log_by_force(sorted(history, reverse=True), after, most)
    updates, got = log.upserts(spark.createDataFrame(history, LOG), spark.createDataFrame(after, LOG).repartition(3), files_kept, most)
    assert sorted((r.seq, r.was_update) for r in updates.collect()) == want and got == left


def test_empty_logs(spark):
    none = spark.createDataFrame([], LOG)
    some = spark.createDataFrame([(1, "u", None, "p")], LOG)
    assert log.upserted_log(none, none, files_kept).collect() == []
    assert [r.seq for r in log.upserted_log(some, none, files_kept).collect()] == [1]
    assert [(r.seq, r.was_update) for r in log.upserted_log(none, some, files_kept).collect()] == [(1, False)]


@pytest.mark.parametrize("seed", range(3))
def test_scans_over_ranges(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b", f"k{i}"]), rng.randrange(50), i, rng.choice([None, *range(-5, 9)])) for i in range(rng.choice([1, 40, 400]))]
    df = spark.createDataFrame(rows, "k string, at int, i int, v int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ranks.running(df, ["k"], ["at", "i"], files_kept, {"total": ("sum", "v"), "most": ("max", "v"), "before": ("lag", "v")}).collect()
        places = {r.i: r.pos for r in ranks.numbered(df, ["k"], ["at", "i"], files_kept).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in {r[0] for r in rows}:
        total, most, before = 0, None, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])):
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            want[i] = (total, most, before, n)
            before = v
    assert {r.i: (r.total, r.most, r.before, places[r.i]) for r in got} == want and len(got) == len(rows)
    assert ranks.numbered(df.limit(0), ["k"], ["at"], files_kept).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_call_windows(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(k, i, i * rng.randrange(1, 9) + k, rng.choice(["rate_limit", "success", "other", "success", "rate_limit"])) for k in range(6) for i in range(rng.randrange(1, 25) if k else 120)]  # one of most rows
    rows = [(k, i, sum(r[2] for r in rows if r[0] == k and r[1] < i), o) for k, i, _, o in rows]
    df = spark.createDataFrame(rows, "k int, i int, arrival long, outcome string")
    kept, starts, index = set(), {}, {}
    for k in range(6):
        streak, stopped, last, hits = 0, False, None, 0
        for _, i, a, o in sorted(r for r in rows if r[0] == k):
            starts[k, i] = last = a if last is None else max(a, last + 5)
            index[k, i] = hits % 3
            hits += o == "rate_limit"
            if not stopped:
                kept.add((k, i))
                streak = 0 if o == "success" else streak + (o == "rate_limit")
                stopped = streak >= 3
    assert {(r.k, r.i) for r in calls.until_break(df, "k", "i", files_kept).collect()} == kept
    assert {(r.k, r.i): r.start for r in calls.spaced(df, "k", "arrival", 5, "i", files_kept).collect()} == starts
    assert {(r.k, r.i): r.key_index for r in calls.rotated(df, "k", "i", 3, files_kept).collect()} == index


def test_providers(spark):
    model = calls.provider("offline")
    assert model.generate_text("a b") == model.generate_text("a b") != model.generate_text("a c")
    with pytest.raises(ValueError):
        calls.provider("nobody")
    slept = []
    answers = iter([calls.RateLimited(), "ok"])

    def ask():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert calls.with_retry(ask, slept.append) == "ok" and slept == [65.0]

    pictures = spark.createDataFrame([(1, "p", [bytearray(b"x")]), (2, "p", [])], "id long, prompt string, images array<binary>")
    said = {r.id: r.answer for r in calls.generated(pictures, model, ["id"], images_col="images").collect()}
    assert said == {1: model.generate_multimodal("p", [b"x"]), 2: model.generate_text("p")}

    class Flaky:
        max_input_tokens, n = 10, 0

        def generate_text(self, prompt, system=""):
            self.n += 1
            return "no" if self.n < 3 else '```json\n{"a": 1}\n```'

    assert calls.generate_json(Flaky(), "p", lambda x: x["a"]) == 1
    used = []
    keys = calls.RotatingKeys(["k1", "k2"], clock=lambda: 0.0, sleep=slept.append)

    def refuse(key):
        used.append(key)
        if key == "k1":
            raise calls.RateLimited
        return key

    assert keys.call(refuse) == "k2" and used == ["k1", "k2"] and keys.call(refuse) == "k2"
    long = spark.createDataFrame([("s", "para one.\n\n" * 4000), ("t", "short")], "subject string, text string")
    got = {r.subject: r.summary for r in calls.summarized(long, model, "subject").collect()}
    assert set(got) == {"s", "t"} and all(got.values())


def test_sections_in_the_jvm_are_those_of_the_scan(spark):
    """Orderly and odd notes alike: pairs in order, crossed, repeated, cut off, headings anywhere."""
    import random

    rng = random.Random(13)
    mark = lambda k, h, dup, kind: f"<!-- note:slide:{k} hash:{h}{f' dup:{dup}' if dup else ''} {kind} -->"
    texts = ["", "---\na: b\n---\n\n", "plain", f"\n## {L.slide} 3\nx", None]
    for _ in range(150):
        parts = [rng.choice(["", "---\na: b\n---\n\n", "---\nopen\n"])]
        for k in range(rng.randrange(5)):
            identity = (k, rng.choice([A, B]), rng.choice([None, None, 2]))
            body = [mark(*identity, "start"), rng.choice(["\nbody\n", "", f"\n## {L.slide} 9\n"]), mark(*identity, "end"), rng.choice(["\n\n> own\n", "", f"tail\n\n## {L.slide} {k + 1}\nhead\n", f"## {L.slide} x\n", f"a\n## {L.slide} 1\nb\n## {L.slide} 2\n"])]
            if rng.random() < 0.15:
                body.pop(rng.randrange(len(body)))
            if rng.random() < 0.1:
                body.reverse()
            parts += [rng.choice(["pre\n", "", f"\n## {L.slide} {k}\n\n"]), *body]
        texts.append("".join(parts))
    df = spark.createDataFrame(enumerate(texts), "i int, content string")
    got = {r.i: r.asDict(recursive=True) for r in notes.with_sections(df).collect()}
    for i, t in enumerate(texts):
        want = sections_of(t)
        assert {k: got[i][k] for k in ("frontmatter", "preamble", "sections")} == want, t
    assert "Python" not in notes.with_sections(df)._jdf.queryExecution().executedPlan().toString()
    pairs = df.select("i", notes.paired_sections(F.coalesce("content", F.lit(""))).alias("s")).collect()
    assert all(r.s.asDict(recursive=True) == sections_of(texts[r.i]) for r in pairs)
    odd = df.select(F.count_if(notes.orderly_sections(F.coalesce("content", F.lit(""))).isNull())).first()[0]
    assert 20 < odd < 100


def test_links_fold_a_text_once(spark):
    """The text's folding is bound outside of what is done for each name."""
    df = spark.createDataFrame([(1, "deep graph theory of GRAPH theory and graphs")], "id int, text string")
    book = spark.createDataFrame([(i, n) for i, n in enumerate(["graph theory", "graph", "theory of", "deep x graph"])], "ord int, name string")
    out = notes.linked_texts(df, book, "id", "text", "name", "ord")
    assert out.first().text == "deep [[graph theory]] of [[graph theory]] and [[graph]]s"
    assert "transform(array(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_new_lines_takes_a_notes_lines_once(spark):
    df = spark.createDataFrame([("a\n b\n\nb", "b\nc\n c \na\n\nd"), ("", "x\nx"), ("x", "")], "a string, b string")
    out = df.select(merge.new_lines(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in out.collect()] == [3, 2, 0]
    tests = out._jdf.queryExecution().optimizedPlan().toString().split("array_contains(")[1:]
    assert tests and all(t.startswith("lambda") for t in tests)
