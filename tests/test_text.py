import math
import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import chunk, extract, relevance
from notemill.sources import files


def one(spark, expression, *rows, columns=("x",)):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{c} string" for c in columns))
    return [r[0] for r in df.select(expression).collect()]


def test_names_and_keys(spark):
    names = ['a<b>:"c"/d\\e|f?g*h...', "  Deep　Learning ", "x\x01y.", "", None, "A-B_c d"]
    assert one(spark, T.sanitized(F.col("x")), *names) == ["abcdefgh", "Deep　Learning", "xy", "", None, "A-B_c d"]
    assert one(spark, T.concept_key(F.col("x")), *names) == ["abcdefgh", "deeplearning", "xy", "", None, "abcd"]
    assert one(spark, T.subject_key(F.col("x")), "Ab. ") == ["ab."]
    assert one(spark, T.slug(F.col("x")), "a  b?\tc ") == ["a b c"]
    assert one(spark, T.lock_key(F.col("x")), " Ab ") == ["ab"]


def test_entities_decode_twice_ampersand_first(spark):
    assert one(spark, T.decoded(F.col("x")), "&amp;lt;b&amp;gt; &#39;&quot;") == ["<b> '\""]


def test_hashes(spark):
    import base64
    import hashlib

    want = hashlib.sha1(b"abc").hexdigest()[:8]
    assert one(spark, T.content_hash(F.col("x")), "abc") == [want]
    assert one(spark, T.base64_hash(F.col("x")), base64.b64encode(b"abc").decode()) == [want]
    assert one(spark, T.numbered_hash(F.col("x"), F.lit(3)), "n") == [hashlib.sha1(b"n:3").hexdigest()[:8]]
    assert one(spark, T.data_url_bytes(F.col("x")), "data:image/png;base64,YWJj") == [b"abc"]


def test_page_text_and_numbers(spark):
    assert one(spark, T.page_text(F.col("x")), " a \n b con-  nect 1- 2 ") == ["a b connect 1- 2"]
    assert one(spark, T.rate_delay(F.col("x")), "6000abc", "12", "0", "x", "", "-5") == [6000, 1000, 4000, 4000, 4000, 1000]
    assert one(spark, T.zoom(F.col("x").cast("double")), "0.1", "2", "9") == [0.6, 2.0, 3.0]
    assert one(spark, T.render_scale(F.col("x").cast("double")), "100", "2048") == [2.0, 0.5]


def test_error_kinds(spark):
    said = ["HTTP 429", "503 busy", "model overload", "401", "boom", "quota exceeded"]
    assert one(spark, T.error_kind(F.col("x")), *said) == ["rate_limit", "overload", "overload", "fatal", "other", "rate_limit"]


def test_truncation(spark):
    assert one(spark, T.head_and_tail(F.col("x"), 10, "|"), "abcdefghijkl", "short") == ["abcdefg|jkl", "short"]
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .?!\n") for _ in range(rng.randrange(60))) for _ in range(300)]

    def want(t, n=30):
        if len(t) <= n:
            return t
        part = t[:n]
        end = max(part.rfind(e) for e in (". ", "? ", "! "))
        return (part[: end + 1] if end > n * 0.6 else part).strip()

    assert one(spark, T.at_sentence(F.col("x"), 30), *texts) == [want(t) for t in texts]


def test_hosts_subjects_ids(spark):
    hosts = ("notes.example", "www.notes.example")
    urls = ["https://notes.example/a", "https://x.notes.example/", "not a url", None, "https://WWW.notes.example/n/1"]
    assert one(spark, T.allowed_host(F.col("x"), hosts), *urls) == [True, False, False, False, True]
    assert one(spark, T.allowed_note_url(F.col("x"), "notes.example"), "https://a.notes.example/note/1", "https://notes.example/en/note/1", "https://evilnotes.example/note/1") == [True, False, False]
    assert one(spark, T.id_from_url(F.col("x")), "https://a/b?q=1", "https://a/b/", "") == ["b?q=1", "unknown", "unknown"]
    assert one(spark, T.suggested_subject(F.col("x")), "cs 101 intro", "Graph Theory", "a_b", "Brand 4") == ["CS101", "Graph", "a", "Brand"]
    assert one(spark, T.summary_action(F.col("x"), F.lit("t")), "a" * 499, "a" * 500, "a" * 2500) == ["generate", "enhance", "skip"]
    assert one(spark, T.summary_action(F.col("x"), F.lit("")), "a") == ["keep"]


def greedy(text, most):
    """The chunker, step by step."""
    size = lambda x: math.ceil(len(x) / 4)
    if size(text) <= most:
        return [text]
    out, now, used = [], "", 0
    for p in re.split(r"\n\n+", text):
        whole = size(p) <= most
        if used + size(p) > most and now:  # room for all of a paragraph, be it cut or not
            out.append(now.strip())
            now, used = "", 0
        for piece in [p] if whole else re.split(r"(?<=[.!?])\s+", p):
            if used + size(piece) > most and now:
                out.append(now.strip())
                now, used = "", 0
            now += piece + ("\n\n" if whole else " ")
            used += size(piece)
    return out + ([now.strip()] if now.strip() else [])


@pytest.mark.parametrize("most", [1, 3, 8])
def test_chunks(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice(["ab", "c. ", "d! ", "\n\n", "\n\n\n", "efghij", " "]) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "    \n\n  " * 9]
    assert one(spark, chunk.chunks(F.col("x"), most), *texts) == [greedy(t, most) for t in texts]


def test_chunks_of_thousands_of_paragraphs(spark):
    text = "\n\n".join(f"Paragraph {i} of a long text, with some words." for i in range(8000))
    df = spark.createDataFrame([(text,)], "x string").select(chunk.chunks(F.col("x"), 100).alias("c"))
    df.collect()
    began = time.perf_counter()
    assert df.first().c == greedy(text, 100)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("most,ranges", [(1, 7), (3, 4), (8, 2), (40, 5)])
def test_chunks_of_parts(spark, most, ranges):
    rng = random.Random(most)
    word = lambda: rng.choice(["ab", "c. ", "d! ", "\n\n", "\n\n\n", "efghij", " ", "k" * 30])
    parts = [(k, i, "".join(word() for _ in range(rng.randrange(9)))) for k in ("a", "b", None) for i in range(rng.randrange(1, 12))]
    parts += [("hot", i, "".join(word() for _ in range(12))) for i in range(120)] + [("short", 0, "x"), ("short", 1, "y"), ("void", 0, ""), ("null", 0, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {}
        for r in chunk.chunked_parts(spark.createDataFrame(parts, "subject string, at int, body string").repartition(3), "subject", "at", "body", most, files.kept).collect():
            got.setdefault(r.subject, {})[r.chunk] = r.text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in {p[0] for p in parts}:
        text = "\n\n".join(t.strip("\n") for key, _, t in sorted(parts, key=lambda p: p[1]) if key == k and (t or "").strip("\n"))
        want = greedy(text, most)
        assert [got.get(k, {}).get(i) for i in range(max(len(want), len(got.get(k, {}))))] == want, (k, text)


def test_chunks_of_parts_keep_rows_for_parts_not_for_pieces(spark):
    rng = random.Random(5)
    parts = [("k", i, " ".join(rng.choice(["ab.", "c!", "\n\nefghij"]) for _ in range(200)) + "\n" * (i % 3)) for i in range(9)] + [("l", 0, "x. " * 90), ("l", 1, "   ")]
    most, counts, texts = 12, [], []

    def keep(x):
        x = files.kept(x)
        counts.append(x.count())
        texts.append("text" in x.columns)
        return x

    got = {(r.subject, r.chunk): r.text for r in chunk.chunked_parts(spark.createDataFrame(parts, "subject string, at int, body string"), "subject", "at", "body", most, keep).collect()}
    want = {(k, i): t for k in "kl" for i, t in enumerate(greedy("\n\n".join(t.strip("\n") for key, _, t in parts if key == k), most))}
    assert got == want
    assert max(counts) == len(parts) and sum(texts) == 1


def test_fill_is_the_fold_from_every_state():
    rng = random.Random(1)
    for most in (0, 1, 5, 30):
        sizes = [(rng.randrange(8), 0) for _ in range(60)]
        sizes = [(t, max(t, rng.choice([t, t, most + 1]))) for t, _ in sizes]
        fill = chunk.Fill(most)
        for piece in sizes:
            fill.add(*piece)
        for state, (exits, begun) in enumerate(zip(fill.exits(), fill.begun(), strict=True)):
            n = 0
            for t, need in sizes:
                fresh = state == 0 or state - 1 + need > most
                n += fresh
                state = min((0 if fresh else state - 1) + t, most + 1) + 1
            assert (state, n) == (exits, begun)


def test_even_slices(spark):
    df = spark.createDataFrame([("abcdefg", 3), ("ab", 4), ("", 2), (None, 2), ("x", 0)], "t string, n int")
    assert [r[0] for r in df.select(chunk.even_slices(F.col("t"), F.col("n"))).collect()] == [["abc", "def", "g"], ["a", "b", None, None], [None, None], [None, None], []]


def test_packed_context(spark):
    rng = random.Random(5)
    pages = [("d", n, ". ".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 60)))) for n in range(1, 15)]

    def cut(t, n):
        if len(t) <= n:
            return t
        end = max(t[:n].rfind(e) for e in (". ", "? ", "! "))
        return (t[:n][: end + 1] if end > n * 0.6 else t[:n]).strip()

    lines, used = [], 0
    for _, n, t in pages:
        if 3000 - used <= 0:
            break
        t = cut(t, min(900, 3000 - used))
        if t:
            lines.append(f"[p.{n}] {t}")
            used += len(lines[-1])
    totals = spark.createDataFrame([("d", 14, 99_999)], "deck_id string, page_count int, extracted_chars long")
    got = relevance.packed_context(spark.createDataFrame(pages, "deck_id string, page_num int, text string"), totals, 3000).first()
    assert (got.text, got.used_chars, got.truncated) == ("\n".join(lines), used, True)


def test_terms(spark):
    assert one(spark, relevance.seed_terms(F.col("x")), "The Graph-based graph-based 알고리즘 정리다 abc tree") == [["graph-based", "알고리즘", "tree"]]


PUSHED = 'self.__next_f.push([1,"{}"])'


def page(spark, html, url="https://notes.example/note/7"):
    return extract.resolve(spark.createDataFrame([(url, html)], "url string, html string")).first()


def test_payload_fields(spark):
    summary = "## Head\\n" + "word " * 60
    inner = f'{{"noteTitle":"T","createdAt":"2026-01-02T","memo":"a &amp;lt; b","slides_url":"https://s/x\\u0026y","token":"{"a" * 36}","s":"{summary}"}}'
    import json

    html = PUSHED.format(json.dumps(inner)[1:-1]) + PUSHED.format(json.dumps('[{"createdAt":1,"segments":[{"text":" one "},{"text":""},{"text":"two"}]}]')[1:-1])
    got = page(spark, html)
    assert (got.title, got.created_at, got.note_id, got.transcript, got.parse_quality) == ("T", "2026-01-02T", "a" * 36, "one two", "full")
    assert got.pdf_url == "https://s/x&y"
    assert got.summary.startswith("## Head\nword") and got.error is None


def test_partial_and_error_pages(spark):
    og = '<meta property="og:title" content="A &amp; B | Notes"/><META property="og:description" content="D">'
    got = page(spark, og)
    assert (got.title, got.summary, got.parse_quality, got.note_id) == ("A & B | Notes", "D", "partial", "7")
    full = page(spark, og + PUSHED.format('{\\"memo\\":\\"m\\"}'))
    assert (full.title, full.summary, full.parse_quality) == ("A & B", "m", "full")
    assert page(spark, "nothing").error and page(spark, None).error


def test_bad_escape_and_early_bracket(spark):
    df = spark.createDataFrame([(PUSHED.format(r'{\"noteTitle\":\"x\"} \q'),), (PUSHED.format('a])b \\"noteTitle\\":\\"y\\"'),)], "html string").withColumn("url", F.lit("u"))
    assert [r.title for r in extract.parse_payload(df).collect()] == ["x", None]


def test_model_answers(spark):
    good = '```json\n{"concepts":[{"name":"n","definition":null,"relatedConcepts":["a"],"example":""}],"tags":[]}\n```'
    got = [r[0] for r in spark.createDataFrame([(good,), ("{",), ('{"tags":[]}',)], "x string").select(extract.concept_answer(F.col("x"))).collect()]
    assert got[1:] == [None, None]
    assert got[0].concepts == [Row(name="n", definition="", related_concepts=["a"], example=None, caution=None, lecture_context=None)]


def test_long_strings_by_raw_length(spark):
    texts = ['q"' + "a" * 96 + '"', 'q"' + "a" * 94 + '"', "\\" * 50, "\\" * 49 + "b", "\\" * 3 + '"' * 47, "c" * 100, "c" * 99]
    payload = F.to_json(F.split("x", "\n"))
    assert one(spark, extract.long_strings(payload, extract.LONG_RAW_STRING), "\n".join(texts)) == [[texts[5], texts[0], texts[2], texts[4]]]
    assert one(spark, extract.long_strings(payload), "\n".join(texts)) == [[texts[5]]]
