"""Operators 1, 5, 9 and 10 against brute force and round trips."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import substring_dedup as dedup
from notemill.llm.bpe import BytePairEncoder, encode_texts
from notemill.llm.html_main import clusters, extract_main, main_text, smoothed
from notemill.llm.order_minhash import fingerprints, with_next
from notemill.llm.suffix_groups import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed_by_force(rows):
    first = {}
    for k, t in rows:
        if k is not None:
            d = (t or "").encode()
            for i in range(len(d) - 49):
                w = d[i : i + 50]
                first[w] = min(first.get(w, k), k)
    out = []
    for k, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for i in range(len(d) - 49 if k is not None else 0):
            if first[d[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dedup_bytes(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert collected(dedup.dedup_bytes(odd_docs)) == removed_by_force(rows)
    assert dedup.dedup_bytes(no_docs).collect() == []


@pytest.mark.parametrize("hot,piece,split,again", [(0, 1 << 21, 256, False), (2, 900, 256, True), (2500, 300, 256, False), (2500, 1 << 21, 2, False), (3, 1 << 21, 1, True), (2500, 1 << 21, 256, True)])
def test_dedup_hot_keys_and_pieces(spark, monkeypatch, hot, piece, split, again):
    monkeypatch.setattr(dedup, "PIECE", piece)
    rng = random.Random(hot)
    blocks = ["".join(rng.choice("abc é") for _ in range(rng.randrange(30, 140))) for _ in range(25)]
    rows = [(k, "".join(rng.choice(blocks) if rng.random() < 0.5 else "".join(rng.choice("xyz") for _ in range(rng.randrange(50))) for _ in range(rng.randrange(12)))) for k in rng.sample(range(1000), 60)]
    if again:  # ids that several texts have
        rows = [(k // 60, t) for k, t in rows] + rows[:3] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = dedup.removed_runs
    monkeypatch.setattr(dedup, "removed_runs", lambda docs: whole(docs, share_bytes=2000, hot=hot, split=split, unit=4000))
    monkeypatch.setattr(dedup, "CHUNK", 1500)
    assert collected(dedup.dedup_bytes(df)) == removed_by_force(rows)


M64 = (1 << 64) - 1


def long_hash(x, seed=42):
    return xxhash.xxh64((x & M64).to_bytes(8, "little"), seed=seed).intdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def murmur(values, seed=42):
    """Murmur3 of longs, chained."""
    rotated = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = seed
    for v in values:
        for half in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            h ^= rotated(half * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rotated(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
    return h


def order_min_hash(text):
    """Every k-mer arrives in every register; each register's first two, in order of the text. No arrival is left out."""
    words = [x for w in re.split(r"[ \t\n\x0b\f\r]", text) for x in (w if len(w) > 32 else [w])]
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    seen, arrivals = Counter(), [[] for _ in range(64)]
    for place in range(len(words)):
        h = 42
        for x in hashes[place : place + 3]:
            h = long_hash(x, h)
        kmer = signed(h) >> 26
        z = long_hash(kmer) if not seen[kmer] else long_hash(signed(xxhash.xxh64((seen[kmer]).to_bytes(4, "little"), seed=long_hash(kmer)).intdigest()))
        seen[kmer] += 1
        for slot in range(64):
            start, moment = z >> 58, z >> 26 & 0x3FFFFFF
            register = (start + slot * ((moment & 31) * 2 + 1)) % 64
            own = moment if slot == 0 else long_hash(slot, long_hash(start << 58 | moment << 26)) >> 26 & 0x3FFFFFF
            arrivals[register].append((slot, own, place))
    out = []
    for register, a in enumerate(arrivals):
        names = [register << 58 | slot << 52 | moment << 26 for slot, moment, place in sorted(sorted(a)[:2], key=lambda x: x[2])]
        out.append(f"{murmur(names):08X}")
    return out


def test_signatures_are_order_min_hash(odd_docs, spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(n)) for n in (1, 2, 3, 7, 30, 70, 400)] + [" ".join(str(rng.randrange(n)) for _ in range(n)) for n in (100, 767, 768, 769, 3000)]
    texts += ["", " ", "x" * 33, "é" * 20, "".join(rng.choice("abcdefgh") for _ in range(600))]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    for k, t in enumerate(texts):
        want = order_min_hash(t)
        have = [got[k][i : i + 8] for i in range(0, len(got[k]), 8)]
        assert len(set(want) - set(have)) <= (len(t.split()) > 12), k  # a register may be left with fewer than two


def likeness_of(spark, a, b):
    """Of fingerprints of two texts."""
    near = fingerprints(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")).where("doc_id = 2").first().near_next
    x, y = set(order_min_hash(a)), set(order_min_hash(b))
    assert abs(near - len(x & y) / 64) <= 2 / 64
    return near


def test_likeness_follows_the_order_and_the_edits(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    edited = list(words)
    for i in rng.sample(range(1500), 30):
        edited[i] = f"new{i}"
    text = " ".join(words)
    assert 0.65 < likeness_of(spark, text, " ".join(edited)) < 0.95
    assert 0.3 < likeness_of(spark, text, " ".join(words[750:] + words[:750])) < 0.65
    assert likeness_of(spark, text, " ".join(words[::-1])) < 0.2
    bare = "".join(rng.choice("abcdefgh") for _ in range(600))
    assert likeness_of(spark, bare, bare[:300] + "Z" + bare[301:]) > 0.85


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_next_documents_of_uneven_ids(spark, ranges):
    """An outlying id, ids that many rows have, and rows without id."""
    rng = random.Random(ranges)
    rows = [(k, f"t{k}") for k in rng.sample(range(500), 60)] + [(1 << 60, "far")] + [(77_777, f"same{k}") for k in range(50)] + [(None, f"none{k}") for k in range(40)] + [(None, "none0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = with_next(df, {"text": "next_text"}, ranges).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))


def test_fingerprints(odd_docs, no_docs, spark):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    got = fingerprints(odd_docs).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in got:
        t = next(t for i, t in rows if i == r.doc_id)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got if r.n_chars > 800]
    assert sum(r.near_edited for r in long) / len(long) > 0.15 > 0.1 > sum(r.near_next for r in long if r.doc_id != 3) / len(long)
    assert fingerprints(no_docs).collect() == []
    two = spark.createDataFrame([(1, "a b c d e f g h"), (2, "h g f e d c b a")], "doc_id long, text string")
    a, b = fingerprints(two).collect()
    assert a.fingerprint != b.fingerprint
    one = fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def test_fingerprints_use_no_python(odd_docs):
    plan = fingerprints(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers as P

    return BytePairEncoder.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abcdetion -'\n", max_size=200))
def test_bpe_same_ids_and_round_trip(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_of_table(odd_docs, no_docs, reference):
    import public_tokenizers as P

    got = encode_texts(odd_docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert encode_texts(no_docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies on this page to do this and that.</div>
<aside>Side</aside><div class="ad">Buy</div>%s<section id="comments"><article><p>A long comment of a reader, longer than some paragraphs are.</p></article></section><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("holder", ["article", "main", "div", 'div class="story"'])
def test_main_text(holder):
    body = f"<{holder}><h1>Head &amp; &#233;</h1><p>First  <b>bold</b>\n paragraph that says a good deal of things.<br><p>Second, <a href=y>linked</a> text, and some more words.</p><div class=share>Share!</div><p>x</p><ul><li>one<li>two</ul></{holder.split()[0]}>"
    assert main_text(PAGE % body) == "Head & é\nFirst bold paragraph that says a good deal of things.\nSecond, linked text, and some more words.\nx\none\ntwo"


ARTICLE = "<h1>Headline</h1><p>The first paragraph of an article, and it says a good deal.</p><p>x</p><p>The second one says rather more than the first one did.</p>"
TEXT = "Headline\nThe first paragraph of an article, and it says a good deal.\nx\nThe second one says rather more than the first one did."


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post has-sidebar">%s</article>',
        '<article class="post comments-open">%s</article>',
        '<article class="entry no-sidebar">%s</article>',
        '<div id="page" class="site has-sidebar">%s</div>',
        '<div class="site sidebar-right"><div id="content">%s</div></div>',
        '<article><div class="article-header"><span>By X</span><h1>Headline</h1></div>%s</article>',
        "<article><header><p>By X</p><h1>Headline</h1></header>%s</article>",
        '<form id="aspnet"><div class="body">%s</div></form>',
        '<div class="form-page">%s</div>',
    ],
)
def test_names_that_only_mention_other_parts(page):
    body = ARTICLE.replace("<h1>Headline</h1>", "") if "Headline" in page else ARTICLE
    around = '<div class="site-header">Site</div><div class="mainNav"><a>Menu</a></div>%s<div class="related-posts"><p>Other</p></div><div id="sidebar-left">Left</div><div class="comment-list"><p>A reader says something here.</p></div><footer>End</footer>'
    assert main_text(f"<html><body>{around % (page % body)}</body></html>") == TEXT


def test_comments_stay_out_however_long():
    talk = "".join(f"<p>Comment number {k} says quite a lot, and more than the article.</p>" for k in range(40))
    assert main_text(f'<body><div class="main">{ARTICLE}</div><div id="comments">{talk}</div></body>') == TEXT
    assert main_text(f'<body><div class="main">{ARTICLE}</div><form class="search"><p>Search</p></form></body>') == TEXT


def test_smoothing_and_clusters_by_hand():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 30)
        sizes, tags, on = [[rng.randrange(k, m) for _ in range(n)] for k, m in ((1, 200), (0, 5), (0, 2))]
        ratio = [s / max(1, t) * o for s, t, o in zip(sizes, tags, on, strict=True)]
        weight = {d: math.exp(-(d**2) / 2) for d in range(-3, 4)}
        want = [sum(w * ratio[k + d] for d, w in weight.items() if 0 <= k + d < n) / sum(weight.values()) for k in range(n)]
        got = smoothed(np.array(sizes, float), np.array(tags, float), np.array(on, bool))
        assert np.allclose(got, want)
        runs, best = [], []
        for k in range(n):
            if on[k] and (k == 0 or not on[k - 1]):
                runs.append([])
            if on[k]:
                runs[-1].append(k)
        most = max((sum(sizes[k] for k in r) for r in runs), default=0)
        best = [k for r in runs if sum(sizes[k] for k in r) >= 0.1 * most for k in r]
        assert np.flatnonzero(clusters(np.array(on, bool), np.array(sizes, float))).tolist() == best


def test_main_text_of_long_and_repeated_pages(spark):
    long = "<html><body><nav>Menu</nav><article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(30_000)) + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", "<p>a</p>")], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in extract_main(df).collect())
    want = "\n".join(f"Paragraph {k} of a very long page." for k in range(30_000))
    assert got == [(1, "u", want, len(want))] * 2 + [(2, "u", "a", 1)]


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "plain", "<p>unclosed <b>text", "<html><body></body></html>", "<article><p>cut &am", "</div></p><p>x</p>", "<![if x]><p>y</p><!-- c", "<article>" + "<div>" * 3000 + "deep"]
    df = spark.createDataFrame([(k, "u", h, "clash") for k, h in enumerate(odd)] + [(None, None, "<p>z</p>", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_main(df).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8)] == ["", "", "plain", "unclosed text", "", "cut &am", "x", "y", "deep"]
    assert got[None] == "z" and extract_main(df.limit(0)).collect() == []
