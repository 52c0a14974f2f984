"""Operators 2, 3, 4, 6, 7, 8 and the pipeline against brute force and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.llm import near_dup, packing, quality, sentence_spans, toxicity
from notemill.llm.common import components, kept
from notemill.llm.hamming_search import OP2_SQL, nearest, op2_hamming_top_k, sign_code, top_k
from tests.oracle import assert_same


def test_top_k_same_as_sql(spark, sf):
    assert_same(op2_hamming_top_k, OP2_SQL, spark, sf)


@pytest.mark.parametrize("n,k,block,most", [(0, 3, 100, 100), (2, 5, 100, 100), (400, 4, 1000, 1000), (400, 4, 50, 7)])
def test_top_k_with_copies(spark, n, k, block, most):
    rng = random.Random(n)
    common = rng.getrandbits(63)
    rows = [(i, common if rng.random() < 0.4 else common ^ (1 << rng.randrange(63)) if rng.random() < 0.3 else rng.getrandbits(63)) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 5), (9999, None)], "id long, code long")
    queries = df.where("id % 7 = 0")
    want = {(q, r): (i, d) for q, c in rows if q % 7 == 0 for r, (d, i) in enumerate(sorted((bin(c ^ x).count("1"), i) for i, x in rows)[:k], 1)}
    assert {(r.query_id, r.rank): (r.id, r.distance) for r in top_k(df, queries, k, block, most).collect()} == want


def test_top_k_of_odd_vectors(spark):
    rows = [(1, [1.0, None, -1.0], "x"), (2, [], "x"), (3, None, "x"), (None, [1.0], "x"), (100, [1.0] * 80, "x"), (200, [0.0] * 64, "x"), (300, [0.0] * 64, "x")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, distance string")
    codes = df.select("id", sign_code(F.col("embedding")).alias("code"), "distance")
    got = sorted(tuple(r) for r in top_k(codes, codes.where("id % 100 = 0"), 3).collect())
    assert got == [(100, 1, 100, 0), (100, 2, 1, 63), (100, 3, 2, 64), (200, 1, 2, 0), (200, 2, 200, 0), (200, 3, 300, 0), (300, 1, 2, 0), (300, 2, 200, 0), (300, 3, 300, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 300), st.integers(1, 6), st.integers(1, 64))
def test_nearest_is_brute_force(seed, n, k, bits):
    rng = np.random.default_rng(seed)
    high = np.uint64((1 << bits) - 1)
    codes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) & high)
    ids = [sorted(rng.choice(10_000, rng.integers(1, k + 1), replace=False).tolist()) for _ in codes]
    queries = np.concatenate([codes[:5], rng.integers(0, 1 << 63, 5, dtype=np.uint64), [np.uint64((1 << 64) - 1)]])
    want = [(q, x, d) for q, c in enumerate(queries) for d, x in sorted((int(c ^ o).bit_count(), x) for o, own in zip(codes, ids, strict=True) for x in own)[:k]]
    assert list(nearest(codes, ids, queries, k)) == want


def test_a_query_far_from_a_million_codes():
    codes = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 1 << 20, dtype=np.uint64))
    queries = np.array([(1 << 64) - 1, (1 << 64) - (1 << 40)], np.uint64)
    got = list(nearest(codes, [[i] for i in range(len(codes))], queries, 3))
    for q in (0, 1):
        far = np.bitwise_count(codes ^ queries[q])
        assert [(x, d) for i, x, d in got if i == q] == [(int(i), int(far[i])) for i in np.lexsort((np.arange(len(codes)), far))[:3]]


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b], ids=["both", "exactly one"])
def test_toxicity_on_held_out_rows(spark, toxic):
    """Neither word tells anything alone where exactly one of them is toxic."""
    rng = random.Random(2)
    insults, groups = (["clod", "oaf"], ["gulls", "terns"]) if toxic(True, True) else (["clod"], ["gulls"])
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(1500):
        words = [rng.choice(filler) for _ in range(25)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words[3:3] = [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rows.append((k, " ".join(words), int(toxic(a, b))))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit_toxicity(df, df)
    got = {r.doc_id: r for r in toxicity.scored(df, machine).collect()}
    assert {k: r.held_out for k, r in got.items()} == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in got}
    held = [(t, got[k].score) for k, _, t in rows if got[k].held_out]
    positive, negative = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([p > n for p in positive for n in negative]) > 0.97  # both together count, either alone doesn't
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got.values())


def test_telling_pairs_by_force():
    rng = np.random.default_rng(5)
    x = rng.random((400, 30)) < 0.4
    y = (x[:, 3] ^ x[:, 17]).astype(np.float32)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    told = set()
    for i in range(30):
        for j in range(i):
            n = [[((x[:, i] == a) & (x[:, j] == b) & (y == k)).sum() + 0.5 for k in (0, 1)] for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))]
            odds = [math.log(c[1] / c[0]) for c in n]
            if abs(odds[0] - odds[1] - odds[2] + odds[3]) / math.sqrt(sum(1 / c for r in n for c in r)) >= 5:
                told |= {i, j}
    assert set(toxicity.telling_pairs(rows, y, x.sum(0), block=7).tolist()) == told == {3, 17}


def test_samples_have_one_row_for_each_id(spark):
    df = spark.createDataFrame([(1, f"t{k}", 1) for k in range(50)] + [(2, None, 1), (3, "x", 0)], "doc_id long, text string, toxic int")
    got = toxicity.labelled_sample(df, df.union(df), "toxic", 10).collect()
    assert sorted(tuple(r) for r in got if r.doc_id == 1) in ([], [(1, "t0", 1)]) and len(got) == len({r.doc_id for r in got})
    assert len(got) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in (1, 2, 3))


def test_toxicity_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(1, 80)] + [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(odd_docs, labels)
    got = toxicity.scored(odd_docs, machine).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(no_docs, machine).collect() == []
    assert toxicity.without_toxic(odd_docs, machine).columns == odd_docs.columns
    nobody = toxicity.fit_toxicity(odd_docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.scored(odd_docs, nobody).collect())


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        bad = rng.random() < 0.3
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40)]
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", "low" if bad and rng.random() < 0.8 else "s1", int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    model = quality.fit_quality(df, df.where("doc_id < 500"))
    got = {r.doc_id: r for r in quality.scored(df, model).collect()}
    assert np.mean([got[k].predicted == q for k, *_, q in rows]) > 0.98
    assert np.mean([(got[k].content_score >= 0.5) == q for k, *_, q in rows]) > 0.98
    sources = np.mean([(s != "low") == q for *_, s, q in rows])  # what metadata can tell at best
    assert 0.9 < sources - 0.02 <= np.mean([(got[k].metadata_score >= 0.5) == q for k, *_, q in rows])


def test_views_teach_each_other():
    """With few labels, what one view is sure about lets the other learn what no labelled row shows."""
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.5).astype(float)
    one = (2 * y - 1)[:, None] * 2 + rng.normal(0, 1, (3000, 1))
    other = np.stack([(2 * y - 1) * 2 + rng.normal(0, 1, 3000), rng.normal(0, 1, 3000)], 1)
    views = [one, other]
    first = np.arange(24)
    learnt = quality.CoTrained().fit([v[first] for v in views], y[first], [v[24:2000] for v in views])
    alone = quality.CoTrained().fit([v[first] for v in views], y[first], [v[:0] for v in views])
    score = lambda m: np.mean((m.score([v[2000:] for v in views])[0] >= 0.5) == y[2000:])
    assert score(learnt) > 0.97 and score(learnt) >= score(alone) - 0.005
    assert any(np.abs(a.weights - b.weights).max() > 0.1 for a, b in zip(learnt.views, alone.views, strict=True))


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(1, 80)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels)
    assert quality.scored(odd_docs, model).count() == odd_docs.count()
    assert quality.scored(no_docs, model).collect() == []
    nothing = quality.fit_quality(odd_docs.select("doc_id", "text"), labels.limit(0))
    assert all(r.predicted == 1 for r in quality.scored(odd_docs, nothing).collect())


def test_pack_takes_the_tightest_bin():
    rng = random.Random(4)
    for _ in range(40):
        rows = sorted(((rng.randrange(0, 130), rng.randrange(4), rng.randrange(9)) for _ in range(60)), reverse=True)
        placed = packing.pack([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 100)
        bins = defaultdict(list)
        members = defaultdict(set)
        for item, tokens, b in placed:
            bins[b].append(tokens)
            members[b].add(item)
        assert all(sum(t) <= 100 for t in bins.values())
        for m in members.values():
            assert len({rows[i][1] for i in m}) == len(m) == len({rows[i][2] for i in m})
        left = {}
        for item, tokens, b in placed:  # no bin was tighter
            size, source, cluster = rows[item]
            others = [v for v in left.values() if v[0] >= tokens and source not in v[1] and cluster not in v[2]]
            if tokens < 100 or size == 100:
                here = left.get(b)
                assert (here is None and not others) or (here in others and here[0] == min(v[0] for v in others)) or size > 100
            v = left.setdefault(b, [100, set(), set()])
            v[0] -= tokens
            v[1].add(source)
            v[2].add(cluster)


def test_packed_table(odd_docs, no_docs):
    sized = packing.measured(odd_docs)
    got = packing.packed(sized, capacity=100, shard_rows=30).collect()
    want = Counter()
    for r in sized.collect():
        want[r.doc_id] += r.n_tokens
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
    assert have == want and set(have) == set(want)
    fill = Counter()
    for r in got:
        fill[r.bin_id] += r.n_tokens
    assert max(fill.values()) <= 100
    members = defaultdict(set)
    for r in got:
        members[r.bin_id].add(r.doc_id)
    of = defaultdict(set)
    for r in sized.collect():
        of[r.doc_id].add((r.source, r.cluster))
    for ids in members.values():
        one = [next(iter(of[i])) for i in ids if len(of[i]) == 1]
        assert len({s for s, _ in one}) == len({c for _, c in one}) == len(one)  # no two of a source or cluster in a bin
    assert packing.packed(packing.measured(no_docs)).collect() == []


def test_packed_rows_without_ids_are_dealt_evenly(spark, no_docs):
    df = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "s").otherwise(F.col("id").cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("cluster"), F.lit(5).alias("n_tokens"))
    got = packing.packed(df, shard_rows=1000)
    shards = {r.shard: r["count"] for r in got.groupBy(F.shiftright("bin_id", 32).alias("shard")).count().collect()}
    assert sum(shards.values()) == 9000 and len(shards) == 9 and max(shards.values()) < 1200


def cut_by_hand(text):
    """Sentences, character by character: they end with the white space after a stop, or with a line."""
    out, now, at = [], "", 0
    while at < len(text):
        now += text[at]
        stop = text[at] in ".!?" and at + 1 < len(text) and text[at + 1].isspace() and "\n" not in now
        if stop or text[at] == "\n" or at + 1 < len(text) and text[at + 1] == "\n" and now.strip("\n"):
            while at + 1 < len(text) and text[at + 1].isspace():
                at += 1
                now += text[at]
            out.append(now)
            now = ""
        at += 1
    return [*out, now] if now else out


def runs_by_hand(parts):
    """(text, sentences) of every shortest run that counts, from each sentence on and up to each."""
    words = [(k, p.lower().split()) for k, p in enumerate(parts) if p.split()]
    size = lambda a, b: sum(len(w) for _, w in words[a : b + 1])
    counts = lambda a, b: size(a, b) >= (40 if a == b else 20)
    n = len(words)
    found = set()
    for k in range(n):
        found.add(next(((k, b) for b in range(k, n) if counts(k, b)), None))
        found.add(next(((a, k) for a in range(k, -1, -1) if counts(a, k)), None))
    return [(" ".join(x for _, w in words[a : b + 1] for x in w), range(words[a][0], words[b][0] + 1)) for a, b in sorted(found - {None})]


def spans_by_force(rows):
    first = {}
    cut = {k: cut_by_hand(t or "") for k, t in rows}
    for k, parts in cut.items():
        for text, _ in runs_by_hand(parts):
            first[text] = min(first.get(text, k), k)
    out = {}
    for k, parts in cut.items():
        gone, seen = set(), set()
        for text, covered in runs_by_hand(parts):
            if first[text] < k or text in seen:
                gone |= set(covered)
            seen.add(text)
        out[k] = "".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_sentence_spans(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()]
    got = sentence_spans.drop_repeats(odd_docs)
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns and got.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in got.where("doc_id is not null").collect()}
    assert texts == spans_by_force(rows)
    assert texts[2] == "" and texts[1] == dict(rows)[1] and len(texts[12]) < len(dict(rows)[12]) / 2
    assert sentence_spans.drop_repeats(no_docs).collect() == []


def test_sentence_spans_of_clashing_columns(odd_docs):
    clash = odd_docs.select("*", *[F.lit(7).alias(c) for c in ("n_sentences", "n_removed", "own_id", "own_runs", "__id", "repeated", "run", "first")])
    plain = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in sentence_spans.drop_repeats(odd_docs).collect()}
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in sentence_spans.drop_repeats(clash).collect()} == plain
    kept = sentence_spans.drop_repeats(clash, counts=False)
    assert kept.columns == clash.columns
    assert {r.doc_id: (r.text, r.n_sentences) for r in kept.collect()} == {k: (t, 7) for k, (t, *_) in plain.items()}


def test_a_repeated_longer_run_is_gone_whole(spark):
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + ". "
    for _ in range(5):
        shared = "".join(sentence(rng.choice([1, 2, 5, 12, 45])) for _ in range(8)) + sentence(20)
        texts = [sentence(9) + shared + sentence(7), sentence(6) + sentence(30) + shared + sentence(8)]
        got = sentence_spans.drop_repeats(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
        assert {r.doc_id: r.text for r in got.collect()} == {0: texts[0], 1: texts[1].replace(shared, "")}


def test_sentences_lose_nothing_and_runs_reach_the_ends():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice(["a b c", "d", ". ", "! ", "\n", "?", " ", "e f g h i j"]) for _ in range(rng.randrange(80)))
        parts = sentence_spans.sentences(t)
        assert "".join(parts) == t
        full = [k for k, p in enumerate(parts) if p.split()]
        spans = sentence_spans.runs(parts)
        if len(full) > 1 and len(t.split()) >= 45:
            assert min(a for _, a, _ in spans) == full[0] and max(b for _, _, b in spans) == full[-1]


def near_by_force(rows, threshold=0.8):
    def shingled(t):
        w = (t or "").lower().split()
        times = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
        return Counter({k: 1 + math.log(n) for k, n in times.items()})

    def alike(a, b):
        both = a.keys() & b.keys()
        if not both:
            return 0.0
        every = a.keys() | b.keys()
        weighted = sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in both)
        return max(weighted, len(both) / len(every))

    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, t or "", shingled(t)) for k, t in rows]
    for i, (k, t, a) in enumerate(sets):
        for m, u, b in sets[:i]:
            if t == u or (len(a) and len(b) and min(len(a), len(b)) > 0 and alike(a, b) >= threshold):
                x, y = root(k), root(m)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k, _ in rows}


@pytest.mark.parametrize("small", [2, 12])
def test_near_classes(spark, small):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 16)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows) * 3, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(df, small=small).collect()}
    assert got == near_by_force(sorted(rows))


def test_near_classes_of_templated_texts(spark):
    rng = random.Random(9)
    texts = []
    for k in range(300):  # 0.79 alike by a template, and pairs of 0.801
        w = [f"t{i}" for i in range(100)] + [f"own{k}x{i}" for i in range(13)]
        if k % 3 == 2:
            w = texts[-1].split()
            w[-12] = w[-7] = w[-2] = f"new{k}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {k: min(m for m, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)) for k, a in enumerate(sets)}
    assert len(set(want.values())) == 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(df).collect()} == want


def test_near_classes_around_a_leader_that_links_with_none(spark, monkeypatch):
    """One bucket of 21: a leader that is like none, and ten separate pairs around it."""
    base = [f"h{i}" for i in range(100)]
    texts = [" ".join(base)]
    for k in range(10):
        w = list(base)
        for i in range(3):
            w[(9 * k + 31 * i) % 100] = f"x{k}y{i}"
        w[(9 * k + 15) % 100] = f"z{k}"
        texts.append(" ".join(w))
        w[(9 * k + 16) % 100] = f"v{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = near_by_force(rows)
    assert want == {0: 0} | {k: k - (k + 1) % 2 for k in range(1, 21)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "banded", lambda docs, *_: docs.select("doc_id", F.md5("text").cast("binary").alias("digest"), F.array(F.lit(7).cast("long")).alias("bands")))
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(df).collect()} == want


def test_near_classes_of_texts_that_differ_in_repeated_lines(spark):
    rows = []
    for k in range(80):  # pairs of 126 common shingles and a line of each text's own, 200 times: plain 0.82, weighted far less
        w = [f"c{k // 2}x{i}" for i in range(130)] + [f"own{k}x{i}" for i in range(10)] * 200
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(df).collect()} == {k: k - k % 2 for k in range(80)}


def test_exact_join_finds_what_force_finds(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(90):
        w = [f"t{i}" for i in range(60)]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(12)}"
        rows.append((len(rows), " ".join(w + rng.choice([[], ["a b c d e f"] * rng.randrange(1, 9), [f"e{i}" for i in range(rng.randrange(12))]]))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    members = df.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("c"))
    every = members.alias("x").join(members.alias("y"), F.col("x.rep") < F.col("y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    alike = {tuple(r) for r in near_dup.verified(every, df).collect()}
    met = near_dup.across(members, df, 0.8)
    found = {tuple(r) for r in near_dup.verified(met, df).collect()}
    n_met = met.count()
    assert 20 < len(alike) <= n_met < every.count() and found == alike


def test_near_classes_of_odd_tables(odd_docs, no_docs):
    got = near_dup.near_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    rows = sorted({(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect() if r.doc_id < 16 or r.doc_id > 75}, key=lambda r: r[0])
    want = near_by_force(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id in want} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert near_dup.near_classes(no_docs).collect() == []
    kept = near_dup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.class_id for r in got if r.class_id is not None}) and ids.count(None) == 1


def test_near_classes_of_documents_are_those_of_force(spark, sf):
    """Every class of the given documents: none is split or joined otherwise."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = near_by_force(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()} == want


def test_registers_estimate_the_similarity():
    rng = random.Random(1)
    words = [str(i) for i in range(500)]
    estimates = []
    for _ in range(30):
        a, b = list(words), list(words)
        for i in rng.sample(range(500), 10):
            b[i] = f"n{rng.random()}"
        of, runs, n = near_dup.weighted([" ".join(a + a[:100]), " ".join(b + b[:100])])
        s = near_dup.prob_minhash(of, runs, n, 2)
        own = of == 0
        estimates.append((s[0] == s[1]).mean() - near_dup.similarity(runs[own], n[own], runs[~own], n[~own]))
    assert abs(np.mean(estimates)) < 0.03


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.id: r.class_id for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    from notemill.llm.common import kept

    seen, stages = docs, {}
    for name, stage in p.STAGES:
        seen = stages[name] = kept(stage(spark, seen, sf), "test")
        if name != "best-fit packing":
            assert seen.columns == docs.columns
    counts = [stages[n].count() for n, _ in p.STAGES[:4]]
    assert docs.count() > counts[0] > counts[1] >= counts[2] == counts[3]
    rows = [(r.doc_id, r.text) for r in stages["quality classifier"].collect()]
    unique = {r.doc_id for r in stages["MinHash near-dedup"].select("doc_id").collect()}
    assert unique == set(near_dup_classes(stages["quality classifier"]).values()) and len(rows) >= len(unique)
    left = {r.doc_id: r.text for r in stages["substring dedup"].collect()}
    assert left == spans_by_force([(r.doc_id, r.text) for r in stages["MinHash near-dedup"].collect()])
    packed = stages["best-fit packing"].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {k: len(t.lower().split()) for k, t in left.items()}
    assert p.run(spark, sf).count() == stages["best-fit packing"].count()


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_documents(spark, odd_docs, no_docs, tmp_path, kind):
    import corpus_pipeline as p

    docs = (odd_docs if kind == "odd" else no_docs).select("*", *[F.lit(7).alias(c) for c in ("n_sentences", "label", "__row", "class", "toxic", "quality")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(1, 80)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:4]:
        seen = kept(stage(spark, seen, str(tmp_path)), "odd")
        assert seen.columns == docs.columns, name
    n = p.run(spark, str(tmp_path)).count()
    assert n > 0 if kind == "odd" else n == 0


def near_dup_classes(df):
    return {r.doc_id: r.class_id for r in near_dup.near_classes(df).collect()}
