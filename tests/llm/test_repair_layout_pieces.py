"""Operators 11 to 13 against brute force, SQL and the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.llm import clustered_layout as layout
from notemill.llm.conversation_repair import damaged, digests, op11_conversation_repair, parsed, repaired
from notemill.llm.queries import ORACLE_SQL, QUERIES
from notemill.llm.sentence_pieces import PieceEncoder, encode_pieces, op13_sentence_pieces
from tests.oracle import assert_same


# --- 11: every sequence of edits is tried


def cheapest(rows):
    """(cost, audit) of the cheapest sequence of edits of [(initial, fault)], by trying all with up to three inserts at a place."""
    best = None
    choices = [[("D", "", 4)] + ([] if f in "bd" else [("K", i, 3 * (f == "t")), ("R", "u", 3 + 3 * (f == "t")), ("R", "a", 3 + 3 * (f == "t"))]) for i, f in rows]
    gaps = ["".join(g) for n in range(3) for g in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            roles = inserted[0] + "".join(e[1] + g for e, g in zip(edits, inserted[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(inserted[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, inserted[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_parse_is_the_cheapest_repair(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suaua-"), rng.choice("---tbd")) for _ in range(rng.randrange(4))]
    assert parsed("".join(map("".join, rows))) == cheapest(rows)


def by_states(rows):
    """The same by the shortest path over four states, audits held as strings; for longer conversations."""
    edges = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}

    def inserts(at):
        for _ in range(4):
            for (letter, q), to in edges.items():
                if letter != "s" and q in at:
                    new = (at[q][0] + 3, at[q][1] + "I")
                    at[to] = min(at.get(to, new), new)
        return at

    at = inserts({0: (0, "")})
    for i, f in rows:
        new = {}
        for q, (cost, audit) in at.items():
            ways = [(q, cost + 4, "D")]
            for (letter, p), to in edges.items():
                if p == q and f not in "bd":
                    more = 3 * (f == "t")
                    ways += [(to, cost + more, "K")] if letter == i else []
                    ways += [(to, cost + more + 3, "R")] if letter != "s" else []
            for to, c, e in ways:
                new[to] = min(new.get(to, (c, audit + e)), (c, audit + e))
        at = inserts(new)
    return min(at[q] for q in (0, 3) if q in at)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from("--tbd")), max_size=40))
def test_parse_of_longer_conversations(rows):
    assert parsed("".join(map("".join, rows))) == by_states(rows)


def test_parse_is_linear_in_the_rows():
    rows = [("sua-"[k * k % 4], "--td"[k % 3]) for k in range(20_000)]
    cost, audit = parsed("".join(map("".join, rows)))
    assert len(audit) - audit.count("I") == 20_000 and cost > 0


def repair_by_force(rows):
    """The contract step by step, from (conv_id, turn, role, text)."""
    space = lambda v: " " if v is None else str(v)
    after, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else space(role), {1: "", 2: re.sub("[.!?]", "", space(text))}.get(kind, space(text))
        after += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv in ids:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0d]", text)
            faults.append("b" if not last else "d" if (role, text) in seen else "-" if last[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit = by_states(list(zip(initials, faults, strict=True)))
        left = [e for e in audit if e != "D"]
        roles = ["system"] * (len(left) % 2) + ["user", "assistant"] * (len(left) // 2)
        rest, made = iter(own), []
        for e in audit:
            row = next(rest) if e != "I" else None
            if e != "D":
                role = roles[len(made)]
                made.append(f"{row[2] if e == 'K' else role}:{row[3] if row else ''}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = Counter(faults)
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, cost long, audit string, row long, place int"


def test_repair_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op11_conversation_repair(spark, sf)) == repair_by_force(rows)


def test_repair_same_as_sql(spark, sf):
    assert_same(QUERIES["op11_conversation_repair"], ORACLE_SQL["op11_conversation_repair"], spark, sf)


def test_repair_of_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Well.", "Well", "no end", "Is it?  \n", "", " ", "\t\n", None, "long " * 5000 + ".", "é…", "."]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts), 1, "x", 2, 3) for _ in range(160)]
    rows = list({r[:2]: r for r in rows}.values())  # the contract leaves the order of different rows of one turn open
    rows += [(9, t, ("user", "assistant")[t % 2], f"Turn {t}.", 1, "x", 2, 3) for t in range(3000)]  # a hot conversation
    rows += [(10 + k, 0, "user", "Hello.", 1, "x", 2, 3) for k in range(60)]
    rows += [r for r in rows if r[1] is not None][:20]  # repeated rows
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(op11_conversation_repair(spark, str(tmp_path))) == repair_by_force([r[:4] for r in rows])


def test_repaired_rows_are_well_formed_and_empty_tables_stay_empty(spark, tmp_path):
    rows = [(k % 7, k, ("user", "assistant", "system", "tool")[k * k % 4], f"Text {k}." if k % 3 else "cut") for k in range(90)]
    conversations, left = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    roles = {}
    for r in sorted(left.collect(), key=lambda r: (r.conv_id, r.place)):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
        assert (r.edit == "I") == (r.text == "")
    assert all(re.fullmatch("s?(ua)+", r) for r in roles.values()) and len(roles) == conversations.count() == 7
    none = spark.createDataFrame([], TURNS)
    conversations, left = repaired(damaged(none))
    assert conversations.collect() == left.collect() == digests(left).collect() == []
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversation_repair(spark, str(tmp_path)).collect() == []


# --- 12: the same rows as SQL, and the contract step by step where SQL's table is odd


def test_layout_same_as_sql(spark, sf):
    assert_same(QUERIES["op12_clustered_layout"], ORACLE_SQL["op12_clustered_layout"], spark, sf)


def layout_by_force(rows, file_rows):
    """From (doc_id, source, lang, text), rows of one id being equal."""
    b = lambda v: (v is not None, (v or "").encode())
    values = [(b(s), b(g), -1 if t is None else len(t.encode()), -1 if k is None else zlib.crc32(str(k).encode()) % 365) for k, s, g, t in rows]
    n = len(rows)
    at = [[16 * sum(o[d] < v[d] for o in values) // n for d in range(4)] for v in values]
    z = [sum(((a[d] >> bit) & 1) << (bit * 4 + 3 - k) for bit in range(4) for k, d in enumerate((2, 0, 3, 1))) for a in at]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    place = {i: p for p, i in enumerate(order)}
    files = {}
    for i, p in place.items():
        files.setdefault(p // file_rows, []).append(at[i])
    bounds = {f: [(min(a[d] for a in m), max(a[d] for a in m)) for d in range(4)] for f, m in files.items()}
    reach = (0, 0, 2, 2)
    out = []
    for i, (k, *_) in enumerate(rows):
        q = at[i]
        touched = sum(all(lo - r <= x <= hi + r for (lo, hi), x, r in zip(bo, q, reach, strict=True)) for bo in bounds.values())
        matching = sum(any(all(abs(a - x) <= r for a, x, r in zip(m, q, reach, strict=True)) for m in f) for f in files.values())
        out.append((k, z[i], place[i], place[i] // file_rows, touched, matching, ",".join(f"{lo},{hi}" for lo, hi in bounds[place[i] // file_rows])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,file_rows", [(1, 7), (2, 20), (3, 500)])
def test_layout_of_odd_rows(spark, seed, file_rows):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, "a", "é", "b", "hot", "hot", "hot", ""]), rng.choice([None, "en", "de"]), rng.choice([None, "", "x" * rng.randrange(3000), "é" * rng.randrange(9)])) for k in rng.sample(range(-500, 10_000), 300)]
    rows += [(None, "a", "en", "same")] * 5 + [(77_777, "a", "en", "same")] * 40
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, text string, file long, z long, at_lang int").repartition(3)
    got = layout.with_query_files(layout.document_layout(df, file_rows=file_rows), layout.document_dimensions(), ["doc_id"])
    assert collected(got) == layout_by_force(rows, file_rows)


def test_layout_of_few_and_no_rows(spark, no_docs):
    run = lambda df: layout.with_query_files(layout.document_layout(df), layout.document_dimensions(), ["doc_id"]).collect()
    assert run(no_docs) == []
    one = spark.createDataFrame([(None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in run(one)] == [(None, 0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")]


def test_layout_as_files(odd_docs, tmp_path):
    rows = layout.document_layout(odd_docs, carry=["doc_id", "text", "score"], file_rows=10)
    layout.write_files(rows, f"{tmp_path}/files", 10)
    back = rows.sparkSession.read.parquet(f"{tmp_path}/files").withColumn("name", F.input_file_name())
    assert {(r.n, r.files) for r in back.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()} <= {(10, 1), (odd_docs.count() % 10, 1)}
    assert sorted(r.position for r in back.collect()) == list(range(odd_docs.count()))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in odd_docs.collect())


# --- 13: the same ids and texts as the library


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces(model):
    return PieceEncoder(model)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@settings(max_examples=500, deadline=None)
@given(text=st.one_of(st.text(), st.text(alphabet="abthe ▁ir\n.,0é亜\U0001f600", max_size=80), st.lists(st.sampled_from(["the", " ", "   ", "ing", "▁▁", "<s>", "<0x41>", "\t", "qu", "</s>", "ſ", "\x00"])).map("".join)))
def test_pieces_are_those_of_the_library(pieces, library, text):
    ids = pieces.encode(text)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert pieces.decode(ids) == library.decode(ids)


@settings(max_examples=500, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258), st.sampled_from([259, 260, 28705, 1, 2]))))
def test_any_ids_decode_as_in_the_library(pieces, library, ids):
    assert pieces.decode(ids) == library.decode(ids)


def test_pairs_by_edges_are_pairs_by_merging(pieces):
    rng = random.Random(3)
    some = [p for p in pieces.ids if p in pieces.automaton]
    assert pieces.falling
    for _ in range(20_000):
        left, right = rng.choice(some), rng.choice(some)
        assert pieces.stay_apart(left, right) == (pieces.merged(left + right) == [left, right])


def test_pieces_of_table(odd_docs, no_docs, model, library):
    def row(r):
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return r.doc_id, len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest(library.decode(ids).encode()), ids, library.decode(ids)

    assert sorted(map(repr, (tuple(r) for r in encode_pieces(odd_docs, model).collect()))) == sorted(repr(row(r)) for r in odd_docs.collect())
    assert encode_pieces(no_docs, model).collect() == []


def test_pieces_of_documents(spark, sf, library):
    want = {r.doc_id: len(library.encode(r.text or "", add_bos=True, add_eos=True)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op13_sentence_pieces(spark, sf).collect()} == want


def test_long_runs_and_small_caches(model, library, monkeypatch):
    from notemill.llm import sentence_pieces

    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "CACHE_PAIRS", 5)
    encoder = PieceEncoder(model)
    for text in ("x" * 30_000, " " * 5000 + "end", "ab" * 9000, "the end of it all, again and again " * 20):
        assert encoder.encode(text) == library.encode(text, add_bos=True, add_eos=True)
        assert len(encoder.known) <= 3 and len(encoder.apart) <= 5


def test_byte_pairs_are_not_remembered_without_bound(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    from notemill.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_PAIRS", 7)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.BytePairEncoder.load(path, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abcdefghij éü") for _ in range(60))
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert len(encoder.compatible) <= 7
