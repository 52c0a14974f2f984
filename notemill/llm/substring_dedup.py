"""Suffix-array deduplication of byte strings (operator 1).

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Strings are judged on the input, not on what is left.

1. Every string of LENGTH bytes is owned by one anchor in it: the GRAM bytes with the smallest hash. Equal strings have equal anchors. Strings that
   follow each other under one anchor are a segment, some twenty bytes of text for one row, and the anchor's hash is its key.
2. Segments are dealt by key as packed arrays, after equal segments of the same unit of texts were reduced to their smallest document. Where the same segment stands in several
   documents, all its strings go from all but the smallest. Only where a key has different segments that agree on one side of the anchor are texts needed.
3. Those segments' bytes, and no others, are dealt by key. In each share, strings whose fingerprint no other document has are left out, and of equal pieces of what is left one stays. A suffix array of
   these, built by grouping (suffix_groups), brings equal strings together, and each goes from all documents but the smallest.
4. A document's removed runs are joined to it, and only documents that lose bytes are moved for it.

Skew. A key that has more than SPLIT different segments in one unit of texts is hot: its segments are dealt by what is in them instead, a mark goes to where the key belongs, and there the key's segments of
units that didn't notice become hot as well. So a key brings at most SPLIT segments of a unit to one share, however many documents it stands in. Hot segments, and those of keys with more than HOT
different ones, go string by string through a pre-aggregated minimum.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing. Rows of equal doc_id take nothing from each other, and each row loses what stands in
documents of smaller ids, whether the texts of its id are equal or not. Rows without doc_id neither lend nor lose bytes. Columns other than the id and the text are
ignored. Texts are read whole; those above PIECE bytes are searched in overlapping pieces.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, rows_with_ids, table, texts
from .near_dup import _BASE, _INVERSE, _powers, mixed
from .suffix_groups import suffix_array

LENGTH, GRAM = 50, 16
#: Bytes of text handled at a time, and of the pieces that longer texts are searched in.
CHUNK, PIECE = 1 << 19, 1 << 21
#: Bytes of text that are reduced before they are dealt, and segments of a key in them beyond which it is dealt by content.
UNIT, SPLIT = 16 << 20, 256
#: Bytes of text for each share of keys, segments for each suffix array, and segments of a key beyond which it goes string by string.
SHARE_BYTES, ARRAY_SEGMENTS, HOT = 8 << 20, 8192, 2500

_HALF = (LENGTH - GRAM) // 2  # a string has so many bytes on one side of its anchor at least
_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A segment and a run; with the text's hash where ids repeat, as a place then needs more than the id.
_ROW, _GONE = [("key", "<u8"), ("sig", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1"), ("off", "u1")], [("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")]
_TEXT = ("text", "<i8")
_KINDS = {again: (np.dtype([*_ROW, *[_TEXT] * again]), np.dtype([*_GONE, *[_TEXT] * again])) for again in (False, True)}
_AT = np.uint64((1 << 22) - 1)


def pieces_of(doc: int, data: bytes, text: int = 0) -> Iterator[tuple[int, int, bytes, int]]:
    """(doc, offset, bytes, hash of the text): each string of LENGTH bytes starts in one piece."""
    if len(data) <= PIECE:
        yield doc, 0, data, text
    else:
        for at in range(0, len(data) - LENGTH + 1, PIECE - LENGTH + 1):
            yield doc, at, data[at : at + PIECE], text


def segments(pieces: list[tuple[int, int, bytes, int]], again: bool = False) -> np.ndarray:
    """The segments of some pieces of text as rows: key, sig (40 bits of the segment, 12 each of the anchor's left and right side), place."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, _KINDS[again][0])
    forth, back = _powers(_BASE, n), _powers(_INVERSE, n)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * forth, dtype=np.uint64)])
    grams = mixed((upto[GRAM:] - upto[:-GRAM]) * back[: n - GRAM + 1])
    least = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (least & _AT).astype(np.int64)  # of the string that starts here
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= ends[of]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    last = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    at, of = anchor[first], of[first]
    span = lambda a, b: (upto[b] - upto[a]) * back[a]
    body = mixed(span(first, last + LENGTH) + ((at - first) * 64 + (last - first)).astype(np.uint64))
    left, right = mixed(span(np.maximum(at - _HALF, 0), at + GRAM)), mixed(span(at, np.minimum(at + GRAM + _HALF, n)))
    rows = np.zeros(len(first), _KINDS[again][0])
    rows["key"] = grams[at]
    rows["sig"] = (body & ~np.uint64((1 << 24) - 1)) | ((left >> np.uint64(40)) & np.uint64(0xFFF000)) | (right >> np.uint64(52))
    rows["doc"] = np.array([p[0] for p in pieces], np.int64)[of]
    rows["start"] = first - (ends - sizes)[of] + np.array([p[1] for p in pieces])[of]
    rows["more"], rows["off"] = last - first, at - first
    if again:
        rows["text"] = np.array([p[3] for p in pieces], np.int64)[of]
    return rows


def settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, gone): of equal segments those of the smallest document, sorted by key and sig; the runs that the others lose."""
    rows = rows[np.lexsort((rows["doc"], rows["sig"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["sig"][1:] != rows["sig"][:-1])
    smallest = rows["doc"][new][np.cumsum(new) - 1] if len(rows) else rows["doc"]
    later = rows["doc"] > smallest
    again = "text" in rows.dtype.names
    gone = np.zeros(int(later.sum()), _KINDS[again][1])
    for name in ("doc", "start", *["text"] * again):
        gone[name] = rows[name][later]
    gone["stop"] = gone["start"] + rows["more"][later] + LENGTH
    return rows[~later], gone


def crowded(rows: np.ndarray, most: int) -> np.ndarray:
    """For each of rows, as from settled(), whether its key has more than most."""
    at = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1])) if len(rows) else np.zeros(0, int)
    n = np.diff(np.append(at, len(rows)))
    return np.repeat(n > most, n)


def undecided(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the parts of segments whose strings may stand in another segment of their key; rows as from settled()."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    new_key = np.ones(len(rows), bool)
    new_key[1:] = rows["key"][1:] != rows["key"][:-1]
    new = new_key.copy()
    new[1:] |= rows["sig"][1:] != rows["sig"][:-1]
    group = np.cumsum(new_key).astype(np.uint64)

    def shared(side: np.ndarray) -> np.ndarray:
        tags = (group << np.uint64(12)) | side
        own, n = np.unique(tags[new], return_counts=True)
        return n[np.searchsorted(own, tags)] > 1

    left, right = shared((rows["sig"] >> np.uint64(12)) & np.uint64(0xFFF)), shared(rows["sig"] & np.uint64(0xFFF))
    start = rows["start"].astype(np.int64)
    at, last = start + rows["off"], start + rows["more"]
    start = np.where(left, start, np.maximum(start, at - _HALF + 1))
    last = np.where(right, last, np.minimum(last, at - _HALF))
    on = (left | right) & (start <= last)
    return np.flatnonzero(on), start[on], last[on] + LENGTH


def in_array(pieces: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last): the runs of the pieces' strings that also stand in a piece of a smaller least, by a suffix array of all."""
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    text = b"\xff".join(pieces) + b"\xff"  # a byte that UTF-8 never has
    of = np.repeat(np.arange(len(pieces)), sizes)
    whole = np.arange(len(text)) + LENGTH < ends[of]
    order = np.array(suffix_array(text), np.int64)
    order = order[whole[order]]
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 16):
        a, b = order[k - 1 : k - 1 + (1 << 16)], order[k : k + (1 << 16)]
        new[k : k + len(b)] = (strings[a[: len(b)]] != strings[b]).any(1)
    doc = least[of[order]]
    smallest = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.sort(order[doc > smallest])
    begins = np.ones(len(hit), bool)
    begins[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
    a, b = hit[begins], hit[np.append(begins[1:], True)[: len(hit)]]
    return of[a], a - (ends - sizes)[of[a]], b - (ends - sizes)[of[a]]


def shared_strings(docs: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last): the runs of strings whose fingerprint a part of another document has too. All others stand in one document only."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, n), dtype=np.uint64)])
    of = np.repeat(np.arange(len(parts)), sizes)
    at = np.flatnonzero(np.arange(n) + LENGTH <= ends[of])
    prints = mixed((upto[at + LENGTH] - upto[at]) * _powers(_INVERSE, n)[at])
    order = np.argsort(prints)
    doc = docs[of[at[order]]]
    first = np.flatnonzero(np.append(True, prints[order[1:]] != prints[order[:-1]]))
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    hit = np.sort(at[order[np.repeat(several, np.diff(np.append(first, len(order))))]])
    begins = np.ones(len(hit), bool)
    begins[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
    a, b = hit[begins], hit[np.append(begins[1:], True)[: len(hit)]]
    return of[a], a - (ends - sizes)[of[a]], b - (ends - sizes)[of[a]]


def repeats_within(docs: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, stop): the runs of the parts, places in them, whose strings stand in a part of a smaller document as well."""
    none = (np.zeros(0, np.int64),) * 3
    if len(parts) < 2:
        return none
    part, first, last = shared_strings(docs, parts)
    if not len(part):
        return none
    known: dict[bytes, int] = {}
    piece = np.array([known.setdefault(parts[p][a : b + LENGTH], len(known)) for p, a, b in zip(part.tolist(), first.tolist(), last.tolist(), strict=True)])
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, docs[part])
    later = docs[part] > least[piece]  # a whole piece that a smaller document has
    of, a, b = in_array(list(known), least)
    # the runs of a piece, for each place where its smallest document has it
    edge = np.searchsorted(of, np.arange(len(known) + 1))
    own = np.flatnonzero(~later)
    n = np.diff(edge)[piece[own]]
    which = np.repeat(edge[piece[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(own, n)
    return np.concatenate([part[later], part[at]]), np.concatenate([first[later], first[at] + a[which]]), np.concatenate([last[later], first[at] + b[which]]) + LENGTH


def _places(doc: np.ndarray, text: np.ndarray | None, start: np.ndarray, stop: np.ndarray, key: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key.view(np.int64), pa.int64())
    hots = pa.array(np.zeros(n, bool) if hot is None else hot)
    tag = pa.array(np.zeros(n, np.int64) if text is None else text, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), tag, pa.array(start, pa.int64()), pa.array(stop, pa.int64()), keys, hots], ["doc_id", "text_id", "start", "stop", "key", "hot"])


_PLACES = "doc_id long, text_id long, start long, stop long, key long, hot boolean"
_PLACE = ["doc_id", "text_id"]


def sized(docs: DataFrame) -> tuple[int, bool]:
    """(bytes of all texts, whether an id is on several rows), in one pass; only ids and sizes move."""
    each = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count(F.lit(1)).alias("n"))
    total, most = each.agg(F.sum("size"), F.max("n")).first()
    return total or 0, (most or 0) > 1


def identified(docs: DataFrame, again: bool) -> DataFrame:
    """(doc_id, text_id, text): text_id tells the texts of one id apart where ids repeat."""
    return docs.select("doc_id", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("text_id"), "text")


def _by_share(share: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """values as bytes for each share that has any."""
    order = np.argsort(share, kind="stable")
    values, own = values[order], share[order]
    if not len(own):
        return {}
    at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return {k: values[a:b].tobytes() for k, a, b in zip(own[at].tolist(), at.tolist(), [*at[1:].tolist(), len(own)], strict=True)}


def removed_runs(docs: DataFrame, share_bytes: int = SHARE_BYTES, hot: int = HOT, split: int = SPLIT, unit: int = UNIT) -> DataFrame:
    """(doc_id, text_id, start, stop) of byte runs that go, in pieces that may overlap. docs has doc_id (not null) and text (not null)."""
    total, again = sized(docs)
    shares = max(12, total // share_bytes)
    row_kind, gone_kind = _KINDS[again]

    def dealt_unit(found: list[np.ndarray]) -> pa.RecordBatch:
        rows, gone = settled(np.concatenate(found))
        many = crowded(rows, split)
        marks = np.unique(rows["key"][many])
        usual = _by_share((rows["key"][~many] % np.uint64(shares)).astype(np.int64), rows[~many])
        spread = _by_share((mixed(rows["key"][many] ^ rows["sig"][many]) % np.uint64(shares)).astype(np.int64), rows[many])
        marked = _by_share((marks % np.uint64(shares)).astype(np.int64), marks)
        used = sorted({*usual, *spread, *marked})
        cut = np.linspace(0, len(gone), len(used) + 1).astype(int).tolist()
        columns = [[d.get(k, b"") for k in used] for d in (usual, spread, marked)] + [[gone[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["share", "rows", "spread", "marks", "gone"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part, size, waiting = [], [], 0, 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for piece in pieces_of(doc, text.as_py().encode("utf-8", "surrogatepass"), tag):
                    part.append(piece)
                    size += len(piece[2])
                    if size >= CHUNK:
                        found.append(segments(part, again))
                        waiting += size
                        part, size = [], 0
                    if waiting >= unit:
                        yield dealt_unit(found)
                        found, waiting = [], 0
        found.append(segments(part, again))
        yield dealt_unit(found)

    def decide(group: pa.Table) -> pa.Table:
        of = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        tag = lambda r: r["text"] if again else None
        (rows, gone), (spread, gone_too) = settled(of("rows", row_kind)), settled(of("spread", row_kind))
        marked = np.isin(rows["key"], of("marks", "<u8"))
        late, rows = rows[marked], rows[~marked]
        parts = [_places(g["doc"], tag(g), g["start"], g["stop"]) for g in (gone, gone_too, of("gone", gone_kind))]
        for r in (late, spread):  # every string of a hot key's segments
            start = r["start"].astype(np.int64)
            parts.append(_places(r["doc"], tag(r), start, start + r["more"] + LENGTH, r["key"], np.ones(len(r), bool)))
        at, start, stop = undecided(rows)
        _, inverse, n = np.unique(rows["key"][at], return_inverse=True, return_counts=True)
        parts.append(_places(rows["doc"][at], tag(rows[at]), start, stop, rows["key"][at], n[inverse] > hot if len(at) else np.zeros(0, bool)))
        return pa.Table.from_batches(parts)

    known = identified(docs, again)
    dealt = known.mapInArrow(deal, "share long, rows binary, spread binary, marks binary, gone binary")
    places = kept(dealt.groupBy("share").applyInArrow(decide, _PLACES), "places")
    open_places = places.where("key is not null")
    n, has_hot = open_places.agg(F.count(F.lit(1)), F.coalesce(F.max("hot"), F.lit(False))).first()
    settled_runs = places.where("key is null").select(*_PLACE, "start", "stop")
    if not n:
        return settled_runs
    arrays = max(12, n // ARRAY_SEGMENTS)
    wanted = open_places.groupBy(*_PLACE).agg(F.collect_list(F.struct("key", "start", "stop", "hot")).alias("parts"))  # a document's own segments

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "doc_id": pa.int64(), "text_id": pa.int64(), "start": pa.int64(), "hot": pa.bool_(), "data": pa.binary()}
        for batch in batches:
            out: list[tuple[int, int, int, int, bool, bytes]] = []
            for doc, tag, text, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in parts:
                    if p["hot"]:  # each string by itself, under a digest
                        out += [(p["key"], doc, tag, s, True, hashlib.blake2b(data[s : s + LENGTH], digest_size=16).digest()) for s in range(p["start"], p["stop"] - LENGTH + 1)]
                    else:
                        out.append((p["key"], doc, tag, p["start"], False, data[p["start"] : p["stop"]]))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    own = rows_with_ids(known, kept(wanted.select("doc_id").distinct(), "wanted"))
    own = own.dropDuplicates(_PLACE).join(wanted, _PLACE) if again else own.drop("text_id").join(wanted, "doc_id")
    cut = own.select(*_PLACE, "text", "parts").mapInArrow(cut_out, "key long, doc_id long, text_id long, start long, hot boolean, data binary")
    cut = kept(cut, "cut") if has_hot else cut

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text_id", "ascending"), ("start", "ascending")])
        doc, tag, start = (group.column(c).to_numpy() for c in ("doc_id", "text_id", "start"))
        part, a, b = repeats_within(doc, group.column("data").to_pylist())
        return pa.table([pa.array(c, pa.int64()) for c in (doc[part], tag[part], start[part] + a, start[part] + b)], [*_PLACE, "start", "stop"])

    by_array = cut.where("not hot").select("key", *_PLACE, "start", "data", F.pmod("key", F.lit(arrays)).alias("share"))
    out = settled_runs.unionByName(by_array.groupBy("share").applyInArrow(compare, "doc_id long, text_id long, start long, stop long"))
    if has_hot:
        each = cut.where("hot").select("data", *_PLACE, "start")
        least = each.groupBy("data").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("data", "first")
        out = out.unionByName(each.join(least, "data").where("doc_id > first").select(*_PLACE, "start", (F.col("start") + LENGTH).alias("stop")))
    return out


def finished(data: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(removed bytes, maximal removed runs, SHA-256 of the rest) of one text."""
    removed, n, at, reach, left = 0, 0, 0, -1, []
    for a, b in sorted(runs):
        b = min(b, len(data))
        if a >= b:
            continue
        if a > reach:  # runs that touch are one
            n += 1
        if a > at:
            left.append(data[at:a])
        if b > at:
            removed += b - max(a, at)
            at = b
        reach = max(reach, b)
    left.append(data[at:])
    return removed, n, hashlib.sha256(b"".join(left)).hexdigest()


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = texts(docs)
    rows = rows.withColumn("doc_id", rows.doc_id.cast("long"))
    runs = removed_runs(rows.where("doc_id is not null"))
    runs = kept(runs.groupBy(*_PLACE).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs")), "runs")  # a document's own runs
    ids = runs.select("doc_id").distinct()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digests = [], [], [], []
            for text, parts in zip(batch.column(1), batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows, strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                r, s, digest = finished(data, [(p["start"], p["stop"]) for p in parts or ()])
                n.append(len(data))
                removed.append(r)
                spans.append(s)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n, removed, spans)], pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    again = runs.where("text_id <> 0").limit(1).count() > 0
    if again:  # an id's texts may lose different runs, or none
        known = identified(rows_with_ids(rows, ids), True)
        losing = known.join(runs, _PLACE, "left").select("doc_id", "text", "runs").mapInArrow(finish, ddl)
    else:
        losing = rows_with_ids(rows, ids).join(runs.drop("text_id"), "doc_id").select("doc_id", "text", "runs").mapInArrow(finish, ddl)
    return losing.unionByName(rows_with_ids(rows, ids, "left_anti").select("doc_id", "text").mapInArrow(finish, ddl))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of documents."""
    return dedup_bytes(table(spark, sf_dir, "documents"))
