"""Cutting of texts: greedy chunks under a token limit (CHK-1), even slices (CHK-2)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import CHARS_PER_TOKEN, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

PARAGRAPH = r"\n\n+"
SENTENCE = r"(?<=[.!?])\s+"


def _tokens(x: Column) -> Column:
    return F.ceil(F.length(x) / CHARS_PER_TOKEN)


def pieces(text: Column, most: Column | int, paragraph: str = PARAGRAPH, sentence: str = SENTENCE, gap: str = "\n\n") -> Column:
    """What chunks are made of: array of (text, tokens, need, gap). Paragraphs, and the sentences of those that are too long; a piece goes into a chunk that has room for its need.

    The first sentence of a long paragraph needs room for all of it, so it always begins a chunk.
    """
    most = F.lit(most) if isinstance(most, int) else most
    piece = lambda x, need, end: F.struct(x.alias("text"), _tokens(x).alias("tokens"), need.alias("need"), F.lit(end).alias("gap"))
    apart = lambda p: F.transform(F.split(p, sentence), lambda s, i: piece(s, F.when(i == 0, _tokens(p)).otherwise(_tokens(s)), " "))
    return F.flatten(F.transform(F.split(text, paragraph), lambda p: F.when(_tokens(p) > most, apart(p)).otherwise(F.array(piece(p, _tokens(p), gap)))))


def chunks(text: Column, most: Column | int, paragraph: str = PARAGRAPH, sentence: str = SENTENCE, gap: str = "\n\n") -> Column:
    """CHK-1: an array of chunks of at most so many tokens (a token is four characters; gaps don't count).

    Paragraphs are added while they fit; one that is too long by itself begins a chunk and is added sentence by sentence, and a sentence that is too long is a chunk. A text that fits is
    one chunk as it is; other chunks are trimmed. One fold over sizes finds where chunks begin, and texts are put together once: no shuffle, no Python, time in proportion to the text.
    """
    most = F.lit(most) if isinstance(most, int) else most
    start = F.struct(F.lit(0).cast("long").alias("tokens"), F.array(F.lit(0)).alias("begins"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["tokens"] + p["need"] > most) & (p["i"] > F.element_at(acc["begins"], -1))
        return F.struct((F.when(full, F.lit(0).cast("long")).otherwise(acc["tokens"]) + p["tokens"]).alias("tokens"), F.when(full, F.concat(acc["begins"], F.array(p["i"]))).otherwise(acc["begins"]).alias("begins"))

    # each of these binds what it is made of to a name, so that nothing is worked out again for each chunk
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def cut(all_pieces: Column) -> Column:
        numbered = F.transform(all_pieces, lambda p, i: F.struct(i.alias("i"), p["tokens"].alias("tokens"), p["need"].alias("need")))
        whole = F.transform(all_pieces, lambda p: F.concat(p["text"], p["gap"]))
        begins = F.aggregate(numbered, start, add)["begins"]
        return bound(F.struct(begins.alias("begins"), whole.alias("whole")), joined)

    def joined(x: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(x["begins"], k + 1), F.size(x["whole"]))
        return F.transform(x["begins"], lambda b, k: trimmed(F.array_join(F.slice(x["whole"], b + 1, stop(k) - b), "")))

    last = lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    made = bound(bound(pieces(text, most, paragraph, sentence, gap), cut), last)
    return F.when(_tokens(text) <= most, F.array(text)).otherwise(made)


class Run:
    """The greedy fold from one state. State 0 is no open chunk, s + 1 an open one of s tokens (or of more than fit)."""

    def __init__(self, most: int, state: int = 0):
        self.most, self.state, self.count = most, state, 0

    def add(self, tokens: int, need: int) -> None:
        state, most = self.state, self.most
        if state == 0 or state - 1 + need > most:
            self.count += 1
            state = 1
        self.state = min(state - 1 + tokens, most + 1) + 1


class Fill:
    """The greedy fold from every state at once.

    exits and begun tell for each entry state the state after the pieces so far and how many chunks they begin. Runs from different states soon fall together; equal ones are folded once, and the last one as a Run.
    """

    def __init__(self, most: int):
        self.most = most
        self.which = np.arange(most + 3)  # the run of each entry state
        self.state = np.arange(most + 3)  # of each run
        self.count = np.zeros(most + 3, np.int64)
        self.before = np.zeros(most + 3, np.int64)  # chunks that an entry state had begun more than its run
        self.added = 0
        self.one: Run | None = None

    def add(self, tokens: int, need: int) -> None:
        if self.one is not None:
            self.one.add(tokens, need)
            return
        fresh = (self.state == 0) | (self.state - 1 + need > self.most)
        self.state = np.minimum(np.where(fresh, 0, self.state - 1) + tokens, self.most + 1) + 1
        self.count += fresh
        self.added += 1
        if self.added % 8 == 0:
            state, first, run = np.unique(self.state, return_index=True, return_inverse=True)
            if len(state) < len(self.state):
                self.before += (self.count - self.count[first][run])[self.which]
                self.which, self.count, self.state = run[self.which], self.count[first], state
            if len(state) == 1:
                self.one = Run(self.most, int(state[0]))

    def exits(self) -> list[int]:
        return (self.state[self.which] if self.one is None else np.full(self.most + 3, self.one.state)).tolist()

    def begun(self) -> list[int]:
        return (self.count[self.which] + self.before + (0 if self.one is None else self.one.count)).tolist()


def chunked_parts(parts: DataFrame, key: str, order: str, text: str, most: int, keep: Callable[[DataFrame], DataFrame], paragraph: str = PARAGRAPH, sentence: str = SENTENCE, gap: str = "\n\n") -> DataFrame:
    """CHK-1 for texts whose parts are rows: (key, chunk, text), the chunks of each key's parts in order with a gap between them. Line ends next to such a gap belong to it, and a part of nothing else is left out.

    No text is put together, and a key's parts may be in many tasks: ranges of parts, as the sizes of their pieces alone, are folded side by side from every state that a chunk can be in; the driver joins these tables, one for
    each range, so that each range knows its state and its first chunk's number. Then each part knows where chunks begin in it, and what it has of a chunk is brought together by chunk: that is all that moves texts, but
    for the parts meeting their places where these are too many to be broadcast. keep writes a table and reads it back.
    """
    spark = parts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("text"))
    rows = rows.withColumn("p", pieces(F.col("text"), most, paragraph, sentence, gap))
    each = lambda c: F.transform("p", lambda p: p[c].cast("int")).alias(c)
    rows = keep(rows.select("key", "ord", F.monotonically_increasing_id().alias("id"), "text", F.length("text").alias("n"), each("tokens"), each("need")))
    gaps = F.greatest(F.count_if(F.col("n") > 0) - 1, F.lit(0))
    sizes = keep(rows.groupBy("key").agg((F.ceil((F.sum("n") + F.lit(len(gap)) * gaps) / CHARS_PER_TOKEN) <= most).alias("fits")))
    n_short, n_long = sizes.agg(F.count_if("fits"), F.count_if(~F.col("fits"))).first()

    def of(fits: bool) -> DataFrame:
        """The rows of keys that fit, or don't."""
        if not (n_long if fits else n_short):
            return rows
        right = sizes.where(F.col("fits") == fits).select(F.col("key").alias("__k"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("__s"))
        return rows.join(right, F.col("key").eqNullSafe(F.col("__k")) & (F.pmod("id", F.lit(16)) == F.col("__s"))).drop("__k", "__s")

    short = of(True).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.nullif(x["text"], F.lit(""))), gap).alias("text")).select("key", F.lit(0).cast("long").alias("chunk"), "text")
    if not n_long:
        return short.withColumnRenamed("key", key)

    ordered = of(False).where("n > 0").select("key", "ord", "id", "tokens", "need").repartitionByRange(ranges, "key", "ord", "id").sortWithinPartitions("key", "ord", "id")
    ordered = keep(ordered.select(F.xxhash64("key").alias("key"), "id", "tokens", "need", F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33).cast("int")))
    narrow = ordered.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "row")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each range: its first and last key, the first one's fold from every state, and the last one's fold from none."""
        part, first, last, head, tail = None, None, None, Fill(most), Run(most)
        done = []
        close = lambda: done.append((part, first, last, head.exits(), head.begun(), tail.state, tail.count))
        for batch in batches:
            for p, k, tokens, need in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "tokens", "need")), strict=True):
                if p != part:
                    if part is not None:
                        close()
                    part, first, last, head, tail = p, k, k, Fill(most), Run(most)
                if k != last:
                    last, tail = k, Run(most)
                run = head if k == first else tail
                for t, n in zip(tokens, need, strict=True):
                    run.add(t, n)
        if part is not None:
            close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TABLE, strict=True)], names=list("pflebsn"))

    entry: dict[int, tuple[int, int]] = {}
    after: dict[int, int] = {}  # the first key of the range after each
    state, begun, open_key, open_part = 0, 0, None, None
    for r in sorted(narrow.mapInArrow(tables, "p int, f long, l long, e array<int>, b array<long>, s int, n long").collect()):
        entry[r.p] = (state, begun) if r.f == open_key else (0, 0)
        s, b = entry[r.p]
        state, begun = (r.e[s], b + r.b[s]) if r.f == r.l else (r.s, r.n)
        if open_part is not None:
            after[open_part] = r.f
        open_key, open_part = r.l, r.p

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part, the number of the chunk that its first piece goes into, the pieces at which what it has of a chunk starts, and whether it is its key's last part."""
        part, key, fill, begun = None, None, Run(most), 0
        held = None  # what comes after it isn't known yet
        for batch in batches:
            out = []
            for i, row, p, k, tokens, need in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "part", "key", "tokens", "need")), strict=True):
                if held is not None:
                    out.append((*held, key != (k if p == part else after.get(part))))
                if p != part:
                    part, key, (state, begun) = p, k, entry[p]
                    fill = Run(most, state)
                elif k != key:
                    key, fill, begun = k, Run(most), 0
                starts, chunk = [0], 0
                for j, (t, n) in enumerate(zip(tokens, need, strict=True)):
                    count = fill.count
                    fill.add(t, n)
                    if j == 0:
                        chunk = begun + fill.count - 1
                    elif fill.count > count:
                        starts.append(j)
                held = (i, row, chunk, starts)
            yield places(out)
        if held is not None:
            yield places([(*held, key != after.get(part))])

    def places(found: list[tuple[int, int, int, list[int], bool]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()), strict=True)], names=["id", "row", "chunk", "starts", "last"])

    at = keep(narrow.mapInArrow(number, "id long, row long, chunk long, starts array<int>, last boolean"))

    def cut(whole: Column) -> Column:
        stop = lambda k: F.coalesce(F.get("starts", k + 1), F.size(whole))
        return F.transform("starts", lambda b, k: F.struct(F.array_join(F.slice(whole, b + 1, stop(k) - b), "").alias("text"), (F.col("last") & (k == F.size("starts") - 1)).alias("last")))

    whole = F.transform(pieces(F.col("text"), most, paragraph, sentence, gap), lambda p: F.concat(p["text"], p["gap"]))
    bits = rows.select("key", "id", "text").join(at, "id").select("key", "row", "chunk", F.posexplode(F.get(F.transform(F.array(whole), cut), 0)).alias("k", "bit"))
    made = bits.groupBy("key", (F.col("chunk") + F.col("k")).alias("chunk")).agg(trimmed(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "bit.text"))), lambda x: x["text"]), "")).alias("text"), F.bool_or("bit.last").alias("last"))
    made = made.where(~F.col("last") | (F.col("text") != "")).drop("last")
    return (short.unionByName(made) if n_short else made).withColumnRenamed("key", key)


_TABLE = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64())


def with_transcript(slides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """JOIN-10: slides (deck_id, slide_num, ...) with the even slice of their deck's transcript (deck_id, transcript) that has their place; null where there is none."""
    n = slides.groupBy("deck_id").agg(F.max("slide_num").alias("n"))
    cut = transcripts.join(n, "deck_id").select("deck_id", F.posexplode(even_slices(F.col("transcript"), F.col("n"))).alias("__at", "slice"))
    return slides.join(cut.select("deck_id", (F.col("__at") + 1).alias("slide_num"), "slice"), ["deck_id", "slide_num"], "left")


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, most: int, **how: str) -> DataFrame:
    """(id, chunk, text): one row for each chunk."""
    return docs.select(id_col, F.posexplode(chunks(F.col(text_col), most, **how)).alias("chunk", "text"))


def even_slices(text: Column, n: Column) -> Column:
    """CHK-2: n slices of equal length, trimmed; null where nothing is left. No slice for n = 0; all null for a null or empty text."""
    size = F.ceil(F.length(F.coalesce(text, F.lit(""))) / n).cast("int")
    cut = lambda i: F.nullif(trimmed(F.substring(text, i * size + 1, size)), F.lit(""))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cut))
