"""Substring deduplication by sliding spans of sentences (operator 7).

A text is cut into sentences: at a full stop, question or exclamation mark with white space after it, and at line ends. Runs of several consecutive sentences with LEAST_WORDS words at least count, and so does a
sentence of LONG_SENTENCE words by itself; shorter runs ("Yes. No.") stand in many texts by chance. From each sentence forwards, and up to each
sentence backwards, the shortest run that counts is hashed to 128 bits (lower case, white space as one space). These cover every longer run: where one of those is repeated, so are the
shortest ones in it, the first from its first sentence on and the last up to its last. The hashes are joined globally: a run's first place is the
smallest doc_id that has it, and within a document its first position. Every sentence that a run at any other place covers is removed; what is left keeps its
characters as they were, white space included.

One pre-aggregated minimum and maximum of ids for each hash finds what repeats across documents, so a passage in a third of all texts
costs as much as any other. Repeats within one document are found where the document is.

Defined results: a null text is the empty text and stays empty. Rows of equal doc_id are one document: only repeats within each row, or of documents
with smaller ids, are removed from them. Rows without doc_id neither lend nor lose sentences to others. Columns other than the
id and the text are ignored (drop_repeats keeps them; its counts take the place of columns that have their names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, reachable, table

#: A run must have two sentences and so many words, or be one sentence of so many.
LEAST_WORDS, LONG_SENTENCE = 20, 40
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=\s)\s*|[^\n]+\s*|\s+")


def sentences(text: str) -> list[str]:
    """The text cut into sentences, each with the white space that follows it."""
    return _SENTENCE.findall(text)


def runs(parts: list[str], least: int = LEAST_WORDS, long: int = LONG_SENTENCE) -> list[tuple[bytes, int, int]]:
    """(hash, first, last) of the runs of a text's sentences, each once."""
    words = [p.lower().split() for p in parts]
    at = [k for k, w in enumerate(words) if w]  # sentences that aren't only white space
    if not at:
        return []
    lines = [" ".join(words[k]) for k in at]
    n = len(at)
    upto = list(accumulate((len(words[k]) for k in at), initial=0))
    spans = set()
    last = 0
    for first in range(n):  # forwards: the end never moves back
        if upto[first + 1] - upto[first] >= long:
            spans.add((first, first))
            continue
        last = max(last, first + 1)
        while last < n and upto[last + 1] - upto[first] < least:
            last += 1
        if last >= n:
            break
        spans.add((first, last))
    first = n - 1
    for last in range(n - 1, 0, -1):  # backwards
        if upto[last + 1] - upto[last] >= long:
            continue
        first = min(first, last - 1)
        while first >= 0 and upto[last + 1] - upto[first] < least:
            first -= 1
        if first < 0:
            break
        spans.add((first, last))
    digest = xxhash.xxh3_128_digest
    return [(digest(" ".join(lines[a : b + 1]).encode("utf-8", "surrogatepass")), at[a], at[b]) for a, b in sorted(spans)]


def without(parts: list[str], found: list[tuple[bytes, int, int]], elsewhere: set[bytes]) -> list[bool]:
    """For each sentence, whether a run covers it that stands elsewhere before, or earlier in this text."""
    gone = [False] * len(parts)
    seen: set[bytes] = set()
    for h, a, b in found:
        if h in elsewhere or h in seen:
            gone[a : b + 1] = [True] * (b + 1 - a)
        seen.add(h)
    return gone


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS, long: int = LONG_SENTENCE) -> DataFrame:
    """(doc_id, repeated): the hashes of a document's runs that a document with a smaller id has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [list({h for h, _, _ in runs(sentences(t.as_py() or ""), least, long)}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.binary()))], ["doc_id", "runs"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, runs array<binary>")
    each = kept(rows, "runs").select("doc_id", F.explode("runs").alias("run"))
    shared = kept(each.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "first"), "shared")
    # one plan for all sizes: never broadcast; the partition of a run that many documents have is split by adaptive execution, as shared has one row for it
    later = each.join(shared.hint("merge"), "run").where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("run").alias("repeated"))  # at most a document's own runs


def drop_repeats(docs: DataFrame, least: int = LEAST_WORDS, long: int = LONG_SENTENCE, counts: bool = True) -> DataFrame:
    """docs with its columns, their texts without repeated runs, and with n_sentences and n_removed if counts."""
    reachable(docs.sparkSession)
    docs = docs.drop("n_sentences", "n_removed") if counts else docs
    own, repeated = (_unused(name, docs.columns) for name in ("own_id", "own_runs"))
    found = repeated_runs(docs, least, long).select(F.col("doc_id").alias(own), F.col("repeated").alias(repeated))
    rows = docs.join(found, docs["doc_id"].cast("long") == found[own], "left").drop(own)
    at, names = docs.columns.index("text"), [*docs.columns, *["n_sentences", "n_removed"] * counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, n, removed = [], [], []
            for text, gone_runs in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                parts = sentences(text.as_py() or "")
                gone = without(parts, runs(parts, least, long), set(gone_runs.as_py() or ()))
                left.append("".join(p for p, g in zip(parts, gone, strict=True) if not g))
                n.append(len(parts))
                removed.append(sum(gone))
            columns = [pa.array(left, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in (n, removed) if counts]], names)

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_sentences", "n_removed") if counts]])
    return rows.mapInArrow(run, schema)


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document's text without repeated runs of sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs)
