"""Conflict-constrained best-fit packing (operator 4).

Documents are packed into bins of CAPACITY tokens, largest first. Bins stand in order of what is left in them; each carries a bitmap of its sources and
one of its clusters of copies. A document goes to the tightest bin that holds it and has neither its source nor its cluster: the search starts at the
successor of its size and goes on to the next bin until one is compatible; if none is, a new bin is opened. A document longer than a bin fills bins of its own, and
what is left of it is packed like any other.

Packing is done in shards of about SHARD_ROWS documents, dealt by a hash of all that is known of a document and of which of its equal rows it is, so that a hot source, cluster or id is dealt evenly and a
shard's size stays the same whatever the input's. Equal rows are counted before they are dealt. Only ids, sizes, sources and clusters move, no texts.

Defined results: a null text is empty; empty texts have no tokens and still get a bin. A null source is a source, and a null doc_id an id, like any
other. Repeated rows are packed one by one, and as members of one cluster into different bins. Ties in size go by doc_id, then source, then cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reachable, table

CAPACITY, SHARD_ROWS = 2048, 4096


def pack(sizes: list[int], sources: list[object], clusters: list[object], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(item, tokens, bin) of each piece. Items are taken in the given order, which should be by falling size."""
    placed: list[tuple[int, int, int]] = []
    bits: dict[object, int] = {}
    source_bit = [1 << bits.setdefault(s, len(bits)) for s in sources]
    often = {c: k for k, (c, n) in enumerate(Counter(clusters).items()) if n > 1}  # others can't conflict
    cluster_bit = [1 << often[c] if c in often else 0 for c in clusters]
    order: list[tuple[int, int]] = []  # (what is left, bin), sorted
    in_sources: list[int] = []
    in_clusters: list[int] = []
    for item, size in enumerate(sizes):
        while size > capacity:
            placed.append((item, capacity, len(in_sources)))
            insort(order, (0, len(in_sources)))
            in_sources.append(source_bit[item])
            in_clusters.append(cluster_bit[item])
            size -= capacity
        s, c = source_bit[item], cluster_bit[item]
        at = bisect_left(order, (size, -1))
        while at < len(order):
            left, b = order[at]
            if not (in_sources[b] & s or in_clusters[b] & c):
                break
            at += 1
        if at < len(order):
            del order[at]
            in_sources[b] |= s
            in_clusters[b] |= c
            left -= size
        else:
            b, left = len(in_sources), capacity - size
            in_sources.append(s)
            in_clusters.append(c)
        insort(order, (left, b))
        placed.append((item, size, b))
    return placed


def packed(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows (doc_id, source, cluster, n_tokens) packed: a row for each piece with doc_id, piece, n_tokens and bin_id."""
    reachable(rows.sparkSession)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.col("n_tokens").cast("long").alias("n_tokens"))
    equal = dealt.groupBy(*dealt.columns).agg(F.count(F.lit(1)).alias("n"))
    dealt = equal.select(*dealt.columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(*dealt.columns), F.lit(shards))).drop("copy")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        ids, shard = group.column("doc_id").to_pylist(), group.column("shard")[0].as_py()
        out: list[tuple[int | None, int, int, int]] = []
        last, piece = -1, 0
        for item, tokens, b in pack(group.column("n_tokens").to_pylist(), group.column("source").to_pylist(), group.column("cluster").to_pylist(), capacity):
            piece = piece + 1 if item == last else 0
            last = item
            out.append((ids[item], piece, tokens, (shard << 32) + b))
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "piece", "n_tokens", "bin_id"])

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, n_tokens long, bin_id long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): words as tokens, and a hash of the words in lower case as the cluster of copies."""
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r\f\v"))
    rows = docs.select("doc_id", "source", F.split(F.lower(text), r"\s+").alias("words"), (text == "").alias("empty"))
    return rows.select("doc_id", "source", F.xxhash64("words").alias("cluster"), F.when(F.col("empty"), 0).otherwise(F.size("words")).alias("n_tokens"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document packed."""
    return packed(measured(table(spark, sf_dir, "documents")))
