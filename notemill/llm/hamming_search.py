"""Exact top-k search over binary codes by incremental multi-index hashing (operator 2).

Different codes are dealt by their hash in blocks of BLOCK codes at most, different queries in blocks of QUERIES, and each block of queries meets each block of codes once. A block of codes is indexed m
times: a code of 64 bits is cut into m substrings of about as many bits as the number of codes in the block has (16 at most), and each substring's values lead to codes by a table. The search radius grows by one
substring at a time. After radius r was searched in the first a + 1 substrings and r - 1 in the others, all codes within m * r + a bits are found: a code that isn't found is farther than r in a + 1
substrings and farther than r - 1 in the others. Codes found are verified by their whole Hamming distance, and a query ends as soon as its k-th verified distance is covered: its result is then exact,
ties included. The k nearest of all blocks are the k nearest of each block's.

Masks of a radius are made where they are used, and there are no more of them than values of a substring, so a query without near codes costs no more than
looking at a block's codes once for each substring. Queries times blocks of codes is what this does in any case: the queries are a stated set.

Equal codes are one row of the index with its k smallest ids, chosen through a salted first step, and equal queries search once; so a code that a third of all rows have costs as much as
any other. Results go back to equal queries by salted keys.

Defined results: neighbours are ordered by distance, then id; a row is a neighbour of itself. Rows without id or vector are neither queries nor neighbours. Components that are null or
not above zero give a 0 bit; those after the 64th are ignored. Repeated rows are neighbours each. With fewer than k rows all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, reachable, table

BITS, K, QUERY_STEP, SALTS = 64, 10, 100, 32
#: Codes and queries of a block; codes below which blocks aren't made smaller to keep all cores busy; candidates verified at a time.
BLOCK, QUERIES, LEAST_BLOCK, AT_ONCE = 1 << 18, 1 << 14, 1 << 10, 1 << 21

def sign_code(vector: Column) -> Column:
    """64 bits: whether each of the first 64 components is above zero."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def substrings(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each substring for so many codes."""
    m = min(8, max(4, round(BITS / log2(max(n_codes, 4)))))
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def smallest_ids(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code, first within salts."""
    salted = Window.partitionBy("code", "salt").orderBy("id")
    few = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Index:
    """Tables from the substrings of some different codes to the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = substrings(len(codes))
        self.tables = []
        for first, bits in self.parts:
            keys = self.own(codes, first, bits)
            self.tables.append((np.argsort(keys, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << bits))])))
        self.weights = {bits: np.bitwise_count(np.arange(1 << bits)) for bits in {b for _, b in self.parts}}

    @staticmethod
    def own(codes: np.ndarray, first: int, bits: int) -> np.ndarray:
        return ((codes >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def candidates(self, queries: np.ndarray, part: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, code, distance) of codes at radius in a substring that no earlier step has found: none closer in any, none as close in one before."""
        (first, bits), (order, edge) = self.parts[part], self.tables[part]
        masks = np.flatnonzero(self.weights[bits] == radius)
        some = max(1, AT_ONCE // max(1, len(masks)))
        for low in range(0, len(queries), some):
            keys = self.own(queries[low : low + some], first, bits)[:, None] ^ masks
            begin = edge[keys]
            n = edge[keys + 1] - begin
            upto = np.cumsum(n.sum(1))
            at = 0
            while at < len(keys):  # as many queries as have few enough candidates
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
                times, start = n[at:stop].ravel(), begin[at:stop].ravel()
                code = order[np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())]
                query = np.repeat(np.arange(low + at, low + stop), n[at:stop].sum(1))
                apart = self.codes[code] ^ queries[query]
                new = np.ones(len(code), bool)
                for k, (f, b) in enumerate(self.parts):
                    if k != part:
                        new &= np.bitwise_count(self.own(apart, f, b)) >= radius + (k < part)
                yield query[new], code[new], np.bitwise_count(apart[new]).astype(np.int64)
                at = stop


def nearest(codes: np.ndarray, ids: list[list[int]], queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(index of query, id, distance) of the k nearest ids to each query, by distance, then id. ids are those of each code, ascending, k at most."""
    if not len(codes) or not len(queries):
        return
    index = Index(codes)
    held = np.array([len(x) for x in ids])
    smallest = np.array([x[0] for x in ids])
    m = len(index.parts)
    within = np.zeros((len(queries), BITS + 1), np.int64)  # ids found at each distance
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = np.arange(len(queries))
    reach = np.full(len(queries), BITS)  # nothing farther can be among the k nearest
    for radius in range(max(b for _, b in index.parts) + 1):
        for part, (_, bits) in enumerate(index.parts):
            if radius > bits or not len(waiting):
                continue
            for q, code, far in index.candidates(queries[waiting], part, radius):
                q = waiting[q]
                np.add.at(within, (q, far), held[code])
                near = far <= reach[q]
                found.append((q[near], code[near], far[near]))
            enough = np.cumsum(within[waiting], axis=1) >= k
            reach[waiting] = np.where(enough.any(1), enough.argmax(1), BITS)
            waiting = waiting[reach[waiting] > m * radius + part]
        # only what can still be among the nearest is held
        q, code, far = (np.concatenate(c) for c in zip(*found, strict=True))
        on = far <= reach[q]
        found = [(q[on], code[on], far[on])]
    q, code, far = found[0]
    order = np.lexsort((smallest[code], far, q))
    q, code, far = q[order], code[order], far[order]
    edge = np.searchsorted(q, np.arange(len(queries) + 1))
    for i, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)):
        # k codes at most have the k nearest ids
        named = sorted((d, x) for c, d in zip(code[a : min(b, a + k)].tolist(), far[a : min(b, a + k)].tolist(), strict=True) for x in ids[c])
        yield from ((i, x, d) for d, x in named[:k])


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, most: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest of codes (id, code) for each of queries (id, code)."""
    spark = codes.sparkSession
    reachable(spark)
    index = kept(smallest_ids(codes.where("id is not null and code is not null"), k), "codes")
    asked = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), "code")
    different = kept(asked.select("code").distinct(), "queries")
    n, n_queries = index.count(), different.count()
    blocks = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    sets = max(1, -(-n_queries // most))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = index.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block")).withColumn("set", each(sets))
    asking = different.select("code", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(sets)).cast("int").alias("set")).withColumn("block", each(blocks))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        own, wanted = (np.asarray(t.column("code").combine_chunks(), np.int64).view(np.uint64) if t.num_rows else np.zeros(0, np.uint64) for t in (mine, theirs))
        rows = list(nearest(own, mine.column("ids").to_pylist() if mine.num_rows else [], wanted, k))
        q, ids, far = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(wanted[list(q)].view(np.int64) if q else [], pa.int64()), pa.array(ids, pa.int64()), pa.array(far, pa.int32())], ["code", "id", "distance"])

    by = lambda df: df.groupBy("block", "set")
    found = by(dealt).cogroup(by(asking)).applyInArrow(search, "code long, id long, distance int")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))).where(F.col("rank") <= k)
    # equal queries may be many: their results are sent to each salt
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    return salted.join(ranked.withColumn("salt", each(SALTS)), ["code", "salt"]).select("query_id", "rank", "id", "distance")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the nearest of all embeddings' sign codes for each whose id is divisible by QUERY_STEP."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding")).alias("code"))
    found = top_k(codes, codes.where(F.col("id") % QUERY_STEP == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP2_SQL = f"""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
        CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((coalesce(q.embedding[i], 0) > 0) <> (coalesce(e.embedding[i], 0) > 0) AS INTEGER))) AS INTEGER) AS distance
      FROM q CROSS JOIN embeddings e),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""
