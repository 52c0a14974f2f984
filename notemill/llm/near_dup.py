"""Near-duplicate classes by ProbMinHash (operator 8).

A text's shingles are its runs of five words (lower case, cut at white space), weighted by 1 + ln(how often they occur). Each shingle
sends arrivals of a Poisson process whose rate is its weight; an arrival falls into one of REGISTERS registers, and a register keeps the
shingle that arrived first. A shingle stops when its arrivals come later than all registers' first ones. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. Registers are cut into bands, and so are those of the same shingles without weights, which agree with the
plain Jaccard similarity; texts that agree in a whole band of either kind are candidates, and candidates are verified on their shingles: linked if the probability Jaccard similarity, or the plain one of the sets, is
THRESHOLD or more. Classes are the connected components of links.

Skew. Equal texts are one representative, found by a pre-aggregated minimum. Within a band's bucket of up to SMALL representatives all pairs are
candidates. In a larger one each member is paired with one leader, the member that meets most others, which in a group of copies is what they were copied from. So a bucket of copies
costs its size, not its square. There are no further leaders: all that then stands in different components of one large bucket is joined exactly, on the shingles that two
like texts can share first (`across`), so no link between texts that meet in a band is lost, whether their leader is like anything or not.

Defined results: a null text is the empty text. Texts without words are linked only to equal texts; texts of one to four words have one
shingle, all their words. Rows of equal doc_id are one document. Rows without doc_id have no class (null). The class id is the
smallest doc_id of the class. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, components, kept, rows_with_ids, table, texts, to_salts

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4: two texts of similarity 0.8 share none with a probability of 5e-8.
REGISTERS, BANDS = 128, 32
#: Representatives in a bucket of which all pairs are candidates.
SMALL = 12
#: What rounding may take from a bound.
SLACK = 1e-6
#: Characters of text that are handled at a time in a worker.
CHUNK = 1 << 20

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK * 2), base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order; a word's hash is a polynomial of its bytes."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    hashes = mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(bounds, starts, "right") - 1


def shingles(batch: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, index of its text), in order."""
    words, of = word_hashes(batch)
    counts = np.bincount(of, minlength=len(batch))
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    places = [np.uint64(pow(0xD6E8FEB86659FD93, d + 1, 1 << 64)) for d in range(k)]
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, np.uint64)
    for d in range(k):
        runs += words[d : d + n] * places[d]
    whole = of[:n] == of[k - 1 :][:n] if n else np.zeros(0, bool)
    runs, runs_of = mixed(runs[whole]), of[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([sum(int(words[firsts[s] + d]) * int(places[d]) for d in range(counts[s])) & _M64 for s in short], np.uint64)
        runs, runs_of = np.concatenate([runs, mixed(extra)]), np.concatenate([runs_of, short])
    return runs, runs_of


def weighted(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, shingle, weight), sorted by text and shingle; the weight is 1 + ln(how often), so that one run repeated hundreds of times isn't most of a text."""
    runs, of = shingles(batch)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], runs[at], 1 + np.log(np.diff(np.append(at, len(runs))))


def prob_minhash(of: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m: for each text and register, the shingle that arrives first (0 for a text without shingles)."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    of, key, rate, now, arrival = of.astype(np.int64), keys, weights.astype(np.float64), np.zeros(len(keys)), 0
    while len(of):
        arrival += 1
        z = mixed(key + np.uint64(arrival * _BASE & _M64))
        now = now - np.log1p(-(z >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        at = of * m + (mixed(z) % np.uint64(m)).astype(np.int64)
        sooner = now < first[at]
        np.minimum.at(first, at[sooner], now[sooner])
        won = now == first[at]
        winner[at[won]] = key[won]
        last = first.reshape(n, m).max(1) if len(of) * 4 > n * m else None
        on = now < (last[of] if last is not None else _last(first, of, m))
        of, key, rate, now = of[on], key[on], rate[on], now[on]
    return winner.reshape(n, m)


def _last(first: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
    own, inverse = np.unique(of, return_inverse=True)
    return first.reshape(-1, m)[own].max(1)[inverse]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands: one hash for the registers of each band."""
    n, m = signature.shape
    rows = signature.reshape(n, bands, m // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE), (n, bands)).copy()
    for r in range(m // bands):
        out = mixed(out + rows[:, :, r])
    return out.view(np.int64)


def chunks(batch: list[str], most: int = CHUNK, texts: int = 2000) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters and at most so many texts."""
    part, size = [], 0
    for t in batch:
        if part and (size + len(t) > most or len(part) >= texts):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the probability Jaccard similarity of two weighted sets and the plain one of the sets (sorted hashes, counts)."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a) + len(b) - len(common))
    if wa.max() == 1 and wb.max() == 1:
        return plain
    only_a, only_b = np.ones(len(a), bool), np.ones(len(b), bool)
    only_a[ia], only_b[ib] = False, False
    pairs = np.concatenate([np.stack([wa[ia], wb[ib]], 1), np.stack([wa[only_a], 0 * wa[only_a]], 1), np.stack([0 * wb[only_b], wb[only_b]], 1)])
    kinds, n = np.unique(pairs, axis=0, return_counts=True)
    total = 0.0
    for (x, y), times in zip(kinds, n, strict=True):
        if x and y:
            total += times / float((n * np.maximum(kinds[:, 0] / x, kinds[:, 1] / y)).sum())
    return max(plain, total)


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands): the MD5 of the text and a key for each band of either kind (null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = [], []
            for part in chunks(batch.column(1).to_pylist()):
                of, shingled, n = weighted(part)
                has = np.bincount(of, minlength=len(part)) > 0
                found = list(band_keys(prob_minhash(of, shingled, n, len(part))))
                # the same hashes without weights, for pairs that only the plain similarity links; where nothing is repeated they are the same bands
                repeats = np.unique(of[n > 1])
                own = np.isin(of, repeats)
                plain = band_keys(prob_minhash(np.searchsorted(repeats, of[own]), shingled[own], np.ones(int(own.sum())), len(repeats)))
                for i, k in zip(repeats, plain, strict=True):
                    found[i] = np.unique(np.concatenate([found[i], k]))
                keys += [k if h else None for k, h in zip(found, has, strict=True)]
                digests += [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])
            gc.collect()

    rows_of = texts(docs)
    return rows_of.withColumn("doc_id", rows_of.doc_id.cast("long")).mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as threshold. Only the texts of paired documents move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked: list[bool] = []
            part: list[str] = []
            size = 0

            def test() -> None:
                n = len(part) // 2
                of, runs, times = weighted(part)
                edge = np.searchsorted(of, np.arange(2 * n + 1))
                for i in range(0, 2 * n, 2):
                    a, b = slice(edge[i], edge[i + 1]), slice(edge[i + 1], edge[i + 2])
                    linked.append(similarity(runs[a], times[a], runs[b], times[b]) >= threshold)
                part.clear()

            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                part += [x.as_py(), y.as_py()]
                size += len(part[-1]) + len(part[-2])
                if size >= CHUNK:
                    test()
                    size = 0
            test()
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = rows_with_ids(texts(docs), kept(ids, "paired"))
    both = pairs
    for own, name in (("a", "left"), ("b", "right")):
        text = rows.select(F.col("doc_id").alias(own), F.col("text").alias(name))
        both = both.join(text, own)  # a leader is in many pairs: adaptive execution splits its partition, as the other side has few rows for it
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def bucketed(signed: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large) of representatives (rep, bands): all pairs of small buckets; the members (bucket, rep, rank) of larger ones.

    rank is how many representatives a member meets in all its buckets: what most others are copies of has the highest.
    """
    member = kept(signed.where("bands is not null").select("rep", F.explode("bands").alias("bucket")), "members")
    buckets = kept(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.max("rep").alias("last")).where("n > 1"), "buckets")
    inside = kept(member.join(buckets.where("n > 2").select("bucket", "n"), "bucket"), "inside")
    two = buckets.where("n = 2").select(F.col("least").alias("a"), F.col("last").alias("b"))
    # at most `small` members are gathered here
    groups = inside.where(F.col("n") <= small).groupBy("bucket").agg(F.sort_array(F.collect_set("rep")).alias("r")).select("r").distinct()
    each = groups.select(F.explode(F.transform("r", lambda x: F.struct(x.alias("a"), F.filter("r", lambda y: y > x).alias("bs")))).alias("p")).select("p.a", F.explode("p.bs").alias("b"))
    large = inside.where(F.col("n") > small)
    rank = large.groupBy("rep").agg(F.sum("n").alias("rank"))
    return two.unionByName(each).where("a < b").distinct(), kept(large.select("bucket", "rep").join(rank, "rep"), "large")


def by_salt(df: DataFrame, column: str) -> DataFrame:
    """df with a salt from a hash of column."""
    return df.withColumn("salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))


def stars(members: DataFrame) -> DataFrame:
    """(a, b): each of members (bucket, rep, rank) with the bucket's member of the highest rank (the smallest id of equal ones)."""
    leaders = members.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("rep")).alias("r"))).alias("m")).select("bucket", (-F.col("m.r")).alias("leader"))
    return by_salt(members, "rep").join(to_salts(leaders), ["bucket", "salt"]).where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def texts_shingled(docs: DataFrame) -> DataFrame:
    """(rep, text_id, shingles, weights): the different shingles of each different text of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for part in chunks(batch.column(1).to_pylist()):
                of, runs, times = weighted(part)
                edge = np.searchsorted(of, np.arange(len(part) + 1))
                for i, t in enumerate(part):
                    own = slice(edge[i], edge[i + 1])
                    digest = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                    rows.append((ids[len(rows)], int.from_bytes(digest[:8], "big", signed=True), runs[own].view(np.int64), times[own]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["rep", "text_id", "shingles", "weights"])
            gc.collect()

    rows_of = texts(docs)
    every = rows_of.withColumn("doc_id", rows_of.doc_id.cast("long")).mapInArrow(run, "rep long, text_id long, shingles array<long>, weights array<double>")
    return every.dropDuplicates(["rep", "text_id"])


def openings(ordered: DataFrame, threshold: float) -> DataFrame:
    """Of texts (rep, s: an array of times, shingle, weight in one order for all): the shingles that can be the first which a text shares with a text like it.

    before and weight_before are what the text has before the shingle, n and weight all that it has. A shingle that stands in one text only is shared with none.
    """
    kinds = [("rep", pa.int64()), ("shingle", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("weight_before", pa.float64()), ("weight", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge = batch.column(1).offsets.to_numpy()
            times, shingle, weight = (x.to_numpy(zero_copy_only=False) for x in batch.column(1).flatten().flatten())
            parts = []
            for rep, lo, hi in zip(batch.column(0).to_pylist(), edge[:-1] - edge[0], edge[1:] - edge[0], strict=True):
                n, total, place = hi - lo, weight[lo:hi].sum(), np.arange(hi - lo)
                before = np.cumsum(weight[lo:hi]) - weight[lo:hi]
                at = np.flatnonzero((times[lo:hi] > 1) & ((before <= (1 - threshold) * total + SLACK) | (place <= (1 - threshold) * n + SLACK)))
                parts.append((np.full(len(at), rep), shingle[lo + at], place[at], np.full(len(at), n), before[at], np.full(len(at), total)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    return ordered.mapInArrow(run, "rep long, shingle long, before long, n long, weight_before double, weight double")


def can_be_alike(x: str, y: str, threshold: float) -> Column:
    """Whether texts x and y, whose first common shingle stands where `openings` says, can be as similar as threshold by either measure.

    At most s shingles are common, the lesser of what is left in x and in y; the plain similarity is then s / (nx + ny - s) at most. Of weights, at most what is left is
    common in x (a), and no more than what is left in y and the excess over 1 that is left in x; likewise in y (b). With the weights before (px, py) the probability Jaccard similarity is at
    most 1 / (wx / a + py / b), as x / (c x + d) sums are concave, and the same with x and y changed.
    """
    col = lambda t, c: F.col(f"{t}.{c}")
    left = {t: col(t, "n") - col(t, "before") for t in (x, y)}
    weight = {t: col(t, "weight") - col(t, "weight_before") for t in (x, y)}
    s = F.least(left[x], left[y])
    a, b = (F.least(weight[t], weight[o] + weight[t] - left[t]) for t, o in ((x, y), (y, x)))
    plain = s >= threshold * (col(x, "n") + col(y, "n") - s) - SLACK
    both = [threshold * (col(t, "weight") / u + col(o, "weight_before") / v) <= 1 + SLACK for t, o, u, v in ((x, y, a, b), (y, x, b, a))]
    return plain | (both[0] & both[1])


def across(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of members (rep, c) of different components c that can be as similar as threshold.

    An exact join: in an order that is the same for all texts, the first shingle that two like texts share has little before it in either. The rarest come first, so texts that
    share a template meet in what few of them have. No pair is left out, however large a group is.
    """
    own = texts_shingled(rows_with_ids(docs.select("doc_id", "text"), kept(members.select(F.col("rep").alias("doc_id")).distinct(), "across-ids")))
    each = kept(own.select("rep", "text_id", F.explode(F.arrays_zip("shingles", "weights")).alias("z")).select("rep", "text_id", F.col("z.shingles").alias("shingle"), F.col("z.weights").alias("weight")), "across-shingles")
    times = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    ordered = each.join(times, "shingle").groupBy("rep", "text_id").agg(F.sort_array(F.collect_list(F.struct("times", "shingle", "weight"))).alias("s")).select("rep", "s")
    first = kept(openings(ordered, threshold).join(members, "rep"), "across-openings")
    # a pair of two components has a member outside the shingle's largest one
    sizes = first.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "c")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("shingle", F.col("m.c").alias("main"))
    live = kept(first.join(main, "shingle"), "across-live")
    x, y = live.where("c <> main").alias("x"), live.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))) & can_be_alike("x", "y", threshold))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """One row per input row: doc_id and the class_id of its near-duplicates."""
    rows = kept(banded(docs), "bands")
    known = rows.where("doc_id is not null")
    copies = known.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"))
    copies = kept(copies, "copies")
    pairs, large = bucketed(copies, small)
    links = kept(verified(kept(pairs.unionByName(stars(large)).distinct(), "pairs"), docs, threshold), "links")
    classes = components(links)
    # large buckets that hold several components: all pairs across components that can be links
    placed = kept(large.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("class_id", "rep").alias("c")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("last")).where("least < last").select("bucket")
    apart = kept(by_salt(placed, "rep").join(to_salts(mixed), ["bucket", "salt"]).select("rep", "c").distinct(), "apart")
    if apart.limit(1).count():
        more = kept(verified(kept(across(apart, docs, threshold), "pairs"), docs, threshold), "more")
        if more.limit(1).count():
            classes = components(links.unionByName(more))
    by_text = copies.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"))
    found = rows.select("doc_id", "digest").join(by_text, "digest", "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the smallest id; all columns stay as they are.

    Rows without doc_id stay. Of repeated rows (equal id and text) one stays; an id goes if any of its texts is in the class of a smaller id.
    """
    gone = near_classes(docs, threshold).where("doc_id is not null and class_id < doc_id").select("doc_id").distinct()
    left = rows_with_ids(docs, kept(gone, "gone"), "left_anti").select(*docs.columns)
    ids, different = left.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids == different:
        return left
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents"))
