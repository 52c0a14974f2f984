"""Toxicity scores by a factorization machine over hashed terms (operator 3).

A text's terms are its words in lower case and their beginnings of 3 to 8 letters, each hashed to one of 2**HASH_BITS slots and counted
once. The machine has a weight and a short vector for each slot; its score is the logistic function of the weights' sum and of all
products of two terms' vectors, so that pairs of terms tell what no sum of weights can. It learns from a bounded
sample of labelled rows and scores every text whole, in one pass without a shuffle. Of the terms in that sample, those have vectors that tell something of the label alone, or together with
another one (telling_pairs); with vectors for all, a few hundred toxic rows teach it chance (README).

Defined results: a null text is the empty text; it has no terms and gets the score of the bias. Without labels of both kinds every
score is the share of toxic labels (0 if none). A null doc_id is not held out. Repeated rows give repeated results; of differing labels of
one id the larger counts, and of differing texts of one id the least is learnt from. Columns of documents other than doc_id and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: Rows of each label that are learnt from, at most: those whose ids have the smallest hashes.
SAMPLE_PER_LABEL = 2500
HASH_BITS, FACTORS, EPOCHS, RATE, DECAY, SEED = 18, 4, 30, 0.1, 2e-4, 7
#: Training rows that must have a term, standard errors by which its odds must differ between the labels, and the score from which on a text counts as toxic.
LEAST_ROWS, LEAST_Z, THRESHOLD = 3, 2.5, 0.7
#: Most common terms whose pairs are looked at, and standard errors by which a pair's odds must differ from what its terms have alone.
PAIRED, PAIR_Z = 2048, 5.0
WORDS = re.compile(r"\w+")


def terms_of(word: str, bits: int = HASH_BITS) -> tuple[int, ...]:
    """The slots of a word and of its beginnings."""
    mask = (1 << bits) - 1
    raw = [b"=" + word.encode("utf-8", "surrogatepass")] + [b"^" + word[:n].encode("utf-8", "surrogatepass") for n in range(3, min(8, len(word)) + 1)]
    return tuple({zlib.crc32(x) & mask for x in raw})


class _Terms(dict):
    """Word to slots; keep tells which slots count. Starts anew when it holds many words."""

    def __init__(self, keep: np.ndarray | None = None, most: int = 150_000):
        super().__init__()
        self.keep, self.most = keep, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = terms_of(word)
        if self.keep is not None:
            found = tuple(x for x in found if self.keep[x])
        self[word] = found
        return found

    def slots(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, set(WORDS.findall(text.lower()))))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, n_rows: np.ndarray, most: int = PAIRED, least_z: float = PAIR_Z, block: int = 256) -> np.ndarray:
    """The terms, of the most common ones, that say something of the label together with another and not by themselves: the logarithm of the odds with both, less that with either, plus
    that with neither, is least_z standard errors from 0."""
    either = np.minimum(n_rows, len(rows) - n_rows)
    terms = np.argsort(-either, kind="stable")[:most]
    terms = np.sort(terms[either[terms] > 0])
    place = np.full(len(n_rows), -1)
    place[terms] = np.arange(len(terms))
    told = np.zeros(len(terms), bool)
    matrices = []
    for k in (0, 1):
        x = np.zeros((int((labels == k).sum()), len(terms)), np.float32)
        for i, r in enumerate(r for r, y in zip(rows, labels, strict=True) if y == k):
            own = place[r]
            x[i, own[own >= 0]] = 1
        matrices.append((x, x.sum(0)))
    for at in range(0, len(terms), block):
        effect, spread = 0.0, 0.0
        for k, (x, n) in enumerate(matrices):
            both = x[:, at : at + block].T @ x
            one, other = n[at : at + block, None], n[None, :]
            cells = [both, one - both, other - both, len(x) - one - other + both]
            effect = effect + (1 if k else -1) * sum(sign * np.log(c + 0.5) for sign, c in zip((1, -1, -1, 1), cells, strict=True))
            spread = spread + sum(1 / (c + 0.5) for c in cells)
        z = np.abs(effect) / np.sqrt(spread)
        z[np.arange(len(z)), np.arange(at, at + len(z))] = 0
        told[at : at + len(z)] |= (z >= least_z).any(1)
        told |= (z >= least_z).any(0)
    return terms[told]


class FactorizationMachine:
    """Logistic factorization machine of degree two over sets of slots."""

    def __init__(self, slots: int, factors: int = FACTORS, seed: int = SEED):
        self.bias = 0.0
        self.weights = np.zeros(slots, np.float32)
        self.vectors = np.random.default_rng(seed).normal(0, 0.01, (slots, factors)).astype(np.float32)
        self.seen = np.zeros(slots, bool)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, batch: int = 32, least: int = LEAST_ROWS, seed: int = SEED) -> FactorizationMachine:
        """Adaptive gradient steps on small batches, in an order fixed by the seed."""
        slots = len(self.weights)
        with_term = [np.bincount(np.concatenate([*(r for r, y in zip(rows, labels, strict=True) if y == k), np.zeros(0, np.int32)]), minlength=slots) for k in (0, 1)]
        # a term must be in enough rows, and differ between the labels by more than chance would have it, alone or with another
        odds = [np.log((n + 0.5) / (max(1, (labels == k).sum()) + 1.0)) for k, n in enumerate(with_term)]
        self.seen = (with_term[0] + with_term[1] >= least) & (np.abs(odds[1] - odds[0]) >= LEAST_Z * np.sqrt(1 / (with_term[0] + 0.5) + 1 / (with_term[1] + 0.5)))
        share = labels.mean() if len(labels) else 0.0
        if 0 < share < 1:
            self.seen[telling_pairs(rows, labels, with_term[0] + with_term[1])] = True
        rows = [r[self.seen[r]] for r in rows]
        if not 0 < share < 1:
            self.bias, self.seen[:] = (-30.0 if share == 0 else 30.0), False
            return self
        self.bias = float(np.log(share / (1 - share)))
        sum_w, sum_v, sum_b = np.full(slots, 1e-3, np.float32), np.full(self.vectors.shape, 1e-3, np.float32), 1e-3
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = [k for k in order[at : at + batch] if len(rows[k])]
                if not chosen:
                    continue
                flat, y = np.concatenate([rows[k] for k in chosen]), labels[chosen]
                sizes = np.array([len(rows[k]) for k in chosen])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                v = self.vectors[flat]
                sums = np.add.reduceat(v, starts)
                raw = self.bias + np.add.reduceat(self.weights[flat], starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
                off = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(chosen)).astype(np.float32)
                off_x = np.repeat(off, sizes)
                used, inverse = np.unique(flat, return_inverse=True)
                g_w = np.bincount(inverse, off_x, len(used)).astype(np.float32) + decay * self.weights[used]
                each = off_x[:, None] * (np.repeat(sums, sizes, axis=0) - v)
                g_v = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(each.shape[1])], 1).astype(np.float32) + decay * self.vectors[used]
                sum_w[used] += g_w**2
                sum_v[used] += g_v**2
                self.weights[used] -= rate * g_w / np.sqrt(sum_w[used])
                self.vectors[used] -= 0.5 * rate * g_v / np.sqrt(sum_v[used])
                sum_b += float(off.sum()) ** 2
                self.bias -= rate * float(off.sum()) / sum_b**0.5
        return self

    def score(self, slots: np.ndarray) -> float:
        raw = self.bias
        if len(slots):
            v = self.vectors[slots]
            raw += float(self.weights[slots].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, text, label) of at most per_label ids of either label that may be learnt from, those with the smallest hashes of ids.

    The sample's ids are a bounded number of rows and so may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    return one_row_each(texts(docs).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id"))


def one_row_each(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text, ...) of a bounded sample of ids, one for each id: that of the least text, chosen before the shuffle as well."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    best = rows.groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("__row"))
    return best.select("doc_id", *[F.col(f"__row.{c}").alias(c) for c in ("text", *others)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> FactorizationMachine:
    """The machine, learnt on the driver from the sample's terms."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            slots = [sorted(terms.slots(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "label", "slots"])

    sample = labelled_sample(docs, labels, "toxic", per_label).select("doc_id", "text", "label").mapInArrow(featured, "doc_id long, label int, slots array<int>").toArrow().sort_by("doc_id")
    rows = [np.asarray(x.values, np.int32) for x in sample.column("slots")]
    return FactorizationMachine(1 << HASH_BITS).fit(rows, sample.column("label").to_numpy().astype(np.float32))


def text_scorer(machine: FactorizationMachine) -> Callable[[], Callable[[str], float]]:
    """Makes, in each task, a function from a text to its score."""

    def start() -> Callable[[str], float]:
        terms = _Terms(machine.seen)

        def score(text: str) -> float:
            slots = terms.slots(text)
            return machine.score(np.fromiter(slots, np.int64, len(slots)))

        return score

    return start


def scored(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = text_scorer(model.value)()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = texts(docs)
    rows = rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text is toxic; all columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = text_scorer(model.value)()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of documents, learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
