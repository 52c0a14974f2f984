"""Quality classifier by co-training of two views (operator 6).

One logistic classifier sees a text's content: how often which shapes of words occur (letters, capitals, digits and signs as runs) and ratios such as
repeated words. The other sees the page's metadata: length, lines, language and source. Both learn from a bounded sample of
labelled rows. Then, round by round, each labels the texts of a bounded unlabelled pool that it is surest about, and the other learns from these as well. At last both
are calibrated on labelled rows kept apart, and a logistic combination of the two calibrated views scores every text whole.

Defined results: a null text is the empty text; null metadata is a value of its own, as is that of a missing column. Without labels of both kinds every score is 1: nothing is known
against any text. Repeated rows give repeated results; of differing labels of one id the larger counts, and of differing rows of one id one is learnt from. Labelled rows that `held_out`
sets apart are never learnt from, nor are they in the pool.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reachable, table
from .toxicity import held_out, one_row_each

#: Labelled rows of each kind, and unlabelled rows of the pool, that are learnt from at most: those with the smallest hashes of ids.
SAMPLE_PER_LABEL, POOL = 2000, 4000
#: Rounds of co-training, and texts that a view labels in each as good and as bad, at most.
ROUNDS, SURE_GOOD, SURE_BAD, SURE = 4, 150, 50, 0.99
SHAPES, RIDGE, THRESHOLD = 192, 1.0, 0.3
METADATA = ("lang", "source")
_LOWER, _UPPER, _DIGITS, _SIGNS = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]{2,}"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+")


class _Shapes(dict):
    """Word to the slot of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        shape = _SIGNS.sub(r"\1\1", _LOWER.sub("a", _UPPER.sub("A", _DIGITS.sub("0", word)))) if word.isascii() else _SIGNS.sub(r"\1\1", _LOWER.sub("a", word if not word.isupper() else "A"))
        slot = self[word] = zlib.crc32(shape[:12].encode("utf-8", "surrogatepass")) % SHAPES
        return slot


def content_features(text: str, shapes: dict[str, int]) -> np.ndarray:
    """The content view: square roots of the shapes' shares, then ratios."""
    words = text.split()
    n = len(words)
    out = np.zeros(SHAPES + 6)
    if not n:
        return out
    out[:SHAPES] = np.sqrt(np.bincount(list(map(shapes.__getitem__, words)), minlength=SHAPES) / n)
    counts = Counter(words)
    lines = text.split("\n")
    out[SHAPES:] = (
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        sum(map(len, words)) / n / 10,
        sum(w.isupper() for w in words) / n,
    )
    return out


def metadata_features(text: str, values: tuple[str | None, ...]) -> np.ndarray:
    """The metadata view: sizes on a logarithmic scale, and hashed values of the metadata columns."""
    out = np.zeros(4 + 16 * len(values))
    lines = text.count("\n") + 1
    out[:4] = np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), float(not text)
    for k, v in enumerate(values):
        out[4 + 16 * k + zlib.crc32(repr(v).encode("utf-8", "surrogatepass")) % 16] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    ridge: float = RIDGE
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-2)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        self.weights = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-5:
                break
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


@dataclass
class CoTrained:
    """The two views' classifiers, their calibrations, and what combines them. views is empty if nothing could be learnt."""

    views: list[Logistic] = field(default_factory=list)
    calibrations: list[Logistic] = field(default_factory=list)
    combined: Logistic | None = None

    def fit(self, x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
        """x and pool: the features of each view; every fourth labelled row is kept apart to calibrate on."""
        if len(y) < 8 or len(set(y.tolist())) < 2:
            return self
        apart = np.zeros(len(y), bool)
        for k in (0, 1):
            apart[np.flatnonzero(y == k)[3::4]] = True
        learn = ~apart if all((y[~apart] == k).any() and (y[apart] == k).any() for k in (0, 1)) else np.ones(len(y), bool)
        apart = apart if not learn.all() else learn
        seen = [(x[v][learn], y[learn]) for v in (0, 1)]
        free = [np.ones(len(pool[0]), bool) for _ in (0, 1)]  # what a view hasn't been given yet
        for _ in range(rounds):
            views = [Logistic().fit(*seen[v]) for v in (0, 1)]
            for v in (0, 1):
                other, p = 1 - v, views[v].score(pool[v])
                for good, sure, most in ((1, p, SURE_GOOD), (0, 1 - p, SURE_BAD)):
                    at = np.flatnonzero(free[other] & (sure >= SURE))
                    at = at[np.argsort(-sure[at], kind="stable")[:most]]
                    free[other][at] = False
                    seen[other] = (np.concatenate([seen[other][0], pool[other][at]]), np.concatenate([seen[other][1], np.full(len(at), float(good))]))
        self.views = [Logistic().fit(*seen[v]) for v in (0, 1)]
        raws = [self.views[v].raw(x[v][apart])[:, None] for v in (0, 1)]
        self.calibrations = [Logistic(ridge=0.1).fit(raws[v], y[apart]) for v in (0, 1)]
        self.combined = Logistic(ridge=0.1).fit(np.column_stack([self.calibrations[v].raw(raws[v]) for v in (0, 1)]), y[apart])
        return self

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined score, content view's, metadata view's), each calibrated."""
        if not self.views:
            ones = np.ones(len(x[0]))
            return ones, ones, ones
        raws = [self.calibrations[v].raw(self.views[v].raw(x[v])[:, None]) for v in (0, 1)]
        own = [1 / (1 + np.exp(-r)) for r in raws]
        return self.combined.score(np.column_stack(raws)), own[0], own[1]


def _features(text: list[str | None], metadata: list[tuple[str | None, ...]], shapes: dict[str, int]) -> list[np.ndarray]:
    text = [t or "" for t in text]
    return [np.stack([content_features(t, shapes) for t in text]), np.stack([metadata_features(t, m) for t, m in zip(text, metadata, strict=True)])]


def _slim(docs: DataFrame) -> DataFrame:
    """(doc_id, text, metadata...); a metadata column that docs lacks is null."""
    reachable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"meta_{c}") for c in METADATA])


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, pool: int = POOL) -> CoTrained:
    """Co-trained classifiers, learnt on the driver from the features of two bounded samples of docs."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    may = known.where(~held_out(F.col("doc_id")))
    parts = [may.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    others = ids.orderBy(F.xxhash64("doc_id", F.lit("pool")), "doc_id").limit(pool).withColumn("label", F.lit(-1))
    # a bounded number of ids, and one row of each
    rows = one_row_each(_slim(docs).withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(sample.unionByName(others)), "doc_id"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        kind = pa.list_(pa.float64())
        for batch in batches:
            if batch.num_rows:
                meta = list(zip(*[batch.column(2 + k).to_pylist() for k in range(len(METADATA))], strict=True))
                x = _features(batch.column(1).to_pylist(), meta, shapes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), *[pa.array(list(v), kind) for v in x]], ["doc_id", "label", "content", "metadata"])

    got = rows.mapInArrow(featured, "doc_id long, label int, content array<double>, metadata array<double>").toArrow().sort_by("doc_id")
    label = got.column("label").to_numpy()
    views = [got.column(c).combine_chunks().flatten().to_numpy().reshape(len(label), -1 if len(label) else 1) for c in ("content", "metadata")]
    learn = label >= 0
    return CoTrained().fit([v[learn] for v in views], label[learn].astype(float), [v[~learn] for v in views])


def _batch_scorer(model: CoTrained) -> Callable[[list[str | None], list[tuple[str | None, ...]]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    shapes = _Shapes()

    def score(text: list[str | None], metadata: list[tuple[str | None, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [model.score(_features(text[k : k + 512], metadata[k : k + 512], shapes)) for k in range(0, len(text), 512)]
        return tuple(np.concatenate([np.zeros(0), *(f[v] for f in found)]) for v in range(3))

    return score


def scored(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score (1: good), the views' own scores, and whether the row is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _batch_scorer(shared.value)
        for batch in batches:
            meta = list(zip(*[batch.column(2 + k).to_pylist() for k in range(len(METADATA))], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.float64()) for v in score(batch.column(1).to_pylist(), meta)]], ["doc_id", "score", "content_score", "metadata_score"])

    rows = _slim(docs).mapInArrow(run, "doc_id long, score double, content_score double, metadata_score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def with_quality(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows of low quality; all columns stay as they are."""
    reachable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _batch_scorer(shared.value)
        for batch in batches:
            value = lambda v: None if v is None else str(v)
            meta = list(zip(*[[value(v) for v in batch.column(names.index(c)).to_pylist()] if c in names else [None] * batch.num_rows for c in METADATA], strict=True))
            yield batch.filter(pa.array(score(batch.column(names.index("text")).to_pylist(), meta)[0] >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: scores of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
