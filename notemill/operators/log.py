"""The import log and what is counted from it (UPS-1, WIN-2, SRT-6, AGG-3, JOIN-8, JOIN-9, SET-5)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import blank_to_null

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

LOG_MOST, SHOWN_MOST = 50, 20

#: record_id, url, path (missing ones None), seq
Entry = tuple[str | None, str | None, str | None, int]


def log_key(df: DataFrame) -> DataFrame:
    """df with the key by which its records are one: record_id, else url, else path."""
    return df.withColumn("key", F.coalesce(blank_to_null(F.col("record_id")), blank_to_null(F.col("url")), F.col("path")))


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """WIN-2: the newest row of each key; a maximum, so that a key's rows are reduced before they are shuffled."""
    newest = df.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), seq).alias("__row"))
    return newest.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


@dataclass
class Recent:
    """UPS-1: a log of (record_id, url, path, seq), newest first, at most so many.

    A record takes the place of the first that is the same: by id if both have one, else by url if both have one, else by path. What then has an older entry's key (id, else url, else path) takes that one's place, too.
    """

    most: int
    entries: list[Entry] = field(default_factory=list)

    def first_same(self, r: Entry) -> int | None:
        for i, e in enumerate(self.entries):
            if e[0] == r[0] if e[0] and r[0] else e[1] == r[1] if e[1] and r[1] else e[2] == r[2]:
                return i
        return None

    def take_out(self, r: Entry, hit: int | None) -> None:
        """Remove what r takes the place of."""
        if hit is not None:
            del self.entries[hit]
        self.entries = [e for e in self.entries if key_of(e) != key_of(r)]

    def add(self, r: Entry) -> bool:
        """Whether r is an update of an entry; it is the newest one then."""
        hit = self.first_same(r)
        self.take_out(r, hit)
        self.entries = [r, *self.entries][: self.most]
        return hit is not None


def key_of(r: Entry) -> str | None:
    return r[0] or r[1] or r[2]


def _folded(records: DataFrame, most: int) -> DataFrame:
    """The records (record_id, url, path, seq) of each range of seq, folded from an empty log, and that log at the range's end.

    kind is record or entry. hit tells whether the record was an update of one in its own range; held is how many the range's log has then, until it has been full once; a record with held
    may be an update of, or take the place of, what came before the range.
    """
    names = ["part", "kind", "place", "seq", "record_id", "url", "path", "hit", "held"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        log, full, keys, place = Recent(most), False, set(), 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("record_id", "url", "path", "seq")), strict=True):
                hit = log.add(r)
                asks = not full and (not hit or key_of(r) not in keys)
                if asks:
                    keys.add(key_of(r))
                rows.append((part, "record", place, r[3], *(r[:3] if asks else (None,) * 3), hit, len(log.entries) if asks else None))
                full = full or len(log.entries) >= most
                keys = set() if full else keys
                place += 1
            yield batch_of(rows)
        yield batch_of([(part, "entry", i, e[3], *e[:3], full, None) for i, e in enumerate(log.entries)])

    ranges = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "part int, kind string, place long, seq long, record_id string, url string, path string, hit boolean, held int"
    return records.repartitionByRange(ranges, "seq").sortWithinPartitions("seq").mapInArrow(run, kind)


def _entries(df: DataFrame) -> DataFrame:
    """The columns that make records the same."""
    text = lambda c: blank_to_null(F.col(c).cast("string")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    return df.select(*map(text, ("record_id", "url", "path")), F.col("seq").cast("long").alias("seq"))


def upserts(history: DataFrame, records: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = LOG_MOST) -> tuple[DataFrame, list[int]]:
    """UPS-1: ((seq, was_update) of every record, seqs of the log after all of them, newest first).

    history is the log before (its newest rows, at most so many); seq rises from record to record and is unique. Whether two records are the same isn't transitive, so the log is folded in order. Ranges of records are folded
    side by side, each from an empty log: its entries are the newest of the true log at every step, whatever came before, and when it has been full once, they are all of it. Only the records before that which were no update in their
    range are looked up in the log that came before, range by range. These are about as many for each range as the log holds; they, and no more, come to the driver.

    keep writes what was folded and reads it back, so that it is folded once.
    """
    spark = records.sparkSession
    folded = keep(_folded(_entries(records), most))
    before = [(r.record_id, r.url, r.path, r.seq) for r in _entries(history).orderBy(F.desc("seq")).limit(most).collect()]
    ranges: dict[int, tuple[list[Any], list[Any]]] = {}
    for r in folded.where("held IS NOT NULL OR kind = 'entry'").orderBy("part", "kind", "place").collect():
        ranges.setdefault(r.part, ([], []))[r.kind == "entry"].append(r)
    found: list[int] = []
    for _, (asking, entries) in sorted(ranges.items()):
        older = Recent(most, before)
        for r in asking:
            e = (r.record_id, r.url, r.path, r.seq)
            hit = None if r.hit else older.first_same(e)
            if hit is not None:
                found.append(r.seq)
            older.take_out(e, hit)
            older.entries = older.entries[: most - r.held]
        full = any(e.hit for e in entries)
        before = [(e.record_id, e.url, e.path, e.seq) for e in entries] + ([] if full else older.entries)
    later = F.broadcast(spark.createDataFrame([(s, True) for s in found], "seq long, __older boolean"))
    updates = folded.where("kind = 'record'").join(later, "seq", "left").select("seq", (F.col("hit") | F.coalesce("__older", F.lit(False))).alias("was_update"))
    return updates, [e[3] for e in before]


def upserted_log(history: DataFrame, records: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = LOG_MOST) -> DataFrame:
    """UPS-1: the log after records came: the rows of both that are left, newest first, with was_update; rows of the history keep theirs, or have had none."""
    updates, left = upserts(history, records, keep, most)
    own = history if "was_update" in history.columns else history.withColumn("was_update", F.lit(False))
    rows = own.where(F.col("seq").isin(left)).unionByName(records.drop("was_update").where(F.col("seq").isin(left)).join(updates, "seq"), allowMissingColumns=True)
    return rows.orderBy(F.desc("seq"))


def still_there(log: DataFrame, files: DataFrame, most: int = SHOWN_MOST) -> DataFrame:
    """JOIN-8, SRT-6: the newest records whose file (path) exists."""
    return log.join(files.select("path").distinct(), "path", "left_semi").orderBy(F.desc("seq")).limit(most)


def period_counts(log: DataFrame, subject: str = "subject", period: str = "exam_period", first: str = "midterm", second: str = "final") -> DataFrame:
    """AGG-3: records of each subject in either period and in none."""
    p = F.col(period)
    return log.groupBy(subject).agg(F.count_if(p == first).alias(first), F.count_if(p == second).alias(second), F.count_if(p.isNull() | ~p.isin(first, second)).alias("none"))


def with_deck(notes: DataFrame, decks: DataFrame) -> DataFrame:
    """JOIN-9: notes (path, ...) with the deck that has the note's path and .pdf."""
    return notes.withColumn("__d", F.regexp_replace("path", r"\.md$", ".pdf")).join(decks.select(F.col("path").alias("__d"), F.lit(True).alias("has_deck")), "__d", "left").withColumn("deck_path", F.when(F.col("has_deck"), F.col("__d"))).drop("__d", "has_deck")
