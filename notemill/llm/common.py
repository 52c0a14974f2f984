"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that a Python worker gets at once, where the session doesn't say: texts are decoded whole, so batches bound a worker's memory.
BATCH_BYTES = f"{8 << 20}b"


def reachable(spark: SparkSession) -> None:
    """Let this session's Python workers import this package from where the driver has it, if it wasn't shipped otherwise, and get batches of a bounded size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", f"{64 << 20}b"):  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any store that Spark knows will do."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the session names none and runs on one machine (tests), a folder of this machine's own is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else ""
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="notemill-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/notemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove what kept() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; every other column of docs is left behind, so none can clash."""
    reachable(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Ids that may be broadcast: eight bytes each, so some tens of MB at most.
BROADCAST_IDS = 1_000_000


def rows_with_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """rows whose doc_id is (left_semi) or is not (left_anti) among ids (one column, doc_id, no row twice).

    ids is broadcast if it has most rows at most, so that no text moves; beyond that both sides are shuffled.
    """
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


#: Parts that the rows of a key are dealt in where the key may be that of most rows.
SALTS = 16


def to_salts(df: DataFrame) -> DataFrame:
    """df with a row for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, class_id): for each id in edges (a, b), the smallest id that it is connected with.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, until none changes. Only labels that have changed themselves are looked up, and they are sent to
    every salt, as a label may be that of most nodes.
    Every round's labels are written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    both = kept(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(), name)
    labels = kept(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("class_id")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("class_id").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        best = labels.join(near, "id").select("id", "class_id", F.least("class_id", "c").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("class_id").alias("d")).where("d < c").join(best.select("c").distinct(), "c")
        salted = best.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(to_salts(jump), ["c", "salt"], "left")
        new = kept(salted.select("id", F.least("c", "d").alias("class_id"), (F.least("c", "d") != F.col("class_id")).alias("changed")), name)
        done = new.where("changed").limit(1).count() == 0
        dropped(labels)
        labels = new.select("id", "class_id")
        if done:
            dropped(both)
            return labels


def sql_crc32(text: str) -> str:
    """The CRC-32 of a text of ASCII characters in DuckDB's SQL, which has no function for it: eight steps for each byte."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""
