"""Reading and writing of pages, decks, note folders and state (SRC-1 to SRC-9, SNK-1 to SNK-5)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.text import allowed_host, sanitized
from notemill.streaming.files import store_of

NOT_SUBJECTS = ("Concepts", "Exam")
NAMES_AT_ONCE, BYTES_AT_ONCE = 1000, 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; Spark reads only the columns that are used."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or on this machine where the session names none and has no other."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/notemill-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a folder that all share and read back: it is computed once, its lineage is cut, and it survives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetched_pages(pages: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """SRC-1: pages (url, html) with error; html is null where the host isn't allowed."""
    ok = allowed_host(F.col("url"), hosts)
    return pages.withColumns({"error": F.when(~ok, "host not allowed"), "html": F.when(ok, F.col("html"))})


def _folders(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The folders below a folder that a pattern names, as paths below it; all that the driver holds of a listing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    top = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return [s.getPath().toString()[len(top) + 1 :] for s in _statuses(spark, f"{folder}/{pattern}") if s.isDirectory()]


def _listed(spark: SparkSession, folder: str, within: list[tuple[str, bool]], pattern: str) -> DataFrame:
    """(file, a path below folder) of the files with names of a pattern within folders below it, each with whether its own folders are looked through too. Tasks list the folders, one at a time, and the driver holds no file's
    name. A folder of a local or mounted disk is streamed; of another store that Arrow knows, one folder's names are in its task's memory. Names that begin with a dot are hidden."""
    wanted = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()

    def entries(store: Any, at: str) -> Iterator[tuple[str, bool]]:
        from pyarrow import fs

        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(at) as found:
                for e in found:
                    yield e.name, e.is_dir()
        else:
            for f in store.get_file_info(fs.FileSelector(at)):
                yield f.base_name, f.type == fs.FileType.Directory

    def names(store: Any, root: str, below: str, deep: bool) -> Iterator[str]:
        waiting, fits = [below], re.compile(wanted, re.DOTALL)
        while waiting:
            at = waiting.pop()
            for name, is_folder in entries(store, f"{root}/{at}" if at else root):
                path = f"{at}/{name}" if at else name
                if name.startswith("."):
                    continue
                if not is_folder and fits.fullmatch(name):
                    yield path
                elif is_folder and deep:
                    waiting.append(path)

    def found(batches: Any) -> Any:
        import itertools

        import pyarrow as pa

        store, root = store_of(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rest = names(store, root, *within[k])
                while some := list(itertools.islice(rest, NAMES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["file"])

    return spark.range(0, len(within), 1, max(1, min(len(within), 1000))).mapInArrow(found, "file string")


def _contents(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """(file, content) of listed files, read by as many tasks as a shuffle has; an empty file has an empty content (Spark's own sources leave it out)."""

    def read(batches: Any) -> Any:
        import pyarrow as pa

        store, root = store_of(folder)

        def batch_of(some: list[tuple[str, bytes]]) -> Any:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in some], pa.string()), pa.array([c for _, c in some], pa.binary())], ["file", "content"])

        some: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{file}") as f:
                    content = f.read()
                if some and (len(some) >= NAMES_AT_ONCE or size + len(content) > BYTES_AT_ONCE):
                    yield batch_of(some)
                    some, size = [], 0
                some.append((file, content))
                size += len(content)
        if some:
            yield batch_of(some)

    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(read, "file string, content binary")


def _base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def decks(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC-2: (path, content, size, is_pdf) of deck files in a folder and all below it."""
    within = [("", False), *((f, True) for f in _folders(spark, folder, "*") if not f.startswith("."))]
    rows = _contents(spark, folder, _listed(spark, folder, within, pattern))
    return rows.select(F.concat(F.lit(f"{folder.rstrip('/')}/"), "file").alias("path"), "content", F.octet_length("content").cast("long").alias("size"), (F.substring(F.hex(F.substring("content", 1, 4)), 1, 8) == "25504446").alias("is_pdf"))


def notes(spark: SparkSession, folder: str, subject: str) -> DataFrame:
    """SRC-6: (path, name, content) of the Markdown files directly in a subject's folder (subject may be a wildcard), empty ones too; a subject without a folder has none."""
    rows = _contents(spark, folder, _listed(spark, folder, [(f, False) for f in _folders(spark, folder, subject)], "*.md"))
    return rows.select(F.concat(F.lit(f"{folder.rstrip('/')}/"), "file").alias("path"), F.regexp_replace(_base_name(F.col("file")), r"\.md$", "").alias("name"), F.col("content").cast("string").alias("content"))


def _statuses(spark: SparkSession, pattern: str) -> list[Any]:
    """What a path with wildcards names in its store; nothing where it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])


def concept_names(spark: SparkSession, folder: str, subject: str) -> DataFrame:
    """SRC-7: (subject, name) of a subject's concept notes (subject may be a wildcard); only file names are read, and a subject without a Concepts folder has none."""
    rows = _listed(spark, folder, [(f, False) for f in _folders(spark, folder, f"{subject}/Concepts")], "*.md")
    return rows.select(F.element_at(F.split("file", "/"), -3).alias("subject"), F.regexp_replace(_base_name(F.col("file")), r"\.md$", "").alias("name"))


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-8: the subject folders, with or without notes; one row for each folder directly below, so as few as a folder holds."""
    names = [s.getPath().getName() for s in _statuses(spark, f"{folder}/*") if s.isDirectory()]
    return spark.createDataFrame([(n,) for n in names if n not in NOT_SUBJECTS and not n.startswith(".")], "subject string")


@dataclass(frozen=True)
class Settings:
    """SRC-9: an engine's settings; what a saved state lacks is the default."""

    provider: str = "offline"
    base_folder: str = "notes"
    language: str = "ko"
    rate_delay_ms: int = 4000
    allowed_hosts: tuple[str, ...] = ()

    @classmethod
    def merged(cls, saved: dict[str, Any] | None) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**(asdict(cls()) | {k: v for k, v in (saved or {}).items() if k in known and v is not None}))


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-9: a saved state; an empty table where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def save_state(df: DataFrame, path: str) -> None:
    """SNK-5."""
    df.write.mode("overwrite").json(path)


def save_version(df: DataFrame, folder: str, version: str, partition: str | None = None) -> str:
    """SNK-1, SNK-2: a table's new version in a folder of its own, so that what is read isn't overwritten."""
    writer = df.write.mode("errorifexists")
    path = f"{folder}/version={version}"
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def newest_version(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """SNK-2: (number, path) of a table's newest version that was committed; 0 and None where there is none."""
    numbers = [int(s.getPath().getName()) for s in _statuses(spark, f"{folder}/_newest/[0-9]*")]
    if not numbers:
        return 0, None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/_newest/{max(numbers):012d}")
    stream = pointer.getFileSystem(conf).open(pointer)
    try:
        return max(numbers), f"{folder}/version={stream.readUTF()}"
    finally:
        stream.close()


def commit_version(spark: SparkSession, folder: str, number: int, version: str) -> bool:
    """SNK-2: make a version the newest one, if no other has the number yet: its pointer is a file that is created only where it is absent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/_newest/{number:012d}")
    store = pointer.getFileSystem(conf)
    try:
        stream = store.create(pointer, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    stream.writeUTF(version)
    stream.close()
    return True


def updated_table(spark: SparkSession, folder: str, update: Callable[[DataFrame | None], DataFrame], attempts: int = 20) -> tuple[int, DataFrame]:
    """SNK-2: (number, rows) of the table after update(its newest rows, or None) was written and committed. A writer that comes second to another reads again what that one wrote, so no update is lost."""
    for _ in range(attempts):
        number, path = newest_version(spark, folder)
        version = uuid.uuid4().hex
        written = save_version(update(spark.read.parquet(path) if path else None), folder, version)
        if commit_version(spark, folder, number + 1, version):
            return number + 1, spark.read.parquet(written)
        out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
        out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(out, True)
    raise RuntimeError(f"{folder} was changed by others {attempts} times")


def save_files(df: DataFrame, folder: str) -> None:
    """SNK-1, SNK-4: files (path below folder; content, text or bytes) written by the executors to a folder that all share, in any store that Arrow knows (a path or an
    address); folders are made as needed. Files appear whole: they are written under a name of their own and moved, and a retried task writes the same ones again."""

    def write(rows: Any) -> None:
        store, root = store_of(folder)
        made = set()
        for row in rows:
            target = f"{root}/{row.path}"
            folder_of = os.path.dirname(target)
            if folder_of not in made:  # once for each folder, not for each file
                store.create_dir(folder_of, recursive=True)
                made.add(folder_of)
            part = f"{folder_of}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row.content if isinstance(row.content, bytes | bytearray) else (row.content or "").encode())
            store.move(part, target)

    df.select("path", "content").foreachPartition(write)


def note_path(base: str, subject: Any, title: Any) -> Any:
    """A note's path from its subject and title."""
    return F.concat(F.lit(f"{base}/"), sanitized(subject), F.lit("/"), sanitized(title), F.lit(".md"))
