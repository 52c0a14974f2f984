"""Multidimensional clustered layout (operator 12): rows in Z-order of their rank coordinates, cut into files, and how many files each row's neighbourhood query reads and needs.

Each dimension's values are ranked by a distributed prefix sum over their counts and cut into GRID coordinates. The coordinates' digits are interleaved, rows are put in that order by a range
partitioning that also takes ids (so no cell goes through one task), and every FILE_ROWS rows are a file.

A query asks for the cells whose coordinates are near a row's own. How many files it has to open and how many hold a match is found by inverted scatter, once for each cell and without a range join: every
distinct (cell, file) explodes to the query cells around it, and the files of each are counted; every file's box, widened by the query's reach, explodes to the occupied cells in it, and these are
counted.

What the driver sees and what is broadcast doesn't grow with the input: a number for each range, and GRID bounds for each dimension. A file's group holds FILE_ROWS rows at most. Joins on cells
are salted, as a cell may hold a large share of all rows, and shuffled, as the occupied cells grow with the input until every cell of the grid is one.

Defined results: equal values have equal coordinates, whatever their number. Nulls are the smallest value; a null text's length is -1, and a row without id has no date. Rows of equal z and id are put in order of the hashes of
their texts, and equal rows take neighbouring positions. The empty table gives no rows. Columns that aren't asked for are left behind, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, kept, sql_crc32, table, to_salts

#: Coordinates of a dimension (a power of two), and rows of a file.
GRID, FILE_ROWS = 16, 500

_ROW_BITS = 33  # of monotonically_increasing_id


@dataclass(frozen=True)
class Dimension:
    """A value to cluster by (a string or a number), and how far a query reaches to either side of its own coordinate."""

    name: str
    value: Column
    reach: int = 0


def ranges_of(spark: SparkSession) -> int:
    """Ranges that sorted rows are dealt in: as many as shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def before_each(parts: DataFrame, size: str) -> tuple[DataFrame, int]:
    """(part, offset): the sum of size over the parts before, and the sum of all; parts has a row for each range, so it is bounded by the ranges."""
    offsets, total = [], 0
    for part, n in sorted((r["part"], r[size]) for r in parts.collect()):
        offsets.append((part, total))
        total += n
    return parts.sparkSession.createDataFrame(offsets, "part int, offset long"), total


def cuts(rows: DataFrame, dims: list[Dimension], grid: int) -> list[list[tuple[int, object]]]:
    """For each dimension the (coordinate, smallest value) that occur; rows has a column for each dimension.

    A value's coordinate is floor(grid * s / n), where s of all n rows have a smaller value.
    """
    spark = rows.sparkSession
    numeric = [dict(rows.dtypes)[d.name] != "string" for d in dims]
    value = lambda i, d: F.struct(F.lit(i).alias("dim"), (F.lit(None) if numeric[i] else F.col(d.name)).cast("string").alias("s"), (F.col(d.name) if numeric[i] else F.lit(None)).cast("long").alias("x"))
    counted = rows.select(F.explode(F.array(*[value(i, d) for i, d in enumerate(dims)])).alias("v")).groupBy("v.dim", "v.s", "v.x").agg(F.count(F.lit(1)).alias("n"))
    ordered = kept(counted.repartitionByRange(ranges_of(spark), "dim", "s", "x").withColumn("part", F.spark_partition_id()), "layout-values")
    offsets, total = before_each(ordered.groupBy("part").agg(F.sum("n").alias("n")), "n")
    n = total // len(dims)
    there = Window.partitionBy("part").orderBy("dim", "s", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    smaller = F.sum("n").over(there) - F.col("n")
    ranked = ordered.withColumn("s_here", smaller).join(F.broadcast(offsets), "part").withColumn("smaller", F.col("s_here") + F.col("offset") - F.col("dim") * F.lit(n).cast("long"))
    ranked = ranked.withColumn("coordinate", F.expr(f"cast(smaller * {grid} div {max(n, 1)} as int)"))
    found: list[list[tuple[int, object]]] = [[] for _ in dims]
    for r in ranked.groupBy("dim", "coordinate").agg(F.min(F.struct("s", "x")).alias("least")).collect():
        found[r["dim"]].append((r["coordinate"], r["least"]["x" if numeric[r["dim"]] else "s"]))
    return found


def coordinate(value: Column, found: list[tuple[int, object]]) -> Column:
    """The coordinate of a value among those of cuts()."""
    steps = [F.when(value >= F.lit(least), k).otherwise(0) for k, least in sorted(found, key=lambda f: f[0]) if least is not None and k]
    return F.greatest(F.lit(0), *steps) if steps else F.lit(0)


def interleaved(coordinates: list[Column], grid: int) -> Column:
    """The coordinates' binary digits, highest first, one of each dimension in turn."""
    z = F.lit(0).cast("long")
    for bit in range((grid - 1).bit_length() - 1, -1, -1):
        for c in coordinates:
            z = z * 2 + F.shiftright(c, bit).bitwiseAND(F.lit(1))
    return z


def placed(docs: DataFrame, dims: list[Dimension], order: list[str], ids: list[Column], carry: list[str] | None = None, grid: int = GRID, file_rows: int = FILE_ROWS) -> DataFrame:
    """docs' columns carry, with z, position, file and at_<dimension> for each dimension.

    order names the dimensions as their digits are interleaved; rows of equal z come in the order of ids.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in carry], *[d.value.alias(d.name) for d in dims], *[c.alias(f"id_{i}") for i, c in enumerate(ids)])
    found = cuts(rows, dims, grid)
    at = {d.name: coordinate(F.col(d.name), found[i]).cast("int") for i, d in enumerate(dims)}
    rows = rows.select("*", *[c.alias(f"at_{name}") for name, c in at.items()])
    rows = rows.withColumn("z", interleaved([F.col(f"at_{name}") for name in order], grid)).withColumn("any", F.monotonically_increasing_id())
    keys = ["z", *[f"id_{i}" for i in range(len(ids))], "any"]  # the last one lets a range end among equal rows
    there = rows.repartitionByRange(ranges_of(spark), *keys).sortWithinPartitions(*keys).withColumn("there", F.monotonically_increasing_id())
    there = kept(there.select(*[f"own_{c}" for c in carry], "z", *[f"at_{d.name}" for d in dims], F.shiftright("there", _ROW_BITS).cast("int").alias("part"), F.col("there").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row")), "layout-rows")
    offsets, _ = before_each(there.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n")
    there = there.join(F.broadcast(offsets), "part").withColumn("position", F.col("row") + F.col("offset"))
    return there.select(*[F.col(f"own_{c}").alias(c) for c in carry], "z", "position", F.expr(f"position div {file_rows}").alias("file"), *[f"at_{d.name}" for d in dims])


def write_files(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """What placed() gives, written as Parquet files that are its files: a task gets whole files in order, and begins a new one after file_rows rows."""
    spark = rows.sparkSession
    rows.repartitionByRange(ranges_of(spark), "file").sortWithinPartitions("position").write.option("maxRecordsPerFile", file_rows).parquet(path)


def scattered(files: DataFrame, dims: list[Dimension], grid: int) -> DataFrame:
    """(cell, files_touched, files_matching) for each occupied cell; files has file, cells (distinct) and low_, high_ of each dimension."""
    count = len(dims)
    weight = [grid ** (count - 1 - i) for i in range(count)]
    digit = lambda c, i: F.pmod(F.floor(c / F.lit(weight[i])).cast("int"), F.lit(grid))

    def neighbours(cells: Column, i: int) -> Column:
        """The cells, and those that are within reach of one in dimension i."""
        steps = F.array(*[F.lit(k) for k in range(-dims[i].reach, dims[i].reach + 1)])
        near = lambda c: F.transform(F.filter(steps, lambda k: (digit(c, i) + k).between(0, grid - 1)), lambda k: c + k * weight[i])
        return F.array_distinct(F.flatten(F.transform(cells, near)))

    around = F.col("cells")
    for i, d in enumerate(dims):
        around = neighbours(around, i) if d.reach else around
    matching = files.select(F.explode(around).alias("cell"), F.lit(0).alias("touched"), F.lit(1).alias("matching"))

    # occupied cells by their first digits; a box explodes to first digits and takes from each list what lies inside it
    heads = max(1, count - 2)
    rest = grid ** (count - heads)
    head, tail = F.floor(F.col("cell") / F.lit(rest)).cast("int"), F.pmod("cell", F.lit(rest))
    occupied = files.select(F.explode("cells").alias("cell")).distinct().select(head.alias("head"), tail.alias("tail")).groupBy("head").agg(F.collect_list("tail").alias("tails"))
    low = lambda i: F.greatest(F.col(f"low_{dims[i].name}") - dims[i].reach, F.lit(0))
    high = lambda i: F.least(F.col(f"high_{dims[i].name}") + dims[i].reach, F.lit(grid - 1))
    longer = lambda some, i: F.flatten(F.transform(some, lambda b: F.transform(F.sequence(low(i), high(i)), lambda k: b * grid + k)))
    boxes = reduce(longer, range(heads), F.array(F.lit(0)))
    inside = lambda t: reduce(and_, [digit(t, i).between(low(i), high(i)) for i in range(heads, count)], F.lit(True))
    boxes = files.select(*[f"{side}_{d.name}" for d in dims for side in ("low", "high")], F.pmod("file", F.lit(SALTS)).cast("int").alias("salt"), F.explode(boxes).alias("head"))
    met = boxes.hint("merge").join(to_salts(occupied), ["head", "salt"])
    touched = met.select(F.explode(F.transform(F.filter("tails", inside), lambda t: F.col("head") * rest + t)).alias("cell"), F.lit(1).alias("touched"), F.lit(0).alias("matching"))
    both = touched.unionByName(matching).groupBy("cell").agg(F.sum("touched").alias("files_touched"), F.sum("matching").alias("files_matching"))
    return both.where("files_touched > 0")  # a cell around a row that holds none itself is no one's query


def with_query_files(rows: DataFrame, dims: list[Dimension], carry: list[str], grid: int = GRID) -> DataFrame:
    """What placed() gives, with files_touched, files_matching and file_bounds (the file's lowest and highest coordinate of each dimension, in the order of dims)."""
    at = [F.col(f"at_{d.name}") for d in dims]
    cell = F.lit(0)
    for c in at:
        cell = cell * grid + c
    own = [*carry, "z", "position", "file"]
    bounds = [x for d in dims for x in (F.min(f"at_{d.name}").alias(f"low_{d.name}"), F.max(f"at_{d.name}").alias(f"high_{d.name}"))]
    files = rows.withColumn("cell", cell).groupBy("file").agg(F.collect_list(F.struct(*[c for c in own if c != "file"], "cell")).alias("rows"), *bounds)
    files = kept(files.withColumn("cells", F.array_distinct(F.transform("rows", lambda r: r["cell"]))), "layout-files")
    counts = scattered(files, dims, grid)
    named = F.concat_ws(",", *[F.col(f"{side}_{d.name}").cast("string") for d in dims for side in ("low", "high")])
    back = files.select("file", named.alias("file_bounds"), F.explode("rows").alias("r")).select("file", "file_bounds", "r.*").withColumn("salt", F.pmod("position", F.lit(SALTS)).cast("int"))
    return back.hint("merge").join(to_salts(counts), ["cell", "salt"]).select(*own, "files_touched", "files_matching", "file_bounds")


def document_dimensions() -> list[Dimension]:
    """Source, language, length in bytes and day of a document; queries reach two coordinates of length and day to either side."""
    return [
        Dimension("source", F.col("source").cast("string")),
        Dimension("lang", F.col("lang").cast("string")),
        Dimension("length", F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long"), 2),
        Dimension("date", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(365)).cast("long"), 2),
    ]


def document_layout(docs: DataFrame, carry: list[str] | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """documents in Z-order of length, source, date and language; equal z by doc_id."""
    docs = docs.select("doc_id", "text", "source", "lang", *[c for c in carry or [] if c not in ("doc_id", "text", "source", "lang")])
    return placed(docs, document_dimensions(), ["length", "source", "date", "lang"], [F.col("doc_id").cast("long"), F.xxhash64("text")], carry or ["doc_id"], file_rows=file_rows)


def op12_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: places and query files of all documents."""
    rows = document_layout(table(spark, sf_dir, "documents"))
    return with_query_files(rows, document_dimensions(), ["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


_DIGITS = " + ".join(f"((c_{name} >> {bit}) & 1) * {1 << (bit * 4 + 3 - k)}" for bit in range(3, -1, -1) for k, name in enumerate(("length", "source", "date", "lang")))

OP12_SQL = f"""
WITH v AS (
  SELECT doc_id, text, source, lang, CASE WHEN text IS NULL THEN -1 ELSE strlen(text) END AS length,
    {sql_crc32("doc_id::VARCHAR")} % 365 AS date
  FROM documents),
c AS (
  SELECT doc_id, text, {", ".join(f"(16 * (rank() OVER (ORDER BY {name} NULLS FIRST) - 1)) // count(*) OVER () AS c_{name}" for name in ("source", "lang", "length", "date"))} FROM v),
p AS (SELECT *, {_DIGITS} AS z FROM c),
q AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM p),
f AS (SELECT *, position // 500 AS file FROM q),
b AS (SELECT file, {", ".join(f"min(c_{name}) AS l_{name}, max(c_{name}) AS h_{name}" for name in ("source", "lang", "length", "date"))} FROM f GROUP BY file),
cells AS (SELECT DISTINCT c_source, c_lang, c_length, c_date FROM f),
touched AS (
  SELECT cells.*, count(*) AS files_touched FROM cells JOIN b ON c_source BETWEEN l_source AND h_source AND c_lang BETWEEN l_lang AND h_lang
    AND c_length + 2 >= l_length AND c_length - 2 <= h_length AND c_date + 2 >= l_date AND c_date - 2 <= h_date GROUP BY ALL),
matching AS (
  SELECT cells.*, count(DISTINCT o.file) AS files_matching FROM cells JOIN (SELECT DISTINCT file, c_source, c_lang, c_length, c_date FROM f) o
    ON o.c_source = cells.c_source AND o.c_lang = cells.c_lang AND abs(o.c_length - cells.c_length) <= 2 AND abs(o.c_date - cells.c_date) <= 2 GROUP BY ALL)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched::BIGINT AS files_touched, files_matching::BIGINT AS files_matching,
  concat_ws(',', l_source, h_source, l_lang, h_lang, l_length, h_length, l_date, h_date) AS file_bounds
FROM f JOIN b USING (file) JOIN touched USING (c_source, c_lang, c_length, c_date) JOIN matching USING (c_source, c_lang, c_length, c_date)
"""
