"""Places, running sums and maxima of rows within their keys, without bringing a key's rows into one task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

#: Parts that a key's rows are dealt in where they meet what belongs to the key.
SALTS = 16
LEAST = -(1 << 62)  # less than any value


def running(df: DataFrame, keys: list[str], order: list[str], keep: Callable[[DataFrame], DataFrame], scans: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a long column for each scan: name to (sum, max or lag; a column of whole numbers), over the rows of equal keys in the order of the columns order, each row included; lag is the value of the row before.

    Nulls count as 0 in a sum and are left out of a maximum. Equal rows take neighbouring places in any order.

    Rows are sorted by ranges of keys and order, so a key of most rows is in many ranges, and scanned within their range. Only rows of a range's first key may have others before it; what these come to follows from the ends of
    the ranges: one row for each range, which is all that the driver sees and that is broadcast. keep writes a table and reads it back.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    values = {f"__v_{out}": F.coalesce(F.col(c).cast("long"), F.lit({"sum": 0, "max": LEAST}[op]).cast("long")) if op != "lag" else F.coalesce(F.col(c).cast("long"), F.lit(LEAST).cast("long")) for out, (op, c) in scans.items()}
    rows = df.withColumns({**values, "__any": F.monotonically_increasing_id()})  # the last lets a range end among equal rows
    rows = rows.repartitionByRange(ranges, *columns, "__any").sortWithinPartitions(*columns, "__any").drop("__any")
    rows = rows.withColumn("__part", F.spark_partition_id()).withColumn("__key", F.xxhash64(*keys))
    longs = [f"__s_{out}" for out in scans]
    schema = T.StructType([*rows.schema.fields, T.StructField("__n", T.LongType()), T.StructField("__first", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n = None, None, 0  # the range's first key, the key of the last row, and the rows so far
        ended: dict[str, int] = {}  # what each scan, and each value, came to at the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__key").to_numpy()
            group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            goes_on = (group == 0) & (key[0] == last)
            first = key[0] if first is None else first
            found = []
            for out, (op, _) in scans.items():
                v = pd.Series(batch.column(f"__v_{out}").to_numpy())
                by = v.groupby(group)
                if op == "sum":
                    s = by.cumsum().to_numpy() + (np.where(goes_on, ended[out], 0) if n else 0)
                elif op == "max":
                    s = by.cummax().to_numpy()
                    s = np.maximum(s, np.where(goes_on, ended[out], LEAST)) if n else s
                else:
                    s = by.shift(1, fill_value=LEAST).to_numpy()
                    s[0] = ended[out] if n and goes_on[0] else LEAST
                ended[out] = int(v.iloc[-1] if op == "lag" else s[-1])
                found.append(pa.array(s, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + len(key))), pa.array(key == first), *found], names=schema.names)
            last, n = key[-1], n + len(key)

    rows = keep(rows.mapInArrow(scan, schema))
    kept_end = [F.col(f"__v_{out}" if op == "lag" else f"__s_{out}").alias(f"e{k}") for k, (out, (op, _)) in enumerate(scans.items())]
    ends = rows.groupBy("__part").agg(F.min_by("__key", "__n").alias("first"), F.max_by(F.struct("__key", *kept_end), "__n").alias("last"))
    none = {"sum": 0, "max": LEAST, "lag": LEAST}
    open_key: Any = None
    carried = [none[op] for op, _ in scans.values()]
    offsets = []
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        entry = carried if r["first"] == open_key else [none[op] for op, _ in scans.values()]
        offsets.append((r["__part"], *entry))
        alone = r["last"]["__key"] == r["first"]
        carried = [e if op == "lag" or not alone else e + c if op == "sum" else max(e, c) for (op, _), e, c in zip(scans.values(), r["last"][1:], entry, strict=True)]
        open_key = r["last"]["__key"]
    before = F.broadcast(spark.createDataFrame(offsets, ", ".join(["__part int", *[f"__c_{out} long" for out in scans]])))
    made = []
    for out, (op, _) in scans.items():
        own, carry = F.col(f"__s_{out}"), F.col(f"__c_{out}")
        whole = {"sum": own + carry, "max": F.greatest(own, carry), "lag": F.when(F.col("__n") == 0, carry).otherwise(own)}[op]
        value = F.when(F.col("__first"), whole).otherwise(own)
        made.append((value if op == "sum" else F.nullif(value, F.lit(LEAST).cast("long"))).alias(out))
    return rows.join(before, "__part").select(*df.columns, *made)


def numbered(df: DataFrame, keys: list[str], order: list[str], keep: Callable[[DataFrame], DataFrame], name: str = "pos") -> DataFrame:
    """df with name (long): the row's place, from 0, among those of equal keys, in the order of the columns order; equal rows take neighbouring places."""
    counted = running(df.withColumn("__one", F.lit(1)), keys, order, keep, {name: ("sum", "__one")})
    return counted.withColumn(name, F.col(name) - 1).drop("__one")
