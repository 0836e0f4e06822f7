"""Ordered slices: a total order over a table of any size, worked off slice by slice.

Rows are dealt by ranges of the *whole* order, so the rows of one hot key spread over as many
slices as they need.  What an order asks of a row (its number, the row before it, the sum so far)
is then found in two levels: inside the slice, and from one row per slice (and key) that carries
what came before it.  The slices are a written table, so every reader, and a task that runs
again, sees the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chainlens.session import written

SLICE, PLACE = "_slice", "_place"


def _sliced(df: DataFrame, *order: str) -> DataFrame:
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return at.select(*df.columns, F.shiftright("_at", 33).cast("int").alias(SLICE), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE))


def in_slices(df: DataFrame, *order: str, name: str = "slices") -> DataFrame:
    """``df`` in ``order``, with the number of a row's slice and its place there (from 0)."""
    return written(df.sparkSession, _sliced(df, *order), name)


def numbered(df: DataFrame, order: list[str], number: str, after: int | Column = 0) -> DataFrame:
    """``df`` with dense numbers in ``order``, the first one ``after`` + 1.

    Where ``order`` tells all rows apart, a rerun gives the same numbers.  The driver sees one count
    per slice.
    """
    x = in_slices(df, *order, name="numbered")
    before, rows = 0, []
    for r in x.groupBy(SLICE).count().orderBy(SLICE).collect():
        rows.append((r[SLICE], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, f"{SLICE} int, _before long")
    after = after if isinstance(after, Column) else F.lit(after)
    return x.join(offsets, SLICE).select((after + F.col("_before") + F.col(PLACE) + 1).cast("bigint").alias(number), *df.columns)


def _carried(x: DataFrame, key: str, per_slice: Column, carry) -> DataFrame:
    """(key, slice, carried): ``carry`` of ``per_slice`` over the key's earlier slices."""
    ends = x.groupBy(key, SLICE).agg(per_slice.alias("_end"))
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)   # a row per slice
    return ends.select(F.col(key).alias("_key"), F.col(SLICE).alias("_of"), carry(F.col("_end")).over(earlier).alias("_carried"))


def _with_carried(x: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    return x.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col(SLICE) == F.col("_of"))).drop("_key", "_of")


def previous(x: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """``x`` (from :func:`in_slices`, ordered by ``key`` first) with the ``column`` of the key's row before, or NULL."""
    inside = Window.partitionBy(SLICE, key).orderBy(PLACE)
    # the nearest earlier slice of the key has its row before
    ends = _carried(x, key, F.max_by(F.struct(column), PLACE), lambda e: F.last(e))
    y = _with_carried(x.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(column).over(inside)), ends, key)
    return y.withColumn(out, F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_carried").getField(column))).drop(
        "_n", "_lag", "_carried")


def _summed(batches, key: str):
    """The batches of a slice with ``_sum``, the sum of ``_value`` over the key's earlier rows there."""
    last, total = None, 0        # the last row's key, as an array of one, and its sum so far
    for b in batches:
        if not b.num_rows:
            continue
        keys, value = b.column(key), b.column("_value").to_numpy()
        code = keys.dictionary_encode("encode").indices.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        before = np.cumsum(value) - value
        base = before[start]
        if last is not None and last.equals(keys.slice(0, 1)):
            base[0] -= total
        before -= np.repeat(base, np.diff(np.append(start, len(code))))
        last, total = keys.slice(len(code) - 1, 1), int(before[-1] + value[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], [*b.schema.names, "_sum"])


def in_slices_summed(df: DataFrame, value: Column, out: str, *order: str, name: str = "slices") -> DataFrame:
    """:func:`in_slices` with :func:`sum_before` of ``value`` by the first column of ``order``.

    The sums inside a slice are taken as it is written, so the rows are dealt once."""
    key = order[0]
    rows = _sliced(df.withColumn("_value", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))), *order)
    schema = StructType([*rows.schema.fields, StructField("_sum", LongType())])
    x = written(df.sparkSession, rows.mapInArrow(lambda batches: _summed(batches, key), schema), name)
    # a row per slice and key, as a table: its size is known, so a small one is sent to the rows
    ends = written(df.sparkSession, _carried(x, key, F.sum("_value"), F.sum), f"{name}-ends")
    return _with_carried(x, ends, key).withColumn(out, F.coalesce("_carried", F.lit(0)) + F.col("_sum")).drop("_value", "_sum", "_carried")


def sum_before(x: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``x`` (as above) with the sum of ``value`` over the key's earlier rows, 0 for its first."""
    inside = Window.partitionBy(SLICE, key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_value", value.cast("bigint"))
    y = _with_carried(x.withColumn("_sum", F.sum("_value").over(inside)), _carried(x, key, F.sum("_value"), F.sum), key)
    return y.withColumn(out, F.coalesce("_carried", F.lit(0)) + F.coalesce("_sum", F.lit(0))).drop("_value", "_sum", "_carried")
