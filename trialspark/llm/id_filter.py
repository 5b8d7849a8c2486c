"""A bit table of fixed size over ids, to keep rows out of a shuffle that cannot be meant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 23


def bit_of(column: str | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame):
    """The broadcast table of ``FILTER_BITS`` bits that has the bit of every value of the one column of ``ids``."""
    bit = ids.select((bit_of(ids.columns[0]) + 1).alias("b"))  # the bitmap functions count from 1
    rows = bit.groupBy(F.expr("bitmap_bucket_number(b)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r.n - 1) * 4096
        table[at:at + 4096] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(table)


def with_bit(batches, column: int, table, there: bool):
    """The rows whose bit number in ``column`` is in the table, or is not."""
    for batch in batches:
        bit = batch.column(column).to_numpy()
        yield batch.filter(pa.array((table.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool) == there))


def split(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as columns ``c0``..: rows whose ``key`` is surely not in ``ids``, and the others, by two scans and no shuffle."""
    n, schema = len(df.columns), df.toDF(*(f"c{i}" for i in range(len(df.columns)))).schema
    own = df.toDF(*schema.names)
    at = f"c{df.columns.index(key)}"
    own = own.withColumn("b", bit_of(F.col(at).cast(ids.schema[0].dataType)))
    table = id_filter(ids)
    return tuple(own.mapInArrow(lambda batches, there=there: (b.select(range(n)) for b in with_bit(batches, n, table, there)), schema) for there in (False, True))
