"""Places of rows in a global order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources import scratch

#: Bits of monotonically_increasing_id that count the rows of a range.
RANGE_BITS = 33


def numbered(df: DataFrame, *order: str, out: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds the place of each row, from 0, in the order of columns that together tell rows apart.

    ``sums`` names further columns, each the sum of another of whole numbers over the rows before.
    Rows are dealt to ranges of the order; a range is numbered on its own, as its rows
    are sorted and before they are stored, and begins where those before it end. Only a
    row for each range is moved to one task, and no row a second time.
    """
    sums = sums or {}
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())  # the range in the upper bits, the row in the lower ones

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = dict.fromkeys(sums, 0)
        for b in batches:
            cols = list(b.columns)
            for k, c in sums.items():
                each = b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(each)
                cols.append(pa.array(total - each + upto[k]))
                upto[k] += int(each.sum())
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *sums])

    if sums:
        schema = StructType([*dealt.schema, *[StructField(k, LongType()) for k in sums]])
        dealt = dealt.mapInArrow(running, schema)
    dealt = scratch.keep(dealt, "ranges", 10_000)
    range_ = F.shiftright("_at", RANGE_BITS).alias("_range")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(range_).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_n_{k}") for k, c in sums.items()])
    begins = totals.select("_range", *[F.coalesce(F.sum(f"_n{x}").over(before), F.lit(0)).alias(f"_begin{x}") for x in ("", *[f"_{k}" for k in sums])])
    placed = dealt.withColumn("_range", range_).join(F.broadcast(begins), "_range")
    placed = placed.withColumn(out, (F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << RANGE_BITS) - 1))).cast("long"))
    for k in sums:
        placed = placed.withColumn(k, F.col(f"_begin_{k}") + F.col(k))
    return placed.select(*df.columns, out, *sums)


def carried(df: DataFrame, key: str, order: str, values: dict[str, str]) -> DataFrame:
    """Adds, by name, the last value of a column before the row within its key, nulls passed over.

    Rows are dealt to ranges of (key, order), so that a key with very many rows is
    worked on by many tasks. What a range begins with is made from a row for each
    range and key.
    """
    dealt = scratch.keep(df.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()), "ranges")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    ends = dealt.groupBy(key, "_range").agg(*[last(c).alias(f"_last_{k}") for k, c in values.items()])
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = ends.select(key, "_range", *[F.last(f"_last_{k}", ignorenulls=True).over(before).alias(f"_from_{k}") for k in values])
    own = W.partitionBy("_range", key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.select("*", *[F.last(c, ignorenulls=True).over(own).alias(k) for k, c in values.items()])
    out = inner.join(begins.withColumnRenamed(key, "_key"), (F.col(key).eqNullSafe(F.col("_key"))) & (inner["_range"] == begins["_range"]), "left")
    return out.select(*df.columns, *[F.coalesce(k, f"_from_{k}").alias(k) for k in values])
