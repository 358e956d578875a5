"""Running sums and ranks over groups of any size: ranges of rows, a sum in each, and what comes before each range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.operators.history import fresh
from gleaner.sources.scratch import stored


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value``, whole numbers, over the rows of the same ``group`` that come before by ``order``, which must tell rows of a group apart.

    Rows are dealt out in ranges of (group, order) and written once, so a group of any size lies over as many partitions as it fills. Each
    partition sums for itself; only the group that it begins with may have rows before it, so the sums to be added are one
    for each partition at most and are broadcast.
    """
    block = fresh(rows, "block")
    place = {c: rows.columns.index(c) for c in (group, value)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, begun = None, 0, False
        for b in batches:
            before = []
            for g, v in zip(b.column(place[group]).to_pylist(), b.column(place[value]).to_pylist(), strict=True):
                if not begun or g != last:
                    last, total, begun = g, 0, True
                before.append(total)
                total += v or 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], [*b.schema.names, out])

    keys = [group, *order]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(block, F.spark_partition_id().cast("long"))
    cut = stored(cut.mapInArrow(run, StructType([*cut.schema.fields, StructField(out, LongType())])))
    total, base = fresh(cut, "total"), fresh(cut, "base")
    sums = cut.groupBy(group, block).agg(F.sum(value).alias(total))  # a row for each group and partition that it is in
    earlier = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn(base, F.sum(total).over(earlier)).where(F.col(base) != 0).select(F.col(group).alias(f"{base}_g"), F.col(block).alias(f"{base}_b"), base)
    joined = cut.join(F.broadcast(bases), F.col(group).eqNullSafe(F.col(f"{base}_g")) & (F.col(block) == F.col(f"{base}_b")), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(base, F.lit(0))).drop(block, base, f"{base}_g", f"{base}_b")
