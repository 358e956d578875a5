"""Shared helpers of the llm operators: inputs, scratch tables, Arrow columns."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by ``written`` in this process, in order.
_FOLDERS: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which all machines share.

    Only a session whose driver and executors are one process may leave that setting out: a temporary folder is then set once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gleaner.scratch.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.gleaner.scratch.dir", root)
    return f"{root.rstrip('/')}/gleaner/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared scratch folder and read it back.

    The files survive the loss of executors, unlike cached blocks; ``release`` deletes them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    _FOLDERS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the folder of a table that ``written`` gave; neither it nor what is derived from it may be read again."""
    release(table.sparkSession, _FOLDERS.index(table.scratch), _FOLDERS.index(table.scratch) + 1)


def tidy(spark: SparkSession) -> None:
    """Shuffle files of DataFrames that the driver no longer refers to are deleted on all machines, as its collector finds them. It takes a while on a large heap."""
    spark.sparkContext._jvm.System.gc()


def folders() -> int:
    """How many scratch folders there are; a mark for ``release``."""
    return len(_FOLDERS)


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the scratch folders numbered ``first`` up to ``last``. No DataFrame that reads them may be used afterwards."""
    jvm = spark.sparkContext._jvm
    for i in range(first, len(_FOLDERS) if last is None else last):
        if _FOLDERS[i]:
            path = jvm.org.apache.hadoop.fs.Path(_FOLDERS[i])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _FOLDERS[i] = ""


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_rows(df: DataFrame, limit_bytes: int = 64 << 20) -> list | None:
    """Rows of ``df`` if their text size is at most ``limit_bytes``, measured before anything is collected; else None."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(16) for c in df.columns), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return df.collect() if size <= limit_bytes else None


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def offsets_of(counts) -> np.ndarray:
    """int64 offsets 0, c0, c0+c1, ..."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20, max_rows: int = 4096):
    """Cut a batch into zero-copy pieces of bounded text size (a single longer row is one piece)."""
    col = batch.column(batch.schema.get_field_index(column))
    n = batch.num_rows
    if not n:
        return
    size = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    start, acc = 0, 0
    for i in range(n):
        if i > start and (acc + size[i] > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, acc = i, 0
        acc += size[i]
    yield batch.slice(start, n - start)


class Ranges:
    """Ranges of (id, tie) in ascending order, with about as many rows each; a null id counts as the lowest.

    An id so frequent that it spans several ranges is split among them by its tie, a hash spread over all 64-bit numbers.
    """

    LOWEST = -(1 << 63)

    def __init__(self, bounds):
        self.bounds = np.array(sorted(bounds), np.int64)

    @classmethod
    def over(cls, rows: DataFrame, id_col: str, n: int) -> Ranges:
        """``n`` ranges of a whole-number column, in one pass; the driver gets n - 1 numbers."""
        if n < 2:
            return cls([])
        key = F.coalesce(F.col(f"`{id_col}`"), F.lit(cls.LOWEST))
        return cls(rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or [])

    def of(self, ids: pa.Array, ties: pa.Array) -> np.ndarray:
        known = ids.fill_null(self.LOWEST).to_numpy(zero_copy_only=False)
        first, last = np.searchsorted(self.bounds, known, "left"), np.searchsorted(self.bounds, known, "right")
        share = (ties.to_numpy(zero_copy_only=False).astype(np.float64) + 2.0**63) / 2.0**64
        within = np.minimum((share * (last - first)).astype(np.int64), last - first - 1)
        return np.where(last > first, first + 1 + within, first)
