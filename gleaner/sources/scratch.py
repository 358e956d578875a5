"""Tables that cut the lineage: written as Parquet into a folder that all machines share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``; only a session of one process may leave that setting out and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gleaner.scratch.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.gleaner.scratch.dir", root)
    return f"{root.rstrip('/')}/gleaner/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once and read back: what it computes, a paid call among it, is done once however often the result is used, and outlives executors."""
    path = path or folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` gave; nothing derived from it may be read afterwards."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
