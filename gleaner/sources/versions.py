"""A keyed table under a folder, changed by whole versions: an upsert rewrites the key buckets that it touches and then names the new version.

Rows lie in folders by the hash of their keys. A version is a small file that lists the folder of each bucket; it is made last, so a
reader sees the old rows or the new ones, and an upsert that breaks off leaves the old version in place. Two writers cannot both make the same version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.operators.history import fresh
from gleaner.sources.sinks import upsert

BUCKETS = 64


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content (buckets, folders by bucket) of the last whole version; 0 if there is none."""
    path, files = _path(spark, f"{root}/_versions")
    names = sorted((s.getPath().getName() for s in files.listStatus(path)), reverse=True) if files.exists(path) else []
    for name in names:
        try:
            return int(name.split(".")[0]), json.loads(spark.read.text(f"{root}/_versions/{name}", wholetext=True).first()[0])
        except (ValueError, TypeError):  # its writer broke off
            continue
    return 0, {"buckets": BUCKETS, "folders": {}}


def read_table(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the last version; none if there is no table."""
    folders = current(spark, root)[1]["folders"].values()
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def upsert_table(new: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Put ``new`` rows in place of those with the same keys, of several new ones with the same keys one by the rule of ``history.latest``; the number of the version made.

    ``buckets`` counts for a new table only; a bucket should fit a task.
    """
    spark, columns = new.sparkSession, new.columns
    number, version = current(spark, root)
    n = version["buckets"] if number else buckets
    bucket = fresh(new, "bucket")
    place = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in new.select(place).distinct().collect())  # as many as buckets at most
    held = [version["folders"][str(b)] for b in touched if str(b) in version["folders"]]
    old = spark.read.schema(new.schema).parquet(*(f"{root}/{f}" for f in held)) if held else new.limit(0)
    data = f"data/{uuid.uuid4().hex}"
    merged = upsert(old, new, keys).select(*(F.col(f"`{c}`") for c in columns)).withColumn(bucket, place)
    merged.repartition(bucket).write.partitionBy(bucket).parquet(f"{root}/{data}")
    folders = version["folders"] | {str(b): f"{data}/{bucket}={b}" for b in touched}
    publish(spark, root, number + 1, {"buckets": n, "folders": folders})
    return number + 1


def publish(spark: SparkSession, root: str, number: int, version: dict) -> None:
    path, files = _path(spark, f"{root}/_versions/{number:012d}.json")
    try:
        out = files.create(path, False)
    except Exception as e:
        raise GleanerError("validation", f"version {number} of {root} was made by another writer") from e
    out.write(json.dumps(version).encode())
    out.close()
