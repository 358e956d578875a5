"""Extraction history: statistics, recency, what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.formatting import file_size

HISTORY_CAP = 1000


def stats(history: DataFrame) -> DataFrame:
    """One row over (success, file_size): totals, bytes of the successes and the rate in percent."""
    total, good = F.count("*"), F.count_if("success")
    return history.agg(total.alias("total"), good.alias("successes"), (total - good).alias("failures"), F.coalesce(F.sum(F.when(F.col("success"), F.col("file_size"))), F.lit(0)).alias("total_bytes"), F.expr("IF(count(*) = 0, 0.0D, count_if(success) * 100.0D / count(*))").alias("success_rate"))


def recent(history: DataFrame, limit: int | None = None, order: str = "seq") -> DataFrame:
    """Newest first; no limit (None or 0) gives what the history keeps, the last 1,000."""
    return history.orderBy(F.desc(order)).limit(min(limit, HISTORY_CAP) if limit else HISTORY_CAP)


def status_lines(history: DataFrame, limit: int = 20, order: str = "seq") -> DataFrame:
    """The newest entries as a status list shows them: video, status, size and date, over (video_id, title, status, file_size, timestamp)."""
    return recent(history, limit, order).select(
        order,
        F.coalesce("title", F.col("video_id").cast("string"), F.lit("Unknown")).alias("video"),
        F.expr("IF(status = 'completed', 'Success', 'Failed')").alias("status"),
        F.expr(f"IF(coalesce(file_size, 0) = 0, '-', {file_size('file_size')})").alias("size"),
        F.expr("coalesce(nullif(replace(left(timestamp, 16), 'T', ' '), ''), 'Unknown')").alias("date"),
    )


def pending(items: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Items that no run has completed."""
    return items.join(history.where("status = 'completed'").select(key), key, "left_anti")


def by_status(items: DataFrame, history: DataFrame, key: str) -> DataFrame:
    done = history.where("status = 'completed'").select(key).distinct().withColumn("_done", F.lit(True))
    return items.join(done, key, "left").withColumn("group", F.when(F.col("_done"), "extracted").otherwise("new")).drop("_done")


def with_titles(results: DataFrame, items: DataFrame, key: str = "video_id") -> DataFrame:
    """Each result with its item's title, the id where there is none; of items that share an id the first by title counts."""
    one = items.groupBy(key).agg(F.min("title").alias("title"))
    return results.join(one, key, "left").withColumn("title", F.coalesce(F.expr("nullif(title, '')"), F.col(key).cast("string")))


def run_counters(results: DataFrame, total: int | None = None) -> DataFrame:
    """One row over (video_id, status, error): counters and progress in percent; ``failures`` has a row for each failure."""
    n = F.lit(total) if total is not None else F.count("*")
    done = F.count_if(F.col("status").isin("completed", "failed", "skipped"))
    return results.agg(
        n.cast("long").alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "skipped")),
        F.when(n == 0, 100.0).otherwise(done * 100.0 / n).alias("progress"),
    )


def failures(results: DataFrame) -> DataFrame:
    """video_id and error of each failed result."""
    return results.where("status = 'failed'").select("video_id", "error")


def fresh(table: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of the table has it."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def latest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; of equally new ones the one with the smallest hash of all its columns."""
    rn = fresh(table, "rn")
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*(F.col(f"`{c}`") for c in table.columns)))
    return table.withColumn(rn, F.row_number().over(newest)).where(f"{rn} = 1").drop(rn)
