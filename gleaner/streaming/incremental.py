"""Incremental runs: new transcript files are extracted once, whatever is restarted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.extract import ExtractOptions, extract_units

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def extract_batch(batch: DataFrame, batch_id: int, out: str, opts: ExtractOptions) -> None:
    """Units and outcomes of a batch's documents (doc_id, text, blank); a batch that is run again replaces its own files, so nothing is doubled."""
    extract_units(batch.where("NOT blank"), opts).write.mode("overwrite").parquet(f"{out}/units/batch_id={batch_id}")
    status = F.when(F.col("blank"), "failed").otherwise("completed")
    batch.select("doc_id", status.alias("status"), F.length("text").alias("size")).write.mode("overwrite").parquet(f"{out}/history/batch_id={batch_id}")


def first_seen(docs: DataFrame) -> DataFrame:
    """Each document's first text that is not blank, and its first blank one: a blank document may still be completed later, a completed one is not done again.

    The ids seen are keyed state in the state store, so a batch costs what is in it and not what came before.
    """
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    return docs.withColumn("blank", blank).dropDuplicates(["doc_id", "blank"])


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """doc_id and status of all documents so far: completed if any text of it was, else failed."""
    return spark.read.parquet(f"{out}/history").groupBy("doc_id").agg(F.min("status").alias("status"))


def start(spark: SparkSession, source: str, out: str, checkpoint: str, opts: ExtractOptions = ExtractOptions(), available_now: bool = True):
    """Stream the Parquet files (doc_id, text) of a folder through the extractor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # state on disk, not in the heap
    stream = first_seen(spark.readStream.schema("doc_id long, text string").parquet(source))
    writer = stream.writeStream.foreachBatch(lambda b, i: extract_batch(b, i, out, opts)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
