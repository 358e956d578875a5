"""Writers: records, video pages, caches, analyses and the knowledge base. Spark's committers write; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.formatting import clock, thousands
from gleaner.operators import synthesis
from gleaner.operators.history import fresh, latest
from gleaner.sources.page_files import write_pages


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# The page's layout, its headings and labels.
def video_markdown(videos: DataFrame, *kept: str) -> DataFrame:
    """path and value: the page of each video, after the columns ``kept``. ``videos``: video columns, transcript and extracted (a time as text)."""
    value = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "title"),
        F.lit(""),
        F.concat(F.lit("**Video ID:** "), "video_id"),
        F.concat(F.lit("**Channel:** "), "channel_title"),
        F.concat(F.lit("**Upload Date:** "), "upload_date"),
        F.concat(F.lit("**Duration:** "), F.expr(f"IF(coalesce(duration_seconds, 0) = 0, 'Unknown', {clock('duration_seconds')})")),
        F.concat(F.lit("**Views:** "), F.expr(thousands("view_count")), F.lit(" views")),
        F.concat(F.lit("**Extracted:** "), "extracted"),
        F.lit("\n## Description\n"),
        F.col("description"),
        F.lit("\n## Video Information\n"),
        F.concat(F.lit("- **Channel ID:** "), "channel_id"),
        F.concat(F.lit("- **Like Count:** "), F.expr(thousands("like_count"))),
        F.concat(F.lit("- **Comment Count:** "), F.expr(thousands("comment_count"))),
        F.lit("\n## Tags\n"),
        F.expr("IF(coalesce(size(tags), 0) > 0, array_join(tags, ', '), 'No tags available')"),
        F.lit("\n## Transcript\n"),
        F.expr("coalesce(nullif(transcript, ''), 'No transcript available for this video')"),
        F.lit("\n---\n"),
    )
    return videos.select(*kept, F.concat("channel_title", F.lit("/transcripts/"), "video_id", F.lit(".md")).alias("path"), value.alias("value"))


#: Columns of a history beside video_id.
HISTORY = {"timestamp": "string", "success": "boolean", "output_path": "string", "error": "string", "file_size": "bigint", "title": "string", "status": "string"}


def append_history(results: DataFrame, path: str, at: str | None = None) -> None:
    """Add ``results`` to the history: video_id and ``success`` or ``status``, of which one follows from the other, and any other columns of HISTORY.

    Missing ones are null, the title empty, the time ``at``. Other columns are left out.
    """
    known = results
    if "success" not in known.columns:
        known = known.withColumn("success", F.col("status") == "completed")
    known = known.withColumn("status", F.when(F.col("success"), "completed").otherwise("failed"))
    default = {"timestamp": F.lit(at), "title": F.lit("")}
    columns = [(F.col(c) if c in known.columns else default.get(c, F.lit(None))).cast(t).alias(c) for c, t in HISTORY.items()]
    known.select("video_id", *columns).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """The history under ``path``; empty if there is none yet."""
    schema = ", ".join(f"{c} {t}" for c, t in ({"video_id": id_type} | HISTORY).items())
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables, new rows in place of old ones with the same keys; write the result beside the old table, then swap."""
    mark = fresh(old, "new")
    both = old.withColumn(mark, F.lit(0)).unionByName(new.withColumn(mark, F.lit(1)))
    return latest(both, keys, mark).drop(mark)


def write_analyses(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("video_id").json(path)


def write_knowledge_base(synthesized: DataFrame, path: str) -> None:
    """Under one layout a file for each unit in the folder of its type; index by type, units and statistics as JSON."""
    write_pages(synthesis.unit_markdown(synthesized), path)
    synthesis.index_lines(synthesized).orderBy("type", "name", "id").write.mode("overwrite").json(f"{path}/index")
    synthesis.headings(synthesized).write.mode("overwrite").json(f"{path}/headings")
    synthesis.totals(synthesized).write.mode("overwrite").json(f"{path}/totals")
    synthesis.videos(synthesized).write.mode("overwrite").json(f"{path}/videos")
    synthesis.metadata(synthesized).write.mode("overwrite").json(f"{path}/units")
    synthesis.stats(synthesized).write.mode("overwrite").json(f"{path}/synthesis")


def channel_paths(channels: DataFrame, root: str = "channels") -> DataFrame:
    """Folders of each channel by kind of content."""
    return channels.select("name", *(F.concat_ws("/", F.lit(root), "name", F.lit(k)).alias(k.replace("-", "_")) for k in ("transcripts", "analyses", "knowledge-base")))
