"""Readers: API responses, captions, transcript files, histories, caches and templates as DataFrames."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.formatting import human_duration, iso_date, iso_duration, safe_int, thousands
from gleaner.operators.validate import VIDEO_RULES, tagged

#: Fixed value: nested shape of an API item; counts arrive as strings.
VIDEO_ITEM = "id STRING, snippet STRUCT<title: STRING, description: STRING, publishedAt: STRING, channelId: STRING, channelTitle: STRING, thumbnails: STRUCT<maxresdefault: STRUCT<url: STRING>>, tags: ARRAY<STRING>, categoryId: STRING>, contentDetails STRUCT<duration: STRING>, statistics STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>"
CHANNEL_ITEM = "id STRING, snippet STRUCT<title: STRING, description: STRING, publishedAt: STRING, thumbnails: STRUCT<high: STRUCT<url: STRING>>, country: STRING, defaultLanguage: STRING>, statistics STRUCT<subscriberCount: STRING, videoCount: STRING>"
PAGE_MAX = 50


def json_array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of one array or object; a missing or broken file gives an empty table."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record STRING").json(path, multiLine=True, mode="PERMISSIVE").cache()
        return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _text(path: str, default: str = "") -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def parse_videos(items: DataFrame) -> DataFrame:
    """Flat video rows of API items (columns as VIDEO_ITEM); items without id or title are left out."""
    count = lambda c: F.expr(safe_int(f"statistics.{c}"))
    return items.where("id IS NOT NULL AND snippet.title IS NOT NULL").select(
        F.col("id").alias("video_id"),
        F.col("snippet.title").alias("title"),
        _text("snippet.description").alias("description"),
        F.expr(iso_duration("contentDetails.duration")).alias("duration_seconds"),
        F.expr(iso_date("snippet.publishedAt")).alias("upload_date"),
        count("viewCount").alias("view_count"),
        count("likeCount").alias("like_count"),
        count("commentCount").alias("comment_count"),
        _text("snippet.channelId").alias("channel_id"),
        _text("snippet.channelTitle").alias("channel_title"),
        _text("snippet.thumbnails.maxresdefault.url").alias("thumbnail_url"),
        F.coalesce("snippet.tags", F.array().cast("array<string>")).alias("tags"),
        _text("snippet.categoryId").alias("category"),
    )


def parse_channels(items: DataFrame) -> DataFrame:
    return items.where("id IS NOT NULL").select(
        F.col("id").alias("channel_id"),
        _text("snippet.title", "Unknown Channel").alias("channel_title"),
        _text("snippet.description").alias("description"),
        F.expr(iso_date("snippet.publishedAt")).alias("created_date"),
        _text("snippet.thumbnails.high.url").alias("thumbnail"),
        _text("snippet.country").alias("country"),
        _text("snippet.defaultLanguage").alias("default_language"),
        F.expr(safe_int("statistics.subscriberCount")).alias("subscriber_count"),
        F.expr(safe_int("statistics.videoCount")).alias("video_count"),
    )


def rejected_items(items: DataFrame) -> DataFrame:
    """API items that ``parse_videos`` leaves out, with what they lack."""
    marked = tagged(items, {"id": "id IS NULL", "title": "snippet.title IS NULL"})
    return marked.where(F.size("errors") > 0)


def channel_info(channels: DataFrame) -> DataFrame:
    """Channels as an info panel shows them: numbers with separators, the date's day, 200 characters of the description."""
    return channels.select(
        "channel_id",
        F.coalesce("channel_title", F.lit("Unknown")).alias("channel"),
        *(F.expr(thousands(f"coalesce({c}, 0)")).alias(n) for c, n in (("subscriber_count", "subscribers"), ("video_count", "videos"))),
        F.expr("coalesce(left(created_date, 10), 'Unknown')").alias("created"),
        F.expr("IF(length(description) > 200, concat(left(description, 200), '...'), coalesce(description, 'No description available'))").alias("description"),
    )


def published_between(videos: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Videos whose ``upload_date`` (year-month-day) is in the window, both ends included; a missing end is open."""
    for bound, keep in ((after, F.col("upload_date") >= after), (before, F.col("upload_date") <= before)):
        videos = videos.where(keep) if bound else videos
    return videos


def selection_summary(videos: DataFrame) -> DataFrame:
    """One row over (duration_seconds, view_count): how many, total seconds, total views and the time as a text; zeros for none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = videos.agg(F.count("*").alias("total_videos"), total("duration_seconds").alias("seconds"), total("view_count").alias("views"))
    return out.withColumn("formatted", F.expr(human_duration("seconds")))


def discover(search_ids: DataFrame, details: DataFrame, max_results: int | None = None, order: str = "relevance", after: str | None = None, before: str | None = None) -> DataFrame:
    """Search ids met by their details, in the order asked for, one page at most. ``search_ids``: video_id, relevance."""
    videos = published_between(details, after, before).join(search_ids.groupBy("video_id").agg(F.min("relevance").alias("relevance")), "video_id")
    by = {"relevance": F.asc("relevance"), "date": F.desc("upload_date"), "viewCount": F.desc("view_count")}[order]
    return videos.orderBy(by, "video_id").limit(min(max_results or PAGE_MAX, PAGE_MAX)).drop("relevance")


def resolve_channels(refs: DataFrame, channels: DataFrame, search: DataFrame | None = None) -> DataFrame:
    """``refs`` (type, id) with channel_id: ids pass through, names are looked up in ``channels`` (kind, name, channel_id).

    A name of type c that is not found there, be it as c or as handle, is the first hit of ``search`` (name, rank, channel_id).
    """
    kinds = channels.unionByName(channels.where("kind = 'handle'").withColumn("kind", F.lit("c")))
    names = kinds.groupBy(F.col("kind").alias("type"), F.col("name").alias("id")).agg(F.min("channel_id").alias("found"))
    out = refs.join(names, ["type", "id"], "left")
    if search is not None:
        first = search.groupBy(F.col("name").alias("id")).agg(F.min_by("channel_id", F.struct("rank", "channel_id")).alias("hit"))
        out = out.join(first, "id", "left").withColumn("found", F.when(F.col("type") == "c", F.coalesce("found", "hit")).otherwise(F.col("found"))).drop("hit")
    return out.select("type", "id", *(c for c in refs.columns if c not in ("type", "id")), F.when(F.col("type") == "channel_id", F.col("id")).otherwise(F.col("found")).alias("channel_id"))


def require_rows(df: DataFrame, error: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(error)
    return df


def fetch_misses(requests: DataFrame, stored: DataFrame, key: str = "request_key") -> DataFrame:
    """Requests whose answers are not stored yet."""
    return requests.join(stored.select(key), key, "left_anti")


def pick_captions(captions: DataFrame, languages: list[str], key: str = "video_id") -> DataFrame:
    """Per video the entries of the first preferred language it has. ``captions``: key, lang, start, duration, text."""
    ranked = captions.withColumn("_pos", F.array_position(F.lit(languages), F.col("lang"))).where("_pos > 0")
    best = ranked.groupBy(key).agg(F.min("_pos").alias("_pos"))
    return ranked.join(best, [key, "_pos"]).drop("_pos")


def transcripts(captions: DataFrame, key: str = "video_id", order: str = "start") -> DataFrame:
    """One row per video: entry texts in order, joined by line ends."""
    entry = F.struct(F.col(order).alias("o"), "text")
    return captions.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("es")).select(key, F.expr("array_join(transform(es, e -> e.text), '\n')").alias("transcript"))


def timed_entries(captions: DataFrame, key: str = "video_id") -> DataFrame:
    return captions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "duration", "text"))).alias("entries"))


def available_languages(captions: DataFrame, key: str = "video_id") -> DataFrame:
    """Language codes per video; generated ones are marked. ``captions``: key, lang, is_generated."""
    code = F.when(F.col("is_generated"), F.concat("lang", F.lit(" (auto)"))).otherwise(F.col("lang"))
    return captions.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("languages"))


def with_captions(videos: DataFrame, captions: DataFrame, languages: list[str], key: str = "video_id") -> DataFrame:
    return videos.join(captions.where(F.col("lang").isin(languages)), key, "left_semi")


def with_overrides(videos: DataFrame, info: DataFrame) -> DataFrame:
    """Description, duration and date of ``info`` (video_id, description, duration, upload_date) take precedence where present."""
    i = info.select("video_id", *(F.col(a).alias(f"_{b}") for a, b in (("description", "description"), ("duration", "duration_seconds"), ("upload_date", "upload_date"))))
    out = videos.join(i, "video_id", "left")
    for c in ("description", "duration_seconds", "upload_date"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem after its last underscore) and text: what follows the transcript heading of each markdown file, all of it where there is none."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/_]+)\.md$", 1).alias("doc_id"), "value")
    body = F.expr("IF(contains(value, '## Transcript'), split_part(value, '## Transcript', 2), value)")
    return files.select("doc_id", F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("text"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """version and template of every template file, versions in order."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"_(v[0-9.]+[0-9])\.md$", 1).alias("version"), F.col("value").alias("template")).orderBy("version")


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings of a JSON file, as they stand there; ``defaults`` only if there is no file, nothing if it holds no JSON object."""
    try:
        value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return dict(defaults)
    except (ValueError, TypeError):
        return {}
    return value if isinstance(value, dict) else {}


def label_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file of cached labels keyed ``video:unit`` as a table with two key columns."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<type:string,name:string,summary:string,confidence:double,normalizer_sig:string>>")).alias("k", "v"))
    return raw.select(F.split_part("k", F.lit(":"), F.lit(1)).alias("video_id"), F.expr("substr(k, instr(k, ':') + 1)").alias("unit_id"), "v.*")


def invalid_videos(videos: DataFrame) -> DataFrame:
    """Rows that lack a required field or whose duration is no whole number, with what is wrong."""
    return tagged(videos, VIDEO_RULES, "problem").withColumn("problem", F.array_join("problem", ",")).where("problem != ''")
