"""Extraction runs: every item fetched with retries and growing delays, every outcome a row; a recorded run adds its outcomes to the history."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.errors import CODES, GleanerError
from gleaner.functions.formatting import percent, rate_per_minute, seconds_left
from gleaner.operators.requests import backoff_delay
from gleaner.sources.scratch import stored
from gleaner.sources.page_files import write_pages
from gleaner.sources.sinks import append_history, read_history, video_markdown

#: Errors that another attempt cannot mend.
FINAL = ("not_found", "validation", "authentication", "invalid_video", "cancelled", "blank")


def extract_items(items: DataFrame, fetch: Callable[[object, int], str | None], max_retries: int = 3, base: float = 1.0, jitter: float | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """video_id, status, error, attempts, delay, file_size and transcript of each item; nothing throws.

    ``fetch(video_id, attempt)`` gives a text or raises; it and ``sleep`` run inside partitions. An error that another attempt
    cannot mend ends the item at once, others after ``max_retries`` more attempts with doubled delays between them.
    """
    if max_retries < 0 or base < 0:
        raise GleanerError("validation", "max_retries and base cannot be negative")

    def one(video_id) -> tuple:
        waited, code = 0.0, None
        for attempt in range(max_retries + 1):
            try:
                text = fetch(video_id, attempt)
                return ("completed", None, attempt + 1, waited, len((text or "").encode()), text) if text else ("failed", "blank", attempt + 1, waited, 0, None)
            except Exception as e:  # an item may fail in any way; its row says so
                code = e.code if isinstance(e, GleanerError) and e.code in CODES else "extraction_failed"
                if code in FINAL or attempt == max_retries:
                    return "failed", code, attempt + 1, waited, 0, None
                delay = backoff_delay(attempt, base, jitter=jitter)
                sleep(delay)
                waited += delay
        raise AssertionError("not reached")

    types = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.string())
    names = ["video_id", "status", "error", "attempts", "delay", "file_size", "transcript"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [one(v) for v in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    kind = items.schema["video_id"].dataType.simpleString()
    return items.select("video_id").mapInArrow(run, f"video_id {kind}, status string, error string, attempts int, delay double, file_size long, transcript string")


def run_extraction(items: DataFrame, history: DataFrame, fetch: Callable[[object, int], str | None], **options) -> DataFrame:
    """Results of all items: those that the history (video_id, status) has completed are ``skipped``, the others extracted."""
    done = history.where("status = 'completed'").select("video_id").distinct()
    fresh = extract_items(items.join(done, "video_id", "left_anti"), fetch, **options)
    held = items.join(done, "video_id", "left_semi").select("video_id", F.lit("skipped").alias("status"))
    return fresh.unionByName(held, allowMissingColumns=True)


def record_run(items: DataFrame, path: str, fetch: Callable[[object, int], str | None], at: str, **options) -> DataFrame:
    """Run what the history under ``path`` has not completed, fetch each item once, store the results and add them to the history under the time ``at``; skipped items are not added."""
    results = stored(run_extraction(items, read_history(items.sparkSession, path, items.schema["video_id"].dataType.simpleString()), fetch, **options))
    append_history(results.where("status != 'skipped'"), path, at)
    return results


def extract_pages(videos: DataFrame, root: str, history: str, fetch: Callable[[object, int], str | None], at: str, **options) -> DataFrame:
    """Videos that the history has not completed, fetched, rendered and written as a page each under ``root``; outcomes with path and size go to the history and come back.

    ``videos``: the columns of ``sinks.video_markdown`` but transcript and extracted. ``file_size`` is that of the page in bytes; a failed video has no page.
    """
    kind = videos.schema["video_id"].dataType.simpleString()
    results = stored(run_extraction(videos.select("video_id"), read_history(videos.sparkSession, history, kind), fetch, **options))
    ready = videos.join(results.where("status = 'completed'").select("video_id", "transcript"), "video_id").withColumn("extracted", F.lit(at))
    pages = stored(video_markdown(ready, "video_id"))
    write_pages(pages.select("path", "value"), root, mode="append")
    sized = pages.select("video_id", F.col("path").alias("output_path"), F.octet_length("value").cast("long").alias("page_size"))
    named = results.join(sized, "video_id", "left").join(videos.select("video_id", "title"), "video_id", "left")
    out = stored(named.withColumn("file_size", F.coalesce("page_size", "file_size")).drop("page_size", "transcript"))
    append_history(out.where("status != 'skipped'"), history, at)
    return out


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` (status) that are counted while they are written, by the job that writes them: completed, failed, skipped and total."""
    seen = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "skipped")]
    return results.observe(seen, F.count(F.lit(1)).alias("total"), *counts), seen


def progress(counts: DataFrame) -> DataFrame:
    """Adds progress in percent, rate per minute and seconds left to rows of (total, completed, failed, skipped, seconds)."""
    done = "(completed + failed + skipped)"
    out = counts.withColumn("progress", F.expr(percent(done, "total"))).withColumn("rate", F.expr(rate_per_minute(done, "seconds")))
    return out.withColumn("left", F.expr(seconds_left(f"(total - {done})", "rate")))
