"""Rules in one pass: every row with the names of the rules that it breaks, good and rejected rows written by one job that counts them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators.history import fresh

#: What a video must have: the rule's name and when a row breaks it.
VIDEO_RULES = {
    "video_id": "video_id IS NULL OR CAST(video_id AS STRING) = ''",
    "title": "title IS NULL",
    "duration_seconds": "duration_seconds IS NULL OR NOT CAST(duration_seconds AS STRING) RLIKE '^[+-]?[0-9]+$'",
    "upload_date": "upload_date IS NULL",
}


def tagged(rows: DataFrame, rules: dict[str, str], column: str = "errors") -> DataFrame:
    """Adds the names of the rules that a row breaks, in the rules' order. A rule that is null for a row is broken."""
    broken = F.array(*(F.when(F.coalesce(F.expr(f"({r})"), F.lit(True)), F.lit(n)) for n, r in rules.items()))
    return rows.withColumn(column, F.array_compact(broken) if rules else F.array().cast("array<string>"))


@dataclass(frozen=True)
class Checked:
    """``good`` rows as they came, ``rejects`` with ``errors``, and how many rows there were, were good and broke each rule."""

    good: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def check_rows(rows: DataFrame, rules: dict[str, str], path: str) -> Checked:
    """Write good rows and rejects under ``path`` in one job, which also counts; a row that breaks several rules is one reject and counts for each of them."""
    spark, accepted, errors = rows.sparkSession, fresh(rows, "accepted"), fresh(rows, "errors")
    seen = Observation()
    marked = tagged(rows, rules, errors)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size(errors) == 0).alias("good"), *(F.count_if(F.array_contains(errors, n)).alias(f"broke_{n}") for n in rules)]
    marked.withColumn(accepted, F.size(errors) == 0).observe(seen, *counts).write.partitionBy(accepted).parquet(path)
    found = seen.get

    def part(value: str) -> DataFrame:
        n = found["good"] if value == "true" else found["rows"] - found["good"]
        return spark.read.schema(marked.schema).parquet(f"{path}/{accepted}={value}") if n else marked.limit(0)

    rejects = part("false")
    return Checked(part("true").drop(errors), rejects.withColumnRenamed(errors, "errors") if "errors" not in rows.columns else rejects, dict(found))
