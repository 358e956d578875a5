"""Runs compared: hashes of a document's units, how often they agree, and what a prior analysis had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_hashes(units: DataFrame, columns: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """doc_id, n_units and units_hash: SHA-256 over the units' columns, tab between columns and a line a unit, sorted. A document's units are few."""
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))
    lines = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_units"), F.sha2(F.array_join("lines", "\n"), 256).alias("units_hash"))


LANE = 15  # hexadecimal digits, 60 bits
LANES = 4


def multiset_hashes(units: DataFrame, columns: tuple[str, ...] = ("id", "text"), key: str = "doc_id") -> DataFrame:
    """``key``, n_units and units_hash: the sums, in four lanes of 60 bits, of the SHA-256 of each unit's line, as in ``unit_hashes``.

    Equal multisets of units have equal hashes whatever their order and partitions, and partial sums merge, so that a document's units never
    meet in one row. Not proof against units made up to cancel out.
    """
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))
    digest = units.select(key, F.sha2(line, 256).alias("h"))
    lane = lambda i: F.conv(F.substring("h", LANE * i + 1, LANE), 16, 10).cast("decimal(38,0)")
    sums = digest.groupBy(key).agg(F.count("*").alias("n_units"), *(F.sum(lane(i)).alias(f"s{i}") for i in range(LANES)))
    parts = [F.lower(F.lpad(F.hex((F.col(f"s{i}") % (1 << 4 * LANE)).cast("long")), LANE, "0")) for i in range(LANES)]
    return sums.select(key, "n_units", F.concat(*parts).alias("units_hash"))


def determinism(runs: DataFrame) -> DataFrame:
    """doc_id, runs and distinct hashes of (doc_id, units_hash) over several runs; ``deterministic`` where there is one."""
    out = runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.count_distinct("units_hash").alias("hashes"))
    return out.withColumn("deterministic", F.col("hashes") == 1)


def determinism_rate(judged: DataFrame) -> DataFrame:
    """One row: documents, and the percentage of them that are deterministic."""
    return judged.agg(F.count("*").alias("documents"), F.round(F.avg(F.col("deterministic").cast("int")) * 100, 6).alias("rate"))


def averages(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """One row for each group: how many, and the mean of each value."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def against_prior(units: DataFrame, prior: DataFrame) -> DataFrame:
    """Each document's units against those of a prior analysis, if it had one: n_units, n_prior (null: none), n_shared by id."""
    now = units.groupBy("doc_id").agg(F.count("*").alias("n_units"))
    then = prior.groupBy("doc_id").agg(F.count("*").alias("n_prior"))
    shared = units.select("doc_id", "id").distinct().join(prior.select("doc_id", "id").distinct(), ["doc_id", "id"]).groupBy("doc_id").agg(F.count("*").alias("n_shared"))
    return now.join(then, "doc_id", "left").join(shared, "doc_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
