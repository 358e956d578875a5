"""Labels for candidate units: a signed cache, a pluggable provider, validation, retries and fallbacks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.formatting import truncated
from gleaner.sources.scratch import stored

# The labels, and the bounds of their texts.
TYPES = ("technique", "pattern", "use-case", "capability", "integration", "anti-pattern", "component", "troubleshooting", "configuration", "code-snippet")
NAME_MAX, SUMMARY_MAX, FALLBACK_SUMMARY, FALLBACK_CONFIDENCE = 80, 300, 280, 0.3
FIELDS = ("id", "type", "name", "summary", "confidence")


class Provider(Protocol):
    """Labels the candidates of one document; called inside partitions, so it must be picklable."""

    def __call__(self, doc_id, candidates: list[dict]) -> list[dict]: ...


def stub_provider(doc_id, candidates: list[dict]) -> list[dict]:
    """Offline: every candidate is a technique named by its first words."""
    return [{"id": c["id"], "type": "technique", "name": c["text"][:NAME_MAX] or "(empty)", "summary": c["text"][:SUMMARY_MAX] or "(empty)", "confidence": 0.5} for c in candidates]


def signature(model: str, template: str, taxonomy: list[str]) -> str:
    """Changes when labels made before can no longer be used."""
    canonical = json.dumps({"model": model, "taxonomy": sorted(taxonomy), "template": template}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()


def valid_unit(prefix: str = "") -> str:
    """Predicate: type known, name and summary in bounds, confidence from 0 to 1, all there."""
    p = prefix
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    return f"coalesce({p}id IS NOT NULL AND {p}type IN ({kinds}) AND length({p}name) BETWEEN 1 AND {NAME_MAX} AND length({p}summary) BETWEEN 1 AND {SUMMARY_MAX} AND {p}confidence BETWEEN 0 AND 1, false)"


def only_known_keys(raw_json: str) -> str:
    allowed = ", ".join(f"'{f}'" for f in FIELDS)
    return f"coalesce(size(array_except(json_object_keys({raw_json}), array({allowed}))) = 0, false)"


def _good(units: list[dict], candidates: list[dict]) -> bool:
    """Same ids in the same order, and each unit valid."""
    if [u.get("id") for u in units] != [c["id"] for c in candidates]:
        return False
    return all(set(u) == set(FIELDS) and u["type"] in TYPES and 1 <= len(u["name"]) <= NAME_MAX and 1 <= len(u["summary"]) <= SUMMARY_MAX and 0 <= u["confidence"] <= 1 for u in units)


def fallback(prefix: str = "") -> list[str]:
    """Select list of the label given when none can be had."""
    return [f"{prefix}id AS id", "'component' AS type", "'(unclear)' AS name", f"left({prefix}text, {FALLBACK_SUMMARY}) AS summary", f"{FALLBACK_CONFIDENCE}D AS confidence"]


def cache_split(candidates: DataFrame, cache: DataFrame, sig: str) -> tuple[DataFrame, DataFrame]:
    """Labels of documents whose candidates are all cached under ``sig``, and the candidates of all other documents.

    ``candidates``: doc_id, ord, id, text. ``cache``: video_id, unit_id, type, name, summary, confidence, normalizer_sig.
    """
    held = cache.where(F.col("normalizer_sig") == sig).select(F.col("video_id").alias("doc_id"), F.col("unit_id").alias("id"), "type", "name", "summary", "confidence", F.lit(True).alias("hit"))
    joined = candidates.join(held, ["doc_id", "id"], "left")
    complete = candidates.select("doc_id", "id").join(held.select("doc_id", "id", "hit"), ["doc_id", "id"], "left").groupBy("doc_id").agg(F.coalesce(F.bool_and(F.coalesce("hit", F.lit(False))), F.lit(True)).alias("all_cached"))
    both = joined.join(complete, "doc_id")
    return both.where("all_cached").select("doc_id", "ord", "id", "type", "name", "summary", "confidence"), both.where("NOT all_cached").select("doc_id", "ord", "id", "text")


def ask(candidates: DataFrame, provider: Provider | Callable = stub_provider, max_retries: int = 1, text_cap: int = 350) -> DataFrame:
    """Labels from the provider, document by document; after ``max_retries`` more attempts, fallbacks."""
    lists = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", F.expr(truncated("text", text_cap)).alias("text"), F.left("text", F.lit(FALLBACK_SUMMARY)).alias("head")))).alias("cs"))
    struct = pa.list_(pa.struct([("ord", pa.int64()), *((f, pa.string()) for f in FIELDS[:4]), ("confidence", pa.float64()), ("is_fallback", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                units = None
                for _ in range(max_retries + 1):
                    try:
                        got = provider(doc, [{"id": c["id"], "text": c["text"]} for c in cs])
                        units = got if _good(got, cs) else None
                    except Exception:  # a provider may fail in any way; that is what fallbacks are for
                        units = None
                    if units:
                        break
                if units is None:
                    units = [{"id": c["id"], "type": "component", "name": "(unclear)", "summary": c["head"], "confidence": FALLBACK_CONFIDENCE, "is_fallback": True} for c in cs]
                out.append([{"ord": c["ord"], "is_fallback": False, **u} for c, u in zip(cs, units, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, struct)], ["doc_id", "us"])

    kind = candidates.schema["doc_id"].dataType.simpleString()
    return lists.mapInArrow(run, f"doc_id {kind}, us array<struct<ord:bigint,id:string,type:string,name:string,summary:string,confidence:double,is_fallback:boolean>>").selectExpr("doc_id", "inline(us)")


def normalize(candidates: DataFrame, cache: DataFrame, sig: str, provider: Provider | Callable = stub_provider, max_retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """All labels in input order (doc_id, ord), and the cache with the new ones in place of old ones and of other signatures.

    The provider is asked here, once for each document that needs it, and its labels are stored: the cache gets those that are returned.
    """
    hits, misses = cache_split(candidates, cache, sig)
    fresh = stored(ask(misses, provider, max_retries))
    columns = ["doc_id", "ord", *FIELDS]
    new = fresh.select(F.col("doc_id").alias("video_id"), F.col("id").alias("unit_id"), "type", "name", "summary", "confidence", F.lit(sig).alias("normalizer_sig"))
    kept = cache.where(F.col("normalizer_sig") == sig).join(new.select("video_id", "unit_id"), ["video_id", "unit_id"], "left_anti")
    return hits.select(columns).unionByName(fresh.select(columns)), kept.unionByName(new)


def invariants(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ok: same number, ids and order on both sides."""
    a = candidates.select("doc_id", "ord", F.col("id").alias("a"))
    b = labels.select("doc_id", "ord", F.col("id").alias("b"))
    return a.join(b, ["doc_id", "ord"], "full").groupBy("doc_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("ok"))
