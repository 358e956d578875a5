"""Requests to a language model as columns: prompts, validation, retries and usage texts."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import literal
from gleaner.operators.cost import PRICES
from gleaner.operators.normalize import TYPES

MAX_OUTPUT_TOKENS = 64_000


def backoff_delay(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float | None = None) -> float:
    """Seconds before the next attempt: doubled each time up to ``most``, plus less than one second at random."""
    return min(base * 2**attempt, most) + (random.random() if jitter is None else jitter)


def system_prompt(types: tuple[str, ...] = TYPES) -> str:
    return f"You label candidate units of a transcript. Answer with JSON only: an array of objects with id, type (one of {', '.join(types)}), name (80 characters at most), summary (300 at most) and confidence from 0 to 1, one for each candidate in the given order."


def model_provider(chat: Callable[[str], str], types: tuple[str, ...] = TYPES, text_cap: int = 350) -> Callable[[object, list[dict]], list[dict]]:
    """A provider of labels (``normalize.Provider``) out of a model: the system prompt and a document's candidates go in, its JSON with or without a fence comes out."""
    opening = system_prompt(types)

    def provider(doc_id, candidates: list[dict]) -> list[dict]:
        body = json.dumps({"video_id": str(doc_id), "candidates": [{"id": c["id"], "text": c["text"][:text_cap]} for c in candidates]}, ensure_ascii=False)
        answer = chat(f"{opening}\n\n{body}").strip()
        if answer.startswith("```"):
            answer = answer.split("\n", 1)[-1].rsplit("```", 1)[0]
        return json.loads(answer)

    return provider


def user_prompts(candidates: DataFrame, text_cap: int = 350) -> DataFrame:
    """doc_id and prompt: the candidates of each document as JSON, in order. ``candidates``: doc_id, ord, id, text."""
    item = F.struct("ord", "id", F.left("text", F.lit(text_cap)).alias("text"))
    lists = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    return lists.select("doc_id", F.expr("to_json(named_struct('video_id', CAST(doc_id AS STRING), 'candidates', transform(cs, c -> named_struct('id', c.id, 'text', c.text))))").alias("prompt"))


def transcript_prompts(docs: DataFrame, template: str) -> DataFrame:
    """doc_id and prompt: the template, id, title and url where the table has them (an empty url is left out), then the transcript's body."""
    lines = [F.lit(template)]
    if "title" in docs.columns:
        lines.append(F.concat(F.lit("\n**Video ID**: "), F.col("doc_id").cast("string"), F.lit("\n**Title**: "), F.coalesce("title", F.lit(""))))  # fixed value: the labels
    if "url" in docs.columns:
        lines.append(F.concat(F.lit("**URL**: "), F.expr("nullif(url, '')")))
    head = F.concat_ws("\n", *lines)
    return docs.select("doc_id", F.concat(head, F.lit("\n\n## Transcript\n\n"), "text").alias("prompt"))


def invalid_reason(model: str = "model", max_tokens: str = "max_tokens", temperature: str = "temperature", top_p: str = "top_p", roles: str = "roles") -> str:
    """SQL expression: what is wrong with a request, null if nothing is."""
    models = ", ".join(literal(m) for m in PRICES)
    return (
        f"CASE WHEN coalesce({model} NOT IN ({models}), true) THEN 'model' WHEN {max_tokens} IS NOT NULL AND NOT {max_tokens} BETWEEN 1 AND {MAX_OUTPUT_TOKENS} THEN 'max_tokens' "
        f"WHEN {temperature} IS NOT NULL AND NOT {temperature} BETWEEN 0 AND 1 THEN 'temperature' WHEN {top_p} IS NOT NULL AND NOT ({top_p} > 0 AND {top_p} <= 1) THEN 'top_p' "
        f"WHEN coalesce(size({roles}), 0) = 0 OR exists({roles}, r -> r NOT IN ('user', 'assistant', 'system')) THEN 'roles' END"
    )


def usage_summary(usage: DataFrame) -> DataFrame:
    """One text per row over (requests, input_tokens, output_tokens, cost)."""
    number = lambda c: F.format_number(c, 0)
    lines: list[Column] = [
        F.lit("API Usage Summary:"),
        F.concat(F.lit("  Requests: "), F.col("requests").cast("string")),
        F.concat(F.lit("  Total Tokens: "), number(F.col("input_tokens") + F.col("output_tokens"))),
        F.concat(F.lit("  Input Tokens: "), number(F.col("input_tokens"))),
        F.concat(F.lit("  Output Tokens: "), number(F.col("output_tokens"))),
        F.concat(F.lit("  Total Cost: $"), F.format_string("%.4f", "cost")),
    ]
    return usage.select(F.concat_ws("\n", *lines).alias("summary"))
