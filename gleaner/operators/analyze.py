"""Whole transcripts through a model: prompt, answer, parsed units and usage, one row a transcript and no exception."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.errors import CODES, GleanerError
from gleaner.functions.formatting import strip_fence
from gleaner.operators.cost import with_cost
from gleaner.operators.parse import parse_units
from gleaner.operators.requests import transcript_prompts
from gleaner.sources.inputs import fetch_misses
from gleaner.sources import scratch

#: What a model's answer holds, as far as it is read.
RESPONSE = "model string, stop_reason string, content array<struct<type:string,text:string>>, usage struct<input_tokens:bigint,output_tokens:bigint>"


def stub_chat(prompt: str) -> str:
    """Offline: one technique, named by the transcript's first line, with its length as id."""
    body = prompt.split("## Transcript\n\n", 1)[-1]
    text = f"## 1. Techniques Extracted\n\n### Technique: {body.split(chr(10))[0][:40].strip() or '(empty)'}\n**ID**: `technique-{len(body)}`\n"
    return json.dumps({"model": "stub", "content": [{"type": "text", "text": text}], "usage": {"input_tokens": len(prompt) // 4, "output_tokens": len(text) // 4}})


def ask_model(prompts: DataFrame, chat: Callable[[str], str] = stub_chat, max_retries: int = 1) -> DataFrame:
    """doc_id, raw and error_code of each prompt (doc_id, prompt). ``chat`` is called inside partitions, so it must be picklable; a GleanerError keeps its code."""
    if max_retries < 0:
        raise GleanerError("validation", "max_retries cannot be negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, codes = [], []
            for prompt in b.column(1).to_pylist():
                raw, code = None, "validation" if prompt is None else None
                for _ in range(max_retries + 1 if prompt is not None else 0):
                    try:
                        raw, code = chat(prompt), None
                        break
                    except Exception as e:  # a provider may fail in any way; the row says so
                        code = e.code if isinstance(e, GleanerError) else "api_error"
                raws.append(raw)
                codes.append(code if code in (None, *CODES) else "api_error")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.string()), pa.array(codes, pa.string())], ["doc_id", "raw", "error_code"])

    kind = prompts.schema["doc_id"].dataType.simpleString()
    return prompts.select("doc_id", "prompt").mapInArrow(run, f"doc_id {kind}, raw string, error_code string")


def parse_responses(raw: DataFrame) -> DataFrame:
    """Adds text (the first text block), model, stop_reason, input_tokens, output_tokens (0 where missing) and cost; broken JSON is a ``validation`` error."""
    r = F.from_json("raw", RESPONSE)
    out = raw.withColumn("r", r).withColumn("error_code", F.when(F.col("error_code").isNull() & F.col("r.content").isNull(), "validation").otherwise(F.col("error_code")))
    first = F.expr("get(filter(r.content, x -> x.type = 'text'), 0).text")
    tokens = [F.coalesce(F.col(f"r.usage.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return with_cost(out.select("doc_id", "error_code", F.coalesce(first, F.lit("")).alias("text"), F.col("r.model").alias("model"), F.col("r.stop_reason").alias("stop_reason"), *tokens))


def json_answers(texts: DataFrame, schema: str, text_col: str = "text") -> DataFrame:
    """Adds ``value``, the JSON in a text with or without a code fence, read by ``schema``, and ``ok``: it could be read and lacks nothing."""
    out = texts.withColumn("value", F.from_json(F.expr(strip_fence(text_col)), schema))
    names = [f.name for f in out.schema["value"].dataType.fields]
    return out.withColumn("ok", F.expr("value IS NOT NULL AND " + " AND ".join(f"value.`{n}` IS NOT NULL" for n in names)))


def analyze_transcripts(docs: DataFrame, template: str, chat: Callable[[str], str] = stub_chat, max_retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """Answers with usage and errors, a row a transcript (doc_id, text, and title and url if there are), and the units parsed from them.

    The model is asked here, once for each transcript, and its answers are stored: both tables are read from them, however often.
    """
    answers = parse_responses(scratch.stored(ask_model(transcript_prompts(docs, template), chat, max_retries)))
    return answers, parse_units(answers.where("error_code IS NULL"), "doc_id", "text")


def extend_store(requests: DataFrame, path: str, fetch: Callable[[str], str], key: str = "request_key", request: str = "request") -> DataFrame:
    """``fill_store`` over the answers kept under ``path``, to which the new ones are added: what any run has fetched, no later one asks for."""
    schema = f"`{key}` {requests.schema[key].dataType.simpleString()}, answer string"
    try:
        held = requests.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = requests.sparkSession.createDataFrame([], schema)
    every, new = fill_store(requests, held, fetch, key, request)
    every = scratch.stored(every)  # before the folder that it reads changes
    new.write.mode("append").parquet(path)
    return every


def fill_store(requests: DataFrame, stored: DataFrame, fetch: Callable[[str], str], key: str = "request_key", request: str = "request") -> tuple[DataFrame, DataFrame]:
    """(key, answer, error_code) of all requests, and what the store gains. ``stored``: key, answer; only requests without a stored answer are fetched.

    The requests are fetched here, once each. Errors are not kept, so that a later run asks again; 403 and 404 come as ``quota`` and ``not_found`` from ``fetch``.
    """
    misses = fetch_misses(requests, stored, key).select(F.col(key).alias("doc_id"), F.col(request).alias("prompt"))
    new = scratch.stored(ask_model(misses, fetch, 0)).select(F.col("doc_id").alias(key), F.col("raw").alias("answer"), "error_code")
    held = stored.join(requests.select(key).distinct(), key, "left_semi").select(key, "answer", F.lit(None).cast("string").alias("error_code"))
    return held.unionByName(new), new.where("error_code IS NULL").select(key, "answer")
