"""Deterministic extraction of the most telling sentences of each document.

Windows of characters that end at a sentence where they can, sentences in them, candidates in a band of word counts, scored by
frequency, place, length and mood; exact and near duplicates collapse, the best are kept in text order. Segmenting is
sequential per text and runs on Arrow batches; all else is built-in and shares one shuffle by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.errors import GleanerError
from gleaner.functions import text as T


@dataclass(frozen=True)
class ExtractOptions:
    window_chars: int = 3500
    target_count: int | None = None
    min_words: int = 4
    max_words: int = 24
    jaccard_threshold: float = 0.92
    per_window_quota: int | None = None  # 0 and None: no quota
    nfkc: bool = True  # compatibility normalisation, in Python for the texts that it touches

    def __post_init__(self) -> None:
        if self.window_chars < 1 or not 0 <= self.min_words <= self.max_words or self.max_words < 1:
            raise GleanerError("validation", "window_chars and max_words must be positive, min_words between 0 and max_words")
        if not 0 <= self.jaccard_threshold <= 1:
            raise GleanerError("validation", "jaccard_threshold must be from 0 to 1")
        if (self.target_count or 0) < 0 or (self.per_window_quota or 0) < 0:
            raise GleanerError("validation", "target_count and per_window_quota cannot be negative")


def options(settings: dict) -> ExtractOptions:
    """Options from settings as they come from JSON; names that are none are refused."""
    if unknown := set(settings) - {f.name for f in fields(ExtractOptions)}:
        raise GleanerError("validation", f"unknown settings: {', '.join(sorted(unknown))}")
    return ExtractOptions(**settings)


# Fixed value: a run without terminators, its terminators, then closing marks and white space, or the end.
_SENTENCE = re.compile(r"""[^.!?]+[.!?]+(?=(?:[\\"')\]]*\s+)|$)""")


def windows_of(text: str, size: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n and (snap := text.rfind(". ", at + 1, end)) > at:
            end = snap + 2
        yield at, end
        at = end


def sentences_of(text: str) -> list[tuple[int, int]]:
    out = [m.span() for m in _SENTENCE.finditer(text)]
    return out or ([(0, len(text))] if text.strip() else [])


_WINDOWS = "array<struct<idx:int,start:int,end:int,text:string>>"
_SENTENCES = "array<struct<win:int,start:int,end:int,text:string,plain:string>>"


def spread(df: DataFrame) -> DataFrame:
    """A table too small to give each core a scan partition (one small file) is dealt out before per-row Python work; told from the plan's statistics, without a job."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    scan = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < cores * scan else df


def windows(df: DataFrame, size: int = 3500) -> DataFrame:
    """doc_id, idx, start, end, text of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, s, e, t[s:e]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (s, e) in enumerate(windows_of(t or "", size))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "idx", "start", "end", "text"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, idx int, start int, end int, text string")


def segment(df: DataFrame, size: int = 3500, nfkc: bool = True) -> DataFrame:
    """doc_id, text and all sentences of its windows; start and end are places in the text before the sentence is trimmed.

    ``plain`` of the text and of a sentence is what it is without marks and after NFKC, null for those that NFKC leaves alone, nearly all.
    """
    struct = pa.list_(pa.struct([("win", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("plain", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, plain = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                normal = T.strip_and_normalise if nfkc and T.changes(t) else None
                plain.append(normal and normal(t))
                rows = [{"win": i, "start": s + a, "end": s + z, "text": t[s + a : s + z].strip(), "plain": None} for i, (s, e) in enumerate(windows_of(t, size)) for a, z in sentences_of(t[s:e])]
                for r in rows if normal else ():
                    r["plain"] = normal(r["text"]) if T.changes(r["text"]) else None
                out.append(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain, pa.string()), pa.array(out, struct)], ["doc_id", "text", "plain", "sentences"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, text string, plain string, sentences {_SENTENCES}")


def sentences(df: DataFrame, size: int = 3500) -> DataFrame:
    return segment(df, size, nfkc=False).selectExpr("doc_id", "inline(sentences)").drop("plain")


#: Characters times sentences up to which each sentence is looked for by itself.
_SMALL = 1 << 22


def occurrences_of(text: str, sentences: list[str]) -> list[int]:
    """One more than the places of each sentence that do not overlap, 0 for an empty one; long texts are read once, whatever the number of sentences."""
    if len(text) * len(sentences) <= _SMALL:
        return [text.count(s) + 1 if s else 0 for s in sentences]
    automaton = ahocorasick.Automaton()
    for s in set(sentences) - {""}:
        automaton.add_word(s, s)
    if not len(automaton):
        return [0] * len(sentences)
    automaton.make_automaton()
    count, done = {"": 0}, {}
    for last, s in automaton.iter(text):
        if last - len(s) + 1 >= done.get(s, 0):
            done[s] = last + 1
            count[s] = count.get(s, 1) + 1
    return [count.get(s, 1) for s in sentences]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, n_chars, comparison form and sentences become a row a sentence, with the times it occurs."""
    for b in batches:
        lists = b.column(3)
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        parts = lists.flatten()
        doc = pa.array(np.repeat(np.arange(b.num_rows), size))
        columns = [pc.struct_field(parts, i) for i in range(parts.type.num_fields)]
        canon = columns[4].to_pylist()
        occ, at = [], 0
        for text, n in zip(b.column(2).to_pylist(), size.tolist(), strict=True):
            occ += occurrences_of(text or "", canon[at : at + n])
            at += n
        yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), *columns, pa.array(occ, pa.int64())], ["doc_id", "n_chars", "win", "start", "end", "text", "canon", "wc", "occ"])


def candidates(df: DataFrame, opts: ExtractOptions = ExtractOptions()) -> DataFrame:
    """doc_id, n_chars, win, start, end, text, canon, wc, occ, imp, score, q of the sentences in the word band."""
    canon = lambda row: T.collapse(f"lower(coalesce({row}plain, {T.strip_marks(f'{row}text')}))")
    docs = segment(df, opts.window_chars, opts.nfkc).withColumn("n_chars", F.length("text")).withColumn("doc_canon", F.expr(canon("")))
    inner = f"transform(sentences, s -> named_struct('win', s.win, 'start', s.start, 'end', s.end, 'text', s.text, 'canon', {canon('s.')}))"
    worded = f"transform({inner}, s -> named_struct('win', s.win, 'start', s.start, 'end', s.end, 'text', s.text, 'canon', s.canon, 'wc', {T.words('s.canon')}))"
    banded = f"filter({worded}, s -> s.wc BETWEEN {opts.min_words} AND {opts.max_words})"
    kind = df.schema["doc_id"].dataType.simpleString()
    flat = docs.selectExpr("doc_id", "n_chars", "doc_canon", f"{banded} AS sentences").mapInArrow(_counted, f"doc_id {kind}, n_chars int, win int, start int, end int, text string, canon string, wc int, occ long")
    flat = flat.withColumn("imp", F.expr(T.imperative("canon")))
    flat = flat.withColumn("score", F.expr(T.score("occ", "start", "n_chars", "wc", opts.max_words, "imp")))
    return flat.withColumn("q", F.expr(T.quant("score")))


def window_quota(c: DataFrame, quota: int | None) -> DataFrame:
    if not quota:
        return c
    w = Window.partitionBy("doc_id", "win").orderBy(F.desc("q"), "start", "text")
    return c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota).drop("_rn")


def exact_dedup(c: DataFrame) -> DataFrame:
    """Of equal comparison forms in a document the first stays."""
    w = Window.partitionBy("doc_id", "canon").orderBy("start", "text")
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _grams(canon: str) -> set[str]:
    return {canon[i : i + 3] for i in range(len(canon) - 2)}


def _alike(a: set[str], b: set[str]) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def collapse_near(c: DataFrame, threshold: float, ranked: bool = False, dealt: bool = False) -> DataFrame:
    """In text order, drop what is as similar as ``threshold`` to the last one kept of its document.

    One pass over sorted partitions that holds one document's sentences at a time. ``ranked``: with the ``rank`` of those kept, as
    ``rank_units`` gives it. ``dealt``: the rows of a document are in one partition already.
    """
    place = {n: c.columns.index(n) for n in ("doc_id", "start", "win", "canon", "q")}

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        keep, owner, last, doc = [], [], set(), object()
        for d, canon in zip(rows.column(place["doc_id"]).to_pylist(), rows.column(place["canon"]).to_pylist(), strict=True):
            grams, first = _grams(canon), d != doc
            kept = first or _alike(last, grams) < threshold
            if kept:
                last, doc = grams, d
            keep.append(kept)
            owner.append(len(owner) and owner[-1] + int(first))
        out = rows.filter(pa.array(keep, pa.bool_()))
        if not ranked:
            return out
        owner = np.array(owner, np.int64)[np.array(keep, bool)]
        win, start, q = (out.column(place[n]).to_numpy(zero_copy_only=False) for n in ("win", "start", "q"))
        order = np.lexsort((start, win, -q, owner))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], "left") + 1
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(rank)], [*out.schema.names, "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column(place["doc_id"])
            last = docs[-1].as_py()
            cut = b.num_rows
            while cut and docs[cut - 1].as_py() == last:
                cut -= 1
            if cut or held and held[-1].column(place["doc_id"])[-1].as_py() != last:  # what was held is whole now
                yield judged(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            held.append(b.slice(cut))
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    schema = StructType([*c.schema.fields, *([StructField("rank", IntegerType())] if ranked else [])])
    rows = c if dealt else c.repartition("doc_id")
    return rows.sortWithinPartitions("doc_id", "start", "text").mapInArrow(run, schema)


def rank_units(c: DataFrame) -> DataFrame:
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("q"), "win", "start", "text")))


def extract_units(df: DataFrame, opts: ExtractOptions = ExtractOptions()) -> DataFrame:
    """doc_id, id, text, start, end, score, win, rank of the units kept. ``df``: doc_id, text; blank texts give none."""
    c = candidates(df, opts).repartition("doc_id")  # what follows is grouped by document
    ranked = collapse_near(exact_dedup(window_quota(c, opts.per_window_quota)), opts.jaccard_threshold, ranked=True, dealt=True)
    target = F.lit(opts.target_count) if opts.target_count is not None else F.expr(T.target_count("n_chars"))
    return ranked.where(F.col("rank") <= target).select("doc_id", F.expr(T.unit_id("win", "start", "end")).alias("id"), "text", "start", "end", "score", "win", "rank")


def transcript_hashes(df: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each text that is not blank."""
    return df.where(F.col("text").rlike(r"\S")).select("doc_id", F.sha2("text", 256).alias("transcript_hash"))


def extract_documents(df: DataFrame, opts: ExtractOptions = ExtractOptions(), include_meta: bool = True) -> DataFrame:
    """One row per document that is not blank: doc_id, transcript_hash, units in text order and, if asked for, meta."""
    unit = F.struct("start", "text", "id", "end", "score", "win")
    grouped = extract_units(df, opts).groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    out = transcript_hashes(df).join(grouped, "doc_id", "left")
    out = out.withColumn("units", F.coalesce("units", F.array().cast(grouped.schema["units"].dataType)))
    if include_meta:
        meta = {"version": "1", **{k: str(v) for k, v in vars(opts).items()}}
        out = out.withColumn("meta", F.create_map(*(F.lit(x) for kv in meta.items() for x in kv)))
    return out


def blank_documents(df: DataFrame) -> DataFrame:
    """The reject table: documents without a character that is not white space."""
    return df.where(F.col("text").isNull() | ~F.col("text").rlike(r"\S")).select("doc_id", F.lit("blank").alias("error_code"))
