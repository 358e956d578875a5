"""Personal data: base patterns, then information-theoretic sanitisation of the terms that give it away.

Method. The values found by the base patterns (email, ip, card, phone) are the protected entities. Words close to an
entity are counted with it over the whole corpus, each distinct context once, so that copies of one text are one piece
of evidence. With N distinct texts, an entity e in n(e) contexts and a term t in n(t) distinct texts,

    PMI(e; t) = log(N * n(e, t) / (n(e) * n(t))),   IC(e) = log(N / n(e)),   disclosure = PMI / IC  (1: t gives e away).

A term is removed where disclosure reaches ``remove_at`` and generalised to a class where it reaches ``generalise_at``,
in documents that hold e; other documents stay as they are. Every term near every entity is counted. One met in fewer than
``min_seen`` distinct contexts of e is no evidence, as every word beside an entity that is met once is there as often as the entity: it stays,
however rare. One met in fewer than ``min_support`` is judged on a lower bound: each context it lacks counts as one more of e without it,

    PMI(e; t) >= log(N * n(e, t) / ((n(e) + max(0, min_support - n(e, t))) * n(t))).

A text that occurs c times weighs 1/c wherever it occurs, so texts need not move to be counted once; the texts that
repeat are known by hash.

Cases: a null text counts as empty; an empty text has no spans and the hash of the empty string. Repeated rows are
judged alike and add no evidence. Long texts, long runs of digits and texts full of entities take linear time, but for a logarithm: no pattern
rescans a run of characters. Columns other than id and text are ignored by ``find`` and passed on, of any name, by ``sanitise``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, slices, small_rows, texts, written

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}
#: Words on either side of an entity that count as its context.
CONTEXT_WORDS = 8
#: Distinct contexts of one entity that hold a term before its estimate is taken as it is; with fewer it is lowered.
MIN_SUPPORT = 3
#: Distinct contexts of one entity that hold a term before it is judged at all.
MIN_SEEN = 2
REMOVE_AT, GENERALISE_AT = 0.95, 0.8
#: Largest table of disclosing terms that is broadcast; a larger one is joined.
BROADCAST_BYTES = 32 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the longest run of local characters before it, back to the last match, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        elif start < at or at >= done:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) in code points, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]  # a part may have any number of zeros in front
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_key(text: str, span: tuple[int, int, int]) -> int:
    """The same value written in another way is the same entity."""
    start, kind, end = span
    value = text[start:end].lower()
    return xxhash.xxh64_intdigest(f"{kind}:{value if kind < 2 else ''.join(_DIGIT.findall(value))}") - (1 << 63)


def term_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class _Spans:
    """Spans sorted by start; tells in logarithmic time whether a stretch touches one."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))  # where the spans up to each one end at the latest

    def touch(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.reach[at - 1] > start


def _words_near(text: str, start: int, end: int, spans: _Spans) -> tuple[set[str], int]:
    """The lower-case words of the context, none of which touch a span, and a hash of the context."""
    width = 40 * CONTEXT_WORDS
    left = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text, max(0, start - width), start)][-CONTEXT_WORDS:]
    right = [(m.start(), m.end(), m.group()) for m in islice(_WORD.finditer(text, end, min(len(text), end + width)), CONTEXT_WORDS)]
    words = [w.lower() for s, e, w in (*left, *right) if not spans.touch(s, e)]
    return set(words), xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each entity, term near it and context."""

    def out(rows):
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["entity", "term", "context"])

    for batch in batches:
        rows = []
        for text in texts(batch.column(0)):
            spans = base_spans(text)
            sorted_spans = _Spans(spans)
            for span in spans:
                words, context = _words_near(text, span[0], span[2], sorted_spans)
                entity = entity_key(text, span)
                rows += [(entity, term_key(w), context) for w in words or ("",)]
                if len(rows) > 1 << 16:  # a text may hold any number of entities
                    yield out(rows)
                    rows = []
        yield out(rows)


def _text_counts(batches: Iterator[pa.RecordBatch], repeated: tuple[np.ndarray, np.ndarray], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """In how many distinct texts each term occurs, summed within bounded pieces of a batch: a text of c copies is 1/c in each.

    c is in the column ``copies`` where it is set, else in ``repeated`` (sorted hashes, copies), else 1. Only the terms in
    ``wanted`` (sorted hashes) come out, or all.
    """
    hashes, copies = repeated
    for big in batches:
        for batch in slices(big, "text", 4 << 20):
            docs = [_WORD.findall(t.lower()) for t in texts(batch.column(0))]
            weight = np.ones(len(docs))
            if len(hashes):
                own = batch.column(1).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                weight = np.where(hashes[at] == own, 1.0 / copies[at], 1.0)
            elif batch.column(2).null_count < len(docs):
                weight = 1.0 / batch.column(2).fill_null(1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            codes, words = pd.factorize(np.array([w for d in docs for w in d], dtype=object))
            seen = np.unique(codes.astype(np.int64) * max(1, len(docs)) + doc)
            n = np.bincount(seen // max(1, len(docs)), weights=weight[seen % max(1, len(docs))], minlength=len(words))
            terms = np.fromiter((term_key(w) for w in words), np.int64, len(words))
            if wanted is not None:
                asked = np.isin(terms, wanted) if len(wanted) else np.zeros(len(terms), bool)
                terms, n = terms[asked], n[asked]
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n, pa.float64())], ["term", "n"])


def _counted(source: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, int]:
    """term, n_term: the distinct texts that hold each term in ``asked``, or each at all; and how many distinct texts there are.

    The terms asked for are broadcast where they are few, and counted first and joined afterwards where they are not.
    """
    hashed = source.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    groups = written(hashed.groupBy("hash").agg(F.count("*").alias("copies")))
    repeated = groups.where("copies > 1")
    rows = small_rows(repeated, BROADCAST_BYTES)
    if rows is None:
        ready, table = hashed.join(repeated, "hash", "left").select("text", "hash", "copies"), []
    else:
        ready, table = hashed.withColumn("copies", F.lit(None).cast("long")), sorted((r.hash, r.copies) for r in rows)
    few = None if asked is None else small_rows(asked, BROADCAST_BYTES)
    wanted = None if few is None else np.sort(np.array([r.term for r in few], np.int64))
    shared = source.sparkSession.sparkContext.broadcast((np.array([h for h, _ in table], np.int64), np.array([c for _, c in table], np.int64), wanted))
    counts = ready.mapInArrow(lambda batches: _text_counts(batches, shared.value[:2], shared.value[2]), "term long, n double")
    # shares of a text add up to whole numbers but for rounding
    return counts.groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n_term")), groups.count()


def disclosing_terms(df: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, min_seen: int = MIN_SEEN, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """entity, term (hashes), kind: the terms of this corpus that give an entity away."""
    source = df.select(F.col(f"`{text_col}`").alias("text"))
    found = source.where(F.col("text").rlike("[0-9@]")).mapInArrow(_evidence, "entity long, term long, context long")
    found = written(found.distinct())  # copies of a text say nothing new
    near = found.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_seen)
    of_entity = found.groupBy("entity").agg(F.count_distinct("context").alias("n_entity"))
    of_term, n = _counted(source, near.select("term").distinct())
    n = max(1, n)
    lacking = F.greatest(F.lit(0), F.lit(min_support) - F.col("n_both"))
    pmi = F.log(F.lit(float(n)) * F.col("n_both") / ((F.col("n_entity") + lacking) * F.greatest("n_term", "n_both")))
    disclosure = F.when(F.col("n_entity") < n, pmi / F.log(F.lit(float(n)) / F.col("n_entity"))).otherwise(F.lit(0.0))
    kind = F.when(disclosure >= remove_at, "remove").when(disclosure >= generalise_at, "generalise")
    return near.join(of_entity, "entity").join(of_term, "term").select("entity", "term", kind.alias("kind")).where("kind is not null")


def all_spans(text: str, spans: list[tuple[int, int, int]], terms: dict[int, str]) -> list[tuple[int, int, int]]:
    """Base spans and those of the disclosing terms, by start, then kind."""
    if not terms:
        return spans
    out, base = list(spans), _Spans(spans)
    for m in _WORD.finditer(text):
        kind = terms.get(term_key(m.group().lower()))
        if kind and not base.touch(m.start(), m.end()):
            out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Labels in place of the spans; spans that overlap become one, labelled by the first."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            label = LABELS.get(KINDS[kind])
            if label is None:
                label = "[NUMBER]" if text[start:end].isdigit() else "[TERM]"
            out += [text[done:start], label]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _terms_of(text: str, spans, by_entity: dict[int, dict[int, str]]) -> dict[int, str]:
    """Of all the document's entities; where two disagree, the term is removed."""
    out: dict[int, str] = {}
    for span in spans:
        for term, kind in by_entity.get(entity_key(text, span), {}).items():
            if out.get(term) != "remove":
                out[term] = kind
    return out


def _lookup(df: DataFrame, text_col: str, options: dict):
    """How a document finds its disclosing terms: a broadcast table where it is small, else a joined column, whose name comes last."""
    name, hashed = fresh(df, "__terms"), fresh(df, "__key")
    terms = written(disclosing_terms(df, text_col, **options))
    rows = small_rows(terms, BROADCAST_BYTES)
    if rows is not None:
        by_entity: dict[int, dict[int, str]] = {}
        for r in rows:
            by_entity.setdefault(r.entity, {})[r.term] = r.kind
        return df.withColumn(name, F.lit(None).cast("array<struct<term:bigint,kind:string>>")), df.sparkSession.sparkContext.broadcast(by_entity), name

    def entities(batches):
        for batch in batches:
            rows = [(k, entity_key(t, s)) for k, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for s in base_spans(t)]
            cols = list(zip(*set(rows), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [hashed, "entity"])

    key: Column = F.xxhash64(F.col(f"`{text_col}`"))
    held = df.select(key.alias(hashed), F.col(f"`{text_col}`").alias("text")).mapInArrow(entities, f"{hashed} long, entity long").distinct()
    per_text = held.join(terms, "entity").groupBy(hashed, "term").agg(F.max("kind").alias("kind")).groupBy(hashed).agg(F.collect_list(F.struct("term", "kind")).alias(name))
    return df.withColumn(hashed, key).join(per_text, hashed, "left").drop(hashed), None, name


def _judged(text: str, joined, by_entity) -> tuple[list, list]:
    spans = base_spans(text)
    terms = {x["term"]: x["kind"] for x in joined} if joined else _terms_of(text, spans, by_entity) if by_entity and spans else {}
    return spans, all_spans(text, spans, terms)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row: id, counts of the base kinds, ``base_sha256``, ``spans``; options as in ``disclosing_terms``."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ready, shared, name = _lookup(source, "text", options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_entity = shared.value if shared else {}
        for batch in batches:
            counts, digests, joined = [], [], []
            for text, terms in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                base, every = _judged(text, terms, by_entity)
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(every))
            columns = np.array(counts, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(joined, pa.string())], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    id_type = df.schema[id_col].dataType.simpleString()
    return ready.select("id", "text", name).mapInArrow(run, f"`{id_col}` {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(df: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``df`` with every span of its texts replaced; a null text stays null. ``length_col``, if given, is set anew."""
    ready, shared, name = _lookup(df, text_col, options)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_entity = shared.value if shared else {}
        for batch in batches:
            arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            terms = arrays.pop(name).to_pylist()
            new = [None if t is None else redact(t, _judged(t, x, by_entity)[1]) for t, x in zip(arrays[text_col].to_pylist(), terms, strict=True)]
            arrays[text_col] = pa.array(new, pa.string())
            if length_col:
                arrays[length_col] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(arrays[length_col].type)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    return ready.select(*(f"`{n}`" for n in names), name).mapInArrow(run, df.schema)
