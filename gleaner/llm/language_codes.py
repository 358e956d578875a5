"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword of signs. For each bit a binary classifier tells the languages with + from those with -: the mean, over a text's
n-grams, of the log ratio of their frequencies in both groups, every language counting alike. Up to ``EXHAUSTIVE`` languages have all ways of
parting them as bits, more have a random code of fixed seed, of several the one with the largest distances. Decoding takes the
codeword of the least loss, the logistic loss of sign times margin, where each bit of a language weighs as much as its classifier is right on that
language's training texts. A text whose two nearest codewords are less than ``CLOSE`` apart is flagged as ambiguous.

Letters are lower-cased, all else is a space; n-grams of 1 to 4 characters over words and the spaces around them go into ``BUCKETS`` cells. Texts
are read whole, in pieces of ``PIECE`` characters. Margins are shrunk as if ``CALM`` more n-grams told nothing, so that short texts score lower.

The model is fitted on at most ``PER_LANGUAGE`` distinct texts of each language, those of the smallest hashes, of documents outside the held-out fold
(crc32 of the id modulo 5 is 0). Everything that the driver gathers is of the model's size: languages by cells.

Cases: a null text and one without a letter are ``und`` with score 0, as is every text if no language was learned; a single learned language has
score 1. A null doc_id is held out and never learned from. Languages that tie go by name. Rows that repeat count once in the model. Documents with null lang are predicted like all
others. An empty lang is a language. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import slices, texts, written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 18
#: Texts of each language that the model is fitted on, at most.
PER_LANGUAGE = 1000
FOLDS = 5
SALTS = 64
SMOOTH = 0.5
EXHAUSTIVE, BITS_A_DOUBLING, TRIES, SEED = 5, 10, 200, 11
CALM = 20
SHARPNESS = 8.0
CLOSE = 0.1
UNKNOWN = "und"
_UNIT = 1 << 16


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def cells(many: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, text) of all n-grams, in bounded pieces."""
    held, size = [], 0
    for i, t in enumerate(many):
        for at in range(0, len(t), PIECE):
            piece = t[at : at + PIECE]
            held.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                yield _cells(held)
                held, size = [], 0
    if held:
        yield _cells(held)


def _cells(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [f" {p.lower()} " for _, p in pieces]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in lowered])
    letter = _letters()[points]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # of each run of other characters the first stays, as a space
    kept[1:] |= owner[1:] != owner[:-1]
    x = np.where(letter, points, 32).astype(np.uint64)[kept]
    letter, owner = letter[kept], owner[kept]
    number = np.array([i for i, _ in pieces])
    out, docs = [], []
    code = np.zeros(len(x), np.uint64)
    some = np.zeros(len(x), bool)
    for n in ORDERS:
        m = len(x) - n + 1
        if m < 1:
            break
        code = (code[:m] * np.uint64(0x100000001B3)) ^ (x[n - 1 :] + np.uint64(n))
        some = some[:m] | letter[n - 1 :]
        ok = some & (owner[:m] == owner[n - 1 :])
        mixed = code[ok] * np.uint64(0x9E3779B97F4A7C15)
        out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int32))
        docs.append(number[owner[:m][ok]])
    return np.concatenate(out), np.concatenate(docs)


def code_matrix(n: int) -> np.ndarray:
    """Signs of n codewords, a row each; no bit is constant, no two are equal or opposite."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.stack([np.ones(len(bits), np.int8), *(np.where(bits >> i & 1, -1, 1).astype(np.int8) for i in range(n - 1))])
    rng = np.random.default_rng(SEED)
    width = math.ceil(BITS_A_DOUBLING * math.log2(n))
    best, apart = None, (-1, -1)
    for _ in range(TRIES):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code * code[0]
        code = np.unique(code[:, (code != 1).any(0)], axis=1)
        far = (code.shape[1] - code.astype(np.int32) @ code.T) // 2
        np.fill_diagonal(far, code.shape[1])
        if (found := (int(far.min()), int(far.sum()))) > apart:
            best, apart = code, found
    return best


class Model:
    """``languages`` in order, their codewords, the bits' weights by cell, the bits' usual margins and each language's weights of the bits."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = code_matrix(len(languages))
        share = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        plus, minus = self.code.T > 0, self.code.T < 0
        ratio = [np.log(share[p].mean(0)) - np.log(share[m].mean(0)) for p, m in zip(plus, minus, strict=True)]
        self.weights = np.rint(np.array(ratio).reshape(len(ratio), BUCKETS) * _UNIT).astype(np.int32)
        self.usual = np.ones(len(ratio))
        self.trust = np.full(self.code.shape, 1 / max(1, len(ratio)))

    def margins(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each text (row) for each bit, and the number of its n-grams. Sums are of whole numbers."""
        total, n = np.zeros((len(many), len(self.weights)), np.int64), np.zeros(len(many), np.int64)
        for cell, doc in cells(many):
            if not len(cell):
                continue
            order = np.argsort(doc, kind="stable")
            cell, doc = cell[order], doc[order]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for b, w in enumerate(self.weights):
                total[doc[first], b] += np.add.reduceat(w[cell], first, dtype=np.int64)
            n[doc[first]] += np.diff(np.r_[first, len(doc)])
        return total / _UNIT / (n + CALM)[:, None], n

    def weigh(self, right: np.ndarray, texts_seen: np.ndarray, size: np.ndarray) -> None:
        """From the training texts: right signs (language, bit), texts (language), summed magnitudes of margins (bit)."""
        self.usual = np.maximum(size / max(1, texts_seen.sum()), 1e-9)
        trust = (right + 1) / (texts_seen + 2)[:, None]
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each text (row) for each language."""
        z = margins / self.usual
        out = np.zeros((len(z), len(self.languages)))
        for i in range(len(self.languages)):
            out[:, i] = (np.logaddexp(0, -z * self.code[i]) * self.trust[i]).sum(1)
        return out

    def predict(self, many: list[str]) -> list[tuple]:
        """(language, score, runner-up, ambiguous) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, None, False)] * len(many)
        margins, n = self.margins(many)
        loss = self.losses(margins)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        score = share.max(1) / share.sum(1)
        out = []
        for i, t in enumerate(many):
            if not n[i]:
                out.append((UNKNOWN, 0.0, None, False))
                continue
            second = self.languages[order[i, 1]] if len(self.languages) > 1 else None
            gap = loss[i, order[i, 1]] - loss[i, order[i, 0]] if second is not None else math.inf
            out.append((self.languages[order[i, 0]], float(score[i]), second, bool(gap < CLOSE)))
        return out


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """lang and text of the texts that the model is fitted on: of each language those of the smallest hashes, each once."""
    known = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text", "lang"))
    hashes = known.select("lang", "h", (F.col("h") % SALTS).alias("salt")).distinct()
    for by in (["lang", "salt"], ["lang"]):  # the least of each share of a language first, as one language may have most texts
        hashes = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= per_language)
    last = F.broadcast(hashes.groupBy("lang").agg(F.max("h").alias("last")))  # a row for each language; the model has a hundred kilobytes for each
    return known.join(last, "lang").where("h <= last").select("lang", "text").distinct()


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """``rows``: doc_id, text, lang, held_out."""
    spark = rows.sparkSession
    sample = written(_sample(rows, per_language))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for big in batches:
            for batch in slices(big, "text"):
                own = np.array([number[x] for x in batch.column(0).to_pylist()])
                for cell, doc in cells(texts(batch.column(1))):
                    lang = own[doc]
                    for i in np.unique(lang).tolist():
                        counts[i] = counts.get(i, 0) + np.bincount(cell[lang == i], minlength=BUCKETS)
        for i, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(c[some])], ["lang", "cell", "n"])

    found = sample.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # languages by cells
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    model = Model(languages, counts)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for big in batches:
            for batch in slices(big, "text"):
                own = np.array([number[x] for x in batch.column(0).to_pylist()])
                margins, n = model.margins(texts(batch.column(1)))
                own, margins = own[n > 0], margins[n > 0]
                right = np.sign(margins) == model.code[own]
                for i in np.unique(own).tolist():
                    mine = own == i
                    size = np.rint(np.abs(margins[mine]) * _UNIT).astype(np.int64).sum(0)
                    bits = len(size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(bits, i, np.int32)), pa.array(np.arange(bits, dtype=np.int32)), pa.array(right[mine].sum(0).astype(np.int64)), pa.array(size), pa.array(np.full(bits, mine.sum(), np.int64))], ["lang", "bit", "ok", "size", "n"])

    right, size, seen = np.zeros(model.code.shape), np.zeros(model.code.shape[1]), np.zeros(len(languages))
    for r in sample.mapInArrow(judge, "lang int, bit int, ok long, size long, n long").groupBy("lang", "bit").agg(F.sum("ok").alias("ok"), F.sum("size").alias("size"), F.sum("n").alias("n")).collect():  # languages by bits
        right[r.lang, r.bit], seen[r.lang] = r.ok, r.n
        size[r.bit] += r.size / _UNIT
    model.weigh(right, seen, size)
    return model


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up and ambiguous of every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), held_out(f"`{id_col}`").alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                lang, score, second, close = zip(*shared.value.predict(texts(batch.column(2))), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(second, pa.string()), pa.array(close)], ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean")
