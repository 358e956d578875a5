"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and punctuation runs, and pairs of neighbours, are hashed into ``BUCKETS`` cells (a pair of equal
neighbours into one cell of its own, so that repetition is seen whatever the word). The raw model counts all documents, the target model a
bounded sample of the labelled good ones. Where a cell has t target counts and e were to be expected from the raw model, its ratio is
(t + PRIOR) / (e + PRIOR), so that cells with little evidence weigh little. A document's log weight is the mean log ratio of its n-grams, as if
``CALM`` more had none, so that long and short texts compare, times a scale: the one that puts ``SPREAD`` between the medians of the labelled good rows and the
others. With a Gumbel variate added to each log weight, the k largest are a sample without replacement in proportion to the weights: texts far
from the border are as good as sure to be drawn or not, those near it are drawn by chance, the more often the better they are.

k is the number of documents whose log weight reaches a threshold: the one that tells the labelled rows apart best (share of good rows above
plus share of others below), where a good row's weight is taken without its own counts in the target model. Labels need not be in
proportion to the documents for that.

Weights are means of whole millionths, so that any partitioning gives the same ones. The k-th largest key is found by
histograms, without a sort or a collection of the keys.

Cases: a text without an n-gram (null, empty, white space) has the log weight ``NOTHING`` and is not drawn. Rows that repeat id and text get the same key, and
all rows that tie with the k-th are kept. A null doc_id is a value like any other; ids are whole numbers. Without labels of both kinds in the
documents every document is kept. Columns of any name are passed on by ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.llm.common import fresh, slices, texts, written

BUCKETS = 1 << 14
#: Labelled rows used at most, those of the smallest hashes.
MAX_LABELS = 20_000
#: N-grams of no evidence that each text is given; nats between the medians of good and other labelled rows.
CALM, SPREAD = 10, 16.0
#: Counts that a cell is given in both models; chosen on halves of the labels, each tested on the other.
PRIOR = 100
SEED = 1
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_UNIT = 1_000_000
#: Log weight of a text without n-grams, in millionths.
NOTHING = -(10**15)


def features(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of the texts, and the text each belongs to."""
    tokens = [_TOKEN.findall(t) for t in many]
    n = np.array([len(t) for t in tokens], np.int64)
    flat = [w for t in tokens for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    doc = np.repeat(np.arange(len(many)), n)
    h = hashes[codes]
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
    pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    pair[codes[:-1] == codes[1:]] = 0
    inside = doc[:-1] == doc[1:]
    cells = np.concatenate([h, pair[inside]]) >> np.uint64(64 - int(math.log2(BUCKETS)))
    return cells.astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def gumbel(key: bytes) -> int:
    """A Gumbel variate in millionths, fixed by the key and the seed."""
    u = (xxhash.xxh3_64_intdigest(key, SEED) + 0.5) / 2**64
    return round(-math.log(-math.log(u)) * _UNIT) if u < 1 else 45 * _UNIT


class Model:
    """log(target / raw) of every cell in millionths, the scale of the weights and the threshold (None: every text is good enough)."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw.astype(np.float64), target.astype(np.float64)
        self.log_ratio = np.rint(self._ratio(self.target, self.raw, self.target.sum()) * _UNIT).astype(np.int64)
        self.scale, self.at = 1.0, None

    def _ratio(self, target: np.ndarray, raw: np.ndarray, total: float) -> np.ndarray:
        return np.log((target + PRIOR) / (raw * (total / max(1.0, self.raw.sum())) + PRIOR))

    def weights(self, many: list[str]) -> np.ndarray:
        """Log weights in millionths."""
        total = np.zeros(len(many), np.int64)
        cells, doc = features(many)
        value = self.log_ratio[cells]
        high, low = value >> 20, value & ((1 << 20) - 1)  # sums of either part stay far under 2**53, so they are exact
        total += np.bincount(doc, weights=high, minlength=len(total)).astype(np.int64) << 20
        total += np.bincount(doc, weights=low, minlength=len(total)).astype(np.int64)
        n = np.bincount(doc, minlength=len(total))
        return np.where(n > 0, np.rint(self.scale * total / (n + CALM)), NOTHING).astype(np.int64)

    def without(self, text: str) -> int:
        """Log weight in millionths of a good labelled text as if it were not in the target model."""
        cell, n = np.unique(features([text])[0], return_counts=True)
        if not len(cell):
            return NOTHING
        total = n @ self._ratio(np.maximum(0, self.target[cell] - n), self.raw[cell], self.target.sum() - n.sum())
        return int(np.rint(self.scale * total * _UNIT / (n.sum() + CALM)))

    def calibrate(self, judged: list[tuple[int, int]]) -> None:
        """Scale and threshold from labelled rows (weight, 1 or 0) of a model with scale 1."""
        at = threshold(judged)
        if at is not None:
            middle = [float(np.median([w for w, y in judged if y == label])) for label in (1, 0)]
            self.scale = SPREAD * _UNIT / max(middle[0] - middle[1], _UNIT / 1000)
            self.at = math.ceil(at * self.scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> Model:
    """Both models in one pass over the documents. ``labels``: id_col and ``label_col`` (1 is good)."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().orderBy(F.xxhash64("id"), "id", "y").limit(max_labels).collect()
    labelled = {r.id: int(r.y == 1) for r in known}
    good = {i for i, y in labelled.items() if y}
    shared = spark.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                cells, doc = features(texts(batch.column(1)))
                is_good = np.array([i in shared.value for i in batch.column(0).to_pylist()], bool)
                raw += np.bincount(cells, minlength=BUCKETS)
                if is_good.any():
                    target += np.bincount(cells[is_good[doc]], minlength=BUCKETS)
        if raw.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], ["cell", "raw", "target"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = source.mapInArrow(count, "cell int, raw long, target long").groupBy("cell").agg(F.sum("raw"), F.sum("target")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for cell, r, t in rows:
        raw[cell], target[cell] = r, t
    model = Model(raw, target)
    if 0 < len(good) < len(labelled):
        model.calibrate(_judged(source, model, labelled))
    return model


def _judged(source: DataFrame, model: Model, labelled: dict[int, int]) -> list[tuple[int, int]]:
    """(weight, label) of the labelled documents; of several rows with one id the least weight."""
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(model)
    chosen = F.broadcast(spark.createDataFrame(list(labelled.items()), "label_id long, y int"))  # MAX_LABELS rows at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                many, y = texts(batch.column(1)), batch.column(2).to_pylist()
                weight = shared.value.weights(many).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([shared.value.without(t) if z else w for t, z, w in zip(many, y, weight, strict=True)], pa.int64())], ["id", "y", "w"])

    rows = source.join(chosen, F.col("id") == F.col("label_id")).select("id", "text", "y").mapInArrow(judge, "id long, y int, w long")
    return [(r.w, r.y) for r in rows.groupBy("id", "y").agg(F.min("w").alias("w")).collect()]


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str, names: list[str], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``docs`` and two more, called ``names``: weight and key."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, text_col, 2 << 20):
                many = texts(batch.column(batch.schema.get_field_index(text_col)))
                ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).to_pylist()
                weight = shared.value.weights(many)
                key = weight + np.array([gumbel(f"{i}:".encode() + xxhash.xxh3_64_digest(t)) for i, t in zip(ids, many, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(weight), pa.array(key)], [*kept, *names])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), *(StructField(n, LongType()) for n in names)]))


def threshold(judged: list[tuple[int, int]]) -> int | None:
    """The weight that tells rows (weight, label) apart best, midway to the next lower row; of equally good ones the lowest. None without both labels."""
    rows = sorted(judged)
    good, bad = sum(y for _, y in rows), sum(not y for _, y in rows)
    if not good or not bad:
        return None
    best, at, below = -1.0, 0, [0, 0]
    for i, (w, y) in enumerate(rows):
        if i == 0 or w != rows[i - 1][0]:
            value = (good - below[1]) / good + below[0] / bad
            if value > best + 1e-12:
                best, at = value, w if i == 0 else (rows[i - 1][0] + w + 1) // 2
        below[y] += 1
    return at


def least_key(rows: DataFrame, names: list[str], model: Model) -> int | None:
    """The key of the last document drawn; None if all are."""
    weight, key = names
    return None if model.at is None else kth_largest(rows, key, rows.where(F.col(weight) >= model.at).count())


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a whole-number column; None if there are fewer rows. Each round narrows the range 1024-fold."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    left = k  # rank of the value sought from above, within low..high
    while low < high:
        width = max(1, -(-(high - low + 1) // 1024))
        bins = rows.where(F.col(column).between(low, high)).groupBy(F.expr(f"(`{column}` - {low}L) div {width}L").alias("bin")).count().collect()
        for b, c in sorted(bins, reverse=True):
            if left <= c:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            left -= c
    return low


def drawn(rows: DataFrame, names: list[str], model: Model) -> DataFrame:
    if model.at is None:
        return rows
    least = least_key(rows, names, model)
    return rows.where(F.col(names[1]) >= least) if least is not None else rows.limit(0)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, log_weight and sample_key of the documents drawn."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    model = fit(source, labels.withColumnRenamed(id_col, "doc_id"), **options)
    names = ["weight", "key"]
    keys = written(_scored(source, model, "doc_id", "text", names, ["doc_id"]))
    return drawn(keys, names, model).select("doc_id", (F.col("weight") / _UNIT).alias("log_weight"), (F.col("key") / _UNIT).alias("sample_key"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns; they are written once with their keys and read back."""
    model = fit(docs, labels, id_col, text_col, **options)
    names = [fresh(docs, n) for n in ("weight", "key")]
    rows = written(_scored(docs, model, id_col, text_col, names, docs.columns))
    return drawn(rows, names, model).select(*(F.col(f"`{c}`") for c in docs.columns))
