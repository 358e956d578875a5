"""All pairs of short texts whose trigram sets are alike: a set-similarity join that compares rare trigrams only.

Texts in comparison form become sets of trigrams, each a whole number of three code points. Equal sets are one class. The trigrams of a
class are put in one order for all, rarest first. Two sets of similarity ``threshold`` share a trigram among the first n - ceil(threshold * n) + 1 of
each, and of the smaller of the two a shorter start will do, the shorter the larger the other is; so only these starts are joined, by trigram and range of
sizes. Sizes too different, places too late in the order and bitmaps too different are cut off in the join; the few pairs left are compared in full.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.functions import text as T
from gleaner.operators.skew import with_group
from gleaner.sources.scratch import stored

#: Trigrams with more than one of so many places are ranked by frequency, of which there are fewer than this; all others are rarer and come first.
RANKED = 1 << 16
#: Longs of a bitmap, of which ranges of sizes that begin at LARGE or below use half; a bitmap much smaller than its set tells little.
WORDS, LARGE = 8, 100
#: Trigrams that a worker puts in order at a time, besides those of one set.
AT_ONCE = 1 << 17
_WORDS = [f"w{i}" for i in range(WORDS)]
_NEAR = 1e-9


@dataclass(frozen=True)
class Similar:
    """``pairs``: a, b (class ids), similarity. ``members``: id, class_id, n_links, the number of other rows that are alike: a row for each row of the input."""

    pairs: DataFrame
    members: DataFrame


def trigram_numbers(canon: str) -> np.ndarray:
    """The distinct trigrams of a text in comparison form, ascending."""
    x = np.frombuffer(canon.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.empty(0, np.int64)


def _sets(texts: DataFrame, kind: str) -> DataFrame:
    """id, digest and grams of (id, canon)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                grams = [trigram_numbers(t or "") for t in part.column(1).to_pylist()]
                digests = pa.array([hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grams], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.array(grams, pa.list_(pa.int64()))], ["id", "digest", "grams"])

    return texts.mapInArrow(run, f"id {kind}, digest binary, grams array<bigint>")


def _ranges(threshold: float, longest: int) -> np.ndarray:
    """The first size of each range of sizes, the last one beyond ``longest``; a size meets about three ranges of sizes that are not smaller."""
    first = [1]
    while first[-1] <= longest:
        first.append(min(max(first[-1] + 1, math.ceil(first[-1] / math.sqrt(threshold))), longest + 1))
    return np.array(first)


def bitmaps(grams: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """The longs (2, 4, 8 ...) of a bitmap for each of the sets that begin at ``starts`` of ``grams``: a bit tells whether an odd number of trigrams falls on it.

    A trigram that only one of two sets has turns one bit, so the bitmaps differ in no more bits than the sets in trigrams.
    """
    bit = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59 - words.bit_length())
    one = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), starts).view(np.int64) for w in range(words)]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of (digest, grams) a few at a time: AT_ONCE trigrams and those of one more set at most."""
    size = b.column(1).value_lengths().to_numpy().astype(int)
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // AT_ONCE)) + 1).tolist(), b.num_rows]
    return (b.slice(i, k - i) for i, k in pairwise(cuts) if i < k)


def _prefixes(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """gram, range, digest, size, place and bitmap of the trigrams by which a class as the smaller of two, and as the larger, must meet those that are alike."""
    places, longest = classes.agg(F.sum(F.size("grams").cast("long")), F.max(F.size("grams"))).first()
    counts = classes.select(F.explode("grams").alias("g")).groupBy("g").count()
    frequent = sorted((r.g, r["count"]) for r in counts.where(F.col("count") * RANKED > (places or 0)).collect())  # fewer than RANKED
    shared = classes.sparkSession.sparkContext.broadcast(np.ascontiguousarray(np.array([*frequent, (np.iinfo(np.int64).max, 0)], np.int64).T))
    edges = _ranges(threshold, longest or 0)

    def smaller(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        reach = np.searchsorted(edges, size, "right") - 1
        while True:
            least = np.maximum(edges[np.minimum(reach, len(edges) - 1)], size)
            meets = (reach < len(edges)) & (threshold * least <= size + _NEAR)
            if not meets.any():
                return
            yield reach, np.where(meets, size - np.ceil(threshold / (1 + threshold) * (size + least) - _NEAR).astype(int) + 1, 0)
            reach = reach + 1

    def larger(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.searchsorted(edges, size, "right") - 1, size - np.ceil(threshold * size - _NEAR).astype(int) + 1

    def starts_of(role):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ranks = shared.value
            for b in batches:
                for part in _slices(b):
                    grams = part.column(1).flatten().to_numpy()
                    size = part.column(1).value_lengths().to_numpy().astype(int)
                    own, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                    at = np.searchsorted(known, grams)
                    order = np.lexsort((grams, np.where(known[at] == grams, ranks[at], 0), own))
                    place = np.arange(len(grams)) - begin[own]
                    all_words, half = bitmaps(grams, begin, WORDS), bitmaps(grams, begin, WORDS // 2)
                    half += [np.zeros(len(size), np.int64)] * (WORDS // 2)
                    for reach, first in role(size):
                        i = np.flatnonzero(place < first[own])
                        k = own[i]
                        columns = [grams[order[i]], reach[k].astype(np.int32), part.column(0).take(pa.array(k)), size[k].astype(np.int32), place[i].astype(np.int32), *(np.where(edges[reach[k]] > LARGE, w[k], h[k]) for w, h in zip(all_words, half, strict=True))]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["gram", "range", "digest", "size", "place", *_WORDS])

        return run

    held = classes.where(F.size("grams") > 0).select("digest", "grams")
    kind = "gram long, range int, digest binary, size int, place int, " + ", ".join(f"{w} long" for w in _WORDS)
    return held.mapInArrow(starts_of(smaller), kind), held.mapInArrow(starts_of(larger), kind)


def similar(rows: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text") -> Similar:
    """Rows alike by the Jaccard similarity of their texts' trigrams, ``threshold`` or more; texts without a trigram are alike among themselves.

    A null text counts as empty. Rows that repeat an id are rows of their own. Pairs are between classes of equal sets, named by their smallest id, so many
    copies of a text cost no more than one.
    """
    if not 0 < threshold <= 1:
        raise GleanerError("validation", "threshold must be above 0 and at most 1")
    kind = rows.schema[id_col].dataType.simpleString()
    texts = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text"))
    sets = stored(_sets(texts.select("id", T.canon_column("text").alias("canon")), kind))
    classes = stored(sets.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.first("grams").alias("grams")))
    p, q = (side.select(*(F.col(c).alias(c + x) for c in side.columns)) for side, x in zip(_prefixes(classes, threshold), "ab", strict=True))
    both = F.col("sizea") + F.col("sizeb")
    fits = (F.col("sizea") <= F.col("sizeb")) & (F.col("sizea") >= threshold * F.col("sizeb") - _NEAR)
    room = F.least(F.col("sizea") - F.col("placea"), F.col("sizeb") - F.col("placeb")) >= threshold / (1 + threshold) * both - _NEAR
    first, rest = (sum(F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in words) for words in (_WORDS[: WORDS // 2], _WORDS[WORDS // 2 :]))
    most = (1 - threshold) / (1 + threshold) * both + _NEAR
    once = (F.col("sizea") < F.col("sizeb")) | (F.col("digesta") < F.col("digestb"))
    met = (F.col("grama") == F.col("gramb")) & (F.col("rangea") == F.col("rangeb"))
    candidates = p.join(q, met & fits & room & (first <= most) & (first + rest <= most) & once).select("digesta", "digestb").distinct()
    sides = [classes.select(F.col("digest").alias(f"digest{x}"), F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"grams{x}")) for x in "ab"]
    whole = candidates.join(sides[0], "digesta").join(sides[1], "digestb").withColumn("common", F.size(F.array_intersect("gramsa", "gramsb")))
    found = whole.withColumn("similarity", F.expr("common / (size(gramsa) + size(gramsb) - common)")).where(F.col("similarity") >= threshold)
    pairs = stored(found.select("digesta", "digestb", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb", "similarity"))
    links = pairs.select(F.col("digesta").alias("digest"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("digestb").alias("digest"), F.col("na").alias("m"))).groupBy("digest").agg(F.sum("m").alias("m"))
    values = classes.select("digest", "class_id", "n").join(links, "digest", "left").select("digest", "class_id", "n", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    members = with_group(sets.select("id", "digest"), values, "digest").drop("digest")
    return Similar(pairs.select("a", "b", "similarity"), members)
