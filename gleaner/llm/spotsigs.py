"""SpotSigs: documents compared by the chains of content words that follow common words.

Each common word (an anchor) begins a signature: the anchor and the next ``CHAIN`` content words after it, every
``DISTANCE``-th of them. A fingerprint is the set of the signatures' hashes. Two fingerprints are compared by Jaccard
similarity. ``near_duplicates`` never joins sets whose sizes alone forbid the threshold (partition by set length);
``compare_with_edits`` has its pairs given and no threshold, so it compares them all in full.

A text with fewer than ``MIN_ANCHORS`` anchors has each of its words as an anchor and each as content, so that lists, code and unknown
languages have fingerprints too. A text too short for a chain has its whole sequence of words as the one signature; a text
without words has the empty set, which is like another empty set (1) and nothing else (0).

Cases: a null text counts as empty. Equal texts have equal fingerprints. Repeated rows are documents of their own. A
null doc_id is the lowest. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import offsets_of, slices, texts, written

#: Anchors: the commonest function words of English, French, German and Spanish.
ANCHORS = frozenset(
    "the of and to in a is that for it as was with on be by he this are or from "
    "le la les de des du un une et en que qui dans pour est sur par "
    "der die das und den dem ein eine ist zu mit von nicht auf für "
    "el los las y del al se no una con su para es lo por".split()
)
CHAIN, DISTANCE, MIN_ANCHORS = 2, 1, 4
#: The similarity from which documents are near duplicates.
THRESHOLD = 0.8
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x * _MIX) ^ (y + (x >> np.uint64(29)))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def signatures(many: list[str], anchors: frozenset[str] = ANCHORS, chain: int = CHAIN, distance: int = DISTANCE, min_anchors: int = MIN_ANCHORS) -> list[np.ndarray]:
    """Each text's sorted distinct 32-bit signatures."""
    words = [_WORD.findall(t.lower()) for t in many]
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    common = np.fromiter((w in anchors for w in number), bool, len(number))
    if not len(flat):
        return [np.zeros(0, np.uint32) for _ in many]
    h, is_anchor = hashes[codes], common[codes]
    doc = np.repeat(np.arange(len(many)), n)
    few = np.bincount(doc, weights=is_anchor, minlength=len(many)) < min_anchors
    is_content = ~is_anchor | few[doc]
    is_anchor = is_anchor | few[doc]
    content = np.flatnonzero(is_content)  # places of content words
    starts = np.flatnonzero(is_anchor)
    k = np.searchsorted(content, starts, "right")  # the first content word after the anchor
    last = k + distance * (chain - 1)
    whole = last < len(content)
    starts, k, last = starts[whole], k[whole], last[whole]
    same = doc[content[last]] == doc[starts]
    starts, k = starts[same], k[same]
    sig = h[starts]
    for step in range(chain):
        sig = _mixed(sig, h[content[k + distance * step]])
    owner = doc[starts]
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
    bounds = np.searchsorted(keyed, np.arange(len(many) + 1, dtype=np.uint64) << np.uint64(32))
    low = (keyed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = [low[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for i in np.flatnonzero((np.diff(bounds) == 0) & (n > 0)):
        out[i] = np.array([xxhash.xxh32_intdigest(" ".join(words[i]))], np.uint32)
    return out


def as_string(sigs: np.ndarray) -> str:
    """Eight hexadecimal digits a signature, ascending."""
    return sigs.astype(">u4").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 if it is under ``threshold``, without a look at the members where the sizes say so."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < threshold * large:  # the lengths alone decide
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    value = shared / (small + large - shared)
    return value if value >= threshold else 0.0


def with_next(df: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """doc_id, packed and next_packed: the text and that of the next row in descending doc_id; after the last comes the first.

    Texts move compressed (zstd, each by itself), which about halves what is shuffled; ``unpacked`` reads them. A null stays null.
    Rows are dealt into ranges of doc_id. Within a range a window reads the neighbour; at its lower end the
    neighbour is the top row of the range below, of which there is one a range. Rows that share an id are ordered by their texts' hash.
    """
    spark = df.sparkSession
    n_blocks = n_blocks or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    found = source.agg(F.percentile_approx("doc_id", [i / n_blocks for i in range(1, n_blocks)], 100_000)).first()[0]
    bounds = np.array(sorted(set(found or [])), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(bounds, batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            squeeze = zstandard.ZstdCompressor(level=3).compress
            packed = pa.array([None if t is None else squeeze(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2), pa.array(block, pa.int32())], ["doc_id", "packed", "tie", "block"])

    placed = source.mapInArrow(place, "doc_id long, packed binary, tie long, block int")
    in_block = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), F.asc("tie"))
    inside = placed.withColumn("below", F.lag(F.struct("packed")).over(in_block))
    tops = written(placed.groupBy("block").agg(F.max_by(F.struct("packed"), F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie")).alias("top")))
    numbers = tops.select("block")  # n_blocks rows at most
    below = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy()))
    edges = numbers.select("block", below.alias("under")).join(tops.withColumnRenamed("block", "under"), "under").select("block", "top")
    return inside.join(edges, "block").select("doc_id", "packed", F.coalesce("below", "top")["packed"].alias("next_packed"))


def unpacked(column: pa.Array) -> list[str]:
    """Texts of a packed column; null counts as empty."""
    open_ = zstandard.ZstdDecompressor().decompress
    return ["" if x is None else open_(x).decode() for x in column.to_pylist()]


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as many code points of the next document's beginning."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "packed", 1 << 20):
                text, following = unpacked(batch.column(1)), unpacked(batch.column(2))
                edited = [edited_text(t, f) for t, f in zip(text, following, strict=True)]
                distinct = list(dict.fromkeys([*text, *following, *edited]))  # the next document mostly is in the same slice
                of = dict(zip(distinct, signatures(distinct), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t) for t in text], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([as_string(of[t]) for t in text], pa.string()),
                        pa.array([as_string(of[e]) for e in edited], pa.string()),
                        pa.array([pruned_jaccard(of[t], of[e]) for t, e in zip(text, edited, strict=True)], pa.float64()),
                        pa.array([pruned_jaccard(of[t], of[f]) for t, f in zip(text, following, strict=True)], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    pairs = with_next(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return pairs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``sigs``: the sorted distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", 4 << 20):
                sigs = signatures(texts(batch.column(1)))
                flat = np.concatenate([np.zeros(0, np.uint32), *sigs]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets_of([len(x) for x in sigs]).astype(np.int32)), pa.array(flat))], ["doc_id", "sigs"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, sigs array<long>")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class) and pairs (a, b, similarity) of classes, a < b, whose similarity is ``threshold`` or more.

    A class holds the documents of one fingerprint and is named by its smallest doc_id. Sets are dealt by length: each
    range of lengths meets itself and the next one up. A set is indexed by its rarest signatures, as many as two sets
    must share one of, so that common chains make no candidates.
    """
    docs = written(fingerprints(df, id_col, text_col))
    classes = written(docs.groupBy("sigs").agg(F.min("doc_id").alias("class")).withColumn("n", F.size("sigs")))
    members = docs.join(classes.select("sigs", "class"), "sigs").select("doc_id", "class")
    each = classes.where("n > 0").select("class", "n", F.explode("sigs").alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("df"))
    ordered = each.join(seen, "sig").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    prefix = f"CAST(n - ceil({threshold} * n - 1e-9) + 1 AS INT)"
    level = f"CAST(floor(ln(n) / -ln({threshold})) AS INT)" if threshold < 1 else "n"
    index = written(ordered.selectExpr("class", "n", f"{level} AS level", f"explode(slice(s, 1, {prefix})) AS x").selectExpr("class", "n", "level", "x.sig AS sig"))
    probe = index.selectExpr("class AS a", "n AS na", "sig", "explode(array(level, level + 1)) AS level") if threshold < 1 else index.selectExpr("class AS a", "n AS na", "sig", "level")
    fits = f"least(n, na) >= {threshold} * greatest(n, na) - 1e-9"
    found = probe.join(index, ["sig", "level"]).where("a != class").where(fits).selectExpr("least(a, class) AS a", "greatest(a, class) AS b").distinct()
    left, right = (classes.select(F.col("class").alias(k), F.col("sigs").alias(f"s{k}")) for k in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return members, found.join(left, "a").join(right, "b").select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
