"""SimHash near duplicates by deletion-variant signatures.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits have a segment that
differs in at most one, so they share the segment itself or one of its 32 variants with one bit wildcarded. All variants are
indexed, joined by equality and verified on the whole 64 bits.

Only distinct fingerprints enter the index, so exact copies cost one entry. A bucket of the index with more than
``PAIR_LIMIT`` members makes no pairs: its members are indexed once more by the other segment with one bit wildcarded (two bits where the
first segment is equal). Whoever shares such a key differs in those two bits at most; a key has four members at most. So the rows stay in
proportion to the fingerprints, and no link is lost. Components are found by alternating large and small stars on
distinct fingerprints, each round written to the shared folder.

Cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; fewer than
``shingle`` words make one shingle. Repeated rows share their component. A null doc_id gets a row and its component, and
never names a component that has another id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.llm.common import discard, fresh, slices, texts, written

SHINGLE_WORDS = 3
SEED = 42
#: Buckets up to this size are paired directly; larger ones are refined.
PAIR_LIMIT = 64


def shingle_hashes(text: str, shingle: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``shingle`` words, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]


def fingerprints_of(many: list[str], shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 fingerprints: a bit is set if it is set in over half of the hashes."""
    hashes = [shingle_hashes(t, shingle) for t in many]
    counts = np.array([len(h) for h in hashes], np.int64)
    out, done = np.zeros(len(many), np.uint64), 0
    full = np.flatnonzero(counts)
    step = 1 << 17  # hashes whose bits are laid out at once
    flat = np.array([x for h in hashes for x in h], np.uint64)
    bounds = np.concatenate([[0], np.cumsum(counts[full])])
    for k, doc in enumerate(full):
        if k and bounds[k] < done:
            continue
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + step, "right")) - 1)
        if last == k + 1 and counts[doc] > step:  # one very long text, in parts
            ones = sum(np.unpackbits(flat[i : min(i + step, bounds[last])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(bounds[k], bounds[last], step))[None]
        else:
            bits = np.unpackbits(flat[bounds[k] : bounds[last]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, bounds[k:last] - bounds[k], axis=0, dtype=np.int32)
        over = 2 * ones > counts[full[k:last]][:, None]
        out[full[k:last]] = np.packbits(over, axis=1, bitorder="little").copy().view(np.uint64).ravel()
        done = bounds[last]
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of ``df`` and the fingerprint as a signed 64-bit number; ``out_col`` must be a new name."""
    names = df.columns
    if fresh(df, out_col) != out_col:
        raise ValueError(f"there is a column {out_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, text_col, 2 << 20):
                fp = fingerprints_of(texts(batch.column(batch.schema.get_field_index(text_col))), shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, LongType())]))


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """a < b: pairs of the distinct fingerprints in ``fp`` whose links join all that are within two bits.

    Every pair within two bits is linked, directly or through others of its bucket that are within two bits as well.
    """
    # variant i < 64: bit i wildcarded in its segment; 64 and 65: a whole segment. The number leads the key.
    variants = "transform(sequence(0, 65), i -> struct(i, CASE WHEN i < 64 THEN (shiftright(fp, IF(i < 32, 0, 32)) & 4294967295L) & ~shiftleft(1L, i % 32) ELSE shiftright(fp, IF(i = 64, 0, 32)) & 4294967295L END | shiftleft(CAST(i AS BIGINT), 32)))"
    keyed = fps.selectExpr("fp", f"explode({variants}) AS v").selectExpr("fp", "v.i AS i", "v.col2 AS key")
    keyed = keyed.repartition("key")  # the count and the join below both use this one exchange
    shared = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    near = "bit_count(a ^ b) <= 2"
    some = shared.where(F.col("n") <= pair_limit)
    # a pair whose segments differ in bit i meets under variant i; one whose segments are equal under the whole segment
    pairs = some.select("key", "i", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where("a < b").where(near).where("IF(i < 64, getbit(a, i) != getbit(b, i), true)").select("a", "b")
    many = shared.where(F.col("n") > pair_limit).drop("n")
    # the other segment's bits: 32..63 for variants of the low segment, else 0..31
    one = many.where("i < 64").selectExpr("fp", "i", "explode(transform(sequence(0, 31), j -> j + IF(i < 32, 32, 0))) AS j").selectExpr("fp", "least(i, j) AS i", "greatest(i, j) AS j")
    two = many.where("i >= 64").selectExpr("fp", "IF(i = 64, 32, 0) AS base").selectExpr("fp", "base", "explode(sequence(0, 30)) AS x").selectExpr("fp", "base", "x", "explode(sequence(x + 1, 31)) AS y").selectExpr("fp", "base + x AS i", "base + y AS j")
    free = one.unionByName(two).selectExpr("fp", "i", "j", "fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) AS fixed")
    stars = free.groupBy("i", "j", "fixed").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    spokes = stars.selectExpr("array_min(members) AS a", "explode(members) AS b").where("a < b")
    return pairs.unionByName(spokes).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable. Stars alternate until nothing changes, as often as it takes; a node without edges is absent."""
    seen, edges = None, written(edges.select("a", "b"))
    while True:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("m AS a", "b").where("a != b").distinct()
        down = large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").selectExpr("m AS a", "b").where("a != b").unionByName(low.selectExpr("m AS a", "a AS b")).distinct()
        before, edges = edges, written(small)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.selectExpr("b AS node", "a AS label").unionByName(edges.selectExpr("a AS node", "a AS label").distinct())
        seen = now


def _labelled(ids: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """fp, low, label for the table ``ids`` (doc_id, fp): the fingerprint's smallest doc_id, and the smallest fingerprint that links reach."""
    low = written(ids.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = component_labels(links(low.select("fp"), pair_limit))
    return low.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))


def _named(labelled: DataFrame) -> DataFrame:
    """fp, label, component_id: the smallest doc_id of the label's rows; it is null or shared by labels where ids are."""
    least = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    return labelled.join(least, "label").select("fp", "label", "component_id")


def components(ids: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """fp, component_id for the table ``ids`` (doc_id, fp): the smallest doc_id that links reach."""
    return _named(_labelled(ids, pair_limit)).select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id."""
    ids = written(with_fingerprint(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", "fp", shingle).select("doc_id", "fp"))
    return ids.join(components(ids, pair_limit), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``df`` that bear the smallest id of their component, one row for each component.

    Components are told apart by their fingerprints, as ids may be null or repeat. Of a component's rows that repeat this
    id, the one with the smallest hash of its text stays, and of rows that repeat both the one with the smallest hash of all its columns (of
    maps none). Columns of any name are kept as they are.
    """
    texts_ = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    ids = written(with_fingerprint(texts_, "text", "fp", shingle).select("doc_id", "fp", "tie"))
    kept = ids.join(_named(_labelled(ids.select("doc_id", "fp"))), "fp").where("doc_id <=> component_id")
    kept = kept.groupBy("label").agg(F.min(F.struct("tie", "doc_id")).alias("k"), F.count("*").alias("n"))
    of_id, of_tie, count, tie = (fresh(df, n) for n in ("kept_id", "kept_tie", "kept_n", "tie"))
    kept = kept.select(F.col("k.doc_id").alias(of_id), F.col("k.tie").alias(of_tie), F.col("n").alias(count))
    names = [F.col(f"`{n}`") for n in df.columns]
    rows = df.withColumn(tie, F.xxhash64(F.col(f"`{text_col}`")))
    joined = rows.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(of_id)) & (F.col(tie) == F.col(of_tie)))
    alone = joined.where(F.col(count) == 1).select(*names)
    told = F.xxhash64(*(F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind))
    repeated = joined.where(F.col(count) > 1).groupBy(of_id, of_tie).agg(F.min_by(F.struct(*names), told).alias(of_tie + "_row")).select(f"{of_tie}_row.*")
    return alone.unionByName(repeated)
