"""The fold that drops what is as similar as a threshold to the last one kept, over documents of any length.

Each stretch of a document is folded on its own, as if nothing came before it. Whether a row is kept depends on what came before only
through the last row kept, so a stretch is folded again from the row in which the stretch before it ends, up to the first row that both
chains keep: from there they are one. Only where the chains of a stretch never meet does its end change and the next stretch have
to be folded again; ends are passed on until none changes. Stretches are folded side by side in each round, and in nearly all
texts one round is enough. Of each stretch, of which there are two for each partition at most, the driver holds the last sentence kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gleaner.functions import text as T
from gleaner.operators.extract import ExtractOptions, _alike, _grams, candidates, exact_dedup, rank_units, window_quota
from gleaner.operators.history import fresh
from gleaner.sources.scratch import stored

#: As many units as ``text.target_count`` gives at most.
MOST_UNITS = 90


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in columns), strict=True)


class Chain:
    """A stretch folded from the row in which the one before it ends. ``end`` is the last row kept."""

    def __init__(self, entering: str, threshold: float):
        self.end, self.last, self.threshold, self.met = entering, _grams(entering), threshold, False

    def keeps(self, canon: str, alone: bool) -> bool:
        """Whether the next row is kept; ``alone``: it is if the stretch is folded with nothing before it. Once both chains keep a row, they are one."""
        kept = alone
        if not self.met:
            grams = _grams(canon)
            kept = _alike(self.last, grams) < self.threshold
            if kept:
                self.last, self.met = grams, alone
        if kept:
            self.end = canon
        return kept


def collapse_long(c: DataFrame, threshold: float) -> DataFrame:
    """As ``extract.collapse_near``, with a document's rows in as many tasks as they fill. ``c``: doc_id, start, text, canon and any others; (doc_id, start, text) tells rows apart."""
    keys = ["doc_id", "start", "text"]
    block, kept = fresh(c, "block"), fresh(c, "kept")
    place = {n: c.columns.index(n) for n in ("doc_id", "canon")}

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, last, begun = None, set(), False
        for b in batches:
            flags = []
            for d, canon in _pieces([b], [place["doc_id"], place["canon"]]):
                grams, first = _grams(canon), not begun or d != doc
                flags.append(first or _alike(last, grams) < threshold)
                if flags[-1]:
                    last = grams
                doc, begun = d, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags, pa.bool_())], [*b.schema.names, kept])

    cut = c.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(block, F.spark_partition_id())
    cut = stored(cut.mapInArrow(alone, StructType([*cut.schema.fields, StructField(kept, BooleanType())])))
    spans = cut.groupBy("doc_id").agg(F.min(block).alias("low"), F.max(block).alias("high")).where("low < high").select(F.col("doc_id").alias("d"), "low")  # documents in several blocks, fewer than blocks
    mine = F.broadcast(spans)
    ends = cut.where(kept).join(mine, F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("doc_id", block).agg(F.max_by("canon", F.struct("start", "text")).alias("end")).collect()  # two for each block at most
    chains = defaultdict(list)
    for r in ends:
        chains[r.doc_id].append((r[block], r.end))
    entering, ended, follows = {}, {}, {}  # of a block's first stretch, if its document began in an earlier block: the row before it, its end, the next block with such a stretch of that document
    for own in chains.values():
        own.sort()
        for (_, x), (b, y) in zip(own, own[1:], strict=False):
            entering[b], ended[b] = x, y
        follows |= {a: b for (a, _), (b, _) in zip(own[1:], own[2:], strict=False)}
    later_blocks = sorted(entering)
    order = ["doc_id", block, "canon", kept]

    def stretches(blocks: list[int]) -> DataFrame:
        chosen = F.broadcast(cut.sparkSession.createDataFrame([(b,) for b in blocks], "b int"))
        later = cut.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(block) > F.col("low"))).drop("d", "low").join(chosen, F.col(block) == F.col("b"), "left_semi")
        return later.repartition(F.col(block)).sortWithinPartitions(block, "start", "text")

    todo = later_blocks
    while todo:
        shared = cut.sparkSession.sparkContext.broadcast({b: entering[b] for b in todo})

        def last_kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, rows in groupby(_pieces(batches, [1, 2, 3]), lambda r: r[0]):
                chain = Chain(shared.value[b], threshold)
                for _, canon, on_its_own in rows:
                    chain.keeps(canon, on_its_own)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chain.end])], ["b", "end"])

        found = {r.b: r.end for r in stretches(todo).select(*order).mapInArrow(last_kept, "b int, end string").collect()}
        changed = [b for b in todo if found[b] != ended[b] and b in follows]
        ended |= found
        entering |= {follows[b]: ended[b] for b in changed}
        todo = sorted(follows[b] for b in changed)
    if not later_blocks:
        return cut.where(kept).drop(block, kept)
    final = cut.sparkSession.sparkContext.broadcast(entering)
    at = {n: cut.columns.index(n) for n in (block, "canon", kept)}

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, current = None, None
        for b in batches:
            flags = []
            for x, canon, on_its_own in _pieces([b], [at[block], at["canon"], at[kept]]):
                if x != current:
                    chain, current = Chain(final.value[x], threshold), x
                flags.append(chain.keeps(canon, on_its_own))
            yield b.filter(pa.array(flags, pa.bool_()))

    settled = stretches(later_blocks).mapInArrow(flagged, cut.schema)
    first = cut.where(kept).join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(block) > F.col("low")), "left_anti")
    return first.unionByName(settled).drop(block, kept)


def extract_long_units(df: DataFrame, opts: ExtractOptions = ExtractOptions()) -> DataFrame:
    """As ``extract.extract_units``, for texts whose sentences are too many for a task: nothing but the cutting of one text is done by one task alone.

    ``df``: doc_id, text; as a rule those above some length, all others being cheaper with ``extract_units``, which shuffles once.
    """
    c = exact_dedup(window_quota(candidates(df, opts), opts.per_window_quota))
    kept = collapse_long(c, opts.jaccard_threshold)
    most = opts.target_count if opts.target_count is not None else MOST_UNITS
    target = F.lit(opts.target_count) if opts.target_count is not None else F.expr(T.target_count("n_chars"))
    best = rank_units(kept).where((F.col("rank") <= most) & (F.col("rank") <= target))  # by a fixed bound tasks drop what cannot be among the best before it moves
    return best.select("doc_id", F.expr(T.unit_id("win", "start", "end")).alias("id"), "text", "start", "end", "score", "win", "rank")
