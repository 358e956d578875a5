"""Vector codes: each vector in ``PARTS`` parts, each part by the nearest entry of its codebook, found by the filtering form of Lloyd's rounds.

The table is cut into blocks of at most ``BLOCK`` vectors. Each block gets a kd-tree for each part, whose nodes keep their bounding box, the
sum of their points and (by their place) the number of them; blocks and trees are written once. A round passes the codebooks, a few hundred
entries, down every tree. At a node an entry goes if another is at least as near to every point of the box (nearer, or of a lower index);
where one is left, the whole subtree is assigned at once by the cached sum and count. In leaves the entries left are compared point by point.
All arithmetic is on whole numbers, so any partitioning gives the same result. Only codebooks and their sums reach the driver.

Cases: a null vector and one with a null or non-finite component are dropped. A component beyond ``most(width)`` / 1024, about a hundred
thousand, counts as that bound, so that every squared distance fits a long. The width is that of the first kept row by vec_id; rows of another width come back with
null code and error and take no part. A width that four does not divide is cut at floor(i * width / 4). Rows are ordered by vec_id (null last),
then components, so repeated ids give an entry each. Fewer than 256 rows give as many entries. Equal labels share ``label_error``, null being one label. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gleaner.llm.common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block, points in a leaf.
BLOCK, LEAF = 1 << 13, 32
#: A label with more than one of so many rows is joined by broadcast, of which there are fewer than this.
HOT = 64

_TREE = pa.struct([("order", pa.list_(pa.int32())), ("points", pa.list_(pa.int32())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])
_TREES = "array<struct<order:array<int>,points:array<int>,low:array<int>,high:array<int>,sums:array<bigint>>>"


def most(width: int) -> int:
    """Largest magnitude of a whole component for which squared distances of vectors fit a long."""
    return 1 << (30 - (max(1, width - 1).bit_length() + 1) // 2)


def cuts(width: int) -> list[int]:
    return [i * width // PARTS for i in range(PARTS + 1)]


class Tree:
    """A balanced kd-tree: node ``at`` of a level has the points from ``at * n >> level`` up to the next node's."""

    def __init__(self, order, points, low, high, sums):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums

    @staticmethod
    def depth(n: int) -> int:
        return max(0, (n - 1) // LEAF).bit_length()

    @staticmethod
    def first(n: int, level: int, at: int) -> int:
        return at * n >> level

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        """Of at least one point; the widest side of each box is cut at the median."""
        n, depth = len(points), cls.depth(len(points))
        order = np.arange(n)
        for level in range(depth):
            for at in range(1 << level):
                a, b, mid = cls.first(n, level, at), cls.first(n, level, at + 1), cls.first(n, level + 1, 2 * at + 1)
                own = points[order[a:b]]
                if own.shape[1] and 0 < mid - a < b - a:
                    side = np.argmax(own.max(0) - own.min(0))
                    order[a:b] = order[a:b][np.argpartition(own[:, side], mid - a, kind="introselect")]
        points = points[order]
        firsts = [cls.first(n, depth, at) for at in range(1 << depth)]
        levels = [(np.minimum.reduceat(points, firsts), np.maximum.reduceat(points, firsts), np.add.reduceat(points, firsts))]
        for _ in range(depth):
            low, high, sums = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
        return cls(order, points, *(np.concatenate(x) for x in zip(*levels, strict=True)))

    def row(self) -> dict:
        return {"order": self.order.astype(np.int32), **{k: getattr(self, k).astype(np.int32).ravel() for k in ("points", "low", "high")}, "sums": self.sums.ravel()}

    @classmethod
    def of(cls, row: pa.StructScalar, width: int) -> Tree:
        array = lambda k: row[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        order = array("order")
        nodes = (2 << cls.depth(len(order))) - 1
        return cls(order, array("points").reshape(len(order), width), *(array(k).reshape(nodes, width) for k in ("low", "high", "sums")))

    def subtrees(self, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(node, first and last point, entries left) of the subtrees with one entry left and of the leaves with more."""
        n, depth = len(self.order), self.depth(len(self.order))
        squares = (book * book).sum(1)
        todo = [(0, 0, np.arange(len(book)))]
        while todo:
            level, at, left = todo.pop()
            node = (1 << level) - 1 + at
            if len(left) > 1:
                low, high = self.low[node], self.high[node]
                gap = book[left] - ((low + high) >> 1)
                best = left[np.argmin((gap * gap).sum(1))]
                way = book[left] - book[best]
                least = squares[left] - squares[best] - 2 * np.maximum(way * low, way * high).sum(1)  # of the difference in squared distance over the box
                left = left[(least < 0) | (least == 0) & (left <= best)]
            if len(left) == 1 or level == depth:
                yield node, self.first(n, level, at), self.first(n, level, at + 1), left
            else:
                todo += [(level + 1, 2 * at, left), (level + 1, 2 * at + 1, left)]

    def nearest(self, first: int, last: int, book: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The entry of each point, of those left."""
        points, entries = self.points[first:last], book[left]
        top = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
        kind = np.float64 if 4 * max(1, points.shape[1]) * int(top) ** 2 < 1 << 53 else np.int64  # either is exact
        points, entries = points.astype(kind), entries.astype(kind)
        return left[np.argmin((entries * entries).sum(1) - 2 * (points @ entries.T), axis=1)]

    def add_to(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Sums and counts of the points of each entry."""
        for node, first, last, left in self.subtrees(book):
            if len(left) == 1:
                sums[left[0]] += self.sums[node]
                counts[left[0]] += last - first
            else:
                entry = self.nearest(first, last, book, left)
                np.add.at(sums, entry, self.points[first:last])
                counts += np.bincount(entry, minlength=len(counts))

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the order in which the points were given."""
        entry = np.empty(len(self.order), np.int64)
        for _, first, last, left in self.subtrees(book):
            entry[first:last] = left[0] if len(left) == 1 else self.nearest(first, last, book, left)
        error = ((self.points - book[entry]) ** 2).sum(1)
        codes, errors = np.empty_like(entry), np.empty_like(error)
        codes[self.order], errors[self.order] = entry, error
        return codes, errors


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and whole components ``v`` of the rows that take part in any way."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.cast("array<double>").alias("x"))
    rows = rows.where("x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    bound = most(1)
    return rows.select("vec_id", "label", F.expr(f"transform(x, c -> CAST(floor({SCALE} * greatest(least(c, {bound / SCALE}D), {-bound / SCALE}D)) AS INT))").alias("v"))


def _first_rows(rows: DataFrame) -> list[list[int]]:
    """Components of the ENTRIES first rows that are as wide as the first."""
    ordered = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v")
    found = [r.v for r in ordered.limit(ENTRIES).collect()]
    if found and any(len(v) != len(found[0]) for v in found):
        found = [r.v for r in ordered.where(F.size("v") == len(found[0])).limit(ENTRIES).collect()]
    return found


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row a block: ids, labels and the trees of the parts."""
    at, bound = cuts(width), most(width)
    types = [rows.schema["vec_id"].dataType, rows.schema["label"].dataType]

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        v = whole.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(whole.num_rows, width).clip(-bound, bound)
        trees = [Tree.over(v[:, a:b]).row() for a, b in itertools.pairwise(at)]
        ends = pa.array([0, whole.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(ends, whole.column(i)) for i in (0, 1)), pa.array([trees], pa.list_(_TREE))], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, BLOCK - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == BLOCK:
                    yield build(held)
                    held, n = [], 0
        if n:
            yield build(held)

    return rows.where(F.size("v") == width).mapInArrow(run, StructType([StructField("ids", ArrayType(types[0])), StructField("labels", ArrayType(types[1])), StructType.fromDDL(f"trees {_TREES}")["trees"]]))


def _trees(batch: pa.RecordBatch, at: list[int]) -> Iterator[tuple[int, list[Tree]]]:
    column = batch.column(batch.schema.get_field_index("trees"))
    for i in range(batch.num_rows):
        yield i, [Tree.of(column[i][p], at[p + 1] - at[p]) for p in range(PARTS)]


def _round(blocks: DataFrame, books: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """The codebooks after one more assignment; the driver gets the sums of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, trees in _trees(batch, at):
                for p, tree in enumerate(trees):
                    tree.add_to(books[p], sums[p], counts[p])
        for p in range(PARTS):
            entry, place = (x.ravel() for x in np.indices(sums[p].shape))
            used = counts[p][entry] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (np.full(len(entry), p), entry, place, sums[p].ravel(), counts[p][entry])], ["part", "entry", "place", "total", "n"])

    rows = blocks.select("trees").mapInArrow(run, "part long, entry long, place long, total long, n long")
    new = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one for each component of the codebooks
        new[r.part][r.entry, r.place] = r.total // r.n
    return new


def _assigned(blocks: DataFrame, books: list[np.ndarray], at: list[int], vec_id: StructField, label: StructField) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in _trees(batch, at):
                found = [tree.codes(books[p]) for p, tree in enumerate(trees)]
                code = ["".join(f"{x:02x}" for x in row) for row in np.stack([c for c, _ in found], 1).tolist()]
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, StructType([vec_id, label, StructField("code", StringType()), StructField("error", LongType())]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error of all rows with the same label. Frequent labels are few and are broadcast; the rows of any other are few and are shuffled."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    share = (sums.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(sums.where(F.col("n") > share).select(F.col("label").alias("l"), "label_error"))  # fewer than HOT rows
    rare = sums.where(F.col("n") <= share).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    often = coded.join(hot, same, "inner")
    return often.unionByName(coded.join(hot, same, "left_anti").join(rare, same, "inner")).drop("l")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector kept."""
    rows = _kept(vectors, id_col, vector_col, label_col)
    seeds = _first_rows(rows)
    width = len(seeds[0]) if seeds else 0
    at = cuts(width)
    seed = np.array(seeds, np.int64).reshape(len(seeds), width).clip(-most(width), most(width))
    books = [seed[:, a:b] for a, b in itertools.pairwise(at)]
    blocks = written(_blocks(rows, width))
    for _ in range(ROUNDS if seeds else 0):
        books = _round(blocks, books, at)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = written(_assigned(blocks, books, at, rows.schema["vec_id"], rows.schema["label"]))
    discard(blocks)
    other = rows.where(F.size("v") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return with_label_error(coded.unionByName(other)).withColumn("codebooks_sha256", F.lit(digest))


def summary(coded: DataFrame) -> DataFrame:
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The same by comparing every part with every entry; doubles hold these whole numbers exactly."""
    parts = "SELECT vec_id, label, p, list_transform(x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4], lambda c: floor(1024 * c)) AS v FROM kept, (SELECT unnest(range(4)) AS p)"
    pick = "SELECT a.vec_id, a.label, a.p, a.v, arg_min(b.e, (list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), b.e)) AS e FROM parts a JOIN {book} b ON a.p = b.p GROUP BY a.vec_id, a.label, a.p, a.v"
    steps = [
        "kept AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"parts AS MATERIALIZED ({parts})",
        "book0 AS MATERIALIZED (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    for i in range(ROUNDS):
        steps.append(f"near{i} AS MATERIALIZED ({pick.format(book=f'book{i}')})")
        means = f"SELECT p, e, list(m ORDER BY place) AS v FROM (SELECT p, e, place, floor(sum(c) / count(*)) AS m FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY p, e, place) GROUP BY p, e"
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, coalesce(m.v, b.v) AS v, b.e FROM book{i} b LEFT JOIN ({means}) m ON m.p = b.p AND m.e = b.e)")
    last = f"book{ROUNDS}"
    steps += [
        f"final AS MATERIALIZED ({pick.format(book=last)})",
        f"coded AS (SELECT f.vec_id, any_value(f.label) AS label, string_agg(printf('%02x', f.e), '' ORDER BY f.p) AS code, CAST(sum(list_inner_product(f.v, f.v) - 2 * list_inner_product(f.v, b.v) + list_inner_product(b.v, b.v)) AS BIGINT) AS error FROM final f JOIN {last} b ON f.p = b.p AND f.e = b.e GROUP BY f.vec_id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS d FROM {last})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM coded"


ORACLE_SQL = _oracle()
