"""Exact repeats of ``SPAN`` bytes and repeated passages of ``PASSAGE`` bytes, by suffix sorting with hash comparisons.

1. Sparse suffixes. Each window of either length has an anchor: the place in it whose GRAM bytes hash lowest. Equal windows
   have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so a ninetieth of all places stand for
   all. An anchor's context is the text of the windows it stands for.
2. Contexts that are equal as a whole, ranges included, by a 128-bit BLAKE2b digest, which nobody can make collide, repeat as a whole;
   their text is not moved.
3. Contexts of equal anchors that differ meet by anchor. There, for each of the two lengths, the suffixes right of the anchors and the
   reversed prefixes left of them are sorted by mergesort; a comparison finds the longest common extension by binary search over
   polynomial prefix hashes, so it takes logarithmic time. Within each class of equal left extension the neighbours in right order
   give the longest match, hence the windows that repeat. What is reported is verified on the bytes.

An anchor shared by more than ``GROUP_LIMIT`` different contexts is not gathered: all its windows are counted by
128-bit hash instead, spread over the cluster. Both ways are exact.

Windows of SPAN bytes that repeat are removed. Passages are only reported: fifty words of prose are under SPAN bytes but over PASSAGE.

Cases: a null text counts as empty. A text shorter than a length has no windows of it. Rows that repeat id and text are
documents of their own, so all their windows repeat. Periodic text repeats within itself. Text of any length is cut into overlapping
pieces, each window lying in one. A null doc_id is a value like any other. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.chunks import spans_index
from gleaner.llm.common import discard, offsets_of, slices, texts, tidy, written

SPAN, PASSAGE, GRAM = 400, 240, 64
#: Different contexts of one anchor that are sorted together.
GROUP_LIMIT = 4096
_PIECE = 1 << 20  # bytes hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0..n, modulo 2**64."""
    size = 1 << max(10, n.bit_length())
    if size not in _tables:
        _tables[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _tables[size]


class PrefixHashes:
    """Hashes of any stretch of the bytes in constant time, modulo 2**64: equal stretches have equal hashes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, leftward: bool = False) -> np.ndarray:
        """Longest common extension from places a and b, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a - mid, mid) == self.of(b - mid, mid) if leftward else self.of(a, mid) == self.of(b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _lowest(hashes: np.ndarray, windows: list[int]) -> list[np.ndarray]:
    """For each width (ascending), the least of the ``width`` values from every place on, by doubling."""
    low, width, out = hashes, 1, []
    for window in windows:
        while width * 2 <= window:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        more = window - width
        out.append(low if not more else np.minimum(low[:-more], low[more:]) if len(low) > more else low[:0])
    return out


def _anchors(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, inside: np.ndarray, spans: tuple[int, int], gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (at most _PIECE bytes): text, anchor, anchor hash, then first and last window of each span (last < first: none).

    ``inside``: only windows that begin before this place of their text count. All places are in ``flat``; ``spans`` descend.
    """
    hashes, n = PrefixHashes(flat), len(flat) - gram + 1
    h = _mixed(hashes.of(np.arange(n), gram))
    low = (h & ~np.uint64(_PIECE * 2 - 1)) | np.arange(n, dtype=np.uint64)  # of equal hashes the first
    runs = []
    for span, lowest in zip(spans, reversed(_lowest(low, [s - gram + 1 for s in reversed(spans)])), strict=True):
        valid = spans_index(starts, np.minimum(inside, np.maximum(0, sizes - span + 1)))
        anchor = (lowest[valid] & np.uint64(_PIECE * 2 - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)])) if len(valid) else valid
        runs.append((anchor[new], valid[new], valid[np.append(new[1:], len(valid)) - 1] if len(valid) else valid))
    every = np.union1d(runs[0][0], runs[1][0])
    ranges = []
    for anchor, first, last in runs:
        at = np.searchsorted(every, anchor)
        ranges += [np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)]
        ranges[-2][at], ranges[-1][at] = first, last
    return np.searchsorted(starts, every, "right") - 1, every, h[every], *ranges


def packed_reach(anchor: np.ndarray, ranges: list[np.ndarray]) -> np.ndarray:
    """Both ranges as distances before the anchor, 9 bits each; 511 where there is none."""
    out = np.zeros(len(anchor), np.int64)
    for k, (first, last) in enumerate(zip(ranges[::2], ranges[1::2], strict=True)):
        some = last >= first
        out |= np.where(some, (anchor - first) | (anchor - last) << 9, 511 | 511 << 9) << 18 * k
    return out


def reach_of(packed: int) -> list[tuple[int, int] | None]:
    """For each span the distances of the first and the last window before the anchor."""
    a, b, c, d = (packed >> s & 511 for s in (0, 9, 18, 27))
    return [(a, b) if a != 511 else None, (c, d) if c != 511 else None]


def context_bounds(packed: int, spans: tuple[int, int]) -> tuple[int, int]:
    """Where the context begins and ends, from the anchor."""
    both = [(-r[0], s - r[1]) for r, s in zip(reach_of(packed), spans, strict=True) if r]
    return min(a for a, _ in both), max(b for _, b in both)


def anchors_of(many: list[bytes], spans: tuple[int, int] = (SPAN, PASSAGE), gram: int = GRAM) -> list[np.ndarray]:
    """Of each anchor: text, place in it, reach, hash, context digest in two halves."""
    pieces: list[list[tuple[int, int, bytes, int]]] = [[]]
    size, step = 0, _PIECE - spans[0] + 1
    for k, data in enumerate(many):
        if len(data) < spans[1]:
            continue
        for at in range(0, max(1, len(data) - spans[0] + 1), step):  # a long text's pieces overlap, and the windows that begin in the overlap are the next one's
            part = data[at : at + _PIECE]
            if size + len(part) > _PIECE:
                pieces.append([])
                size = 0
            pieces[-1].append((k, at, part, step if at + step < len(data) - spans[0] + 1 else len(part)))
            size += len(part)
    out = []
    for piece in pieces:
        if not piece:
            continue
        joined = b"".join(p[2] for p in piece)
        offsets = offsets_of([len(p[2]) for p in piece])
        begins = np.array([p[1] for p in piece], np.int64) - offsets[:-1]
        text, anchor, key, *ranges = _anchors(np.frombuffer(joined, np.uint8), offsets[:-1], np.diff(offsets), np.array([p[3] for p in piece]), spans, gram)
        reach = packed_reach(anchor, ranges)
        low = np.minimum(*(np.where(last >= first, first, len(joined)) for first, last in (ranges[:2], ranges[2:])))
        high = np.maximum(*(np.where(last >= first, last + s, 0) for s, (first, last) in zip(spans, (ranges[:2], ranges[2:]), strict=True)))
        view, digest = memoryview(joined), hashlib.blake2b
        digests = [digest(view[a:b], digest_size=16, salt=r.to_bytes(8, "little")).digest() for a, b, r in zip(low.tolist(), high.tolist(), reach.tolist(), strict=True)]
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
        owner = np.array([p[0] for p in piece], np.int64)[text]
        out.append((owner, anchor + begins[text], reach, key.view(np.int64), *halves))
    return [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(6)]


def suffix_order(hashes: PrefixHashes, data: np.ndarray, group: np.ndarray, place: np.ndarray, most: np.ndarray, leftward: bool) -> np.ndarray:
    """Numbers of the suffixes (or reversed prefixes) at ``place``, of ``most`` bytes each, sorted within their group; groups are contiguous.

    Bottom-up mergesort: each round all suffixes find their rank in the neighbouring run at once by binary search.
    """

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether y comes before x; equal ones as ``ties`` says."""
        bound = np.minimum(most[x], most[y])
        same = hashes.common(place[x], place[y], bound, leftward)
        inside = same < bound
        step = np.where(inside, same, 0)
        a, b = (place[x] - 1 - step, place[y] - 1 - step) if leftward else (place[x] + step, place[y] + step)
        ca, cb = data[np.clip(a, 0, len(data) - 1)], data[np.clip(b, 0, len(data) - 1)]
        return np.where(inside, cb < ca, np.where(most[x] != most[y], most[y] < most[x], ties))

    n = len(group)
    order = np.arange(n)
    first = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - first
    within, run = np.arange(n) - first, 1
    while (size > run).any():
        block = within // run
        other = first + (block ^ 1) * run  # where the neighbouring run begins
        length = np.clip(first + size - other, 0, run)
        odd = block % 2 == 1
        live = np.flatnonzero(length > 0)
        low, high = np.zeros(len(live), np.int64), length[live].copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            at = live[open_]
            less = before(order[at], order[other[at] + mid], odd[at])
            low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
        rank = np.zeros(n, np.int64)
        rank[live] = low
        target = first + (block // 2) * 2 * run + within % run + rank
        merged = np.empty_like(order)
        merged[target] = order
        order, run = merged, run * 2
    return order


def repeated_windows(contexts: list[bytes], anchor: list[int], group: list[int], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each context the ranges (first, last) of its windows that another context of its group has at the same offset from the anchor.

    ``group`` ascends.
    """
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    joined = b"".join(contexts)
    data, group, left = np.frombuffer(joined, np.uint8), np.asarray(group), np.asarray(anchor, np.int64)
    size = np.array([len(c) for c in contexts], np.int64)
    place = offsets_of(size)[:-1] + left
    right = size - left
    hashes = PrefixHashes(data)
    by_right = suffix_order(hashes, data, group, place, right, leftward=False)
    by_left = suffix_order(hashes, data, group, place, left, leftward=True)
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    a, b = by_left[:-1], by_left[1:]
    shared = np.where(group[a] == group[b], hashes.common(place[a], place[b], np.minimum(left[a], left[b]), leftward=True), -1)
    # rows: the members of a group, once for each distinct left extension between neighbours
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    rows: list[np.ndarray] = []
    for g0, g1 in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if g1 - g0 < 2:
            continue
        inner = shared[g0 : g1 - 1]
        values = np.unique(inner)
        for v, under in zip(values.tolist(), [-1, *values[:-1].tolist()], strict=True):
            cut = np.concatenate([[True], inner < v])
            rows.append(np.stack([by_left[g0:g1], np.full(g1 - g0, v), np.full(g1 - g0, under), cut]))
    if not rows:
        return out
    who, most, under, cut = np.concatenate(rows, axis=1)
    cls = np.cumsum(cut)
    order = np.lexsort((rank[who], cls))
    who, most, under, cls = who[order], most[order], under[order], cls[order]
    a, b = who[:-1], who[1:]
    length = np.where(cls[:-1] == cls[1:], hashes.common(place[a], place[b], np.where(cls[:-1] == cls[1:], np.minimum(right[a], right[b]), 0)), -1)
    to_next, to_last = np.append(length, -1), np.insert(length, 0, -1)
    best = np.maximum(to_next, to_last)
    partner = np.where(to_next >= to_last, np.append(b, -1), np.insert(a, 0, -1))
    high = np.minimum(most, left[who])  # offsets of the anchor from the window's start
    low = np.maximum(np.maximum(span - best, under + 1), np.maximum(left[who] - (size[who] - span), 0))
    broken = set()
    for k in np.flatnonzero((best > 0) & (low <= high)).tolist():
        i, j, h, r = int(who[k]), int(partner[k]), int(high[k]), int(best[k])
        p, q = int(place[i]), int(place[j])
        if joined[p - h : p + r] != joined[q - h : q + r]:
            broken.add(int(group[i]))  # a collision of hashes: this group is compared plainly
            continue
        out[i].append((int(left[i]) - h, int(left[i] - low[k])))
    for g in broken:
        of = np.flatnonzero(group == g).tolist()
        seen = Counter((int(left[i]) - w, contexts[i][w : w + span]) for i in of for w in range(len(contexts[i]) - span + 1))
        for i in of:
            out[i] = [(w, w) for w in range(len(contexts[i]) - span + 1) if seen[int(left[i]) - w, contexts[i][w : w + span]] > 1]
    return out


def merged_spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open stretches, touching ones joined."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reached = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reached[:-1]]))
    return list(zip(first[new].tolist(), reached[np.append(new[1:] - 1, len(first) - 1)].tolist(), strict=True))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the first column compressed, each by itself; a null stays null."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else squeeze(t.encode()) for t in part.column(0).to_pylist()], pa.binary()), *part.columns[1:]], ["packed", *part.schema.names[1:]])


def _opened(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def spans(df: DataFrame, span: int = SPAN, passage: int = PASSAGE, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Of a table (doc_id, text): its rows (doc_id, packed text) with the keys ``did`` and ``th``, and for these keys the stretches that repeat.

    A stretch has a level: 0 for windows of ``span`` bytes, 1 for windows of ``passage`` bytes.
    """
    both = (span, passage)
    if not gram <= passage < span < gram + 511:
        raise ValueError("gram <= passage < span < gram + 511 is needed")
    rows = df.select("text", "doc_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"))
    keyed = rows.mapInArrow(_squeezed, "packed binary, doc_id long, did long, th long")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", 4 << 20):
                owner, anchor, *rest = anchors_of([t.encode() for t in texts(batch.column(0))], both, gram)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(anchor.astype(np.int32)), *map(pa.array, rest)], ["did", "th", "anchor", "reach", "akey", "c1", "c2"])

    every = written(rows.select("text", "did", "th").mapInArrow(anchors, "did long, th long, anchor int, reach long, akey long, c1 long, c2 long"))
    # most anchors are met once: their rows go before anything wider moves
    found = written(every.join(every.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1").select("akey"), "akey", "left_semi"))
    discard(every)
    tidy(df.sparkSession)
    same = ["akey", "c1", "c2"]
    # one row for each different context, copies summed before the shuffle: an anchor's rows are as many as its contexts
    distinct = found.groupBy(*same, "reach").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "anchor")).alias("r")).select(*same, "reach", "n", "r.*")
    groups = distinct.groupBy("akey").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("akey", "m")
    # most contexts are alone: only those with copies, and those whose anchor has others, are kept; both sides read one exchange
    kept = written(distinct.join(groups, "akey", "left").where("n > 1 OR m IS NOT NULL"))
    del distinct, groups
    tidy(df.sparkSession)
    whole = kept.where("n > 1").select(*same, "reach")
    reps = kept.where("m IS NOT NULL").groupBy("did", "th").agg(F.collect_list(F.struct(*same, "reach", "n", "m", "anchor")).alias("asked"))
    names = ["akey", "c1", "c2", "reach", "n", "m", "data"]
    schema = pa.schema([*((x, pa.int64()) for x in names[:6]), ("data", pa.binary())])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of a row that is there many times a task gives the contexts once
        for batch in batches:
            rows = []
            for did, th, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (did, th) in seen:
                    continue
                seen.add((did, th))
                data = _opened(packed)
                for x in wanted:
                    low, high = context_bounds(x["reach"], both)
                    rows.append((*(x[k] for k in names[:6]), data[x["anchor"] + low : x["anchor"] + high]))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    contexts = written(keyed.select("did", "th", "packed").join(reps, ["did", "th"]).select("did", "th", "packed", "asked").mapInArrow(cut_out, "akey long, c1 long, c2 long, reach long, n long, m long, data binary"))
    window_type = "array<struct<level:int,a:int,b:int>>"
    verdict_schema = pa.schema([*((x, pa.int64()) for x in names[:4]), ("windows", pa.list_(pa.struct([("level", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])))])

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0

        def judged():
            kept = list({r[:3]: r for r in rows}.values())  # rows that repeat a document bring its contexts twice
            windows: list[list] = [[] for _ in kept]
            for level, length in enumerate(both):
                mine = [(i, r, reach) for i, r in enumerate(kept) if (reach := reach_of(r[3])[level])]
                zero = [-context_bounds(r[3], both)[0] for _, r, _ in mine]  # the anchor in its context
                cut = [r[5][z - reach[0] : z - reach[1] + length] for (_, r, reach), z in zip(mine, zero, strict=True)]
                repeats = repeated_windows(cut, [reach[0] for _, _, reach in mine], [r[0] for _, r, _ in mine], length)
                for (i, _, reach), w in zip(mine, repeats, strict=True):
                    windows[i] += [{"level": level, "a": a - reach[0], "b": b - reach[0] + length} for a, b in w]
            out = [{"akey": r[0], "c1": r[1], "c2": r[2], "reach": r[3], "windows": w} for r, w in zip(kept, windows, strict=True) if w and r[4] == 1]
            return pa.RecordBatch.from_pylist(out, verdict_schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 2 << 20 and r[0] != rows[-1][0]:
                    yield judged()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield judged()

    sorted_ = contexts.where(F.col("m") <= group_limit).select("akey", "c1", "c2", "reach", "n", "data").repartition("akey").sortWithinPartitions("akey").mapInArrow(sort_groups, f"akey long, c1 long, c2 long, reach long, windows {window_type}")

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for akey, c1, c2, reach, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                zero = -context_bounds(reach, both)[0]
                for level, length in enumerate(both):
                    if (r := reach_of(reach)[level]) is None:
                        continue
                    at = range(-r[0], -r[1] + 1)
                    h = [xxhash.xxh3_128_intdigest(data[zero + w : zero + w + length]) for w in at]
                    fill = lambda v, t=pa.int64(), k=len(at): pa.array([v] * k, t)
                    halves = ([(x >> 64) - (1 << 63) for x in h], [(x & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for x in h])
                    yield pa.RecordBatch.from_arrays([fill(akey), fill(c1), fill(c2), fill(reach), fill(n), fill(level, pa.int32()), pa.array(at, pa.int32()), *(pa.array(x, pa.int64()) for x in halves)], ["akey", "c1", "c2", "reach", "n", "level", "w", "h1", "h2"])

    hot = contexts.where(F.col("m") > group_limit).dropDuplicates(same).select("akey", "c1", "c2", "reach", "n", "data").mapInArrow(hash_windows, "akey long, c1 long, c2 long, reach long, n long, level int, w int, h1 long, h2 long")
    twice = hot.groupBy("level", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    one = F.struct("level", F.col("w").alias("a"), F.expr(f"w + IF(level = 0, {span}, {passage})").cast("int").alias("b"))
    counted = hot.where("n = 1").join(twice, ["level", "h1", "h2"]).groupBy(*same, "reach").agg(F.collect_list(one).alias("windows"))
    verdict = whole.withColumn("windows", F.lit(None).cast(window_type)).unionByName(sorted_).unionByName(counted)
    bits = [f"CAST(shiftright(reach, {s}) & 511 AS INT)" for s in (0, 9, 18, 27)]
    full = ", ".join(f"IF({a} = 511, NULL, struct({level} AS level, -{a} AS a, {length} - {b} AS b))" for level, length, a, b in ((0, span, bits[0], bits[1]), (1, passage, bits[2], bits[3])))
    windows = F.expr(f"coalesce(windows, filter(array({full}), x -> x IS NOT NULL))")
    hits = found.drop("reach").join(verdict, same).select("did", "th", "anchor", windows.alias("windows"))
    placed = hits.select("did", "th", F.expr("transform(windows, x -> struct(x.level AS level, anchor + x.a AS a, anchor + x.b AS b))").alias("s"))
    tidy(df.sparkSession)
    return keyed, placed.groupBy("did", "th").agg(F.flatten(F.collect_set("s")).alias("spans"))  # rows that repeat id and text give the same stretches


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), passages (start and end in bytes, ``removed`` ones among them) of every row."""
    keyed, found = spans(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), **options)
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept", pa.binary()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "packed", 4 << 20):
                wanted = batch.column(2)
                ends, stretches = offsets_of(pa.compute.list_value_length(wanted).fill_null(0).to_numpy(zero_copy_only=False)), wanted.flatten()
                level, first, last = (pa.compute.struct_field(stretches, i).to_numpy(zero_copy_only=False) for i in range(3))
                rows = []
                for doc, packed, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    data = _opened(packed)
                    if s == e:
                        rows.append((doc, len(data), 0, 0, data, []))
                        continue
                    gone, passages = (merged_spans(first[s:e][level[s:e] == k], last[s:e][level[s:e] == k]) for k in (0, 1))
                    edges = [0, *(p for s in gone for p in s), len(data)]
                    rows.append((doc, len(data), sum(b - a for a, b in gone), len(gone), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [{"start": a, "end": b} for a, b in passages]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    joined = keyed.join(found, ["did", "th"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, passages array<struct<start:long,end:long>>")


def summary(removed: DataFrame) -> DataFrame:
    """The digest of ``remove``, and how many bytes lie in passages that repeat."""
    covered = F.expr("aggregate(passages, 0L, (n, x) -> n + x.end - x.start)").alias("n_passage_bytes")
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), covered)
