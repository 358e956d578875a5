"""Benchmark decontamination by the q-gram lemma.

Two strings within e edits share at least m + 1 - q - q * e of the m-long one's q-grams, and those lie on at most e + 1
neighbouring diagonals. The q-grams of all items are indexed; each document's q-grams are looked up, the hits counted in diagonal bands
as wide as two edit budgets, each overlapping half of the next, and the bands that reach the bound are verified by a banded
alignment of the whole item with the region. Text is compared in lower case with runs of white space as one space.

The items are broadcast as an index in blocks of about ``BLOCK_CHARS`` characters, at most twice as many but for a single longer item, one pass over the documents
for each block, so that an index of any total size fits; benchmarks of usual size are one block.

Cases: null and empty texts hold nothing. An item shorter than ``MIN_CHARS`` has too few q-grams for edits and is searched
verbatim, as whole words; a null one and one of white space are ignored. Part of an item is not searched. Repeated items
and documents are all reported. Columns of any name are passed on by ``clean``. An empty table
gives an empty result, an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.chunks import spans_index
from gleaner.llm.common import offsets_of, slices, texts

Q = 12
#: Edits allowed for each character of an item; never more than the lemma can see.
EDIT_RATE = 0.06
#: Items under this size are searched verbatim.
MIN_CHARS = 40
#: Characters of items in one broadcast index.
BLOCK_CHARS = 4 << 20
_APART = 0x1C  # white space, so no normal text holds it
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_INSIDE = re.compile(r"(?<=\w)\w")
_B = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of ``normal(text)`` and its end, the place in ``text``."""
    out: list[int] = []
    for m in _WORD.finditer(text):
        if out:
            out.append(m.start() - 1)
        for i, c in enumerate(m.group(), m.start()):
            out += [i] * len(c.lower())
    return [*out, (out[-1] + 1) if out else 0]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the Q-gram at each place of the code points, by doubling: 1, 2, 4, 8, then 8 + 4."""
    x = points.astype(np.uint64)
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    known, width = {1: x}, 1
    while width * 2 <= Q:
        h = known[width]
        known[width * 2] = h[:-width] * _power(width) + h[width:]
        width *= 2
    n = len(x) - Q + 1
    out, done = known[width][:n], width
    for w in sorted(known, reverse=True)[1:]:
        if done + w <= Q:
            out = out * _power(w) + known[w][done : done + n]
            done += w
    return out ^ (out >> np.uint64(29))


def points_of(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one mark between two, and each text's start."""
    flat = np.frombuffer(chr(_APART).join(many).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, offsets_of([len(t) + 1 for t in many])[:-1]


class Index:
    """Q-grams of the items, with a bit table in front."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE):
        plain = [(i, normal(x)) for i, x in items if x is not None]
        kept = [(i, t) for i, t in plain if len(t) >= MIN_CHARS]
        #: first token, size, text -> ids of the items under MIN_CHARS
        self.short: dict[str, dict[int, dict[str, list]]] = {}
        for i, t in plain:
            if len(t) < MIN_CHARS and (m := _TOKEN.search(t)):
                self.short.setdefault(m.group(), {}).setdefault(len(t), {}).setdefault(t, []).append(i)
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.minimum((rate * self.sizes).astype(np.int64), (self.sizes - Q) // Q) if kept else self.sizes
        self.least = self.sizes + 1 - Q - Q * self.budget
        grams, owner, place = [], [], []
        for k, t in enumerate(self.texts):
            h = gram_hashes(points_of([t])[0])
            grams.append(h)
            owner.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = (np.concatenate([np.zeros(0, np.int32), *x])[order] for x in (owner, place))
        self.grams, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int64)
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.grams) * 64).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.grams * _B) >> self.shift] = True

    def candidates(self, many: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lowest and highest start of the item) of the bands that reach the item's bound."""
        flat, starts = points_of(many)
        h = gram_hashes(flat)
        at = np.flatnonzero(self.table[(h * _B) >> self.shift])
        found = np.searchsorted(self.grams, h[at])
        found[found == len(self.grams)] = 0
        real = self.grams[found] == h[at] if len(self.grams) else np.zeros(len(at), bool)
        at, found = at[real], found[real]
        n = self.first[found + 1] - self.first[found]
        hit = spans_index(self.first[found], n)
        item, at = self.owner[hit].astype(np.int64), np.repeat(at, n)
        doc = np.searchsorted(starts, at, "right") - 1
        width = np.maximum(1, self.budget[item])
        shift = int(self.sizes.max()) if len(self.sizes) else 0
        diagonal = at - starts[doc] - self.place[hit] + shift  # never negative
        band = diagonal // width
        # band b holds the diagonals from b * width up to (b + 2) * width; one number for document, item and band
        span = int(band.max()) + 2 if len(band) else 1
        key = (doc * len(self.ids) + item) * span + band + 1
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        owner, low = keys // span, keys % span - 1
        for k in np.flatnonzero(counts >= self.least[owner % len(self.ids)]):
            item = int(owner[k] % len(self.ids))
            width = max(1, int(self.budget[item]))
            yield int(owner[k] // len(self.ids)), item, int(low[k]) * width - shift, (int(low[k]) + 2) * width - shift


    def verbatim(self, text: str) -> Iterator[tuple[list, int, int]]:
        """(ids, start, end) of the short items in a normal text, as whole words; places of one item do not overlap."""
        done: dict[str, int] = {}
        for m in _TOKEN.finditer(text) if self.short else ():
            start = m.start()
            for size, items in self.short.get(m.group(), {}).items():
                item, end = text[start : start + size], start + size
                if item in items and start >= done.get(item, 0) and not _INSIDE.match(text, end):
                    done[item] = end
                    yield items[item], start, end


def align(pattern: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole pattern in the text with at most ``budget`` edits; else None.

    A dynamic programme over diagonals: row by row of the pattern, only the places from which the end can be reached.
    """
    if (at := text.find(pattern)) >= 0:
        return 0, at, at + len(pattern)
    best = _ends(pattern, text, budget, free_start=True)
    if best is None:
        return None
    edits, end = best
    back = _ends(pattern[::-1], text[:end][::-1], edits, free_start=False)
    return edits, end - (back[1] if back else len(pattern)), end


def _ends(pattern: str, text: str, budget: int, free_start: bool) -> tuple[int, int] | None:
    """Fewest edits and the first end of a match; ``free_start``: it may begin anywhere, else at the text's begin."""
    m, n = len(pattern), len(text)
    low, high = -budget, (n - m + budget if free_start else budget)  # diagonals: place in text minus place in pattern
    if high < low:
        return None
    big = m + n + 1
    width = high - low + 1
    p, t = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (pattern, text))
    padded = np.full(width + m + 1, 0xFFFFFFFF, np.uint32)  # text at place low .. low + width + m
    a, b = max(0, low), min(n, low + len(padded))
    padded[a - low : b - low] = t[a:b]
    steps = np.arange(width)
    place = steps + low
    row = np.where((place >= 0) & (place <= n), 0 if free_start else place, big)
    for i in range(m):
        fresh = np.minimum(row + (padded[i : i + width] != p[i]), np.append(row[1:], big) + 1)
        place = steps + low + i + 1
        fresh[(place < 0) | (place > n)] = big
        row = np.minimum.accumulate(fresh - steps) + steps
        row[(place < 0) | (place > n)] = big
    k = int(np.argmin(row))
    return (int(row[k]), k + low + m) if row[k] <= budget else None


def matches(index: Index, many: list[str]) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, start, end, edits) of every item found, in code points of the texts as given."""
    if not index.ids and not index.short:
        return []
    plain = [normal(t) for t in many]
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for doc, item, low, high in sorted(set(index.candidates(plain)) if index.ids else ()):
        pattern, budget = index.texts[item], int(index.budget[item])
        begin = max(0, low - budget)
        region = plain[doc][begin : max(0, high) + len(pattern) + budget]
        if found := align(pattern, region, budget):
            best.setdefault((doc, item), []).append((found[0], begin + found[1], begin + found[2]))
    out, maps = [], {}
    for (doc, item), spans in best.items():
        if doc not in maps:
            maps[doc] = places(many[doc])
        taken: list[tuple[int, int]] = []
        for edits, start, end in sorted(set(spans)):  # of matches that overlap, the one with fewest edits
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                out.append((doc, index.ids[item], maps[doc][start], maps[doc][end - 1] + 1, edits))
    for doc, text in enumerate(plain):
        for ids, start, end in index.verbatim(text):
            if doc not in maps:
                maps[doc] = places(many[doc])
            out += [(doc, i, maps[doc][start], maps[doc][end - 1] + 1, 0) for i in ids]
    return out


def indexes(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> Iterator:
    """Broadcast indexes of the items, block after block; the sizes are summed before any text is collected. An item that is listed again with the same id and text is one."""
    items = bench.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    while True:  # twice as many until each one fits, unless it is one item
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        sizes = items.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("n"), F.count_distinct("item_id", "text").alias("k")).where(f"n > {2 * block_chars} AND k > 1")
        if blocks == 1 or sizes.isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        rows = items.where(block == b).collect()
        yield bench.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0))], rate))


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start, end, edits of every item found in a document."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for shared in indexes(bench, **options):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in slices(big, "text", 2 << 20):
                    rows = matches(shared.value, texts(batch.column(1)))
                    ids = batch.column(0)
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "start", "end", "edits"])

        part = source.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for shared in indexes(bench, **options):
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in slices(big, text_col, 2 << 20):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[r[0] for r in matches(shared.value, texts(batch.column(place)))]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
