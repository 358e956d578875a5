"""Byte-level BPE in two tiers.

Tier one: a minimal perfect hash over the vocabulary answers for a whole pre-token at once; the stored key settles whether
it is one. Tier two, for the others: the token's bytes form a linked list, and a heap yields the pair of lowest
rank, leftmost first, until no pair of neighbours is in the vocabulary. Decoding looks the ids up in the concatenated vocabulary.

Cases: a null or empty text has no ids and decodes to nothing. Text that looks like a special token is plain text.
Any Unicode text and length is encoded whole; a run of n bytes takes n log n steps. Repeated rows give repeated
results; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.chunks import ChunkEncoder, spans_index
from gleaner.llm.common import offsets_of, slices


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of byte strings onto 0..n-1.

    Each level is a bit array as long as the keys it got; a key alone in its cell stays there, others go one level down.
    A key's number is the rank of its bit. About four bits a key with the ranks.
    """

    def __init__(self, keys: list[bytes]):
        h = self.hashes(keys)
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys share a 64-bit hash")
        self.levels: list[tuple[int, int]] = []  # start and size of each level's cells
        bits, start = [], 0
        while len(h):
            size = len(h) + 1
            cell = (_mixed(h, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            level = np.zeros(size, bool)
            level[cell[alone]] = True
            bits.append(level)
            self.levels.append((start, size))
            start += size
            h = h[~alone]
        bits = np.concatenate([*bits, np.zeros(64, bool)])
        self.bits = np.packbits(bits, bitorder="little")
        self.ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(bits, np.arange(0, len(bits), 64), dtype=np.int64))]).astype(np.uint32)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's cell, or -1. A string that is no key may get any number: compare the stored key."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (start, size) in enumerate(self.levels):
            if not len(left):
                break
            at = start + (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            hit = self._bit(at).astype(bool)
            out[left[hit]] = at[hit]
            left = left[~hit]
        found = out >= 0
        at = out[found]
        word = at >> 6
        within = np.zeros(len(at), np.int64)
        padded = np.concatenate([self.bits, np.zeros(16, np.uint8)])
        bytes_of = padded[(word << 3)[:, None] + np.arange(8)]
        words = np.ascontiguousarray(bytes_of).view(np.uint64).ravel()
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        within = np.bitwise_count(words & mask).astype(np.int64)
        out[found] = self.ranks[word].astype(np.int64) + within
        return out


class BytePairCodec:
    """``ranks``: token bytes -> id; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: frozenset[str] | None = None):
        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        self.newer = other_class() if newer is None else newer
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        place = self.hash.lookup(self.hash.hashes(keys))
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.int64)
        for k, p in zip(keys, place.tolist(), strict=True):
            self.keys[p] = k
            self.ids[p] = ranks[k]
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        table: list[bytes] = [b""] * (by_id[-1][1] + 1 if by_id else 0)
        for k, i in by_id:
            table[i] = k
        self.offsets = offsets_of([len(k) for k in table])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.chunks = ChunkEncoder(self.encode_chunks, np.uint32, tails=True)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.findall(text)
        known, out, at = "".join("\u2603" if c in self.newer else c for c in text), [], 0  # a character that is neither letter, number nor space
        for piece in self.findall(known):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def merge(self, token: bytes) -> list[int]:
        """Tier two: ids of a token's bytes after all merges."""
        rank, n = self.ranks.get, len(token)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue  # one of the two has been merged since
            after[i], alive[j] = end, False
            if end < n:
                before[end] = i
                if (r := rank(token[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank(token[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : after[i]]])
            i = after[i]
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [[t.encode() for t in self.pre_tokens(c)] for c in chunks]
        distinct = list({t for ts in tokens for t in ts})
        numbers = self.hash.lookup(self.hash.hashes(distinct)).tolist()
        known: dict[bytes, list[int]] = {}
        for t, p in zip(distinct, numbers, strict=True):
            known[t] = [int(self.ids[p])] if p >= 0 and self.keys[p] == t else self.merge(t)
        flat = [i for ts in tokens for t in ts for i in known[t]]
        return np.array(flat, np.uint32), np.array([sum(len(known[t]) for t in ts) for ts in tokens], np.int64)

    def encode(self, many: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.encode(many)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array, and each text's offsets into it."""
        starts = self.offsets[ids]
        counts = self.offsets[ids.astype(np.int64) + 1] - starts
        return self.bytes[spans_index(starts, counts)], offsets_of(counts)[offsets]


def other_class() -> frozenset[str]:
    """Characters that this regex module calls letters or numbers and the tiktoken library, with its Unicode tables, does not."""
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    plain = {bytes([i]): i for i in range(256)}
    theirs = set(bytes(tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=plain, special_tokens={}).encode_ordinary(points)).decode())
    ours = set(regex.findall(r"[\p{L}\p{N}]", points))
    return frozenset(ours - theirs)


_CODECS: dict[str, BytePairCodec] = {}


def codec(ranks: dict[bytes, int], pattern: str, key: str, newer: frozenset[str] | None = None) -> BytePairCodec:
    """One codec for each vocabulary in a worker process."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairCodec(ranks, pattern, newer)
    return _CODECS[key]


def _shared(df: DataFrame, path: str, pattern: str):
    ranks = load_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((ranks, pattern, key, other_class()))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids``: array of int."""
    shared = _shared(df, path, pattern)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for big in batches:
            for batch in slices(big, "text", 6 << 20):
                ids, offsets = c.encode(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))], [id_col, "ids"])

    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded``: the bytes of the ids; a null list decodes to nothing."""
    shared = _shared(df, path, pattern)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], np.int64) for x in batch.column(1).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            data, offsets = c.decode(flat, offsets_of([len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], [id_col, "decoded"])

    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"`{id_col}` {id_type}, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256, in one pass over the texts."""
    shared = _shared(df, path, pattern)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for big in batches:
            for batch in slices(big, "text", 6 << 20):
                ids, offsets = c.encode(batch.column(1))
                data, ends = c.decode(ids, offsets)
                raw, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                digests = [[hashlib.sha256(m[w * a : w * b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)] for m, o, w in ((raw, offsets, 4), (plain, ends, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), *(pa.array(x, pa.string()) for x in digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
