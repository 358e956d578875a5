"""Token ids in files whose document boundaries are Elias-Fano coded.

A file holds consecutive documents in ascending id order: one concatenated array of ids (two bytes each where the
vocabulary allows) and two monotone sequences, the ends of the documents and their doc_ids, each split into low bits stored
plainly and high bits stored in unary. A select index, the place of every 256th one in 32 bits, finds the i-th value without
a table of 64-bit offsets: about 2 + log2(ids / documents) bits a document.

Files are the ``image`` values of a Parquet table (block, part, n_docs, n_ids, image), so that Spark's committer writes
them to any store it can reach and a lost executor leaves no half file; ``export`` puts them on a local disk one by one.
Blocks are ranges of doc_id; a long block makes several parts. A block is sorted and streamed, never held whole, and an id that
many rows share is split over several blocks.

Cases: a null or empty text is a document of the end id alone. Text that spells a special token gets that token's id, as the
library's call has it. A text of any length is encoded whole, in one file. A null doc_id comes first. Rows that share a doc_id are
documents of their own, in the order of their texts' hash. Other columns are not read. An empty table makes no file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.chunks import ChunkEncoder, spans_index
from gleaner.llm.common import Ranges, offsets_of, slices, texts, written

MAGIC = b"GLTOKEF1"
END_ID = 0
#: Ids in a file before the next begins; a document is never cut.
FILE_IDS = 4 << 20
#: Documents in a range of doc_ids, and the largest number of ranges.
BLOCK_DOCS, MAX_BLOCKS = 512, 1 << 16
_SAMPLE = 256
_SIMPLE = re.compile(r"[ \n]?\S{1,200}(?:\n\S{1,200})*")
_ONES = np.array([[p for p in range(8) if b >> p & 1] + [0] * (8 - b.bit_count()) for b in range(256)], np.int64)  # places of a byte's ones
_HEAD = struct.Struct("<8sBxxxIIQqII")  # magic, bytes an id, documents, null doc_ids, ids, first doc_id, sizes of the two sequences


class EliasFano:
    """A sequence 0 <= v0 <= v1 <= ... in its coded form."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
        high[ones] = True
        return cls(n, low_bits, np.packbits(low.astype(bool).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return struct.pack("<IBIII", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data) -> EliasFano:
        n, low_bits, *sizes = struct.unpack_from("<IBIII", data)
        at, parts = 17, []
        for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, low_bits, *parts)

    def _low(self, i) -> np.ndarray:
        at = np.asarray(i, np.int64)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place before it, bytes are counted until its one is found."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7)) & 0xFF
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | int(self._low([i])[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``: for all of them at once the byte is found by the number of ones up to its end."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("no such place")
        if not len(i):
            return np.zeros(0, np.uint64)
        a, b = int(i.min()) // _SAMPLE, int(i.max()) // _SAMPLE + 1  # from the sampled place before the first to that behind the last
        first = int(self.samples[a]) >> 3
        last = (int(self.samples[b]) >> 3) + 1 if b < len(self.samples) else len(self.high)
        before = a * _SAMPLE - (int(self.high[first]) & ((1 << (int(self.samples[a]) & 7)) - 1)).bit_count()  # ones in front of this byte
        ends = before + np.cumsum(np.bitwise_count(self.high[first:last]), dtype=np.int64)
        byte = np.searchsorted(ends, i, "right")
        word = self.high[first + byte]
        at = (first + byte) * 8 + _ONES[word, i - (ends[byte] - np.bitwise_count(word))]
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def all(self) -> np.ndarray:
        return self.select_many(np.arange(self.n))


def file_image(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file. ``ids``: each document's ids as little-endian numbers of ``width`` bytes, the end id included."""
    n_null = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    coded = [EliasFano.of(ends).to_bytes(), EliasFano.of(known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)).to_bytes()]
    return b"".join([_HEAD.pack(MAGIC, width, len(ids), n_null, int(ends[-1]) if len(ids) else 0, first, *map(len, coded)), *coded, *ids])


class TokenFile:
    """Reads an image: ``len``, ``doc_id(i)``, ``ids(i)`` by select; ``offsets()`` of all documents."""

    def __init__(self, image):
        magic, self.width, self.n, self.n_null, self.n_ids, self.first, a, b = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(image)
        at = _HEAD.size
        self.ends, self.docs = EliasFano.from_bytes(view[at : at + a]), EliasFano.from_bytes(view[at + a : at + a + b])
        self.flat = np.frombuffer(view, f"<u{self.width}", self.n_ids, at + a + b)

    def __len__(self) -> int:
        return self.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.docs.select(i - self.n_null)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], self.ends.all().astype(np.int64)])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.docs.all().astype(np.int64) + self.first).tolist()


class LibraryEncoder:
    """The tokenizers library as it comes from its file, behind a memory of distinct chunks where its settings let chunks be encoded apart."""

    GROUP, CALL = 512, 8  # chunks in one string, strings in one call: what the library holds for them at once is small

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        pre, added = parsed.get("pre_tokenizer") or {}, parsed.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and parsed.get("normalizer") is None and not parsed.get("truncation") and not parsed.get("padding")
        # an added token that holds or takes in white space, or asks for whole words, could cross a joint
        self.apart = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 or t["content"] != t["content"].strip() for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.chunks = ChunkEncoder(self._many, f"<u{self.width}", tails=True, whole=tuple(t["content"] for t in added))
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many short chunks in one string: a newline between two words is a token of its own, between chunks and inside them."""
        simple = np.zeros(len(chunks), bool)
        if len(self.newline) == 1:
            word, added = _SIMPLE.fullmatch, self.added.search
            simple[:] = [word(c) is not None and not added(c) for c in chunks]
        easy, hard = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        parts, counts, order = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        groups = [easy[at : at + self.GROUP] for at in range(0, len(easy), self.GROUP)]
        for at in range(0, len(groups), self.CALL):
            some = groups[at : at + self.CALL]
            strings = [[chunks[i] for i in g] for g in some]
            for group, string, e in zip(some, strings, self.tokenizer.encode_batch_fast(["\n".join(s) for s in strings], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int64)
                ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
                lines = np.cumsum([c.count("\n") + 1 for c in string])
                if len(ends) != lines[-1]:  # not expected: then each one by itself
                    hard += group
                    continue
                ends = ends[lines - 1]  # of the chunks
                keep = np.ones(len(ids), bool)
                keep[ends[:-1]] = False
                parts.append(ids[keep])
                counts.append(np.diff(ends, prepend=-1) - 1)
                order += group
        for i in hard:
            ids = self.tokenizer.encode(chunks[i], add_special_tokens=False).ids
            parts.append(np.array(ids, np.int64))
            counts.append(np.array([len(ids)]))
            order.append(i)
        n, back = np.concatenate(counts), np.argsort(np.array(order, np.int64))
        return np.concatenate(parts)[spans_index(offsets_of(n)[:-1][back], n[back])], n[back]

    def encode(self, many: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.apart:
            return self.chunks.encode(many)
        plain = many if isinstance(many, list) else texts(many)
        lists = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in plain]
        return np.array([i for x in lists for i in x], self.chunks.dtype), offsets_of([len(x) for x in lists])


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(spec: str, key: str) -> LibraryEncoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(spec)
    return _ENCODERS[key]


def write_files(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Encode every text, end it with ``end_id`` and write the files; the table of files, read back."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("tie"))
    ranges = Ranges.over(source, "doc_id", min(MAX_BLOCKS, -(-source.count() // block_docs)))
    shared = df.sparkSession.sparkContext.broadcast((spec, hashlib.sha256(spec.encode()).hexdigest(), ranges))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, key, ranges = shared.value
        encoder = _encoder(spec, key)
        w, end = encoder.width, np.array([end_id], f"<u{encoder.width}").tobytes()
        for big in batches:
            for batch in slices(big, "text", 12 << 20, 1 << 14):
                ids, offsets = encoder.encode(batch.column(1))
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                block = pa.array(ranges.of(batch.column(0), batch.column(2)), pa.int32())
                for at in range(0, batch.num_rows, 2048):
                    cut = offsets[at : at + 2049].tolist()
                    rows = pa.array([b"".join((raw[w * a : w * b], end)) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([block.slice(at, len(rows)), batch.column(0).slice(at, len(rows)), batch.column(2).slice(at, len(rows)), rows], ["block", "doc_id", "tie", "ids"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, _, _ = shared.value
        width = 2 if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else 4
        docs: list = []
        ids: list[bytes] = []
        block, part, size = None, 0, 0

        def flush():
            image = file_image(docs, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], ["block", "part", "n_docs", "n_ids", "image"])

        for batch in batches:
            for b, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if docs and (b != block or size + len(x) // width > file_ids or d is None and docs[-1] is not None):
                    yield flush()
                    part = part + 1 if b == block else 0
                    docs, ids, size = [], [], 0
                if b != block:
                    block, part = b, 0
                docs.append(d)
                ids.append(x)
                size += len(x) // width
        if docs:
            yield flush()

    encoded = source.mapInArrow(tokens, "block int, doc_id long, tie long, ids binary")
    dealt = encoded.repartition("block").sortWithinPartitions("block", F.coalesce("doc_id", F.lit(Ranges.LOWEST)), "tie", "ids")
    return written(dealt.drop("tie").mapInArrow(files, "block int, part int, n_docs long, n_ids long, image binary"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(image)
                offsets, flat = file.offsets(), file.flat.astype("<u4")  # the offsets of all its documents by select
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n = len(file)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(file.doc_ids(), pa.int64()), pa.array(offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["block", "part", "doc_id", "local", "n_tokens", "ids_crc32"])

    # at most MAX_BLOCKS sums stand in one window; the parts of a block in one each
    sums = files.groupBy("block").agg(F.sum("n_ids").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    parts = files.select("block", "part", (F.sum("n_ids").over(Window.partitionBy("block").orderBy("part")) - F.col("n_ids")).alias("inner"))
    bases = parts.join(before, "block").select("block", "part", (F.col("base") + F.col("inner")).alias("base"))
    rows = files.select("block", "part", "image").mapInArrow(documents, "block int, part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["block", "part"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(files: DataFrame, folder: str) -> int:
    """Write each image as a file of its own into a local folder, one at a time; how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in files.orderBy("block", "part").toLocalIterator():
        with open(os.path.join(folder, f"{row.block:06d}-{row.part:06d}.tok"), "wb") as f:
            f.write(row.image)
        n += 1
    return n
