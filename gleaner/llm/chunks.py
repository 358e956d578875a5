"""Encoding by distinct chunks: a text is cut where no token can cross, each distinct chunk is encoded once.

In the byte-level patterns used here, a single space between two non-space characters always begins a new
pre-token, and a single line end there is one by itself, so the pieces between such spaces and from such line ends can be encoded apart. Cutting, finding the distinct chunks, looking them up and
putting the ids together run on Arrow arrays; Python sees only the chunks that are new.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.common import offsets_of

_BESIDE = re.compile(r" \s|\s ")
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: What RE2 must be told that Python's \s has: ASCII, then the rest.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MAYBE_BESIDE = rf" [{_SPACES}]|[{_SPACES}] "
_LINE_END = rf"([^{_SPACES}])\n([^{_SPACES}])"
#: Longest run of punctuation that is cut off, in bytes.
_TAIL = 8
_PUNCTUATION, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True


def cut(text: str) -> list[str]:
    """Pieces such that text = " ".join(pieces) and no pre-token crosses a joint."""
    return _BORDER.split(text) if _BESIDE.search(text) else text.split(" ")


def _pieces(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and each text's offsets into them. A piece that begins with a line end had no space before it."""
    odd = pc.match_substring_regex(texts, _MAYBE_BESIDE).to_numpy(zero_copy_only=False)
    if not odd.any():
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _LINE_END, "\\1 \n\\2"), " ")
    else:  # Python cuts these few
        plain = pc.split_pattern(pc.replace_substring_regex(texts.filter(pa.array(~odd)), _LINE_END, "\\1 \n\\2"), " ")
        hard = pa.array([cut(t) for t in texts.filter(pa.array(odd)).to_pylist()], plain.type)
        place = np.empty(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(hard))
        lists = pa.concat_arrays([plain, hard]).take(pa.array(place))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), offsets_of(sizes)


class ChunkEncoder:
    """``encode_many`` maps chunks (the joint's space in front) to all their ids in one array and the count of each.

    Chunks met are remembered with their ids in flat arrays of at most ``memo_bytes``; beyond that the half
    that has not been met for longest goes. A chunk longer than ``LONGEST`` is not remembered. With ``tails`` a run of
    punctuation that ends a chunk is encoded apart from the letter or digit before it, but not in chunks that hold one of ``whole``.
    """

    LONGEST = 64

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, tails: bool = False, whole: tuple[str, ...] = (), memo_bytes: int = 24 << 20):
        self.encode_many, self.dtype, self.tails, self.whole, self.memo_bytes = encode_many, np.dtype(dtype), tails, whole, memo_bytes
        self.clock = 0
        self.words, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self.ids, self.offsets = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _remember(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(words), self.LONGEST).to_numpy(zero_copy_only=False)
        if not short.all():
            ids, words, counts = ids[np.repeat(short, counts)], words.filter(pa.array(short)), counts[short]
        if self.words.nbytes + self.ids.nbytes + 12 * len(self.met) > self.memo_bytes:
            recent = np.flatnonzero(self.met > np.median(self.met))
            mine = np.diff(self.offsets)[recent]
            self.ids = self.ids[spans_index(self.offsets[recent], mine)]
            self.words, self.met, self.offsets = self.words.take(pa.array(recent)), self.met[recent], offsets_of(mine)
        self.words = pa.concat_arrays([self.words, words])
        self.met = np.concatenate([self.met, np.full(len(words), self.clock, np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(self.dtype, copy=False)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])

    def _of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks in one array, where each one's begin, and how many they are."""
        self.clock += 1
        at = pc.index_in(words, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        old = at.drop_null().to_numpy()
        self.met[old] = self.clock
        starts, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[known], counts[known] = self.offsets[old], self.offsets[old + 1] - self.offsets[old]
        ids = self.ids
        new = words.filter(pa.array(~known))
        if len(new):
            new_ids, new_counts = self.encode_many(new.to_pylist())
            starts[~known], counts[~known] = len(ids) + offsets_of(new_counts)[:-1], new_counts
            ids = np.concatenate([ids, new_ids.astype(self.dtype, copy=False)])
            self._remember(new, new_ids, new_counts)
        return ids, starts, counts

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_of_distinct``, each chunk as a stem and a tail."""
        if not self.tails:
            return self._of_distinct(chunks)
        tail = tail_sizes(chunks)
        for mark in self.whole:
            tail[pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)] = 0
        parts = pa.concat_arrays([_part(chunks, tail, False), _part(chunks, tail, True)]).dictionary_encode()
        ids, starts, counts = self._of_distinct(parts.dictionary)
        pair = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        both = counts[pair]
        flat = ids[spans_index(starts[pair], both)]
        counts = both.reshape(-1, 2).sum(axis=1)
        return flat, offsets_of(counts)[:-1], counts

    def encode(self, many: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null counts as empty) in one array, and each text's offsets into it."""
        many = many if isinstance(many, pa.Array) else pa.array(many, pa.string())
        if not len(many):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        pieces, offsets = _pieces(many.fill_null(""))
        coded = pieces.cast(pa.large_string()).dictionary_encode()
        index, first = coded.indices.to_numpy(), offsets[:-1]
        heads = coded.dictionary.take(pa.array(index[first]))  # a text's first piece has no space in front
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        rest = coded.dictionary.filter(pa.array(used))
        index = (np.cumsum(used, dtype=np.int32) - 1)[index]
        index[first] = len(rest) + np.arange(len(first), dtype=np.int32)
        lead = pc.if_else(pc.starts_with(rest, "\n"), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        spaced = pc.binary_join_element_wise(lead, rest, pa.scalar("", pa.large_string()))
        chunks = pa.concat_arrays([spaced, heads]).dictionary_encode()
        ids, starts, counts = self._of_chunks(chunks.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), pa.array(ids[spans_index(starts, counts)]))
        index = chunks.indices.to_numpy()[index]
        return lists.take(pa.array(index)).flatten().to_numpy(), offsets_of(counts[index])[offsets]


def _bytes_of(chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and each chunk's offsets into them."""
    _, ends, data = chunks.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(ends, np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]


def tail_sizes(chunks: pa.LargeStringArray) -> np.ndarray:
    """Bytes of the punctuation that ends each chunk after an ASCII letter or digit or a Latin letter, which no Unicode version disputes; else 0."""
    data, ends = _bytes_of(chunks)
    size, end = np.diff(ends), ends[1:]
    tail, open_ = np.zeros(len(size), np.int64), np.ones(len(size), bool)
    for k in range(1, _TAIL + 2):
        open_ &= size >= k
        open_[open_] = _PUNCTUATION[data[end[open_] - k]]
        tail += open_
    whole = (tail == 0) | (tail > _TAIL) | (tail >= size)
    tail[whole] = 0
    at = np.flatnonzero(~whole)
    last = data[end[at] - tail[at] - 1]
    before = np.where(size[at] - tail[at] >= 2, data[np.maximum(end[at] - tail[at] - 2, 0)], 0)
    latin = ((before >= 0xC4) & (before <= 0xC5) | (before == 0xC3) & (last != 0x97) & (last != 0xB7)) & (last >= 0x80) & (last < 0xC0)
    tail[at[~(_WORD[last] | latin)]] = 0
    return tail


def _part(chunks: pa.LargeStringArray, tail: np.ndarray, behind: bool) -> pa.LargeStringArray:
    """The tails, or what stands before them."""
    data, ends = _bytes_of(chunks)
    size = tail if behind else np.diff(ends) - tail
    kept = data[spans_index(ends[1:] - tail if behind else ends[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(offsets_of(size)), pa.py_buffer(kept))


def spans_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
