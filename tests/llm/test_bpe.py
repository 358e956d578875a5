import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gleaner.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.BytePairCodec(ranks, P.PATTERN)


def both(codec, judge, many):
    ids, offsets = codec.encode(many)
    data, ends = codec.decode(ids, offsets)
    for i, t in enumerate(many):
        same = ids[offsets[i] : offsets[i + 1]].tolist() == judge.encode_ordinary(t)
        assert same, repr(t[:200])
        assert data[ends[i] : ends[i + 1]].tobytes() == t.encode()


def test_perfect_hash_is_minimal(ranks):
    keys = list(ranks)
    h = bpe.PerfectHash(keys)
    assert sorted(h.lookup(h.hashes(keys)).tolist()) == list(range(len(keys)))
    assert bpe.PerfectHash([]).lookup(np.zeros(3, np.uint64)).tolist() == [-1] * 3


def test_every_code_point(codec, judge):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    both(codec, judge, ["".join(f"a{c}b {c}{c} 1{c} " for c in points[i : i + 512]) for i in range(0, len(points), 512)])


def test_random_and_odd_texts(codec, judge):
    rng = random.Random(3)
    alphabet = "abcés's 're  \n\t\r\x1c\x85  .,!1٣文"
    both(codec, judge, ["", " ", "  ", "\n ", " \n", "<|endoftext|>", "a" * 20_000, "ab" * 9999 + " x", " " * 999])
    both(codec, judge, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(20_000)])
    both(codec, judge, [])


def test_tables(spark, judge):
    rows = [(1, "Hello there", "x"), (None, None, "y"), (3, "", None), (3, "naïve 文 text", None), (3, "naïve 文 text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect())

    def want(i, t):
        ids = judge.encode_ordinary(t or "")
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert got == sorted(want(i, t) for i, t, _ in rows)
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
