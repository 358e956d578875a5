import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gleaner.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def judge():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 2, 3], [7, 7, 900, 10**12], list(range(0, 300_000, 257))])
def test_elias_fano(values):
    e = tf.EliasFano.from_bytes(tf.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    for a in range(0, len(values), 100):
        assert e.select_many(np.arange(len(values))[a::7]).tolist() == values[a::7]
    with pytest.raises(IndexError):
        e.select(len(values))


def test_space_is_near_minimal():
    rng = random.Random(4)
    ends = np.cumsum([rng.randint(1, 2000) for _ in range(100_000)])
    assert len(tf.EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 2.6 + np.log2(1000)


def test_image_round_trip():
    docs, ids = [None, None, -5, -5, 3, 1 << 40], [b"\1\0", b"\0\0", b"\2\0\3\0\0\0", b"\0\0", b"\0\0", b"\7\0\0\0"]
    f = tf.TokenFile(tf.file_image(docs, ids, 2))
    assert f.doc_ids() == docs == [f.doc_id(i) for i in range(len(f))]
    assert [f.ids(i).tobytes() for i in range(len(f))] == ids
    assert len(tf.TokenFile(tf.file_image([], [], 2))) == 0


def test_encoder_matches_the_library(judge):
    rng = random.Random(5)
    alphabet = [*"abcés's 're  \n\t\r\x00\x1c\x85  .,!1٣文", "<|endoftext|>"]
    many = ["", " ", "  ", "<|endoftext|> x", "x <|endoftext|> y<|endoftext|>  <|endoftext|><|endoftext|>", " a", "a ", " ", "a  b c", "\nx", "x\ny\n\nz\n\n\nw.\nV \nU\n T\x85\n\xa0S\n", "a" * 3000, " ".join(["word", "wörd,"] * 500)]
    many += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, offsets = tf.LibraryEncoder(judge.to_str()).encode(many)
    for i, t in enumerate(many):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == judge.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_files_match_a_plain_loop(spark, judge, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(-50, 400) * 7, " ".join(rng.choice(["alpha", "bê", "c,"]) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(None, "null id"), (10**12, None), (10**12 + 1, ""), (10**12 + 2, "x " * 4000)]
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n_tokens string")
    files = tf.write_files(docs, PATH, file_ids=500, block_docs=20)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.read_files(files).collect()}
    start = 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*judge.encode(t or "", add_special_tokens=False).ids, 0]
        assert got.pop(d) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got
    assert tf.export(files, str(tmp_path)) == files.count() > 10
    twice = docs.limit(5).unionByName(docs.limit(5))
    assert tf.read_files(tf.write_files(twice, PATH)).count() == 10
    assert tf.read_files(tf.write_files(docs.limit(0), PATH)).collect() == []


def test_memory_of_chunks_is_bounded(judge):
    encoder = tf.LibraryEncoder(judge.to_str())
    encoder.chunks.memo_bytes = 20_000
    rng = random.Random(8)
    for _ in range(20):
        many = [" ".join(str(rng.randint(0, 10**6)) for _ in range(200)) for _ in range(10)]
        ids, offsets = encoder.encode(many)
        assert all(ids[offsets[i] : offsets[i + 1]].tolist() == judge.encode(t).ids for i, t in enumerate(many))
    memo = encoder.chunks
    assert memo.words.nbytes + memo.ids.nbytes < 100_000 and len(memo.words) == len(memo.met) == len(memo.offsets) - 1


def test_rows_that_share_an_id_are_split_in_order(spark, judge):
    rows = [(i, f"text {k}") for i in (None, 7) for k in range(400)] + [(k, "x") for k in range(6)]
    files = tf.write_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, block_docs=50)
    assert files.agg({"n_docs": "max"}).first()[0] < 200
    got = sorted(tf.read_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + list(range(6)) + [7] * 400
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
