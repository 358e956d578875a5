import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.operators import similarity
from tests.test_operators import canon, grams


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def check(spark, rows, threshold):
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(grams(canon(t or ""))), []).append(i)
    found = similarity.similar(spark.createDataFrame(rows, "id long, text string").repartition(4), threshold)
    own = list(sets.items())
    want = {}
    for k, (x, xs) in enumerate(own):
        for y, ys in own[:k]:
            if alike(x, y) >= threshold:
                want[tuple(sorted((min(xs), min(ys))))] = alike(x, y)
    assert {(r.a, r.b): r.similarity for r in found.pairs.collect()} == want
    links = {i: (min(xs), sum(len(ys) for y, ys in own if alike(x, y) >= threshold) - 1) for x, xs in own for i in xs}
    assert {r.id: (r.class_id, r.n_links) for r in found.members.collect()} == links


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 0.8, 1.0])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["cache", "the cache", "limit", "set", "naïve", "use", "always", "42", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    texts += [t + rng.choice(["!", " x", ". The", "s"]) for t in texts[:60]] + ["", None, "a", "ab", "!!", "Set Set", "😀😀😀😀", "😀😀 😀"] + texts[:10]
    check(spark, list(enumerate(texts)), threshold)


def test_frequent_trigrams_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(similarity, "RANKED", 50)
    rng = random.Random(3)
    check(spark, [(i, f"common opening {rng.randint(0, 40)} {rng.choice('abc')} common ending") for i in range(150)], 0.7)


def test_many_copies_are_one_class(spark):
    df = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, "the same words in all").otherwise(F.concat(F.lit("other text "), F.sha1(F.col("id").cast("string")))).alias("text"))
    found = similarity.similar(df, 0.9)
    assert found.pairs.count() == 0
    hot = found.members.where("id % 3 = 0")
    assert hot.select("class_id", "n_links").distinct().collect() == [(0, 2_999)]


def test_edges(spark):
    with pytest.raises(GleanerError):
        similarity.similar(spark.createDataFrame([], "id long, text string"), 0.0)
    none = similarity.similar(spark.createDataFrame([], "id long, text string"), 0.5)
    assert none.pairs.collect() == [] and none.members.collect() == []
    twice = similarity.similar(spark.createDataFrame([(1, "one text", 5, "x"), (1, "one text", 6, "y"), (None, "one texts", 7, "z")], "id long, text string, n int, digest string"), 0.5)
    assert sorted(map(tuple, twice.members.collect()), key=str) == [(1, 1, 2), (1, 1, 2), (None, None, 2)]


def syllables(rng, most):
    made = ["er", "th", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "ou", "ing", "tion", "ble", "ly"]
    return " ".join("".join(rng.choices(made, k=rng.randint(1, 3))) for _ in range(rng.randint(2, most)))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_long_texts_of_common_trigrams(spark, threshold):
    rng = random.Random(7)
    texts = [syllables(rng, 250) for _ in range(80)]
    for t in texts[:60]:
        words = t.split()
        cut = rng.randint(0, len(words) // 2)
        texts += [" ".join(words[cut:]), " ".join(words[: len(words) - cut // 4] + [syllables(rng, 20)])]
    check(spark, list(enumerate(texts)), threshold)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_trigrams():
    rng = np.random.default_rng(2)
    sets = [rng.choice(500, n, replace=False) for n in rng.integers(1, 400, 60)]
    for words in (2, 8):
        maps = np.array(similarity.bitmaps(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets[:-1]]), words)).view(np.uint64)
        for i, x in enumerate(sets):
            for k, y in enumerate(sets):
                assert np.bitwise_count(maps[:, i] ^ maps[:, k]).sum() <= len(np.setxor1d(x, y))


def test_few_sets_at_a_time(monkeypatch):
    monkeypatch.setattr(similarity, "AT_ONCE", 10)
    sizes = [1, 4, 4, 4, 30, 1, 1, 9, 25]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([list(range(n)) for n in sizes], pa.list_(pa.int64()))], ["digest", "grams"])
    parts = list(similarity._slices(b))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert all(sum(map(len, p.column(1).to_pylist()[:-1])) <= 10 for p in parts)
    assert list(similarity._slices(b.slice(0, 0))) == []


@pytest.mark.parametrize("threshold", [1e-40, 0.01, 0.6, 1.0])
def test_ranges_end_behind_the_longest(threshold):
    for longest in (0, 1, 7, 400):
        first = similarity._ranges(threshold, longest)
        assert first.dtype == np.int64 and first[0] == 1 and first[-1] == longest + 1 and (np.diff(first) > 0).all()


def on_disk(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, files in os.walk(d.getPath()) for f in files)


def test_disk_is_in_proportion_to_the_texts(spark):
    """Texts that share all their trigrams with many others, few of them alike: what is shuffled follows the texts, not the pairs."""
    rng = random.Random(5)
    rows = [(i, syllables(rng, 25)) for i in range(4_000)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = on_disk(spark)
        assert similarity.similar(spark.createDataFrame(rows, "id long, text string"), 0.6).members.count() == 4_000
        used, read = on_disk(spark) - before, sum(len(t) for _, t in rows)
        assert used < 50 * read, (used, read)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
