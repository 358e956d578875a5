import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import extract, fold
from tests.test_operators import canon, slow_extract

ROWS = "doc_id long, start long, text string, canon string, block string, extra int"


def plain(rows, threshold):
    out = []
    for doc in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1:3]):
            g = extract._grams(r[3])
            if last is None or extract._alike(last, g) < threshold:
                last = g
                out.append((r[0], r[1]))
    return sorted(out, key=str)


@pytest.fixture
def many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("threshold,change", [(0.92, 1), (0.5, 2), (0.3, 1), (0.9, 0), (0.0, 3), (1.0, 1)])
def test_long_documents_fold_as_in_one_piece(spark, many_blocks, threshold, change):
    """Slowly changing sentences: chains that enter a stretch in different states meet late or never."""
    rng = random.Random(change)
    rows = []
    for doc, n in ((1, 700), (2, 5), (None, 300), (3, 1)):
        words = [rng.choice(["cache", "limit", "use", "set", "naïve"]) for _ in range(12)]
        for i in range(n):
            for _ in range(change):
                words[rng.randrange(12)] = rng.choice(["cache", "limit", "use", "set", "é", str(rng.randint(0, 9))])
            text = " ".join(words)
            rows.append((doc, 3 * i, text, canon(text), "x", i))
    got = fold.collapse_long(spark.createDataFrame(rows, ROWS).repartition(3), threshold)
    assert got.columns == ["doc_id", "start", "text", "canon", "block", "extra"]
    assert sorted(((r.doc_id, r.start) for r in got.collect()), key=str) == plain(rows, threshold)


def test_chains_that_never_meet(spark, many_blocks):
    """Two sentences in turn, alike with one between: what is kept depends on the very first row."""
    a, b, c = "aaa bbb ccc ddd", "bbb ccc ddd eee", "ccc ddd eee fff"
    for first in ([], [c]):
        texts = first + [(a, b, c)[i % 3] for i in range(400)]
        rows = [(1, i, t, t, "", 0) for i, t in enumerate(texts)]
        for threshold in (0.3, 0.5, 0.6):
            got = fold.collapse_long(spark.createDataFrame(rows, ROWS), threshold)
            assert sorted(((r.doc_id, r.start) for r in got.collect()), key=str) == plain(rows, threshold)


def test_empty_table(spark):
    assert fold.collapse_long(spark.createDataFrame([], ROWS), 0.9).collect() == []


def test_one_long_text_in_several_tasks(spark, many_blocks):
    rng = random.Random(5)
    words = ["use", "the", "cache", "must", "we", "set", "limit", "x1", "naïve", "always", "never"]
    text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) + "." for _ in range(6000))
    docs = spark.createDataFrame([(1, text), (2, "We must use the cache here."), (3, None)], "doc_id long, text string")
    c = extract.exact_dedup(extract.candidates(docs))
    assert c.repartitionByRange("doc_id", "start", "text").where("doc_id = 1").select(F.spark_partition_id()).distinct().count() >= 5
    for opts in (extract.ExtractOptions(jaccard_threshold=0.6), extract.ExtractOptions(target_count=7, per_window_quota=4)):
        got = {}
        for r in fold.extract_long_units(docs, opts).collect():
            got.setdefault(r.doc_id, []).append((r.id, r.text))
        assert sorted(got[1]) == slow_extract(text, 3500, opts.target_count, opts.jaccard_threshold, opts.per_window_quota)
        assert got[2] == [("0:0-27", "We must use the cache here.")] and 3 not in got
