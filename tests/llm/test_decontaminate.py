import os
import random

import pytest

from gleaner.llm import decontaminate as d


def slow_best(pattern, text):
    """Fewest edits of the whole pattern anywhere in the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def noisy(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abc é") + text[i:], text[:i] + rng.choice("abc") + text[i + 1 :]])
    return text


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_alignment_matches_the_full_table():
    rng = random.Random(12)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(5, 40)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + noisy(rng, pattern, rng.randint(0, 5)) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        for budget in (2, 5):
            want = slow_best(pattern, text)
            got = d.align(pattern, text, budget)
            if want > budget:
                assert got is None
            else:
                assert got[0] == want == slow_best(pattern, text[got[1] : got[2]]) and abs(got[2] - got[1] - len(pattern)) <= budget


def test_finds_what_brute_force_finds():
    rng = random.Random(13)
    items = [(i, words(rng, 30)) for i in range(15)]
    index = d.Index(items)
    docs = []
    for k in range(120):
        text = words(rng, rng.randint(0, 40))
        if k % 2:
            text += " " + noisy(rng, items[k % 15][1], k % 14).upper().replace(" ", " \n") + " " + words(rng, 10)
        docs.append(text)
    got = {}
    for doc, item, start, end, edits in d.matches(index, docs):
        got[doc, item] = edits
        assert 0 <= slow_best(index.texts[index.ids.index(item)], d.normal(docs[doc][start:end])) - edits <= 2  # white space at either end is trimmed
    want = {}
    for k, text in enumerate(docs):
        for j, t in enumerate(index.texts):
            if (e := slow_best(t, d.normal(text))) <= index.budget[j]:
                want[k, index.ids[j]] = e
    assert got == want and len(want) > 30


def test_places_map_back():
    for text in ["", " ", "Ab  c\n\tD", "İx  ß", " lead"]:
        n = d.normal(text)
        p = d.places(text)
        assert len(p) == len(n) + 1


def test_short_items_are_found_verbatim(spark):
    items = [(1, "Who wrote Faust?"), (2, "two  words"), (3, "two words"), (4, " \n"), (5, "¿qué?"), (6, "aa aa")]
    texts = ["He asked: who WROTE\n faust? x", "two wordsmith, untwo words", "a (two words) and Two Words.", "¿¿Qué??", "aa aa aa aa aa"]
    want = [(0, 1, 10, 27, 0), *((2, i, s, s + 9, 0) for i in (2, 3) for s in (3, 18)), (3, 5, 1, 6, 0), (4, 6, 0, 5, 0), (4, 6, 6, 11, 0)]
    for more in ([], [(7, words(random.Random(15), 30))]):
        assert sorted(d.matches(d.Index(items + more), texts)) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in d.find(docs, bench).collect()) == want
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [1]


def test_tables(spark):
    rng = random.Random(14)
    items = [(1, words(rng, 40)), (2, "too short"), (None, None), (3, words(rng, 25)), (3, words(rng, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = words(rng, 200)
    rows = [(10, clean, "k"), (11, "x " + items[0][1] + " y", "k"), (11, "x " + items[0][1] + " y", "k"), (None, items[3][1], "k"), (12, None, "k"), (13, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for size in (d.BLOCK_CHARS, 200):
        got = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in d.find(docs, bench, block_chars=size).collect())
        assert got == [("11", 1, 2, 2 + len(items[0][1]), 0)] * 2 + [("None", 3, 0, len(items[3][1]), 0)]
        left = d.clean(docs, bench, block_chars=size)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [10, 12, 13]
    assert d.find(docs, bench.limit(0)).collect() == [] == d.find(docs.limit(0), bench).collect()
    assert d.clean(docs, bench.limit(0)).count() == 6


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/benchmark.parquet"), reason="no test tables")
def test_recall_on_edited_items_of_the_tables(spark):
    """Items of the tables with up to half the allowed edits, put into documents: at least 0.95 of them are found, and nothing else."""
    rng = random.Random(41)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect() if r.text and len(d.normal(r.text)) >= d.MIN_CHARS][:150]
    rows = []
    for k, (i, text) in enumerate(items):
        edited = list(text)
        for _ in range(int(d.EDIT_RATE * len(text) / 2)):
            at = rng.randrange(len(edited))
            edited[at] = rng.choice(["", "x", edited[at] + "y"])
        rows.append((k, "some words before it " + "".join(edited) + " and some after"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.find(docs, bench).collect()}
    hit = sum((k, i) in found for k, (i, _) in enumerate(items))
    assert hit >= 0.95 * len(items)


def test_blocks_of_items_find_the_same(spark):
    rng = random.Random(42)
    items = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(8, 40)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y {t} z") for i, t in items], "doc_id long, text string")
    one, many = (sorted(map(tuple, d.find(docs, bench, block_chars=n).collect())) for n in (10**6, 3000))
    assert one == many and len(one) >= 40


def test_an_item_listed_many_times_is_one(spark):
    from pyspark.sql import functions as F

    item = "a question about the benchmark that is long enough to be an item of its own"
    bench = spark.range(20_000).select(F.lit(3).cast("long").alias("item_id"), F.lit(item).alias("text"))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, "nothing here")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in d.find(docs, bench, block_chars=1000).collect()] == [(1, 3, 0)]
    assert [r.doc_id for r in d.clean(docs, bench, block_chars=1000).collect()] == [2]
