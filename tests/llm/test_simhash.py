import random
import re

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """doc_id -> smallest doc_id within chains of links, by comparing all pairs."""
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 2:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d, _ in rows}


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "ÀB\x85c d e f g", " ".join(rng.choice("abcdefgh") for _ in range(3000))]
    texts += [" ".join(rng.choice(["The", "of", "and", "x,", "É"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert simhash.fingerprints_of(texts).tolist() == [slow_fingerprint(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == []


def test_long_text_in_parts():
    text = " ".join(str(i * 7919 % 1013) for i in range(150_000))
    assert simhash.fingerprints_of(["a b", text, "a b"]).tolist() == [slow_fingerprint("a b"), slow_fingerprint(text), slow_fingerprint("a b")]


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    fps, base = [], [rng.getrandbits(64) for _ in range(12)]
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    hot = rng.getrandbits(64)  # one segment shared by many, the other differing in a few bits
    fps += [hot ^ (1 << rng.randrange(32) | 1 << rng.randrange(32) | 1 << rng.randrange(32)) for _ in range(90)]
    fps += [0, 0, (1 << 64) - 1, 3, 1 << 63]
    rows = [(int(i * 3 + 1), f) for i, f in enumerate(fps)]
    ids = spark.createDataFrame([(d, int(np.uint64(f).astype(np.int64))) for d, f in rows], "doc_id long, fp long")
    want = slow_components(rows)
    for limit in (64, 2):
        got = ids.join(simhash.components(ids, pair_limit=limit), "fp").collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (5, "x y z", "c"), (5, "x y z", "c"), (4, "X y  z", "d")], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    f = f"{slow_fingerprint('x y z'):016x}"
    assert got == [("1", "0" * 16, 1), ("4", f, 4), ("5", f, 4), ("5", f, 4), ("None", "0" * 16, 1)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_one_stays_of_each_component_whatever_its_ids(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue yellow", "north south east west")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, d.upper()), (5, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", d), ("5", c), ("None", a), ("None", b)]


def test_null_ids_and_clashing_names(spark):
    words = ["alpha beta gamma delta epsilon zeta eta theta", "iota kappa lambda mu nu xi omicron pi", "rho sigma tau upsilon phi chi psi omega"]
    rows = [(None, t, k, k, -k, "x", "y") for k, t in enumerate(words)] + [(5, words[0], 7, 7, -7, "x", "y"), (5, words[0], 7, 7, -7, "x", "y"), (6, "one two three four five six seven", 8, 8, -8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t long, __fp long, tie long, kept_id string, FP string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    rows = sorted((r.text, r["__t"], r["__fp"], r.tie) for r in got.collect())
    assert rows == sorted([(words[0], 7, 7, -7), (words[1], 1, 1, -1), (words[2], 2, 2, -2), ("one two three four five six seven", 8, 8, -8)])
    with pytest.raises(ValueError, match="already"):
        simhash.with_fingerprint(docs)


def test_rows_that_repeat_id_and_text_but_not_the_rest(spark):
    """The one that stays does not hang on the order of the rows."""
    rows = [(5, "one two three four", k, {"k": k}) for k in range(40)] + [(6, "other words entirely here", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long, m map<string,long>")
    first = sorted((r.doc_id, r.extra) for r in simhash.one_of_each(docs.repartition(3)).collect())
    again = sorted((r.doc_id, r.extra) for r in simhash.one_of_each(docs.orderBy("extra", ascending=False).repartition(5)).collect())
    assert first == again and [d for d, _ in first] == [5, 6]
