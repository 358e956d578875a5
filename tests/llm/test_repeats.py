import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import repeats as r


def slow(many, span):
    """Per text: the bytes left, by counting every window."""
    data = [(t or "").encode() for t in many]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        out.append(" ".join(parts))
    for _ in range(n // 3):
        t = list(rng.choice(out))
        t[rng.randrange(len(t))] = "X"
        out.append("".join(t))
    return [*out, out[0], out[0], "ab" * 90, "z" * 150, "", None, "short", "ab" * 40]


@pytest.mark.parametrize(("seed", "limit"), [(1, 4096), (2, 4096), (3, 3), (4, 0)])
def test_matches_window_counts(spark, seed, limit):
    many = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(many)], "doc_id long, text string, spans string")
    removed = r.remove(docs, span=40, passage=24, gram=12, group_limit=limit)
    got = {x.doc_id: tuple(x)[1:] for x in r.summary(removed).collect()}
    want, passages = slow(many, 40), slow(many, 24)
    assert [got[i] for i in range(len(many))] == [(*w, p[1]) for w, p in zip(want, passages, strict=True)]
    assert [len(x.passages) for x in removed.orderBy("doc_id").collect()] == [p[2] for p in passages]
    assert 1000 < sum(w[1] for w in want) < sum(p[1] for p in passages)


def test_windows_of_contexts_match_plain_comparison():
    rng = random.Random(5)
    for _ in range(200):
        contexts, anchor, group = [], [], []
        for g in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 12)):
                left = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
                right = "".join(rng.choice("ab") for _ in range(rng.randint(8, 14)))
                contexts.append((left + right).encode())
                anchor.append(len(left))
                group.append(g)
        span = 8
        got = r.repeated_windows(contexts, anchor, group, span)
        for i, c in enumerate(contexts):
            want = set()
            for w in range(len(c) - span + 1):
                at = anchor[i] - w
                if at < 0:
                    continue
                for j, d in enumerate(contexts):
                    v = anchor[j] - at
                    if j != i and group[i] == group[j] and 0 <= v <= len(d) - span and d[v : v + span] == c[w : w + span]:
                        want.add(w)
            assert {w for a, b in got[i] for w in range(a, b + 1)} == want


def test_long_text_in_pieces():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(r._PIECE + 5000))
    found = r.anchors_of([b"x" * 10, data])
    for level, span in enumerate((r.SPAN, r.PASSAGE)):
        windows = sorted((c - a, c - b) for c, reach in zip(found[1].tolist(), found[2].tolist(), strict=True) for a, b in [r.reach_of(reach)[level] or (0, 1)] if a >= b)
        assert windows[0][0] == 0 and windows[-1][1] == len(data) - span
        assert all(b + 1 == c for (_, b), (c, _) in zip(windows, windows[1:], strict=False))


def test_a_passage_of_fifty_words_is_reported_and_not_removed(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = words(51)
    rows = [(i, f"{words(60)} {passage if i < 3 else words(51)} {words(30 * i)}") for i in range(6)]
    got = sorted(r.summary(r.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert [x.n_removed for x in got] == [0] * 6
    assert [len(passage) <= x.n_passage_bytes <= len(passage) + 4 for x in got] == [True] * 3 + [False] * 3 and not any(x.n_passage_bytes for x in got[3:])


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    docs = spark.createDataFrame([(None, long), (None, long), (1, None), (2, "a")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans) for x in r.remove(docs).collect())
    n = len(long)
    assert got == [("1", 0, 0, 0), ("2", 1, 0, 0), ("None", n, n, 1), ("None", n, n, 1)]
    assert r.remove(docs.limit(0)).collect() == []


def test_many_copies_of_one_row_are_bounded(spark):
    """100,000 rows with the same id and text: each stretch is gathered once, not once a row."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150))
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    one = r.spans(docs.limit(2))[1].select(F.size("spans").alias("n")).first().n
    assert [x.n for x in r.spans(docs)[1].select(F.size("spans").alias("n")).collect()] == [one]
    got = r.summary(r.remove(docs)).groupBy("n_removed", "n_spans", "kept_sha256").count().collect()
    assert [(x.n_removed, x.n_spans, x["count"]) for x in got] == [(len(text), 1, 100_000)]
