import hashlib
import math
import random

import numpy as np
import pytest

from gleaner.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, width=None):
    """{position: (code, error, label_error)} and the digest, by comparing each part with each entry; rows: (vec_id, vector, label)."""
    kept = [(i, x, y) for i, x, y in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept = sorted(((i, [math.floor(1024 * float(np.float32(c))) for c in x], y) for i, x, y in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1])
    odd, kept = [r for r in kept if len(r[1]) != width], [r for r in kept if len(r[1]) == width]
    at = [i * width // 4 for i in range(5)]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(4):
        parts = [v[at[p] : at[p + 1]] for _, v, _ in kept]
        book = parts[:256]
        assign = lambda book: [min((sum((a - b) ** 2 for a, b in zip(x, z)), e) for e, z in enumerate(book)) for x in parts]  # noqa: B023, E731
        for _ in range(4):
            got = assign(book)
            for e in range(len(book)):
                own = [x for x, (_, f) in zip(parts, got) if e == f]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
        for k, (d, e) in enumerate(assign(book)):
            codes[k].append(f"{e:02x}")
            errors[k] += d
        books.append(book)
    total = {}
    for (_, _, y), e in zip(kept, errors):
        total[y] = total.get(y, 0) + e
    out = [(i, "".join(c), e, total[y]) for (i, _, y), c, e in zip(kept, codes, errors)]
    out += [(i, None, None, total.get(y)) for i, _, y in odd]
    return out, hashlib.sha256(",".join(str(c) for b in books for z in b for c in z).encode()).hexdigest()


def both(spark, rows):
    got = V.summary(V.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    want, digest = slow(rows)
    key = lambda r: str(tuple(r))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} <= {digest}


def cloud(n, width, rng, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("width,spread", [(8, 0.1), (16, 1.0), (4, 0.001), (6, 0.3)])
def test_equals_brute_force(spark, monkeypatch, width, spread):
    monkeypatch.setattr(V, "BLOCK", 100)
    rng = random.Random(width)
    rows = [(i, x, rng.choice([1, 2, None])) for i, x in enumerate(cloud(420, width, rng, spread))]
    both(spark, rows)


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = random.Random(3)
    one = [0.25] * 8
    rows = [(i, one if i % 3 else [rng.choice([-0.5, 0.0, 0.5]) for _ in range(8)], i % 2) for i in range(400)]
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [math.nan] * 8, 1), (403, [math.inf] + [0.0] * 7, None), (404, [1.0] * 4, 9), (405, [], 1)]
    rows += [(5, one, 1), (None, one, None), (None, [0.1] * 8, None)]
    both(spark, rows)


def test_empty_and_small_tables(spark):
    both(spark, [])
    both(spark, [(1, None, 1)])
    both(spark, [(1, [], 1), (2, [], None)])
    both(spark, [(9, [0.1, 0.2, 0.3, 0.4], 1), (3, [1.5, -2.5, 0.0, 7.0], 1)])


def test_large_components_count_as_the_bound(spark):
    rows = [(i, [3e38 if j == i else -3e38 for j in range(8)], 1) for i in range(5)]
    got = V.summary(V.compress(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.error for r in got} == {0} and len({r.code for r in got}) == 5


def test_clashing_names_and_rare_labels(spark):
    rng = random.Random(4)
    rows = [(i, x, i, i, "x") for i, x in enumerate(cloud(300, 8, rng))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, l int, error string")
    got = {r.vec_id: r for r in V.summary(V.compress(df)).collect()}
    assert len(got) == 300 and all(r.label_error == r.error for r in got.values())


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (500, 4)) + c for c in ([0] * 4, [1000] * 4, [-1000] * 4)])
    tree = V.Tree.over(points)
    book = np.array([[0] * 4, [1000] * 4, [-1000] * 4])
    ends = list(tree.subtrees(book))
    assert len(ends) < 20 and sum(b - a for _, a, b, _ in ends) == 1500
    assert sum(b - a for _, a, b, left in ends if len(left) == 1) > 1300
