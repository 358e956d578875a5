import math
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import quality as q

ROOT = "/root/testdata/sf0.01"


def toy(n=300):
    rng = random.Random(11)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "dog"]) for _ in range(30)) for _ in range(n)]
    bad = [" ".join(rng.choice(["buy!!", "$$$", "NOW!!", "click"]) for _ in range(30)) for _ in range(n // 5)]
    return [(i, t) for i, t in enumerate(good + bad)], {i: int(i < n) for i in range(n + n // 5)}


def test_draw_matches_a_plain_computation(spark):
    rows, label = toy()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, weight string")
    labels = spark.createDataFrame([(i, y) for i, y in label.items() if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.resample(docs, labels).collect()}
    counts = {}
    for i, t in rows:
        counts[i] = np.bincount(q.features([t])[0], minlength=q.BUCKETS)
    raw = sum(counts.values())
    target = sum(c for i, c in counts.items() if i % 2 and label[i])

    def ratio(target):
        return np.log((target + q.PRIOR) / (raw * target.sum() / raw.sum() + q.PRIOR))

    mean = lambda c, r: float(c @ r) / (c.sum() + q.CALM)
    own = {i: mean(counts[i], ratio(target - counts[i] * label[i])) for i in label if i % 2}
    scale = q.SPREAD / (np.median([own[i] for i in own if label[i]]) - np.median([own[i] for i in own if not label[i]]))
    best = max(sorted(own.values()), key=lambda w: np.mean([own[i] >= w for i in own if label[i]]) + np.mean([own[i] < w for i in own if not label[i]]))
    at = (best + max([v for v in own.values() if v < best], default=best)) / 2
    weight = {i: round(1e6 * scale * mean(c, ratio(target))) for i, c in counts.items()}
    k = sum(w / 1e6 >= scale * at for w in weight.values())
    import xxhash

    keys = {i: weight[i] + q.gumbel(f"{i}:".encode() + xxhash.xxh3_64_digest(t)) for i, t in rows}
    assert set(got) == set(sorted(keys, key=keys.get, reverse=True)[:k])
    assert all(abs(got[i].sample_key * 1e6 - keys[i]) < 100 for i in got)
    assert sum(label[i] == 0 for i in got) <= 3 and len(got) == k
    kept = q.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got)


def test_threshold():
    assert q.threshold([(5, 1), (9, 1), (1, 0), (2, 0)]) == 4
    assert q.threshold([(5, 1), (9, 1)]) is None is q.threshold([(1, 0)]) and q.threshold([]) is None
    assert q.threshold([(3, 1), (3, 0)]) == 3


def test_kth_largest(spark):
    values = [random.Random(3).randint(-(10**12), 10**12) for _ in range(500)] + [7] * 50
    rows = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for k in (1, 2, 77, 549, 550):
        assert q.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
    assert q.kth_largest(rows, "v", 551) is None and q.kth_largest(rows, "v", 0) is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert q.resample(docs, labels).count() == 4
    assert q.keep(docs, labels.limit(0)).count() == 4
    assert q.resample(docs.limit(0), labels).collect() == [] == q.keep(docs.limit(0), labels).collect()


def test_columns_of_clashing_names_are_kept(spark):
    rows, label = toy(40)
    docs = spark.createDataFrame([(i, t, i, -i, "l", None) for i, t in rows], "doc_id long, text string, weight long, `KEY` long, label string, own string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    kept = q.keep(docs, labels)
    assert kept.columns == docs.columns and all((r.weight, r.KEY, r.label, r.own) == (r.doc_id, -r.doc_id, "l", None) for r in kept.collect())


def test_the_draw_is_a_draw(spark, monkeypatch):
    """With little between good and bad texts the sample differs from the best k, and better texts are drawn more often."""
    monkeypatch.setattr(q, "SPREAD", 3.0)
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        share = i % 11 / 10
        rows.append((i, " ".join("the cat sat".split()[rng.randrange(3)] if rng.random() < share else "buy!! $$$ NOW!!".split()[rng.randrange(3)] for _ in range(30)), i % 11))
    docs = spark.createDataFrame(rows, "doc_id long, text string, share int")
    labels = docs.where("doc_id < 800 AND share NOT BETWEEN 4 AND 6").selectExpr("doc_id", "IF(share > 6, 1, 0) AS quality")
    got = {r.doc_id for r in q.resample(docs, labels).collect()}
    model = q.fit(docs, labels)
    weight = dict(zip([r[0] for r in rows], model.weights([r[1] for r in rows]).tolist()))
    above = {i for i, w in weight.items() if w >= model.at}
    assert len(got) == len(above) and 100 < len(got - above) < len(got)
    part = [sum(i in got for i, _, s in rows if s == share) / sum(s == share for _, _, s in rows) for share in range(11)]
    assert part[10] > part[7] > part[5] > part[2] and part[10] > 0.75 and part[0] < 0.25


def test_junk_of_any_length_goes_and_empty_texts_are_not_drawn(spark):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    junk = ["@@@ ### $$$ " * 10, "NOW!! BUY!! NOW!!", "a | b | c | d", "word word word word word word", "the*** of&&& and$$$"] * 4
    for root in (ROOT, ROOT.replace("0.01", "0.1")):
        docs, labels = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet")
        more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*junk, "", None, " \n"])], docs.schema)
        got = {r.doc_id for r in q.resample(docs.unionByName(more), labels).collect()}
        assert sum(10**9 + i in got for i in range(len(junk))) <= 0.1 * len(junk)
        assert not any(10**9 + len(junk) + i in got for i in range(3))
        clean = {r.doc_id for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) < 200").collect()}
        bad = {r.doc_id for r in docs.join(labels.where("quality = 0"), "doc_id").where("length(text) < 200").collect()}
        assert len(clean & got) >= 0.98 * len(clean) and len(bad - got) >= 0.8 * len(bad)  # two of sixteen are clean prose or a phone number before it


def test_weights_do_not_grow_with_length():
    rows, label = toy()
    model = q.Model(np.bincount(q.features([t for _, t in rows])[0], minlength=q.BUCKETS), np.bincount(q.features([t for i, t in rows if label[i]])[0], minlength=q.BUCKETS))
    one, many = model.weights([rows[-1][1], " ".join([rows[-1][1]] * 50)]).tolist()
    assert many < one < 0 and many > 1.6 * one


@pytest.mark.parametrize("half", [0, 1])
@pytest.mark.parametrize("root", [ROOT, ROOT.replace("0.01", "0.1")])
def test_held_out_accuracy(spark, root, half):
    if not os.path.exists(root):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    kept = {r.doc_id for r in q.resample(docs, labels.where(f"doc_id % 2 = {half}")).collect()}
    rest = pq.read_table(f"{root}/labels.parquet", columns=["doc_id", "quality"]).to_pydict()
    for y, least in ((1, 0.98), (0, 0.9)):
        judged = [(i in kept) == bool(y) for i, z in zip(rest["doc_id"], rest["quality"], strict=True) if i % 2 != half and z == y]
        assert sum(judged) >= least * len(judged)
