import hashlib
import random
import re

import numpy as np

from gleaner.llm import spotsigs as sp


def slow_chains(text):
    """The chains themselves, by a plain loop."""
    words = re.findall(r"\w+", text.lower())
    few = sum(w in sp.ANCHORS for w in words) < sp.MIN_ANCHORS
    chains = set()
    for i, w in enumerate(words):
        if few or w in sp.ANCHORS:
            rest = [x for x in words[i + 1 :] if few or x not in sp.ANCHORS][: sp.CHAIN]
            if len(rest) == sp.CHAIN:
                chains.add((w, *rest))
    return chains or ({" ".join(words)} if words else set())


def some_texts(n, seed=7):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "la", "and", "der", *(f"w{i}" for i in range(30))]
    return ["", "one", "One!", "the the the the", "a, b", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_signatures_match_plain_chains():
    many = some_texts(300)
    sigs = sp.signatures(many)
    chains = [slow_chains(t) for t in many]
    for i in range(0, 300, 7):
        assert len(sigs[i]) == len(chains[i])
        for j in range(0, 300, 11):
            union = chains[i] | chains[j]
            want = len(chains[i] & chains[j]) / len(union) if union else 1.0
            assert abs(sp.pruned_jaccard(sigs[i], sigs[j]) - want) < 1e-12
    assert sp.signatures([]) == []


def test_edits_and_neighbours_match_a_loop(spark):
    rows = [(i * 5 - 40, t) for i, t in enumerate(some_texts(200))] + [(10**9, None), (None, "null id the end")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, next string")
    got = {r.doc_id: r for r in sp.compare_with_edits(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + f[:m]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sp.signatures([t, edited, f])
        assert (r.fingerprint, r.edited_fingerprint) == (sp.as_string(a), sp.as_string(b))
        assert (r.near_edited, r.near_next) == (sp.pruned_jaccard(a, b), sp.pruned_jaccard(a, c))
    one = docs.where("doc_id = 10")
    assert [r.near_next for r in sp.compare_with_edits(one).collect()] == [1.0]
    assert sp.compare_with_edits(docs.limit(0)).collect() == []
    assert sp.compare_with_edits(one.unionByName(one)).count() == 2


def test_pairs_match_all_pairs(spark):
    rng = random.Random(8)
    base = some_texts(12, seed=9)[5:]
    many = [*base, "", "", base[0]]
    for t in base:
        words = t.split()
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = f"w{rng.randrange(30)}"
            many.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "doc_id long, text string")
    members, pairs = sp.near_duplicates(docs, 0.6)
    sigs = sp.signatures(many)
    of = {}
    want_class = {}
    for i, s in enumerate(sigs):
        want_class[i] = of.setdefault(s.tobytes(), i)
    assert {r.doc_id: r["class"] for r in members.collect()} == want_class
    reps = sorted(set(want_class.values()))
    want = {(a, b): v for a in reps for b in reps if a < b and (v := sp.pruned_jaccard(sigs[a], sigs[b])) >= 0.6 - 1e-9}
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values())) and want
