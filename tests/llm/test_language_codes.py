import os
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import language_codes as L

SCHEMA = "doc_id long, text string, lang string"
PARTS = {"en": ["the", "th", "ing", "ou", "wh", "tion"], "de": ["sch", "ei", "ung", "ie", "ö", "ch"], "fr": ["eau", "é", "ç", "qu", "oi"], "es": ["ción", "ñ", "ue", "os", "ll"], "pl": ["sz", "cz", "ł", "ow", "ż"], "fi": ["ää", "kk", "yö", "uu", "tt"], "it": ["gli", "zzi", "che", "ò"], "el": ["αι", "ου", "της", "και"]}


def sentence(lang, rng, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def slow_cells(text):
    """Counts of n-grams by definition, before hashing."""
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    s = " " + " ".join(s.split()) + " " if s.strip() else " "
    return sum(any(c != " " for c in s[i : i + n]) for n in L.ORDERS for i in range(len(s) - n + 1))


def test_ngrams_by_definition():
    rng = random.Random(1)
    many = ["", "a", "A b", "  x1y!!z ", "été – ÇA", "123", "日本語", "İstanbul"] + [sentence(rng.choice(list(PARTS)), rng, 5) for _ in range(30)]
    n = np.zeros(len(many), int)
    alone = []
    for cell, doc in L.cells(many):
        n += np.bincount(doc, minlength=len(many))
        alone.append((cell, doc))
    assert n.tolist() == [slow_cells(t) for t in many]
    cell, doc = (np.concatenate(x) for x in zip(*alone))
    for i, t in enumerate(many):  # the same whatever the neighbours
        assert sorted(cell[doc == i].tolist()) == sorted(c for part, _ in L.cells([t]) for c in part.tolist())


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 64)
    text = sentence("de", random.Random(2), 100)
    n = sum(len(c) for c, _ in L.cells([text, text]))
    assert n == 2 * sum(slow_cells(text[i : i + 64]) for i in range(0, len(text), 64))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 20, 60])
def test_codewords(n):
    code = L.code_matrix(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    if n > 1:
        assert (np.abs(code.sum(0)) < n).all()
        columns = {tuple(x * c[0] for x in c) for c in code.T.tolist()}
        assert len(columns) == code.shape[1]
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 4 else 4)


def test_a_wrong_bit_is_corrected():
    model = L.Model(["a", "b", "c", "d"], np.ones((4, L.BUCKETS)))
    z = model.code.astype(float)
    for i in range(4):
        for b in range(z.shape[1]):
            noisy = z[i].copy()
            noisy[b] *= -1
            assert model.losses(noisy[None]).argmin() == i


def test_unreliable_bits_weigh_less():
    model = L.Model(["a", "b", "c"], np.ones((3, L.BUCKETS)))
    right = np.array([[10, 10, 0], [10, 10, 10], [10, 10, 10]])
    model.weigh(right, np.array([10, 10, 10]), np.array([30.0, 30.0, 30.0]))
    assert model.trust[0, 2] < model.trust[0, 0] and np.allclose(model.trust.sum(1), 1)


@pytest.mark.parametrize("languages", [["en", "de", "fr", "es"], list(PARTS)])
def test_held_out_languages(spark, languages):
    rng = random.Random(3)
    rows = [(i, sentence(lang := rng.choice(languages), rng, rng.choice([3, 10, 60])), lang) for i in range(600)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    fold = [(got[i], lang) for i, _, lang in rows if got[i].held_out]
    assert sum(r.lang_pred == lang for r, lang in fold) >= 0.97 * len(fold)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rng = random.Random(4)
    rows = [(i, sentence(lang := rng.choice(["en", "de"]), rng), lang) for i in range(200)]
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, L.predict(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, swapped))
    assert a == b


def test_mixed_texts_are_ambiguous(spark):
    rng = random.Random(5)
    rows = [(i, sentence(lang := rng.choice(["en", "de"]), rng), lang) for i in range(200)]
    rows += [(1000 + i, sentence("en", rng, 20) + " " + sentence("de", rng, 20), None) for i in range(20)] + [(2000, "z", None)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2000].ambiguous and not any(got[i].ambiguous for i in range(200))
    assert np.mean([got[1000 + i].score for i in range(20)]) < np.mean([got[i].score for i in range(200)])


def test_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the thing", "en"), (4, "the thing", "en"), (None, "the", "fr"), (7, "the other thing", None)]
    got = L.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[None].held_out
    assert L.predict(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = L.predict(spark.createDataFrame([(1, "the", None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_one_language_and_copies(spark):
    rows = [(i, "the same thing", "en") for i in range(50)]
    got = L.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.lang_pred, r.score, r.ambiguous) for r in got} == {("en", 1.0, False)}


def test_clashing_columns(spark):
    rows = [(i, "the thing" if i % 2 else "schei", "en" if i % 2 else "de", "x", 1) for i in range(40)]
    assert L.predict(spark.createDataFrame(rows, SCHEMA + ", held_out string, h int")).count() == 40


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy_on_the_tables(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    fold = [r for r in L.predict(docs).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in fold) >= 0.99 * len(fold)
