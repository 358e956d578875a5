import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    """The patterns as they stand, each by itself."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and slow_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def some_texts(n=400):
    rng = random.Random(21)
    bits = ["a.b@c.de", "x@y", "@", ".", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 555-6789", "+49", "+1.2.3.4 5 6 7 8 9", "é", " ", "-", "word", "0", "\n", "99"]
    return ["", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n))]


def test_base_spans_match_the_patterns():
    for text in some_texts(5000):
        assert pii.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 100_000):
        pii.base_spans(text)


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(200)]
    rows += [(1000 + i, f"{rng.choice(words)} {rng.choice(words)} zorblax {rng.choice(words)} joe@mail.org {rng.choice(words)} {rng.choice(words)}") for i in range(5)]
    rows += [(2000, "zorblax alone here"), *((3000 + i, "copy of one text by ann@mail.org qwert") for i in range(9))]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(rows)
    for d, t in rows:
        base = slow_base(t)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [getattr(got[d], f"n_{k}") for k in PATTERNS] == [sum(x[1] == i for x in base) for i in range(4)]
    for i in range(5):
        kinds = {s.split(":")[0]: text[1000 + i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[1000 + i].spans.split(",")}
        assert kinds["email"] == "joe@mail.org" and "zorblax" in kinds.values()
    assert got[2000].spans == "" and all(got[3000 + i].spans.count(":") == 2 for i in range(9))  # no entity; copies are one context
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all(clean[d] == t for d, t in rows if not slow_base(t))
    assert "zorblax" not in clean[1000] and "[EMAIL]" in clean[1000]


def test_entities_of_one_or_two_contexts_are_judged(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(3000)]
    rows += [(5000, "w1 zorblax w2 joe@mail.org w3"), (5001, "w4 vexigan w5 ann@mail.org w6"), (5002, "w7 vexigan w8 ann@mail.org w9")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000] == "email:14:26"  # one sighting is no evidence
    assert got[5001] == got[5002] == "generalise:3:10,email:14:26"  # ln(3003 * 2 / (3 * 2)) / ln(3003 / 2) = 0.94


def test_copies_do_not_hide_a_term(spark, monkeypatch):
    rng = random.Random(24)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(20))) for i in range(1000)]
    rows += [(5000 + i, f"w{i} zorblax w{i + 3} joe@mail.org w{i + 6}") for i in range(3)]
    rows += [(6000 + i, rows[1000][1]) for i in range(999)]
    rows += [(7000 + i, None if i % 2 else "") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for limit in (pii.BROADCAST_BYTES, -1):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        of_term, n = pii._counted(docs.select("text"))
        found = {r.term: r.n_term for r in of_term.collect()}
        assert n == len({t or "" for _, t in rows}) and found[pii.term_key("zorblax")] == 3
        assert all(found[pii.term_key(f"w{i}")] == len({t for _, t in rows if t and f"w{i}" in t.split()}) for i in range(200))
        got = [r.spans for r in pii.find(docs).collect() if r.doc_id >= 5000 and r.doc_id < 7000]
        assert len(got) == 1002 and all(s.startswith("remove:3:10,") for s in got)


def test_joined_lookup_equals_broadcast(spark, monkeypatch):
    rows = [(i, f"a{i} zorblax near joe@mail.org b{i} c{i}") for i in range(6)] + [(9, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, pii.find(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, pii.find(docs).collect())) == one and any("remove" in r[-1] for r in one)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "x@y.zz", 3), (2, "x@y.zz", 3)], "doc_id long, text string, n_chars int")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.find(docs).collect())
    assert got == [("1", 0, ""), ("2", 1, "email:0:6"), ("2", 1, "email:0:6"), ("None", 0, "")]
    out = pii.sanitise(docs, length_col="n_chars")
    assert out.columns == docs.columns
    assert sorted((str(r.text), r.n_chars) for r in out.collect()) == [("", 0), ("None", None), ("[EMAIL]", 7), ("[EMAIL]", 7)]
    assert pii.find(docs.limit(0)).collect() == [] == pii.sanitise(docs.where(F.lit(False))).collect()


def test_redaction_joins_overlaps():
    text = "call +1 234 567 8901 2345 now"
    assert pii.redact(text, pii.base_spans(text)).count("[") == 1
    assert pii.redact("a zz b 12", [(2, 5, 4), (7, 5, 9)]) == "a [TERM] b [NUMBER]"


def test_many_entities_and_long_runs_in_one_text():
    import time

    text = " ".join(f"word{i} a{i}@b.org" for i in range(100_000))
    began = time.process_time()
    spans = pii.base_spans(text)
    assert len(spans) == 100_000
    rows = sum(b.num_rows for b in pii._evidence(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])))
    assert rows >= 100_000
    terms = {pii.term_key("word5"): "remove", pii.term_key("word99999"): "generalise"}
    assert len(pii.all_spans(text, spans, terms)) == 100_002
    assert pii.base_spans("0" * 10_000 + "1.1.1.255") == [(0, 1, 10_009)]
    assert pii.base_spans("9" * 10_000 + ".1.1.1 1.1.1.256 1.2.3.4") == [(10_017, 1, 10_024)]
    pii.base_spans("@" * 50_000 + "a." * 50_000 + "1." * 50_000 + "+1" * 50_000 + "1-" * 50_000)
    assert time.process_time() - began < 60


@pytest.mark.parametrize("size", [0, 32 << 20])
def test_columns_of_clashing_names_are_kept(spark, monkeypatch, size):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", size)
    rows = [(i, f"call zorro{i % 3} at a{i % 3}@b.org now {i}", i, -i, "x") for i in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __terms long, __key long, id string")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == 41 and all((r["__terms"], r["__key"], r.id) == (r.doc_id, -r.doc_id, "x") for r in rows if r.doc_id is not None)
    assert all("@" not in r.text for r in rows if r.text)
    assert pii.find(docs, id_col="__key").columns[0] == "__key"


def test_precision_and_recall_of_added_spans(spark):
    """Names that go with an entity are found, words that are only rare are left, in a small and a larger corpus."""
    for n in (400, 6000):
        rng = random.Random(n)
        common = [f"w{i}" for i in range(150)]
        fill = lambda k: [rng.choice(common) for _ in range(k)]  # noqa: B023, E731
        rows, names = [], {}
        for p in range(20):  # a person's name beside their address in two to five texts
            names[f"name{p}x"] = f"person{p}@mail.org"
            for _ in range(rng.randint(2, 5)):
                rows.append(" ".join([*fill(5), f"name{p}x", rng.choice(common), names[f"name{p}x"], f"once{len(rows)}q", *fill(5)]))
        rows += [" ".join([*fill(4), f"rare{i}z", f"other{i}@mail.org", f"hash{i}k", *fill(6)]) for i in range(60)]  # entities met once, beside words met once
        rows += [" ".join(fill(15)) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        added, right = [], 0
        for r in pii.find(docs).collect():
            for span in filter(None, r.spans.split(",")):
                kind, start, end = span.split(":")
                if kind in ("remove", "generalise"):
                    added.append(rows[r.doc_id][int(start) : int(end)])
        right = sum(a in names for a in added)
        planted = sum(any(x in names for x in t.split()) for t in rows)
        assert right >= 0.9 * planted and right >= 0.9 * len(added)
