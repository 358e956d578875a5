import random
import sys
import unicodedata

from gleaner.functions import text as T
from gleaner.operators import extract
from tests.test_operators import slow_extract


def by_definition(s):
    s = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s)
    return " ".join(unicodedata.normalize("NFKC", s).lower().split())


def test_the_class_holds_all_that_nfkc_changes():
    rng = random.Random(1)
    table = T._touched()
    touched = lambda s: any(table[ord(c)] for c in s)
    assert all(table[i] for i in range(sys.maxunicode + 1) if unicodedata.normalize("NFKC", chr(i)) != chr(i) and not 0xD800 <= i <= 0xDFFF)
    alphabet = [chr(i) for i in (*range(0x20, 0x250), 0x300, 0x301, 0x308, 0x323, 0x1100, 0x1161, 0x11A8, 0x9BE, 0x9C7, 0x3099, 0x304B, 0xAC00, 0xFF21, 0xFB01, 0x2460, 0x1F600)]
    for _ in range(20_000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
        assert touched(s) or unicodedata.is_normalized("NFKC", s)
        plain = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s)
        assert T.changes(s) or unicodedata.normalize("NFKC", plain) == plain
    assert not touched("Plain text, naïve façade, Größe, ñandú, Привет, 日本語のかな, 한국어 😀")


def test_comparison_form_of_any_text(spark):
    texts = ["Ｆｕｌｌ　ｗｉｄｔｈ！", "ﬁne ﬂow ﬃ", "①②③ ⑴ ½", "étude", "Ångström Å", "ｶﾞ", "a b", "x²", "plain", "Größe", "", None, "각", "각", "ﷺ", "ſ", "µ μ", "日本語", "İ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.canon_column("t").alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: None if t is None else by_definition(t) for i, t in enumerate(texts)}


def test_no_plain_text_leaves_the_jvm(spark):
    """Texts of common scripts do not have the characters that send a text to Python."""
    texts = ["Plain, text.", "naïve façade Größe ñandú", "Привет мир", "日本語の", "한국어", "Ελληνικά"]
    assert spark.createDataFrame([(t,) for t in texts], "t string").where(f"t RLIKE {T.literal(T.outside_plain())}").count() == 0


def test_extraction_of_wide_ligature_and_circled_text(spark):
    rng = random.Random(2)
    words = ["ｕｓｅ", "use", "ﬁx", "fix", "the", "①", "1", "ｍｕｓｔ", "we", "café", "café", "x²"]
    texts = ["".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + rng.choice([". ", "! "]) for _ in range(40)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in extract.extract_units(docs, extract.ExtractOptions(window_chars=300, jaccard_threshold=0.8)).collect():
        got.setdefault(r.doc_id, []).append((r.id, r.text))
    import tests.test_operators as plain

    saved, plain.canon = plain.canon, by_definition
    try:
        want = {i: slow_extract(t, 300, None, 0.8) for i, t in enumerate(texts)}
    finally:
        plain.canon = saved
    assert {i: sorted(x) for i, x in got.items()} == want
