import random

import pytest

from gleaner.llm import url_rules as u


def slow(rules, host, path):
    """Among the rules that fit, the one with most host labels, then the longest path."""
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None  # "block" is the greater word


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "")),
        ("example.net/x", ("", "")),
        ("http://Example.NET", ("example.net", "")),
        ("http://a.b/c/d?e#f", ("a.b", "/c/d")),
        ("http://a.b?x=/c", ("a.b", "")),
        ("http://a.b#/c", ("a.b", "")),
        ("x://y://z/w", ("y:", "//z/w")),
        ("http://ÄB.net/É", ("Äb.net", "/É")),
        ("://", ("", "")),
    ],
)
def test_split(url, want):
    assert u.split_url(url) == want


def test_trie_matches_a_scan_of_all_rules():
    rng = random.Random(31)
    labels, segments = ["a", "b", "net", "org"], ["", "x", "xy", "en"]
    make = lambda: (".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), "/" + "/".join(rng.choice(segments) for _ in range(rng.randint(0, 3))))
    for _ in range(60):
        rules = [(h, p, rng.choice(["allow", "block"])) for h, p in (make() for _ in range(12))]  # some with both verdicts
        trie = u.UrlTrie(rules)
        for _ in range(60):
            host, path = make()
            path = rng.choice([path, path + "/tail", ""])
            assert (trie.match(host, path) or (None,) * 2)[:2] == (slow(rules, host, path) or (None, None))


def test_tables(spark):
    rows = [(1, "http://a.example.net/en/x", "k"), (2, "http://b.net/", "k"), (3, "http://b.net", "k"), (None, None, "k"), (4, "https://X.org/fr/", "k"), (4, "https://X.org/fr/", "k"), (5, "http://example.com/de/a", "k"), (6, "http://notexample.com/de/a", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((str(r.page_id), str(r.rule), r.verdict) for r in u.judge_urls(pages).collect())
    assert got == [("1", "example.net/en/", "allow"), ("2", "net/", "block"), ("3", "None", "allow"), ("4", "org/fr/", "allow"), ("4", "org/fr/", "allow"), ("5", "example.com/de/", "block"), ("6", "None", "allow"), ("None", "None", "allow")]
    assert u.judge_urls(pages.limit(0)).collect() == []
    with pytest.raises(ValueError):
        u.UrlTrie([("a", "/", "maybe")])


def test_long_lists_are_cut_into_several_tries(spark):
    rng = random.Random(32)
    rules = [(f"{rng.choice('abcdef')}.{rng.choice('xyz')}.net", rng.choice(["", "/", "/p", "/p/q", "/p/qr/"]), rng.choice(["allow", "block"])) for _ in range(200)]
    rows = [(i, f"http://{rng.choice('gh')}.{rng.choice('abcdef')}.{rng.choice('xyz')}.net{rng.choice(['', '/', '/p/q', '/p/qr/s', '/z'])}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one, many = (sorted(map(tuple, u.judge_urls(pages, rules, max_edges=n).collect())) for n in (10**6, 120))
    assert 3 < len(u.tries(rules, 120)) < 9 and one == many
    for _, host, path, rule, verdict in one:
        assert (rule, verdict) == (slow(rules, host, path) or (None, "allow"))
