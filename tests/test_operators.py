import random
import re
import unicodedata

from pyspark.sql import functions as F

from gleaner.operators import cost, extract, history, normalize, parse, synthesis
from gleaner.plans.workflow import knowledge
from gleaner.sources import inputs, sinks
from gleaner.streaming import incremental

SENTENCE = re.compile(r"""[^.!?]+[.!?]+(?=(?:[\\"')\]]*\s+)|$)""")


def canon(s):
    s = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s)
    return re.sub(r"\s+", " ", s.lower()).strip()


def grams(c):
    return {c[i : i + 3] for i in range(len(c) - 2)}


def slow_extract(text, size=3500, target=None, threshold=0.92, quota=None):
    """The whole extraction as a plain loop."""
    out, at, index = [], 0, 0
    whole = canon(text)
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (k := text[at:end].rfind(". ")) > 0:
            end = at + k + 2
        window = text[at:end]
        spans = [m.span() for m in SENTENCE.finditer(window)] or ([(0, len(window))] if window.strip() else [])
        for s, e in spans:
            t = window[s:e].strip()
            c = canon(t)
            n = len(c.split())
            if 4 <= n <= 24:
                imp = bool(re.search(r"^(?:(?:you|we)\s+)?(?:must|should|never|always)\b|^(?:use|set|avoid|ensure|check|install|enable|disable|measure|calculate)\b", c))
                score = 0.4 * (1 + whole.count(c)) + 0.2 * (1 - (at + s) / len(text)) + 0.2 * (min(n, 24) / 24) + 0.2 * imp
                out.append((index, at + s, at + e, t, c, round(score * 1e6)))
        at, index = end, index + 1
    if quota:
        out = [x for w in range(index) for x in sorted((y for y in out if y[0] == w), key=lambda y: (-y[5], y[1], y[3]))[:quota]]
    first = {}
    for x in sorted(out, key=lambda x: x[1]):
        first.setdefault(x[4], x)
    kept = []
    for x in sorted(first.values(), key=lambda x: (x[1], x[3])):
        a, b = (grams(kept[-1][4]), grams(x[4])) if kept else (set(), {""})
        if not kept or (len(a & b) / len(a | b) if a | b else 1.0) < threshold:
            kept.append(x)
    target = target if target is not None else int(max(40, min(90, round(len(text) / 2500))))
    return sorted((f"{x[0]}:{x[1]}-{x[2]}", x[3]) for x in sorted(kept, key=lambda x: (-x[5], x[0], x[1], x[3]))[:target])


def some_texts():
    rng = random.Random(4)
    words = ["use", "the", "cache", "must", "we", "set", "limit", "x1", "naïve"]
    texts = []
    for _ in range(25):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + rng.choice([". ", "! ", "? ", '." ', ".5 ", "\n"]) for _ in range(rng.randint(0, 60))]
        texts.append("".join(parts + parts[:2]))
    return texts + ["", "   ", "no end here at all now", None]


def test_extraction_matches_a_plain_loop(spark):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for opts in (extract.ExtractOptions(), extract.ExtractOptions(window_chars=300, target_count=5, jaccard_threshold=0.5, per_window_quota=3), extract.ExtractOptions(per_window_quota=0, nfkc=True)):
        got = {}
        for r in extract.extract_units(docs, opts).collect():
            got.setdefault(r.doc_id, []).append((r.id, r.text))
        for i, t in enumerate(texts):
            want = slow_extract(t or "", opts.window_chars, opts.target_count, opts.jaccard_threshold, opts.per_window_quota)
            assert sorted(got.get(i, [])) == want
    whole = extract.extract_documents(docs).collect()
    assert len(whole) == 26 and all(r.units == sorted(r.units, key=lambda u: u.start) for r in whole)
    assert {r.doc_id for r in extract.blank_documents(docs).collect()} == {i for i, t in enumerate(texts) if not (t or "").strip()}


def test_target_is_a_prefix_by_rank(spark):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    small, large = ({(r.doc_id, r.id) for r in extract.extract_units(docs, extract.ExtractOptions(target_count=n)).collect()} for n in (3, 4))
    assert small < large


def units(spark, rows):
    return spark.createDataFrame(rows, "ord long, type string, id string, name string, content string, source_video_id string")


def test_synthesis(spark):
    rows = [(1, "technique", "technique-a", "A", "One\n\nTwo\n\nsee technique-b", "v1"), (2, "technique", "technique-a", "B", "two \n\n\n\nThree technique-a technique-zz", "v2"), (3, "technique", "technique-b", "C", "technique-a", ""), (4, "pattern", "technique-b", "D", "", None)]
    got = {r.id: r for r in synthesis.synthesize(units(spark, rows)).collect()}
    a, b = got["technique-a"], got["technique-b"]
    assert (a.name, a.source_videos, a.cross_references, a.mixed_types) == ("A", ["v1", "v2"], ["technique-b"], False)
    assert a.content == "One\n\nTwo\n\nsee technique-b\n\nThree technique-a technique-zz"
    assert (b.source_videos, b.cross_references, b.mixed_types, b.content) == ([], ["technique-a"], True, "technique-a")
    s = synthesis.synthesize(units(spark, rows))
    assert [tuple(r) for r in synthesis.mutual_references(s).collect()] == [("technique-a", "technique-b")]
    page = {r.path: r.value for r in synthesis.unit_markdown(s).collect()}["techniques/technique-a.md"]
    assert "- `v1`" in page and "](../techniques/technique-b.md)" in page and page.startswith("# A\n\n**ID**: `technique-a`  \n")
    shuffled = {r.id: r for r in synthesis.synthesize(units(spark, rows[::-1]).repartition(3)).collect()}
    assert shuffled == got


def test_parser_and_its_traps(spark):
    raw = "## 1. TECHNIQUES EXTRACTED\n### Technique: No id\ntext\n### Technique: Has id\n**ID**: `technique-x`\nbody\n## code comment\nrest\n## 9. Configuration Recipes\n### Configuration: C\n**ID**: `config-c`\nk\n"
    rows = parse.parse_units(spark.createDataFrame([("v", raw), ("w", "nothing"), (None, None)], "video_id string, raw string")).collect()
    assert [(r.type, r.id) for r in rows] == [("technique", "technique-x"), ("config", "config-c")]
    assert rows[0].name == "Has id" and rows[0].content.endswith("body")  # a block without an id is none; ## ends a body
    assert rows[1].content == "### Config: C\n**ID**: `config-c`\nk"
    missing = parse.missing_sections(spark.createDataFrame([("KNOWLEDGE UNITS EXTRACTION 1. Techniques Extracted",)], "template string")).first().missing
    assert len(missing) == 9


def test_labels_cache_and_faults(spark):
    cs = spark.createDataFrame([(1, 0, "a", "first text"), (1, 1, "b", "x" * 400), (2, 0, "c", "other")], "doc_id long, ord long, id string, text string")
    empty = spark.createDataFrame([], "video_id long, unit_id string, type string, name string, summary string, confidence double, normalizer_sig string")
    sig = normalize.signature("m", "t", ["b", "a"])
    assert sig == normalize.signature("m", "t", ["a", "b"]) != normalize.signature("m", "t2", ["a", "b"])
    labels, cache = normalize.normalize(cs, empty, sig)
    rows = labels.orderBy("doc_id", "ord").collect()
    assert [r.id for r in rows] == ["a", "b", "c"] and len(rows[1].name) == 80
    assert all(r.ok for r in normalize.invariants(cs, labels).collect())

    def broken(doc, candidates):
        raise RuntimeError("provider down")

    again, _ = normalize.normalize(cs, cache, sig, broken)  # all cached: the provider is not asked
    assert {r.id: r.name for r in again.collect()} == {r.id: r.name for r in rows}
    partly, renewed = normalize.normalize(cs, cache.where("unit_id != 'b'"), sig, broken)
    assert sorted((r.id, r.type, r.name) for r in partly.collect()) == [("a", "component", "(unclear)"), ("b", "component", "(unclear)"), ("c", "technique", "other")]
    assert renewed.count() == 3
    stale, fresh = normalize.normalize(cs, cache, "other", normalize.stub_provider)
    assert stale.count() == 3 and {r.normalizer_sig for r in fresh.collect()} == {"other"}
    for bad in ([{"id": "zz"}], [{"id": "a", "type": "nope", "name": "n", "summary": "s", "confidence": 0.5}]):
        got = normalize.ask(cs.where("doc_id = 1"), lambda d, c, bad=bad: bad).collect()
        assert [r.name for r in got] == ["(unclear)"] * 2 and all(r.is_fallback and len(r.summary) <= 280 for r in got)


def test_history(spark):
    h = spark.createDataFrame([(1, True, 10), (2, False, 99), (3, True, 5)], "seq long, success boolean, file_size long")
    assert tuple(history.stats(h).first()) == (3, 2, 1, 15, 200 / 3)
    assert tuple(history.stats(h.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    assert [r.seq for r in history.recent(h, 2).collect()] == [3, 2] and history.recent(h, 0).count() == 3
    runs = spark.createDataFrame([("a", "completed", None), ("b", "failed", "boom"), ("c", "skipped", None)], "video_id string, status string, error string")
    r = history.run_counters(runs, 10).first()
    assert (r.completed, r.failed, r.skipped, r.progress) == (1, 1, 1, 30.0)
    assert [tuple(f) for f in history.failures(runs).collect()] == [("b", "boom")]
    twice = spark.createDataFrame([("a", 1, "x", 5), ("a", 1, "y", 6), ("b", 2, "z", 7)], "k string, t int, rn string, _rn int")
    assert history.latest(twice, ["k"], "t").columns == twice.columns and history.latest(twice, ["k"], "t").count() == 2
    assert history.latest(twice.repartition(3), ["k"], "t").where("k = 'a'").collect() == history.latest(twice, ["k"], "t").where("k = 'a'").collect()
    assert history.run_counters(runs.limit(0)).first().progress == 100.0


def test_cost(spark):
    u = spark.createDataFrame([("claude-3-haiku-20240307", 1000, 100), ("unknown", 1000, 100)], "model string, input_tokens long, output_tokens long")
    got = {r.model: r.cost for r in cost.with_cost(u).collect()}
    assert abs(got["claude-3-haiku-20240307"] - 0.000375) < 1e-12 and abs(got["unknown"] - 0.0225) < 1e-12


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"id": "v1", "snippet": {"title": "T", "publishedAt": "2024-01-15T10:30:00Z", "tags": ["a", "b"]}, "contentDetails": {"duration": "PT5M"}, "statistics": {"viewCount": "1500"}}, {"id": "v2"}]')
    items = inputs.json_array_file(spark, str(tmp_path / "items.json"), inputs.VIDEO_ITEM)
    v = inputs.parse_videos(items)
    row = v.first()
    assert v.count() == 1 and (row.duration_seconds, row.view_count, row.like_count, row.upload_date, row.category) == (300, 1500, 0, "2024-01-15", "")
    assert inputs.json_array_file(spark, str(tmp_path / "none.json"), inputs.VIDEO_ITEM).count() == 0
    (tmp_path / "broken.json").write_text("{nope")
    assert inputs.json_array_file(spark, str(tmp_path / "broken.json"), inputs.VIDEO_ITEM).count() == 0
    page = sinks.video_markdown(v.withColumn("transcript", F.lit(None).cast("string")).withColumn("extracted", F.lit("now"))).first().value
    assert "**Views:** 1,500 views" in page and "a, b" in page and "No transcript available" in page and "**Duration:** 5:00" in page
    (tmp_path / "t").mkdir()
    (tmp_path / "t/doc_1.md").write_text("# T\n\n## Transcript\n\n the words \n")
    assert [tuple(r) for r in inputs.transcript_files(spark, str(tmp_path / "t/*.md")).collect()] == [("1", "the words")]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), spark.createDataFrame([("b", 2)], "k string, n int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", 2)]
    syn = synthesis.synthesize(units(spark, [(1, "config", "config-a", "A", "x", "v1")]))
    sinks.write_knowledge_base(syn, str(tmp_path / "kb"))
    assert (tmp_path / "kb/configurations/config-a.md").read_text().startswith("# A\n\n**ID**: `config-a`")
    d = inputs.discover(spark.createDataFrame([("v1", 2), ("v1", 1), ("zz", 3)], "video_id string, relevance int"), v)
    assert [r.video_id for r in d.collect()] == ["v1"]
    over = inputs.with_overrides(v, spark.createDataFrame([("v1", None, 7, None)], "video_id string, description string, duration int, upload_date string")).first()
    assert (over.duration_seconds, over.upload_date) == (7, "2024-01-15")


def test_incremental_runs_do_each_document_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    text = "We must use the cache here. Always set the limit first of all."
    spark.createDataFrame([(1, text), (2, " ")], "doc_id long, text string").write.parquet(f"{src}/a")
    for more in ([(1, text), (3, text)], []):
        incremental.start(spark, f"{src}/*", out, check).awaitTermination(120)
        if more:
            spark.createDataFrame(more, "doc_id long, text string").write.parquet(f"{src}/b")
    incremental.start(spark, f"{src}/*", out, check).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/units").collect()) == [1, 1, 3, 3]
    assert sorted((r.doc_id, r.status) for r in spark.read.parquet(f"{out}/history").collect()) == [(1, "completed"), (2, "failed"), (3, "completed")]


def test_whole_workflow(spark):
    docs = spark.createDataFrame([(1, "Use the cache for it. Always set the limit."), (2, "Use the cache for it.")], "doc_id long, text string")
    cache = spark.createDataFrame([], "video_id long, unit_id string, type string, name string, summary string, confidence double, normalizer_sig string")
    found, cache = knowledge(docs, cache, "s")
    assert found.count() == 3 == cache.count()
