import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.functions import formatting as fmt
from gleaner.functions import text as T
from gleaner.operators import analyze, compare, extract, normalize, runs
from gleaner.sources import inputs, sinks


def test_extraction_runs_retry_and_never_throw(spark):
    waited = spark.sparkContext.accumulator(0.0)

    def fetch(video_id, attempt):
        if video_id == 1:
            raise GleanerError("not_found")
        if video_id == 2 and attempt < 2:
            raise RuntimeError("busy")
        if video_id == 3:
            raise RuntimeError("down")
        return None if video_id == 4 else "text é"

    items = spark.createDataFrame([(i,) for i in range(7)], "video_id long")
    done = spark.createDataFrame([(5, "completed"), (6, "failed")], "video_id long, status string")
    got = {r.video_id: r for r in runs.run_extraction(items, done, fetch, max_retries=2, jitter=0.0, sleep=waited.add).collect()}
    assert [(got[i].status, got[i].error, got[i].attempts, got[i].delay) for i in range(7)] == [("completed", None, 1, 0.0), ("failed", "not_found", 1, 0.0), ("completed", None, 3, 3.0), ("failed", "extraction_failed", 3, 3.0), ("failed", "blank", 1, 0.0), ("skipped", None, None, None), ("completed", None, 1, 0.0)]
    assert waited.value == 6.0 and got[0].file_size == 7 and runs.run_extraction(items.limit(0), done, fetch).collect() == []
    with pytest.raises(GleanerError):
        runs.extract_items(items, fetch, max_retries=-1)


def test_transcripts_through_a_model(spark):
    docs = spark.createDataFrame([(1, "First line\nmore"), (2, "limit"), (3, "broken"), (4, None), (5, "no text")], "doc_id long, text string")

    def chat(prompt):
        if prompt.endswith("limit"):
            raise GleanerError("rate_limit")
        if prompt.endswith("broken"):
            return "{nope"
        if prompt.endswith("no text"):
            return json.dumps({"model": "claude-3-haiku-20240307", "content": [{"type": "tool"}]})
        return analyze.stub_chat(prompt)

    answers, units = analyze.analyze_transcripts(docs, "T", chat)
    got = {r.doc_id: r for r in answers.collect()}
    assert [got[i].error_code for i in range(1, 6)] == [None, "rate_limit", "validation", "validation", None]
    assert got[1].input_tokens == len("T\n\n## Transcript\n\nFirst line\nmore") // 4 and got[1].cost > 0
    assert (got[5].text, got[5].input_tokens, got[5].cost) == ("", 0, 0.0)
    assert [(u.id, u.name, u.source_video_id) for u in units.collect()] == [("technique-15", "First line", 1)]
    texts = spark.createDataFrame([('```json\n{"a": 1, "b": "x"}\n```',), ('{"a": 1}',), ("nope",), (None,)], "text string")
    assert [r.ok for r in analyze.json_answers(texts, "a int, b string").collect()] == [True, False, False, False]


def test_each_answer_is_asked_for_once(spark):
    """However often the tables made of the answers are read."""
    calls = spark.sparkContext.accumulator(0)

    def chat(prompt):
        calls.add(1)
        return analyze.stub_chat(prompt)

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    answers, units = analyze.analyze_transcripts(docs, "T", chat)
    assert (answers.count(), units.count(), units.count(), calls.value) == (20, 20, 20, 20)

    def provider(doc, candidates):
        calls.add(1)
        return normalize.stub_provider(doc, candidates)

    calls.value = 0
    cs = spark.createDataFrame([(i % 20, i, str(i), f"text {i}") for i in range(60)], "doc_id long, ord long, id string, text string")
    empty = spark.createDataFrame([], "video_id long, unit_id string, type string, name string, summary string, confidence double, normalizer_sig string")
    labels, cache = normalize.normalize(cs, empty, "s", provider)
    assert (labels.count(), cache.count(), cache.count(), calls.value) == (60, 60, 60, 20)

    calls.value = 0
    requests = spark.createDataFrame([(str(i), "q") for i in range(10)], "request_key string, request string")
    every, new = analyze.fill_store(requests, spark.createDataFrame([("3", "old")], "request_key string, answer string"), chat)
    assert (every.count(), new.count(), new.count(), calls.value) == (10, 9, 9, 9)


def test_a_run_that_records_its_history(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fetch(video_id, attempt):
        calls.add(1)
        return None if video_id == 2 else f"text {video_id}"

    items = spark.createDataFrame([(i,) for i in range(5)], "video_id long")
    path = str(tmp_path / "history")
    first = runs.record_run(items, path, fetch, "2024-01-01T00:00:00", max_retries=0)
    assert sorted((r.video_id, r.status) for r in first.collect()) == [(i, "failed" if i == 2 else "completed") for i in range(5)]
    again = runs.record_run(items, path, fetch, "2024-01-02T00:00:00", max_retries=0)
    assert again.count() == 5 and {r.video_id for r in again.where("status = 'skipped'").collect()} == {0, 1, 3, 4}
    assert calls.value == 6
    h = sinks.read_history(spark, path, "bigint")
    assert sorted((r.video_id, r.success, r.status, r.timestamp[:10], r.error) for r in h.where("video_id > 1").collect()) == [(2, False, "failed", "2024-01-01", "blank"), (2, False, "failed", "2024-01-02", "blank"), (3, True, "completed", "2024-01-01", None), (4, True, "completed", "2024-01-01", None)]
    sinks.append_history(spark.createDataFrame([(9, True, "x")], "video_id long, success boolean, other string"), path)
    assert sinks.read_history(spark, path, "bigint").where("video_id = 9").first().status == "completed"


def test_prompts_name_the_video(spark):
    docs = spark.createDataFrame([(1, "T", "http://u", "words"), (2, None, "", "more")], "doc_id long, title string, url string, text string")
    from gleaner.operators.requests import transcript_prompts

    got = {r.doc_id: r.prompt for r in transcript_prompts(docs, "Template").collect()}
    assert got[1] == "Template\n\n**Video ID**: 1\n**Title**: T\n**URL**: http://u\n\n## Transcript\n\nwords"
    assert "URL" not in got[2] and "**Title**: \n" in got[2]


def test_settings_and_channels(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"window_chars": 100}')
    (tmp_path / "bad.json").write_text("{")
    default = {"min_words": 2}
    assert inputs.settings(spark, str(tmp_path / "s.json"), default) == {"window_chars": 100}
    assert inputs.settings(spark, str(tmp_path / "none.json"), default) == default and inputs.settings(spark, str(tmp_path / "bad.json"), default) == {}
    assert extract.options(inputs.settings(spark, str(tmp_path / "s.json"), default)).window_chars == 100
    refs = spark.createDataFrame([("c", "a"), ("c", "h"), ("c", "s"), ("handle", "s"), ("channel_id", "UC1"), ("c", "none")], "type string, id string")
    channels = spark.createDataFrame([("c", "a", "UCa"), ("handle", "h", "UCh")], "kind string, name string, channel_id string")
    search = spark.createDataFrame([("s", 2, "UCy"), ("s", 1, "UCx"), ("a", 1, "UCz")], "name string, rank int, channel_id string")
    got = {(r.type, r.id): r.channel_id for r in inputs.resolve_channels(refs, channels, search).collect()}
    assert got == {("c", "a"): "UCa", ("c", "h"): "UCh", ("c", "s"): "UCx", ("handle", "s"): None, ("channel_id", "UC1"): "UC1", ("c", "none"): None}


def test_answers_are_fetched_once(spark):
    requests = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("c", "qc")], "request_key string, request string")
    stored = spark.createDataFrame([("a", "old"), ("z", "other")], "request_key string, answer string")

    def fetch(request):
        if request == "qc":
            raise GleanerError("quota")
        return request.upper()

    every, new = analyze.fill_store(requests, stored, fetch)
    assert sorted(map(tuple, every.collect()), key=str) == [("a", "old", None), ("b", "QB", None), ("c", None, "quota")]
    assert [tuple(r) for r in new.collect()] == [("b", "QB")]


def test_runs_compared(spark):
    a = spark.createDataFrame([(1, "x", "t"), (1, "w", "u"), (2, "x", "t")], "doc_id long, id string, text string")
    one, two = compare.unit_hashes(a), compare.unit_hashes(a.orderBy(F.desc("id")).repartition(3))
    assert sorted(one.collect()) == sorted(two.collect())
    other = compare.unit_hashes(a.withColumn("text", F.when(F.col("doc_id") == 2, "v").otherwise(F.col("text"))))
    assert compare.determinism_rate(compare.determinism(one.unionByName(other))).first().rate == 50.0
    prior = spark.createDataFrame([(1, "x"), (1, "q"), (9, "x")], "doc_id long, id string")
    assert sorted(map(tuple, compare.against_prior(a, prior).collect())) == [(1, 2, 2, 1), (2, 1, None, 0)]
    assert [tuple(r) for r in compare.averages(a, "id", "doc_id").orderBy("id").collect()] == [("w", 1, 1.0), ("x", 2, 1.5)]


def test_occurrences_of_long_texts_equal_plain_counts():
    rng = random.Random(1)
    words = ["ab", "aba", "b", "a", "abab"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    sentences = ["", "ab", "aba ab", "a a", "aa", "b a b", "not there", text[100:180], *(text[i : i + 9] for i in range(0, 900, 7))]
    want = [text.count(s) + 1 if s else 0 for s in sentences]
    assert extract.occurrences_of(text, sentences) == want
    small, extract._SMALL = extract._SMALL, 0
    try:
        assert extract.occurrences_of(text, sentences) == want and extract.occurrences_of("x", [""]) == [0]
    finally:
        extract._SMALL = small


def test_collapse_equals_a_plain_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.randint(0, 3), k, "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), rng.randint(0, 5)) for k in range(400)]
    c = spark.createDataFrame([(d, w, s, x, x, q) for d, w, s, x, q in rows], "doc_id long, win int, start int, text string, canon string, q long").repartition(7)
    got = extract.collapse_near(c, 0.4, ranked=True).collect()
    want = set()
    for doc in (1, 2, None):
        kept, last = [], None
        for _, w, s, x, q in sorted([r for r in rows if r[0] == doc], key=lambda r: r[2]):
            grams = {x[i : i + 3] for i in range(len(x) - 2)}
            if last is None or (len(last & grams) / len(last | grams) if last | grams else 1.0) < 0.4:
                kept.append((-q, w, s))
                last = grams
        want |= {(doc, s, i + 1) for i, (_, _, s) in enumerate(sorted(kept))}
    assert {(r.doc_id, r.start, r["rank"]) for r in got} == want and len(got) == len(want) < 400
    assert extract.collapse_near(c.limit(0), 0.4).collect() == []


def test_a_long_text_takes_linear_time(spark):
    rng = random.Random(3)
    text = " ".join("Use the " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{i}"]) for _ in range(6)) + "." for i in range(90_000))
    began = time.time()
    assert extract.extract_units(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 90
    assert len(text) > 3_000_000 and time.time() - began < 60


def test_options_are_checked():
    assert extract.options({"target_count": 3}).target_count == 3
    for bad in ({"window_chars": 0}, {"jaccard_threshold": 1.5}, {"min_words": 9, "max_words": 3}, {"target_count": -1}, {"nope": 1}):
        with pytest.raises(GleanerError):
            extract.options(bad)


def test_small_functions(spark, tmp_path):
    one = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    assert [one(T.lex(a, b)) for a, b in (("'a'", "'b'"), ("'b'", "'a'"), ("'a'", "'a'"))] == [-1, 1, 0]
    assert one(fmt.cache_key("'e'", "map('b', '2 3', 'a', '1')")) == one("md5('e:a=1&b=2+3')")
    assert (one(fmt.rate_per_minute("30L", "60L")), one(fmt.rate_per_minute("1L", "0L")), one(fmt.seconds_left("10L", "5.0D")), one(fmt.seconds_left("1L", "0.0D"))) == (30.0, 0.0, 120.0, 0.0)
    refs = spark.createDataFrame([("channel_id", "UC1"), ("handle", "h"), ("user", "none")], "type string, id string")
    channels = spark.createDataFrame([("handle", "h", "UC2")], "kind string, name string, channel_id string")
    assert {r.id: r.channel_id for r in inputs.resolve_channels(refs, channels).collect()} == {"UC1": "UC1", "h": "UC2", "none": None}
    with pytest.raises(ValueError, match="no channel"):
        inputs.require_rows(refs.limit(0), "no channel")
    captions = spark.createDataFrame([("v", 2.0, 1.0, "b"), ("v", 1.0, 1.0, "a")], "video_id string, start double, duration double, text string")
    assert [e.text for e in inputs.timed_entries(captions).first().entries] == ["a", "b"]
    videos = spark.createDataFrame([("v", "t", 1, "d"), ("w", None, None, "d")], "video_id string, title string, duration_seconds int, upload_date string")
    assert [(r.video_id, r.problem) for r in inputs.invalid_videos(videos).collect()] == [("w", "title,duration_seconds")]
    assert one(normalize.only_known_keys("""'{"id": 1, "name": 2}'""")) and not one(normalize.only_known_keys("""'{"id": 1, "more": 2}'"""))
    (tmp_path / "unit_v1.0.md").write_text("one")
    (tmp_path / "unit_v1.1.md").write_text("two")
    assert [tuple(r) for r in inputs.templates(spark, str(tmp_path / "*.md")).collect()] == [("v1.0", "one"), ("v1.1", "two")]
    (tmp_path / "labels.json").write_text('{"v:u:1": {"type": "pattern", "name": "n", "summary": "s", "confidence": 0.5, "normalizer_sig": "x"}}')
    assert tuple(inputs.label_cache(spark, str(tmp_path / "labels.json")).first())[:3] == ("v", "u:1", "pattern")
    item = '[{"id": "c", "snippet": {"title": "C", "publishedAt": "2024-01-15T10:30:00Z"}, "statistics": {"subscriberCount": "12"}}]'
    (tmp_path / "channels.json").write_text(item)
    row = inputs.parse_channels(inputs.json_array_file(spark, str(tmp_path / "channels.json"), inputs.CHANNEL_ITEM)).first()
    assert (row.channel_title, row.created_date, row.subscriber_count, row.video_count) == ("C", "2024-01-15", 12, 0)
    results = spark.createDataFrame([("v", True), ("w", False)], "video_id string, success boolean")
    sinks.append_history(results, str(tmp_path / "history"))
    sinks.append_history(results, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).groupBy("status").count().orderBy("status").collect() == [("completed", 2), ("failed", 2)]
    sinks.write_records(results, str(tmp_path / "records"))
    sinks.write_analyses(results, str(tmp_path / "analyses"))
    assert spark.read.json(str(tmp_path / "records")).count() == 2 == spark.read.json(str(tmp_path / "analyses")).count()
    paths = sinks.channel_paths(spark.createDataFrame([("chan",)], "name string")).first()
    assert paths.knowledge_base == "channels/chan/knowledge-base"


def test_videos_become_pages(spark, tmp_path):
    columns = "video_id string, title string, channel_title string, upload_date string, duration_seconds long, view_count long, like_count long, comment_count long, channel_id string, description string, tags array<string>"
    videos = spark.createDataFrame([(f"v{i}", f"T{i}", "ch", "2024-01-01", 61, 1500, 3, 4, "c1", "d", ["x"]) for i in range(4)], columns)

    def fetch(video_id, attempt):
        if video_id == "v2":
            raise GleanerError("not_found")
        return f"words of {video_id} é"

    root, path = str(tmp_path / "out"), str(tmp_path / "history")
    got = {r.video_id: r for r in runs.extract_pages(videos, root, path, fetch, "2024-05-01").collect()}
    page = tmp_path / "out/ch/transcripts/v1.md"
    assert "words of v1 é" in page.read_text() and got["v1"].file_size == page.stat().st_size and got["v1"].output_path == "ch/transcripts/v1.md"
    assert got["v2"].status == "failed" and not (tmp_path / "out/ch/transcripts/v2.md").exists()
    again = {r.video_id: r.status for r in runs.extract_pages(videos, root, path, lambda v, a: "later", "2024-05-02").collect()}
    assert again == {"v0": "skipped", "v1": "skipped", "v2": "completed", "v3": "skipped"} and "words of v1" in page.read_text()
    h = sinks.read_history(spark, path)
    assert sorted((r.video_id, r.status, r.title, r.output_path) for r in h.where("video_id = 'v2'").collect()) == [("v2", "completed", "T2", "ch/transcripts/v2.md"), ("v2", "failed", "T2", None)]


def test_labels_by_a_model(spark):
    from gleaner.operators.requests import model_provider, system_prompt

    def chat(prompt):
        assert prompt.startswith(system_prompt())
        asked = json.loads(prompt.split("\n\n", 1)[1])
        if asked["video_id"] == "2":
            return "no json"
        return "```json\n" + json.dumps([{"id": c["id"], "type": "pattern", "name": c["text"][:5], "summary": c["text"], "confidence": 1} for c in asked["candidates"]]) + "\n```"

    cs = spark.createDataFrame([(1, 0, "a", "first text"), (1, 1, "b", "x" * 400), (2, 0, "c", "other")], "doc_id long, ord long, id string, text string")
    got = {r.id: r for r in normalize.ask(cs, model_provider(chat), text_cap=300).collect()}
    assert (got["a"].name, got["a"].is_fallback, got["c"].name, got["c"].is_fallback) == ("first", False, "(unclear)", True)
    assert got["b"].summary == "x" * 300


def test_a_store_that_grows(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fetch(request):
        calls.add(1)
        if request == "q3":
            raise GleanerError("quota")
        return request.upper()

    ask = lambda n: spark.createDataFrame([(f"k{i}", f"q{i}") for i in range(n)], "request_key string, request string")
    path = str(tmp_path / "store")
    assert analyze.extend_store(ask(3), path, fetch).count() == 3 and calls.value == 3
    got = {r.request_key: (r.answer, r.error_code) for r in analyze.extend_store(ask(5), path, fetch).collect()}
    assert got == {"k0": ("Q0", None), "k1": ("Q1", None), "k2": ("Q2", None), "k3": (None, "quota"), "k4": ("Q4", None)} and calls.value == 5
    assert spark.read.parquet(path).count() == 4


def test_items_that_are_left_out_say_why(spark):
    items = spark.createDataFrame([("v1", ("T",)), (None, ("T",)), ("v2", (None,)), ("v3", None)], "id string, snippet struct<title:string>")
    assert [(r.id, r.errors) for r in inputs.rejected_items(items).collect()] == [(None, ["id"]), ("v2", ["title"]), ("v3", ["title"])]
