import random

import pytest
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.operators import compare, history, runs, validate
from gleaner.sources import versions
from gleaner.streaming import incremental

KV = "k long, v string"


def rows_of(spark, root):
    return dict(map(tuple, versions.read_table(spark, root, KV).collect()))


def test_versions_of_a_table(spark, tmp_path):
    root = str(tmp_path / "t")
    assert rows_of(spark, root) == {}
    assert versions.upsert_table(spark.createDataFrame([(i, "a") for i in range(50)], KV), root, ["k"], 8) == 1
    first = versions.current(spark, root)[1]["folders"]
    assert versions.upsert_table(spark.createDataFrame([(3, "b"), (77, "b"), (3, "b")], KV), root, ["k"]) == 2
    second = versions.current(spark, root)[1]["folders"]
    assert sum(first.get(b) != f for b, f in second.items()) <= 2  # only the buckets of 3 and 77 are written anew
    assert rows_of(spark, root) == {i: "b" if i == 3 else "a" for i in range(50)} | {77: "b"}
    versions.upsert_table(spark.createDataFrame([], KV), root, ["k"])
    assert len(rows_of(spark, root)) == 51


def test_an_upsert_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.upsert_table(spark.createDataFrame([(1, "old"), (2, "old")], KV), root, ["k"], 4)

    def dies(*_):
        raise RuntimeError("writer dies")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", dies)
        with pytest.raises(RuntimeError):
            versions.upsert_table(spark.createDataFrame([(1, "new")], KV), root, ["k"])
    assert rows_of(spark, root) == {1: "old", 2: "old"}
    (tmp_path / "t/_versions/000000000002.json").write_text('{"buckets": 4, "fol')  # cut off while it was written
    assert rows_of(spark, root) == {1: "old", 2: "old"}
    with pytest.raises(GleanerError):
        versions.upsert_table(spark.createDataFrame([(1, "new")], KV), root, ["k"])
    (tmp_path / "t/_versions/000000000002.json").unlink()
    versions.upsert_table(spark.createDataFrame([(1, "new")], KV), root, ["k"])
    assert rows_of(spark, root) == {1: "new", 2: "old"}


def test_multiset_hashes(spark):
    rng = random.Random(1)
    rows = [(d, str(rng.randint(0, 5)), rng.choice(["x", "y", None, "é"])) for d in range(20) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "doc_id long, id string, text string")
    a = {r.doc_id: (r.n_units, r.units_hash) for r in compare.multiset_hashes(df).collect()}
    b = {r.doc_id: (r.n_units, r.units_hash) for r in compare.multiset_hashes(df.orderBy(F.rand(3)).repartition(7)).collect()}
    assert a == b and all(len(h) == 60 for _, h in a.values())
    changed = spark.createDataFrame([*rows[1:], (rows[0][0], rows[0][1] + "!", rows[0][2])], df.schema)
    c = {r.doc_id: (r.n_units, r.units_hash) for r in compare.multiset_hashes(changed).collect()}
    assert {d for d in a if a[d] != c[d]} == {rows[0][0]}
    twice = {r.doc_id: r.units_hash for r in compare.multiset_hashes(df.unionAll(df)).collect()}
    assert all(twice[d] != a[d][1] for d in a)
    assert compare.multiset_hashes(df.limit(0)).collect() == []


def test_counters_while_writing(spark, tmp_path):
    rows = [(i, ["completed", "failed", "skipped", "waiting"][i % 4], None) for i in range(103)]
    df = spark.createDataFrame(rows, "video_id long, status string, error string").repartition(5)
    results, seen = runs.observed(df)
    results.write.parquet(str(tmp_path / "r"))
    want = history.run_counters(df).first()
    assert seen.get == {"total": 103, "completed": want.completed, "failed": want.failed, "skipped": want.skipped}
    counts = spark.createDataFrame([(10, 3, 1, 1, 60.0), (0, 0, 0, 0, 0.0), (4, 0, 0, 0, 5.0)], "total long, completed long, failed long, skipped long, seconds double")
    assert [(r.progress, r.rate, r.left) for r in runs.progress(counts).collect()] == [(50.0, 5.0, 60.0), (100.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_rules_in_one_pass(spark, tmp_path):
    rules = {"no_text": "text IS NULL", "short": "length(text) < 3", "even": "id % 2 = 0"}
    rows = [(1, "long enough"), (2, "xx"), (3, None), (4, "fine too"), (5, "ok!")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = validate.check_rows(df, rules, str(tmp_path / "a"))
    assert sorted(map(tuple, got.good.collect())) == [(1, "long enough"), (5, "ok!")] and got.good.columns == df.columns
    assert {r.id: r.errors for r in got.rejects.collect()} == {2: ["short", "even"], 3: ["no_text", "short"], 4: ["even"]}
    assert got.counts == {"rows": 5, "good": 2, "broke_no_text": 1, "broke_short": 2, "broke_even": 2}
    none = validate.check_rows(df.limit(0), rules, str(tmp_path / "b"))
    assert none.good.collect() == none.rejects.collect() == [] and none.counts["rows"] == 0
    every = validate.check_rows(df, {}, str(tmp_path / "c"))
    assert every.good.count() == 5 and every.rejects.collect() == []
    videos = spark.createDataFrame([("v", "t", "12", "d"), ("", "t", "12", "d"), ("w", None, "1.5", None)], "video_id string, title string, duration_seconds string, upload_date string")
    assert [r.errors for r in validate.tagged(videos, validate.VIDEO_RULES).collect()] == [[], ["video_id"], ["title", "duration_seconds", "upload_date"]]


def test_streams_skip_by_keyed_state(spark, tmp_path):
    """Blank documents may come again, completed ones are done once, over restarts."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    text = "We must use the cache here. Always set the limit first of all."
    batches = [[(1, text), (1, text), (2, " ")], [(1, text), (2, text), (3, None)], [(3, None), (2, " "), (4, text)], []]
    for i, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{src}/{i}")
        incremental.start(spark, f"{src}/*", out, check).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/units").collect()) == [1, 1, 2, 2, 4, 4]
    assert sorted(map(tuple, incremental.outcomes(spark, out).collect())) == [(1, "completed"), (2, "completed"), (3, "failed"), (4, "completed")]
