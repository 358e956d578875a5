import os

import pytest
from pyspark.sql import functions as F

from gleaner.errors import GleanerError
from gleaner.operators import synthesis
from gleaner.sources import sinks
from gleaner.sources.page_files import PageWriter, read_pages, write_pages
from tests.test_parts import UNITS, some_units


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_pages_row_by_row_equal_whole_pages(spark, tmp_path):
    import random

    rows = some_units(60, random.Random(1)) + [(99, "no-type", "x-1", "n", "text", "v")]
    df = spark.createDataFrame(rows, UNITS)
    whole = {r.path: r.value for r in synthesis.unit_markdown(synthesis.synthesize(df)).collect()}
    write_pages(synthesis.unit_page_rows(synthesis.synthesis(df, 20)), str(tmp_path / "kb"), "section", "place", "key")
    assert {p: (tmp_path / "kb" / p).read_text() for p in tree(tmp_path / "kb")} == whole
    assert {r.path: r.value for r in read_pages(spark, str(tmp_path / "kb")).collect()} == whole


def test_a_failing_task_leaves_the_target_as_it_was(spark, tmp_path):
    root = str(tmp_path / "out")
    pages = spark.range(40).select(F.concat(F.lit("a/p"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("value"))
    write_pages(pages, root)
    before = tree(root)
    assert len(before) == 40

    def broken(batches):
        for b in batches:
            yield b
        raise RuntimeError("task fails")

    later = pages.withColumn("value", F.lit("new")).repartition("path").mapInArrow(broken, "path string, value string")
    with pytest.raises(Exception, match="task fails"):
        later.write.format("gleaner_pages").mode("overwrite").save(root)
    assert tree(root) == before and (tmp_path / "out/a/p7.md").read_text() == "text 7"
    assert not [d for d in os.listdir(root) if d.startswith("_temporary")]


def test_modes_and_edges(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, value string")
    write_pages(rows(("a/1.md", "one"), ("b/c/2.md", "two"), ("top.md", None), (None, "lost")), root)
    write_pages(rows(("a/3.md", "three"), ("a/1.md", "newer"), ("b/c/4.md", "é")), root, mode="append")
    assert tree(root) == ["a/1.md", "a/3.md", "b/c/2.md", "b/c/4.md", "top.md"]
    assert (tmp_path / "out/a/1.md").read_text() == "newer" and (tmp_path / "out/top.md").read_text() == ""
    write_pages(rows(("a/9.md", "nine")), root)
    assert tree(root) == ["a/9.md", "b/c/2.md", "b/c/4.md", "top.md"]
    write_pages(rows(), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == []
    for bad in ("../x.md", "/x.md", "a/../../x.md"):
        with pytest.raises(Exception, match="no path"):
            write_pages(rows((bad, "x")), root)
    with pytest.raises(Exception, match="path and value"):
        rows(("a", "b")).withColumn("n", F.lit(1)).write.format("gleaner_pages").mode("overwrite").save(root)


def test_a_task_that_is_run_twice(tmp_path):
    writer = PageWriter(str(tmp_path), True)
    for _ in range(2):
        writer.write(iter([("a/1.md", "x"), ("a/1.md", "y"), ("a/2.md", "z")]))
    with pytest.raises(GleanerError):
        writer.write(iter([("a/3.md", "half"), ("", "")]))
    writer.commit([])
    assert tree(tmp_path) == ["a/1.md", "a/2.md", "a/3.md"] and (tmp_path / "a/1.md").read_text() == "xy"


def test_video_pages(spark, tmp_path):
    v = spark.createDataFrame([("v1", "T", "ch", "2024-01-01", 61, 1500, 3, 4, "c1", "d", ["x"], "words", "now")], "video_id string, title string, channel_title string, upload_date string, duration_seconds long, view_count long, like_count long, comment_count long, channel_id string, description string, tags array<string>, transcript string, extracted string")
    write_pages(sinks.video_markdown(v), str(tmp_path))
    assert "**Views:** 1,500 views" in (tmp_path / "ch/transcripts/v1.md").read_text()
