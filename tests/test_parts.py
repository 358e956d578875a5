import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import synthesis
from gleaner.operators.running import running_sum
from gleaner.operators.skew import with_group

UNITS = "ord long, type string, id string, name string, content string, source_video_id string"


def slow_merge(contents):
    seen, out = set(), []
    for c in contents:
        for p in (c or "").split("\n\n"):
            p = p.strip()
            if p and p.lower() not in seen:
                seen.add(p.lower())
                out.append(p)
    return "\n\n".join(out)


def some_units(n, rng):
    words = ["alpha", "Beta", "beta", "x", "ünï 😀", "technique-b2", "pattern-zz see issue-a1", " "]
    ids = ["technique-a1", "technique-b2", "issue-a1", "config-c"]
    text = lambda: "\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5)))
    return [(i, "technique", ids[0] if rng.random() < 0.6 else rng.choice(ids), f"n{i}", rng.choice([text(), text(), text(), None, "", " \n\n "]), rng.choice(["v1", "v2", "", None])) for i in range(n)]


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_parts_join_to_the_merged_content(spark, part):
    rng = random.Random(part)
    rows = some_units(150, rng) + [(900, "technique", "technique-none", "n", None, ""), (901, "technique", "technique-blank", "n", " \n\n\t", "")]
    got = {}
    for r in synthesis.merge_paragraphs(spark.createDataFrame(rows, UNITS).repartition(5), part).collect():
        got.setdefault(r.id, []).append((r.part, r.offset, r.text))
    assert set(got) == {r[2] for r in rows}
    for i, parts in got.items():
        parts.sort()
        whole = slow_merge([r[4] for r in rows if r[2] == i])
        assert [(k, o) for k, o, _ in parts] == [(k, k * part) for k in range(len(parts))]
        assert "".join(t for _, _, t in parts) == whole
        assert all(len(t) == part for _, _, t in parts[:-1]) and len(parts[-1][2]) <= part


def test_a_hot_id_is_merged_by_several_tasks(spark):
    """One id with all paragraphs: no partition holds them all, no value more than a part."""
    df = spark.range(20_000).select(F.col("id").alias("ord"), F.lit("t").alias("type"), F.lit("technique-a").alias("id"), F.lit("n").alias("name"), F.concat(F.lit("Paragraph "), (F.col("id") % 15_000).cast("string"), F.lit("\n\nshared")).alias("content"), F.lit("v").alias("source_video_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = synthesis.placed_paragraphs(df)
        assert len(placed.inputFiles()) > 2  # a file for each task
        parts = sorted(map(tuple, synthesis.merge_paragraphs(df, 10_000).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "".join(p[3] for p in parts) == slow_merge([f"Paragraph {i % 15_000}\n\nshared" for i in range(20_000)])
    assert max(len(p[3]) for p in parts) == 10_000


def test_synthesis_tables(spark):
    rng = random.Random(9)
    rows = some_units(80, rng)
    df = spark.createDataFrame(rows, UNITS)
    s = synthesis.synthesis(df, 50)
    known = {r[2] for r in rows}
    want_refs = {(r[2], x) for r in rows for x in re.findall(r"(?i)\b(?:technique|pattern|issue|config)-[a-z0-9-]+\b", r[4] or "") if x in known and x != r[2]}
    assert {tuple(r) for r in s.references.collect()} == want_refs
    assert {tuple(r) for r in s.sources.collect()} == {(r[2], r[5]) for r in rows if r[5]}
    for h in s.heads.collect():
        own = [r for r in rows if r[2] == h.id]
        whole = slow_merge([r[4] for r in own])
        assert (h.name, h.content_length, h.paragraph_count) == (own[0][3], len(whole), len(whole.split("\n\n")))
        assert (h.n_sources, h.n_references) == (len({r[5] for r in own if r[5]}), sum(a == h.id for a, _ in want_refs))
    one = {r.id: r for r in synthesis.synthesize(df).collect()}
    assert all(one[i].content == slow_merge([r[4] for r in rows if r[2] == i]) for i in known)
    assert synthesis.synthesize(df.limit(0)).collect() == []


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b", str(i)]), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    got = {r.o: r.s for r in running_sum(df, "g", ["o"], "v", "s").collect()}
    assert got == {o: sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
    assert running_sum(df.limit(0), "g", ["o"], "v", "s").collect() == []
    clash = running_sum(df.withColumn("block", F.lit("x")).withColumn("base", F.lit(1)), "g", ["o"], "v", "s")
    assert clash.columns == ["g", "o", "v", "block", "base", "s"] and {r.o: r.s for r in clash.collect()} == got


def test_groups_of_any_size_meet_their_value(spark):
    rows = [(None if i % 3 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, key long")
    values = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("key").alias("total"))
    got = with_group(df, values, "k")
    assert got.columns == ["k", "key", "total"]
    hot = sum(i for i in range(300) if i % 3 == 0)
    assert sorted((r.key, r.total) for r in got.collect()) == [(i, hot if i % 3 == 0 else i) for i in range(300)]
