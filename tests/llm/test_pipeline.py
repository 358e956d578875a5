import os

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from gleaner.llm import bpe, decontaminate, pii, quality, simhash

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")
def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    kept = cp.quality_stage(spark, docs, ROOT)
    assert kept.columns == docs.columns
    drawn = {r.doc_id for r in quality.resample(docs, spark.read.parquet(f"{ROOT}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == drawn
    one = cp.near_duplicates_stage(spark, kept, ROOT)
    prints = dict(zip(sorted(drawn), simhash.fingerprints_of([rows[i] for i in sorted(drawn)]).tolist(), strict=True))
    root = {}
    for i in sorted(prints):  # smallest id within chains of links
        linked = {root[j] for j in root if (prints[i] ^ prints[j]).bit_count() <= 2}
        least = min(linked | {i})
        root = {j: least if x in linked else x for j, x in root.items()} | {i: least}
    assert {r.doc_id for r in one.collect()} == {i for i, x in root.items() if i == x}
    clean = cp.decontamination_stage(spark, one, ROOT)
    survivors = {r.doc_id for r in one.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i in survivors if not any(decontaminate.normal(t) in decontaminate.normal(rows[i]) for _, t in bench)}
    private = cp.personal_data_stage(spark, clean, ROOT)
    assert private.columns == docs.columns
    for r in private.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(rows[r.doc_id]):
            assert r.text == rows[r.doc_id]
    judge = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r.doc_id: len(judge.encode_ordinary(r.text)) for r in private.collect()}
    assert {r.doc_id: r.n_tokens for r in cp.run(spark, ROOT).collect()} == want


@pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")
def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "x", "k"), (None, "", "x", "k"), (3, "a b c", None, "k"), (3, "a b c", None, "k")], "doc_id long, text string, fp string, component_id string")
    for start in (docs, docs.limit(0)):
        d = start
        for _, stage in cp.STAGES[:-1]:
            d = stage(spark, d, ROOT)
            assert d.columns == docs.columns
            d.collect()
        cp.STAGES[-1][1](spark, d, ROOT).collect()


def test_stages_keep_rows_of_null_ids_and_columns_of_any_name(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["north", "river", "stone", "green", "lamp", "seven", "cloud", "paper"]) for _ in range(40)) for _ in range(30)]
    rows = [(None if i % 3 == 0 else i, t, "en", "s", len(t), i, -i, "x", i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __t long, __fp long, __terms string, __key long, weight long")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such benchmark question in these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        assert sorted(out.select("text", "__t", "__fp", "__terms", "__key", "weight").collect()) == sorted(docs.select("text", "__t", "__fp", "__terms", "__key", "weight").collect()), name
    assert out.where(F.col("doc_id").isNull()).count() == 10 and cp.STAGES[-1][1](spark, out, str(tmp_path)).count() == 30
