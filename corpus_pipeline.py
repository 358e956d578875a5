"""From raw documents to token ids: STAGES in order, each on all that the one before kept.

1. quality: documents that importance resampling does not draw go.
2. near_duplicates: of each group linked by SimHash, the document with the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. personal_data: personal data and the terms that give it away are replaced in the texts.
5. token_ids: what is left is encoded; doc_id, n_tokens and the digests of ids and decoded text come out.

Every stage passes on all columns of its input but the last. Null texts, empty tables and repeated rows are handled as
each operator says. ``run`` writes each stage's rows as Parquet into the shared scratch folder and reads them
again, so that a lost executor costs one stage at most. Scratch tables of a stage are deleted once its rows stand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, decontaminate, pii, quality, simhash
from gleaner.llm.common import folders, release, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("token_ids", token_ids_stage),
]

#: Resampling, alignment and byte-pair merges are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), folders()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        release(spark, first, folders() - 1)  # what the stage has read and left, now that its rows stand
        first = folders() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
