"""Extract, label and synthesise in one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import normalize, parse, synthesis
from gleaner.operators.extract import ExtractOptions, extract_units
from gleaner.sources.scratch import stored


def knowledge(docs: DataFrame, cache: DataFrame, sig: str, provider=normalize.stub_provider, opts: ExtractOptions = ExtractOptions()) -> tuple[DataFrame, DataFrame]:
    """Synthesised units of the documents and the label cache after the run. Unit ids carry their document's id. Units and labels are each made once and stored."""
    units = stored(extract_units(docs, opts).select("doc_id", F.col("rank").cast("long").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), "id").alias("id"), "text"))
    labels, cache = normalize.normalize(units, cache, sig, provider)
    rows = parse.labelled_content(labels)
    rows = rows.select("type", "id", "name", "content", F.col("doc_id").cast("string").alias("source_video_id"), F.struct("doc_id", "ord").alias("ord"))
    return synthesis.synthesize(stored(synthesis.aliased_types(rows).drop("raw_type"))), cache
