"""Units that recur across sources become one: merged content, sources, references; and the graph of references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.formatting import cross_references
from gleaner.operators.running import running_sum

# Folders and headings of the unit types.
TYPE_DIRS = {
    "technique": "techniques",
    "pattern": "patterns",
    "use-case": "use-cases",
    "capability": "capabilities",
    "integration": "integrations",
    "antipattern": "antipatterns",
    "component": "components",
    "issue": "troubleshooting",
    "config": "configurations",
    "snippet": "snippets",
}
TYPE_NAMES = {
    "technique": "Techniques",
    "pattern": "Patterns",
    "use-case": "Use Cases",
    "capability": "Capabilities",
    "integration": "Integration Methods",
    "antipattern": "Anti-Patterns",
    "component": "Architecture Components",
    "issue": "Troubleshooting",
    "config": "Configuration Recipes",
    "snippet": "Code Snippets",
}
#: The labelling taxonomy's names for types that have another one here.
TYPE_ALIASES = {"anti-pattern": "antipattern", "troubleshooting": "issue", "configuration": "config", "code-snippet": "snippet"}


def sql_map(d: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")"


def aliased_types(units: DataFrame) -> DataFrame:
    """Keeps the type as given in ``raw_type`` and names it as the synthesis does."""
    return units.withColumn("raw_type", F.col("type")).withColumn("type", F.expr(f"coalesce({sql_map(TYPE_ALIASES)}[type], type)"))


#: Characters of a part of a merged text.
PART_CHARS = 1 << 20


def union_units(*analyses: DataFrame) -> DataFrame:
    """The units of several analyses (each with ``ord``) one after another; ``ord`` becomes (analysis, ord), in which the first analysis names a unit."""
    ordered = [u.withColumn("ord", F.struct(F.lit(i).alias("analysis"), F.col("ord").alias("ord"))) for i, u in enumerate(analyses)]
    out = ordered[0]
    for u in ordered[1:]:
        out = out.unionByName(u)
    return out


def first_paragraphs(units: DataFrame) -> DataFrame:
    """id, ord, pos, p: each group's paragraphs without white space at their ends, the first of those equal but for case. ``units``: id, ord, content."""
    pieces = units.select("id", "ord", F.posexplode(F.split("content", "\n\n", -1)).alias("pos", "p"))
    pieces = pieces.withColumn("p", F.regexp_replace("p", r"(?U)^\s+|\s+$", "")).where("p != ''")
    return pieces.groupBy("id", F.sha2(F.lower("p"), 256).alias("k")).agg(F.min(F.struct("ord", "pos", "p")).alias("f")).select("id", "f.*")


def placed_paragraphs(units: DataFrame) -> DataFrame:
    """id, ord, pos, p, size, at: the first paragraphs of a group by ``ord``, then place, then text; ``at`` is the sum of the sizes, two more than the lengths, before each."""
    sized = first_paragraphs(units).withColumn("size", F.length("p").cast("long") + 2)
    return running_sum(sized, "id", ["ord", "pos", "p"], "size", "at")


def _parts(units: DataFrame, placed: DataFrame, part_chars: int) -> DataFrame:
    pieces = placed.selectExpr("id", "IF(at = 0, 0L, at - 2) AS at", "IF(at = 0, p, concat('\n\n', p)) AS piece")
    chunk = f"transform(sequence(at div {part_chars}, (at + length(piece) - 1) div {part_chars}), k -> struct(k AS part, substring(piece, CAST(greatest(k * {part_chars} - at, 0) AS INT) + 1, CAST((k + 1) * {part_chars} - greatest(at, k * {part_chars}) AS INT)) AS chunk))"
    chunks = pieces.select("id", "at", F.explode(F.expr(chunk)).alias("c")).select("id", "at", "c.*")
    parts = chunks.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("cs"))
    parts = parts.select("id", "part", (F.col("part") * part_chars).alias("offset"), F.expr("array_join(transform(cs, c -> c.chunk), '')").alias("text"))
    some = F.max(F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False)))
    none = units.groupBy("id").agg(some.alias("some")).where("NOT some").selectExpr("id", "0L AS part", "0L AS offset", "'' AS text")
    return parts.unionByName(none)


def merge_paragraphs(units: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """id, part, offset, text: each group's paragraphs joined by blank lines, by ``ord`` and then place, and cut every ``part_chars`` characters.

    The texts of an id's parts in order are its merged content; ``offset`` is where a part begins in it. Repeats are told by the hash of a
    paragraph, its place in the merged content by running sums over ranges, so no task, row or value holds more than one part and one paragraph,
    however many paragraphs an id has. A group without paragraphs has one empty part. ``units``: id, ord, content.
    """
    return _parts(units, placed_paragraphs(units), part_chars)


@dataclass(frozen=True)
class Synthesis:
    """Units that became one for each id, as tables none of whose rows grows with the number of units.

    ``heads``: type, id, name, mixed_types, n_sources, n_references, content_length, paragraph_count. ``parts``: id, part, offset, text.
    ``sources``: id, video_id. ``references``: id, ref, only to ids that exist here.
    """

    heads: DataFrame
    parts: DataFrame
    sources: DataFrame
    references: DataFrame


def synthesis(units: DataFrame, part_chars: int = PART_CHARS) -> Synthesis:
    """``units``: type, id, name, content, source_video_id, ord, where ``ord`` is the input order. The first unit names the type; a group whose types differ has ``mixed_types`` set."""
    sources = units.where("source_video_id != ''").select("id", F.col("source_video_id").alias("video_id")).distinct()
    refs = units.select("id", F.explode(F.expr(cross_references("content", "id"))).alias("ref")).distinct()
    references = refs.join(units.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("id", "ref")
    placed = placed_paragraphs(units)
    counts = [
        placed.groupBy("id").agg(F.count("*").alias("paragraph_count"), (F.sum("size") - 2).alias("content_length")),
        sources.groupBy("id").agg(F.count("*").alias("n_sources")),
        references.groupBy("id").agg(F.count("*").alias("n_references")),
    ]
    heads = units.groupBy("id").agg(F.min_by(F.struct("type", "name"), "ord").alias("first"), (F.min("type") != F.max("type")).alias("mixed_types"))
    for one in counts:
        heads = heads.join(one, "id", "left")
    heads = heads.fillna({"n_sources": 0, "n_references": 0, "content_length": 0, "paragraph_count": 1})  # an empty text splits into one piece
    return Synthesis(heads.select("first.type", "id", "first.name", "mixed_types", "n_sources", "n_references", "content_length", "paragraph_count"), _parts(units, placed, part_chars), sources, references)


def synthesize(units: DataFrame) -> DataFrame:
    """One row per id: type, name, content, source_videos, cross_references, mixed_types, for groups whose merged content fits a value; ``synthesis`` is for any."""
    s = synthesis(units)
    content = s.parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("ps")).select("id", F.expr("array_join(transform(ps, p -> p.text), '')").alias("content"))
    lists = [t.groupBy("id").agg(F.array_sort(F.collect_list(c)).alias(name)) for t, c, name in ((s.sources, "video_id", "source_videos"), (s.references, "ref", "cross_references"))]
    out = s.heads.select("type", "id", "name", "mixed_types").join(content, "id")
    for one in lists:
        out = out.join(one, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("type", "id", "name", "content", F.coalesce("source_videos", none).alias("source_videos"), F.coalesce("cross_references", none).alias("cross_references"), "mixed_types")


def mutual_references(synthesized: DataFrame) -> DataFrame:
    """a < b: pairs that refer to each other."""
    edges = synthesized.select(F.col("id").alias("src"), F.explode("cross_references").alias("dst"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src < dst").join(back, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def metadata(synthesized: DataFrame) -> DataFrame:
    return synthesized.select("id", "name", "type", "source_videos", "cross_references", F.length("content").cast("long").alias("content_length"), F.size(F.split("content", "\n\n", -1)).alias("paragraph_count"))


def stats(synthesized: DataFrame) -> DataFrame:
    """Units, types and sources of a synthesis, one row per type."""
    return synthesized.groupBy("type").agg(F.count("*").alias("units"), F.sum(F.size("source_videos")).alias("source_links"))


# The page's layout, its headings and labels.
def unit_markdown(synthesized: DataFrame) -> DataFrame:
    """path and text of each unit's page; units of unknown types have no folder and are left out."""
    dirs = sql_map({k.split("-")[0]: v for k, v in TYPE_DIRS.items()})
    lines = f"""concat_ws('\n', concat('# ', name), '', concat('**ID**: `', id, '`  '), concat('**Type**: ', type, '  '), concat('**Sources**: ', size(source_videos), ' video(s)'), '',
      IF(size(source_videos) > 0, concat('## Source Videos\n\n', array_join(transform(source_videos, v -> concat('- `', v, '`')), '\n'), '\n'), NULL),
      '## Content', '', content, '',
      IF(size(cross_references) > 0, concat('## Related Knowledge\n\n', array_join(transform(cross_references, r -> concat('- [', r, '](../', coalesce({dirs}[split_part(r, '-', 1)], concat(split_part(r, '-', 1), 's')), '/', r, '.md)')), '\n'), '\n'), NULL))"""
    return synthesized.where(F.col("type").isin(*TYPE_DIRS)).select(F.expr(f"concat({sql_map(TYPE_DIRS)}[type], '/', id, '.md')").alias("path"), F.expr(lines).alias("value"))


# As above.
def unit_page_rows(s: Synthesis) -> DataFrame:
    """path, section, place, key, value: the pages of ``unit_markdown`` row by row, to be joined in this order, so that no row grows with a unit's sources, content or references."""
    dirs = sql_map({k.split("-")[0]: v for k, v in TYPE_DIRS.items()})
    heads = s.heads.where(F.col("type").isin(*TYPE_DIRS)).select("id", "type", "name", "n_sources", "n_references", F.expr(f"concat({sql_map(TYPE_DIRS)}[type], '/', id, '.md')").alias("path"))
    fixed = {
        0: "concat('# ', name, '\n\n**ID**: `', id, '`  \n**Type**: ', type, '  \n**Sources**: ', n_sources, ' video(s)\n\n', IF(n_sources > 0, '## Source Videos\n\n', ''))",
        2: "concat(IF(n_sources > 0, '\n', ''), '## Content\n\n')",
        4: "IF(n_references > 0, '\n\n## Related Knowledge\n\n', '\n')",
    }
    lines = heads.select("path", F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit(0).cast("long").alias("place"), F.lit("").alias("key"), F.expr(v).alias("value")) for k, v in fixed.items()))).alias("l")).select("path", "l.*")
    pages = heads.select("id", "path", (F.col("n_sources") + F.col("n_references") + 1).alias("n"))
    reference = f"concat('- [', ref, '](../', coalesce({dirs}[split_part(ref, '-', 1)], concat(split_part(ref, '-', 1), 's')), '/', ref, '.md)\n')"
    for table, section, place, key, value in ((s.sources, 1, "0L", "video_id", "concat('- `', video_id, '`\n')"), (s.parts, 3, "part", "''", "text"), (s.references, 5, "0L", "ref", reference)):
        lines = lines.unionByName(table.join(pages, "id").selectExpr("path", f"{section} AS section", f"{place} AS place", f"{key} AS key", f"{value} AS value"))
    return lines


def headings(synthesized: DataFrame) -> DataFrame:
    """One row per type: its heading in the index, with the number of units."""
    heading = f"coalesce({sql_map(TYPE_NAMES)}[type], initcap(type))"
    return synthesized.groupBy("type").agg(F.count("*").alias("n_units")).select("type", F.expr(f"concat('## ', {heading}, ' (', n_units, ')')").alias("heading"), "n_units")


def index_lines(synthesized: DataFrame) -> DataFrame:
    """type, name, id and line of each unit in the index, to be read in this order; links lead to the real folders."""
    folder = f"coalesce({sql_map(TYPE_DIRS)}[type], concat(type, 's'))"
    return synthesized.select("type", "name", "id", F.expr(f"concat('- [', name, '](', {folder}, '/', id, '.md) - ', size(source_videos), ' source(s)')").alias("line"))


def videos(synthesized: DataFrame) -> DataFrame:
    """The distinct sources."""
    return synthesized.select(F.explode("source_videos").alias("video_id")).distinct()


def totals(synthesized: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """One row: units, types, distinct sources, and analyses, which counts the rows of a table of analyses and not its distinct sources."""
    whole = synthesized.agg(F.count("*").alias("units"), F.count_distinct("type").alias("types"), F.sum(F.size("cross_references")).alias("references"))
    out = whole.crossJoin(videos(synthesized).agg(F.count("*").alias("sources")))  # one row each
    return out if analyses is None else out.crossJoin(analyses.agg(F.count("*").alias("analyses")))
