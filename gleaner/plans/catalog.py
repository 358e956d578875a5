"""Queries over the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import formatting as fmt
from gleaner.functions import text as T
from gleaner.errors import GleanerError
from gleaner.operators import analyze, compare, cost, extract, fold, history, normalize, parse, runs, synthesis, validate
from gleaner.operators.similarity import similar
from gleaner.operators.skew import with_group
from gleaner.sources import inputs, scratch, versions
from gleaner.sources.page_files import read_pages, write_pages
from gleaner.sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- text core -------------------------------------------------------------------------------------------------

_CANON = r"trim(regexp_replace(lower(regexp_replace({x}, '[\p{{P}}\p{{S}}]', ' ', 'g')), '\s+', ' ', 'g'))"
_WC = "CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END"
_IMP = r"CAST(regexp_matches({c}, '^(?:(?:you|we)\s+)?(?:must|should|never|always)\b|^(?:use|set|avoid|ensure|check|install|enable|disable|measure|calculate)\b') AS INT)"


def _canon(x: str) -> str:
    return _CANON.format(x=x)


_C = f"c AS (SELECT doc_id, text, {_canon('text')} AS canon FROM documents)"


@query(f"WITH {_C} SELECT doc_id, canon FROM c")
def canon_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.canon_column("text").alias("canon"))


def _wide(spark, d):
    """The documents in full-width letters and circled digits, character for character; NFKC makes the plain ones of them."""
    wide = "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0x2460 + i) for i in range(9))
    return read(spark, d, "documents").select("doc_id", F.translate("text", string.ascii_letters + "123456789", wide).alias("text"))


@query(f"WITH {_C} SELECT doc_id, canon FROM c")
def canon_wide_text(spark, d):
    return _wide(spark, d).select("doc_id", T.canon_column("text").alias("canon"))


@query(f"WITH {_C} SELECT doc_id, {_WC.format(c='canon')} AS words FROM c")
def word_counts(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{T.canon('text')} AS canon").selectExpr("doc_id", f"{T.words('canon')} AS words")


_WINDOWS = r"""w AS (
  SELECT doc_id, 0 AS idx, 0 AS start, CASE WHEN length(text) <= 3500 THEN length(text) WHEN p > 0 THEN p + 2 ELSE 3500 END AS "end", text, length(text) AS n
  FROM (SELECT doc_id, text, CASE WHEN instr(reverse(substr(text, 1, 3500)), ' .') = 0 THEN -1 ELSE 3500 - instr(reverse(substr(text, 1, 3500)), ' .') - 1 END AS p FROM documents WHERE text <> '')
  UNION ALL
  SELECT doc_id, idx + 1, "end", CASE WHEN n - "end" <= 3500 THEN n WHEN p > 0 THEN "end" + p + 2 ELSE "end" + 3500 END, text, n
  FROM (SELECT *, CASE WHEN instr(reverse(substr(text, "end" + 1, 3500)), ' .') = 0 THEN -1 ELSE 3500 - instr(reverse(substr(text, "end" + 1, 3500)), ' .') - 1 END AS p FROM w WHERE "end" < n))"""


@query(f'WITH RECURSIVE {_WINDOWS} SELECT doc_id, idx, start, "end", sha256(substr(text, start + 1, "end" - start)) AS digest FROM w')
def windows(spark, d):
    return extract.windows(read(spark, d, "documents")).select("doc_id", "idx", "start", "end", F.sha2("text", 256).alias("digest"))


# pieces are contiguous after the leading terminators, so places are running sums; a window without a match is one sentence
_SENTENCES = (
    _WINDOWS
    + r""",
win AS (SELECT doc_id, idx, start AS ws, substr(text, start + 1, "end" - start) AS t FROM w),
pieces AS (SELECT doc_id, idx, ws, t, unnest(regexp_extract_all(t, '[^.!?]+[.!?]+')) AS piece, generate_subscripts(regexp_extract_all(t, '[^.!?]+[.!?]+'), 1) AS k FROM win),
placed AS (SELECT *, length(regexp_extract(t, '^[.!?]*')) + sum(length(piece)) OVER (PARTITION BY doc_id, idx ORDER BY k) AS e FROM pieces),
kept AS (SELECT doc_id, idx, ws, e - length(piece) AS s, e, piece FROM placed WHERE e = length(t) OR regexp_matches(substr(t, CAST(e + 1 AS BIGINT)), '^[\\"'')\]]*\s')),
alone AS (SELECT doc_id, idx, ws, 0 AS s, length(t) AS e, t AS piece FROM win WHERE regexp_matches(t, '\S') AND (doc_id, idx) NOT IN (SELECT (doc_id, idx) FROM kept)),
sent AS (SELECT doc_id, CAST(idx AS INT) AS win, CAST(ws + s AS INT) AS start, CAST(ws + e AS INT) AS "end", regexp_replace(piece, '^\s+|\s+$', '', 'g') AS text FROM (SELECT * FROM kept UNION ALL SELECT * FROM alone))"""
)


@query(f'WITH RECURSIVE {_SENTENCES} SELECT doc_id, win, start, "end", sha256(text) AS digest FROM sent')
def sentences(spark, d):
    return extract.sentences(read(spark, d, "documents")).select("doc_id", "win", "start", "end", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_C} SELECT doc_id, {_IMP.format(c='canon')} AS imperative FROM c")
def imperatives(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{T.canon('text')} AS canon").selectExpr("doc_id", f"{T.imperative('canon')} AS imperative")


_CANDIDATES = (
    _SENTENCES
    + f""",
docs AS (SELECT doc_id, length(text) AS n_chars, {_canon("text")} AS dc FROM documents),
cc AS (SELECT s.*, {_canon("s.text")} AS canon, n_chars, dc FROM sent s JOIN docs USING (doc_id)),
cand AS (SELECT doc_id, win, start, "end", text, canon, n_chars, {_WC.format(c="canon")} AS wc, 1 + (length(dc) - length(replace(dc, canon, ''))) // length(canon) AS occ, {_IMP.format(c="canon")} AS imp FROM cc WHERE {_WC.format(c="canon")} BETWEEN 4 AND 24),
scored AS (SELECT *, CAST(round_even((0.4::DOUBLE * occ + 0.2::DOUBLE * (1 - start::DOUBLE / n_chars) + 0.2::DOUBLE * (least(wc, 24)::DOUBLE / 24) + 0.2::DOUBLE * imp) * 1000000, 0) AS BIGINT) AS q FROM cand)"""
)


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT doc_id, win, start, CAST(occ AS BIGINT) AS occ FROM scored")
def sentence_frequency(spark, d):
    return extract.candidates(read(spark, d, "documents")).select("doc_id", "win", "start", "occ")


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT doc_id, win, start, q FROM scored")
def unit_scores(spark, d):
    return extract.candidates(read(spark, d, "documents")).select("doc_id", "win", "start", "q")


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT doc_id, win, start FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, win ORDER BY q DESC, start, text) <= 5")
def window_quota(spark, d):
    return extract.window_quota(extract.candidates(read(spark, d, "documents")), 5).select("doc_id", "win", "start")


_DEDUP = _CANDIDATES + ", uniq AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, canon ORDER BY start, text) = 1)"


@query(f"WITH RECURSIVE {_DEDUP} SELECT doc_id, win, start FROM uniq")
def exact_dedup(spark, d):
    return extract.exact_dedup(extract.candidates(read(spark, d, "documents"))).select("doc_id", "win", "start")


_GRAMS = "CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(generate_series(1, length({c}) - 2), lambda i: substr({c}, i, 3))) ELSE [] END"
_JACCARD = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_NEAR_SQL = (
    _DEDUP
    + f""",
lined AS (SELECT *, {_GRAMS.format(c="canon")} AS g, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS rn FROM uniq),
walk AS (
  SELECT doc_id, rn, g AS last, true AS keep FROM lined WHERE rn = 1
  UNION ALL
  SELECT l.doc_id, l.rn, CASE WHEN {_JACCARD.format(a="w.last", b="l.g")} >= @limit THEN w.last ELSE l.g END, {_JACCARD.format(a="w.last", b="l.g")} < @limit FROM walk w JOIN lined l ON l.doc_id = w.doc_id AND l.rn = w.rn + 1),
near AS (SELECT l.* FROM lined l JOIN walk w USING (doc_id, rn) WHERE w.keep)"""
)
_NEAR = _NEAR_SQL.replace("@limit", "0.92")
_LOW = 0.2  # sentences of the tables are that much alike


@query(f"WITH RECURSIVE {_NEAR_SQL.replace('@limit', str(_LOW))} SELECT doc_id, win, start FROM near")
def near_dup_collapse(spark, d):
    return extract.collapse_near(extract.exact_dedup(extract.candidates(read(spark, d, "documents"))), _LOW).select("doc_id", "win", "start")


@query(
    f"""WITH RECURSIVE {_NEAR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, win, start, text) AS rank FROM near)
SELECT doc_id, win || ':' || start || '-' || "end" AS id, text, start, "end", q, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= least(greatest(round_even(n_chars / 2500.0, 0), 40), 90)"""
)
def top_units(spark, d):
    return extract.extract_units(read(spark, d, "documents")).select("doc_id", "id", "text", "start", "end", F.expr(T.quant("score")).alias("q"), "rank")


@query(ORACLES["top_units"].replace('"end" AS id, text, start', '"end" AS id, start'))
def wide_units(spark, d):
    """Units of the documents in full-width letters: the same places and scores."""
    return extract.extract_units(_wide(spark, d)).select("doc_id", "id", "start", "end", F.expr(T.quant("score")).alias("q"), "rank")


@query(ORACLES["top_units"])
def long_units(spark, d):
    """All documents taken as long ones: their sentences lie in ranges, not by document."""
    return fold.extract_long_units(read(spark, d, "documents")).select("doc_id", "id", "text", "start", "end", F.expr(T.quant("score")).alias("q"), "rank")


@query(ORACLES["near_dup_collapse"])
def near_dup_fold(spark, d):
    return fold.collapse_long(extract.exact_dedup(extract.candidates(read(spark, d, "documents"))), _LOW).select("doc_id", "win", "start")


@query("SELECT doc_id, CAST(least(greatest(round_even(length(text) / 2500.0, 0), 40), 90) AS INT) AS target FROM documents")
def target_counts(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{T.target_count('length(text)')} AS target")


_B = f"b AS (SELECT item_id, {_canon('text')} AS c FROM benchmark)"


@query(f"WITH {_B} SELECT item_id, list_aggregate(list_sort({_GRAMS.format(c='c')}), 'string_agg', '|') AS grams FROM b")
def trigram_sets(spark, d):
    c = read(spark, d, "benchmark").selectExpr("item_id", f"{T.canon('text')} AS c")
    return c.selectExpr("item_id", f"array_join(array_sort({T.trigrams('c')}), '|') AS grams")


@query(f"WITH {_B}, g AS (SELECT item_id, {_GRAMS.format(c='c')} AS g FROM b) SELECT x.item_id AS a, y.item_id AS b, CAST(round_even({_JACCARD.format(a='x.g', b='y.g')} * 1000000, 0) AS BIGINT) AS q FROM g x JOIN g y ON y.item_id = x.item_id + 1")
def trigram_jaccard(spark, d):
    g = read(spark, d, "benchmark").selectExpr("item_id", f"{T.canon('text')} AS c").selectExpr("item_id", f"{T.trigrams('c')} AS g")
    y = g.selectExpr("item_id - 1 AS item_id", "item_id AS b", "g AS h")
    return g.join(y, "item_id").selectExpr("item_id AS a", "b", f"{T.quant(T.jaccard('g', 'h'))} AS q")


def _similar_sql(table: str, key: str, text: str, threshold: float) -> str:
    """Similarity of all pairs that share a trigram, by counting the trigrams they share; no pair is left out."""
    return f"""t AS (SELECT {key} AS id, {_canon(text)} AS c FROM {table}), sets AS (SELECT id, {_GRAMS.format(c='c')} AS g FROM t),
named AS (SELECT id, len(g) AS n, list_sort(g) AS k, min(id) OVER (PARTITION BY list_sort(g)) AS class_id FROM sets), flat AS (SELECT id, n, class_id, unnest(k) AS gram FROM named),
met AS (SELECT x.id AS a, y.id AS b, any_value(x.class_id) AS ca, any_value(y.class_id) AS cb, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS s FROM flat x JOIN flat y ON x.gram = y.gram AND x.id <> y.id GROUP BY x.id, y.id
  UNION ALL SELECT x.id, y.id, x.class_id, y.class_id, 1 FROM named x JOIN named y ON x.n = 0 AND y.n = 0 AND x.id <> y.id),
alike AS (SELECT * FROM met WHERE s >= {threshold})"""


_ALIKE = 0.3


@query(f"WITH {_similar_sql('benchmark', 'item_id', 'text', _ALIKE)} SELECT DISTINCT ca AS a, cb AS b, CAST(round_even(s * 1000000, 0) AS BIGINT) AS q FROM alike WHERE ca < cb")
def similar_items(spark, d):
    return similar(read(spark, d, "benchmark"), _ALIKE, "item_id").pairs.selectExpr("a", "b", f"{T.quant('similarity')} AS q")


_OPENING = "regexp_extract(text, '^[^.!?]*', 0)"


@query(f"WITH {_similar_sql('documents', 'doc_id', _OPENING, 0.6)} SELECT n.id, n.class_id, (SELECT count(*) FROM alike WHERE a = n.id) AS n_links FROM named n")
def similar_openings(spark, d):
    """First sentences of the documents, each against all others."""
    return similar(read(spark, d, "documents").selectExpr("doc_id AS id", f"{_OPENING} AS text"), 0.6).members


@query("SELECT doc_id, sha256(text) AS transcript_hash FROM documents WHERE regexp_matches(text, '\\S')")
def text_hash(spark, d):
    return extract.transcript_hashes(read(spark, d, "documents"))


# ---- captions, metadata, formats -------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS transcript FROM conversations GROUP BY conv_id")
def join_captions(spark, d):
    return inputs.transcripts(read(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT source, min_by(lang, CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) AS lang, count(*) FILTER (WHERE lang = l) AS n FROM (SELECT *, first_value(lang) OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) AS l FROM documents WHERE lang IN ('de', 'es', 'en')) GROUP BY source")
def caption_language_pick(spark, d):
    c = inputs.pick_captions(read(spark, d, "documents"), ["de", "es", "en"], "source")
    return c.groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def caption_available(spark, d):
    docs = read(spark, d, "documents")
    return inputs.with_captions(docs.select("doc_id"), docs, ["fr", "de"], "doc_id")


@query("SELECT conv_id, string_agg(DISTINCT CASE WHEN role = 'assistant' THEN role || ' (auto)' ELSE role END, ',' ORDER BY CASE WHEN role = 'assistant' THEN role || ' (auto)' ELSE role END) AS languages FROM conversations GROUP BY conv_id")
def caption_languages(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.col("role").alias("lang"), (F.col("role") == "assistant").alias("is_generated"))
    return inputs.available_languages(c, "conv_id").select("conv_id", F.array_join("languages", ",").alias("languages"))


_REFS = "('https://www.youtube.com/@team.blue/videos'), ('youtube.com/channel/UC123?x=1'), ('https://m.youtube.com/user/u1'), ('http://youtube.com/c/Chan/'), ('https://example.org/watch'), ('youtube.com/@h'), ('https://www.m.site.org/@a/channel/b')"


@query(
    rf"""WITH u AS (SELECT url FROM pages UNION ALL SELECT url FROM (VALUES {_REFS}) v(url)),
x AS (SELECT url, regexp_replace(CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END, '^(https?://)(?:www\.|m\.)+', '\1') AS f FROM u)
SELECT url, CASE WHEN regexp_matches(f, '/@[^/?]+') THEN 'handle' WHEN regexp_matches(f, '/channel/[^/?]+') THEN 'channel_id' WHEN regexp_matches(f, '/user/[^/?]+') THEN 'user' WHEN regexp_matches(f, '/c/[^/?]+') THEN 'c' END AS kind,
CASE WHEN regexp_matches(f, '/@[^/?]+') THEN regexp_extract(f, '/@([^/?]+)', 1) WHEN regexp_matches(f, '/channel/[^/?]+') THEN regexp_extract(f, '/channel/([^/?]+)', 1) WHEN regexp_matches(f, '/user/[^/?]+') THEN regexp_extract(f, '/user/([^/?]+)', 1) WHEN regexp_matches(f, '/c/[^/?]+') THEN regexp_extract(f, '/c/([^/?]+)', 1) END AS id FROM x"""
)
def page_url_parse(spark, d):
    urls = read(spark, d, "pages").select("url").unionByName(spark.sql(f"SELECT url FROM VALUES {_REFS} AS v(url)"))
    return urls.selectExpr("url", f"{fmt.channel_ref('url')} AS r").select("url", F.col("r.type").alias("kind"), F.col("r.id").alias("id"))


@query("SELECT event_id, (event_id % 3) * 3600 + (event_id % 61) * 60 + event_id % 59 AS seconds FROM events UNION ALL SELECT * FROM (VALUES (-1, 0), (-2, 0), (-3, 300), (-4, 7200), (-5, 86400)) v(a, b)")
def iso_durations(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "concat('PT', event_id % 3, 'H', event_id % 61, 'M', event_id % 59, 'S') AS iso")
    fixed = spark.sql("SELECT * FROM VALUES (-1L, ''), (-2L, 'invalid'), (-3L, 'PT5M'), (-4L, 'PT2H'), (-5L, 'P1D') AS v(event_id, iso)")
    return e.unionByName(fixed).selectExpr("event_id", f"{fmt.iso_duration('iso')} AS seconds")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS upload_date FROM orders")
def iso_dates(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 7 = 0, 'not a date', concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00Z')) AS iso")
    return o.selectExpr("o_orderkey", f"{fmt.iso_date('iso')} AS upload_date")


@query(r"SELECT event_id, CASE WHEN regexp_matches(s, '^\s*[+-]?\d+\s*$') THEN CAST(trim(s) AS BIGINT) ELSE 0 END AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '12.5' WHEN 2 THEN '' ELSE ' ' || user_id || ' ' END AS s FROM events)")
def safe_int(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN '12.5' WHEN 2 THEN '' ELSE concat(' ', user_id, ' ') END AS s")
    return e.selectExpr("event_id", f"{fmt.safe_int('s')} AS n")


_CLOCK = "CASE WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, ({x} % 3600) // 60, {x} % 60) ELSE printf('%d:%02d', {x} // 60, {x} % 60) END"


@query(f"WITH l AS (SELECT l_orderkey, l_linenumber, CAST(greatest(CAST(l_quantity AS BIGINT) * 173 - 500, 0) AS BIGINT) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, {_CLOCK.format(x='s')} AS clock FROM l")
def fmt_duration(spark, d):
    s = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT) * 173 - 500 AS s")
    return s.selectExpr("l_orderkey", "l_linenumber", f"{fmt.clock('s')} AS clock")


_VIEWS = "CASE WHEN {n} >= 1000000 THEN CASE WHEN {n} % 1000000 = 0 THEN ({n} // 1000000) || 'M views' ELSE printf('%.1f', {n}::DOUBLE / 1000000) || 'M views' END WHEN {n} >= 1000 THEN CASE WHEN {n} % 1000 = 0 THEN ({n} // 1000) || 'K views' ELSE printf('%.1f', {n}::DOUBLE / 1000) || 'K views' END WHEN {n} = 1 THEN '1 view' ELSE {n} || ' views' END"


@query(f"WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 50 ELSE CAST(floor(o_totalprice * (o_orderkey % 40)) AS BIGINT) END AS n FROM orders) SELECT o_orderkey, {_VIEWS.format(n='n')} AS views FROM o")
def fmt_views(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 5 = 0, o_orderkey * 50, CAST(floor(o_totalprice * (o_orderkey % 40)) AS BIGINT)) AS n")
    return o.selectExpr("o_orderkey", f"{fmt.view_count('n')} AS views")


@query("WITH s AS (SELECT doc_id, n_chars * (doc_id % 97) * (doc_id % 89) * (doc_id % 83) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' WHEN n < 1099511627776 THEN printf('%.1f', n / 1073741824.0::DOUBLE) || ' GB' ELSE printf('%.1f', n / 1099511627776.0::DOUBLE) || ' TB' END AS size FROM s")
def fmt_bytes(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", "n_chars * (doc_id % 97) * (doc_id % 89) * (doc_id % 83) AS n").selectExpr("doc_id", f"{fmt.file_size('n')} AS size")


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS n FROM orders")
def fmt_number(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{fmt.thousands('CAST(floor(o_totalprice) AS BIGINT)')} AS n")


@query(r"""WITH p AS (SELECT p_partkey, p_name || '  : "v" ' || p_brand || '/a. ' AS t FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g'), ' .') AS safe, regexp_replace(regexp_replace(t, '[^\w\s-]', '', 'g'), '[-\s]+', '-', 'g') || '.md' AS file FROM p""")
def filenames(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit('  : "v" '), "p_brand", F.lit("/a. ")).alias("t"))
    return p.selectExpr("p_partkey", f"{fmt.sanitize_filename('t')} AS safe", f"{fmt.generate_filename('t')} AS file")


@query(
    f"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t, CAST(p_size * 97 AS BIGINT) AS s, CAST(floor(p_retailprice * (p_partkey % 30)) AS BIGINT) AS n FROM part),
x AS (SELECT *, ' (' || {_CLOCK.format(x="s")} || ') - Unknown - ' || {_VIEWS.format(n="n")} AS suffix FROM p), y AS (SELECT *, least(60, 80 - length(suffix)) AS room FROM x)
SELECT p_partkey, CASE WHEN length(t) > room THEN left(t, greatest(room - 3, 0)) || '...' ELSE t END || suffix AS line FROM y"""
)
def display_lines(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_type, ' ', p_brand) AS t", "CAST(p_size * 97 AS BIGINT) AS s", "CAST(floor(p_retailprice * (p_partkey % 30)) AS BIGINT) AS n")
    return p.selectExpr("p_partkey", f"{fmt.display_line('t', 's', chr(39) * 2, 'n')} AS line")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59:59'")
def date_window(spark, d):
    o = read(spark, d, "orders").withColumn("upload_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return inputs.published_between(o, "1995-01-01", "1996-12-31").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS video_id, CAST(o_totalprice AS BIGINT) AS view_count FROM orders ORDER BY CAST(o_totalprice AS BIGINT) DESC, o_orderkey LIMIT 50")
def ordered_limit(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey AS video_id", "CAST(rint(o_totalprice) AS BIGINT) AS view_count", "date_format(o_orderdate, 'yyyy-MM-dd') AS upload_date")
    return inputs.discover(o.selectExpr("video_id", "video_id AS relevance"), o, 120, "viewCount").select("video_id", "view_count")


@query("SELECT o_orderkey AS video_id, strftime(o_orderdate, '%Y-%m-%d') AS upload_date FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30 23:59:59' ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 50")
def newest_first(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey AS video_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS upload_date")
    return inputs.discover(o.selectExpr("video_id", "video_id AS relevance"), o, None, "date", before="1997-06-30").select("video_id", "upload_date")


@query("SELECT p_partkey AS video_id FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey ORDER BY -n, p_partkey LIMIT 20")
def most_relevant(spark, d):
    ids = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("video_id")).agg((-F.count("*")).alias("relevance"))
    parts = read(spark, d, "part").selectExpr("p_partkey AS video_id", "'' AS upload_date")
    return inputs.discover(ids, parts, 20).select("video_id")


@query("SELECT count(*) AS total_videos, CAST(coalesce(sum(CAST(floor(p_retailprice) AS BIGINT)), 0) AS BIGINT) AS views, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS seconds, CAST(sum(p_size) // 3600 AS BIGINT) || ' hour' || CASE WHEN sum(p_size) // 3600 = 1 THEN '' ELSE 's' END || CASE WHEN (sum(p_size) % 3600) // 60 > 0 THEN ' ' || CAST((sum(p_size) % 3600) // 60 AS BIGINT) || ' minutes' ELSE '' END AS formatted FROM part")
def selection_summary(spark, d):
    return inputs.selection_summary(read(spark, d, "part").selectExpr("p_size AS duration_seconds", "CAST(floor(p_retailprice) AS BIGINT) AS view_count"))


# ---- history and joins -----------------------------------------------------------------------------------------


def _history(spark, d):
    return read(spark, d, "events").selectExpr("event_id AS seq", "user_id", "event_type <> 'error' AS success", "CAST(floor(value) AS BIGINT) AS file_size")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS total_bytes, round(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS success_rate FROM events")
def history_stats(spark, d):
    return history.stats(_history(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT event_id AS seq, user_id FROM events ORDER BY event_id DESC LIMIT 25")
def history_recent(spark, d):
    return history.recent(_history(spark, d), 25).select("seq", "user_id")


_SIZE = "CASE WHEN {n} < 1024 THEN {n} || ' B' ELSE printf('%.1f', {n} / 1024.0::DOUBLE) || ' KB' END"


@query(f"SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS video, CASE WHEN event_type <> 'error' THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN coalesce(CAST(floor(value * 40) AS BIGINT), 0) = 0 THEN '-' ELSE {_SIZE.format(n='CAST(floor(value * 40) AS BIGINT)')} END AS size, strftime(ts, '%Y-%m-%d %H:%M') AS date FROM events ORDER BY event_id DESC LIMIT 40")
def status_lines(spark, d):
    h = read(spark, d, "events").selectExpr("event_id AS seq", "user_id AS video_id", "CAST(NULL AS STRING) AS title", "IF(event_type = 'error', 'failed', 'completed') AS status", "CAST(floor(value * 40) AS BIGINT) AS file_size", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp")
    return history.status_lines(h, 40)


@query("SELECT c_custkey AS channel_id, c_name AS channel, format('{:,}', CAST(floor(greatest(c_acctbal, 0) * 1000) AS BIGINT)) AS subscribers, format('{:,}', c_nationkey) AS videos, '2024-01-15' AS created, CASE WHEN length(repeat(c_mktsegment, c_nationkey)) > 200 THEN left(repeat(c_mktsegment, c_nationkey), 200) || '...' ELSE repeat(c_mktsegment, c_nationkey) END AS description FROM customer")
def channel_panels(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey AS channel_id", "c_name AS channel_title", "CAST(floor(greatest(c_acctbal, 0) * 1000) AS BIGINT) AS subscriber_count", "c_nationkey AS video_count", "'2024-01-15T10:00:00Z' AS created_date", "repeat(c_mktsegment, c_nationkey) AS description")
    return inputs.channel_info(c)


def _done(spark, d):
    return read(spark, d, "labels").selectExpr("doc_id", "IF(quality = 1, 'completed', 'failed') AS status")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_items(spark, d):
    return history.pending(read(spark, d, "documents"), _done(spark, d), "doc_id").select("doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'extracted' END AS \"group\" FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def status_groups(spark, d):
    return history.by_status(read(spark, d, "documents").select("doc_id"), _done(spark, d), "doc_id")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS skipped, round(count(*) FILTER (WHERE event_type IN ('purchase', 'error', 'view')) * 100.0::DOUBLE / count(*), 6) AS progress, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events")
def run_progress(spark, d):
    e = read(spark, d, "events").selectExpr("CAST(event_id AS STRING) AS video_id", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'waiting' END AS status", "props AS error")
    return history.run_counters(e).select("total", "completed", "failed", "skipped", F.round("progress", 6).alias("progress"), F.col("failed").alias("n_errors"))


_RUN = "count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS skipped"
_DONE = "(completed + failed + skipped)"
_RATE = f"CASE WHEN seconds <= 0 THEN 0.0::DOUBLE ELSE {_DONE} * 60.0::DOUBLE / seconds END"


@query(f"SELECT *, CASE WHEN total = 0 THEN 100.0::DOUBLE ELSE {_DONE} * 100.0::DOUBLE / total END AS progress FROM (SELECT {_RUN} FROM events)")
def observed_progress(spark, d):
    """Counted by the job that writes the results."""
    e = read(spark, d, "events").selectExpr("event_id", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'waiting' END AS status")
    results, seen = runs.observed(e)
    stored(results)
    counts = spark.createDataFrame([seen.get], "total long, completed long, failed long, skipped long").withColumn("seconds", F.lit(0))
    return runs.progress(counts).select("total", "completed", "failed", "skipped", "progress")


@query(
    f"""WITH r AS (SELECT user_id, {_RUN}, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY user_id), x AS (SELECT *, {_RATE} AS rate FROM r)
SELECT user_id, round({_DONE} * 100.0::DOUBLE / total, 6) AS progress, round(rate, 6) AS rate, round(CASE WHEN rate <= 0 THEN 0.0::DOUBLE ELSE (total - {_DONE}) * 60.0::DOUBLE / rate END, 3) AS "left" FROM x"""
)
def run_rates(spark, d):
    e = read(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    counts = e.groupBy("user_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("event_type") == t).alias(s) for s, t in (("completed", "purchase"), ("failed", "error"), ("skipped", "view"))), (F.max("s") - F.min("s")).alias("seconds"))
    return runs.progress(counts).select("user_id", F.round("progress", 6).alias("progress"), F.round("rate", 6).alias("rate"), F.round("left", 3).alias("left"))


@query("SELECT CAST(event_id AS VARCHAR) AS video_id, props AS error FROM events WHERE event_type = 'error'")
def run_failures(spark, d):
    e = read(spark, d, "events").selectExpr("CAST(event_id AS STRING) AS video_id", "IF(event_type = 'error', 'failed', 'completed') AS status", "props AS error")
    return history.failures(e)


@query("SELECT doc_id AS video_id, CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 5 IN (0, 3) THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'not_found' WHEN doc_id % 5 = 3 THEN 'extraction_failed' END AS error, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 3 THEN 3 WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 3 THEN 3.0::DOUBLE WHEN doc_id % 5 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS delay FROM documents")
def extraction_run(spark, d):
    """Fetches that always fail, fail once, or are not there; no time is waited."""

    def fetch(video_id, attempt):
        if video_id % 5 == 0:
            raise GleanerError("not_found")
        if video_id % 5 == 3 or video_id % 5 == 1 and attempt == 0:
            raise RuntimeError("no answer")
        return f"text of {video_id}"

    items = read(spark, d, "documents").selectExpr("doc_id AS video_id")
    done = items.where("video_id % 7 = 0").withColumn("status", F.lit("completed"))
    return runs.run_extraction(items, done, fetch, max_retries=2, jitter=0.0, sleep=lambda s: None).select("video_id", "status", "error", "attempts", "delay")


@query("SELECT l.doc_id, coalesce(nullif(d.source, ''), CAST(l.doc_id AS VARCHAR)) AS title FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) d USING (doc_id)")
def result_titles(spark, d):
    items = read(spark, d, "documents").selectExpr("doc_id", "source AS title")
    return history.with_titles(read(spark, d, "labels").select("doc_id"), items, "doc_id")


# ---- ids, references, synthesis: units made from the documents, a unit for each type and source ----------------

_CASES = "CASE doc_id % 9 WHEN 0 THEN 'a--b' WHEN 1 THEN '' WHEN 2 THEN source WHEN 3 THEN '-' || source WHEN 4 THEN lang || '-' WHEN 5 THEN lang || '_' || source || '-x' WHEN 6 THEN upper(lang) || '-' || source WHEN 7 THEN lang || '-' || source || '-' || doc_id ELSE lang || '-' || source END"


@query(f"SELECT doc_id, regexp_matches({_CASES}, '^[a-z0-9]+(-[a-z0-9]+)+$') AS valid FROM documents")
def valid_ids(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{_CASES} AS id").selectExpr("doc_id", f"{fmt.valid_id('id')} AS valid")


_KINDS = ("technique", "pattern", "use-case", "issue", "component")
_KIND = "CASE {} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_UNIT = f"""SELECT doc_id AS ord, t AS type, t || '-' || source AS id, source || ' ' || lang AS name,
  replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'see ' || t2 || '-src' || doc_id % 23 || ' and ' || t || '-' || source AS content, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS source_video_id
  FROM (SELECT *, {_KIND.format('doc_id % 5')} AS t, {_KIND.format('CAST(floor(doc_id / 5) AS BIGINT) % 5')} AS t2 FROM documents)"""
_FIX = f"u AS ({_UNIT})"
_REF = r"(?i)\b(?:technique|pattern|use-case|capability|integration|antipattern|component|issue|config|snippet)-[a-z0-9-]+\b"


def _units(spark, d):
    return spark.sql(_UNIT.replace("FROM documents", "FROM {documents}"), documents=read(spark, d, "documents"))


@query(f"WITH {_FIX} SELECT ord, coalesce(list_aggregate(list_sort(list_filter(list_distinct(regexp_extract_all(content, '{_REF}')), lambda r: r <> id)), 'string_agg', ','), '') AS refs FROM u")
def cross_refs(spark, d):
    return _units(spark, d).selectExpr("ord", f"array_join({fmt.cross_references('content', 'id')}, ',') AS refs")


_MERGED = r"""pieces AS (SELECT id, ord, unnest(string_split(content, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS pos FROM u),
clean AS (SELECT id, ord, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM pieces),
firsts AS (SELECT * FROM clean WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY id, lower(p) ORDER BY ord, pos) = 1),
merged AS (SELECT id, string_agg(p, chr(10) || chr(10) ORDER BY ord, pos) AS content FROM firsts GROUP BY id)"""
_SYNTH = f"""WITH {_FIX}, {_MERGED}, refs AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '{_REF}')) AS ref FROM u),
ok AS (SELECT id, string_agg(ref, ',' ORDER BY ref) AS cross_references FROM refs WHERE ref <> id AND ref IN (SELECT id FROM u) GROUP BY id),
syn AS (SELECT id, min_by(type, ord) AS type, min_by(name, ord) AS name, coalesce(string_agg(DISTINCT nullif(source_video_id, ''), ',' ORDER BY nullif(source_video_id, '')), '') AS source_videos, count(DISTINCT nullif(source_video_id, '')) AS n_sources FROM u GROUP BY id),
s AS (SELECT syn.*, coalesce(merged.content, '') AS content, coalesce(ok.cross_references, '') AS cross_references FROM syn LEFT JOIN merged USING (id) LEFT JOIN ok USING (id))"""


_PART = 4000
_PARTS = f"parts AS (SELECT id, k AS part, k * {_PART} AS \"offset\", substr(content, k * {_PART} + 1, {_PART}) AS text FROM (SELECT id, content, unnest(range(greatest(1, CAST(ceil(length(content) / {_PART}.0) AS BIGINT)))) AS k FROM (SELECT id, coalesce(content, '') AS content FROM (SELECT DISTINCT id FROM u) LEFT JOIN merged USING (id))))"


@query(f"WITH {_FIX}, {_MERGED}, {_PARTS} SELECT id, part, \"offset\", text FROM parts")
def merge_paragraphs(spark, d):
    return synthesis.merge_paragraphs(_units(spark, d), _PART)


@query(
    f"""{_SYNTH}, {_PARTS} SELECT id, type, name, part, "offset", text, n_sources, CASE WHEN cross_references = '' THEN 0 ELSE len(string_split(cross_references, ',')) END AS n_references,
    length(content) AS content_length, CAST(len(string_split(content, chr(10) || chr(10))) AS BIGINT) AS paragraph_count FROM s JOIN parts USING (id)"""
)
def synthesize_units(spark, d):
    s = synthesis.synthesis(_units(spark, d), _PART)
    heads = s.heads.drop("mixed_types").withColumn("n", F.col("content_length") / _PART + 1)
    return with_group(stored(s.parts), heads, "id")


@query(f"{_SYNTH} SELECT id, type, name, content, source_videos, cross_references FROM s")
def synthesize_whole(spark, d):
    return synthesis.synthesize(_units(spark, d)).select("id", "type", "name", "content", F.array_join("source_videos", ",").alias("source_videos"), F.array_join("cross_references", ",").alias("cross_references"))


_LATER = "(SELECT ord + CASE WHEN ord % 2 = 0 THEN 0 ELSE 1000000000 END AS ord, type, id, name, content, source_video_id FROM (" + _UNIT + "))"
_LATER_MERGED = _MERGED.replace("FROM u)", f"FROM {_LATER})", 1)


@query(f"WITH {_LATER_MERGED}, named AS (SELECT id, min_by(name, ord) AS name FROM {_LATER} GROUP BY id) SELECT id, name, sha256(coalesce(content, '')) AS digest FROM named LEFT JOIN merged USING (id)")
def union_of_analyses(spark, d):
    """Two analyses, the documents with even ids first: the earlier one names a unit and its paragraphs come first."""
    u = _units(spark, d)
    s = synthesis.synthesize(synthesis.union_units(u.where("ord % 2 = 0"), u.where("ord % 2 = 1")))
    return s.select("id", "name", F.sha2("content", 256).alias("digest"))


@query(f"WITH {_FIX} SELECT DISTINCT id, source_video_id AS video_id FROM u WHERE source_video_id <> ''")
def unit_sources(spark, d):
    return synthesis.synthesis(_units(spark, d)).sources


@query(f"{_SYNTH}, r AS (SELECT id, unnest(string_split(cross_references, ',')) AS ref FROM s WHERE cross_references <> '') SELECT id, ref FROM r")
def unit_references(spark, d):
    return synthesis.synthesis(_units(spark, d)).references


@query(f"{_SYNTH}, e AS (SELECT id AS src, unnest(string_split(cross_references, ',')) AS dst FROM s) SELECT DISTINCT e.src AS a, e.dst AS b FROM e JOIN e f ON e.src = f.dst AND e.dst = f.src WHERE e.src < e.dst")
def mutual_refs(spark, d):
    return synthesis.mutual_references(synthesis.synthesize(_units(spark, d)))


_HEADS = "CASE type WHEN 'technique' THEN '## Techniques (' WHEN 'pattern' THEN '## Patterns (' WHEN 'use-case' THEN '## Use Cases (' WHEN 'issue' THEN '## Troubleshooting (' ELSE '## Architecture Components (' END"
_FOLDERS = "CASE type WHEN 'issue' THEN 'troubleshooting' ELSE type || 's' END"


@query(f"{_SYNTH} SELECT type, {_HEADS} || count(*) OVER (PARTITION BY type) || ')' AS heading, name, id, '- [' || name || '](' || {_FOLDERS} || '/' || id || '.md) - ' || n_sources || ' source(s)' AS line FROM s")
def type_index(spark, d):
    syn = synthesis.synthesize(_units(spark, d))
    return synthesis.index_lines(syn).join(synthesis.headings(syn).select("type", "heading"), "type")


@query(f"{_SYNTH} SELECT count(*) AS units, count(DISTINCT type) AS types, CAST(sum(CASE WHEN cross_references = '' THEN 0 ELSE len(string_split(cross_references, ',')) END) AS BIGINT) AS \"references\", (SELECT count(DISTINCT source_video_id) FROM u WHERE source_video_id <> '') AS sources, (SELECT count(*) FROM documents) AS analyses FROM s")
def synthesis_totals(spark, d):
    return synthesis.totals(synthesis.synthesize(_units(spark, d)), read(spark, d, "documents"))


@query(f"{_SYNTH} SELECT id, name, type, length(content) AS content_length, CAST(len(string_split(content, chr(10) || chr(10))) AS INT) AS paragraph_count FROM s")
def unit_metadata(spark, d):
    return synthesis.metadata(synthesis.synthesize(_units(spark, d))).select("id", "name", "type", "content_length", "paragraph_count")


@query(f"{_SYNTH} SELECT type, count(*) AS units, CAST(sum(n_sources) AS BIGINT) AS source_links FROM s GROUP BY type")
def synthesis_stats(spark, d):
    return synthesis.stats(synthesis.synthesize(_units(spark, d)))


_NL = "chr(10)"
_LINKS = f"list_aggregate(list_transform(string_split(cross_references, ','), lambda r: '- [' || r || '](../' || CASE split_part(r, '-', 1) WHEN 'issue' THEN 'troubleshooting' WHEN 'use' THEN 'use-cases' ELSE split_part(r, '-', 1) || 's' END || '/' || r || '.md)' || {_NL}), 'string_agg', '')"
_PAGES = f"""{_SYNTH}, pages AS (SELECT {_FOLDERS} || '/' || id || '.md' AS path, '# ' || name || {_NL} || {_NL} || '**ID**: `' || id || '`  ' || {_NL} || '**Type**: ' || type || '  ' || {_NL} || '**Sources**: ' || n_sources || ' video(s)' || {_NL} || {_NL}
  || CASE WHEN n_sources > 0 THEN '## Source Videos' || {_NL} || {_NL} || list_aggregate(list_transform(string_split(source_videos, ','), lambda v: '- `' || v || '`' || {_NL}), 'string_agg', '') || {_NL} ELSE '' END
  || '## Content' || {_NL} || {_NL} || content || {_NL} || CASE WHEN cross_references <> '' THEN {_NL} || '## Related Knowledge' || {_NL} || {_NL} || {_LINKS} ELSE '' END AS value FROM s)"""


@query(f"{_PAGES} SELECT path, value FROM pages")
def unit_pages(spark, d):
    return synthesis.unit_markdown(synthesis.synthesize(_units(spark, d)))


@query(f"{_PAGES} SELECT path, length(value) AS n_chars, sha256(value) AS digest FROM pages")
def page_files(spark, d):
    """A file for each unit, written part by part and read back."""
    root = scratch.folder(spark)
    write_pages(synthesis.unit_page_rows(synthesis.synthesis(_units(spark, d), _PART)), root, "section", "place", "key")
    return read_pages(spark, root).select("path", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("digest"))


_BODY = "regexp_replace(text, '[#`]', '', 'g')"


@query(
    rf"""SELECT 'technique' AS type, 'technique-' || doc_id AS id, lang || ' ' || source AS name, '### Technique: ' || lang || ' ' || source || chr(10) || '**ID**: `technique-' || doc_id || '`' || chr(10) || regexp_replace({_BODY}, '^\s+|\s+$', '', 'g') AS content, doc_id AS source_video_id, 0 AS section, 0 AS ord FROM documents
UNION ALL SELECT 'config', 'config-' || doc_id, 'Setup', '### Config: Setup' || chr(10) || '**ID**: `config-' || doc_id || '`' || chr(10) || 'key = ' || n_chars, doc_id, 8, 1 FROM documents
UNION ALL SELECT 'config', 'config-x' || doc_id, 'First', '### Config: First' || chr(10) || '**ID**: `config-x' || doc_id || '`' || chr(10), doc_id, 8, 0 FROM documents"""
)
def parse_units(spark, d):
    answer = "concat('# Notes\n\n## 1. Techniques Extracted\n\n### Technique: ', lang, ' ', source, '\n**ID**: `technique-', doc_id, '`\n', regexp_replace(text, '[#`]', ''), '\n\n## 77. Unknown\n### Technique: No\n**ID**: `technique-no`\n\n## 9. CONFIGURATION RECIPES\n### Config: First\n**ID**: `config-x', doc_id, '`\n### Config: without id\nx\n### Configuration: Setup\n**ID**: `config-', doc_id, '`\nkey = ', n_chars, '\n')"
    return parse.parse_units(read(spark, d, "documents").selectExpr("doc_id", f"{answer} AS raw"), "doc_id")


_TALK = "t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"
_FIRST = "coalesce(nullif(trim(left(split_part(text, chr(10), 1), 40)), ''), '(empty)')"


@query(f"WITH {_TALK} SELECT conv_id AS doc_id, CAST((length(text) + 25) // 4 AS BIGINT) AS input_tokens, CAST((length('## 1. Techniques Extracted') + 2 + length('### Technique: ' || {_FIRST}) + 1 + length('**ID**: `technique-' || length(text) || '`') + 1) // 4 AS BIGINT) AS output_tokens, {_FIRST} AS name, 'technique-' || length(text) AS id FROM t")
def transcript_analysis(spark, d):
    docs = inputs.transcripts(read(spark, d, "conversations"), "conv_id", "turn").selectExpr("conv_id AS doc_id", "transcript AS text")
    answers, units = analyze.analyze_transcripts(docs, "Template")
    return answers.join(units.withColumnRenamed("source_video_id", "doc_id"), "doc_id").select("doc_id", "input_tokens", "output_tokens", "name", "id")


@query(f"WITH u AS (SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) || chr(9) || text AS line FROM conversations) SELECT doc_id, count(*) AS n_units, sha256(string_agg(line, chr(10) ORDER BY line)) AS units_hash FROM u GROUP BY doc_id")
def units_hash(spark, d):
    return compare.unit_hashes(read(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS id", "text"))


_LANES = " || ".join(f"printf('%015x', CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT))" for i in range(4))


@query(f"SELECT source AS doc_id, count(*) AS n_units, {_LANES} AS units_hash FROM (SELECT source, sha256(CAST(doc_id AS VARCHAR) || chr(9) || text) AS h FROM documents) GROUP BY source")
def units_multiset_hash(spark, d):
    return compare.multiset_hashes(read(spark, d, "documents").selectExpr("source AS doc_id", "doc_id AS id", "text"))


@query("SELECT count(*) AS documents, round(avg(CASE WHEN h = 1 THEN 1 ELSE 0 END) * 100, 6) AS rate FROM (SELECT source, count(DISTINCT sha256(text)) AS h FROM documents GROUP BY source, lang)")
def determinism_rate(spark, d):
    runs_ = read(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("doc_id"), F.sha2("text", 256).alias("units_hash"))
    return compare.determinism_rate(compare.determinism(runs_))


@query("WITH n AS (SELECT conv_id, turn FROM conversations), p AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 AND turn % 2 = 0) SELECT n.conv_id AS doc_id, count(*) AS n_units, (SELECT nullif(count(*), 0) FROM p WHERE p.conv_id = n.conv_id) AS n_prior, (SELECT count(DISTINCT turn) FROM p WHERE p.conv_id = n.conv_id) AS n_shared FROM n GROUP BY n.conv_id")
def prior_comparison(spark, d):
    units = read(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS id")
    return compare.against_prior(units, units.where("doc_id % 3 != 0 AND id % 2 = 0"))


# ---- labels, cost ----------------------------------------------------------------------------------------------


@query("SELECT conv_id, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS input_tokens, 100 AS output_tokens, round(floor(sum(length(text)) / 4) * 0.000003::DOUBLE + 100 * 0.000015::DOUBLE, 9) AS cost FROM conversations GROUP BY conv_id")
def token_cost(spark, d):
    u = cost.estimate(read(spark, d, "conversations"), "conv_id").withColumn("model", F.lit("claude-sonnet-4-5-20250929"))
    return cost.with_cost(u).select("conv_id", "input_tokens", F.col("output_tokens").cast("int").alias("output_tokens"), F.round("cost", 9).alias("cost"))


@query("WITH u AS (SELECT conv_id, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS i FROM conversations GROUP BY conv_id) SELECT CAST(sum(i) AS BIGINT) AS input_tokens, 100 * count(*) AS output_tokens, count(*) AS requests, round(sum(i * 0.000015::DOUBLE + 100 * 0.000075::DOUBLE), 6) AS cost FROM u")
def usage_totals(spark, d):
    u = cost.estimate(read(spark, d, "conversations"), "conv_id").withColumn("model", F.lit("unpriced"))
    return cost.totals(cost.with_cost(u)).withColumn("cost", F.round("cost", 6))


_LABEL = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'technique' WHEN 1 THEN 'code-snippet' WHEN 2 THEN 'nope' ELSE 'pattern' END AS type, left(text, CAST(doc_id % 100 AS INT)) AS name, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE left(text, CAST(doc_id % 400 AS INT)) END AS summary, (doc_id % 13) / 11.0 AS confidence FROM documents"


@query(f"SELECT id, coalesce(type IN {normalize.TYPES!r} AND length(name) BETWEEN 1 AND 80 AND length(summary) BETWEEN 1 AND 300 AND confidence BETWEEN 0 AND 1, false) AS ok FROM ({_LABEL})")
def schema_check(spark, d):
    return spark.sql(_LABEL.replace("FROM documents", "FROM {documents}"), documents=read(spark, d, "documents")).selectExpr("id", f"{normalize.valid_unit()} AS ok")


_BAD = {"short": "length(text) < 100", "no_space": "instr(text, ' ') = 0", "shouting": "upper(text) = text", "long": "length(text) > 10000", "lang": "lang IS NULL OR lang NOT IN ('en', 'de', 'fr')"}
_BROKEN = "list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _BAD.items()) + "], lambda e: e IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_BROKEN}, ',') AS errors FROM documents WHERE len({_BROKEN}) > 0")
def document_rejects(spark, d):
    checked = validate.check_rows(read(spark, d, "documents"), _BAD, scratch.folder(spark))
    return checked.rejects.select("doc_id", F.array_join("errors", ",").alias("errors"))


_VIDEO = "SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey END AS video_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title, CASE p_partkey % 5 WHEN 0 THEN '12.5' WHEN 1 THEN NULL ELSE CAST(p_size AS VARCHAR(9)) END AS duration_seconds, '2024-01-01' AS upload_date, p_partkey FROM part"


@query(f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN video_id IS NULL THEN 'video_id' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN duration_seconds IS NULL OR duration_seconds = '12.5' THEN 'duration_seconds' END], lambda e: e IS NOT NULL), ',') AS problem FROM ({_VIDEO}) WHERE video_id IS NULL OR title IS NULL OR duration_seconds IS NULL OR duration_seconds = '12.5'")
def video_rejects(spark, d):
    videos = spark.sql(_VIDEO.replace("FROM part", "FROM {part}"), part=read(spark, d, "part"))
    return inputs.invalid_videos(videos).select("p_partkey", "problem")


def _split(spark, d):
    docs = read(spark, d, "documents").selectExpr("source AS doc_id", "doc_id AS ord", "CAST(doc_id AS STRING) AS id", "text")
    held = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").selectExpr("source AS video_id", "CAST(doc_id AS STRING) AS unit_id", "'pattern' AS type", "'n' AS name", "'s' AS summary", "0.5D AS confidence", "IF(quality = 1, 'now', 'old') AS normalizer_sig")
    return normalize.cache_split(docs, held, "now")


@query("WITH h AS (SELECT d.source, bool_and(coalesce(l.quality = 1, false)) AS ok FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source) SELECT d.doc_id AS ord, CASE WHEN h.ok THEN 'cache' ELSE 'provider' END AS via FROM documents d JOIN h USING (source)")
def cache_hits(spark, d):
    hits, misses = _split(spark, d)
    return hits.select("ord", F.lit("cache").alias("via")).unionByName(misses.select("ord", F.lit("provider").alias("via")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'component' AS type, '(unclear)' AS name, left(text, 280) AS summary, 0.3::DOUBLE AS confidence FROM documents")
def fallback_units(spark, d):
    return read(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "text").selectExpr(*normalize.fallback())


@query("SELECT conv_id AS doc_id, count(*) AS n, count(*) AS fallbacks FROM conversations GROUP BY conv_id")
def provider_failures(spark, d):
    c = read(spark, d, "conversations").selectExpr("conv_id AS doc_id", "CAST(turn AS BIGINT) AS ord", "CAST(turn AS STRING) AS id", "text")
    return normalize.ask(c, lambda doc, cs: [], 1).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("is_fallback").alias("fallbacks"))


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean_chars, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY lang")
def quality_averages(spark, d):
    docs = read(spark, d, "documents")
    hashes = docs.groupBy("lang").agg(F.count_distinct(F.sha2("text", 256)).alias("hashes"))
    return compare.averages(docs, "lang", "n_chars").withColumnRenamed("mean_n_chars", "mean_chars").join(hashes, "lang")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_rows(spark, d):
    return history.latest(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def versioned_upsert(spark, d):
    """Each user's row, brought up to date by three versions of a table."""
    events, root = read(spark, d, "events"), scratch.folder(spark)
    for upto in (3, 6, 10):
        now = events.where(f"event_id % 10 < {upto}").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
        versions.upsert_table(now.where(f"user_id % 2 = {upto % 2} OR {upto} = 10"), root, ["user_id"], 8)
    return versions.read_table(spark, root, "user_id long, event_id long, n long")


@query(f"SELECT doc_id || '/' || id AS id, 'technique' AS type, left(text, 80) AS name, 1 AS n_sources FROM ({ORACLES['top_units']})")
def knowledge_run(spark, d):
    from gleaner.plans.workflow import knowledge

    cache = spark.createDataFrame([], "video_id bigint, unit_id string, type string, name string, summary string, confidence double, normalizer_sig string")
    return knowledge(read(spark, d, "documents").select("doc_id", "text"), cache, "sig")[0].select("id", "type", "name", F.size("source_videos").alias("n_sources"))



