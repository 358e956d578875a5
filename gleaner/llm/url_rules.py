"""URL filter: a trie over reversed host labels, then path segments; the longest fitting rule decides.

Method: every rule ``host/path`` is one walk in a trie whose edges are the host's labels from the right
and then the path's segments. A url walks the same trie once; the deepest rule met on the way gives the verdict,
so the cost of a url is its own depth, whatever the number of rules. Where one rule is listed both to allow and to block, it blocks.

The trie itself is broadcast, and each worker process reads it once. Lists whose trie would be larger than ``MAX_EDGES`` are cut into
several tries, each applied in a pass of its own over what the ones before found, so that no list is too long.

Cases: a null url, or one without ``://``, has an empty host and an empty path and fits no rule. A url that fits no
rule gets ``default`` (allow). A url without a path has the empty path, which starts no rule's ``/``. Repeated rows
give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

#: The list that the pages query judges by.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Edges of the largest trie that is broadcast, some 50 MB.
MAX_EDGES = 200_000

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, cut at the first of ``/ ? #`` and the first of ``? #``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    before = rest
    for mark in "?#":
        before = before.partition(mark)[0]
    host, slash, path = before.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Edges are (node, label) -> node, the root is node 0. A host node's paths hang under the label ``/``, which no host has.

    A path ``/a/b/c`` walks the edges ``a`` and ``b``; its last, perhaps unfinished, segment ``c`` is a prefix of the
    url's segment there and stays among the node's ends, the one to try first in front.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, list[tuple[str, bool, str, str, int]]] = {}
        for rule in rules:
            self.add(rule)
        for ends in self.ends.values():
            ends.sort(key=lambda e: (len(e[0]), e[1], e[3] == "block"), reverse=True)

    def _child(self, node: int, label: str) -> int:
        return self.edges.setdefault((node, label), len(self.edges) + 1)

    def add(self, rule: tuple[str, str, str]) -> None:
        host, path, verdict = rule
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict!r}")
        if path and not path.startswith("/"):
            return  # starts no url's path
        node = 0
        for label in reversed(host.translate(_LOWER).split(".")):
            node = self._child(node, label)
        *whole, last = path.removeprefix("/").split("/")
        node = self._child(node, "/")
        for segment in whole:
            node = self._child(node, segment)
        self.ends.setdefault(node, []).append((last, path.startswith("/"), host + path, verdict, len(path)))

    def match(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """Rule, verdict, host labels and path length of the longest rule that fits: by host labels first, then by the path's length."""
        best, node, edges = None, 0, self.edges
        if not host:
            return None
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = edges.get((node, label))
            if node is None:
                break
            paths = edges.get((node, "/"))
            if paths is not None and (found := self._path(paths, path)):
                best = (found[2], found[3], depth, found[4])
        return best

    def _path(self, node: int, path: str) -> tuple | None:
        best, rooted = None, path.startswith("/")
        for segment in path.removeprefix("/").split("/"):
            for end in self.ends.get(node, ()):
                if segment.startswith(end[0]) and (rooted or not end[1]):
                    best = end
                    break
            node = self.edges.get((node, segment))
            if node is None:
                break
        return best


def tries(rules: Iterable[tuple[str, str, str]], max_edges: int = MAX_EDGES) -> list[UrlTrie]:
    """Tries of bounded size that hold all rules, neighbours by host in one trie."""
    parts: list[list] = [[]]
    size = 0
    for rule in sorted(set(rules), key=lambda r: (r[0].split(".")[::-1], r[1:])):
        depth = rule[0].count(".") + rule[1].count("/") + 2
        if parts[-1] and size + depth > max_edges:
            parts.append([])
            size = 0
        parts[-1].append(rule)
        size += depth
    return [UrlTrie(p) for p in parts]


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_edges: int = MAX_EDGES) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule (null if none fits), verdict."""
    names = ["id", "host", "path", "rule", "verdict", "labels", "size"]
    schema = f"id {df.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, labels int, size int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = zip(*(split_url(u) for u in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.nulls(n, pa.string()), pa.array([default] * n, pa.string()), *[pa.array([-1] * n, pa.int32())] * 2], names)

    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).mapInArrow(split, schema)
    for number, trie in enumerate(tries(rules, max_edges)):
        if number:  # one trie in memory at a time
            out = written(out)
        shared = df.sparkSession.sparkContext.broadcast(trie)

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = shared.value.match
            for batch in batches:
                ids, hosts, paths, *before = batch.columns
                rows = []
                for host, path, *known in zip(hosts.to_pylist(), paths.to_pylist(), *(c.to_pylist() for c in before), strict=True):
                    found = match(host, path)
                    # of a rule that stands in two tries with both verdicts, the one that blocks
                    rows.append(found if found and (*found[2:], found[1] == "block") > (*known[2:], known[1] == "block") else known)
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([ids, hosts, paths, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True))], names)

        out = out.mapInArrow(judge, schema)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
cut AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*', 0), '') AS raw_host, coalesce(regexp_extract(rest, '^[^?#]*', 0), '') AS before FROM parts),
hp AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(before, length(raw_host) + 1) AS path FROM cut),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM hp)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
