"""Text core as Spark SQL expressions. Each function takes and gives an expression string; wrap with ``F.expr``."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that open an instruction.
MODALS = "must|should|never|always"
VERBS = "use|set|avoid|ensure|check|install|enable|disable|measure|calculate"
IMPERATIVE = rf"^(?:(?:you|we)\s+)?(?:{MODALS})\b|^(?:{VERBS})\b"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_marks(s: str) -> str:
    """Each punctuation or symbol character becomes a space."""
    return f"regexp_replace({s}, {literal(r'[\p{P}\p{S}]')}, ' ')"


def collapse(s: str) -> str:
    """Runs of white space become one space; none at the ends."""
    return f"trim(regexp_replace({s}, {literal(r'(?U)\s+')}, ' '))"


def canon(s: str) -> str:
    """Comparison form of texts that compatibility normalisation leaves alone; see ``canon_column`` for all others."""
    return collapse(f"lower({strip_marks(s)})")


@functools.cache
def _touched() -> list[bool]:
    """For each code point, whether a text with it may change under NFKC: it changes itself, has a combining class, or joins with one before it."""
    out = [unicodedata.combining(c) != 0 or not unicodedata.is_normalized("NFKC", c) for c in map(chr, range(0x110000))]
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out[int(parts[1], 16)] = True
    for jamo in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)):  # fixed values: vowels and tails of syllables
        for i in jamo:
            out[i] = True
    return out


def _runs(flags: list[bool], value: bool) -> list[tuple[int, int]]:
    """First and last of each run of ``value``, surrogates left out."""
    out, start = [], None
    for i in range(len(flags) + 1):
        inside = i < len(flags) and flags[i] == value and not 0xD800 <= i <= 0xDFFF
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def changes(s: str) -> bool:
    """Whether NFKC changes a text."""
    return not s.isascii() and not unicodedata.is_normalized("NFKC", s)


@functools.cache
def outside_plain() -> str:
    """Pattern of a character outside the longer runs that NFKC leaves alone in the commonest scripts (up to Cyrillic, kana, Han, Hangul): few texts that NFKC does not touch have one. A short class, as it is tried range by range."""
    runs = [(a, b) for a, b in _runs(_touched(), False) if a < 0x530 and b - a >= 6 or 0x3000 <= a < 0x3100 and b - a >= 40 or 0x3100 <= a < 0xE000 and b - a >= 4000]
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def strip_and_normalise(s: str) -> str:
    """Each punctuation or symbol character becomes a space, then NFKC."""
    return unicodedata.normalize("NFKC", "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else strip_and_normalise(x) if changes(x) else None)


def canon_column(c: str, nfkc: bool = True) -> Column:
    """Comparison form of a column: marks to spaces, NFKC, lower case, white space collapsed. Only texts with a rare character leave the JVM, only those that NFKC touches come back."""
    stripped = F.expr(strip_marks(c))
    if nfkc:
        beyond = F.regexp_replace(c, r"[\x00-\x7f]+", "")  # what is not ASCII is little, and the class is slow
        rare = F.when(beyond.rlike(outside_plain()), F.col(c))
        stripped = F.coalesce(_nfkc(rare), stripped)
    return F.trim(F.regexp_replace(F.lower(stripped), r"(?U)\s+", " "))


def words(canon_s: str) -> str:
    """Word count of a text in comparison form."""
    return f"IF({canon_s} = '', 0, size(split({canon_s}, ' ', -1)))"


def quant(x: str) -> str:
    """Millionths, half to even."""
    return f"CAST(rint({x} * 1000000) AS BIGINT)"


def lex(a: str, b: str) -> str:
    """-1, 0 or 1 by code points."""
    return f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 ELSE 0 END"


def trigrams(canon_s: str) -> str:
    """Distinct runs of three characters of a text in comparison form."""
    return f"IF(length({canon_s}) >= 3, array_distinct(transform(sequence(1, greatest(length({canon_s}) - 2, 1)), i -> substr({canon_s}, i, 3))), array())"


def jaccard(a: str, b: str) -> str:
    """Similarity of two sets without repeats; two empty ones are alike."""
    shared = f"size(array_intersect({a}, {b}))"
    return f"IF(size({a}) + size({b}) = 0, 1.0D, {shared} / greatest(size({a}) + size({b}) - {shared}, 1))"


def imperative(canon_s: str) -> str:
    return f"CAST({canon_s} RLIKE {literal(IMPERATIVE)} AS INT)"


def occurrences(haystack: str, needle: str) -> str:
    """One more than the number of places, none overlapping; 0 for an empty needle."""
    return f"IF({needle} = '', 0L, 1L + CAST((length({haystack}) - length(replace({haystack}, {needle}, ''))) div greatest(length({needle}), 1) AS BIGINT))"


def clamp(n: str, lo: str, hi: str) -> str:
    return f"least(greatest({n}, {lo}), {hi})"


def score(occ: str, start: str, total: str, wc: str, max_words: int, imp: str) -> str:
    """Weighted sum, evaluated left to right."""
    return f"0.4D * {occ} + 0.2D * (1 - CAST({start} AS DOUBLE) / {total}) + 0.2D * (CAST(least({wc}, {max_words}) AS DOUBLE) / {max_words}) + 0.2D * {imp}"


def unit_id(window: str, start: str, end: str) -> str:
    return f"concat({window}, ':', {start}, '-', {end})"


def target_count(length: str) -> str:
    """Units to keep for a text of this length: one for 2,500 characters, 40 to 90."""
    return f"CAST({clamp(f'rint({length} / 2500.0D)', '40', '90')} AS INT)"
