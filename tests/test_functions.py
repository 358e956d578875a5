import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import formatting as fmt
from gleaner.functions import text as T


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").repartition(2)
    return [r.y for r in df.select("i", F.expr(expr).alias("y")).orderBy("i").collect()]


def slow_canon(s):
    s = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).lower()).strip()


def test_canon(spark):
    rng = random.Random(1)
    rows = ["", "  ", "A-b, C!", "É\t\n x", *("".join(rng.choice("aB .,!é ß-$\t") for _ in range(20)) for _ in range(300))]
    assert values(spark, T.canon("x"), rows) == [slow_canon(r) for r in rows]
    odd = spark.createDataFrame([("½ ⑴ ﬁ",)], "x string").select(T.canon_column("x").alias("y")).first().y
    assert odd == slow_canon("½ ⑴ ﬁ")


@pytest.mark.parametrize(
    ("expr", "rows", "want"),
    [
        (T.words(T.canon("x")), ["", "a", "a, b!"], [0, 1, 2]),
        (T.imperative("x"), ["use it", "you must go", "useful", "we never do", "go use"], [1, 1, 0, 1, 0]),
        (T.occurrences("'reuse item use it'", "x"), ["use it", "", "zz"], [3, 0, 1]),
        (fmt.iso_duration("x"), ["PT5M", "PT1H30M", "PT2H", "PT45S", "PT1H2M3S", "invalid", "", None], [300, 5400, 7200, 45, 3723, 0, 0, 0]),
        (fmt.iso_date("x"), ["2024-01-15T10:30:00Z", "2024-01-15T23:30:00-08:00", "invalid", "", None], ["2024-01-15", "2024-01-15", "unknown", "unknown", "unknown"]),
        (fmt.safe_int("x"), ["123", "", None, "12.5", " 12 "], [123, 0, 0, 0, 12]),
        (fmt.valid_id("x"), ["a-b", "technique-123", "", "ab", "-a", "a-", "a--b", "a_b-c", "A-b"], [True, True] + [False] * 7),
        (fmt.sanitize_filename("x"), ['a<b>:"/\\|?*c', " .x  y. ", ""], ["abc", "x y", ""]),
        (fmt.generate_filename("x"), ["Héllo, wörld - x"], ["Héllo-wörld-x.md"]),
        (fmt.strip_fence("x"), ['```json\n{"a":1}\n```', "```\n{}\n```", "{}", "  {}  ", "```json\n{}\n``` tail", ""], ['{"a":1}', "{}", "{}", "{}", "{}", ""]),
        (fmt.channel_ref("x") + ".id", ["youtube.com/@team.blue", "https://www.youtube.com/channel/UC1?x", "m.youtube.com/user/u", "example.org"], ["team.blue", "UC1", "u", None]),
    ],
)
def test_string_cases(spark, expr, rows, want):
    if expr.endswith(".id"):
        expr = f"({expr[:-3]}).id"
    assert values(spark, expr, rows) == want


@pytest.mark.parametrize(
    ("expr", "rows", "want"),
    [
        (fmt.clock("x"), [0, 45, 90, 3600, 3661, -5], ["0:00", "0:45", "1:30", "1:00:00", "1:01:01", "0:00"]),
        (fmt.human_duration("x"), [0, 59, 60, 3600, 7260, 7200], ["0 seconds", "59 seconds", "1 minutes", "1 hour", "2 hours 1 minutes", "2 hours"]),
        (fmt.thousands("x"), [0, 1234567], ["0", "1,234,567"]),
        (T.target_count("x"), [0, 100000, 103750, 106250, 10**6], [40, 40, 42, 42, 90]),
    ],
)
def test_number_cases(spark, expr, rows, want):
    assert values(spark, expr, rows, "long") == want


def test_decimals_round_as_binary_doubles(spark):
    rng = random.Random(2)
    rows = [0, 1, 999, 1000, 1500, 999999, 1500000, 2250, 2350, 1250000, *(rng.randrange(1, 40) * 50 + 1000 for _ in range(300)), *(rng.randrange(10**9) for _ in range(300))]

    def views(n):
        for unit, mark in ((10**6, "M"), (10**3, "K")):
            if n >= unit:
                return f"{n // unit}{mark} views" if n % unit == 0 else f"{n / unit:.1f}{mark} views"
        return "1 view" if n == 1 else f"{n} views"

    def size(n):
        if n < 1024:
            return f"{n} B"
        k = 0
        x = float(n)
        while x >= 1024 and k < 4:
            x, k = x / 1024, k + 1
        return f"{x:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][k]}"

    assert values(spark, fmt.view_count("x"), rows, "long") == [views(n) for n in rows]
    sizes = [*rows, 1024, 1048576, 2**30, 2**40, 1536, 1024 * 45 // 10, *(1024 + 1024 * k // 20 for k in range(40))]
    assert values(spark, fmt.file_size("x"), sizes, "long") == [size(n) for n in sizes]



def test_display_line_fits_80_code_points(spark):
    suffix = " (1:30) - 2024-01-01 - 1.5K views"
    long, short = values(spark, fmt.display_line("x", "90L", "'2024-01-01'", "1500L", "'new'"), ["t" * 100, "short"])
    assert len(long) == 80 and long.endswith("..." + suffix) and short == "\U0001f195 short" + suffix


def test_scores_quantise_half_to_even(spark):
    assert values(spark, T.quant("x"), [0.0000005, 0.0000015, 1.25], "double") == [0, 2, 1250000]
