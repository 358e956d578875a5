import pytest
from pyspark.sql import functions as F

from gleaner import errors
from gleaner.functions.formatting import retryable
from gleaner.operators import requests


def test_backoff():
    assert [requests.backoff_delay(n, jitter=0) for n in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]
    assert 4 <= requests.backoff_delay(2) < 5


def test_request_checks(spark):
    good = ("claude-3-haiku-20240307", 100, 0.0, 1.0, ["user"])
    rows = [good, ("x", *good[1:]), (good[0], 0, *good[2:]), (*good[:2], 1.5, *good[3:]), (*good[:3], 0.0, ["user"]), (*good[:4], ["robot"]), (*good[:4], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, model string, max_tokens int, temperature double, top_p double, roles array<string>")
    got = [r.y for r in df.select("i", F.expr(requests.invalid_reason()).alias("y")).orderBy("i").collect()]
    assert got == [None, "model", "max_tokens", "temperature", "top_p", "roles", "roles"]


def test_prompts_and_summary(spark):
    c = spark.createDataFrame([(1, 1, "b", "y" * 400), (1, 0, "a", "x")], "doc_id long, ord long, id string, text string")
    prompt = requests.user_prompts(c).first().prompt
    assert prompt.startswith('{"video_id":"1","candidates":[{"id":"a","text":"x"},{"id":"b"') and "y" * 350 in prompt and "y" * 351 not in prompt
    u = spark.createDataFrame([(2, 1500, 500, 0.5)], "requests long, input_tokens long, output_tokens long, cost double")
    assert "Total Tokens: 2,000" in requests.usage_summary(u).first().summary and "$0.5000" in requests.usage_summary(u).first().summary


def test_errors(spark):
    rows = spark.createDataFrame([(429, ""), (503, ""), (400, "too many Tokens"), (404, ""), (None, "connection reset")], "s int, m string")
    assert [tuple(r) for r in rows.select(F.expr(errors.code_of_status("s", "m")), F.expr(retryable("s", "m"))).collect()] == [("rate_limit", True), ("api_error", True), ("token_limit", False), ("not_found", False), ("api_error", True)]
    assert errors.GleanerError("blank").code == "blank"
    with pytest.raises(ValueError):
        errors.GleanerError("nope")
