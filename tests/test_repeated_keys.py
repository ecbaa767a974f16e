"""Objects that repeat a key are objects whatever was read before in the session."""

import pytest
from pyspark.sql import functions as F

from parley.sources import jsonl

TWICE = '{"id":"a","user":"u","user":"v","turns":[{"role":"user","content":"hi"}]}'


@pytest.fixture
def fresh(spark):
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    return spark.createDataFrame([(1, TWICE), (2, "[]"), (3, "{bad")], "line_number long, line string")


def test_lenient_objects(fresh):
    rows = fresh.select("line_number", jsonl.object_or_empty(F.col("line")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [TWICE, "{}", "{}"]


def test_normalized(fresh):
    good, rejects = jsonl.normalized(fresh, {"conversation_id": "id", "user_id": "user", "messages": "turns"})
    assert [(r.line_number, r.conversation_id) for r in good.collect()] == [(1, "a")] and sorted(r.reason for r in rejects.collect()) == ["invalid_json", "non_object_line"]
