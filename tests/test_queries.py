import json

import pytest
from pyspark.sql import functions as F

from palaver.operators.history import bigrams, repeated_questions
from palaver.operators.lookups import allowed, by_prefix, neighbourhood, titles
from palaver.operators.ranking import one_edit, relevance
from palaver.plans import ALL
from palaver.sources.transcripts import parsed


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(name, against_sql):
    against_sql(*ALL[name])


def test_entry_imports_without_training_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "palaver.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(ALL)
    sys.modules.pop("__spark_entry__", None)


def test_transcripts_skip_malformed_lines(spark):
    lines = [
        json.dumps({"type": "user", "sessionId": "s", "timestamp": "2026-04-09T07:14:25Z", "message": {"role": "user", "content": "plain words"}}),
        json.dumps({"type": "assistant", "sessionId": "s", "timestamp": "2026-04-09T07:14:26Z", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}}),
        "{broken",
    ]
    df = spark.createDataFrame([(v, "p", i) for i, v in enumerate(lines)], "value string, path string, n long")
    got = parsed(df, "message_blocks").orderBy("seq").collect()
    assert [(r.session_id, r.role, r.text, r.malformed) for r in got] == [("s", "user", "plain words", False), ("s", "assistant", "a\nb", False), ("p", None, None, True)]


def test_one_edit_counts_characters_and_swaps(spark):
    pairs = [("abc", "acb", True), ("ca", "abc", False), ("a", "ab", True), ("ab", "ba", True), ("é", "e", True), ("tion", "tioné", True), ("abcd", "badc", False), ("x", "x", True), ("", "a", True), ("abc", "abcde", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(one_edit(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_policy_takes_the_most_specific_rule(spark):
    rules = {"imported": False, "imported:box": True, "*": True}
    df = spark.createDataFrame([("local",), ("imported:box",), ("imported:other",), (None,)], "origin string")
    assert [r.ok for r in df.select(allowed(F.col("origin"), rules).alias("ok")).collect()] == [True, True, False, True]


def test_retrieval_tiers_take_empty_tables(spark):
    m = spark.createDataFrame([], "session_id long, seq long, role string, text string, ts timestamp")
    for df in (relevance(m, ["a", "b"]), neighbourhood(m, F.col("text") == "a"), titles(m), repeated_questions(m), bigrams(m), by_prefix(m, "1")):
        assert df.count() == 0
