"""Odd cases of what the whole-table queries use."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from palaver.functions import redact as R
from palaver.functions import scalars as S
from palaver.operators import served as V


def test_bits_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "aaaa"), (2, "abab"), (3, ""), (4, None), (5, "é東é東"), (6, "abcdefgh" * 1000)], "id long, text string")
    got = {r.id: r.bits for r in R.bits(rows, "id").collect()}
    assert got[3] is None and got[4] is None
    assert [got[k] for k in (1, 2, 5, 6)] == pytest.approx([0, 1, 1, 3])


def test_bits_are_exact_to_the_last_digits(spark):
    """Bits were what is left of one large number after another; at a boundary of the sixth digit that decides."""
    rng, letters = random.Random(5), "".join(map(chr, range(97, 97 + 60)))
    texts = ["".join(c * rng.randint(1, 3000) for c in letters) for _ in range(40)]

    def exact(text):
        with localcontext() as c:
            c.prec = 40
            p = [Decimal(k) / len(text) for k in Counter(text).values()]
            return -sum(x * x.ln() for x in p) / Decimal(2).ln()

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    off = [abs(Decimal(r.bits) - exact(texts[r.id])) for r in R.bits(rows, "id").collect()]
    assert len(off) == 40 and max(off) < Decimal("1e-15")


def test_tombstones_name_sessions_by_prefix_and_project(spark):
    metas = spark.createDataFrame([(12, "a"), (123, "b"), (21, "c"), (3, None), (None, "d")], "session_id long, project string")
    rules = spark.createDataFrame([("id", "12"), ("id", "12"), ("project", "c"), ("project", None), ("id", None)], "kind string, value string")
    assert sorted(r.session_id for r in V.forgotten(metas, rules).collect()) == [12, 21, 123]
    assert V.forgotten(metas, rules.where("kind = 'none'")).count() == 0


def test_densest_mention_of_odd_texts(spark):
    texts = ["", None, "the", "xthe" + " " * 300 + "thethe", "THE " * 600]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.p for r in rows.select("id", S.densest_mention(F.col("text"), "the").alias("p")).collect()}
    assert got == {0: -1, 1: None, 2: 0, 3: 304, 4: 0}


def test_all_mentions_of_a_long_text_count(spark):
    """Only the first 256 were looked at, so what comes after them never was the densest."""
    apart = ("the" + "." * 300) * 400
    rows = spark.createDataFrame([(1, apart + "the the the"), (2, apart + "the the" + apart + "the the"), (3, "THE " * 5000 + apart), (4, apart)], "id long, text string")
    got = {r.id: (r.p, r.f) for r in rows.select("id", S.densest_mention(F.col("text"), "the").alias("p"), S.densest_mention(F.col("text"), "the", first=256).alias("f")).collect()}
    assert got == {1: (len(apart), 0), 2: (len(apart), 0), 3: (0, 0), 4: (0, 0)}
    flat = "ion" + " far" * 100
    shown = spark.createDataFrame([(flat * 300 + "ion ion ion",)], "text string").select(S.snippet(F.col("text"), "ion").alias("s")).first().s
    assert shown.startswith("… ") and shown.endswith("ion ion ion")


def test_a_snippet_flattens_its_text_once(spark):
    """Each use of the flat text, of its mentions and of their place worked them out again."""
    long = "word ion " * 400 + "x" * 300 + " ionion ion" + " tail" * 80
    df = spark.createDataFrame([(1, long), (2, "no mention\nof it"), (3, None), (4, ""), (5, "tool_use of\n ion ")], "id long, text string")
    shown = df.select("id", S.snippet(F.col("text"), "ion").alias("shown"))
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tool_use") == 1 and plan.count("lower(") == 2  # one more for a text without mentions
    got = {r.id: r.shown for r in shown.collect()}
    assert got == {1: ("word ion " * 34)[:300].strip() + " …", 2: "no mention of it", 3: None, 4: "", 5: "ion"}
