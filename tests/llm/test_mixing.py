"""Mixing holds its targets where ids repeat or are missing, and where rows are wholly equal."""

from __future__ import annotations

import pytest

from palaver.llm import mixing

SCHEMA = "doc_id long, source string, text string, note string"


def _text(row):
    return tuple(map(str, row))


def _near(rows):
    by = {}
    for r in rows:
        a, b = by.setdefault(r.target, [0, 0])
        by[r.target] = [a + r.taken, b + 1]
    return all(abs(t - target) < 0.1 * target for target, (t, _) in by.items())


@pytest.fixture(scope="module")
def shared(spark):
    ten = " ".join("abcdefghij")
    rows = [(None, "a", f"{ten} {i}", None) for i in range(1500)] + [(7, "b", f"{i} {ten}", None) for i in range(1500)]
    rows += [(9, "c", ten, str(i % 2)) for i in range(1500)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_shared_and_missing_ids_meet_their_targets(shared):
    rows = mixing.taken(shared).collect()
    assert len(rows) == 4500 and _near(rows)
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(rows, key=_text) == sorted(mixing.taken(shared.repartition(3)).collect(), key=_text)


def test_the_mixed_rows_meet_them_too_and_keep_their_columns(shared):
    goals = {r.doc_id: r.target for r in mixing.taken(shared).select("doc_id", "target").distinct().collect()}
    mixed = mixing.mix(shared)
    assert mixed.columns == shared.columns
    got = {r.doc_id: r.n for r in mixed.selectExpr("doc_id", "size(split(text, ' ')) AS words").groupBy("doc_id").agg({"words": "sum"}).toDF("doc_id", "n").collect()}
    assert all(abs(got[k] - goals[k]) < 0.1 * goals[k] for k in goals)
    assert sorted(mixed.collect(), key=_text) == sorted(mixing.mix(shared.repartition(2)).collect(), key=_text)


def test_many_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    rows = mixing.numbered(spark.createDataFrame([("x", 23), ("y", 7), ("z", 1)], "__id string, __n long")).collect()
    assert sorted((r[0], r["__number"]) for r in rows) == sorted((k, i) for k, n in (("x", 23), ("y", 7), ("z", 1)) for i in range(n))
