"""Steps whose rows must follow the input: each posting moves once in an update, pairs of tokens are counted in bounded pieces."""

from pyspark.sql import functions as F

from palaver.functions.language import identifier_parts, index_tokens, token_set
from palaver.operators import ladder, search
from palaver.operators.increments import Postings
from test_planner_size import moved


def test_an_update_moves_each_posting_once(spark, tmp_path):
    rows = [("p", i, 0, " ".join(f"word{(i * 7 + k) % 90}" for k in range(20)), None) for i in range(200)]
    fresh = spark.createDataFrame(rows, "path string, session_id long, seq long, text string, ts timestamp")
    own = Postings(spark, str(tmp_path))
    n = moved(spark, lambda: own.update(fresh, spark.createDataFrame([("p", "new")], "path string, what string")))
    assert own.read().count() == 4000 == own.read().distinct().count()
    assert n < 6_000  # 12,000 when dealt, made distinct and dealt again


def test_pairs_of_tokens_are_counted_in_pieces(spark, monkeypatch):
    rows = [(i, " ".join(f"token{(i % 40) * 3 + k}" for k in range(8))) for i in range(300)] + [(None, "token1 token2")]
    texts = spark.createDataFrame(rows, "session_id long, text string")
    want = sorted(map(tuple, search.neighbours_of_tokens(texts, "session_id").collect()))
    monkeypatch.setattr(search, "SESSIONS", 10)
    df = search.neighbours_of_tokens(texts, "session_id")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()  # which nothing joins again
    assert sorted(map(tuple, df.collect())) == want and want


def test_light_tokens_are_those_of_the_index(spark):
    texts = ["aB abCDe x_y_z_longer " + "q" * 200, "ÉaÜber HTTPServer plain_words a-b", "", None, "İstanbul " + "é" * 70 + " é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.sort_array(index_tokens(F.col("text"))).alias("a"), F.sort_array(token_set(F.col("text"))).alias("b"), identifier_parts(F.col("text")).alias("p")).collect()
    assert all(r.a == r.b for r in df)
    assert df[1].p == ["über", "http", "server", "plain", "words"]


def test_neighbours_of_a_query_look_into_its_own_sessions(spark):
    rows = [(i, " ".join(f"token{(i % 40) * 3 + k}" for k in range(8))) for i in range(300)] + [(None, "token1 token2")]
    texts = spark.createDataFrame(rows, "session_id long, text string")
    few = ["token5", "token88", "absent"]
    want = sorted(r for r in map(tuple, search.neighbours_of_tokens(texts, "session_id").collect()) if r[0] in few)
    got = []
    n = moved(spark, lambda: got.extend(map(tuple, search.neighbours_of_tokens(texts, "session_id", of=few).collect())))
    assert sorted(got) == want and {r[0] for r in want} == {"token5", "token88"}
    assert n < moved(spark, lambda: search.neighbours_of_tokens(texts, "session_id").collect()) - 500


def test_a_term_that_nothing_holds_costs_no_neighbours(spark, monkeypatch):
    rows = [(f"s{i}", 0, t) for i in range(5) for t in ("alpha-beta", "gamma", "delta")]
    postings = spark.createDataFrame(rows, "session_id string, seq long, token string")
    monkeypatch.setattr(ladder, "neighbours_of_tokens", lambda *a, **k: 1 / 0)
    assert ladder.by_neighbours(postings, "zzzznothing").count() == 0


def test_only_near_spellings_reach_python(spark):
    rows = [(f"s{i}", 0, t) for i, t in enumerate(["migration", "mgiratoin", "migrations", "nigratoins", "xxxxxxxxx", "migr", "éigration"])]
    postings = spark.createDataFrame(rows, "session_id string, seq long, token string")
    found = ladder.spelled(postings, "migration")
    assert sorted(r.session_id for r in found.collect()) == ["s0", "s1", "s2", "s6"]
