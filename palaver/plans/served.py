"""Named queries over tiers, pages, digests, notes, imports and their state, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions.query import path_forms, query_keys, word_forms
from ..functions.text import tokens
from ..operators import ladder as R
from ..operators import mining as M
from ..operators import search as S
from ..operators import served as V
from ..operators.lookups import allowed
from ..sources.scratch import shared_dir
from ..sources.tables import messages, table, usage
from .cases import rows_sql
from .queries import _MESSAGES, _TOKENS, _USAGE, TERMS, _bm25_sql

_META = "(SELECT doc_id AS session_id, lang AS harness, source AS project, CASE WHEN doc_id % 7 = 0 THEN 'box' END AS machine, left(text, 60) AS title, TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INT) AS updated FROM documents)"
_NOW = "2024-12-01 00:00:00"
#: Index tokens, parts of identifiers (the test tables hold none beyond hyphens) and dates, as SQL.
_INDEX = rf"""(SELECT DISTINCT session_id, seq, unnest(list_concat(
    list_filter(flatten(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_-]+'), lambda r: [r])), lambda t: strlen(t) >= 2),
    [lower(monthname(ts)), strftime(ts, '%Y'), strftime(ts, '%Y-%m')])) AS token FROM {_MESSAGES})"""


def metas(s, d):
    day = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(400)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return table(s, d, "documents").select(F.col("doc_id").alias("session_id"), F.col("lang").alias("harness"), F.col("source").alias("project"), F.when(F.col("doc_id") % 7 == 0, "box").alias("machine"), F.left("text", F.lit(60)).alias("title"), day.alias("updated"))


def _lookup(s, d):
    path = shared_dir(s)
    R.write_postings(messages(s, d), path)
    return R.read_postings(s, path, ["the", "und", "2024-01"])


def _tier(tier, query):
    return lambda s, d: tier(R.indexed(messages(s, d)), query)


def _holding_sql(variants):
    rows = ", ".join(f"('{t}', '{v}')" for t, vs in variants.items() for v in vs)
    return f"SELECT session_id, count(*) AS messages FROM (SELECT session_id, seq FROM {_INDEX} JOIN (VALUES {rows}) w(term, variant) ON token = variant GROUP BY ALL HAVING count(DISTINCT term) = {len(variants)}) GROUP BY session_id"


_STEM = ["ortion"]


def _stemmed(s, d):
    """The word forms of terms that the table holds are few, so the query is one whose forms occur in it."""
    return R.holding(R.indexed(messages(s, d)), {t: word_forms(t) for t in _STEM})


def _ladder(s, d):
    post = R.indexed(messages(s, d)).persist()
    out = None
    for q in ("the and", "tiono", "zzzznothing"):
        own = R.ladder(post, q).select(F.lit(q).alias("query"), "tier").distinct()
        out = own if out is None else out.unionByName(own)
    return out


def _batch(s, d):
    m = messages(s, d).select("session_id", "role", "ts", "text")
    mark = lambda df: df.select(F.xxhash64("session_id", "role", "ts", "text").alias("mark"))
    return V.imported(m.unionByName(m), mark(m.where("session_id % 3 = 0")), mark(m.where("session_id % 5 = 0"))).drop("mark")


_PLAN = "# Plan\n- look at the onand\n* then the ther and one\n3. done\ntext"
_STEPS = {"a": ["the", "and", "one"], "b": ["der", "und"]}
_RECORDS = [
    (1, 0, "user", "the build breaks", "2026-01-01 10:00:00"), (1, 1, "tool-output", "bash:1: command not found: timeout\nmore", "2026-01-01 10:01:00"), (1, 2, "command", "$ brew install coreutils-timeout", "2026-01-01 10:02:00"), (1, 3, "assistant", "The fix was coreutils. It held.", "2026-01-01 10:03:00"),
    (1, 4, "edit", "/w/app/a.py\nold text", "2026-01-01 10:04:00"), (2, 0, "tool-output", "psql: error: Connection refused by the server", "2026-01-02 10:00:00"), (2, 1, "command", "$ make restart", "2026-01-02 10:01:00"), (2, 2, "tool-output", "psql: error: Connection refused by the server", "2026-01-02 10:02:00"),
    (3, 0, "tool-output", "psql: error: Connection refused by the server", "2026-01-03 10:00:00"), (3, 1, "command", "$ service db start", "2026-01-03 10:01:00"), (3, 2, "assistant", "We reverted the change after that, it was wrong", "2026-01-03 10:02:00"), (3, 3, "edit", "/w/app/a.py\nother text", "2026-01-03 10:03:00"), (3, 4, "edit", "b.py\nx", "2026-01-03 10:04:00"),
]


def records(s, d):
    return s.createDataFrame(_RECORDS, "session_id long, seq long, role string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def _notes(s, d):
    """Orders as a log of notes: customers' priorities are projects, order states their states."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("state"), F.col("o_orderpriority").alias("project"), F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("text"))


_NOTES = "(SELECT o_custkey AS key, o_orderkey AS seq, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'rejected' END AS state, o_orderpriority AS project, 'note ' || o_orderkey AS text FROM orders)"
_FILES = [("/a/x", 10, 1, "h1"), ("/a/y", 30, 2, "h2"), ("/a/z", 5, 1, "h3"), ("/b/n", 1, 1, "h4"), ("/a/r", 30, 9, "hX")]
_MANIFEST = [("/a/x", 10, 1, "h1"), ("/a/y", 20, 1, "h2"), ("/a/w", 5, 1, "h5"), ("/c/m", 7, 1, "h6"), ("/a/r", 20, 1, "h7")]
_FILE = "path string, size long, mtime long, head string"


def _delivered(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("record"), F.col("event_type").alias("source"), "ts")
    peers = s.createDataFrame([("north",), ("south",)], "peer string")
    return e.where("record % 10 < 4").crossJoin(F.broadcast(peers)).where("peer = 'north' or source != 'click'"), e


_DELIVERED = "(SELECT peer, event_id AS record, event_type AS source, ts FROM events, (VALUES ('north'), ('south')) p(peer) WHERE event_id % 10 < 4 AND (peer = 'north' OR event_type != 'click'))"
_RULES = {"src1": False, "*": True}


def _fused_page(s, d):
    return V.page(S.bm25(table(s, d, "documents"), TERMS, "doc_id"), "doc_id", 5, 10).select("doc_id", "score", "total", "capped")


def _touches(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.concat(F.lit("/w/p"), (F.col("l_partkey") % 50).cast("string")).alias("path"))


_TOUCHES = "(SELECT l_suppkey AS session_id, '/w/p' || (l_partkey % 50) AS path FROM lineitem)"

ALL = {
    "r31_postings_lookup": (_lookup, f"SELECT token, session_id, seq FROM {_INDEX} WHERE token IN ('the', 'und', '2024-01')"),
    "r02_exact_tier": (_tier(R.exact, "the and"), _holding_sql({k: [k] for k in query_keys("the and")})),
    "r03_close_tier": (_tier(R.close, "onan ther"), f"SELECT session_id, count(*) AS messages FROM (SELECT session_id, seq FROM {_INDEX} JOIN (VALUES ('onan'), ('ther')) w(term) ON contains(token, term) GROUP BY ALL HAVING count(DISTINCT term) = 2) GROUP BY session_id"),
    "r05_stem_tier": (_stemmed, _holding_sql({t: word_forms(t) for t in _STEM})),
    "r07_neighbour_tier": (lambda s, d: R.by_neighbours(s.createDataFrame([(f"s{i}", 0, t) for i in range(6) for t in (["cache", "redis", "other" + str(i)] if i < 3 else ["filler" + str(i), "pad"])] + [("s9", 0, "redis"), ("s9", 0, "timeout"), ("s8", 0, "timeout"), ("s8", 0, "none")], "session_id string, seq long, token string"), "cache timeout"), rows_sql(["session_id", "messages"], [("s9", 1)])),
    "r06_spelling_tier": (lambda s, d: R.spelled(s.createDataFrame([("s1", 0, "migration"), ("s1", 0, "failed"), ("s2", 0, "migrations"), ("s2", 0, "failed"), ("s3", 0, "failed")], "session_id string, seq long, token string"), "migratoin failde"), rows_sql(["session_id", "messages"], [("s1", 1), ("s2", 1)])),
    "r01_ladder": (_ladder, rows_sql(["query", "tier"], [("the and", "exact"), ("tiono", "close")])),
    "r29_term_counts": (lambda s, d: R.term_counts(R.indexed(messages(s, d)), "onand erstst zzz"), f"SELECT term, coalesce(n, 0) AS sessions FROM (VALUES ('onand'), ('erstst'), ('zzz')) w(term) LEFT JOIN (SELECT token, count(DISTINCT session_id) AS n FROM {_INDEX} GROUP BY token) ON token = term"),
    "r18_page": (_fused_page, f"WITH r AS ({_bm25_sql('documents', 'doc_id', TERMS, 'false')}) SELECT doc_id, score, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 15 AS capped FROM r ORDER BY score DESC, doc_id LIMIT 5 OFFSET 10"),
    "s39_envelope": (lambda s, d: V.envelope(s.createDataFrame([(1, 2.5, 3, True), (2, 1.5, 3, True)], "id long, score double, total long, capped boolean"), "exact", "id"), rows_sql(["envelope"], [('{"schema_version":2,"tier":"exact","total":3,"capped":true,"hits":[{"id":1,"score":2.5},{"id":2,"score":1.5}]}',)])),
    "p01_session_filter": (lambda s, d: V.matching_sessions(metas(s, d), "en", "SRC1", "local", F.lit("2024-03-01").cast("timestamp")).select("session_id"), f"SELECT session_id FROM {_META} WHERE harness = 'en' AND contains(lower(project), 'src1') AND machine IS NULL AND updated >= TIMESTAMP '2024-03-01'"),
    "p05_verified": (lambda s, d: V.verified(s.createDataFrame([(0, "the cafe\u0301 is open"), (1, "the caf\u00e9"), (2, "數據庫 café"), (3, "cafe")], "id long, text string"), ["caf\u00e9"], ("數據庫", "数据库")).select("id"), rows_sql(["id"], [(0,), (1,), (2,)])),
    "p05_folded": (lambda s, d: V.verified(s.createDataFrame([(0, "這個數據庫"), (1, "这个数据库"), (2, "x")], "id long, text string"), ["数据库"], ("數據庫", "数据库")).select("id"), rows_sql(["id"], [(0,), (1,)])),
    "p19_spoken": (lambda s, d: V.spoken_of(messages(s, d), ["onand", "der"]), rf"SELECT DISTINCT session_id FROM {_MESSAGES} WHERE role IN ('user', 'assistant') AND (regexp_matches(' ' || lower(text), '[^\p{{L}}\p{{Nd}}]onand') OR regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{Nd}}]der[^\p{{L}}\p{{Nd}}]'))"),
    "p20_session_spans": (lambda s, d: V.session_spans(messages(s, d)), f"SELECT session_id, min(ts) AS started, max(ts) AS updated, count(*) AS messages FROM {_MESSAGES} GROUP BY session_id"),
    "s30_role_scan": (lambda s, d: V.of_role(messages(s, d), metas(s, d), "system").select("session_id", "seq", "harness"), f"SELECT session_id, seq, harness FROM {_MESSAGES} JOIN {_META} USING (session_id) WHERE role = 'system'"),
    "s36_whole_files": (lambda s, d: V.whole_files(table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), "event_id", (F.col("event_id") % 97 == 0).alias("broken"))).groupBy("path").agg(F.count("*").alias("n")), "SELECT user_id::VARCHAR AS path, count(*) AS n FROM events GROUP BY path HAVING NOT bool_or(event_id % 97 = 0)"),
    "s37_unembedded": (lambda s, d: V.unembedded(messages(s, d), messages(s, d).where("session_id % 2 = 0").select(F.xxhash64("text").alias("mark"))).select("session_id", "seq"), f"SELECT session_id, seq FROM {_MESSAGES} WHERE text NOT IN (SELECT text FROM {_MESSAGES} WHERE session_id % 2 = 0)"),
    "j04_late_read": (lambda s, d: V.late_read(messages(s, d), R.indexed(messages(s, d)).where("token = 'the'")).select("session_id", "seq", "role"), f"SELECT session_id, seq, role FROM {_MESSAGES} WHERE (session_id, seq) IN (SELECT (session_id, seq) FROM {_INDEX} WHERE token = 'the')"),
    "j05_in_order": (lambda s, d: V.in_order(s.createDataFrame([(3, 1), (1, 2)], "session_id long, place long"), messages(s, d)).select("place", "session_id", "seq", "role"), f"SELECT place, session_id, seq, role FROM {_MESSAGES} JOIN (VALUES (3, 1), (1, 2)) f(session_id, place) USING (session_id)"),
    "j07_import": (_batch, f"SELECT DISTINCT session_id, role, ts, text FROM {_MESSAGES} WHERE session_id % 3 != 0 AND session_id % 5 != 0"),
    "j13_around_errors": (lambda s, d: V.around_errors(records(s, d), F.exists(F.split("text", "\n"), lambda x: L.friction(x).isNotNull()), 1), rows_sql(["session_id", "seq", "hit"], [(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, True), (2, 1, False), (2, 2, True), (3, 0, True), (3, 1, False)])),
    "w04_reply_window": (lambda s, d: V.reply_window(messages(s, d), F.contains(F.lower("text"), F.lit("tion"))), f"SELECT session_id, seq FROM (SELECT *, bool_or(contains(lower(text), 'tion')) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS asked FROM {_MESSAGES}) WHERE role = 'assistant' AND asked"),
    "j14_plan_steps": (lambda s, d: V.steps_meet(messages(s, d), _STEPS), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS step, session_id, max({' + '.join(rf'''regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{Nd}}]{t}[^\p{{L}}\p{{Nd}}]')::INT''' for t in ts)})::BIGINT AS n FROM {_MESSAGES} GROUP BY session_id" for k, ts in _STEPS.items()) + ") WHERE n >= 2"),
    "d13_plan": (lambda s, d: s.createDataFrame([(i, x) for i, x in enumerate(V.plan_steps(_PLAN))], "id long, step string"), rows_sql(["id", "step"], [(0, "look at the onand"), (1, "then the ther and one"), (2, "done")])),
    "j17_notes_first": (lambda s, d: V.notes_first(s.createDataFrame([("a", 1), ("b", 2), ("note-b", 3), ("note-z", 4), ("c", 5)], "session_id string, place long"), s.createDataFrame([("note-b", "b"), ("note-z", "z")], "session_id string, source string")), rows_sql(["session_id", "place"], [("a", 1), ("note-b", 2), ("b", 3), ("note-z", 4), ("c", 5)])),
    "j18_conflicts": (lambda s, d: V.conflicting(s.createDataFrame([("p", "k1", ["db", "x"], "accepted"), ("p", "k2", ["db"], "accepted"), ("p", "k3", ["db"], "rejected"), ("q", "k4", ["db"], "accepted"), ("p", "k5", ["y"], "accepted")], "project string, key string, tags array<string>, state string")), rows_sql(["project", "first", "second"], [("p", "k1", "k2")])),
    "r21_semantic": (lambda s, d: S.semantic(table(s, d, "embeddings").withColumn("session", F.col("vec_id") % 50), table(s, d, "embeddings").where("vec_id in (0, 1)").agg(*(F.avg(F.get("embedding", F.lit(i))).alias(f"x{i}") for i in range(64))).select(F.array(*(f"x{i}" for i in range(64))).alias("embedding")), "session"), """WITH q AS (SELECT list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) / 2) AS q FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1)
        SELECT vec_id % 50 AS session, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE round(list_cosine_similarity(embedding::DOUBLE[], q), 6) >= 0.55 QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, vec_id) = 1 ORDER BY score DESC, session LIMIT 10"""),
    "k01_newest_first": (lambda s, d: V.newest_first(metas(s, d)), f"SELECT session_id, row_number() OVER (ORDER BY updated DESC, harness, session_id) AS place FROM {_META}"),
    "k02_recall_order": (lambda s, d: V.recall_order(metas(s, d).withColumn("task", F.col("session_id") % 3), F.lit(_NOW).cast("timestamp")).select("session_id"), f"SELECT session_id FROM {_META} ORDER BY session_id % 3 DESC, updated >= TIMESTAMP '{_NOW}' - INTERVAL 90 DAY DESC, updated DESC, session_id LIMIT 12"),
    "k04_best_snippets": (lambda s, d: V.best_snippets(messages(s, d).select("session_id", "seq", F.pmod(F.char_length("text"), F.lit(5)).alias("window"), F.pmod(F.char_length("text"), F.lit(7)).alias("count"))), f"SELECT session_id, seq, place FROM (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY length(text) % 5 > 0 DESC, length(text) % 5, length(text) % 7 DESC, seq) AS place FROM {_MESSAGES}) WHERE place <= 3"),
    "r26_elided_id": (lambda s, d: V.by_id(metas(s, d), "1…7").select("session_id"), f"SELECT session_id FROM {_META} WHERE starts_with(session_id::VARCHAR, '1') AND ends_with(session_id::VARCHAR, '7')"),
    "r26_composite_id": (lambda s, d: V.by_id(metas(s, d), "fr:1").select("session_id"), f"SELECT session_id FROM {_META} WHERE harness = 'fr' AND starts_with(session_id::VARCHAR, '1')"),
    "a04_filtered_stats": (lambda s, d: V.filtered_stats(messages(s, d), metas(s, d), "user", harness="en"), f"SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages FROM {_MESSAGES} JOIN {_META} USING (session_id) WHERE role = 'user' AND harness = 'en'"),
    "a11_friction_report": (lambda s, d: V.friction_report(usage(s, d).where("kind = 'error'").withColumn("harness", F.concat(F.lit("h"), (F.col("session_id") % 3).cast("string")))), f"SELECT signature, count(DISTINCT session_id) AS sessions, max(ts) AS last, string_agg(DISTINCT 'h' || session_id % 3, ',' ORDER BY 'h' || session_id % 3) AS harnesses FROM {_USAGE} WHERE kind = 'error' GROUP BY signature HAVING sessions >= 3 ORDER BY sessions DESC, last DESC, signature LIMIT 10"),
    "a15_command_uses": (lambda s, d: V.command_uses(table(s, d, "documents").select(F.col("lang").alias("command"), F.col("source").alias("project"), F.timestamp_seconds("doc_id").alias("ts")), "EN", allowed(F.col("project"), _RULES)), "SELECT source AS project, count(*) AS runs, max(to_timestamp(doc_id)::TIMESTAMP) AS last FROM documents WHERE lang = 'en' AND source != 'src1' GROUP BY source"),
    "a16_mined_fixes": (lambda s, d: M.mined_fixes(records(s, d)).select("error", "command", "candidate"), rows_sql(["error", "command", "candidate"], [("command not found: timeout", "$ brew install coreutils-timeout", False), ("psql: error: Connection refused by the server", "$ service db start", True)])),
    "a17_fix_lookup": (lambda s, d: M.fixes_for(M.mined_fixes(records(s, d)), "noise\nzsh:7: command not found: timeout\n").select("error", "command"), rows_sql(["error", "command"], [("command not found: timeout", "$ brew install coreutils-timeout")])),
    "a21_gave_up": (lambda s, d: V.gave_up(records(s, d)), rows_sql(["session_id", "gave_up"], [(1, False), (2, False), (3, True)])),
    "a28_spans": (lambda s, d: V.spans(records(s, d)), rows_sql(["spans", "files"], [(3, 2)])),
    "d07_restorable": (lambda s, d: V.restorable(records(s, d), "app/a.py").select("session_id", "seq", "span"), rows_sql(["session_id", "seq", "span"], [(3, 3, "other text"), (1, 4, "old text")])),
    "a30_task_scores": (lambda s, d: V.task_scores(_touches(s, d), ["src/p1", "p2", "x/p3"]), f"SELECT session_id, count(DISTINCT path) AS task FROM {_TOUCHES} WHERE path IN ('/w/p1', '/w/p2', '/w/p3') GROUP BY session_id ORDER BY task DESC, session_id LIMIT 12"),
    "d03_conclusions": (lambda s, d: V.conclusions(records(s, d)), rows_sql(["session_id", "seq", "line"], [(1, 3, "The fix was coreutils. It held.")])),
    "d02_digest": (lambda s, d: V.digest(messages(s, d), ["the", "der", "and"]), rf"""WITH m AS (SELECT *, {' + '.join(rf"regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{Nd}}]{t}[^\p{{L}}\p{{Nd}}]')::INT" for t in ('the', 'der', 'and'))} AS n FROM {_MESSAGES}),
        q AS (SELECT session_id, seq AS asked FROM m WHERE role = 'user' AND n > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, seq) = 1),
        t AS (SELECT session_id, seq FROM m JOIN q USING (session_id) WHERE role = 'assistant' AND n > 0 AND seq > asked QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 3)
        SELECT session_id, asked, coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM t WHERE t.session_id = q.session_id), '') AS answers FROM q"""),
    "d04_context": (lambda s, d: V.context_document(messages(s, d), F.contains("text", F.lit("onand")), 2000), f"""WITH m AS (SELECT *, role = 'user' OR contains(text, 'onand') AS own FROM {_MESSAGES}), k AS (SELECT *, lag(own) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM m),
        b AS (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE own OR (role = 'assistant' AND prev))
        SELECT session_id, count(*) AS parts, strlen(string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY seq))::BIGINT AS bytes FROM b WHERE before < 2000 GROUP BY session_id"""),
    "d06_blame": (lambda s, d: V.blame(s.createDataFrame([(1, "see /w/app/src/main.go and main.go"), (2, "main.go"), (3, "domain.go"), (2, "app/src/main.go again")], "session_id long, text string"), s.createDataFrame([(1, "/w/app", "2026-01-01 00:00:00"), (2, "other", "2026-01-02 00:00:00"), (3, "x", "2026-01-02 00:00:00")], "session_id long, project string, updated string").withColumn("updated", F.col("updated").cast("timestamp")), "/w/app/src/main.go", path_forms("/w/app/src/main.go"), F.lit("2026-01-03 00:00:00").cast("timestamp")), rows_sql(["session_id", "mentions", "score"], [(1, 2, round(2 * (1 + 2.25) * 1.35 / 3, 6)), (2, 2, round(2 * (1 + 1.75) / 2, 6))])),
    "d10_conventions": (lambda s, d: V.conventions(_notes(s, d), ["1-URGENT", "2-HIGH"]), f"""WITH l AS (SELECT key, arg_max((state, project, text, ts), (ts, seq)) AS n FROM {_NOTES} GROUP BY key), r AS (SELECT key, n[3] AS text, n[4] AS ts FROM l WHERE n[1] = 'accepted' AND n[2] IN ('1-URGENT', '2-HIGH') ORDER BY ts DESC, key LIMIT 5)
        SELECT key, text FROM (SELECT *, sum(strlen(text)) OVER (ORDER BY ts DESC, key) AS upto FROM r) WHERE upto <= 600"""),
    "d12_moved": (lambda s, d: V.moved_since(_touches(s, d), s.createDataFrame([("/w/p1", "2024-03-01"), ("/w/p2", "2023-01-01"), ("/w/p3", "2025-01-01")], "path string, changed string").withColumn("changed", F.col("changed").cast("timestamp")), metas(s, d)), f"SELECT session_id, count(DISTINCT path) AS moved FROM {_TOUCHES} JOIN (VALUES ('/w/p1', TIMESTAMP '2024-03-01'), ('/w/p2', TIMESTAMP '2023-01-01'), ('/w/p3', TIMESTAMP '2025-01-01')) c(path, changed) USING (path) JOIN {_META} USING (session_id) WHERE changed > updated GROUP BY session_id"),
    "d15_focus": (lambda s, d: V.focused(messages(s, d), F.contains(F.lower("text"), F.lit("onand")), 6, 1), f"SELECT session_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, bool_or(contains(lower(text), 'onand')) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {_MESSAGES}) WHERE n <= 6 OR near QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 6"),
    "d14_session_start": (lambda s, d: V.session_start(messages(s, d), metas(s, d).where("session_id < 100"), 3, 4), f"SELECT project, session_id, count(*) AS turns, max(seq) AS upto FROM (SELECT * FROM {_MESSAGES} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4) JOIN (SELECT session_id, project FROM {_META} WHERE session_id < 100 QUALIFY row_number() OVER (PARTITION BY project ORDER BY updated DESC, session_id) <= 3) USING (session_id) GROUP BY ALL"),
    "d17_labels": (lambda s, d: V.topic_label(metas(s, d)), rf"SELECT session_id, CASE WHEN length(t) <= 40 THEN t ELSE left(t, 39) || '…' END AS label FROM (SELECT session_id, regexp_replace(title, '\s+', ' ', 'g') AS t FROM {_META})"),
    "d01_auto_recall": (lambda s, d: V.auto_recall(metas(s, d).where("session_id < 40").select("session_id", F.col("session_id").alias("place")), table(s, d, "documents").select(F.col("doc_id").alias("session_id"), tokens(F.col("text")).alias("w")), 6), f"""WITH RECURSIVE w AS (SELECT doc_id AS session_id, row_number() OVER (ORDER BY doc_id) AS i, {_TOKENS} AS w FROM documents WHERE doc_id < 40 AND len({_TOKENS}) >= 3),
        k(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.i, CASE WHEN len(kept) < 6 AND NOT EXISTS (SELECT 1 FROM w b WHERE list_contains(kept, b.session_id) AND len(list_intersect(b.w, w.w)) / len(list_distinct(list_concat(b.w, w.w))) >= 0.8) THEN list_append(kept, w.session_id) ELSE kept END FROM k JOIN w ON w.i = k.i + 1)
        SELECT x AS session_id, x AS place FROM (SELECT unnest(kept) AS x FROM k ORDER BY i DESC LIMIT 1000) GROUP BY x"""),
    "d16_due": (lambda s, d: V.due(usage(s, d).select(F.col("session_id").alias("agent"), "ts"), F.lit("2024-01-30 20:00:00").cast("timestamp"), 600), f"SELECT session_id AS agent FROM {_USAGE} GROUP BY agent HAVING max(ts) + INTERVAL 600 MINUTE <= TIMESTAMP '2024-01-30 20:00:00'"),
    "x11_not_yet_shown": (lambda s, d: V.not_yet_shown(usage(s, d).select(F.col("session_id").alias("agent"), F.col("signature").alias("session_id")).distinct(), usage(s, d).select(F.col("session_id").alias("agent"), F.col("signature").alias("session_id"), "ts")), f"WITH u AS (SELECT session_id AS agent, signature AS session_id, ts FROM {_USAGE}) SELECT DISTINCT agent, session_id FROM u WHERE (agent, session_id) NOT IN (SELECT (agent, session_id) FROM (FROM u QUALIFY row_number() OVER (PARTITION BY agent ORDER BY ts DESC, session_id) <= 10))"),
    "x01_changed_files": (lambda s, d: V.changed_files(s.createDataFrame(_FILES, _FILE), s.createDataFrame(_MANIFEST, _FILE)), rows_sql(["path", "what"], [("/a/x", "same"), ("/a/y", "grown"), ("/a/z", "new"), ("/b/n", "new"), ("/a/w", "gone"), ("/c/m", "missing"), ("/a/r", "changed")])),
    "x03_updated_index": (lambda s, d: V.updated_index(s.createDataFrame([("/a", 1), ("/b", 2), (None, 3)], "path string, n long"), s.createDataFrame([("/a", 9), ("/c", 8)], "path string, n long"), s.createDataFrame([("/b",)], "path string")), rows_sql(["path", "n"], [("/a", 9), ("/c", 8), (None, 3)])),
    "x06_marks": (lambda s, d: V.marks_after(_delivered(s, d)[0]), f"SELECT peer, source, ts AS mark, count(*) AS at_mark FROM {_DELIVERED} WHERE (peer, source, ts) IN (SELECT (peer, source, max(ts)) FROM {_DELIVERED} GROUP BY peer, source) GROUP BY ALL"),
    "x06_to_deliver": (lambda s, d: V.to_deliver(_delivered(s, d)[1], _delivered(s, d)[0]), f"SELECT p.peer, e.event_id AS record FROM events e, (VALUES ('north'), ('south')) p(peer) LEFT JOIN (SELECT peer, source, max(ts) AS mark FROM {_DELIVERED} GROUP BY ALL) m ON m.peer = p.peer AND m.source = e.event_type WHERE (mark IS NULL OR e.ts >= mark) AND (p.peer, e.event_id) NOT IN (SELECT (peer, record) FROM {_DELIVERED})"),
    "x10_rotation": (lambda s, d: V.rotated(usage(s, d), F.lit("2024-01-30").cast("timestamp")).select("event_id"), f"SELECT event_id FROM {_USAGE} WHERE ts >= TIMESTAMP '2024-01-16'"),
    "x13_forgotten": (lambda s, d: V.forgotten(metas(s, d), s.createDataFrame([("id", "12"), ("project", "src3")], "kind string, value string")), f"SELECT session_id FROM {_META} WHERE starts_with(session_id::VARCHAR, '12') OR project = 'src3'"),
    "x14_merged_fixes": (lambda s, d: V.merged_fixes(s.createDataFrame([(1, "e", "c", 1), (2, "e", "d", 2), (3, "f", "c", 3)], "session_id long, error string, command string, ts long"), s.createDataFrame([(2, "e", "x", 9)], "session_id long, error string, command string, ts long"), s.createDataFrame([(3,)], "session_id long")), rows_sql(["error", "command", "ts"], [("e", "c", 1), ("e", "x", 9)])),
    "x15_rebucketed": (lambda s, d: V.rebucketed(usage(s, d).select(F.col("kind").alias("project"), F.col("ts").cast("timestamp").alias("ts")), "Asia/Tokyo"), f"SELECT kind AS project, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS notes FROM {_USAGE} GROUP BY ALL"),
    "u06_merged_counts": (lambda s, d: V.merged_counts(*(_touches(s, d).where(f"session_id % 2 = {k} or path like '%1'").groupBy("session_id", "path").agg(F.count("*").alias("n")) for k in (0, 1)), "session_id", "path"), f"SELECT * FROM (SELECT session_id, path, (count(*) * CASE WHEN path LIKE '%1' THEN 2 ELSE 1 END)::BIGINT AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) * CASE WHEN path LIKE '%1' THEN 2 ELSE 1 END DESC, path) AS place FROM {_TOUCHES} GROUP BY session_id, path) WHERE place <= 6"),
    "a39_log_tail": (lambda s, d: V.log_tail(usage(s, d)).select("event_id", "kind"), f"SELECT event_id, kind FROM {_USAGE} ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "a35_brief": (lambda s, d: V.brief(usage(s, d), F.lit("2024-01-20 10:00:00").cast("timestamp")), f"SELECT kind, count(DISTINCT session_id) AS sessions, count(*) AS n, round(sum(bytes), 4) AS bytes FROM {_USAGE} WHERE ts::DATE = DATE '2024-01-20' GROUP BY kind"),
    "x21_to_fetch": (lambda s, d: V.to_fetch(usage(s, d).select("event_id", F.col("kind").alias("source"), F.to_date("ts").alias("day")), s.createDataFrame([("error", "2024-01-20", 500), ("click", "2024-01-29", 1)], "source string, mark string, mark_id long").withColumn("mark", F.col("mark").cast("date")), "source", "day", "event_id").select("event_id"), f"SELECT event_id FROM (SELECT *, ts::DATE AS day FROM {_USAGE}) LEFT JOIN (VALUES ('error', DATE '2024-01-20', 500), ('click', DATE '2024-01-29', 1)) m(kind, mark, mark_id) USING (kind) WHERE mark IS NULL OR day > mark OR (day = mark AND event_id > mark_id)"),
    "x22_rewritten_notes": (lambda s, d: V.rewritten_notes(_notes(s, d), s.createDataFrame([(1,), (2,)], "key long"), s.createDataFrame([(4, "T")], "key long, title string")).where("key < 10").select("key", "seq", "title"), f"SELECT key, seq, CASE WHEN key = 4 THEN 'T' END AS title FROM {_NOTES} WHERE key NOT IN (1, 2) AND key < 10"),
    "r19_weighted_hits": (lambda s, d: V.weighted_hits(messages(s, d), ["the", "onand", "erst"], 100), f"""WITH m AS (SELECT session_id, seq, contains(lower(text), 'the') AS a, contains(lower(text), 'onand') AS b, contains(lower(text), 'erst') AS c FROM {_MESSAGES}), d AS (SELECT count(DISTINCT session_id) FILTER (a) AS x, count(DISTINCT session_id) FILTER (b) AS y, count(DISTINCT session_id) FILTER (c) AS z FROM m),
        w AS (SELECT session_id, seq, round(CASE WHEN a THEN 0.2 + ln(101 / (x + 1)) ELSE 0 END + CASE WHEN b THEN 0.2 + ln(101 / (y + 1)) ELSE 0 END + CASE WHEN c THEN 0.2 + ln(101 / (z + 1)) ELSE 0 END, 6) AS weight FROM m, d)
        SELECT session_id, seq, weight FROM w WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, seq) = 1"""),
    "d09_file_history": (lambda s, d: V.file_history(_touches(s, d), "w/p1"), f"SELECT count(DISTINCT session_id) AS sessions FROM {_TOUCHES} WHERE path = '/w/p1' HAVING sessions >= 5"),
}
