"""Named queries over the archive, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining as M
from ..operators import search as S
from ..sources.tables import messages, notes, table, usage
from ..streaming.usage import tumbling

TERMS = ["the", "erstst", "onand"]
_MESSAGES = "(SELECT conv_id AS session_id, turn AS seq, role, text, TIMESTAMP '2024-01-01' + to_days(conv_id::INT) + to_minutes(turn) AS ts FROM conversations)"
_USAGE = "(SELECT event_id, user_id AS session_id, event_type AS kind, value AS bytes, ts, (props->>'$.k')::BIGINT AS signature FROM events)"
_TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+')), lambda t: strlen(t) >= 2)"


def _rank(df, key):
    return df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("place"))


def _imported_twice(s, d):
    """All messages, all of them again, and those of some sessions a day later."""
    m = messages(s, d)
    later = m.where("session_id % 2 = 0").withColumn("seq", F.col("seq") + 200).withColumn("ts", F.timestamp_add("DAY", F.lit(1), F.col("ts")))
    return M.deduplicated(m.unionByName(m.withColumn("seq", F.col("seq") + 100)).unionByName(later))


def _fused(s, d):
    m = messages(s, d)
    a, b = (S.top(S.bm25(m, [t], "session_id"), 50, "session_id") for t in ("the", "and"))
    return S.fused(_rank(a, "session_id"), _rank(b, "session_id"), "session_id")


def _recall(s, d):
    docs, bench = table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark")
    post = S.postings(docs, "doc_id")
    asked = bench.select("item_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    # the 12 rarest tokens of each item, so that common ones don't join with most of the table
    df = post.join(asked.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "token"))
    rare = asked.join(df, "token").withColumn("nth", nth).where("nth <= 12").select("item_id", "token")
    hits = post.join(rare, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    top = hits.withColumn("rank", rank).where("rank <= 10").join(bench.withColumnRenamed("text", "passage"), "item_id").join(docs, "doc_id")
    found = bench.select("item_id").join(top.groupBy("item_id").agg(F.min(F.when(F.contains("text", F.col("passage")), F.col("rank"))).alias("first")), "item_id", "left")
    return found.agg(F.count("*").alias("items"), F.count_if(F.col("first") == 1).alias("hit_1"), F.count_if(F.col("first") <= 5).alias("hit_5"), F.count_if(F.col("first") <= 10).alias("hit_10"), F.round(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"))


def _bm25_sql(source, key, terms, user):
    tf = "".join(f", sum(len(list_filter(w, lambda x: x = '{t}'))) AS tf{i}, sum(CASE WHEN {user} THEN len(list_filter(w, lambda x: x = '{t}')) ELSE 0 END) AS ut{i}" for i, t in enumerate(terms))
    n = range(len(terms))
    return rf"""WITH o AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_-]+') AS w FROM {source}),
        p AS (SELECT {key}, floor(sqrt((sum(len(w)) * sum(CASE WHEN list_has_any(w, {terms}) THEN len(w) ELSE 0 END))::DOUBLE)) AS len{tf} FROM o GROUP BY {key}), q AS (SELECT * FROM p WHERE {" + ".join(f"tf{i}" for i in n)} > 0),
        c AS (SELECT count(*) AS n, avg(len) AS avg{"".join(f", count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)} FROM q)
        SELECT {key}, round({" + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * (tf{i} * 2.2::DOUBLE + ut{i} * 2.2::DOUBLE * 0.3::DOUBLE) / (tf{i} + (len / avg * 0.75::DOUBLE + 0.25::DOUBLE) * 1.2::DOUBLE)" for i in n)}, 9) AS score FROM q, c"""


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = f"list_transform(string_split({_TRIM.format('text')}, chr(10)), lambda x: {_TRIM.format('x')})"
_DUMP = f"(len({_LINES}) >= 8 AND len(list_distinct({_LINES})) / len({_LINES}) < 0.35)"
#: An aggregate: whether half of the long texts are dumps.
PASTED = f"(count(*) FILTER (len({_LINES}) >= 8) > 0 AND 2 * count(*) FILTER ({_DUMP}) >= count(*) FILTER (len({_LINES}) >= 8))"

#: By name: the query, and its SQL.
ALL = {
    "stats_overview": (lambda s, d: M.overview(messages(s, d)), f"SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages, min(ts) AS oldest, max(ts) AS newest FROM {_MESSAGES}"),
    "tokenize_distinct": (lambda s, d: S.postings(table(s, d, "documents"), "doc_id"), f"SELECT doc_id, unnest({_TOKENS}) AS token FROM documents"),
    "token_df_catalog": (lambda s, d: S.token_catalog(messages(s, d), "session_id"), f"SELECT token, count(*) AS sessions, sum(least(n, 25))::BIGINT AS units FROM (SELECT token, session_id, count(*) AS n FROM (SELECT session_id, unnest({_TOKENS}) AS token FROM {_MESSAGES}) GROUP BY ALL) GROUP BY token"),
    "and_search": (lambda s, d: S.containing(table(s, d, "documents"), ["tion", "erst"], ["the an"]).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'erst') AND contains(lower(text), 'the an')"),
    "regex_search": (lambda s, d: S.matching(table(s, d, "documents"), r"licensed under \w+").select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under \w+')"),
    "bm25_topk": (lambda s, d: S.top(S.bm25(table(s, d, "documents"), TERMS, "doc_id"), 15, "doc_id"), _bm25_sql("documents", "doc_id", TERMS, "false") + " ORDER BY score DESC, doc_id LIMIT 15"),
    "bm25_user_boost": (lambda s, d: S.bm25(messages(s, d), TERMS, "session_id", is_user=F.col("role") == "user"), _bm25_sql(_MESSAGES, "session_id", TERMS, "role = 'user'")),
    "rrf_fusion": (_fused, "WITH " + ", ".join(f"{a} AS (SELECT session_id, row_number() OVER (ORDER BY score DESC, session_id) AS place FROM ({_bm25_sql(_MESSAGES, 'session_id', [t], 'false')} ORDER BY score DESC, session_id LIMIT 50))" for a, t in (("a", "the"), ("b", "and"))) + " SELECT session_id, round(coalesce(1 / (a.place + 60), 0) + coalesce(1 / (b.place + 60), 0), 9) AS score FROM a FULL JOIN b USING (session_id)"),
    "per_session_sample": (lambda s, d: S.sampled_postings(S.postings(table(s, d, "documents"), "doc_id"), "doc_id", "token", 64), f"WITH p AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM p) SELECT doc_id, token FROM r WHERE total <= 64 OR (i * 64) // total != ((i + 1) * 64) // total"),
    "cooccur_neighbors": (lambda s, d: S.neighbours_of_tokens(messages(s, d), "session_id"), f"""WITH p AS (SELECT DISTINCT session_id, token FROM (SELECT session_id, unnest({_TOKENS}) AS token FROM {_MESSAGES}) WHERE strlen(token) >= 4),
        f AS (SELECT token, count(*) AS df FROM p GROUP BY token HAVING count(*) BETWEEN 3 AND greatest(8, (SELECT count(DISTINCT conv_id) FROM conversations) // 4)),
        r AS (SELECT session_id, token FROM p JOIN f USING (token) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY df, token) <= 64),
        c AS (SELECT a.token, b.token AS neighbour, count(*) AS sessions FROM r a JOIN r b USING (session_id) WHERE a.token != b.token GROUP BY ALL HAVING count(*) >= 3)
        SELECT *, row_number() OVER (PARTITION BY token ORDER BY sessions DESC, neighbour) AS rank FROM c QUALIFY rank <= 6"""),
    "cosine_topk": (lambda s, d: S.cosine_to(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id = 0"), 10), "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT 10"),
    "session_stats": (lambda s, d: M.session_stats(messages(s, d)), rf"SELECT session_id, count(*) AS messages, sum(len(regexp_extract_all(text, '[^ \n\t]+')))::BIGINT AS words, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 60 AS minutes FROM {_MESSAGES} GROUP BY session_id"),
    "monthly_series": (lambda s, d: M.monthly(table(s, d, "orders"), "o_orderdate", "1995-01-01", 12), "SELECT strftime(m, '%Y-%m') AS month, count(o_orderkey) AS n FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-01', INTERVAL 1 MONTH) g(m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m"),
    "heatmap": (lambda s, d: M.heatmap(usage(s, d), "ts", "2023-12-31"), f"SELECT (date_diff('day', DATE '2023-12-31', ts::DATE) // 7) AS week, (date_diff('day', DATE '2023-12-31', ts::DATE) % 7) AS weekday, count(*) AS n FROM {_USAGE} WHERE ts::DATE >= DATE '2023-12-31' GROUP BY ALL"),
    "busiest_day": (lambda s, d: M.busiest_day(usage(s, d), "ts"), f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM {_USAGE} GROUP BY day ORDER BY n DESC, day LIMIT 1"),
    "friction_clusters": (lambda s, d: M.recurring(usage(s, d).where("kind = 'error'")), f"SELECT signature, count(DISTINCT session_id) AS sessions, max(ts) AS last FROM {_USAGE} WHERE kind = 'error' GROUP BY signature HAVING count(DISTINCT session_id) >= 3"),
    "fix_pairs": (lambda s, d: M.fixes(usage(s, d)), f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i FROM {_USAGE}),
        f AS (SELECT w.session_id, w.event_id, w.signature, min(x.i) AS fx FROM e w JOIN e x ON x.session_id = w.session_id AND x.i BETWEEN w.i + 1 AND w.i + 10 WHERE w.kind = 'error' AND x.kind = 'click' GROUP BY ALL)
        SELECT f.session_id, f.event_id, f.signature, x.event_id AS fix_id FROM f JOIN e x ON x.session_id = f.session_id AND x.i = f.fx
        WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.session_id = f.session_id AND a.kind = 'error' AND a.signature = f.signature AND a.i BETWEEN f.fx + 1 AND f.fx + 6)"""),
    "files_near_topic": (lambda s, d: M.near_in_time(usage(s, d).where("kind = 'error'"), usage(s, d).where("kind = 'click'")), f"SELECT a.session_id, a.event_id AS left_id, b.event_id AS right_id FROM {_USAGE} a JOIN {_USAGE} b ON a.session_id = b.session_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1200000000 WHERE a.kind = 'error' AND b.kind = 'click'"),
    "lifecycle_latest": (lambda s, d: M.latest_state(notes(s, d)), "SELECT o_custkey AS key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state, count(*) AS n FROM orders GROUP BY o_custkey"),
    "dedupe_import": (_imported_twice, f"SELECT session_id, role, ts, text, min(seq) AS seq FROM (FROM {_MESSAGES} UNION ALL SELECT session_id, seq + 100, role, text, ts FROM {_MESSAGES} UNION ALL SELECT session_id, seq + 200, role, text, ts + to_days(1) FROM {_MESSAGES} WHERE session_id % 2 = 0) GROUP BY ALL"),
    "tombstone_antijoin": (lambda s, d: M.without(messages(s, d), messages(s, d).where("role = 'system'").select("session_id").distinct(), "session_id").select("session_id", "seq"), f"SELECT session_id, seq FROM {_MESSAGES} WHERE session_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"),
    "answer_after": (lambda s, d: M.answers(messages(s, d)), f"SELECT u.session_id, u.seq, min(a.seq) AS answer FROM {_MESSAGES} u JOIN {_MESSAGES} a ON a.session_id = u.session_id AND a.role = 'assistant' AND a.seq > u.seq WHERE u.role = 'user' AND (SELECT count(*) FROM {_MESSAGES} k WHERE k.session_id = u.session_id AND k.seq > u.seq AND k.seq <= a.seq) <= 3 AND NOT EXISTS (SELECT 1 FROM {_MESSAGES} k WHERE k.session_id = u.session_id AND k.role = 'user' AND k.seq > u.seq AND k.seq < a.seq) GROUP BY ALL"),
    "usage_totals": (lambda s, d: M.usage_totals(usage(s, d), "2024-01-28 12:00:00"), f"SELECT kind, count(*) AS n, round(sum(bytes), 4) AS bytes, count(DISTINCT session_id) AS sessions, count(*) FILTER (ts > TIMESTAMP '2024-01-21 12:00:00') AS week, count(*) FILTER (ts > TIMESTAMP '2024-01-27 12:00:00') AS day FROM {_USAGE} WHERE ts <= TIMESTAMP '2024-01-28 12:00:00' GROUP BY kind"),
    "worn_sessions": (lambda s, d: M.worn(usage(s, d)), f"SELECT session_id, count(*) AS recalls FROM {_USAGE} WHERE kind = 'view' GROUP BY session_id HAVING count(*) >= 2"),
    "watermark_export": (lambda s, d: M.export_since(usage(s, d), "2024-01-25 00:00:00", []).select("event_id"), f"SELECT event_id FROM {_USAGE} WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-25'"),
    "tumbling_usage": (lambda s, d: tumbling(usage(s, d)), f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, kind, count(*) AS n, round(sum(bytes), 4) AS bytes FROM {_USAGE} GROUP BY ALL"),
    "paste_detect": (lambda s, d: table(s, d, "documents").groupBy("source").agg(T.mostly_pasted(F.col("text")).alias("pasted"), F.count_if(T.is_pasted(F.col("text"))).alias("dumps")), f"SELECT source, {PASTED} AS pasted, count(*) FILTER ({_DUMP}) AS dumps FROM documents GROUP BY source"),
    "redact_counts": (lambda s, d: table(s, d, "documents").select("doc_id", T.redacted(F.col("text")).alias("text"), F.regexp_count("text", F.lit(T.MAIL)).cast("long").alias("mails")).where("mails > 0 or text like '%[redacted]%'"), rf"""SELECT * FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{T.SECRET}', '\1"[redacted]"', 'g'), '{T.MAIL}', '[mail]', 'g') AS text, len(regexp_extract_all(text, '{T.MAIL}')) AS mails FROM documents) WHERE mails > 0 OR text LIKE '%[redacted]%'"""),
    "page_messages": (lambda s, d: messages(s, d).where("session_id = 3").orderBy("seq").offset(1).limit(2).select("seq", "role", "text"), f"SELECT seq, role, text FROM {_MESSAGES} WHERE session_id = 3 ORDER BY seq LIMIT 2 OFFSET 1"),
    "retrieval_recall_at_k": (_recall, f"""WITH p AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), q AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark),
        c AS (SELECT token, count(*) AS df FROM p GROUP BY token), k AS (SELECT item_id, token FROM q JOIN c USING (token) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, token) <= 12),
        h AS (SELECT item_id, doc_id, count(*) AS shared FROM k JOIN p USING (token) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM h QUALIFY rank <= 10),
        f AS (SELECT item_id, min(rank) FILTER (contains(d.text, b.text)) AS first FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) GROUP BY item_id)
        SELECT count(*) AS items, count(*) FILTER (first = 1) AS hit_1, count(*) FILTER (first <= 5) AS hit_5, count(*) FILTER (first <= 10) AS hit_10, round(sum(coalesce(1 / first, 0)) / count(*), 6) AS mrr FROM benchmark LEFT JOIN f USING (item_id)"""),
}
