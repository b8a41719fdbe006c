"""More named queries over the archive (lookups, history, ranking), each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L_
from ..functions import text as T
from ..functions.language import ASKING
from ..operators import history as H
from ..operators import lookups as L
from ..operators import mining as M
from ..operators import ranking as R
from ..operators import search as S
from ..sources.tables import messages, notes, table, usage
from .queries import PASTED, _MESSAGES, _TOKENS, _USAGE, TERMS, _bm25_sql, _rank

_NOW = "2024-06-01 00:00:00"
_RULES = {"src0": False, "src7": False, "imported": False, "*": True}
_MARKS = [("north", "1-URGENT", "1996-01-01 00:00:00"), ("north", "2-HIGH", "1995-01-01 00:00:00"), ("south", "1-URGENT", "1994-01-01 00:00:00"), ("south", "5-LOW", "1997-01-01 00:00:00")]
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+')"
_FUZZY = ["the", "erst", "tion"]
#: One edit or none, by characters: the library's own distances count bytes.
_LESS = "list_transform(range(1, length({0}) + 1), lambda i: {0}[:i - 1] || {0}[i + 1:])"
_ONE_EDIT = f"""(term = token OR list_contains({_LESS.format('term')}, token) OR list_contains({_LESS.format('token')}, term)
    OR (length(term) = length(token) AND len(list_filter(range(1, length(term) + 1), lambda i: term[i] != token[i])) = 1)
    OR (length(term) = length(token) AND list_contains(list_transform(range(1, length(term)), lambda i: term[:i - 1] || term[i + 1] || term[i] || term[i + 2:]), token)))"""


def _runs(s, d):
    return usage(s, d).select("session_id", "ts", F.concat_ws(" ", F.initcap("kind"), F.col("signature").cast("string")).alias("command"))


_RUNS = f"(SELECT session_id, ts, upper(kind[1]) || kind[2:] || ' ' || signature AS command FROM {_USAGE})"


def _boosted(s, d):
    m = messages(s, d)
    own = m.groupBy("session_id").agg(F.max("ts").alias("updated"), F.bool_or(F.col("role") == "system").alias("note"), F.bool_or(L_.is_question(F.col("text"))).alias("decided"), T.mostly_pasted(F.col("text")).alias("pasted"), (F.count("*") < 4).alias("gave_up"))
    rows = S.bm25(m, TERMS, "session_id").join(own, "session_id").join(M.worn(usage(s, d)), "session_id", "left")
    age = (F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.unix_timestamp("updated")) / 86400
    return rows.select("session_id", F.round(R.boosted(F.col("score"), age, F.coalesce("recalls", F.lit(0)), *map(F.col, ("note", "decided", "pasted", "gave_up"))), 8).alias("score"))


_STRIPPED = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_FIRST = rf"regexp_replace(regexp_extract(lower({_STRIPPED}), '^[^\s\p{{Z}}]+'), '^[,.:;!\"'']+|[,.:;!\"'']+$', '', 'g')"
_QUESTION = f"(length({_STRIPPED}) <= 240 AND (regexp_matches({_STRIPPED}, '[?？]$') OR list_contains({ASKING}, {_FIRST})))"


def _hybrid(s, d):
    e = table(s, d, "embeddings")
    cosines = S.cosines(e, e.where("vec_id = 0")).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("cosine"))
    return R.hybrid(S.bm25(table(s, d, "documents"), TERMS, "doc_id"), cosines, "doc_id")


def _first(s, d, k):
    return _rank(S.top(S.bm25(table(s, d, "documents"), TERMS, "doc_id"), k, "doc_id"), "doc_id")


def _superseded(s, d):
    """Documents as sessions of a project a language, a day each."""
    day = F.timestamp_add("DAY", F.col("doc_id"), F.lit("2024-01-01").cast("timestamp"))
    m = table(s, d, "documents").select(F.col("doc_id").alias("session_id"), "text", day.alias("ts"), F.col("lang").alias("project"))
    return H.superseded(_rank(S.top(S.bm25(m, ["der"], "session_id"), 50, "session_id"), "session_id"), m, "project")


_DAYS = "(SELECT doc_id AS session_id, text, lang AS project, TIMESTAMP '2024-01-01' + to_days(doc_id::INT) AS ts FROM documents)"


def _pushed(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("started"))
    marks = s.createDataFrame(_MARKS, "peer string, source string, mark string").withColumn("mark", F.col("mark").cast("timestamp"))
    return L.pushed_to(orders, marks)


def _relevance_sql(terms):
    per = "".join(f", max(list_contains(w, '{t}')::INT) AS h{i}" for i, t in enumerate(terms))
    n = range(len(terms))
    plus = " + ".join
    figure = "".join(f", (SELECT coalesce(max(sessions), 0) FROM c WHERE token = '{t}') AS s{i}, (SELECT coalesce(max(units), 0) FROM c WHERE token = '{t}') AS u{i}" for i, t in enumerate(terms))
    rank = "".join(f", ln((s + 1) / (s{i} + 1)) AS k{i}, greatest(ln(d / (u{i} + 1)), ln((s + 1) / (s{i} + 1))) AS f{i}" for i in n)
    weight = "".join(f", CASE WHEN f{i} <= 0 AND s{i} > 2 THEN 0 ELSE greatest(k{i}, 0.1) END AS r{i}, (f{i} >= 2 OR s{i} <= 2)::INT AS i{i}" for i in n)
    return f"""WITH p AS (SELECT session_id, seq, {_TOKENS} AS w FROM {_MESSAGES}), b AS (SELECT session_id, seq{per} FROM p GROUP BY ALL),
        c AS (SELECT token, count(*) AS sessions, sum(least(n, 25)) AS units FROM (SELECT token, session_id, count(*) AS n FROM (SELECT session_id, unnest(w) AS token FROM p) GROUP BY ALL) GROUP BY token),
        z AS (SELECT count(*) AS s, 1 + sum(least(n, 25)) AS d FROM (SELECT session_id, count(*) AS n FROM p GROUP BY 1)),
        g AS (SELECT *{figure} FROM z), y AS (SELECT *{rank} FROM g), x AS (SELECT *{weight} FROM y),
        o AS (SELECT session_id, max({plus(f"h{i} * r{i}" for i in n)}) AS best, max({plus(f"h{i} * (r{i} > 0)::INT" for i in n)}) AS k{"".join(f", sum(h{i}) AS t{i}, first(r{i}) AS r{i}, first(i{i}) AS i{i}" for i in n)} FROM b, x GROUP BY session_id),
        v AS (SELECT *, {plus(f"CASE WHEN t{i} > 0 THEN r{i} * (1 + 0.25 * log2(t{i})) ELSE 0 END" for i in n)} AS score0, {plus(f"i{i} * (t{i} > 0)::INT" for i in n)} AS m FROM o)
        SELECT session_id, round((best * (1 + 0.2 * (k - 1)) + 0.25 * (score0 - best)) * CASE WHEN m > 1 THEN 1 + 0.15 * (m - 1) ELSE 1 END, 9) AS score FROM v WHERE best > 0"""


_DOC_RANK = f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM ({_bm25_sql('documents', 'doc_id', TERMS, 'false')} ORDER BY score DESC, doc_id LIMIT %d)"
_RARE = ["onand", "erstst", "the", "die"]

#: By name: the query, and its SQL.
ALL = {
    "visible_roles": (lambda s, d: L.visible(messages(s, d), work=("system",)).groupBy("role").agg(F.count("*").alias("n")), f"SELECT role, count(*) AS n FROM {_MESSAGES} WHERE role IS NULL OR role != 'system' GROUP BY role"),
    "policy_filter": (lambda s, d: L.policy_counts(table(s, d, "documents"), "source", _RULES), "SELECT source, count(*) FILTER (source NOT IN ('src0', 'src7')) AS served, count(*) FILTER (source IN ('src0', 'src7')) AS withheld FROM documents GROUP BY source"),
    "recent_n": (lambda s, d: L.recent(messages(s, d), 10), f"SELECT session_id, max(ts) AS updated FROM {_MESSAGES} GROUP BY session_id ORDER BY updated DESC, session_id LIMIT 10"),
    "recent_by_project": (lambda s, d: L.recent_by(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3), "SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3"),
    "prefix_lookup": (lambda s, d: L.by_prefix(messages(s, d), "1"), f"SELECT session_id, count(*) OVER () AS matches FROM (SELECT DISTINCT session_id FROM {_MESSAGES} WHERE starts_with(session_id::VARCHAR, '1'))"),
    "neighborhood": (lambda s, d: L.neighbourhood(messages(s, d), F.contains(F.lower("text"), F.lit("tion"))), f"SELECT session_id, seq, hit FROM (SELECT session_id, seq, contains(lower(text), 'tion') AS hit, bool_or(contains(lower(text), 'tion')) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {_MESSAGES}) WHERE near"),
    "session_titles": (lambda s, d: L.titles(messages(s, d)), rf"WITH k AS (SELECT *, CASE WHEN role = 'user' AND len(regexp_extract_all(text, '[^ \n\t]+')) >= 4 THEN 0 WHEN role = 'assistant' THEN 1 ELSE 2 END AS kind FROM {_MESSAGES}) SELECT session_id, substring(text, 1, 60) AS title, kind = 1 AS by_assistant FROM k QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY kind, seq) = 1"),
    "egress_audit": (_pushed, f"SELECT o_orderkey AS session_id, string_agg(peer, ',' ORDER BY peer) AS peers FROM orders JOIN (VALUES {', '.join(f'({p!r}, {q!r}, TIMESTAMP {m!r})' for p, q, m in _MARKS)}) w(peer, source, mark) ON o_orderpriority = source AND mark >= o_orderdate GROUP BY o_orderkey"),
    "last_distinct": (lambda s, d: L.last_distinct(usage(s, d), "session_id", "signature"), f"SELECT session_id, signature, max(ts) AS last, row_number() OVER (PARTITION BY session_id ORDER BY max(ts) DESC, signature) AS place FROM {_USAGE} GROUP BY session_id, signature QUALIFY place <= 8"),
    "repeat_questions": (lambda s, d: H.repeated_questions(table(s, d, "documents").select(F.col("source").alias("session_id"), F.lit("user").alias("role"), "text")), f"SELECT stem, count(*) AS sessions FROM (SELECT DISTINCT source, array_to_string(w, ' ') AS stem FROM (SELECT source, {_WORDS} AS w FROM documents) WHERE len(w) >= 4) GROUP BY stem HAVING count(*) > 1"),
    "asked_twice": (lambda s, d: H.asked_twice(usage(s, d), "signature"), f"SELECT signature, count(DISTINCT session_id) AS sessions, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM {_USAGE} GROUP BY signature HAVING sessions >= 2 AND span >= 172800000000 ORDER BY span DESC, sessions DESC, signature LIMIT 1"),
    "command_table": (lambda s, d: H.commands(_runs(s, d)), f"SELECT command, count(*) AS runs, count(DISTINCT session_id) AS sessions, max(ts) AS last FROM {_RUNS} GROUP BY command HAVING sessions >= 2 ORDER BY sessions DESC, command LIMIT 4000"),
    "how_lookup": (lambda s, d: H.how(_runs(s, d), ["SIGN", "7"]), f"SELECT lower(command) AS command, count(*) AS runs, count(DISTINCT session_id) AS sessions, max(ts) AS last FROM {_RUNS} WHERE contains(lower(command), 'sign') AND contains(lower(command), '7') GROUP BY ALL"),
    "touched_files": (lambda s, d: H.touched(table(s, d, "lineitem"), "l_suppkey", "l_partkey"), "SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS place FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY place <= 6"),
    "files_topic_score": (lambda s, d: H.topic_paths(usage(s, d).where("kind = 'click'"), M.near_in_time(usage(s, d).where("kind = 'error'"), usage(s, d).where("kind = 'click'")).select(F.col("right_id").alias("event_id")), "signature", "event_id"), f"""WITH c AS (SELECT * FROM {_USAGE} WHERE kind = 'click'), n AS (SELECT DISTINCT c.event_id FROM c JOIN {_USAGE} e ON e.kind = 'error' AND e.session_id = c.session_id AND abs(epoch_us(e.ts) - epoch_us(c.ts)) < 1200000000),
        g AS (SELECT signature, count(*) AS total, count(n.event_id) AS near, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (n.event_id IS NOT NULL) AS near_sessions FROM c LEFT JOIN n USING (event_id) GROUP BY signature)
        SELECT signature, total, near, round(near_sessions * (near / total) * ln(1 + near) * ln(1 + (SELECT count(DISTINCT session_id) FROM c) / sessions), 9) AS score FROM g WHERE near > 0"""),
    "superseded_attempts": (_superseded, f"""WITH r AS (SELECT session_id, row_number() OVER (ORDER BY score DESC, session_id) AS place FROM ({_bm25_sql(_DAYS, 'session_id', ["der"], "false")} ORDER BY score DESC, session_id LIMIT 50)),
        o AS (SELECT session_id, place, project, max(ts) AS updated, list_distinct(flatten(list({_TOKENS}))) AS w FROM {_DAYS} JOIN r USING (session_id) GROUP BY ALL)
        SELECT a.session_id, arg_min(b.session_id, b.place) AS newer FROM o a JOIN o b ON a.project = b.project AND b.updated > a.updated + INTERVAL 24 HOURS WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6 GROUP BY a.session_id"""),
    "word_bigrams": (lambda s, d: H.bigrams(messages(s, d)), f"SELECT p[1] AS word, p[2] AS next, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: [w[i], w[i + 1]])) AS p FROM (SELECT {_WORDS} AS w FROM {_MESSAGES}) WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 2"),
    "substring_expand": (lambda s, d: R.expanded(S.token_catalog(table(s, d, "documents"), "doc_id"), _FUZZY), f"SELECT term, token FROM (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents) JOIN (SELECT unnest({_FUZZY}) AS term) ON contains(token, term)"),
    "fuzzy_tokens": (lambda s, d: R.fuzzy(S.token_catalog(table(s, d, "documents"), "doc_id"), _FUZZY), f"SELECT term, token, (term != token)::INT AS distance, row_number() OVER (PARTITION BY term ORDER BY term != token, token) AS place FROM (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents) JOIN (SELECT unnest({_FUZZY}) AS term) ON {_ONE_EDIT} QUALIFY place <= 8"),
    "relevance_rank": (lambda s, d: R.relevance(messages(s, d), _RARE), _relevance_sql(_RARE)),
    "boosted_rank": (_boosted, f"""WITH b AS ({_bm25_sql(_MESSAGES, 'session_id', TERMS, 'false')}), o AS (SELECT session_id, max(ts) AS updated, bool_or(role = 'system') AS note, bool_or({_QUESTION}) AS decided, {PASTED} AS pasted, count(*) < 4 AS gave_up FROM {_MESSAGES} GROUP BY session_id),
        u AS (SELECT session_id, count(*) AS n FROM {_USAGE} WHERE kind = 'view' GROUP BY session_id HAVING count(*) >= 2), a AS (SELECT *, (epoch(TIMESTAMP '{_NOW}') - epoch(updated)) / 86400 AS age FROM b JOIN o USING (session_id) LEFT JOIN u USING (session_id))
        SELECT session_id, round(score * CASE WHEN note THEN 1.25 ELSE 1 END * CASE WHEN decided THEN 2 ELSE 1 END * CASE WHEN pasted THEN 0.5 ELSE 1 END * CASE WHEN gave_up AND NOT decided THEN 0.5 ELSE 1 END * least(1.5, 1 + 0.1 * log2(1 + coalesce(n, 0))) * CASE WHEN age < 0 THEN 1 ELSE 1 / (1 + age) END, 8) AS score FROM a"""),
    "hybrid_rerank": (_hybrid, f"""WITH h AS ({_bm25_sql('documents', 'doc_id', TERMS, 'false')} ORDER BY score DESC, doc_id LIMIT 64), b AS (SELECT min(score) AS low, max(score) AS high FROM h), c AS (SELECT e.vec_id AS doc_id, max(round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0 GROUP BY 1)
        SELECT doc_id, round(0.5 * CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END + 0.5 * coalesce(cosine, 0), 6) AS score FROM h CROSS JOIN b LEFT JOIN c USING (doc_id)"""),
    "rejected_demote": (lambda s, d: R.demoted(_first(s, d, 50), M.latest_state(notes(s, d)).select(F.col("key").alias("doc_id"), "state"), "doc_id", "F"), f"SELECT doc_id, row_number() OVER (ORDER BY (state IS NOT DISTINCT FROM 'F')::INT, place) AS place FROM ({_DOC_RANK % 50}) LEFT JOIN (SELECT o_custkey AS doc_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1) USING (doc_id)"),
    "question_detect": (lambda s, d: messages(s, d).where(L_.is_question(F.col("text"))).select("session_id", "seq"), f"SELECT session_id, seq FROM {_MESSAGES} WHERE {_QUESTION}"),
}
