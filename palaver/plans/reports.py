"""Named queries of matching and reports, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as J
from ..operators import mining as M
from ..operators import reports as P
from ..operators import search as S
from ..sources.tables import messages, notes, table, usage
from .queries import _MESSAGES, _TOKENS, _USAGE, TERMS, _bm25_sql, _rank

_NOW = "2024-01-28 12:00:00"
_VARIANTS = {"the": ["the", "die"], "onand": ["onand", "erstst"]}
_WANTED = ["http://therwh.example.org/es/12?utm_source=feed", "x/685"]
_ORIGIN = "('imported:home/' || source)"
_LISTS = f"""s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM ({_bm25_sql('documents', 'doc_id', TERMS[1:2], 'false')} ORDER BY score DESC, doc_id LIMIT 9)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM ({_bm25_sql('documents', 'doc_id', TERMS, 'false')} ORDER BY score DESC, doc_id LIMIT 50))"""


def _lists(s, d):
    docs = table(s, d, "documents")
    return (_rank(S.top(S.bm25(docs, terms, "doc_id"), k, "doc_id"), "doc_id") for terms, k in ((TERMS[1:2], 9), (TERMS, 50)))


def _origins(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("imported:home/"), "source").alias("project"))


def _counted(s, d):
    return messages(s, d).where("seq = 1").select("session_id", F.sha2("text", 256).alias("mark"))


def _reused(s, d):
    return P.most_reused(M.worn(usage(s, d)), usage(s, d).groupBy("session_id").agg(F.max("ts").alias("updated")), "2024-03-01 00:00:00")


#: By name: the query, and its SQL.
ALL = {
    "posting_intersection": (lambda s, d: J.holding_all(S.postings(table(s, d, "documents"), "doc_id"), TERMS[:2], "doc_id"), f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, {TERMS[:2]})"),
    "variant_intersection": (
        lambda s, d: J.holding_variants(S.postings(table(s, d, "documents"), "doc_id"), _VARIANTS, "doc_id"),
        "SELECT doc_id FROM documents WHERE " + " AND ".join(f"list_has_any({_TOKENS}, {v})" for v in _VARIANTS.values()),
    ),
    "project_scope": (lambda s, d: _origins(s, d).where(J.in_scope(F.col("project"), "src3")).select("doc_id"), "SELECT doc_id FROM documents WHERE source = 'src3'"),
    "project_exclusion": (lambda s, d: _origins(s, d).where(~J.excluded(F.col("project"), ["src7", "home/?rc1*", "*"])).select("doc_id"), f"SELECT doc_id FROM documents WHERE NOT (contains({_ORIGIN}, 'src7') OR regexp_matches({_ORIGIN}, '^imported:home/[^/]rc1[^/]*$'))"),
    "usable_notes": (lambda s, d: J.usable(table(s, d, "customer").select("c_custkey"), M.latest_state(notes(s, d)), "c_custkey", "F"), "WITH l AS (SELECT o_custkey AS c_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN l USING (c_custkey) WHERE state IS NULL OR state = 'F'"),
    "signature_join": (lambda s, d: J.sharing_signatures(usage(s, d).where("kind = 'error'"), [3, 7, 11, 42]), f"SELECT session_id, count(DISTINCT signature) AS shared, max(ts) AS last FROM {_USAGE} WHERE kind = 'error' AND signature IN (3, 7, 11, 42) GROUP BY session_id"),
    "path_sessions": (lambda s, d: J.touching(table(s, d, "pages"), F.col("url"), _WANTED).select("page_id"), f"SELECT page_id FROM pages WHERE url IN {tuple(_WANTED)} OR regexp_extract(url, '([^/]*)/?$', 1) IN ('12?utm_source=feed', '685')"),
    "spawn_edges": (lambda s, d: J.children(messages(s, d).select("session_id", F.floor(F.col("session_id") / 3).alias("parent")).distinct()), "WITH s AS (SELECT DISTINCT conv_id AS session_id, conv_id // 3 AS parent FROM conversations) SELECT parent, count(*) AS children FROM s WHERE parent != session_id AND parent IN (SELECT session_id FROM s) GROUP BY parent"),
    "merged_sessions": (
        lambda s, d: J.merged_sessions(messages(s, d), usage(s, d)),
        f"SELECT session_id, min(ts) AS started, max(ts) AS updated, count(*) AS rows, min(o) != max(o) AS shared FROM (SELECT session_id, ts, 0 AS o FROM {_MESSAGES} UNION ALL SELECT session_id, ts, 1 FROM {_USAGE}) GROUP BY session_id",
    ),
    "ordered_union": (
        lambda s, d: J.ordered_union(*_lists(s, d), "doc_id"),
        f"WITH {_LISTS}, b AS (SELECT doc_id, 0 AS l, place FROM s UNION ALL SELECT doc_id, 1, place FROM r), m AS (SELECT doc_id, min((l, place)) AS k FROM b GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS place FROM m",
    ),
    "thin_and_tail": (
        lambda s, d: J.thin_tail(*_lists(s, d), "doc_id"),
        f"WITH {_LISTS}, n AS (SELECT count(*) AS n FROM r), b AS (SELECT doc_id, r.place AS rp, s.place AS sp, n FROM r FULL JOIN s USING (doc_id), n) SELECT doc_id, row_number() OVER (ORDER BY coalesce(rp, n + 1) - CASE WHEN sp IS NULL THEN 0 ELSE 10 END, coalesce(rp, n + sp), doc_id) AS place FROM b",
    ),
    "source_inventory": (lambda s, d: P.inventory(table(s, d, "documents"), "source"), "SELECT source, count(*) AS rows, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty FROM documents GROUP BY source"),
    "agent_credits": (lambda s, d: P.credits(usage(s, d), "click", _NOW), f"SELECT session_id, count(*) AS n, count(*) FILTER (ts > TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS week FROM {_USAGE} WHERE kind = 'click' GROUP BY session_id"),
    "rolling_windows": (lambda s, d: P.windows(usage(s, d), _NOW), "SELECT kind" + "".join(f", count(*) FILTER (ts > TIMESTAMP '{_NOW}' - INTERVAL {n} DAY) AS days_{n}" for n in (7, 14, 60, 90)) + f" FROM {_USAGE} WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY kind"),
    "most_reused": (_reused, f"SELECT session_id, count(*) FILTER (kind = 'view') AS recalls FROM {_USAGE} GROUP BY session_id HAVING recalls >= 2 AND max(ts) < TIMESTAMP '2024-02-29' ORDER BY recalls DESC, session_id LIMIT 1"),
    "suggested_query": (
        lambda s, d: P.suggested(messages(s, d)),
        rf"""WITH w AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_-]+') AS w FROM conversations WHERE role = 'user'), n AS (SELECT count(*) AS n FROM w),
        f AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM w) GROUP BY t HAVING count(*) >= 2),
        p AS (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS c FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 2)
        SELECT a AS word, b AS next, round(ln(n / x.df) + ln(n / y.df), 9) AS score FROM p JOIN f x ON x.t = a JOIN f y ON y.t = b, n WHERE round(ln(n / x.df) + ln(n / y.df), 9) >= 1 ORDER BY score DESC, word, next LIMIT 1""",
    ),
    "last_other_session": (
        lambda s, d: P.last_other(usage(s, d).where("signature is not null"), "signature"),
        f"WITH o AS (SELECT session_id, signature, max(ts) AS last FROM {_USAGE} WHERE signature IS NOT NULL GROUP BY ALL) SELECT a.session_id, a.signature, b.session_id AS other FROM o a JOIN o b ON a.signature = b.signature AND a.session_id != b.session_id QUALIFY row_number() OVER (PARTITION BY a.session_id, a.signature ORDER BY b.last DESC, b.session_id) = 1",
    ),
    "first_distinct": (lambda s, d: P.first_distinct(usage(s, d), "session_id", "signature"), f"SELECT session_id, signature, min(ts) AS first, row_number() OVER (PARTITION BY session_id ORDER BY min(ts), signature) AS place FROM {_USAGE} WHERE signature IS NOT NULL GROUP BY session_id, signature QUALIFY place <= 8"),
    "carried_turns": (
        lambda s, d: P.carried(messages(s, d), F.length("text") > 60).select("session_id", "seq"),
        f"SELECT session_id, seq FROM (SELECT session_id, seq, last_value(CASE WHEN role != 'assistant' THEN length(text) > 60 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS kept FROM {_MESSAGES}) WHERE kept",
    ),
    "new_suffix": (
        lambda s, d: P.new_suffix(messages(s, d), _counted(s, d)),
        f"WITH c AS (SELECT session_id, text AS mark FROM {_MESSAGES} WHERE seq = 1), l AS (SELECT session_id, max(seq) AS last FROM {_MESSAGES} JOIN c USING (session_id) WHERE text = mark GROUP BY 1) SELECT session_id, seq FROM {_MESSAGES} LEFT JOIN l USING (session_id) WHERE last IS NULL OR seq > last",
    ),
    "budgeted_prefix": (
        lambda s, d: P.budgeted(messages(s, d), "session_id", "seq", "text", 400),
        f"SELECT session_id, seq, least(size, 400 - before)::BIGINT AS bytes FROM (SELECT session_id, seq, coalesce(strlen(text), 0) AS size, coalesce(sum(coalesce(strlen(text), 0)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_MESSAGES}) WHERE before < 400",
    ),
    "longest_tokens": (
        lambda s, d: table(s, d, "documents").select("doc_id", P.longest_tokens(T.tokens(F.col("text"))).alias("tokens")).where("tokens != ''"),
        f"SELECT doc_id, string_agg(t, ' ' ORDER BY strlen(t) DESC, t) AS tokens FROM (SELECT doc_id, t FROM (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strlen(t) DESC, t) <= 8) GROUP BY doc_id",
    ),
}
