"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extraction, licences, minhash, mixing, negatives, neighbours, packing, passages, quality, runs, tokens, urls
from .common import read


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(read(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.assembled(turns.unionByName(extra)))


def op4_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removed(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(read(spark, sf_dir, "documents"))


def made_periodic(doc_id: int | None, text: bytes) -> bytes:
    """The text of one of ten ids with a period from some word on, as the query asks; a row without an id stays as it is."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    words = text.split() if h % 10 == 0 else []
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.found(read(spark, sf_dir, "documents"), rewritten=made_periodic))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_html_main_text, op2_best_fit_packing, op3_chat_formatting, op4_vector_neighbours, op5_quality_rules, op6_source_mixing, op7_near_duplicates, op8_token_counts, op9_repeated_passages, op10_license_scan, op11_periodic_runs, op12_hard_negatives, op13_url_filters)}



def _spread_sql() -> str:
    """The rounds of trust and distrust, one after another."""
    first = ", r0 AS MATERIALIZED (SELECT host, true AS forward, trust AS mass FROM seed WHERE trust > 0 UNION ALL SELECT host, false, distrust FROM seed WHERE distrust > 0)"
    step = ", r{} AS MATERIALIZED (SELECT b AS host, forward, sum(mass * 85 // (100 * ways))::BIGINT AS mass FROM r{} r JOIN way w USING (forward) WHERE w.a = r.host AND mass * 85 // (100 * ways) > 0 GROUP BY ALL)"
    return first + "".join(step.format(i + 1, i) for i in range(urls.ROUNDS))


_CONTROL = chat.CONTROL.replace("'", "''")
SQL = {
    "op3_chat_formatting": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               (3 + sum(8 + 8 + 7 + length(role) + length(text) + len(regexp_extract_all(role, '\\|{_CONTROL}'))
                        + len(regexp_extract_all(text, '\\|{_CONTROL}'))))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, e.r, e.vec_id, a.label = e.label AS alike, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.r != e.r WHERE a.vec_id % 100 = 0),
        p AS (SELECT a, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
        SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
        QUALIFY row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r) <= 10""",
    "op13_url_filters": rf"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
        f AS (SELECT *, '.' || host AS h, CASE WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/' WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM u),
        g AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM f),
        seed AS (SELECT host, 1000000 * count(*) FILTER (ruled = 'allow') AS trust, 1000000 * count(*) FILTER (ruled = 'block') AS distrust FROM g WHERE host != '' GROUP BY host),
        up AS (SELECT s.host AS a, max_by(t.host, length(t.host)) AS b FROM seed s JOIN seed t ON s.host LIKE '%.' || t.host AND t.host LIKE '%.%' GROUP BY 1),
        link AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)), '{urls.UPPER}', '{urls.LOWER}') AS b FROM g WHERE host != ''
                 UNION ALL SELECT a, b FROM up UNION ALL SELECT b, a FROM up),
        edge AS (SELECT DISTINCT a, b FROM link WHERE a != b), both_ AS (SELECT true AS forward, a, b FROM edge UNION ALL SELECT false, b, a FROM edge),
        way AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY forward, a) AS ways FROM both_)
        {_spread_sql()},
        total AS (SELECT host, coalesce(sum(mass) FILTER (forward), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (NOT forward), 0)::BIGINT AS distrust
                  FROM ({' UNION ALL '.join(f'SELECT * FROM r{i}' for i in range(urls.ROUNDS + 1))}) GROUP BY host)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
        FROM g LEFT JOIN total USING (host)""",
    "op5_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k) GROUP BY r),
        p AS (SELECT r, max(n) AS n FROM (SELECT r, w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM m WHERE len(w) >= 2) GROUP BY ALL) GROUP BY r),
        f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                     coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS lines, coalesce(p.n, 0) AS top_pair,
                     len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS ellipses,
                     len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alphabetic FROM m LEFT JOIN c USING (r) LEFT JOIN p USING (r)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 10 * bullets > 9 * lines OR 10 * ellipses > 3 * lines OR 10 * alphabetic < 6 * n_words OR 10 * top_pair > n_words) AS kept
        FROM b""",
    "op6_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
        r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5(key || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op7_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        rare AS (SELECT g, count(*) AS df FROM s GROUP BY g HAVING count(*) > 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN rare USING (g) JOIN s y USING (g) WHERE x.doc_id != y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r(a, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.m),
        k AS (SELECT a, min(m) AS m FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.m AS component_id, d.doc_id = k.m AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.a = d.doc_id""",
}
