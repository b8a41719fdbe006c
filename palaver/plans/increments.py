"""Updates, streams and what comes back of plans and long sessions, over the given tables; a stream reads them in batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import covering_window
from ..functions.text import tokens
from ..operators.history import command_projects
from ..operators.increments import Postings
from ..operators.planner import Store
from ..operators.recall import densest, plan_walls
from ..sources.scratch import shared_dir
from ..sources.tables import table
from ..streaming.cooldown import run_to_end, shown
from ..streaming.sync import RECORD, Outbox
from .planner import _BASE, _STOP, _open, archive
from .queries import _TOKENS


def _updated(s, d):
    """Half of each document first, some sources with other words, and a file that goes; then the rest."""
    lines = table(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("path"), F.col("doc_id").alias("session_id"), F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    lines = lines.withColumn("seq", F.col("seq").cast("long")).withColumn("ts", F.lit(None).cast("timestamp"))
    changed, half = F.col("path").endswith("3"), F.col("seq") * 2 < F.col("n")
    lines = lines.select("path", "session_id", "seq", "text", "ts", changed.alias("changed"), half.alias("half"))
    own, columns = Postings(s, shared_dir(s)), ("path", "session_id", "seq", "text", "ts")
    other = F.when(F.col("changed"), F.reverse("text")).otherwise(F.col("text")).alias("text")
    first = lines.where("half").select("path", "session_id", "seq", other, "ts")
    gone = s.createDataFrame([("gone", -1, 0, "words of a file that goes", None)], "path string, session_id long, seq long, text string, ts timestamp")
    paths = lines.select("path", "changed").distinct()
    own.update(first.unionByName(gone), paths.select("path", F.lit("new").alias("what")))
    what = paths.select("path", F.when(F.col("changed"), "changed").otherwise("grown").alias("what")).unionByName(gone.select("path", F.lit("gone").alias("what")))
    own.update(lines.where("changed OR NOT half").select(*columns), what)
    return own.read()


def _delivered(s, d):
    """Events in three batches by day, some late; what belongs to some users is held back in the first two."""
    day = F.dayofmonth("ts")
    late = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    batch = F.least(F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2) + late, F.lit(2))
    rows = table(s, d, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("record"), F.col("user_id").cast("string").alias("project"), batch.alias("batch"))
    box, folder = Outbox(s, ["north", "south"]), shared_dir(s)
    for n in range(3):
        rows.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(folder)
        box.held = (lambda project: project.cast("long") % 9 == 0) if n < 2 else (lambda project: F.lit(False))
        box.deliver(s.readStream.schema(RECORD).parquet(folder))
    return box.delivered().select("peer", "source", "record", "batch")


def _shown(s, d):
    """Events as candidates: a user's kinds and hours."""
    rows = table(s, d, "events").select(F.col("user_id").alias("agent"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    folder = shared_dir(s)
    rows.write.parquet(folder)
    return run_to_end(shown(s.readStream.schema(rows.schema).parquet(folder), 3, 240))


def _walls(s, d):
    steps = table(s, d, "benchmark").select(F.col("item_id").alias("step_id"), F.array_join(F.slice(F.split("text", r"[ \n]+"), 1, 8), " ").alias("text"))
    lines = archive(s, d).where(F.char_length("text").between(20, 120)).select("session_id", F.col("text").alias("line"))
    return plan_walls(steps, _open(s, d)[0], lines)


def _projects(s, d):
    """Orders' priorities as commands, customers as sessions, clerks' days as projects."""
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("command"), F.col("o_custkey").alias("session_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 31).cast("string")).alias("project"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _commands(s, d):
    return command_projects(_projects(s, d)).select("command", "runs", "sessions", "last", F.array_join(F.transform("projects", lambda p: F.concat_ws(":", p["project"], p["sessions"], F.unix_seconds(p["last"]))), ",").alias("projects"))


def evidence(items, texts, store: Store):
    """item_id, evidence (texts that hold the item's passage), found_5, found_10 and first (place of the first of them, up to 10).

    All tokens of a passage count by their rarity, no token is left out. items: item_id, passage; texts: session_id, text.
    """
    asked = items.select("item_id", F.explode(tokens(F.col("passage"))).alias("token")).join(store.catalog.select("token", "sessions"), "token")
    asked = asked.withColumn("weight", F.log((store.sessions + 1) / F.col("sessions")))
    held = store.posted(asked).select("token", "session_id").distinct()
    ranked = asked.join(held, "token").groupBy("item_id", "session_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "session_id"))
    top = ranked.withColumn("place", place).where(F.col("place") <= 10).select("item_id", "session_id", "place")
    # who holds the passage holds its words; those at its ends may be parts of longer ones there
    inner = items.select("item_id", F.slice(F.regexp_extract_all(F.lower("passage"), F.lit(r"[\p{L}\p{Nd}_-]+"), F.lit(0)), 2, 1 << 20).alias("w")).select("item_id", F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("token"))
    rarest = inner.join(asked, ["item_id", "token"]).groupBy("item_id").agg(F.min(F.struct("sessions", "token"))["token"].alias("token"))
    near = rarest.join(held, "token").join(items, "item_id").join(texts, "session_id").where(F.contains("text", F.col("passage"))).select("item_id", "session_id")
    own = near.join(top, ["item_id", "session_id"], "left").groupBy("item_id").agg(F.count("*").alias("evidence"), F.count_if(F.col("place") <= 5).alias("found_5"), F.count("place").alias("found_10"), F.min("place").alias("first"))
    return items.select("item_id").join(own, "item_id", "left").fillna(0, ["evidence", "found_5", "found_10"])


def _evidence(s, d):
    rows = evidence(table(s, d, "benchmark").select("item_id", F.col("text").alias("passage")), table(s, d, "documents").select(F.col("doc_id").alias("session_id"), "text"), _open(s, d)[0])
    share = lambda n: F.round(F.avg(F.when(F.col("evidence") > 0, F.col(n) / F.col("evidence"))), 6)
    return rows.agg(
        F.count("*").alias("items"), F.count_if(F.col("evidence") > 0).alias("covered"), F.count_if(F.col("first") == 1).alias("hit_1"), F.count_if(F.col("first") <= 5).alias("hit_5"), F.count_if(F.col("first") <= 10).alias("hit_10"),
        share("found_5").alias("evidence_5"), share("found_10").alias("evidence_10"), F.round(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"),
        F.percentile("first", F.lit(0.5)).alias("first_p50"), F.percentile("first", F.lit(0.9)).alias("first_p90"), F.percentile("evidence", F.lit(0.9)).alias("evidence_p90"),
    )


_NEAR = ("the", "and", "erst")
_DENSE = " + ".join(f"contains(lower(coalesce(text, '')), '{t}')::INT" for t in ("the", "und", "ción"))

ALL = {
    "x03_incremental_postings": (_updated, f"WITH {_BASE[:_BASE.index('cat AS')]} s AS (SELECT 1) SELECT DISTINCT token, coalesce(source, 'none') AS path, session_id, seq FROM p JOIN documents ON doc_id = session_id"),
    "x07_streamed_delivery": (_delivered, """
        WITH e AS (SELECT event_type AS source, ts, event_id AS record, user_id % 9 = 0 AS held, least(CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END + (event_id % 50 = 0)::INT, 2) AS b FROM events),
        s0 AS (SELECT source, ts, record FROM e WHERE b = 0 AND NOT held), w0 AS (SELECT * FROM e WHERE b = 0 AND held),
        m0 AS (SELECT source, least(mark, oldest) AS mark FROM (SELECT source, max(ts) AS mark FROM s0 GROUP BY 1) LEFT JOIN (SELECT source, min(ts) AS oldest FROM w0 GROUP BY 1) USING (source)),
        s1 AS (SELECT source, ts, record FROM e LEFT JOIN m0 USING (source) WHERE b = 1 AND NOT held AND (mark IS NULL OR ts > mark OR (ts = mark AND record NOT IN (SELECT record FROM s0)))),
        w1 AS (SELECT * FROM w0 UNION ALL SELECT * FROM e WHERE b = 1 AND held),
        m1 AS (SELECT source, least(mark, oldest) AS mark FROM (SELECT source, max(mark) AS mark FROM (SELECT * FROM m0 UNION ALL SELECT source, ts FROM s1) GROUP BY 1) LEFT JOIN (SELECT source, min(ts) AS oldest FROM w1 GROUP BY 1) USING (source)),
        s2 AS (SELECT source, ts, record FROM (SELECT * FROM w1 UNION ALL SELECT * FROM e WHERE b = 2) LEFT JOIN m1 USING (source) WHERE mark IS NULL OR ts > mark OR (ts = mark AND record NOT IN (SELECT record FROM s0 UNION ALL SELECT record FROM s1)))
        SELECT peer, source, record, batch FROM (SELECT *, 0::BIGINT AS batch FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2), (VALUES ('north'), ('south')) p(peer)"""),
    "x11_cooldown": (_shown, """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS agent, event_id, (props->>'$.k')::BIGINT AS session_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE (props->>'$.k') IS NOT NULL),
        r(agent, i, have, event_id, session_id) AS (SELECT DISTINCT agent, 0::BIGINT, []::STRUCT(s BIGINT, t TIMESTAMP)[], NULL::BIGINT, NULL::BIGINT FROM e UNION ALL
            SELECT e.agent, e.i, CASE WHEN again THEN have ELSE list_append(have, {'s': e.session_id, 't': e.ts})[-3:] END, CASE WHEN NOT again THEN e.event_id END, e.session_id
            FROM (SELECT r.have, e.*, len(list_filter(r.have, lambda h: h.s = e.session_id AND e.ts < h.t + INTERVAL 240 HOUR)) > 0 AS again FROM r JOIN e ON e.agent = r.agent AND e.i = r.i + 1) e)
        SELECT agent, event_id, session_id FROM r WHERE event_id IS NOT NULL"""),
    "d13_plan_walls": (_walls, rf"""WITH {_BASE[:_BASE.index('b AS (')]}
        q AS (SELECT item_id AS step_id, array_to_string(regexp_split_to_array(text, '[ \n]+')[1:8], ' ') AS t FROM benchmark),
        t AS (SELECT DISTINCT step_id, trim(x, '.') AS term FROM (SELECT step_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{Nd}}_./-]+')) AS x FROM q) WHERE strlen(x) >= 3 AND x NOT IN ({_STOP})),
        n AS (SELECT step_id, CASE WHEN bool_or(regexp_matches(term, '[_./0-9-]')) THEN 1 ELSE 2 END AS need FROM t GROUP BY 1),
        told AS (SELECT step_id, term FROM t JOIN cat ON token = term WHERE sessions <= 2 OR ln(((SELECT count(DISTINCT session_id) FROM m) + 1) / (sessions + 1)) >= CASE WHEN regexp_matches(term, '[_./0-9-]') THEN 1.0 ELSE 2.0 END),
        c AS (SELECT step_id, session_id FROM told JOIN (SELECT DISTINCT token, session_id FROM p) ON token = term JOIN n USING (step_id) GROUP BY ALL HAVING count(*) >= any_value(need)),
        w AS (SELECT DISTINCT session_id, text AS line FROM m WHERE length(text) BETWEEN 20 AND 120), k AS (SELECT line, count(*) AS sessions FROM w GROUP BY 1 HAVING count(*) >= 3)
        SELECT step_id, line, sessions, carriers FROM (SELECT step_id, line, count(*) AS carriers FROM c JOIN w USING (session_id) GROUP BY ALL) f JOIN k USING (line)
        WHERE EXISTS (SELECT 1 FROM told WHERE told.step_id = f.step_id AND list_contains(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{Nd}}_./-]+'), term))
        QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY sessions DESC, carriers DESC, line) <= 3"""),
    "a13_command_projects": (_commands, """
        WITH r AS (SELECT o_orderpriority AS command, o_custkey AS session_id, 'p' || o_custkey % 31 AS project, o_orderdate AS ts FROM orders),
        e AS (SELECT command, project, count(DISTINCT session_id) AS n, max(ts) AS last FROM r GROUP BY command, project QUALIFY row_number() OVER (PARTITION BY command ORDER BY n DESC, project) <= 24),
        p AS (SELECT command, string_agg(project || ':' || n || ':' || epoch(last)::BIGINT, ',' ORDER BY n DESC, project) AS projects FROM e GROUP BY 1)
        SELECT command, count(*) AS runs, count(DISTINCT session_id) AS sessions, max(ts) AS last, any_value(projects) AS projects FROM r JOIN p USING (command) GROUP BY command HAVING count(DISTINCT session_id) >= 2"""),
    "a32_evidence": (_evidence, rf"""WITH {_BASE[:_BASE.index('b AS (')]}
        q AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark), w AS (SELECT item_id, token, ln(((SELECT count(DISTINCT session_id) FROM m) + 1) / sessions) AS weight FROM q JOIN cat USING (token)),
        k AS (SELECT item_id, session_id, round(sum(weight), 6) AS score FROM w JOIN (SELECT DISTINCT token, session_id FROM p) USING (token) GROUP BY ALL),
        t AS (SELECT item_id, session_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, session_id) AS place FROM k QUALIFY place <= 10),
        g AS (SELECT item_id, doc_id AS session_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        o AS (SELECT item_id, count(*) AS evidence, count(*) FILTER (place <= 5) AS found_5, count(place) AS found_10, min(place) AS first FROM g LEFT JOIN t USING (item_id, session_id) GROUP BY 1),
        r AS (SELECT item_id, coalesce(evidence, 0) AS evidence, found_5, found_10, first FROM benchmark LEFT JOIN o USING (item_id))
        SELECT count(*) AS items, count(*) FILTER (evidence > 0) AS covered, count(*) FILTER (first = 1) AS hit_1, count(*) FILTER (first <= 5) AS hit_5, count(*) FILTER (first <= 10) AS hit_10,
               round(avg(found_5 / evidence) FILTER (evidence > 0), 6) AS evidence_5, round(avg(found_10 / evidence) FILTER (evidence > 0), 6) AS evidence_10, round(sum(coalesce(1 / first, 0)) / count(*), 6) AS mrr,
               quantile_cont(first, 0.5)::DOUBLE AS first_p50, quantile_cont(first, 0.9)::DOUBLE AS first_p90, quantile_cont(evidence, 0.9)::DOUBLE AS evidence_p90 FROM r"""),
    "r15_closest": (lambda s, d: table(s, d, "documents").select("doc_id", covering_window(F.col("text"), list(_NEAR)).cast("long").alias("bytes")), f"""
        WITH t AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents), k AS (SELECT unnest({list(_NEAR)}) AS term),
        o AS MATERIALIZED (SELECT doc_id, term, strlen(low[:i - 1]) AS pos, strlen(term) AS size FROM (SELECT doc_id, low, term, unnest(list_filter(range(1, length(low) + 1), lambda i: low[i:i + length(term) - 1] = term)) AS i FROM t, k WHERE contains(low, term))),
        f AS (SELECT doc_id, count(*) AS n, max(pos + size) - min(pos) AS span FROM (SELECT doc_id, term, min(pos) AS pos, any_value(size) AS size FROM o GROUP BY ALL) GROUP BY 1),
        l AS (SELECT doc_id, pos + size AS upto, {', '.join(f"max(pos) FILTER (term = '{t}') OVER w AS l{i}" for i, t in enumerate(_NEAR))} FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos, list_position({list(_NEAR)}, term) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        c AS (SELECT doc_id, min(upto - least(l0, l1, l2)) FILTER (l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL) AS best FROM l GROUP BY 1)
        SELECT doc_id, CASE WHEN low IS NULL THEN NULL WHEN coalesce(n, 0) < 3 THEN 0 WHEN span <= 200 THEN span ELSE best END::BIGINT AS bytes FROM t LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)"""),
    "d15_densest": (lambda s, d: densest(archive(s, d), ["the", "und", "ción"], 6).withColumn("hits", F.col("hits").cast("long")), rf"""
        WITH m AS (SELECT doc_id AS session_id, unnest(range(len(l)))::BIGINT AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        h AS (SELECT *, ({_DENSE})::BIGINT AS hits FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, bool_or(hits > 0) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near,
            row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, seq) AS place FROM h), k AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY session_id) AS kept FROM n)
        SELECT session_id, seq, hits FROM k WHERE n <= 6 OR CASE WHEN kept > 6 THEN hits > 0 AND place <= 6 ELSE near END"""),
}
