"""Named queries of the statistics report, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as R
from ..sources.tables import table, usage
from .queries import _USAGE

_TODAY = "2024-01-24"
_TOTALS = "count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS messages"


def _orders(s, d):
    """Orders as messages of customers, the priority as harness and the status as project."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("harness"), F.col("o_orderstatus").alias("project"))


#: By name: the query, and its SQL.
ALL = {
    "a01_report": (
        lambda s, d: R.report(_orders(s, d)),
        f"""WITH t AS (SELECT o_custkey AS id, o_orderpriority AS h, coalesce(o_orderstatus, '-') AS p, count(*) AS n FROM orders GROUP BY ALL)
        SELECT 'total' AS section, NULL::VARCHAR AS name, {_TOTALS} FROM t UNION ALL SELECT 'harness', h, {_TOTALS} FROM t GROUP BY h
        UNION ALL (SELECT 'project', p, {_TOTALS} FROM t GROUP BY p ORDER BY sessions DESC, p LIMIT 5)
        UNION ALL (SELECT 'longest', id::VARCHAR, 1, n FROM t ORDER BY n DESC, id, h, p LIMIT 1)""",
    ),
    "a02_months": (
        lambda s, d: R.months(usage(s, d), "ts", _TODAY),
        f"""WITH m AS (SELECT m, count(ts) AS n FROM generate_series(TIMESTAMP '2023-02-01', TIMESTAMP '2024-01-01', INTERVAL 1 MONTH) g(m) LEFT JOIN {_USAGE} ON date_trunc('month', ts) = m GROUP BY m)
        SELECT strftime(m, '%Y-%m') AS month, n, CASE WHEN n = 0 THEN 0 ELSE (n - 1) * 7 // (SELECT max(n) FROM m) + 1 END::BIGINT AS level FROM m""",
    ),
    "a03_year_grid": (
        lambda s, d: R.year_grid(usage(s, d), "ts", _TODAY),
        f"""WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM {_USAGE} GROUP BY day), g AS (SELECT i, DATE '2023-01-15' + i::INT AS day FROM range(378) r(i) WHERE DATE '2023-01-15' + i::INT <= DATE '2024-01-27')
        SELECT i // 7 AS week, i % 7 AS weekday, CASE WHEN g.day > DATE '{_TODAY}' THEN -1 ELSE coalesce(n, 0) END::BIGINT AS n FROM g LEFT JOIN c USING (day)""",
    ),
}
