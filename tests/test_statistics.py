"""Odd cases of the statistics report."""

from __future__ import annotations

from palaver.operators import statistics as R


def test_report_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(2, "a", "p"), (2, "a", "p"), (1, "a", "q"), (1, "a", "q"), (3, None, None)], "session_id long, harness string, project string")
    got = {tuple(r) for r in R.report(rows, 2).collect()}
    assert got == {("total", None, 3, 5), ("harness", "a", 2, 4), ("harness", None, 1, 1), ("project", "-", 1, 1), ("project", "p", 1, 2), ("longest", "1", 1, 2)}
    assert [tuple(r) for r in R.report(rows.where("false")).collect()] == [("total", None, 0, 0)]


def test_months_and_grid_have_every_cell(spark):
    rows = spark.createDataFrame([("2024-02-29 23:59:59",), ("2024-02-01 00:00:00",), ("2023-03-01 00:00:00",), ("2023-02-28 00:00:00",), ("2024-03-01 00:00:00",), (None,)], "ts string").selectExpr("cast(ts AS timestamp) AS ts")
    got = {r.month: (r.n, r.level) for r in R.months(rows, "ts", "2024-02-29").collect()}
    assert len(got) == 12 and got["2024-02"] == (2, 4) and got["2023-03"] == (1, 1) and got["2023-04"] == (0, 0)
    grid = {(r.week, r.weekday): r.n for r in R.year_grid(rows, "ts", "2024-02-29").collect()}
    assert len(grid) == 54 * 7 or len(grid) == 53 * 7
    last = max(w for w, _ in grid)
    assert [grid[last, d] for d in range(7)] == [0, 0, 0, 0, 1, -1, -1]
    assert sum(n for n in grid.values() if n > 0) == 4
    assert all(n == 0 for n in (r.n for r in R.year_grid(rows.where("false"), "ts", "2024-02-24").collect()))
