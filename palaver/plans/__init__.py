"""Plans of Palaver."""

from . import archive, cases, increments, planner, queries, reports, served, statistics, transcripts, whole

#: Every query by name, with its SQL.
ALL = queries.ALL | archive.ALL | reports.ALL | cases.ALL | transcripts.ALL | served.ALL | planner.ALL | increments.ALL | whole.ALL | statistics.ALL
