"""Scalar functions over text columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}_-]+"


def tokens(text: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens of two bytes or more, in lower case, distinct."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))), lambda t: F.octet_length(t) >= 2)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def overlap(a: Column, b: Column) -> Column:
    """What two sets share, as a part of the smaller one."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def text_lines(text: Column) -> Column:
    """Lines, without white space around them or the text."""
    return F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def is_pasted(text: Column, lines: int = 8, share: float = 0.35) -> Column:
    """Of a text of so many lines or more whether few are distinct; null of others."""
    own = text_lines(text)
    return F.when(F.size(own) >= lines, F.size(F.array_distinct(own)) / F.size(own) < share)


def mostly_pasted(text: Column) -> Column:
    """P15, an aggregate: whether at least half of a session's long texts are dumps."""
    dump = is_pasted(text)
    return (F.count(dump) > 0) & (2 * F.count_if(dump) >= F.count(dump))


#: Assignments of secrets: a name, then a quoted value of 16 characters or more.
SECRET = r"((?:token|secret|password|api_key)\s*=\s*)\"[^\"]{16,}\""
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, '$1"[redacted]"'), MAIL, "[mail]")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
