"""Joins of postings, scopes, signatures and paths, and merges of ranked lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(project: Column, want: str) -> Column:
    """The project itself or a path that ends in it, imported or not."""
    own = F.regexp_replace(project, "^imported:", "")
    return (own == want) | own.endswith(f"/{want}")


def excluded(project: Column, patterns: list[str]) -> Column:
    """Projects that hold a pattern, or match one with * (within a part of the path) and ?."""
    own = F.regexp_replace(project, "^imported:", "")
    out = F.lit(False)
    for p in patterns:
        if re.search(r"[*?]", p):
            out |= own.rlike("^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in p) + "$")
        else:
            out |= F.contains(own, F.lit(p))
    return out


def usable(rows: DataFrame, states: DataFrame, key: str, accepted: str) -> DataFrame:
    """Rows whose latest state is the accepted one, or that have none. states: key, state."""
    latest = states.select(F.col("key").alias(key), "state")
    return rows.join(latest, key, "left").where(F.col("state").isNull() | (F.col("state") == accepted)).drop("state")


def holding_all(postings: DataFrame, tokens: list[str], key: str) -> DataFrame:
    """The keys that every one of the tokens is posted for. postings: key, token, each pair once."""
    own = sorted(set(tokens))
    return postings.where(F.col("token").isin(own)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select(key)


def holding_variants(postings: DataFrame, variants: dict[str, list[str]], key: str) -> DataFrame:
    """The keys that some variant of every term is posted for."""
    rows = [(t, v) for t, own in variants.items() for v in own]
    wanted = F.broadcast(postings.sparkSession.createDataFrame(rows, "term string, token string"))  # as many rows as the query has variants
    return postings.join(wanted, "token").groupBy(key).agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(variants)).select(key)


def sharing_signatures(events: DataFrame, signatures: list[int]) -> DataFrame:
    """Sessions by how many of the signatures they met."""
    own = events.where(F.col("signature").isin(signatures))
    return own.groupBy("session_id").agg(F.countDistinct("signature").alias("shared"), F.max("ts").alias("last"))


def touching(rows: DataFrame, path: Column, wanted: list[str]) -> DataFrame:
    """Rows of a path that is wanted, or whose last part is the last part of a wanted one."""
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return rows.where(path.isin(wanted) | last.isin([re.search(r"([^/]*)/?$", w)[1] for w in wanted]))


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first list, then what only the second one holds. Both: key, place."""
    both = first.select(key, F.lit(0).alias("list"), "place").unionByName(second.select(key, F.lit(1).alias("list"), "place"))
    once = both.groupBy(key).agg(F.min(F.struct("list", "place")).alias("at"))
    return once.select(key, F.row_number().over(Window.orderBy("at", key)).alias("place"))  # ranked lists are at most a page long


def thin_tail(strict: DataFrame, relevant: DataFrame, key: str, lift: int = 10) -> DataFrame:
    """The relevant list with the strict hits so many places higher; strict hits it lacks start from its end. Both: key, place."""
    n = relevant.agg(F.count("*").alias("n"))
    both = relevant.select(key, F.col("place").alias("relevant")).join(strict.select(key, F.col("place").alias("strict")), key, "full").crossJoin(F.broadcast(n))
    at = F.coalesce("relevant", F.col("n") + 1) - F.when(F.col("strict").isNotNull(), lift).otherwise(0)
    return both.select(key, F.row_number().over(Window.orderBy(at, F.coalesce("relevant", F.col("n") + F.col("strict")), key)).alias("place"))


def children(sessions: DataFrame) -> DataFrame:
    """Sessions that others were spawned from, with their number. sessions: session_id, parent."""
    parents = sessions.select(F.col("session_id").alias("parent"))
    return sessions.where("parent != session_id").join(parents, "parent", "left_semi").groupBy("parent").agg(F.count("*").alias("children"))


def merged_sessions(*sources: DataFrame) -> DataFrame:
    """One row of each session of all sources: first and last time, rows, and whether several sources share it."""
    rows = sources[0].select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("of"))
    for k, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(k).alias("of")))
    return rows.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count("*").alias("rows"), (F.min("of") != F.max("of")).alias("shared"))
