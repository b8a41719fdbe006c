"""The ladder of retrieval tiers over a table of postings: exact, close, word forms, near spellings, neighbours, relevance.

Postings are (token, session_id, seq), written once by bucket of their token, so that a query reads the buckets of its own tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.language import date_tokens, identifier_parts, token_set
from ..functions.query import query_keys, query_parts, relevance_terms, word_forms
from ..functions.scalars import osa
from ..functions.text import tokens
from .search import neighbours_of_tokens

BUCKETS = 64
#: Pieces of a bucket that are sorted and written apart.
SLICES = 4


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def indexed(messages: DataFrame) -> DataFrame:
    """Token, session_id, seq of each message's words, parts of identifiers and date."""
    keys = F.array_distinct(F.concat(token_set(F.col("text")), identifier_parts(F.col("text")), F.coalesce(date_tokens(F.col("ts")), F.array().cast("array<string>"))))
    return messages.select(F.explode(keys).alias("token"), "session_id", "seq")


def write_postings(messages: DataFrame, path: str) -> None:
    """Postings by bucket, sorted within, each once."""
    rows = indexed(messages).withColumn("bucket", _bucket(F.col("token")))
    rows.repartition("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS * SLICES))).sortWithinPartitions("bucket", "token", "session_id", "seq").write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """The postings of some tokens: only their buckets are listed, and files are skipped by their tokens' range."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in tokens] or [("",)], "t string").select(_bucket(F.col("t"))).distinct().collect()]  # at most BUCKETS numbers
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)).drop("bucket")


def holding(postings: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Sessions of the messages that hold a variant of every term, with how many such messages. The variants are a query's, so few."""
    rows = [(term, v) for term, vs in variants.items() for v in dict.fromkeys(vs)]
    if not rows:
        return postings.select("session_id", F.lit(0).cast("long").alias("messages")).limit(0)
    wanted = postings.sparkSession.createDataFrame(rows, "term string, token string")
    met = postings.join(F.broadcast(wanted), "token").groupBy("session_id", "seq").agg(F.countDistinct("term").alias("n"))
    return met.where(F.col("n") == len(variants)).groupBy("session_id").agg(F.count("*").alias("messages"))


def exact(postings: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Sessions of messages that hold all of the longest keys of a query."""
    return holding(postings, {k: [k] for k in query_keys(query)[:most]})


def close(postings: DataFrame, query: str, longest: int = 3) -> DataFrame:
    """The same with each of the longest keys as a part of a token; the catalog is scanned once."""
    keys = query_keys(query)[:longest]
    catalog = postings.select("token").distinct()
    near = catalog.sparkSession.createDataFrame([(k,) for k in keys], "term string")
    pairs = catalog.join(F.broadcast(near), F.contains("token", F.col("term")))
    met = postings.join(pairs, "token").groupBy("session_id", "seq").agg(F.countDistinct("term").alias("n"))
    return met.where(F.col("n") == len(keys)).groupBy("session_id").agg(F.count("*").alias("messages"))


def known_forms(postings: DataFrame, terms: list[str], most: int = 8) -> dict[str, list[str]]:
    """Of each term's forms those that the archive holds, the term first, so many at most."""
    forms = {t: word_forms(t) for t in terms}
    asked = sorted({f for fs in forms.values() for f in fs})
    have = {r[0] for r in postings.where(F.col("token").isin(asked)).select("token").distinct().collect()}  # a query's forms, so few
    return {t: [f for f in fs if f in have][:most] for t, fs in forms.items()}


def stemmed(postings: DataFrame, query: str) -> DataFrame:
    """Sessions that hold a form of every term, if a term is long enough to have forms."""
    terms = query_parts(query)[0]
    if not any(len(t) >= 5 for t in terms):
        return holding(postings, {})
    forms = known_forms(postings, terms)
    return holding(postings, forms if all(forms.values()) else {})


def spelled(postings: DataFrame, query: str, nearest: int = 8, common: int = 200) -> DataFrame:
    """Sessions that hold every term or one of its nearest spellings: one edit away, two from eight characters on.

    Terms that so many postings hold are spelled right; short ones aren't tried.
    """
    terms = query_parts(query)[0]
    asked = postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    count = postings.where(F.col("token").isin(terms)).groupBy("token").count()
    right = {r["token"] for r in count.where(F.col("count") >= common).collect()}
    catalog = postings.select("token").distinct()
    tried = asked.where((F.char_length("term") >= 4) & ~F.col("term").isin([*right] or [""]))
    limit = F.when(F.char_length("term") >= 8, 2).otherwise(1)
    pairs = catalog.join(F.broadcast(tried), F.abs(F.char_length("token") - F.char_length("term")) <= limit)
    pairs = pairs.where(F.levenshtein("term", "token", 4).between(0, 2 * limit))  # a swap is two plain edits; few pairs are left for Python
    pairs = pairs.withColumn("d", osa(F.col("term"), F.col("token"))).where(F.col("d") <= limit)
    nth = F.row_number().over(Window.partitionBy("term").orderBy("d", "token"))
    variants = {t: [t] for t in terms}
    for r in pairs.withColumn("nth", nth).where(F.col("nth") <= nearest).collect():  # a query's terms, so few
        variants[r["term"]].append(r["token"])
    return holding(postings, variants)


def by_neighbours(postings: DataFrame, query: str) -> DataFrame:
    """Sessions that hold all terms but one, and a token that often occurs in the sessions of that one."""
    terms = query_parts(query)[0]
    out = holding(postings, {})
    held = postings.select("session_id", F.explode(tokens(F.col("token"))).alias("token")).where(F.col("token").isin(terms))
    often = held.groupBy("token").agg(F.countDistinct("session_id").alias("n")).where("n >= 3")
    terms_met = [r["token"] for r in often.collect()]  # a query's terms, so few
    if not terms_met:
        return out
    near = neighbours_of_tokens(postings, "session_id", "token", of=terms_met).collect()  # six a term
    for t in terms:
        own = [r["neighbour"] for r in near if r["token"] == t]
        if own:
            out = out.unionByName(holding(postings, {u: own if u == t else [u] for u in terms}))
    return out.groupBy("session_id").agg(F.max("messages").alias("messages"))


TIERS = (("exact", exact), ("close", close), ("stemmed", stemmed), ("spelled", spelled), ("neighbours", by_neighbours))


def ladder(postings: DataFrame, query: str) -> DataFrame:
    """session_id, messages and the tier of the first tier that finds anything."""
    for name, tier in TIERS:
        found = tier(postings, query)
        if not found.isEmpty():
            return found.withColumn("tier", F.lit(name))
    return holding(postings, {}).withColumn("tier", F.lit("none"))


def term_counts(postings: DataFrame, query: str) -> DataFrame:
    """How many sessions hold each term of a query, none for those that nothing holds."""
    terms = postings.sparkSession.createDataFrame([(t,) for t in dict.fromkeys([*query_parts(query)[0], *relevance_terms(query)])], "term string")
    own = postings.groupBy(F.col("token").alias("term")).agg(F.countDistinct("session_id").alias("sessions"))
    return F.broadcast(terms).join(own, "term", "left").select("term", F.coalesce("sessions", F.lit(0)).alias("sessions"))
