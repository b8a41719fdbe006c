"""Retrieval and ranking over messages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idf, tokens, words
from ..sources.scratch import kept

#: Sessions whose pairs of tokens one task counts.
SESSIONS = 1000


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Token and key, a row for each token of each text."""
    return texts.select(key, F.explode(tokens(F.col(text))).alias("token"))


def token_catalog(texts: DataFrame, session: str, text: str = "text", most: int = 25) -> DataFrame:
    """Sessions of each token, and its messages, at most so many a session."""
    each = texts.select(session, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", session).agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.count("*").alias("sessions"), F.sum(F.least(F.col("n"), F.lit(most))).alias("units"))


def containing(texts: DataFrame, terms: list[str], phrases: list[str] = (), text: str = "text") -> DataFrame:
    """Rows that hold every term and phrase as a substring, in any case."""
    low = F.lower(F.col(text))
    for t in (*terms, *phrases):
        texts = texts.where(F.contains(low, F.lit(t.lower())))
    return texts


def matching(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows that the regular expression finds, in any case."""
    return texts.where(F.col(text).rlike(f"(?i){pattern}"))


def bm25(texts: DataFrame, terms: list[str], key: str, text: str = "text", is_user: Column | None = None) -> DataFrame:
    """BM25 (k1 = 1.2, b = 0.75) over the sessions that hold a term; turns of users count 30 % more.

    A session's length is the geometric mean of its words and of the words of its texts that hold a term.

    One pass counts every term's occurrences per session; corpus figures are one row, joined back by broadcast.
    """
    user = is_user if is_user is not None else F.lit(False)
    own = texts.select(key, words(F.col(text)).alias("w"), user.alias("u"))
    tf = lambda t: F.size(F.filter("w", lambda x: x == t))
    held = F.arrays_overlap("w", F.array(*map(F.lit, terms)))
    per = own.groupBy(key).agg(F.floor(F.sqrt((F.sum(F.size("w")) * F.sum(F.when(held, F.size("w")).otherwise(0))).cast("double"))).alias("len"), *(F.sum(tf(t)).alias(f"tf{i}") for i, t in enumerate(terms)), *(F.sum(F.when(F.col("u"), tf(t)).otherwise(0)).alias(f"ut{i}") for i, t in enumerate(terms)))
    per = per.where(sum(F.col(f"tf{i}") for i in range(len(terms))) > 0)
    corpus = per.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    norm = F.col("len") / F.col("avg") * 0.75 + 0.25
    part = lambda i: idf(F.col("n"), F.col(f"df{i}")) * (F.col(f"tf{i}") * 2.2 + F.col(f"ut{i}") * 2.2 * 0.3) / (F.col(f"tf{i}") + norm * 1.2)
    return per.crossJoin(F.broadcast(corpus)).select(key, F.round(sum(part(i) for i in range(len(terms))), 9).alias("score"))


def top(ranked: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The first k by score, ties to the smaller key."""
    return ranked.orderBy(F.desc(score), key).limit(k)


def fused(a: DataFrame, b: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two lists of (key, place)."""
    x, y = a.withColumnRenamed("place", "pa"), b.withColumnRenamed("place", "pb")
    gain = lambda c: F.coalesce(1 / (F.col(c) + k), F.lit(0.0))
    return x.join(y, key, "full").select(key, F.round(gain("pa") + gain("pb"), 9).alias("score"))


def sampled_postings(post: DataFrame, session: str, order: str, budget: int) -> DataFrame:
    """Of each session's rows at most so many, evenly spread."""
    by = Window.partitionBy(session)
    n, total = F.row_number().over(by.orderBy(order, "token")) - 1, F.count("*").over(by)
    rows = post.withColumn("i", n).withColumn("total", total)
    keep = F.floor(F.col("i") * budget / F.col("total")) != F.floor((F.col("i") + 1) * budget / F.col("total"))
    return rows.where((F.col("total") <= budget) | keep).drop("i", "total")


def neighbours_of_tokens(texts: DataFrame, session: str, text: str = "text", most: int = 6, of: list[str] | None = None) -> DataFrame:
    """Tokens that share sessions: rare enough, the 64 rarest of a session, in three sessions together, six a token.

    of: only the neighbours of these few tokens; only their sessions are looked into.
    """
    per = texts.select(session, F.explode(tokens(F.col(text))).alias("token")).where(F.octet_length("token") >= 4).distinct()
    n = texts.agg(F.countDistinct(session).alias("n"))
    df = per.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= 3) & (F.col("df") <= F.greatest(F.lit(8), F.floor(F.col("n") / 4)))).select("token", "df")
    looked = per if of is None else per.join(per.where(F.col("token").isin(of)).select(session).distinct(), session, "left_semi")
    rare = looked.join(df, "token").withColumn("r", F.row_number().over(Window.partitionBy(session).orderBy("df", "token"))).where("r <= 64").select(session, "token")
    own = kept(rare.where(F.col(session).isNotNull()).groupBy(session).agg(F.array_sort(F.collect_list("token")).alias("own")))  # 64 at most
    parts = max(own.sparkSession.sparkContext.defaultParallelism, own.count() // SESSIONS + 1)  # a session gives up to 2,016 pairs, so a task's pairs are bounded
    each = own.repartition(parts, session).select("own", F.posexplode("own").alias("i", "token")).select("token", F.explode(F.slice("own", F.col("i") + 2, F.lit(64))).alias("neighbour"))
    if of is not None:
        each = each.where(F.col("token").isin(of) | F.col("neighbour").isin(of))
    once = each.groupBy("token", "neighbour").agg(F.count("*").alias("sessions")).where("sessions >= 3")
    pair = lambda a, b: F.struct(F.col(a).alias("token"), F.col(b).alias("neighbour"))
    pairs = once.select("sessions", F.inline(F.array(pair("token", "neighbour"), pair("neighbour", "token")))).select("token", "neighbour", "sessions")
    pairs = pairs if of is None else pairs.where(F.col("token").isin(of))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("sessions"), "neighbour"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def cosines(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vec_id and score of all vectors against one query vector (one row, which is broadcast); 0 for other lengths and without a norm."""
    q = query.select(F.col("embedding").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    rows = vectors.crossJoin(F.broadcast(q))
    score = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    same = F.size("embedding") == F.size("q")
    return rows.select("vec_id", F.round(F.when(same, F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))).otherwise(0.0), 6).alias("score"))


def cosine_to(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors nearest to one query vector by cosine."""
    return cosines(vectors, query).orderBy(F.desc("score"), "vec_id").limit(k)


def semantic(vectors: DataFrame, query: DataFrame, session: str, floor: float = 0.55, k: int = 10) -> DataFrame:
    """The best message of each session whose cosine reaches the floor, the first k sessions."""
    scored = cosines(vectors, query).where(F.col("score") >= floor).join(vectors.select("vec_id", session), "vec_id")
    best = scored.groupBy(session).agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("b"))
    return best.select(session, (-F.col("b.v")).alias("vec_id"), F.col("b.score").alias("score")).orderBy(F.desc("score"), session).limit(k)
