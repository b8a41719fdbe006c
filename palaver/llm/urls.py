"""URL filters: rules by host and path, and for the rest trust and distrust that spread over the links between hosts.

The longest rule that fits decides. What no rule fits is judged by its host: pages that rules allow give their host a unit
of trust each, pages that rules block one of distrust. Trust spreads as personalised PageRank along the links between
hosts, distrust against them, to those that link to blocked ones: each host passes ``DAMPING`` percent of what newly came in
to its neighbours in equal parts, and what has come in by then is summed up. A host is blocked if its distrust is more than
``MOST_PERCENT`` percent of its trust. Links are those in the pages' html that name another host, and one each way between
a host and the nearest of its parent domains that has pages. DataFrame functions only; units are whole millionths, so that
sums don't depend on their order.

Rounds end when nothing is passed on any more, or after ``ROUNDS``; each reads and writes tables with a row per host or link,
and only hosts that something newly reached take part. Pages of a host are counted before they are shuffled, and verdicts go
back to the pages by broadcast only while there are at most ``BROADCAST_HOSTS``; beyond, Spark's skew join deals hot hosts out.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the verdict of a host that
nothing reaches, which is allow; an empty host gives and takes no trust. Of rules that fit the longest wins (host and path
together, then host), of equal ones the first; hosts are compared in lower case (A-Z), paths as they are. Pages without html
have no links. Repeated rows and ids are judged each, and their links count once; other columns aren't read; an empty table
gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UNIT, DAMPING, MOST_PERCENT, ROUNDS = 1_000_000, 85, 100, 20
#: Hosts whose verdicts are broadcast to the pages, at most.
BROADCAST_HOSTS = 200_000
#: A link to another host in html: its host.
LINK = r"""(?i)href[ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:https?:)?//([^/?#"'<> \t\n\r\f]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _parents(hosts: DataFrame) -> DataFrame:
    """a, b: each way between a host and the nearest of its parent domains, of two labels at least, among the hosts."""
    labels = F.split("host", "[.]")
    upper = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: i < F.size(labels)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("up")))
    found = hosts.select("host", F.explode(upper).alias("x")).select("host", "x.*").join(hosts.select(F.col("host").alias("up")), "up")
    nearest = found.groupBy("host").agg(F.min(F.struct("at", "up"))["up"].alias("up"))
    return nearest.select(F.col("host").alias("a"), F.col("up").alias("b")).unionByName(nearest.select(F.col("up").alias("a"), F.col("host").alias("b")))


def links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """a, b: different hosts of which a links to b, once each; pages (host, html), hosts (host)."""
    named = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    linked = pages.where("host != ''").select(F.col("host").alias("a"), F.explode(named).alias("b"))
    return linked.unionByName(_parents(hosts)).where("a != b").distinct()


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """host, trust, distrust of every host that any reaches; seeds (host, trust, distrust)."""
    both = links.selectExpr("true AS forward", "a", "b").unionByName(links.selectExpr("false AS forward", "b AS a", "a AS b"))
    ways = stored(both.join(both.groupBy("forward", "a").agg(F.count("*").alias("ways")), ["forward", "a"]))
    new = stored(seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit(True), F.lit(False)), F.array("trust", "distrust")))).toDF("host", "forward", "mass").where("mass > 0"))
    all_ = [new]
    for _ in range(rounds):
        passed = new.withColumnRenamed("host", "a").join(ways, ["forward", "a"]).select("forward", F.col("b").alias("host"), F.expr(f"mass * {damping} DIV (100 * ways)").alias("mass"))
        new = stored(passed.where("mass > 0").groupBy("host", "forward").agg(F.sum("mass").alias("mass")))
        if new.isEmpty():
            break
        all_.append(new)
    total = reduce(DataFrame.unionByName, [x.select("host", "forward", "mass") for x in all_])
    return total.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("forward") == way, F.col("mass"))), F.lit(0)).alias(name) for way, name in ((True, "trust"), (False, "distrust"))))


def judged(pages: DataFrame, rules=RULES, most_percent: int = MOST_PERCENT, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and its host's trust and distrust in millionths of a page."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = split.select("*", rule.alias("rule"), verdict.alias("ruled"))
    seeds = stored(ruled.where("host != ''").groupBy("host").agg(*((UNIT * F.count_if(F.col("ruled") == what)).alias(name) for what, name in (("allow", "trust"), ("block", "distrust")))))
    between = links(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), seeds.select("host"))
    hosts = stored(spread(between, seeds))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    out = ruled.join(hosts, "host", "left").fillna(0, ["trust", "distrust"])
    worse = F.col("distrust") * F.lit(100).cast("decimal(20)") > F.col("trust") * F.lit(most_percent).cast("decimal(20)")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(worse, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
