"""Crawl rules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.scan import max_plus


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, grp, agents, kind, prefix) from (host, robots): consecutive User-agent lines open a group; comments and
    empty values count for nothing."""
    lines = files.select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    parts = lines.select("host", "pos", F.lower(F.trim(F.regexp_extract("line", "^([^:]+):", 1))).alias("kind"), F.trim(F.regexp_extract("line", "^[^:]+:(.*)$", 1)).alias("value"))
    parts = parts.filter(F.col("kind").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("kind") == "user-agent") & ~F.lag("kind").over(w).eqNullSafe(F.lit("user-agent"))
    grouped = parts.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w))
    agents = grouped.filter("kind = 'user-agent'").groupBy("host", "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = grouped.filter("kind <> 'user-agent' and value <> ''").select("host", "grp", "kind", F.col("value").alias("prefix"))
    return rules.join(agents, ["host", "grp"])


def gate(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """pages with `allowed`: groups that name the agent beat those for all; the longest prefix wins, then the earlier
    group, then a Disallow; without a rule a page is allowed. A host's rules are few; they are gathered on its row, so
    pages meet hosts one to one."""
    named = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a))
    star = F.array_contains("agents", "*")
    usable = rules.withColumn("named", named).filter(F.col("named") | star)
    best = usable.groupBy("host").agg(F.bool_or("named").alias("any_named"), F.collect_list(F.struct("named", "grp", "kind", "prefix")).alias("rules"))
    own = best.select("host", F.filter("rules", lambda r: r["named"] == F.col("any_named")).alias("rules"))
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/"))
    joined = pages.withColumn("host", F.regexp_extract("url", "^https?://([^/?#]+)", 1)).join(own, "host", "left").withColumn("_path", path)
    hits = F.filter("rules", lambda r: F.startswith(F.col("_path"), r["prefix"]))
    ranked = F.array_sort(F.transform(hits, lambda r: F.struct((-F.length(r["prefix"])).alias("n"), r["grp"].alias("g"), (r["kind"] == "allow").cast("int").alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(F.get(ranked, F.lit(0))["allow"] == 1, F.lit(True))).drop("rules", "_path", "host")


def fetch_times(pages: DataFrame, gap_ms: int) -> DataFrame:
    """pages with at_ms, when each is to be fetched if all are wanted at once: requests to one host lie gap_ms apart."""
    hosts = pages.withColumn("host", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return throttled(hosts, ["host"], [F.asc("page_id")], F.lit(0), gap_ms, "at_ms").drop("host")


def throttled(requests: DataFrame, host: list[str], order: list[Column], arrival: Column, gap: int, name: str) -> DataFrame:
    """requests with the time at which each is let through: when it arrives, or gap after the one before it of its host if that is
    later. A request waits only when it must. Times are longs of one unit; a host of most requests is planned by many tasks."""
    return max_plus(requests, host, order, arrival, F.lit(gap), name)
