"""Host reputation by empirical Bayes, and URL rules.

Labelled page outcomes (bad or not) are counted for each host, then shrunk through beta-binomial priors
along suffix -> registered domain -> host: each level's posterior mean is the prior mean of the level
below, and the prior's strength is estimated from the spread between the groups of that level (method of
moments). A page whose url no rule decides is blocked if the lower bound of its host's posterior bad rate
exceeds `limit`.

A suffix is a host's last label, or its last two where SUFFIXES has them; a registered domain is one label more. A user, a port and
final dots don't count; addresses are domains of their own.

Only aggregates leave the scan: counts by host are summed before the shuffle, so a host with a third of all
pages costs one row a task, and are written once; pages then meet their host's row in a left join whose page side Spark
can split.

Defined results: a null url, or one without `://`, has empty host and path and shares the reputation of the
empty host; pages without label count for nothing; repeated pages are judged alike, and each labelled repeat
counts; labels repeated for one page count as bad if any of them is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.staging import Stage
from waymark.llm.text import LOWER, UPPER

# Suffixes of two labels under which hosts are registered by the public, of the larger registries. A suffix
# that is not listed counts by its last label; pass a fuller list where the corpus needs one.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe",
    "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.in",
    "edu.tw", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "ne.jp", "net.au", "net.br", "net.cn",
    "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "sch.uk",
)

#: (verdict, host, path); the longest that fits a url wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LEVELS = ("suffix", "domain", "host")
#: Hosts that are addresses, which share a prior of their own.
ADDRESS, NO_SUFFIX = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$", "#address"
MIN_STRENGTH, MAX_STRENGTH, Z, LIMIT = 2.0, 1000.0, 1.645, 0.5


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host and path of each url."""
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def _levels(hosts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """hosts with the domain and suffix of their names: user, port and final dots are no part of a name, and an address is a domain of its own."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    last = lambda n: F.substring_index("_name", ".", -n)
    two = last(2).isin(list(suffixes)) if suffixes else F.lit(False)
    address = F.col("_name").rlike(ADDRESS)
    named = {
        "domain": F.when(address, F.col("_name")).when(two, last(3)).otherwise(last(2)), "suffix": F.when(address, NO_SUFFIX).when(two, last(2)).otherwise(last(1)),
    }
    return hosts.withColumn("_name", name).withColumns(named).drop("_name")


def host_counts(urls: DataFrame, labels: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """suffix, domain, host, n labelled pages and those that are bad, for every host."""
    outcome = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int")).alias("bad")
    )
    joined = urls.select("page_id", "host").join(outcome, "page_id", "left")
    return _levels(joined.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), suffixes)


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Overall bad rate and the prior's strength, from six sums over the groups of a level."""
    r = groups.filter("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("s"),
    ).first()
    if not r["n"]:
        return 0.0, MAX_STRENGTH
    m = r["bad"] / r["n"]
    within, size = m * (1 - m), r["n"] - r["nn"] / r["n"]
    between = (r["s"] - r["n"] * m * m - (r["k"] - 1) * within) / size if size > 0 else 0.0
    strength = within / between - 1 if between > 0 else MAX_STRENGTH
    return m, round(min(MAX_STRENGTH, max(MIN_STRENGTH, strength)), 6)


def reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """host, n, bad, rate (posterior mean) and bound (its lower bound), rounded to six places."""
    up = {
        "suffix": counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
        "domain": counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
    }
    (m, ks), (_, kd), (_, kh) = (_strength(g) for g in (up["suffix"], up["domain"], counts))
    shrunk = lambda n, bad, mean, k: (F.col(bad) + k * mean) / (F.col(n) + k)
    suffix = up["suffix"].select("suffix", shrunk("n", "bad", F.lit(m), ks).alias("m1"))
    domain = up["domain"].join(suffix, "suffix").select("domain", shrunk("n", "bad", F.col("m1"), kd).alias("m2"))
    a = F.col("bad") + kh * F.col("m2")
    b = F.col("n") - F.col("bad") + kh * (1 - F.col("m2"))
    rate = a / (a + b)
    bound = rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return counts.join(domain, "domain").select("host", "n", "bad", F.round(rate, 6).alias("rate"), F.round(bound, 6).alias("bound"))


def rule_of(rules: Sequence[tuple[str, str, str]] = RULES):
    """Columns (rule, verdict) of the longest rule that fits host and path. The rules are the caller's short
    list, compiled into one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """Verdict for every page, with the reputation behind it."""
    urls = split_url(pages)
    stage = Stage(pages.sparkSession, "hosts")
    table = stage.write(reputation(stage.write(host_counts(urls, labels), "counts")), "reputation")
    stage.drop("counts")
    rule, verdict = rule_of(rules)
    by_host = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return urls.join(table, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "rate", "bound",
    )
