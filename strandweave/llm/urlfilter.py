"""URL filters: fixed host and path rules, else empirical-Bayes reputation of the host.

Pages with a label are outcomes (bad or not).  Bad rates are beta-binomial on four
levels: all pages, suffix, registered domain, host.  Each level's prior is a beta
distribution around the parent's posterior mean; its strength is fitted to the spread of
the level's own rates by the method of moments,
    strength = max(MIN, min(MAX, (m (1 - m) - s2) / (s2 - m (1 - m) c / n)))
with m the overall rate, s2 the outcome-weighted variance of the c rates and n outcomes.
A host is blocked if even the lower bound of its bad rate, posterior mean minus Z posterior
standard deviations, is above THRESHOLD.

A suffix is a host's last label, or its last two where they are in TWO_LEVEL; the
registered domain has one label more.  Rules fit their host and its subdomains where
the path starts with the rule's path; the longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path; hosts
without outcomes get their parents' means; without any outcome the rate is that of
PRIOR; rows that repeat a page id count each; null labels are no outcomes; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_safe_join

#: Second-level labels that act as suffixes.
TWO_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
PRIOR = (1.0, 9.0)
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
Z = 1.645
THRESHOLD = 0.25


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, then path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LEVEL), two).otherwise(last)


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LEVEL), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, n, bad (one row a host).  Adds mean, lower: the posterior of each host's bad rate."""
    top = outcomes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    rate = (top.b + PRIOR[0]) / (top.n + PRIOR[0] + PRIOR[1])
    rows = outcomes.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host")))
    rows = rows.withColumn("mean", F.lit(rate))
    for level in ("suffix", "domain", "host"):
        sums = rows.groupBy(level).agg(F.sum("n").alias("ln"), F.sum("bad").alias("lb"), F.count(F.lit(1)).alias("lk"))
        p = F.col("lb") / F.col("ln")
        got = sums.filter("ln > 0").agg(F.sum(F.col("ln") * (p - rate) * (p - rate)).alias("ss"), F.count(F.lit(1)).alias("c"), F.sum("ln").alias("n")).first()
        strength = MAX_STRENGTH
        if got.n:
            spread, noise = round(got.ss / got.n, 9), rate * (1 - rate)
            over = spread - noise * got.c / got.n
            strength = max(MIN_STRENGTH, min(MAX_STRENGTH, (noise - spread) / over)) if over > 0 else MAX_STRENGTH
        if level == "host":
            n, bad = F.col("n"), F.col("bad")
        else:
            rows = skew_safe_join(rows, sums, level, "lk").drop("lk")
            n, bad = F.col("ln"), F.col("lb")
        mean = (bad + F.col("mean") * strength) / (n + strength)
        rows = rows.withColumn("total", n + F.lit(strength)).withColumn("mean", mean).drop("ln", "lb")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))
    return rows.withColumn("lower", F.col("mean") - Z * sd).select("host", "mean", "lower")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_lower.  labels: page_id, bad (boolean)."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    # One outcome a page id: more than one label of a page is bad if any is.
    known = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    told = rows.select("page_id", "host").join(known, "page_id")
    seen = told.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = materialize(hosts.join(seen, "host", "left").fillna(0, ["n", "bad"]), "hosts")
    known_hosts = materialize(reputation(hosts.select("host", "n", "bad")).join(hosts.select("host", "pages"), "host"), "reputation")
    rows = skew_safe_join(rows, known_hosts, "host", "pages").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("lower") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
