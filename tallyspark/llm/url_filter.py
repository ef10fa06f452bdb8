"""URL filtering: longest matching rule, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages shrink through beta-binomial priors: all pages -> suffix -> registered
domain -> host. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Least and greatest weight of a level's prior, z of the bound, and the multiple of the overall bad share (at most MOST_SHARE) above which a host is blocked.
LEAST_WEIGHT, MOST_WEIGHT, BOUND_Z, BAD_RATIO, MOST_SHARE = 1.0, 1000.0, 1.645, 1.5, 0.95
#: Public suffixes of two labels.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za"]


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, h, p in rules:
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def host_levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is a host's last label, or its last two if SUFFIXES has them; the domain has one label more."""
    labels = F.split(host, r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    two = last(2).isin(SUFFIXES)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def _shrunk(bad, n, prior, weight):
    return (bad + weight * prior) / (n + weight)


def prior_weight(groups: DataFrame) -> DataFrame:
    """One row: the strength of a beta prior for groups (n, bad), by moments: p(1 - p) / (variance between groups) - 1, within bounds."""
    whole = groups.agg((F.sum("bad") / F.sum("n")).alias("p"))
    n, share = F.col("n"), F.col("bad") / F.col("n")
    sums = groups.crossJoin(F.broadcast(whole)).agg(F.first("p").alias("p"), F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(n * n).alias("squares"), F.sum(n * (share - F.col("p")) * (share - F.col("p"))).alias("q"))
    noise = F.col("p") * (1 - F.col("p"))
    between = (F.col("q") - (F.col("k") - 1) * noise) / F.nullif(F.col("total") - F.col("squares") / F.col("total"), F.lit(0.0))
    weight = F.when(F.round(between, 12) > 0, F.least(F.greatest(noise / between - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(F.lit(MOST_WEIGHT))
    return sums.select(weight.alias("weight"))


def host_reputation(outcomes: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """host, n, bad, mean, low, cut from outcomes (host string, bad 0/1).

    mean is the posterior mean of the bad share, low its lower bound by the normal approximation of the
    beta posterior, cut the share above which low blocks. The strength of each level's prior comes from how
    much its groups differ. Only hosts with outcomes are listed; rows with null bad are left out, and those with an
    empty host, which is no host that urls could share.
    """
    domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.where("bad is not null and host != ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    whole = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("p_all"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    with_weight = lambda level: level.crossJoin(F.broadcast(prior_weight(level)))
    suffixes = with_weight(suffixes).crossJoin(F.broadcast(whole)).select("suffix", "p_all", _shrunk(F.col("bad"), F.col("n"), F.col("p_all"), F.col("weight")).alias("p_suffix"))
    domains = with_weight(domains).join(suffixes, "suffix").select("domain", "p_all", _shrunk(F.col("bad"), F.col("n"), F.col("p_suffix"), F.col("weight")).alias("p_domain"))
    mean = _shrunk(F.col("bad"), F.col("n"), F.col("p_domain"), F.col("weight"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    out = with_weight(hosts).join(domains, "domain").withColumn("mean", mean)
    return out.select("host", "n", "bad", "mean", (F.col("mean") - z * sd).alias("low"), F.least(BAD_RATIO * F.col("p_all"), F.lit(MOST_SHARE)).alias("cut"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share_low for every row of pages.

    pages: page_id, url. outcomes: page_id, bad (0/1), labelled outcomes of some pages; several
    outcomes of a page all count. A url matched by rules has the verdict of the longest one (of equal
    length the later rule text). Other urls are blocked if the lower bound of their host's bad share is
    above BAD_RATIO times the overall one; hosts without outcomes are allowed.

    A url that is null or has no :// has an empty host and path, and no reputation. Null page_id rows have no outcomes.
    Repeated rows are judged each. Empty tables give no rows, or no reputations. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = outcomes.select(F.col("page_id").alias("label_id"), F.col("bad").cast("int").alias("bad"))
    seen = judged.join(labels, judged["page_id"] == labels["label_id"]).select("host", "bad")
    standing = host_reputation(seen).select(F.col("host").alias("known_host"), "low", "cut")
    judged = judged.join(standing, judged["host"] == standing["known_host"], "left")
    found = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("found", found)
    own = F.when(F.round("low", 9) > F.round("cut", 9), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.col("low").alias("bad_share_low"))
