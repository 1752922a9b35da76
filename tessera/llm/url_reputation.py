"""URL filtering by host rules and empirical-Bayes host reputation (operator 11).

Labelled page outcomes are counted by host, registered domain and suffix.  A host's share of bad
pages has a beta prior whose mean is its domain's posterior mean, a domain's prior has its suffix's
and a suffix's the share of all.  How strongly each level holds on to its prior comes from the
counts themselves: the beta-binomial concentration by the method of moments.  A host is blocked
if even the lower bound of its posterior share (mean less z standard deviations) is over a limit.

Rules come first: the longest one that fits a URL decides, reputation decides the rest.

Hosts are counted by partial aggregates.  A row finds its host's posterior by a shuffle, but for
the hosts with over a thousandth of all rows, which are a thousand at most and are broadcast, so a
host with a third of all pages never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import looked_up, written

#: Bounds of a level's concentration, and its value where no unit has two labelled pages.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 10_000.0, 10.0
#: Suffixes of more than one label, below which names are registered; parameter suffixes has others.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za")

_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end, as it stands; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, without user and port; an IPv4 address is its own domain without a suffix."""
    bare = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    known = F.regexp_extract(bare, "(?:^|\\.)(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$", 1) if suffixes else F.lit("")
    number = bare.rlike("^[0-9]+(\\.[0-9]+){3}$")
    suffix = F.when(number, "").when(known != "", known).otherwise(F.substring_index(bare, ".", -1))
    head = F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    domain = F.when(number, bare).when(F.length(bare) <= F.length(suffix) + 1, suffix).otherwise(F.concat(F.substring_index(head, ".", -1), F.lit("."), suffix))
    return suffix, domain


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Of rules of one
    length the one with the longer host wins, then block.  Rules are few: they become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _concentration(units: DataFrame) -> float:
    """Concentration of the beta-binomial that fits units (bad, n, prior) by the method of moments."""
    plain = F.expr("n * prior * (1 - prior)")
    s = units.agg(F.sum(F.expr("(bad - n * prior) * (bad - n * prior)") - plain).alias("excess"), F.sum(plain * F.expr("n - 1")).alias("pairs")).first()
    if not s.pairs or s.pairs <= 0:
        return UNKNOWN
    share = s.excess / s.pairs  # 1 / (concentration + 1)
    return STRONGEST if share <= 1 / (STRONGEST + 1) else max(WEAKEST, 1 / share - 1)


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, rows, n, bad, mean, spread) for each host of pages (page_id, host); outcomes: (page_id, bad).

    mean and spread: the posterior mean and standard deviation of the host's share of bad pages.
    An id with several outcomes is bad if one of them is; null ids and null outcomes count for
    nothing.  Every row of pages counts, repeated ones too.  Without outcomes all means are 0.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    judged = pages.join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = pages.groupBy("host").agg(F.count("*").alias("rows"))
    none = F.lit(0).cast("long")
    both = counted.select("host", "rows", none.alias("n"), none.alias("bad")).unionByName(judged.select("host", none.alias("rows"), "n", "bad"))
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = written(both.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "bad"))).select("*", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    sums = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    share = (sums.bad or 0) / sums.n if sums.n else 0.0

    def level(units: DataFrame) -> DataFrame:
        """units (bad, n, prior, ...) with the posterior's a and b."""
        held = _concentration(units)
        a, b = F.col("prior") * held + F.col("bad"), (1 - F.col("prior")) * held + F.col("n") - F.col("bad")
        return units.select("*", (a / (a + b)).alias("mean"), (a + b).alias("weight"))

    def grouped(by: str, *more: str) -> DataFrame:
        return hosts.groupBy(by, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("names"))

    tops = level(grouped("suffix").withColumn("prior", F.lit(share)))
    domains = written(grouped("domain", "suffix"), "domains")
    tops = tops.select("suffix", F.col("mean").alias("prior")).join(domains.groupBy("suffix").agg(F.count("*").alias("under")), "suffix")
    domains = level(looked_up(domains, written(tops, "suffixes"), "suffix", "under"))
    domains = written(domains.select("domain", F.col("mean").alias("prior"), F.col("names").alias("under")), "domains")
    found = level(looked_up(hosts, domains, "domain", "under"))
    return found.select("host", "rows", "n", "bad", "mean", F.sqrt(F.expr("mean * (1 - mean) / (weight + 1)")).alias("spread"))


def judged_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float, z: float, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) of every row of pages (page_id, url).

    verdict: the rule's, else block where bound, the posterior mean less z spreads of the host's
    share of bad pages, is over limit, else allow.  Null and odd URLs have the host '', which is
    judged like any other; repeated rows are all returned; an empty table gives none; columns of
    pages besides page_id and url don't matter.  See reputations for outcomes.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = written(reputations(rows, outcomes, suffixes).select("host", "rows", "mean", (F.col("mean") - z * F.col("spread")).alias("bound")), "reputations")
    found = looked_up(rows, hosts, "host", "rows")
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "mean", "bound")
