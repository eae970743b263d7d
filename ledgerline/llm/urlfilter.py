"""URL verdicts: explicit rules first, else empirical-Bayes reputation of the host.

Labelled page outcomes are shrunk level by level: a suffix towards the whole table, a registered domain towards its
suffix, a host towards its domain. Each level's prior is a beta distribution with the parent's posterior mean and with a
strength that is fitted to the spread of its children's rates by moments. A host is blocked where the lower bound of its
posterior, a quantile of the beta distribution, is above a threshold: where its rate is above it with a high probability.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

#: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path as one text) that fits and its verdict; the longest wins, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(list(zip(fits, values))), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain of a host, user and port aside; suffixes are those of two labels, any other last label
    is one. A host of a single label is its own domain; an address is suffix and domain in one."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two, address = last(2).isin(*suffixes), bare.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, bare).when(two, last(2)).otherwise(last(1)), F.when(address, bare).when(two, last(3)).otherwise(last(2))


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, distinct, and other columns) with their suffix and registered domain by a table suffixes (suffix).

    Its rows are written as public lists of suffixes are: `co.uk`; `*.ck` for any one label before ck; `!www.ck` for a
    name that is registered although such a row covers it. The longest row that fits wins, an exception before all; where
    none fits the last label is the suffix. Null, empty and repeated rows of suffixes change nothing. A host that is a
    suffix is its own domain, an address suffix and domain in one.
    """
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    labels, address = F.split(bare, r"\."), bare.rlike(r"^[0-9.]+$|^\[")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    rule = F.lower(F.trim("suffix"))
    more = F.when(rule.startswith("!"), -1).when(rule.startswith("*."), 1).otherwise(0)
    rules = suffixes.where(F.trim("suffix") != "").select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("ending"), more.alias("more")).distinct()
    endings = hosts.select("host", F.size(labels).alias("size"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k")).withColumn("ending", last(F.col("k")))
    fits = endings.join(rules, "ending").where("k + more BETWEEN 1 AND size")
    best = fits.groupBy("host").agg(F.max(F.struct(F.col("more") == -1, F.col("k") + F.col("more"))).alias("best"))
    taken = F.coalesce(F.col("best.col2"), F.lit(1))
    named = lambda n: F.when(address, bare).otherwise(last(n))
    return hosts.join(best, "host", "left").withColumns({"suffix": named(taken), "domain": named(taken + 1)}).drop("best")


STEPS = 400  # intervals of the integrals on either side of the threshold
WIDE = 12.0  # standard deviations beyond which only the tails' closed forms count


def above(a: Column, b: Column, threshold: float) -> Column:
    """Probability that a beta-distributed rate with parameters a and b is above threshold.

    In z = log(t / (1 - t)) the density is smooth, exp(a log t + b log(1 - t)); both sides of the threshold are integrated
    by Simpson's rule, and beyond WIDE standard deviations the tails are exponential.
    """
    z = float(np.log(threshold / (1 - threshold)))
    middle, spread = F.log(a / b), F.sqrt(1 / a + 1 / b)
    low, high = F.least(F.lit(z), middle - F.lit(WIDE) * spread), F.greatest(F.lit(z), middle + F.lit(WIDE) * spread)
    log_t = lambda x: -F.when(x > 0, F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)) - x)
    density = lambda x: F.exp(a * (log_t(x) - log_t(middle)) + b * (log_t(-x) - log_t(-middle)))

    def integral(start: Column, end: Column) -> Column:
        step = (end - start) / F.lit(float(STEPS))
        weight = lambda k: F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, k: acc + weight(k) * density(start + k * step))
        return total * step / 3

    over = integral(F.lit(z), high) + density(high) / b
    return over / (over + integral(low, F.lit(z)) + density(low) / a)


def reputation(outcomes: DataFrame, threshold: float = 0.25, suffixes: tuple[str, ...] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, host_pages, host_bad, above) of labelled pages (host, bad 0/1): above is the posterior probability that a
    host's rate of bad pages is above threshold; the posterior's lower bound at 1 - p is above it where above > p.

    A level's strength is m = p(1-p) / v - 1, with p the rate of all pages and v the variance of the children's rates
    around it beyond binomial noise; children of one page say nothing about v. A prior weighs as much as one page at least
    and as all labelled pages at most, which it does where children differ by no more than noise. suffixes are endings of
    two labels, or a table of them as `registered` takes it. Rows with a null host
    or outcome are left out; repeated rows count one by one; no labelled page at all gives an empty table.
    """
    hosts = outcomes.where("host IS NOT NULL AND bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    if isinstance(suffixes, DataFrame):
        hosts = written(registered(hosts, suffixes))
    else:
        suffix, domain = suffix_and_domain(F.col("host"), suffixes)
        hosts = written(hosts.withColumn("suffix", suffix).withColumn("domain", domain))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("domain_n"), F.sum("bad").alias("domain_bad"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_bad").alias("suffix_bad"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = whole["bad"] / whole["n"] if whole["n"] else 0.0

    def strength(children: DataFrame, n: str, bad: str) -> float:
        """The beta prior's strength for children with n pages of which bad are bad."""
        off = F.col(bad) / F.col(n) - F.lit(rate)
        spread = children.where(F.col(n) > 1).agg((F.sum(off * off * F.col(n)) / F.sum(n)).alias("v"), (F.count("*") * rate * (1 - rate) / F.sum(n)).alias("noise")).first()
        beyond = (spread["v"] or 0.0) - (spread["noise"] or 0.0)
        most = float(whole["n"] or 1)
        return max(1.0, min(most, rate * (1 - rate) / beyond - 1)) if beyond > 0 else most

    m1, m2, m3 = strength(suffixes_, "suffix_n", "suffix_bad"), strength(domains, "domain_n", "domain_bad"), strength(hosts, "n", "bad")
    shrunk = lambda bad, n, m, prior: (F.col(bad) + F.lit(m) * prior) / (F.col(n) + F.lit(m))
    by_domain = shrunk("domain_bad", "domain_n", m2, shrunk("suffix_bad", "suffix_n", m1, F.lit(rate)))
    joined = hosts.join(domains, ["suffix", "domain"]).join(suffixes_, "suffix").withColumn("prior", by_domain)
    # never an empty side: a rate of 0 or 1 in the whole table leaves a millionth of a page for the other
    a = F.greatest(F.col("bad") + F.lit(m3) * F.col("prior"), F.lit(1e-6))
    b = F.greatest(F.col("n") - F.col("bad") + F.lit(m3) * (1 - F.col("prior")), F.lit(1e-6))
    rows = joined.select("host", F.col("n").alias("host_pages"), F.col("bad").alias("host_bad"), a.alias("a"), b.alias("b"))
    return rows.select("host", "host_pages", "host_bad", above(F.col("a"), F.col("b"), threshold).alias("above"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.25, sure: float = 0.95, suffixes: tuple[str, ...] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, host_pages, host_bad.

    outcomes holds (page_id, bad) of labelled pages; several outcomes of one page count as bad if one is. Without a
    rule, a host is blocked where its bad rate is above threshold with a posterior probability over sure: where the
    posterior's lower bound is. suffixes are as in `reputation`. Unknown and empty hosts are allowed. Repeated rows are judged one by one; an empty table
    gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    # counts go through the hosts, so a hot host is summed before it is shuffled
    # and the hosts' scores are written, so that adaptive execution can split it in the join below
    scores = written(reputation(rows.where("host <> ''").join(known, "page_id").select("host", "bad"), threshold, suffixes))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("above") > sure, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("host_pages", F.lit(0)).cast("long").alias("host_pages"),
        F.coalesce("host_bad", F.lit(0)).cast("long").alias("host_bad"),
    )
