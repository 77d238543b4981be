"""URL filters: rules by host and path, and the reputation of hosts by empirical Bayes, in DataFrame operations only.

Outcomes (1 good, 0 bad) of labelled pages are counted by site (a host without user, port and trailing dots), registered
domain and public suffix; an address is all three. Every level's rates follow a beta distribution whose mean is its parent's posterior mean and whose
strength is fitted by the method of moments over the level; so hosts with few pages lean on their domain, domains on
their suffix, suffixes on the whole. A host passes if the posterior's lower bound, mean less Z standard deviations,
reaches LEAST_GOOD. A host without labelled pages has its domain's posterior for its prior, and so on up.

A rule `host/path` fits its host and subdomains, if the page's path starts with the rule's; the longest that fits
decides. Null urls and urls without :// have an empty host and path, fit no rule and have the reputation of the empty
host. Null outcomes aren't counted; repeated rows count each; empty tables give empty results or a prior of a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import checkpointed, fresh

#: The contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEAST_GOOD, Z = 0.5, 1.645
#: Bounds of a level's fitted strength, in pages.
STRENGTH = (2.0, 1000.0)
# Public suffixes of two labels, the commonest ones; callers may give others.
SUFFIX_PAIRS = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn",
    "gov.in", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn",
    "org.nz", "org.uk", "org.za",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host that reputations are kept by: without user, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"\.*(:[0-9]*)?$", "")


def is_address(site: Column) -> Column:
    """Four numbers, or an address in brackets; nothing is registered above it."""
    return site.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")


def suffix_of(site: Column, pairs=SUFFIX_PAIRS) -> Column:
    """The public suffix: the last label, or the last two where both are one; an address is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*pairs), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, pairs=SUFFIX_PAIRS) -> Column:
    """The registered domain: the public suffix and the label before it."""
    return F.when(is_address(site), site).when(F.substring_index(site, ".", -2).isin(*pairs), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, _, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict; null if none fits. One expression for each rule: for lists of hundreds."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    pick = lambda k: F.coalesce(*[F.when(_fits(r[1], host, path), F.lit(r[k])) for r in ordered], F.lit(None).cast("string"))
    return pick(1), pick(0)


def _shrunk(level: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """level: key, parent_key, n, good; parent: parent_key, mean. Adds the posterior's mean and strength."""
    joined = level.join(parent.select(parent_key, F.col("mean").alias("prior_mean")), parent_key)
    # moments: sum n (rate - prior)^2 = sum prior (1 - prior) (1 + (n - 1) rho), strength = 1 / rho - 1
    spread = F.col("prior_mean") * (1 - F.col("prior_mean"))
    fit = joined.agg(
        F.sum((F.col("good") - F.col("n") * F.col("prior_mean")) ** 2 / F.col("n")).alias("seen"),
        F.sum(spread).alias("least"),
        F.sum(spread * (F.col("n") - 1)).alias("slope"),
    )
    rho = F.when(F.col("slope") > 0, (F.col("seen") - F.col("least")) / F.col("slope"))
    strength = F.least(F.greatest(F.coalesce(1 / F.nullif(F.greatest(rho, F.lit(0.0)), F.lit(0.0)) - 1, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    fitted = joined.crossJoin(F.broadcast(fit.select(F.round(strength, 6).alias("strength"))))  # one row
    mean = (F.col("good") + F.col("prior_mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return fitted.select(*level.columns, mean.alias("mean"), (F.col("n") + F.col("strength")).alias("weight"))


def reputation(pages: DataFrame, outcomes: DataFrame, pairs=SUFFIX_PAIRS) -> DataFrame:
    """host (a site), pages seen (n) and good of them, mean, weight and lower bound of the posterior, for every site of pages.

    pages: page_id, url; outcomes: page_id and good (0 or 1); pairs: public suffixes of two labels.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), site_of(host_of(F.col("url"))).alias("host"))
    known = outcomes.select(F.col("page_id").cast("long").alias("known_id"), F.col("good").cast("int").alias("good")).where("known_id is not null and good is not null")
    joined = own.join(known, F.col("page_id") == F.col("known_id"), "left")
    hosts = joined.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = checkpointed(hosts.withColumn("domain", domain_of(F.col("host"), pairs)).withColumn("suffix", suffix_of(F.col("host"), pairs)))
    seen = hosts.where("n > 0")
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("whole", F.lit(0))
    whole = suffixes.agg(F.coalesce((F.sum("good") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("mean")).withColumn("whole", F.lit(0))
    # each level is read by its fit and by two more steps
    suffixes = checkpointed(_shrunk(suffixes, "suffix", checkpointed(whole), "whole"))
    domains = checkpointed(_shrunk(checkpointed(domains), "domain", suffixes, "suffix"))
    scored = _shrunk(seen, "host", domains.select("domain", "mean"), "domain").select("host", "mean", "weight")
    # hosts without outcomes: the posterior of the nearest level that has some
    parents = domains.select(F.col("domain"), F.col("mean").alias("domain_mean"), F.col("weight").alias("domain_weight"))
    grand = suffixes.select(F.col("suffix"), F.col("mean").alias("suffix_mean"), F.col("weight").alias("suffix_weight"))
    out = hosts.join(scored, "host", "left").join(parents, "domain", "left").join(grand, "suffix", "left").crossJoin(F.broadcast(whole.select(F.col("mean").alias("whole_mean"))))
    mean = F.coalesce("mean", "domain_mean", "suffix_mean", "whole_mean")
    # an unseen host has only its prior's strength, the least there is
    weight = F.coalesce("weight", F.least("domain_weight", F.lit(STRENGTH[0])), F.lit(STRENGTH[0]))
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))
    return out.select("host", "n", "good", mean.alias("mean"), weight.alias("weight"), F.round(bound, 6).alias("lower_bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict and lower_bound for every row of pages (page_id, url)."""
    key = fresh(pages, "_host")
    scores = reputation(pages, outcomes).select(F.col("host").alias(key), "lower_bound")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = own.join(scores, site_of(F.col("host")) == F.col(key), "left")
    method = F.when(F.col("lower_bound") >= least_good, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "lower_bound")
