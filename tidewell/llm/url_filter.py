"""URL filter: explicit rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are shrunk from host to registered domain to
suffix to the whole.  Each level has a beta-binomial prior whose mean is the parent's
posterior mean and whose strength comes from moments over that level.  A page is
blocked where the upper posterior bound of its host's good rate stays below a limit.

Scale: pages are read once for counts (combined map-side, so a host with a third of
all pages is one row per task) and once for verdicts; the host table joins by host,
where adaptive execution splits a hot host.  All levels above are smaller still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: host, path, verdict
Rule = tuple[str, str, str]
#: Labels under which country codes let names be registered, and an address in numbers.
GENERIC = "ac|co|com|edu|go|gov|ne|net|or|org"
ADDRESS = r"^[0-9]+(\.[0-9]+){3}\z"
#: Strength of a prior where moments show no spread, and least correlation assumed.
RHO = (1e-4, 0.99)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """A host without user and port, which is what reputation goes by."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")


def suffix_of(site: Column) -> Column:
    """The last label; the last two where these are of the kind of ``co.uk`` and a label stands before them; an address in numbers as it is."""
    two = F.regexp_extract(site, rf"^.*\.((?:{GENERIC})\.[a-z]{{2}})\z", 1)
    return F.when(site.rlike(ADDRESS), site).when(two != "", two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and the label before it, or the site."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(site.rlike(ADDRESS), site).otherwise(F.array_join(F.slice(F.split(site, r"\."), F.greatest(F.size(F.split(site, r"\.")) - labels + 1, F.lit(1)), labels), "."))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.  Ties: the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row: prior strength m, by moments of children's rates about their parent's."""
    by = children.groupBy(parent).agg(
        F.sum("n").alias("pn"), F.sum("s").alias("ps"), F.sum(F.col("n") * F.col("n")).alias("pn2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("pq"), F.count(F.lit(1)).alias("k")
    )
    p = F.col("ps") / F.col("pn")
    v = p * (1 - p)
    by = by.select(
        (F.col("pq") - F.col("ps") * p - v * (F.col("k") - 1)).alias("num"),
        (v * (F.col("pn") - F.col("pn2") / F.col("pn") - (F.col("k") - 1))).alias("den"),
    )
    num, den = F.sum("num"), F.sum("den")
    rho = F.least(F.greatest(F.coalesce(F.when(den > 0, num / den), F.lit(0.0)), F.lit(RHO[0])), F.lit(RHO[1]))
    return by.agg(((1 - rho) / rho).alias("m"))


def reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """From (site, n, s): site, mean, upper.  Sites without a label take their parents' prior."""
    hosts = counts.withColumn("suffix", suffix_of(F.col("site"))).withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    some = hosts.where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("whole", F.lit(0))
    whole = suffixes.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mu0"))
    m1, m2, m3 = _strength(suffixes.where("n > 0"), "whole"), _strength(domains.where("n > 0"), "suffix"), _strength(some, "domain")
    # Each of these has one row.
    suffixes = suffixes.join(F.broadcast(whole)).join(F.broadcast(m1)).select("suffix", ((F.col("s") + F.col("m") * F.col("mu0")) / (F.col("n") + F.col("m"))).alias("mu1"))
    domains = domains.join(suffixes, "suffix").join(F.broadcast(m2)).select("domain", ((F.col("s") + F.col("m") * F.col("mu1")) / (F.col("n") + F.col("m"))).alias("mu2"))
    a = F.col("s") + F.col("m") * F.col("mu2")
    b = F.col("n") - F.col("s") + F.col("m") * (1 - F.col("mu2"))
    mean = a / (a + b)
    upper = mean + F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.join(domains, "domain").join(F.broadcast(m3)).select("site", mean.alias("mean"), upper.alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Return page_id, host, path, rule, verdict, mean for each page.

    `outcomes` has page_id and good (0, 1 or null); repeated or null ids count once and
    not at all.  Null urls and urls without ``://`` have empty host and path and are
    judged as the host of that name.  Repeated pages count each time, and are judged alike.  No labels: every mean is 1/2 and, the bound being
    above it, pages without a rule are allowed.  Other columns are ignored.
    """
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    labels = outcomes.where("good is not null and page_id is not null").groupBy("page_id").agg(F.max("good").cast("long").alias("good"))
    counts = parts.join(labels, "page_id", "left").groupBy("site").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))
    known = scratch.written(reputation(scratch.written(counts, "url-sites"), z), "url-reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < limit, "block").otherwise("allow")
    return parts.join(known, "site").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean"
    )
