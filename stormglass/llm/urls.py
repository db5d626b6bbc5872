"""URL filter by empirical-Bayes host reputation, as DataFrame expressions only.

Labelled page outcomes (bad or not) are counted per host. Suffix, registered domain and host
are three levels of beta-binomial shrinkage: the mean of a level, weighted with a prior strength,
is the prior of the next. The prior strength of a level comes from the data: with V the sum of
binomial variances n m (1 - m) around the parents' means m and S the sum of squared residuals,
the overdispersion is rho = (S - V) / sum of V_i (n_i - 1), held within [0.0001, 0.5], and the strength
(1 - rho) / rho. A host is blocked if the lower bound of its bad rate, mean - z * standard
deviation of the posterior, is above the limit. A host without labelled pages has its domain's
prior, a domain without any its suffix's, a suffix without any the overall rate.

Rules come first: (host, path) pairs with a verdict; the longest that fits decides.

Defined cases: a null url or one without `://` has empty host and path; such pages share one
host without a name. Hosts are kept as written (ports too). Repeated labels count each; null outcomes and labels
without a page are ignored. Repeated pages are judged each. Without labels everything that no
rule blocks is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

Z, LIMIT = 1.645, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Second-level labels under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three under names like co.uk."""
    labels = F.split(host, r"\.")
    second = F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    keep = F.when((F.size(labels) > 2) & second, 3).otherwise(2)
    return F.when(keep == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.substring(
        domain, F.instr(domain, ".") + 1, F.length(domain))).otherwise(domain)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Prior strength of a level from (n, k, m): sizes, bad outcomes and the parents' means."""
    v = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = level.agg(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2).alias("s"), F.sum(v).alias("v"),
                    F.sum(v * (F.col("n") - 1)).alias("w")).first()
    rho = (row["s"] - row["v"]) / row["w"] if row["w"] else 0.0001
    rho = min(0.5, max(0.0001, rho))
    return (1 - rho) / rho


def reputation(pages: DataFrame, labels: DataFrame, page_id: str, label_id: str, bad: Column) -> DataFrame:
    """(host, n, k, mean, deviation): labelled pages, bad ones, posterior of every host.

    pages has the columns `host` and page_id.
    """
    outcomes = labels.select(F.col(label_id).alias("_id"), bad.cast("int").alias("_bad"))
    counts = (pages.select("host", F.col(page_id).alias("_id")).join(outcomes, "_id")
              .groupBy("host").agg(F.count("_bad").alias("n"), F.sum("_bad").alias("k")))
    hosts = (pages.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "k"])
             .withColumn("domain", domain_of(F.col("host")))
             .withColumn("suffix", suffix_of(F.col("domain"))))
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = total[1] / total[0] if total[0] else 0.0

    def shrunk(level: DataFrame) -> DataFrame:
        s = _strength(level)
        return level.withColumn("s", F.lit(s)).withColumn(
            "mean", (F.col("k") + s * F.col("m")) / (F.col("n") + s))

    suffixes = shrunk(suffixes.withColumn("m", F.lit(overall)))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    return hosts.select("host", "n", "k", "mean", F.sqrt(
        F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s") + 1)).alias("deviation"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url",
          label_id: str = "doc_id", bad: Column | None = None,
          rules: Sequence[tuple[str, str]] = RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, and the host's posterior."""
    if bad is None:
        bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    parts = pages.select(page_id, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = reputation(parts, labels, page_id, label_id, bad)
    hosts = hosts.withColumn("_own", F.when(F.col("mean") - z * F.col("deviation") > limit, "block")
                             .otherwise("allow"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.join(hosts, "host", "left")
            .select(page_id, "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, "_own", F.lit("allow")).alias("verdict"),
                    F.col("mean").alias("bad_rate"), F.col("deviation").alias("bad_rate_sd")))
