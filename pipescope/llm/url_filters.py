"""URL filter: explicit rules first, else the reputation of the host.

Reputation is an empirical-Bayes estimate. Labelled outcomes (1 = bad page) are counted per host. A host's
rate of bad pages gets a beta prior centred on the posterior mean of its registered domain, which has one
centred on its public suffix, which has one centred on the overall rate. How strongly each level is pulled
to the one above is estimated from the counts: the spread of the rates beyond binomial noise gives the
intra-class correlation rho, and the prior weighs as much as 1/rho - 1 observations. A host is blocked
when even the lower posterior bound (mean - z standard deviations) of its bad rate exceeds a limit.

Defined cases: a null url or one without `://` has an empty host and path and is judged by the overall
rate's prior like any other host (the empty one); a host with no labels has its domain's estimate; null
outcomes are ignored; repeated pages and labels count as often as they occur; without any label the rate
is 1/2 with the smallest strength, so no bound is high and nothing is blocked. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.llm.common import lower_ascii
from pipescope.session import cut_lineage

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Public suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "org.uk")


@dataclass(frozen=True)
class Rule:
    """`host` with its subdomains, paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column, two_label: Sequence[str]) -> Column:
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last_two = F.substring_index(name, ".", -2)
    return F.when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one label before it."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    return F.when(F.instr(suffix, ".") > 0, F.substring_index(name, ".", -3)).otherwise(
        F.substring_index(name, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], pick) -> Column:
    """`pick(rule)` of the longest rule that fits; null without one."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, pick(rule)) if out is None else out.when(fits, pick(rule))
    return F.lit(None).cast("string") if out is None else out


def _strength(counts: DataFrame) -> float:
    """Pseudo observations of the prior, from rows (n, bad) of one level (moment estimate)."""
    row = counts.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.round(F.col("bad") * F.col("bad") / F.col("n"), 9).cast("decimal(38,9)")).alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not row["n"]:
        return MIN_STRENGTH
    p = row["bad"] / row["n"]
    noise = p * (1 - p)
    room = row["n"] - row["nn"] / row["n"] - (row["k"] - 1)
    if noise <= 0 or room <= 0:
        return MAX_STRENGTH
    spread = float(row["squares"]) - row["bad"] * row["bad"] / row["n"]
    rho = (spread / noise - (row["k"] - 1)) / room
    return round(MAX_STRENGTH if rho <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / rho - 1)), 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, url: str = "url", page_id: str = "page_id",
                    outcome_id: str = "page_id", outcome: str = "bad",
                    two_label: Sequence[str] = TWO_LABEL_SUFFIXES, z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n_labelled, n_bad, bad_rate, lower_bound), one row per host of `pages`.

    `outcomes` gives a 0/1 outcome per page. Hosts are totalled with partial aggregation before anything
    else happens to them, so a host with a third of all pages is one row from then on.
    """
    keyed = pages.select(F.col(page_id).alias("_id"), host_of(F.col(url)).alias("host"))
    seen = outcomes.select(F.col(outcome_id).alias("_id"), F.col(outcome).cast("long").alias("_bad"))
    hosts = keyed.join(seen, "_id", "left").groupBy("host").agg(
        F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    suffix = suffix_of(F.col("host"), two_label)
    hosts = cut_lineage(hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((overall["bad"] or 0) + 1) / ((overall["n"] or 0) + 2)
    at_suffix, at_domain, at_host = _strength(suffixes), _strength(domains), _strength(hosts)

    suffixes = suffixes.select("suffix", ((F.col("bad") + F.lit(at_suffix) * F.lit(rate))
                                          / (F.col("n") + F.lit(at_suffix))).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", (
        (F.col("bad") + F.lit(at_domain) * F.col("suffix_rate")) / (F.col("n") + F.lit(at_domain))).alias("domain_rate"))
    weight = F.col("n") + F.lit(at_host)
    mean = (F.col("bad") + F.lit(at_host) * F.col("domain_rate")) / weight
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (weight + 1))
    return (
        hosts.join(domains, ["domain", "suffix"])
        .withColumn("bad_rate", mean)
        .select("host", "domain", "suffix", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"),
                F.round("bad_rate", 6).alias("bad_rate"),
                F.round(F.col("bad_rate") - F.lit(z) * deviation, 6).alias("lower_bound"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, url: str = "url", page_id: str = "page_id",
               outcome_id: str = "page_id", outcome: str = "bad", rules: Sequence[Rule] = RULES,
               limit: float = 0.25, z: float = 1.645,
               two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, lower_bound), one row per page.

    The rules are a short list and become one CASE expression. Pages meet their host's row in a join that
    adaptive execution broadcasts while the host table is small and splits by skew when it is not.
    """
    reputation = host_reputation(pages, outcomes, url=url, page_id=page_id, outcome_id=outcome_id,
                                 outcome=outcome, two_label=two_label, z=z).drop("domain", "suffix")
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = matching_rule(host, path, rules, lambda r: F.lit(r.verdict))
    method = F.when(F.col("lower_bound") > F.lit(limit), "block").otherwise("allow")
    return parts.join(reputation, "host").select(
        "page_id", "host", "path", matching_rule(host, path, rules, lambda r: F.lit(r.text)).alias("rule"),
        F.coalesce(ruled, method).alias("verdict"), "n_labelled", "n_bad", "bad_rate", "lower_bound")
