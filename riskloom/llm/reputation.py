"""URL filters: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host. A host's share of good pages is shrunk to that of its
registered domain, the domain's to that of its public suffix, the suffix's to the overall share.
Every level has a beta-binomial model: given the parent's mean m, a child's outcomes are
Beta(strength * m, strength * (1 - m)) mixed binomials. The strength of a level follows from its own
counts by moments: Var(good) = n m (1 - m) (1 + (n - 1) rho) and strength = (1 - rho) / rho. A host is
allowed if its posterior mean less ``z`` posterior deviations reaches ``cutoff``.

Only counts per host are gathered, summed on the map side, so a host with a third of all pages is one
row per task. Pages meet the verdicts of their hosts in one join whose small side is stored first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scan import lookup
from riskloom.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that are known without a list of one's own.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx",
            "com.tr", "gov.uk", "org.au", "org.uk")
RHO_LEAST, RHO_MOST = 1e-4, 0.5


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _authority(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty for null or without ``://``."""
    host = F.regexp_extract(_authority(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_authority(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain, without user and port.

    An address, an empty host and a host of one label are their own suffix and domain.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.+$", "")
    parts = F.split(name, r"\.")
    count = F.size(parts)

    def last(n: int) -> Column:
        return F.when(count <= n, name).otherwise(F.substring_index(name, ".", -n))

    double = last(2).isin(*suffixes) if suffixes else F.lit(False)
    whole = (count == 1) | name.rlike(r"^[0-9.]+$|^\[")
    return (F.when(whole, name).when(double, last(2)).otherwise(last(1)),
            F.when(whole, name).when(double, last(3)).otherwise(last(2)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, of equal ones the first in ``rules``; nulls if none does."""
    text = action = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        action = F.when(fits, rule.action) if action is None else action.when(fits, rule.action)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, action)


def _posterior(strength: float) -> list[Column]:
    """Parameters of the Beta posterior under the prior mean ``prior``."""
    return [F.col("good") + F.lit(strength) * F.col("prior"),
            F.col("trials") - F.col("good") + F.lit(strength) * (1 - F.col("prior"))]


def _strength(units: DataFrame) -> float:
    """Prior strength of a level from (trials, good, prior); no evidence of spread gives the strongest prior."""
    n, k, m = F.col("trials"), F.col("good"), F.col("prior")
    row = units.where("trials > 0").agg(
        F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)).alias("extra"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("scale")).first()
    rho = row["extra"] / row["scale"] if row["scale"] else RHO_LEAST
    rho = min(max(rho, RHO_LEAST), RHO_MOST)
    return (1 - rho) / rho


def host_reputation(counts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """Per row of ``counts`` (host, trials, good): ``host``, ``trials``, ``reputation`` and ``bound``.

    ``counts`` has one row per host, with zero trials for a host without labels, and is read several
    times: pass a stored table. An empty table gives an empty one; without any label all means are one half.
    """
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = counts.withColumns({"suffix": suffix, "domain": domain})
    sums = [F.sum("trials").alias("trials"), F.sum("good").alias("good")]
    whole = counts.agg(*sums).first()
    overall = ((whole["good"] or 0) + 0.5) / ((whole["trials"] or 0) + 1)

    def shrunk(units: DataFrame) -> DataFrame:
        a, b = _posterior(_strength(units))
        return units.withColumns({"mean": a / (a + b), "bound": a / (a + b) - F.lit(z) * F.sqrt(
            a * b / ((a + b) * (a + b) * (a + b + 1)))})

    def below(units: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        means = lookup(parents.select(key, F.col("mean").alias("prior")))
        return units.join(means, key)

    tops = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall)))
    domains = shrunk(stage(below(hosts.groupBy("suffix", "domain").agg(*sums), tops, "suffix"), "domains"))
    judged = shrunk(stage(below(hosts, domains, "domain"), "hosts"))
    return judged.select("host", "trials", F.col("mean").alias("reputation"), "bound")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url",
               outcome_key: str = "page_id", good: str = "good", suffixes: tuple[str, ...] = SUFFIXES,
               z: float = 1.645, cutoff: float = 0.8) -> DataFrame:
    """Per row of ``pages``: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``reputation``, ``n_labelled``.

    ``outcomes`` has a 0/1 column ``good`` per labelled page. Outcomes of null pages, null outcomes and
    outcomes of unknown pages are left out; repeated ones count each. Rows without a url have an empty host,
    which is judged like any other. Repeated rows and null keys are returned as they are; without
    outcomes all hosts have one bound; an empty table gives an empty one. Other columns are not read.
    """
    address = F.col(url).cast("string")
    parsed = pages.select(F.col(key).cast("long").alias("page"), host_of(address).alias("host"),
                          path_of(address).alias("path"))
    marks = outcomes.select(F.col(outcome_key).cast("long").alias("page"), F.col(good).cast("long").alias("good"))
    marks = marks.where("page IS NOT NULL AND good IN (0, 1)").groupBy("page").agg(
        F.count(F.lit(1)).alias("trials"), F.sum("good").alias("good"))
    counts = parsed.join(marks, "page", "left").groupBy("host").agg(
        F.coalesce(F.sum("trials"), F.lit(0)).alias("trials"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    verdicts = host_reputation(stage(counts, "outcomes"), suffixes, z).select(
        "host", "trials", "reputation", F.when(F.col("bound") >= cutoff, "allow").otherwise("block").alias("verdict"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(lookup(verdicts), "host", "left").select(
        F.col("page").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(action, F.col("verdict")).alias("verdict"), "reputation", F.col("trials").alias("n_labelled"))
