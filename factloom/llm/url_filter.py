"""URL filter by empirical-Bayes host reputation.

Labelled outcomes of pages (good or not) are counted by host, registered domain and suffix. A suffix's
good rate is shrunk towards the overall one, a domain's towards its suffix, a host's towards its
domain: each level's parent mean is the mean of a beta prior whose strength is estimated from the
counts of that level by moments (beta-binomial). A host is blocked if even the upper bound of its
posterior good rate, a quantile of the beta posterior, is below the demanded one. Explicit rules go first.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """host and its subdomains, for paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Settings:
    """least_good: the good rate that a host must be able to have; certainty: of the posterior bound;
    least_strength and most_strength: of a prior, in pages; salts: parts of a host's pages when they meet
    its verdict."""

    least_good: float = 0.7
    certainty: float = 0.95
    least_strength: float = 2.0
    most_strength: float = 200.0
    salts: int = 8


#: Second labels that, before a country's two letters, belong to the public suffix.
PUBLIC_SECOND = ("ac", "co", "com", "edu", "gob", "gov", "govt", "go", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def bare(host: Column) -> Column:
    """A host without user names, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")


def registered_domain(host: Column) -> Column:
    """The part of a host that someone registers: the public suffix and one label more. Addresses, and hosts
    of no more labels than that, stand for themselves. A public suffix is the last label, or the last two
    where a country's letters follow one of PUBLIC_SECOND."""
    name = bare(host)
    last = F.when(name.rlike(rf"(^|\.)({'|'.join(PUBLIC_SECOND)})\.[a-z]{{2}}$"), F.lit(3)).otherwise(F.lit(2))
    address = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | name.contains(":")
    return F.when(address, name).when(last == 3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(host: Column) -> Column:
    """The public suffix of a host's domain; a domain of one label, or an address, is its own."""
    domain = registered_domain(host)
    return F.when(domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | domain.contains(":"), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.(?=.)", ""))


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.where(flip, 1 - front * h, front * h)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of beta distributions, by bisection; of those of more than 20,000 cases that of the normal
    with the same mean and variance, which then differs by less than the counts' own noise."""
    mean = a / (a + b)
    out = np.clip(mean + NormalDist().inv_cdf(p) * np.sqrt(mean * (1 - mean) / (a + b + 1)), 0, 1)
    few = a + b <= 20_000
    low, high = np.zeros(int(few.sum())), np.ones(int(few.sum()))
    for _ in range(50 if len(low) else 0):
        middle = (low + high) / 2
        under = incomplete_beta(middle, a[few], b[few]) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    out[few] = (low + high) / 2
    return out


def upper_bound(certainty: float):
    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(certainty, a.to_numpy(float), b.to_numpy(float)))

    return bound


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as (name, verdict); null where none fits."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _prior_strength(counts: DataFrame, parent: list[str], settings: Settings) -> DataFrame:
    """For each parent: its mean, and the strength of the beta prior of its children by moments.

    With n_i pages, g_i of them good, and rate m: E sum (g_i - n_i m)^2 = m (1 - m) sum n_i (1 + (n_i - 1) r)
    for an intra-group correlation r; the strength is 1 / r - 1.
    """
    mean = counts.groupBy(*parent).agg(F.sum("good").alias("__g"), F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("n")).alias("__nn"), F.sum(F.col("good") * F.col("good")).alias("__gg"), F.sum(F.col("good") * F.col("n")).alias("__gn"))
    m = F.col("__g") / F.col("__n")
    spread = F.col("__gg") - 2 * m * F.col("__gn") + m * m * F.col("__nn")
    noise = m * (1 - m) * F.col("__n")
    extra = m * (1 - m) * (F.col("__nn") - F.col("__n"))
    r = F.when(extra > 0, (spread - noise) / extra).otherwise(F.lit(0.0))
    strength = F.when(r > 0, F.least(F.greatest(1 / r - 1, F.lit(settings.least_strength)), F.lit(settings.most_strength))).otherwise(F.lit(settings.most_strength))
    return mean.select(*parent, strength.alias("strength"))


def host_reputation(outcomes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, n, rate, upper, for the hosts of ``outcomes`` (host, good: 1 or 0), and the same for each
    domain and suffix, whose names stand in ``host`` with ``level`` telling which.

    Counts are made once per host, so nothing that follows sees a page twice. Null outcomes are ignored.
    """
    hosts = outcomes.filter("good is not null and host is not null").groupBy("host").agg(F.sum(F.col("good").cast("double")).alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    overall = suffixes.agg(F.sum("good").alias("g"), F.sum("n").alias("m")).select(F.coalesce((F.col("g") + 1) / (F.col("m") + 2), F.lit(0.5)).alias("parent"))

    def shrunk(df: DataFrame) -> DataFrame:
        """good, n, parent, strength -> a, b of the posterior and its mean."""
        a, b = F.col("parent") * F.col("strength") + F.col("good"), (1 - F.col("parent")) * F.col("strength") + F.col("n") - F.col("good")
        return df.withColumn("rate", a / (a + b)).withColumn("upper", upper_bound(settings.certainty)(a, b))

    top = F.broadcast(overall.crossJoin(_prior_strength(suffixes, [], settings)))  # one row
    suffix_post = shrunk(suffixes.crossJoin(top))
    up = suffix_post.select("suffix", F.col("rate").alias("parent"))
    domain_post = shrunk(domains.join(up, "suffix").join(_prior_strength(domains, ["suffix"], settings), "suffix"))
    up = domain_post.select("suffix", "domain", F.col("rate").alias("parent"))
    host_post = shrunk(hosts.join(up, ["suffix", "domain"]).join(_prior_strength(hosts, ["suffix", "domain"], settings), ["suffix", "domain"]))
    levels = [("host", "host", host_post), ("domain", "domain", domain_post), ("suffix", "suffix", suffix_post)]
    parts = [df.select(F.lit(level).alias("level"), F.col(name).alias("host"), F.col("n").cast("long").alias("n"), "rate", "upper") for level, name, df in levels]
    return parts[0].union(parts[1]).union(parts[2])


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, rate of every row of ``pages`` (page_id, url).

    ``outcomes``: page_id and good. A host without outcomes has its domain's posterior, else its
    suffix's; where there is none at all, the rate is null and the page allowed, as is one without a
    host. Repeated rows are judged alike, a null page_id like any other; other columns are ignored, and no
    pages give no rows. Which pages have outcomes, and of what, is the caller's: see the query.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labelled = parts.filter("host <> ''").join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    known = host_reputation(labelled, settings)
    hosts = parts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))  # each host once, however many pages it has
    for level, key in (("host", F.col("host")), ("domain", registered_domain(F.col("host"))), ("suffix", suffix(F.col("host")))):
        own = known.filter(F.col("level") == level).select(F.col("host").alias("__key"), F.struct("rate", "upper").alias(f"of_{level}"))
        hosts = hosts.withColumn("__key", key).join(own, "__key", "left").drop("__key")
    judged = hosts.select("host", F.coalesce("of_host", "of_domain", "of_suffix").alias("best"))
    bad = F.coalesce(F.col("best.upper") < settings.least_good, F.lit(False))
    # Each verdict is held ``salts`` times, so that a host with a third of all pages meets it in as many tasks.
    judged = judged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(settings.salts)).cast("int")
    found = parts.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__salt", salt).join(judged, ["host", "__salt"], "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(bad, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("__rule.name").alias("rule"), verdict.alias("verdict"), F.col("best.rate").alias("rate"))


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``; the outcome of a page is the quality label of the document of its number."""
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)
    return judged.withColumn("rate", F.round("rate", 9))
