"""URL filter: explicit rules, else an empirical-Bayes host reputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import fresh, materialize, without

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which domains are registered, the usual ones of a long public list; others have one label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe",
    "com.ph", "com.pk", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn",
    "org.in", "org.nz", "org.uk", "org.za",
)
#: A host is blocked if its bad share exceeds BAD with a posterior probability of SURE at least: the lower bound of its share does.
BAD, SURE = 0.25, 0.95
#: Bad share and pseudo-observations of the prior at the top, and the bounds of those that the moments give at each level.
PRIOR, TOP, LEAST, MOST = 0.1, 2.0, 1.0, 1000.0


def with_parts(pages: DataFrame, url_col: str = "url", suffixes=SUFFIXES, names=("host", "path", "domain", "suffix")) -> DataFrame:
    """pages with host, path, suffix (the last label, or a listed pair of labels) and domain (the suffix and the label before it)."""
    u, (host, path, domain, suffix) = F.coalesce(F.col(url_col), F.lit("")), names
    df = pages.withColumn(host, F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), AZ, az)).withColumn(path, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1))
    two = F.substring_index(host, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    return df.withColumn(domain, F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))).withColumn(suffix, F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)))


def _level(counts: DataFrame, key: str, up: str | None) -> DataFrame:
    """(key, n, bad, up): labelled outcomes of a level."""
    return counts.groupBy(key, *([up] if up else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(children: DataFrame) -> float:
    """Prior pseudo-observations by the method of moments, from children (n, bad, prior): with tau2 the spread around the prior
    mean beyond binomial noise, m = mean(p (1 - p)) / tau2 - 1, kept within LEAST and MOST. One row reaches the driver."""
    p = F.col("prior")
    noise = F.col("n") * p * (1 - p)
    x = children.agg(F.sum(noise), F.sum("n"), F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) - noise), F.sum(F.col("n") * (F.col("n") - 1))).first()
    if not x[1] or not x[3] or x[2] <= 0:
        return MOST
    return round(max(LEAST, min(MOST, x[0] / x[1] / (x[2] / x[3]) - 1)), 6)


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distribution function of Beta(a, b) at x, by its power series in x (x below one; terms are summed until they vanish)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lead = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    term, total, k = np.ones_like(p), np.ones_like(p), 0
    while k < 100_000 and (term > 1e-17 * total).any():
        term = term * z * (p + q + k) / (p + 1 + k)
        total = total + term
        k += 1
    out = np.minimum(lead * total, 1.0)
    return np.where(flip, 1 - out, out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function: the asymptotic series, eight steps further up."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for k in range(8):
        low = low + np.log(x + k)
    y = x + 8
    s = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y - low


def surely(a: F.Column, b: F.Column, share: float) -> F.Column:
    """Posterior probability that a Beta(a, b) share exceeds `share`."""

    @F.pandas_udf(DoubleType())
    def above(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(1 - beta_cdf(share, x.to_numpy(float), y.to_numpy(float)))

    return above(a, b)


def reputation(counts: DataFrame, share: float = BAD) -> DataFrame:
    """(host, mean, sure) for every host of counts (host, domain, suffix, n, bad): its posterior mean bad share, and the posterior
    probability that its share exceeds `share`.

    Beta-binomial shrinkage in three steps: a suffix towards the overall share, a domain towards its suffix, a host towards its
    domain; a level's posterior mean is the prior mean of the next. A level's prior weighs as many observations as the moments say.
    """
    n, bad = counts.agg(F.sum("n"), F.sum("bad")).first()
    prior = ((bad or 0) + PRIOR * TOP) / ((n or 0) + TOP)
    suffix = _level(counts, "suffix", None).withColumn("prior", F.lit(prior))
    suffix = suffix.select("suffix", _mean(_strength(suffix)).alias("prior"))
    domain = _level(counts, "domain", "suffix").join(suffix, "suffix")
    domain = domain.select("domain", _mean(_strength(domain)).alias("prior"))
    host = _level(counts, "host", "domain").join(domain, "domain")
    m = _strength(host)
    a, b = F.col("bad") + F.lit(m) * F.col("prior"), F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col("prior"))
    return host.select("host", _mean(m).alias("mean"), surely(a, b, share).alias("sure"))


def _mean(m: float) -> F.Column:
    return (F.col("bad") + F.lit(m) * F.col("prior")) / (F.col("n") + F.lit(m))


def rule_for(rules=RULES) -> F.Column:
    """The longest rule (rule, verdict) that fits host and path, or null; of two rules of one length the later in the order of text."""
    kind = "struct<len:int,rule:string,verdict:string>"
    fits = [(F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))) for v, h, p in rules]
    return F.greatest(*fits, F.lit(None).cast(kind)) if len(fits) else F.lit(None).cast(kind)


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, suffixes=SUFFIXES, share: float = BAD, sure: float = SURE) -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule's; else block where the host's bad share exceeds `share` with
    posterior probability `sure` (its lower posterior bound does), else allow.

    outcomes (id, bad 0/1) labels some pages; ids may repeat (each label counts), null ids or outcomes do not count. A url that is
    null or has no :// has empty host and path, no rule, and the verdict of the empty host. Labels are counted by host before
    any other step, so a hot host is one row of the reputation; the join with pages is an ordinary one, which AQE splits. Columns of
    pages named like results are replaced, all others stay. Without rules or outcomes the reputation, or its prior, decides alone.
    """
    base = without(pages, "host", "path", "rule", "verdict")
    domain, suffix, chance, best = fresh(base, "_domain", "_suffix", "_sure", "_rule")
    parts = with_parts(base, url_col, suffixes, ("host", "path", domain, suffix))
    labels = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    seen = parts.select(F.col(id_col).alias("id"), "host", F.col(domain).alias("domain"), F.col(suffix).alias("suffix")).join(labels, "id", "left")
    counts = seen.groupBy("host", "domain", "suffix").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counts = materialize(counts, "hosts")
    out = parts.join(reputation(counts, share).select("host", F.col("sure").alias(chance)), "host", "left").withColumn(best, rule_for(rules))
    own = F.when(F.col(chance) >= sure, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn("rule", F.col(f"{best}.rule")).withColumn("verdict", F.coalesce(F.col(f"{best}.verdict"), own)).drop(best, chance, domain, suffix)
    return out.select(*[c for c in base.columns], "host", "path", "rule", "verdict")
