"""Families as formulas over eta, y and w, which may be Spark columns or arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EPS = float(np.finfo(float).eps)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: a series near zero, else a continued fraction by Lentz's rule; relative error about 1e-13."""
    x = np.asarray(x, float)
    a = np.abs(x)
    out = np.empty_like(a)
    near = a < 2.5
    s = a[near]
    term, total = s.copy(), s.copy()
    for k in range(1, 60):
        term = term * -(s**2) / k
        total += term / (2 * k + 1)
    out[near] = 1 - 2 / np.sqrt(np.pi) * total
    f = a[~near]
    with np.errstate(over="ignore", under="ignore"):
        c = np.zeros_like(f)
        for k in range(80, 0, -1):
            c = k / 2 / (f + c)
        out[~near] = np.exp(-(f**2)) / np.sqrt(np.pi) / (f + c)
    out[np.isnan(x)] = np.nan
    return np.where(x < 0, 2 - out, out)


def norm_cdf(x):
    return 0.5 * erfc(-np.asarray(x, float) / np.sqrt(2))


def norm_pdf(x):
    return np.exp(-(np.asarray(x, float) ** 2) / 2) / np.sqrt(2 * np.pi)


def norm_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if norm_cdf(np.array([mid]))[0] < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def phi_cdf(x: pd.Series) -> pd.Series:
    """Normal distribution function; Spark has no erf."""
    return pd.Series(norm_cdf(x.to_numpy(float)))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class OnColumns:
    """The functions that families need, over columns."""

    exp, log, sqrt, abs, isnan, cdf = (staticmethod(f) for f in (F.exp, F.log, F.sqrt, F.abs, F.isnan, phi_cdf))
    most = staticmethod(lambda a, b: F.greatest(_col(a), _col(b)))
    least = staticmethod(lambda a, b: F.least(_col(a), _col(b)))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    no = staticmethod(lambda like: F.lit(False))


class OnArrays:
    """The same functions over arrays."""

    exp, log, sqrt, abs, isnan, cdf = (staticmethod(f) for f in (np.exp, np.log, np.sqrt, np.abs, np.isnan, norm_cdf))
    most, least, where = (staticmethod(f) for f in (np.maximum, np.minimum, np.where))
    no = staticmethod(lambda like: np.zeros(np.shape(like), bool))


def _on(x):
    return OnColumns if isinstance(x, Column) else OnArrays


def norm_density(x):
    return _on(x).exp(-x * x / 2) * float(1 / np.sqrt(2 * np.pi))


@dataclass(frozen=True)
class Family:
    """name and parameters; methods take columns or arrays alike. theta: of the negative binomial; lb, ub, sigma: of the tobit model."""

    name: str
    theta: float = 1.0
    lb: float = -np.inf
    ub: float = np.inf
    sigma: float = 1.0

    def mu(self, eta):
        m = _on(eta)
        over = lambda d: m.where(d == 0, float("inf"), 1.0 / m.where(d == 0, 1.0, d))  # noqa: E731  # Spark raises where d = 0
        return {
            "poisson": m.exp, "negbin": m.exp, "binomial": lambda e: 1.0 / (1.0 + m.exp(-e)), "probit": m.cdf,
            "gamma": over, "inverse.gaussian": lambda e: over(m.sqrt(e)),
        }.get(self.name, lambda e: e)(eta)

    def link(self, mean: float) -> float:
        """Start value of eta from the mean of the response."""
        if self.name == "binomial":
            p = min(max(mean, 0.01), 0.99)
            return float(np.log(p / (1 - p)))
        if self.name in ("gamma", "inverse.gaussian"):
            # the logarithm as specified, where it is a valid eta
            return float(np.log(mean) if mean > 1 else mean ** (-1.0 if self.name == "gamma" else -2.0))
        if self.name in ("poisson", "negbin"):
            return float(np.log(mean + 0.1))
        return float(mean)

    def working(self, eta, mu, y, w):
        """(working weight, working residual)."""
        m, n = _on(eta), self.name
        if n == "poisson":
            return w * mu, (y - mu) / mu
        if n == "negbin":
            return w * mu / (1 + mu / self.theta), (y - mu) / mu
        if n == "binomial":
            v = mu * (1 - mu)
            return w * v, (y - mu) / v
        if n == "probit":
            d = m.most(norm_density(eta), EPS)
            return w * d * d / m.most(mu * (1 - mu), EPS), (y - mu) / d
        if n == "gamma":
            return w * mu * mu, -(y - mu) / (mu * mu)
        if n == "inverse.gaussian":
            return w * mu * mu * mu / 4, -2 * (y - mu) / (mu * mu * mu)
        if n == "tobit":
            return self._tobit(mu, y, w)
        return w, y - mu

    def censored(self, y):
        m = _on(y)
        side = lambda b: (m.abs(y - float(b)) < EPS) if np.isfinite(b) else m.no(y)
        return side(self.lb), side(self.ub)

    def _tobit(self, mu, y, w):
        m, s = _on(mu), self.sigma
        left, right = self.censored(y)
        a = (float(self.lb if np.isfinite(self.lb) else 0) - mu) / s
        b = (float(self.ub if np.isfinite(self.ub) else 0) - mu) / s
        la, lb = norm_density(a) / m.most(m.cdf(a), EPS), norm_density(b) / m.most(m.cdf(-b), EPS)
        da, db = m.most(la * (la + a), EPS), m.most(lb * (lb - b), EPS)
        weight = m.where(left, w * da / s**2, m.where(right, w * db / s**2, w / s**2))
        return weight, m.where(left, -la * s / da, m.where(right, lb * s / db, y - mu))

    def deviance(self, mu, y):
        """Deviance of a row of weight one."""
        m, n = _on(y), self.name
        if n == "poisson":
            return 2 * (y * m.log(m.most(y, 1.0) / mu) - (y - mu))
        if n == "negbin":
            return 2 * (y * m.log(m.most(y, 1.0) / mu) - (y + self.theta) * m.log((y + self.theta) / (mu + self.theta)))
        if n in ("binomial", "probit"):
            inside = lambda x: m.least(m.most(x, EPS), 1 - EPS)
            c, p = inside(y), inside(mu)
            return 2 * (y * m.log(c / p) + (1 - y) * m.log((1 - c) / (1 - p)))
        if n == "gamma":
            # the log-likelihood of y = 0 is infinite; its quasi-likelihood is not, and what is left out does not vary with mu
            return -2 * (m.log(m.where(y == 0, 1 / mu, m.most(y / mu, EPS))) - (y - mu) / mu)
        if n == "inverse.gaussian":
            # of y = 0 without 1 / y, which is infinite and does not vary with mu
            return m.where(y == 0, -2 / mu, (y - mu) * (y - mu) / (m.where(y == 0, 1.0, y) * mu * mu))
        return (y - mu) * (y - mu)

    def valid(self, eta, mu):
        m = _on(eta)
        ok = ~m.isnan(eta) & ~m.isnan(mu) & (m.abs(eta) < float("inf")) & (m.abs(mu) < float("inf"))
        if self.name in ("poisson", "negbin"):
            return ok & (mu > 0)
        if self.name == "gamma":
            return ok & (eta != 0) & (mu > 0)
        if self.name == "inverse.gaussian":
            return ok & (eta > 0)
        return ok


NAMES = {"gaussian": "gaussian", "poisson": "poisson", "quasipoisson": "poisson", "binomial": "binomial", "logit": "binomial", "probit": "probit", "gamma": "gamma", "inverse.gaussian": "inverse.gaussian", "tobit": "tobit"}


def family(name: str | Family, **more) -> Family:
    if isinstance(name, Family):
        return name
    low = str(name).lower().replace("_", ".")
    if low in ("negbin", "negative.binomial"):
        raise ValueError("use 'fenegbin' instead.")
    if low not in NAMES:
        raise ValueError(f"unknown family '{name}'.")
    return Family(NAMES[low], **more)
