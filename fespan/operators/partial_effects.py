"""Average partial effects and bias correction of logit models: aggregations by fixed effect, and small solves on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .centering import products, square
from .levels import with_effects


def _rows(fit, at, means, alpha_x):
    rows = fit.rows().where("not _sep")
    if fit.prep.f:
        rows = with_effects(rows, fit.prep.f, alpha_x, "_ax", len(at), fit.control.broadcast_levels)
    x = [F.col(fit.prep.x[j]) for j in at]
    mx = [c - F.lit(float(means[j])) - (F.col(f"_ax{i}") if fit.prep.f else F.lit(0.0)) for i, (j, c) in enumerate(zip(at, x, strict=True))]
    return rows.withColumns({f"_mx{i}": c for i, c in enumerate(mx)}), x, [F.col(f"_mx{i}") for i in range(len(x))]


def _ridge(h: np.ndarray) -> np.ndarray:
    return h + np.eye(len(h)) * max(h.max() * 1e-10, np.finfo(float).eps * 100)


def _effects_used(fit, which: str) -> list[str] | None:
    k = len(fit.prep.f)
    if which == "classic":
        return fit.prep.f if 1 <= k <= 2 else None
    return fit.prep.f if k >= 2 else None


def _group_ratio(rows, f: str, m: list, w) -> np.ndarray:
    """Sum over levels of (sum of m) / (sum of w)."""
    t = rows.groupBy(f).agg(F.sum(w).alias("w"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(m)]).where("w > 0")
    return np.array([v or 0.0 for v in t.agg(*[F.sum(F.col(f"m{i}") / F.col("w")) for i in range(len(m))]).first()])


def bias_correction(fit, at, means, alpha_x, h) -> None:
    """stats: beta_corrected and bias_term, from the incidental-parameter bias of each effect."""
    used = _effects_used(fit, fit.control.bias_corr_panel_structure)
    if used is None or not len(at):
        return
    rows, _, mx = _rows(fit, at, means, alpha_x)
    mu, wt = F.col("_mu"), F.col("_w")
    w, z = wt * mu * (1 - mu), wt * mu * (1 - mu) * (1 - 2 * mu)
    n = fit.prep.nobs
    b = sum(_group_ratio(rows, f, [c * z for c in mx], w) for f in used) / (2 * n)
    term = np.linalg.solve(_ridge(h / n), -b)
    full = np.full(len(fit.names), np.nan)
    full[at] = term
    fit.stats |= {"bias_term": full, "beta_corrected": fit.beta - full}


def average_partial_effects(fit, at, means, alpha_x, h) -> None:
    """stats: ape (by name), ape_vcov, ape_binary. A regressor of zeros and ones counts as binary: the mean change of the
    probability; else the mean slope. The covariance uses the delta method without residual weights, plus the finite-population
    term if ape_n_pop is given."""
    rows, x, mx = _rows(fit, at, means, alpha_x)
    c, p, n = fit.control, len(at), fit.prep.nobs
    names = [fit.names[j] for j in at]
    beta = fit.beta[at]
    eta, mu = F.col("_eta"), F.col("_mu")
    slope, bend = mu * (1 - mu), mu * (1 - mu) * (1 - 2 * mu)
    sure = rows.agg(*[F.min(((v == 0) | (v == 1)).cast("int")) for v in x]).first()
    binary = [bool(s) and names[i] != "(Intercept)" for i, s in enumerate(sure)]
    prob = lambda e: F.lit(1.0) / (F.lit(1.0) + F.exp(-e))
    delta, delta1, own = [], [], []
    for i in range(p):
        b = F.lit(float(beta[i]))
        if binary[i]:
            m0, m1 = prob(eta - x[i] * b), prob(eta - x[i] * b + b)
            delta.append(m1 - m0)
            delta1.append(m1 * (1 - m1) - m0 * (1 - m0))
            own.append(m1 * (1 - m1))
        else:
            delta.append(b * slope)
            delta1.append(b * bend)
            own.append(slope)
    rows = rows.withColumns({f"_d{i}": d for i, d in enumerate(delta)} | {f"_e{i}": d for i, d in enumerate(delta1)})
    sums = [F.sum(f"_d{i}") for i in range(p)] + [F.sum(o) for o in own]
    sums += [F.sum((mx[k] if not binary[j] else mx[k] - (x[k] if k == j else F.lit(0.0))) * F.col(f"_e{j}")) for j in range(p) for k in range(p)]
    r = rows.agg(*sums, *products(mx, F.lit(1.0))).first()
    ape, jac = np.array(r[:p]) / n, np.array(r[2 * p : 2 * p + p * p]).reshape(p, p).T / n
    jac[np.diag_indices(p)] += np.array(r[p : 2 * p]) / n
    winv = np.linalg.solve(_ridge(h / n), jac)
    v = winv.T @ square(r[2 * p + p * p :], p) @ winv / n**2
    if c.ape_n_pop and c.ape_n_pop > 1 and fit.prep.f and c.ape_sampling_fe == "independence":
        adj = max(0.0, (c.ape_n_pop - n) / (c.ape_n_pop - 1))
        rows = rows.withColumns({f"_q{i}": (F.col(f"_d{i}") - F.lit(float(ape[i]))) / n for i in range(p)})
        q = [F.col(f"_q{i}") for i in range(p)]
        by = lambda f: square(rows.groupBy(f).agg(*[F.sum(a).alias(f"s{i}") for i, a in enumerate(q)]).agg(*products([F.col(f"s{i}") for i in range(p)], F.lit(1.0))).first(), p)
        single = square(rows.agg(*products(q, F.lit(1.0))).first(), p)
        v = v + adj * by(fit.prep.f[0])
        for f in fit.prep.f[1 : 2 if c.ape_panel_structure == "classic" else 3]:
            v = v + adj * (by(f) - single)
        if c.ape_weak_exo:
            f = fit.prep.f[0 if c.ape_panel_structure == "classic" or len(fit.prep.f) <= 2 else -1]
            gamma = [sum((mx[k] * F.lit(float(winv[k, j])) for k in range(p)), F.lit(0.0)) / n for j in range(p)]
            t = rows.groupBy(f).agg(*[F.sum(a).alias(f"s{i}") for i, a in enumerate(q)], *[F.sum(g).alias(f"t{i}") for i, g in enumerate(gamma)])
            m = np.array(t.agg(*[F.sum(F.col(f"s{i}") * F.col(f"t{j}")) for i in range(p) for j in range(p)]).first()).reshape(p, p)
            v = v + adj * (m + m.T)
    fit.stats |= {"ape": dict(zip(names, ape.tolist(), strict=True)), "ape_vcov": v, "ape_binary": dict(zip(names, binary, strict=True))}
