"""Estimators: linear and generalized linear models with fixed effects. A driver loop holds the coefficients; each pass runs in an
engine (arrays or Spark, see engine), and no state of a row is carried from one pass to the next."""

from __future__ import annotations

import warnings
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family, family as family_of
from ..plans.control import FitControl, merged
from ..plans.formula import ModelSpec, parse
from . import linalg
from .centering import warn_unsettled
from .engine import State, released, rows_of, separate
from .prepare import Prepared, prepare
from .results import Result

VCOV = ("iid", "hetero", "cluster", "m-estimator", "dyadic", "two-way", "twoway")
#: Relative change of the deviance that is noise of summation.
NOISE = 1e-9


def _vcov_kind(given: str | None, control: FitControl, spec) -> str:
    kind = given or control.vcov_type or ("cluster" if spec.clusters else "iid")
    if kind not in VCOV:
        raise ValueError(f"'vcov' must be one of {', '.join(VCOV[:6])}.")
    return "two-way" if kind == "twoway" else kind


def _start(formula, data, weights, offset, control) -> tuple[Prepared, FitControl]:
    if not isinstance(data, DataFrame):
        raise TypeError("'data' has to be a DataFrame.")
    control = merged(control)
    return prepare(data, formula if isinstance(formula, ModelSpec) else parse(formula, data.columns), weights, offset), control


def felm(formula, data: DataFrame, weights=None, vcov: str | None = None, control=None) -> Result:
    """Linear model with fixed effects, by least squares on centred columns."""
    prep, control = _start(formula, data, weights, None, control)
    kind, p = _vcov_kind(vcov, control, prep.spec), len(prep.names)
    rows = rows_of(prep, control, kind not in ("iid", "hetero"))
    ybar, means = rows.moments() if prep.f else (0.0, np.zeros(p))
    found = rows.linear(ybar, means)
    warn_unsettled(found)
    gram = found.gram
    beta, keep = found.solved(control.collin_tol)
    b = np.where(keep, beta, 0.0)
    effects = [a.combined([1.0, *(-b)]) for a in found.levels]
    if effects:
        effects[0] = effects[0].shifted(ybar - float(means @ b))
    ssr, tss = max(gram[0, 0] - 2 * b @ gram[1:, 0] + b @ gram[1:, 1:] @ b, 0.0), rows.total()
    n, params = prep.nobs, p + sum(a.count() - 1 for a in effects)
    r2 = 1 - ssr / tss if tss else float("nan")
    stats = {"r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / max(1, n - params), "vcov": kind, "sweeps": found.sweeps, "ssr": ssr}
    nobs = {"nobs_full": prep.nobs_full, "nobs_na": prep.nobs_full - n, "nobs_separated": 0, "nobs_pc": 0, "nobs": n}
    fam, at = Family("gaussian"), np.flatnonzero(keep)
    out = Result("felm", prep.spec, control, fam, prep.names, beta, None, kind, prep, effects, nobs, stats, weights, None, data if control.keep_data else None)
    h_inv, alpha_x = linalg.inverse(gram[1:, 1:][np.ix_(at, at)]), [a.picked([1 + j for j in at]) for a in found.levels]
    if kind == "iid":
        cov = ssr / max(1, n - p) * h_inv
    else:
        cov = rows.meat(kind, h_inv, fam, State(b, effects or None), at, means, alpha_x)
    out.vcov_matrix = linalg.expand(cov, keep)
    out.at, out.means, out.alpha_x, out.vcov_given = at, means, alpha_x, vcov
    released(rows)
    return out


def _check_response(prep: Prepared, fam: Family, control: FitControl) -> None:
    lo, hi = prep.y_range
    if fam.name in ("binomial", "probit") and (lo < 0 or hi > 1):
        raise ValueError("Model response must be within [0,1].")
    zero = control.zero_response and fam.name in ("gamma", "inverse.gaussian")
    if fam.name in ("gamma", "inverse.gaussian") and lo <= 0 and not zero:
        raise ValueError("Model response must be strictly positive.")
    if zero and lo == hi == 0:
        raise ValueError("all observations are separated.")
    if (fam.name in ("poisson", "negbin") or zero) and lo < 0:
        raise ValueError("Model response must be non-negative.")


def feglm(formula, data: DataFrame, family="gaussian", weights=None, vcov: str | None = None, beta_start=None, eta_start=None, offset=None, control=None) -> Result:
    """Generalized linear model with fixed effects, by iteratively reweighted least squares on centred columns."""
    fam = family_of(family)
    prep, control = _start(formula, data, weights, offset, control)
    if fam.name == "tobit":
        fam = replace(fam, lb=control.tobit_lb, ub=control.tobit_ub)
    kind = _vcov_kind(vcov, control, prep.spec)
    _check_response(prep, fam, control)
    rows = rows_of(prep, control, kind not in ("iid", "hetero"))
    out = _irls(rows, prep, fam, control, kind, data, weights, offset, beta_start, eta_start)
    out.vcov_given = vcov
    released(rows)
    return out


def fepoisson(formula, data, **how) -> Result:
    return feglm(formula, data, family="poisson", **how)


def feprobit(formula, data, **how) -> Result:
    return feglm(formula, data, family="probit", **how)


def fetobit(formula, data, tobit_lb: float = -np.inf, tobit_ub: float = np.inf, control=None, **how) -> Result:
    return feglm(formula, data, family="tobit", control=merged(control, tobit_lb=tobit_lb, tobit_ub=tobit_ub), **how)


def fit_matrix(data: DataFrame, y: str, x_cols: list[str], fe: list[str] = (), clusters: list[str] = (), intercept: bool = False, family="gaussian", **how) -> Result:
    """A model of columns that are a design matrix already: no formula is read, each column of x_cols is a regressor."""
    return feglm(ModelSpec(y, tuple((c,) for c in x_cols), tuple(fe), tuple(clusters), intercept and not fe), data, family=family, **how)


def fit_offset(fit: Result, offset, data: DataFrame | None = None) -> Result:
    """The fixed effects of a fitted model's family alone, given an offset (an expression) that holds all the rest."""
    data = fit.data if data is None else data
    if data is None:
        raise ValueError("fit_offset needs keep_data or data.")
    spec = replace(fit.spec, terms=(), clusters=(), intercept=fit.spec.intercept)
    return feglm(spec, data, family=fit.family, weights=fit.weights, offset=offset, vcov="iid", control=replace(fit.control, vcov_type=None, compute_apes=False, compute_bias_corr=False))


def _mixed(old: State, new: State, rho: float) -> State:
    """The state a step of length rho from old to new leads to."""
    if rho == 1:
        return new
    beta = (1 - rho) * old.beta + rho * new.beta
    if new.effects is None:
        return State(beta, None, (1 - rho) * old.const + rho * new.const)
    base = old.effects or [a.constant(old.const if k == 0 else 0.0) for k, a in enumerate(new.effects)]
    return State(beta, [a.mixed(b, rho) for a, b in zip(base, new.effects, strict=True)])


def _irls(rows, prep, fam, control, kind, data, weights, offset, beta_start=None, eta_start=None, begin: State | None = None, quiet: bool = False) -> Result:
    f, p = prep.f, len(prep.names)
    ybar, means = rows.moments()
    if not f:
        means = np.zeros(p)
    removed, separators = 0, []
    # a level whose responses are all 0 has no finite effect
    parted = fam.name in ("poisson", "negbin", "binomial", "probit") or (fam.name in ("gamma", "inverse.gaussian") and prep.y_range[0] <= 0)
    if control.check_separation and f and begin is None and parted:
        removed, separators = separate(rows, fam, means, control)
        if removed >= prep.nobs:
            raise ValueError("all observations are separated.")
    beta = np.zeros(p) if beta_start is None else np.asarray(beta_start, float)
    state = begin or State(beta, None, fam.link(ybar) if eta_start is None else float(eta_start))
    keep, warm, found, conv, dev, it = None, None, None, False, None, 0
    # effects are centred loosely while coefficients move, and to the full tolerance before a fit may end
    best, crit = min(control.center_tol, 1e-8), 1.0
    tol = best if fam.name == "tobit" else max(best, 1e-4)
    # regressors that others give already, before anything is taken out; the first step looks again at what the effects leave
    first = np.flatnonzero(linalg.kept_columns(rows.raw_products(), control.collin_tol)) if p else np.zeros(0, int)
    for it in range(1, control.iter_max + 1):
        if fam.name == "tobit":
            s = rows.sigma(fam, state)
            fam = replace(fam, sigma=s if s > 0 else 1.0)
        use = (first if keep is None else np.flatnonzero(keep)).tolist()
        found = rows.working(fam, state, use, means, tol, warm)
        b, ok = found.solved(control.collin_tol)
        if keep is None:
            if not ok.all():
                g = [0, *(1 + np.flatnonzero(ok)).tolist()]
                found.levels, found.gram = [a.picked(g) for a in found.levels], found.gram[np.ix_(g, g)]
            use, b, keep = first[ok].tolist(), b[ok], np.zeros(p, bool)
            keep[use] = True
        warm = found.levels or None
        b, full = np.nan_to_num(b), np.zeros(p)
        full[use] = b
        effects = [a.combined([1.0, *(-b)]) for a in found.levels] if f else None
        if f:
            effects[0] = effects[0].shifted(-float(means[use] @ b))
        new = State(full, effects)
        state, dev, moved, crit = _step(rows, fam, control, state, new, dev)
        if tol <= best and (not moved or crit < control.dev_tol * (1 + 1e-10)):
            conv = True
            break
        if not moved:
            tol = best
        else:
            tol = best if crit < 1e-3 or tol <= best else max(best, min(tol, crit * 1e-3))
    warn_unsettled(found)
    out_beta = np.where(keep, state.beta, np.nan)
    effects = state.effects if state.effects is not None else [a.constant(state.const if k == 0 else 0.0) for k, a in enumerate(found.levels)]
    n, at, h = prep.nobs, np.flatnonzero(keep), found.gram[1:, 1:]
    nobs = {"nobs_full": prep.nobs_full, "nobs_na": prep.nobs_full - n, "nobs_separated": removed, "nobs_pc": 0, "nobs": n}
    stats = {"deviance": dev, "conv": conv, "iter": it, "vcov": kind}
    out = Result("feglm", prep.spec, control, fam, prep.names, out_beta, None, kind, prep, effects, nobs, stats, weights, offset, data if control.keep_data else None, separators)
    null, corr = rows.summary(fam, state, ybar)
    stats["null_deviance"] = null
    if fam.name == "poisson":
        stats["pseudo_r_squared"] = corr**2
    alpha_x = [a.picked(list(range(1, 1 + len(at)))) for a in found.levels]
    out.at, out.means, out.alpha_x, out.state = at, means, alpha_x, state
    h_inv = linalg.inverse(h) if len(at) else np.zeros((0, 0))
    cov = h_inv if kind == "iid" or not len(at) else rows.meat(kind, h_inv, fam, state, at, means, alpha_x)
    out.vcov_matrix = linalg.expand(cov, keep)
    if control.return_hessian:
        stats["hessian"] = linalg.expand(h, keep)
    if removed and not quiet:
        warnings.warn(f"Separation detected: {removed} observation(s) with perfect prediction were excluded.", stacklevel=3)
    if fam.name == "binomial" and (control.compute_apes or control.compute_bias_corr):
        from .partial_effects import average_partial_effects, bias_correction

        if control.compute_bias_corr:
            bias_correction(out, at, means, alpha_x, h)
        if control.compute_apes:
            average_partial_effects(out, at, means, alpha_x, h)
    return out


def _step(rows, fam, control, old: State, new: State, dev0):
    """The longest step rho = 1, factor, factor^2, ... that does not raise the deviance beyond noise; many rho share one pass. A tobit
    step must lower its sum of squares by dev_tol: its weights do not follow from that sum, so that the fit ends where it no longer falls.

    Returns (state, deviance, whether a step was taken, change of the coefficients and of the linear predictor, relative)."""
    most = -control.dev_tol if fam.name == "tobit" else NOISE
    tried, rhos = 0, [1.0]
    while tried < control.iter_inner_max and rhos:
        (aa, ad, dd, n), before, dev, ok = rows.compare(fam, old, new, rhos)
        if dev0 is None:
            dev0 = before if np.isfinite(before) else np.inf
        for rho, d, valid in zip(rhos, dev, ok, strict=True):
            if valid and np.isfinite(d) and (not np.isfinite(dev0) or d - dev0 <= most * (0.1 + abs(d))):
                state = _mixed(old, new, rho)
                size = np.sqrt(max(aa + 2 * rho * ad + rho * rho * dd, 0.0) / max(n, 1.0))
                crit = rho * np.sqrt(max(dd, 0.0) / max(n, 1.0)) / max(size, 0.1)
                if len(state.beta):
                    crit = max(crit, float(np.linalg.norm(state.beta - old.beta) / max(np.linalg.norm(state.beta), np.finfo(float).eps)))
                return state, d, True, crit
        tried += len(rhos)
        last = rhos[-1]
        rhos = [last * control.step_halving_factor ** (k + 1) for k in range(min(8, control.iter_inner_max - tried)) if last * control.step_halving_factor ** (k + 1) > (0 if fam.name == "tobit" else 1e-6)]
    if old.effects is None and new.effects is not None:
        return new, dev0, False, 0.0
    return old, dev0, False, 0.0


def estimate_theta(df: DataFrame, response: str) -> float:
    """Dispersion of the negative binomial by moments: mean^2 / (variance - mean), within 0.1 and 1e6."""
    m, v = df.agg(F.avg(response), F.var_samp(response)).first()
    if v is None or v - m <= 0.01 * m:
        return 1e6
    return min(max(m * m / (v - m), 0.1), 1e6)


def fenegbin(formula, data: DataFrame, weights=None, beta_start=None, eta_start=None, init_theta: float | None = None, link: str = "log", offset=None, vcov: str | None = None, control=None) -> Result:
    """Negative binomial model. A Poisson fit starts it; then coefficients given theta, and theta by moments of the response, in turn
    until both settle. init_theta starts theta. link names the link that the model reports; the fit's link is the logarithm."""
    if link not in ("log", "identity", "sqrt"):
        raise ValueError("'link' should be one of 'log', 'identity', 'sqrt'.")
    prep, control = _start(formula, data, weights, offset, control)
    init_theta = control.init_theta if init_theta is None else init_theta
    if init_theta is None or isinstance(init_theta, bool) or not isinstance(init_theta, (int, float)) or init_theta < 0:
        raise ValueError("'init_theta' has to be a positive number.")
    _check_response(prep, Family("negbin"), control)
    kind = _vcov_kind(vcov, control, prep.spec)
    rows = rows_of(prep, control, kind not in ("iid", "hetero"))
    how = (control, kind, data, weights, offset)
    out = _irls(rows, prep, Family("poisson"), control, "iid", data, weights, offset, beta_start, eta_start, quiet=True)
    removed, separators = out.nobs["nobs_separated"], out.separators
    moments = estimate_theta(prep.df, "_y")
    theta, settled, rounds = float(init_theta) or moments, False, 0
    if out.stats["conv"]:
        for rounds in range(1, control.iter_max + 1):
            last = out.state.beta
            out = _irls(rows, prep, Family("negbin", theta=theta), *how, begin=out.state)
            change = np.linalg.norm(out.state.beta - last) / max(np.linalg.norm(out.state.beta), np.finfo(float).eps)
            settled = bool(out.stats["conv"] and change <= control.dev_tol and abs(moments - theta) / (0.1 + abs(theta)) <= control.dev_tol)
            theta = moments
            if settled or not out.stats["conv"]:
                break
    released(rows)
    out.kind, out.separators, out.vcov_given = "fenegbin", separators, vcov
    out.nobs["nobs_separated"] = removed
    out.stats |= {"theta": theta, "iter_outer": rounds, "conv_outer": settled, "link": link}
    if removed:
        warnings.warn(f"Separation detected: {removed} observation(s) with perfect prediction were excluded.", stacklevel=2)
    return out
