"""Dense algebra on matrices as large as the number of regressors; all of it runs on the driver."""

from __future__ import annotations

import numpy as np

from ..functions.families import erfc


#: Share of a sum of squares that is noise of summation.
NOISE = 1e-11


def kept_columns(gram: np.ndarray, tol: float, raw: np.ndarray | None = None) -> np.ndarray:
    """Columns that add rank, earlier ones first: a column goes if its squared distance from the kept ones is below tol, or noise.
    raw: squares of the columns before something was taken out of them."""
    p = len(gram)
    floor = np.maximum(tol, NOISE * np.maximum(np.abs(np.diag(gram)), 0.0 if raw is None else raw))
    basis, keep = np.zeros((p, 0)), np.zeros(p, bool)
    for j in range(p):
        left = gram[j, j] - basis[j] @ basis[j]
        if not np.isfinite(left) or left < floor[j]:
            continue
        new = (gram[:, j] - basis @ basis[j]) / np.sqrt(left)
        basis = np.column_stack([basis, new])
        keep[j] = True
    return keep


def solve(gram: np.ndarray, moment: np.ndarray, tol: float, raw: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(beta with NaN for dropped columns, kept)."""
    keep = kept_columns(gram, tol, raw)
    beta = np.full(len(gram), np.nan)
    if keep.any():
        beta[keep] = np.linalg.solve(gram[np.ix_(keep, keep)], moment[keep])
    return beta, keep


def inverse(h: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return np.full_like(h, np.inf)


def expand(m: np.ndarray, keep: np.ndarray) -> np.ndarray:
    out = np.full((len(keep), len(keep)), np.nan)
    out[np.ix_(keep, keep)] = m
    return out


def coef_table(beta: np.ndarray, vcov: np.ndarray) -> np.ndarray:
    """Estimate, standard error, z and two-sided normal p."""
    with np.errstate(invalid="ignore", divide="ignore"):
        se = np.sqrt(np.diag(vcov))
        z = beta / se
    return np.column_stack([beta, se, z, erfc(np.abs(z) / np.sqrt(2))])


def widest_cone(z: np.ndarray, iter_max: int, tol: float = 1e-8) -> np.ndarray | None:
    """d with z d >= 0, and z_i d >= 1 for each row i that any such d makes positive; None if there is no such row.

    By the dual linear programme: the most rows that a non-negative combination of rows equal to zero can hold, that is
    max sum(s) with z'(s + t) = 0, 0 <= s <= 1, t >= 0; a row without support is one that d makes positive, and the multipliers of
    the equalities are d. Bounded simplex steps with the first eligible column; the basis has as many rows as z has columns.
    """
    n, q = z.shape
    z = np.where(np.abs(z) <= tol, 0.0, z)
    a = np.concatenate([z.T, z.T, np.eye(q)], axis=1)
    cost = np.concatenate([np.ones(n), np.zeros(n + q)])
    upper = np.concatenate([np.ones(n), np.full(n, np.inf), np.zeros(q)])
    basis, at_upper, value = list(range(2 * n, 2 * n + q)), np.zeros(2 * n + q, bool), np.zeros(q)
    inside = np.zeros(2 * n + q, bool)
    inside[basis] = True
    y = np.zeros(q)
    for _ in range(iter_max):
        b = a[:, basis]
        y = np.linalg.solve(b.T, cost[basis])
        gain = cost - y @ a
        ready = np.flatnonzero(~inside & np.where(at_upper, gain < -1e-9, (gain > 1e-9) & (upper > 0)))
        if not len(ready):
            break
        j = int(ready[0])
        sign = -1.0 if at_upper[j] else 1.0
        slope = sign * np.linalg.solve(b, a[:, j])  # basics fall by slope times the step
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(slope > 1e-12, value / slope, np.where(slope < -1e-12, (value - upper[basis]) / slope, np.inf))
        room = np.maximum(room, 0.0)
        least = float(room.min(initial=np.inf))
        if upper[j] <= least:
            if not np.isfinite(upper[j]):
                break
            value = value - slope * upper[j]
            at_upper[j] = not at_upper[j]
            continue
        out = min((i for i in range(q) if room[i] <= least + 1e-12), key=lambda i: basis[i])
        value = value - slope * least
        gone = basis[out]
        inside[gone], at_upper[gone] = False, bool(slope[out] < 0 and np.isfinite(upper[gone]))
        value[out] = (upper[j] if at_upper[j] else 0.0) + sign * least
        basis[out], inside[j], at_upper[j] = j, True, False
    fit = z @ y
    return y if fit.max(initial=0) > 0.5 and fit.min(initial=0) >= -1e-6 else None
