"""Where a fit's passes run: over arrays on the driver when the model's columns are small (equal rows counted once), else over a
persisted table in Spark. Both hold y, prior weights, offset, regressors, effect and cluster keys, and give the same numbers."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.control import FitControl
from . import linalg, vcov
from .centering import Centered, center, center_arrays, coded, count_cells, products, square, tightened
from .levels import checkpointed, with_effects

#: Equal rows are counted once where that leaves at most one row in so many.
FOLD = 4
#: Different rows with y = 0 that the simplex test takes to the driver in a Spark fit.
SIMPLEX_ROWS = 200_000


class State:
    """Coefficients, level effects (one column each; None until the first step) and a constant of the linear predictor."""

    def __init__(self, beta: np.ndarray, effects: list | None, const: float = 0.0):
        self.beta, self.effects, self.const = beta, effects, const


def pulled(df: DataFrame, control: FitControl, rows: int | None = None) -> pa.Table | None:
    """df on the driver, if its columns take local_bytes at most."""
    rows = df.count() if rows is None else rows
    return df.toArrow() if rows * len(df.columns) * 8 <= control.local_bytes else None


def model_columns(prep, clusters: bool) -> list[str]:
    return ["_y", *(["_w"] if prep.weighted else []), *(["_o"] if prep.has_offset else []), *prep.varying, *prep.f, *(prep.c if clusters else [])]


def rows_of(prep, control: FitControl, clusters: bool):
    """The engine for a prepared table. clusters: whether the covariance needs the cluster keys."""
    cols = model_columns(prep, clusters)
    df = prep.df.select(*cols)
    different = prep.nobs if clusters and not prep.distinct_with_clusters else prep.distinct
    rows = prep.nobs
    if different * FOLD <= prep.nobs:
        df, rows = df.groupBy(*cols).agg(F.count("*").alias("_n")), int(different * 1.2) + 1
    t = pulled(df, control, rows)
    return ArrayRows(prep, t, control, clusters) if t is not None else TableRows(prep, df, control, clusters)


class ArrayRows:
    def __init__(self, prep, t: pa.Table, control: FitControl, clusters: bool):
        self.prep, self.control = prep, control
        have = set(t.column_names)
        number = lambda c: t.column(c).to_numpy().astype(float)
        self.y = number("_y")
        self.n = number("_n") if "_n" in have else np.ones(len(self.y))
        self.w = (number("_w") if "_w" in have else 1.0) * self.n
        self.o = number("_o") if "_o" in have else np.zeros(len(self.y))
        self.x = np.stack([number(c) if c in have else np.ones(len(self.y)) for c in prep.x], axis=1) if prep.x else np.zeros((len(self.y), 0))
        self.codes, self.keys = map(list, zip(*(coded(t.column(k)) for k in prep.f), strict=True)) if prep.f else ([], [])
        self.clusters = [coded(t.column(k)) for k in prep.c] if clusters else []
        self.on = self.w > 0  # rows that are not separated

    # -- moments
    def moments(self) -> tuple[float, np.ndarray]:
        """Means of y and of the regressors, without weights."""
        return float(self.n @ self.y / self.n.sum()), self.n @ self.x / self.n.sum()

    def raw_products(self) -> np.ndarray:
        """Products of the regressors under the prior weights, nothing taken out."""
        return (self.x * self.w[:, None]).T @ self.x

    def total(self) -> float:
        """Sum of squares of y around its weighted mean."""
        d = self.y - self.w @ self.y / self.w.sum()
        return float(self.w @ (d * d))

    def eta(self, s: State) -> np.ndarray:
        out = self.o + s.const + self.x @ s.beta
        for c, a in zip(self.codes, s.effects or [], strict=bool(s.effects)):
            out = out + a.values[c, 0]
        return out

    # -- steps of a fit
    def linear(self, means_y: float, means: np.ndarray) -> Centered:
        v = np.column_stack([self.y - means_y, self.x - means])
        return center_arrays(v, self.w, self.codes, self.keys, self.control)[0]

    def sigma(self, fam: Family, s: State) -> float:
        left, right = fam.censored(self.y)
        free = ~left & ~right
        r = (self.y - self.eta(s))[free]
        return float(np.sqrt((self.n[free] * r * r).sum() / self.n[free].sum())) if free.any() else 0.0

    def working(self, fam: Family, s: State, use: list[int], means: np.ndarray, tol: float, warm) -> Centered:
        with np.errstate(all="ignore"):
            eta = self.eta(s)
            ww, nu = fam.working(eta, fam.mu(eta), self.y, self.w)
            z = eta + nu - self.o
        fine = np.isfinite(ww) & np.isfinite(z)
        v = np.column_stack([np.where(fine, z, 0.0), self.x[:, use] - means[use]])
        return center_arrays(v, np.where(fine, ww, 0.0), self.codes, self.keys, tightened(self.control, tol), warm)[0]

    def compare(self, fam: Family, old: State, new: State, rhos: list[float]):
        """(sum of eta^2, eta d, d^2 with d the step, rows; deviance before; deviance and validity at each step length)."""
        a, b = self.eta(old), self.eta(new)
        d = b - a
        on, n = self.on, self.n
        dev, ok = [], []
        with np.errstate(all="ignore"):
            for rho in [0.0, *rhos]:
                eta = a + rho * d if rho != 1 else b
                mu = fam.mu(eta)
                dev.append(float((self.w * fam.deviance(mu, self.y))[on].sum()))
                ok.append(bool(np.all(fam.valid(eta, mu)[on])))
        return (float((n * a * a)[on].sum()), float((n * a * d)[on].sum()), float((n * d * d)[on].sum()), float(n[on].sum())), dev[0], dev[1:], ok[1:]

    def summary(self, fam: Family, s: State, ybar: float) -> tuple[float, float]:
        """(null deviance, correlation of y and mu)."""
        on = self.on
        null = float((self.w * fam.deviance(np.full(len(self.y), ybar), self.y))[on].sum())
        mu, y, n = fam.mu(self.eta(s))[on], self.y[on], self.n[on]
        a, b = mu - n @ mu / n.sum(), y - n @ y / n.sum()
        with np.errstate(all="ignore"):
            return null, float((n * a * b).sum() / np.sqrt((n * a * a).sum() * (n * b * b).sum()))

    def meat(self, kind: str, h_inv: np.ndarray, fam: Family, s: State, at, means, alpha_x) -> np.ndarray:
        x = self.x[:, at] - means[at]
        for c, a in zip(self.codes, alpha_x, strict=True):
            x = x - a.values[c]
        score = np.where(self.on[:, None], x * (self.y - fam.mu(self.eta(s)))[:, None], 0.0)
        return vcov.sandwich(kind, h_inv, vcov.ArrayScores(score[self.on], self.n[self.on], [(c[self.on], k) for c, k in self.clusters]))

    # -- separation
    def drop_levels(self, binary: bool) -> list[DataFrame | None]:
        """Weights become 0 in levels whose mean response is 0 (or 1); returns their keys for each effect."""
        gone = [np.zeros(len(k), bool) for k in self.keys]
        changed = True
        while changed:
            changed = False
            for h, c in enumerate(self.codes):
                w, s = np.bincount(c, self.w, len(gone[h])), np.bincount(c, self.w * self.y, len(gone[h]))
                mean = np.where(w > 0, s / np.where(w > 0, w, 1), 0.5)
                bad = (w > 0) & ((mean <= 0) | (binary & (mean >= 1)))
                if bad.any():
                    gone[h] |= bad
                    self.w = np.where(bad[c], 0.0, self.w)
                    changed = True
        self.on = self.w > 0
        spark = self.prep.df.sparkSession
        return [spark.createDataFrame(pa.table([self.keys[h].filter(pa.array(g))], names=["k"])) if g.any() else None for h, g in enumerate(gone)]

    def boundary(self) -> bool:
        return bool((self.on & (self.y <= 0)).any())

    def rectifier(self, s: State | None, means: np.ndarray, heavy: float, tol: float):
        """One round: (bounds of the fit at y = 0, or None in the first round; the next fit)."""
        zero = self.y <= 0
        if s is None:
            u, bounds = np.where(zero, 1.0, 0.0), None
        else:
            fit = self.eta(s) - self.o
            inside = fit[zero & self.on]
            u, bounds = np.where(zero, np.maximum(fit, 0), 0.0), (float(inside.min()), float(inside.max()))
        w = np.where(self.on, np.where(zero, 1.0, heavy), 0.0) * self.n
        v = np.column_stack([u, self.x - means])
        return bounds, lambda: center_arrays(v, w, self.codes, self.keys, tightened(self.control, tol))[0]

    def drop_fit(self, s: State, tol: float) -> None:
        self.w = np.where((self.y <= 0) & (self.eta(s) - self.o > tol), 0.0, self.w)
        self.on = self.w > 0

    def separated(self) -> int:
        return int(self.n[~self.on & (self._prior() > 0)].sum())

    def _prior(self) -> np.ndarray:
        return self._w0 if hasattr(self, "_w0") else self.w

    def remember(self) -> None:
        self._w0 = self.w.copy()

    def interior(self, means: np.ndarray):
        """Where y > 0: rows, sums and products of the regressors less `means`."""
        inside = self.on & (self.y > 0)
        x, n = (self.x - means)[inside], self.n[inside]
        return n.sum(), n @ x, (x * n[:, None]).T @ x

    def boundary_rows(self, means: np.ndarray) -> np.ndarray:
        """Distinct rows of the regressors less `means` where y = 0."""
        return np.unique((self.x - means)[self.on & (self.y <= 0)], axis=0)


class TableRows:
    def __init__(self, prep, df: DataFrame, control: FitControl, clusters: bool):
        self.prep, self.control, self.clusters = prep, control, clusters
        have = set(df.columns)
        n = F.col("_n").cast("double") if "_n" in have else F.lit(1.0)
        cols = {"_n": n, "_w": (F.col("_w") if "_w" in have else F.lit(1.0)) * n} | ({} if "_o" in have else {"_o": F.lit(0.0)}) | {c: F.lit(1.0) for c in prep.x if c not in have}
        self.df = df.withColumns(cols).persist()
        self.cells = count_cells(self.df, prep.f)
        self.y, self.w, self.n = F.col("_y"), F.col("_w"), F.col("_n")

    def _swap(self, df: DataFrame) -> None:
        """Use the rows of df from now on; the old ones leave memory."""
        new = df.persist()
        new.count()
        self.df.unpersist()
        self.df = new

    def moments(self):
        r = self.df.agg(F.sum("_n"), F.sum(self.n * self.y), *[F.sum(self.n * F.col(c)) for c in self.prep.x]).first()
        return r[1] / r[0], np.array(r[2:], float) / r[0]

    def raw_products(self) -> np.ndarray:
        return square(self.df.agg(*products([F.col(c) for c in self.prep.x], self.w)).first(), len(self.prep.x))

    def total(self) -> float:
        r = self.df.agg(F.sum("_w"), F.sum(self.w * self.y)).first()
        d = self.y - F.lit(r[1] / r[0])
        return float(self.df.agg(F.sum(self.w * d * d)).first()[0])

    def _with(self, states: list[State]) -> DataFrame:
        df = self.df
        for i, s in enumerate(states):
            if s.effects:
                df = with_effects(df, self.prep.f, s.effects, f"_st{i}_", 1, self.control.broadcast_levels)
            total = F.col("_o") + F.lit(float(s.const))
            for b, c in zip(s.beta, self.prep.x, strict=True):
                if b:
                    total = total + F.lit(float(b)) * F.col(c)
            df = df.withColumn(f"_eta{i}", total + F.col(f"_st{i}_0") if s.effects else total)
        return df

    def _center(self, rows: DataFrame, v, w, tol: float, warm=None) -> Centered:
        return center(rows, self.prep.f, v, w, tightened(self.control, tol), self.cells, warm)

    def linear(self, means_y: float, means: np.ndarray) -> Centered:
        v = [self.y - F.lit(means_y), *[F.col(c) - F.lit(float(m)) for c, m in zip(self.prep.x, means, strict=True)]]
        return self._center(self.df, v, self.w, self.control.center_tol)

    def sigma(self, fam: Family, s: State) -> float:
        left, right = fam.censored(self.y)
        d = self.y - F.col("_eta0")
        r = self._with([s]).where(~left & ~right).agg(F.sum(self.n * d * d) / F.sum("_n")).first()[0]
        return float(np.sqrt(r)) if r else 0.0

    def working(self, fam: Family, s: State, use: list[int], means: np.ndarray, tol: float, warm) -> Centered:
        rows = self._with([s]).withColumn("_mu0", fam.mu(F.col("_eta0")))
        ww, nu = fam.working(F.col("_eta0"), F.col("_mu0"), self.y, self.w)
        rows = rows.withColumns({"_ww": ww, "_z": F.col("_eta0") + nu - F.col("_o")})
        whole = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        fine = whole("_ww") & whole("_z")
        v = [F.when(fine, F.col("_z")).otherwise(0.0), *[F.col(self.prep.x[j]) - F.lit(float(means[j])) for j in use]]
        return self._center(rows, v, F.when(fine, F.col("_ww")).otherwise(0.0), tol, warm)

    def compare(self, fam: Family, old: State, new: State, rhos: list[float]):
        a, b = F.col("_eta0"), F.col("_eta1")
        d, on = b - a, self.w > 0
        want = []
        for rho in [0.0, *rhos]:
            eta = a if rho == 0 else b if rho == 1 else a + F.lit(rho) * d
            mu = fam.mu(eta)
            want += [F.sum(F.when(on, self.w * fam.deviance(mu, self.y)).otherwise(0.0)), F.min((fam.valid(eta, mu) | ~on).cast("int"))]
        when = lambda c: F.sum(F.when(on, self.n * c))
        r = self._with([old, new]).agg(when(a * a), when(a * d), when(d * d), when(F.lit(1.0)), *want).first()
        dev = [float("nan") if x is None else float(x) for x in r[4::2]]
        return tuple(float(x) for x in r[:4]), dev[0], dev[1:], [bool(x) for x in r[5::2]][1:]

    def summary(self, fam: Family, s: State, ybar: float) -> tuple[float, float]:
        rows = self._with([s]).where(self.w > 0).withColumn("_mu0", fam.mu(F.col("_eta0")))
        null, n, m, y = rows.agg(F.sum(self.w * fam.deviance(F.lit(float(ybar)), self.y)), F.sum("_n"), F.sum(self.n * F.col("_mu0")), F.sum(self.n * self.y)).first()
        a, b = F.col("_mu0") - F.lit(m / n), self.y - F.lit(y / n)
        ab, aa, bb = rows.agg(F.sum(self.n * a * b), F.sum(self.n * a * a), F.sum(self.n * b * b)).first()
        return float(null), float(ab / np.sqrt(aa * bb)) if aa and bb else float("nan")

    def meat(self, kind: str, h_inv: np.ndarray, fam: Family, s: State, at, means, alpha_x) -> np.ndarray:
        rows = self._with([s]).where(self.w > 0)
        if self.prep.f:
            rows = with_effects(rows, self.prep.f, alpha_x, "_ax", len(at), self.control.broadcast_levels)
        e = self.y - fam.mu(F.col("_eta0"))
        cols = {f"_s{i}": (F.col(self.prep.x[j]) - F.lit(float(means[j])) - (F.col(f"_ax{i}") if self.prep.f else F.lit(0.0))) * e for i, j in enumerate(at)}
        return vcov.sandwich(kind, h_inv, vcov.TableScores(rows.select("_n", *(self.prep.c if self.clusters else []), *[v.alias(k) for k, v in cols.items()]), self.prep.c if self.clusters else [], list(cols)))

    def drop_levels(self, binary: bool) -> list[DataFrame | None]:
        gone: list[DataFrame | None] = [None] * len(self.prep.f)
        changed = True
        while changed:
            changed = False
            for h, f in enumerate(self.prep.f):
                m = F.col("s") / F.col("w")
                bad = self.df.where(self.w > 0).groupBy(F.col(f).alias("k")).agg(F.sum("_w").alias("w"), F.sum(self.w * self.y).alias("s")).where((m <= 0) | (F.lit(binary) & (m >= 1))).select("k")
                bad = checkpointed(bad)
                if bad.isEmpty():
                    continue
                changed = True
                gone[h] = bad if gone[h] is None else checkpointed(gone[h].union(bad))
                flag = bad.select(F.col("k").alias(f), F.lit(1).alias("_gone"))
                self._swap(checkpointed(self.df.join(flag, f, "left").withColumn("_w", F.when(F.col("_gone").isNull(), self.w).otherwise(0.0)).drop("_gone")))
        return gone

    def boundary(self) -> bool:
        return not self.df.where((self.w > 0) & (self.y <= 0)).isEmpty()

    def rectifier(self, s: State | None, means: np.ndarray, heavy: float, tol: float):
        zero, rows, bounds = self.y <= 0, self.df, None
        if s is None:
            u = F.when(zero, 1.0).otherwise(0.0)
        else:
            rows = self._with([s])
            fit = F.col("_eta0") - F.col("_o")
            bounds = tuple(rows.where(zero & (self.w > 0)).agg(F.min(fit), F.max(fit)).first())
            u = F.when(zero, F.greatest(fit, F.lit(0.0))).otherwise(0.0)
        w = F.when(self.w > 0, F.when(zero, 1.0).otherwise(heavy)).otherwise(0.0) * self.n
        v = [u, *[F.col(c) - F.lit(float(m)) for c, m in zip(self.prep.x, means, strict=True)]]
        return bounds, lambda: self._center(rows, v, w, tol)

    def drop_fit(self, s: State, tol: float) -> None:
        rows = self._with([s]).withColumn("_w", F.when((self.y <= 0) & (F.col("_eta0") - F.col("_o") > tol), 0.0).otherwise(self.w))
        self._swap(checkpointed(rows.select(*self.df.columns)))

    def remember(self) -> None:
        self._before = self.df.where(self.w > 0).agg(F.sum("_n")).first()[0] or 0

    def separated(self) -> int:
        return int(self._before - (self.df.where(self.w > 0).agg(F.sum("_n")).first()[0] or 0))

    def interior(self, means: np.ndarray):
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(self.prep.x, means, strict=True)]
        r = self.df.where((self.w > 0) & (self.y > 0)).agg(F.sum("_n"), *[F.sum(self.n * c) for c in x], *products(x, self.n)).first()
        return r[0] or 0.0, np.array([v or 0.0 for v in r[1 : 1 + len(x)]]), square(r[1 + len(x) :], len(x))

    def boundary_rows(self, means: np.ndarray) -> np.ndarray | None:
        x = [(F.col(c) - F.lit(float(m))).alias(f"x{j}") for j, (c, m) in enumerate(zip(self.prep.x, means, strict=True))]
        t = self.df.where((self.w > 0) & (self.y <= 0)).select(*x).distinct()
        if t.count() > SIMPLEX_ROWS:
            warnings.warn(f"more than {SIMPLEX_ROWS} different rows with y = 0: the simplex test is left to the rectifier.", stacklevel=2)
            return None
        return np.stack([c.to_numpy() for c in t.toArrow().columns], axis=1)


def released(rows) -> None:
    if isinstance(rows, TableRows):
        rows.df.unpersist()


def separate(rows, fam: Family, means: np.ndarray, control: FitControl):
    """Weights of separated observations become 0. Returns (number of them, separators): a separator is (effect number, table of
    levels k), or a State whose fit is positive where an observation with y = 0 is separated."""
    rows.remember()
    out: list = [(h, t) for h, t in enumerate(rows.drop_levels(fam.name in ("binomial", "probit"))) if t is not None]
    if fam.name == "poisson" and rows.prep.x and rows.boundary():
        for found in ([_simplex(rows, means, control)] if control.sep_use_simplex else []) + ([_rectified(rows, means, control)] if control.sep_use_relu else []):
            if found is not None:
                out.append(found)
                rows.drop_fit(found, max(control.sep_tol, 1e-5))
    return (rows.separated() if out else 0), out


def _rectified(rows, means: np.ndarray, control: FitControl) -> State | None:
    """Iterated rectifier: regress u (1 where y = 0) on the regressors and effects with a large weight where y > 0; u becomes the
    positive part of the fit; rows with y = 0 whose fit stays positive are separated."""
    s, heavy = None, float(1 / np.sqrt(np.finfo(float).eps))
    for _ in range(control.sep_max_iter):
        bounds, fit = rows.rectifier(s, means, heavy, 1e-10)
        if bounds is not None and (bounds[1] <= control.sep_zero_tol or bounds[0] >= -control.sep_zero_tol):
            return s if bounds[1] > max(control.sep_tol, 1e-5) else None
        found = fit()
        b, _ = found.solved(control.collin_tol)
        b = np.nan_to_num(b)
        effects = [a.combined([1.0, *(-b)]) for a in found.levels]
        s = State(b, effects or None, 0.0)
        if effects:
            effects[0] = effects[0].shifted(-float(means @ b))
        else:
            s.const = -float(means @ b)
    return None


def _simplex(rows, means: np.ndarray, control: FitControl) -> State | None:
    """Separation by the regressors alone: a combination of them that is constant where y > 0, and not below that where y = 0.

    Combinations without spread where y > 0 come from the null space of the products there; among them a linear programme on the
    distinct rows with y = 0 finds one that is positive wherever any can be.
    """
    n, sums, inside = rows.interior(means)
    if not n:
        return None
    shift = sums / n
    inside = inside / n - np.outer(shift, shift)
    scale = np.sqrt(np.maximum(np.diag(inside), shift * shift))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(inside / np.outer(scale, scale))
    null = vectors[:, values <= 1e-10]
    z = rows.boundary_rows(means + shift) if null.shape[1] else None
    if z is None or not len(z):
        return None
    d = linalg.widest_cone(z / scale @ null, control.sep_simplex_max_iter, control.sep_tol)
    if d is None:
        return None
    beta = null @ d / scale
    return State(beta, None, -float((means + shift) @ beta))
