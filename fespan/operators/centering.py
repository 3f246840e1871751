"""Partialling out fixed effects from weighted columns.

On arrays (rows or cells on the driver): accelerated alternating projections. On tables: one aggregation where there is no effect or
one, else the same projections with level tables that are joined and aggregated, and never reach the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.control import FitControl
from .levels import ArrayLevels, TableLevels, checkpointed, with_effects
from .linalg import solve

#: Rounds of extrapolation after which the sum of squares is looked at.
SSR_ROUNDS = 40


@dataclass
class Centered:
    """gram: of all columns after the effects are taken out; levels: for each effect its coefficients, one column for each; raw: the
    columns' squares before, where gram is a difference of them."""

    gram: np.ndarray
    levels: list
    sweeps: int = 0
    settled: bool = True
    raw: np.ndarray | None = None

    def solved(self, tol: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the first column on the others, and which of these are kept."""
        return solve(self.gram[1:, 1:], self.gram[1:, 0], tol, None if self.raw is None else self.raw[1:])


def products(v: list[Column], w: Column) -> list[Column]:
    return [F.sum(w * v[i] * v[j]).alias(f"g{i}_{j}") for i in range(len(v)) for j in range(i + 1)]


def square(values, m: int) -> np.ndarray:
    g, k = np.zeros((m, m)), 0
    for i in range(m):
        for j in range(i + 1):
            g[i, j] = g[j, i] = values[k] or 0.0
            k += 1
    return g


# -- extrapolation
def irons_tuck(x: np.ndarray, gx: np.ndarray, ggx: np.ndarray) -> np.ndarray:
    """Extrapolation of a fixed-point sequence from three terms, for each column."""
    d1 = ggx - gx
    d2 = d1 - (gx - x)
    ssq = (d2 * d2).sum(axis=0)
    c = np.where(ssq > 0, (d1 * d2).sum(axis=0) / np.where(ssq > 0, ssq, 1), 0.0)
    return ggx - c * d1


def reduced_rank(x: np.ndarray, x1: np.ndarray, x2: np.ndarray, x3: np.ndarray) -> np.ndarray:
    """Reduced rank extrapolation of order two, for each column: the differences u0, u1 are combined so that the second
    differences cancel u0 best; where these are parallel, the three-term rule."""
    u0, u1, u2 = x1 - x, x2 - x1, x3 - x2
    a, b = u1 - u0, u2 - u1
    aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
    ua, ub = (u0 * a).sum(axis=0), (u0 * b).sum(axis=0)
    det = aa * bb - ab * ab
    fine = det > 1e-14 * aa * bb
    safe = np.where(fine, det, 1.0)
    out = x + (-(ua * bb - ub * ab) / safe) * u0 + (-(ub * aa - ua * ab) / safe) * u1
    return np.where(fine & np.isfinite(out).all(axis=0), out, irons_tuck(x1, x2, x3))


def close(x: np.ndarray, y: np.ndarray, tol: float) -> bool:
    gap = np.abs(y - x)
    return not ((gap > tol) & (gap > tol * (0.1 + np.abs(y)))).any()


# -- arrays
class Sweeps:
    """Alternating projections of weighted sums on the levels of K effects.

    codes: for each effect the level of every row (or cell); w: weights; sums: weighted column sums of every row.
    """

    def __init__(self, codes: list[np.ndarray], sizes: list[int], w: np.ndarray, sums: np.ndarray):
        self.codes, self.sizes, self.w, self.m = codes, sizes, w, sums.shape[1]
        total = [np.bincount(c, w, n) for c, n in zip(codes, sizes, strict=True)]
        self.scale = [np.where(t > 1e-12, 1 / np.where(t > 1e-12, t, 1), 0.0)[:, None] for t in total]
        self.own = [self._by(h, sums) for h in range(len(codes))]

    def _by(self, h: int, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.codes[h], x[:, j], self.sizes[h]) for j in range(self.m)], axis=1)

    def project(self, a: list[np.ndarray], h: int) -> np.ndarray:
        """Coefficients of effect h, given those of the others."""
        rest = None
        for g, c in enumerate(self.codes):
            if g != h:
                rest = a[g][c] if rest is None else rest + a[g][c]
        return (self.own[h] - self._by(h, rest * self.w[:, None])) * self.scale[h] if rest is not None else self.own[h] * self.scale[h]

    def fit(self, a: list[np.ndarray]) -> np.ndarray:
        return sum(x[c] for x, c in zip(a, self.codes, strict=True))

    def solve(self, control: FitControl, start=None, values=None) -> tuple[list[np.ndarray], int, bool]:
        """(coefficients of each effect, sweeps, whether they settled to center_tol).

        berge: sweeps run from the last effect to the first, and the vector that is extrapolated holds all effects but the last, which
        follows from them. stammann: sweeps run forwards and the vector holds all effects. Both extrapolate from every third sweep,
        and each grand_acc_period rounds once more over the results of rounds.
        """
        k = len(self.codes)
        if k == 1:
            return [self.own[0] * self.scale[0]], 1, True
        berge = control.centering == "berge"
        held = range(k - 1) if berge else range(k)
        cut = np.cumsum([0, *[self.sizes[h] for h in held]])
        split = lambda flat: [flat[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]
        a = [x.copy() for x in start] if start is not None else [np.zeros((n, self.m)) for n in self.sizes]

        def step(flat):
            a[: len(held)] = split(flat)
            for h in range(k - 1, -1, -1) if berge else range(k):
                a[h] = self.project(a, h)
            return np.concatenate([a[h] for h in held])

        x, used, rounds, grand, ssr, settled = np.concatenate([a[h] for h in held]), 0, 0, [], None, False
        while used < control.iter_center_max and not settled:
            seq = [x]
            while len(seq) < 4 and used < control.iter_center_max:
                seq.append(step(seq[-1]))
                used += 1
                if close(seq[-2], seq[-1], control.center_tol):
                    settled = True
                    break
            x = seq[-1]
            if settled or len(seq) < 4:
                break
            x = reduced_rank(*seq)
            rounds += 1
            if rounds % control.grand_acc_period == 0:
                grand.append(x)
                if len(grand) == 3:
                    x, grand = irons_tuck(*grand), []
            if values is not None and rounds % SSR_ROUNDS == 0:
                left = values - self.fit(a)
                now = (self.w[:, None] * left * left).sum(axis=0)
                if ssr is not None and (np.abs(now - ssr) <= 1e-3 * control.center_tol * (0.1 + now)).all():
                    x, settled = seq[-1], True
                ssr = now
        a[: len(held)] = split(x)
        if berge:
            a[k - 1] = self.project(a, k - 1)
        return list(a), used, settled


def center_arrays(v: np.ndarray, w: np.ndarray, codes: list[np.ndarray], keys: list[pa.Array], control: FitControl, start=None) -> tuple[Centered, np.ndarray]:
    """Take the effects out of the columns of v (rows x columns) under weights w; also returns what is left of v."""
    if not codes:
        return Centered((v * w[:, None]).T @ v, []), v
    own = Sweeps(codes, [len(k) for k in keys], w, v * w[:, None])
    a, used, settled = own.solve(control, [x.values for x in start] if start else None, v)
    left = v - own.fit(a)
    return Centered((left * w[:, None]).T @ left, [ArrayLevels(k, x) for k, x in zip(keys, a, strict=True)], used, settled), left


def coded(column) -> tuple[np.ndarray, pa.Array]:
    """(level number of every row, levels in ascending order) of an Arrow column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    d = column.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    order = pc.array_sort_indices(d.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[d.indices.to_numpy(zero_copy_only=False)], d.dictionary.take(order)


# -- tables
def center(df: DataFrame, f: list[str], v: list[Column], w: Column, control: FitControl, cells: int, start=None) -> Centered:
    """Take the effects f (columns of df) out of the columns v under weights w. cells: distinct cells of f, or nearly."""
    m = len(v)
    if not f:
        r = df.agg(*products(v, w)).first()
        return Centered(square(r, m), [])
    sums = [F.sum(w).alias("w"), *[F.sum(w * x).alias(f"s{j}") for j, x in enumerate(v)]]
    if len(f) == 1:
        t = checkpointed(df.groupBy(F.col(f[0]).alias("k")).agg(*sums, *products(v, w)))
        full = F.col("w") > 1e-12
        between = [F.sum(F.when(full, F.col(f"s{i}") * F.col(f"s{j}") / F.col("w"))) for i in range(m) for j in range(i + 1)]
        r = t.agg(F.count("*"), *[F.sum(f"g{i}_{j}") for i in range(m) for j in range(i + 1)], *between).first()
        half = m * (m + 1) // 2
        levels = TableLevels(t.select("k", *[F.when(full, F.col(f"s{j}") / F.col("w")).otherwise(0.0).alias(f"v{j}") for j in range(m)]), r[0])
        raw = square(r[1 : 1 + half], m)
        return Centered(raw - square(r[1 + half :], m), [levels], 1, True, np.diag(raw))
    if cells <= control.max_cells:
        return _center_cells(df.groupBy(*f).agg(*sums, *products(v, w)), f, m, control, start)
    return _center_tables(df.select(*f, w.alias("w"), *[x.alias(f"v{j}") for j, x in enumerate(v)]), f, m, control, start)


def _center_cells(cells: DataFrame, f: list[str], m: int, control: FitControl, start) -> Centered:
    """Cells (at most max_cells) on the driver: within cells the spread stays as it is; between them it is that of the residual means."""
    t = cells.toArrow()
    codes, keys = zip(*(coded(t.column(k)) for k in f), strict=True)
    weight, sums = t.column("w").to_numpy(), np.stack([t.column(f"s{j}").to_numpy() for j in range(m)], axis=1)
    raw = square([t.column(f"g{i}_{j}").to_numpy().sum() for i in range(m) for j in range(i + 1)], m)
    own = Sweeps(list(codes), [len(k) for k in keys], weight, sums)
    mean = np.where(weight[:, None] > 0, sums / np.where(weight > 0, weight, 1)[:, None], 0.0)
    begin = [x.values for x in start] if start and isinstance(start[0], ArrayLevels) else None
    a, used, settled = own.solve(control, begin, mean)
    left = mean - own.fit(a)
    gram = raw - (mean * weight[:, None]).T @ mean + (left * weight[:, None]).T @ left
    return Centered(gram, [ArrayLevels(k, x) for k, x in zip(keys, a, strict=True)], used, settled, np.diag(raw))


def _center_tables(rows: DataFrame, f: list[str], m: int, control: FitControl, start) -> Centered:
    """Sweeps over level tables, extrapolated from every other sweep; only sums over all levels reach the driver."""
    rows = rows.persist()
    most, names = control.broadcast_levels, [f"v{j}" for j in range(m)]
    own = [checkpointed(rows.groupBy(F.col(k).alias("k")).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(n)).alias(f"s{j}") for j, n in enumerate(names)])) for k in f]
    count = [t.count() for t in own]
    # warm starts keep the levels of this table, whatever the old one had
    x = [TableLevels(t.select("k", *[F.lit(0.0).alias(n) for n in names]), c) for t, c in zip(own, count, strict=True)]
    if start and isinstance(start[0], TableLevels) and start[0].width == m:
        x = [TableLevels(t.select("k").join(s.df, "k", "left").select("k", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]), c) for t, s, c in zip(own, start, count, strict=True)]
    order = range(len(f) - 1, -1, -1) if control.centering == "berge" else range(len(f))
    full = F.col("w") > 1e-12

    def sweep(a):
        a = list(a)
        for h in order:
            others = [g for g in range(len(f)) if g != h]
            rest = with_effects(rows.select(*f, "w"), [f[g] for g in others], [a[g] for g in others], "_e", m, most)
            rest = rest.groupBy(F.col(f[h]).alias("k")).agg(*[F.sum(F.col("w") * F.col(f"_e{j}")).alias(f"r{j}") for j in range(m)])
            t = own[h].join(rest, "k").select("k", *[F.when(full, (F.col(f"s{j}") - F.col(f"r{j}")) / F.col("w")).otherwise(0.0).alias(n) for j, n in enumerate(names)])
            a[h] = TableLevels(checkpointed(t), count[h])
        return a

    def far(a, b) -> bool:
        gap = lambda n: F.abs(F.col(f"b.{n}") - F.col(f"a.{n}"))
        bad = lambda n: (gap(n) > control.center_tol) & (gap(n) > control.center_tol * (0.1 + F.abs(F.col(f"b.{n}"))))
        one = [p.df.alias("a").join(q.df.alias("b"), "k").agg(F.max(F.greatest(*[bad(n) for n in names], F.lit(False))).alias("far")) for p, q in zip(a, b, strict=True)]
        every = one[0]
        for t in one[1:]:
            every = every.union(t)
        return bool(every.agg(F.max("far")).first()[0])

    def extrapolated(a, b, c):
        three = [p.df.alias("a").join(q.df.alias("b"), "k").join(r.df.alias("c"), "k") for p, q, r in zip(a, b, c, strict=True)]
        d1 = lambda n: F.col(f"c.{n}") - F.col(f"b.{n}")
        d2 = lambda n: F.col(f"c.{n}") - 2 * F.col(f"b.{n}") + F.col(f"a.{n}")
        sums = [t.agg(*[s for j, n in enumerate(names) for s in (F.sum(d1(n) * d2(n)).alias(f"p{j}"), F.sum(d2(n) * d2(n)).alias(f"q{j}"))]) for t in three]
        every = sums[0]
        for t in sums[1:]:
            every = every.union(t)
        r = every.agg(*[F.sum(c) for c in every.columns]).first()
        by = [(r[2 * j] or 0.0) / r[2 * j + 1] if r[2 * j + 1] else 0.0 for j in range(m)]
        return [TableLevels(checkpointed(t.select("k", *[(F.col(f"c.{n}") - F.lit(by[j]) * d1(n)).alias(n) for j, n in enumerate(names)])), p.n) for t, p in zip(three, a, strict=True)]

    used, settled = 0, False
    while used < control.iter_center_max:
        gx = sweep(x)
        used += 1
        if not far(x, gx):
            x, settled = gx, True
            break
        ggx = sweep(gx)
        used += 1
        if not far(gx, ggx):
            x, settled = ggx, True
            break
        x = extrapolated(x, gx, ggx)
    left = with_effects(rows, f, x, "_e", m, most)
    r = left.agg(*products([F.col(n) - F.col(f"_e{j}") for j, n in enumerate(names)], F.col("w"))).first()
    rows.unpersist()
    return Centered(square(r, m), x, used, settled)


def count_cells(df: DataFrame, f: list[str]) -> int:
    """Distinct cells of the effects (an estimate: it only chooses the plan)."""
    return int(df.agg(F.approx_count_distinct(F.struct(*f), 0.02)).first()[0]) if f else 1


def warn_unsettled(found: Centered) -> None:
    if not found.settled:
        warnings.warn("the fixed effects were not centred to center_tol within iter_center_max sweeps.", stacklevel=4)


def demean(df: DataFrame, columns: list[str], fe: list[str], weights: str | None = None, control: FitControl | None = None) -> DataFrame:
    """df with <column>_demeaned: each column less its (weighted) fixed effects. One effect: means are aggregated and joined back,
    so a hot level is pre-aggregated; more: see center(). Rows with a null effect get null."""
    control = control or FitControl(center_tol=1e-12)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    f = [f"_f{i}" for i in range(len(fe))]
    rows = df.withColumns({k: F.col(c) for k, c in zip(f, fe, strict=True)})
    v = [F.col(c).cast("double") for c in columns]
    if len(fe) == 1:
        means = rows.where(F.col(f[0]).isNotNull()).groupBy(f[0]).agg(*[(F.sum(w * x) / F.sum(w)).alias(f"_e{j}") for j, x in enumerate(v)])
        out = rows.join(means, f[0], "left")
    else:
        from .engine import pulled

        need = rows.select(*f, w.alias("_w"), *[x.alias(f"_v{j}") for j, x in enumerate(v)]).dropna()
        t = pulled(need, control)
        if t is not None:
            codes, keys = zip(*(coded(t.column(k)) for k in f), strict=True)
            found, _ = center_arrays(np.stack([t.column(f"_v{j}").to_numpy() for j in range(len(v))], axis=1), t.column("_w").to_numpy(), list(codes), list(keys), control)
        else:
            found = center(need, f, [F.col(f"_v{j}") for j in range(len(v))], F.col("_w"), control, count_cells(need, f))
        warn_unsettled(found)
        out = with_effects(rows, f, found.levels, "_e", len(v), control.broadcast_levels, "left")
        inside = F.lit(True)
        for k in f:
            inside = inside & F.col(k).isNotNull()
        out = out.withColumns({f"_e{j}": F.when(inside, F.col(f"_e{j}")) for j in range(len(v))})
    return out.withColumns({f"{c}_demeaned": F.col(c) - F.col(f"_e{j}") for j, c in enumerate(columns)}).drop(*f, *[f"_e{j}" for j in range(len(columns))])


def tightened(control: FitControl, tol: float) -> FitControl:
    return replace(control, center_tol=tol)
