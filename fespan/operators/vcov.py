"""Covariance estimators from scores: sums by cluster, and a small product on the driver. Scores are a table's columns or arrays."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centering import products, square


class TableScores:
    """df: score columns s of rows that stand for _n equal ones, and cluster keys c."""

    def __init__(self, df: DataFrame, c: list[str], s: list[str]):
        self.df, self.c, self.s, self.m = df, c, s, len(s)

    @property
    def count(self) -> int:
        return len(self.c)

    def each(self) -> np.ndarray:
        """Sum of the rows' s s'."""
        return square(self.df.agg(*products([F.col(x) for x in self.s], F.col("_n"))).first(), self.m)

    def _sums(self, by: list[int]) -> DataFrame:
        return self.df.groupBy(*[self.c[i] for i in by]).agg(*[F.sum(F.col("_n") * F.col(x)).alias(x) for x in self.s])

    def within(self, by: list[int]) -> tuple[np.ndarray, int]:
        """(sum over clusters of S S', number of clusters), S being a cluster's score sum."""
        r = self._sums(by).agg(F.count("*"), *products([F.col(x) for x in self.s], F.lit(1.0))).first()
        return square(r[1:], self.m), r[0]

    def entities(self) -> int:
        return self.df.select(F.col(self.c[0]).cast("string").alias("e")).union(self.df.select(F.col(self.c[1]).cast("string").alias("e"))).distinct().count()

    def _cross(self, a: DataFrame, b: DataFrame, on) -> np.ndarray:
        r = a.join(b, on).agg(*[F.sum(F.col(f"a.{x}") * F.col(f"b.{y}")) for x in self.s for y in self.s]).first()
        return np.array([x or 0.0 for x in r]).reshape(self.m, self.m)

    def _same(self, a: str, b: str):
        return F.col(a).cast("string") == F.col(b).cast("string")

    def across(self) -> np.ndarray:
        """Sum over entities of S1 S2', the score sums on either side."""
        c = self.c
        return self._cross(self._sums([0]).alias("a"), self._sums([1]).alias("b"), self._same(f"a.{c[0]}", f"b.{c[1]}"))

    def reversed(self) -> np.ndarray:
        """Sum over pairs (g, h) of T_gh T_hg'."""
        c, both = self.c, self._sums([0, 1])
        return self._cross(both.alias("a"), both.alias("b"), self._same(f"a.{c[0]}", f"b.{c[1]}") & self._same(f"a.{c[1]}", f"b.{c[0]}"))

    def selves(self) -> bool:
        return not self.df.where(self._same(self.c[0], self.c[1])).isEmpty()


class ArrayScores:
    """s: scores of rows that stand for n equal ones; c: (level numbers, levels) of each cluster variable."""

    def __init__(self, s: np.ndarray, n: np.ndarray, c: list[tuple[np.ndarray, pa.Array]]):
        self.s, self.n, self.c, self.m = s, n, c, s.shape[1]

    @property
    def count(self) -> int:
        return len(self.c)

    def each(self) -> np.ndarray:
        return (self.s * self.n[:, None]).T @ self.s

    def _sums(self, code: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(code, self.s[:, j] * self.n, size) for j in range(self.m)], axis=1)

    def _joint(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.stack(codes), axis=1, return_inverse=True)

    def within(self, by: list[int]) -> tuple[np.ndarray, int]:
        levels, code = self._joint([self.c[i][0] for i in by]) if len(by) > 1 else np.unique(self.c[by[0]][0], return_inverse=True)
        size = levels.shape[-1]
        t = self._sums(code.ravel(), size)
        return t.T @ t, size

    def _entity_codes(self) -> tuple[list[np.ndarray], int]:
        names = [pc.cast(k, pa.string()) for _, k in self.c[:2]]
        used = [n.take(pa.array(np.unique(c))) for n, (c, _) in zip(names, self.c, strict=False)]
        every = pc.unique(pa.concat_arrays(used))
        return [pc.index_in(n, every).fill_null(0).to_numpy(zero_copy_only=False)[c] for n, (c, _) in zip(names, self.c, strict=False)], len(every)

    def entities(self) -> int:
        return self._entity_codes()[1]

    def across(self) -> np.ndarray:
        (a, b), size = self._entity_codes()
        return self._sums(a, size).T @ self._sums(b, size)

    def reversed(self) -> np.ndarray:
        (a, b), size = self._entity_codes()
        key, code = np.unique(a.astype(np.int64) * size + b, return_inverse=True)
        t = self._sums(code, len(key))
        back = (key % size) * size + key // size
        at = np.minimum(np.searchsorted(key, back), max(0, len(key) - 1))
        found = key[at] == back
        return t[found].T @ t[at[found]]

    def selves(self) -> bool:
        (a, b), _ = self._entity_codes()
        return bool((a == b).any())


def meat_dyadic(x) -> tuple[np.ndarray, int]:
    """Pairs of rows that share an entity on either side, by the six-term formula (exact without self-pairs), and entities."""
    if x.selves():
        warnings.warn("rows pair an entity with itself; the six-term formula miscounts them.", stacklevel=2)
    one, two, same, across = x.within([0])[0], x.within([1])[0], x.within([0, 1])[0], x.across()
    return one + two + across + across.T - same - x.reversed(), x.entities()


def sandwich(kind: str, h_inv: np.ndarray, x) -> np.ndarray:
    """Covariance of the estimator named kind: hetero, cluster, m-estimator, two-way or dyadic."""
    factor = lambda g: g / (g - 1) if g > 1 else 1.0
    if kind == "hetero":
        return h_inv @ x.each() @ h_inv
    if kind in ("cluster", "m-estimator"):
        if not x.count:
            raise ValueError("clustered covariances need cluster variables in the formula.")
        b, g = x.within([0])
        return factor(g) * h_inv @ b @ h_inv
    if x.count < 2:
        raise ValueError(f"'{kind}' covariances need two cluster variables in the formula.")
    if kind == "dyadic":
        b, g = meat_dyadic(x)
        return factor(g) * h_inv @ b @ h_inv
    g = x.entities()
    (b1, _), (b2, _), (b12, g12) = x.within([0]), x.within([1]), x.within([0, 1])
    return h_inv @ (factor(g) * b1 + factor(g) * b2 - factor(g12) * b12) @ h_inv
