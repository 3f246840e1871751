"""Coefficients of a fixed effect's levels: arrays on the driver where the levels are few, tables where they are many."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels up to which a table of them is broadcast.
BROADCAST_LEVELS = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, so that its lineage ends. Without a folder one is made in local mode only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share.")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fespan-"))
    return df.checkpoint(eager=True)


class ArrayLevels:
    """keys: the levels, ascending; values: one row of coefficients for each."""

    def __init__(self, keys: pa.Array, values: np.ndarray):
        self.keys, self.values = keys, values

    def combined(self, c) -> ArrayLevels:
        """One column: the coefficients' combination with weights c."""
        return ArrayLevels(self.keys, self.values @ np.asarray(c, float)[:, None])

    def picked(self, columns: list[int]) -> ArrayLevels:
        return ArrayLevels(self.keys, self.values[:, columns])

    def shifted(self, by: float) -> ArrayLevels:
        return ArrayLevels(self.keys, self.values + by)

    def mixed(self, other: ArrayLevels, rho: float) -> ArrayLevels:
        return ArrayLevels(self.keys, (1 - rho) * self.values + rho * other.values)

    def constant(self, value: float) -> ArrayLevels:
        return ArrayLevels(self.keys, np.full((len(self.values), 1), value))

    def count(self) -> int:
        return len(self.values)

    def first(self) -> float:
        return float(self.values[0, 0]) if len(self.values) else 0.0

    def table(self, spark: SparkSession, key: str, names: list[str], most: int = BROADCAST_LEVELS) -> DataFrame:
        """(key, *names), broadcast if the levels are at most `most`."""
        t = spark.createDataFrame(pa.table([self.keys, *[pa.array(self.values[:, j], pa.float64()) for j in range(len(names))]], names=[key, *names]))
        return F.broadcast(t) if len(self.keys) <= most else t


class TableLevels:
    """df: (k, v0, v1, ...), a row for each level."""

    def __init__(self, df: DataFrame, n: int):
        self.df, self.n = df, n

    @property
    def width(self) -> int:
        return len(self.df.columns) - 1

    def combined(self, c) -> TableLevels:
        total = sum((F.lit(float(x)) * F.col(f"v{j}") for j, x in enumerate(c)), F.lit(0.0))
        return TableLevels(self.df.select("k", total.alias("v0")), self.n)

    def picked(self, columns: list[int]) -> TableLevels:
        return TableLevels(self.df.select("k", *[F.col(f"v{c}").alias(f"v{j}") for j, c in enumerate(columns)]), self.n)

    def shifted(self, by: float) -> TableLevels:
        return TableLevels(self.df.select("k", *[(F.col(f"v{j}") + F.lit(float(by))).alias(f"v{j}") for j in range(self.width)]), self.n)

    def mixed(self, other: TableLevels, rho: float) -> TableLevels:
        both = self.df.alias("a").join(other.df.alias("b"), "k")
        return TableLevels(checkpointed(both.select("k", *[((1 - rho) * F.col(f"a.v{j}") + rho * F.col(f"b.v{j}")).alias(f"v{j}") for j in range(self.width)])), self.n)

    def constant(self, value: float) -> TableLevels:
        return TableLevels(self.df.select("k", F.lit(float(value)).alias("v0")), self.n)

    def count(self) -> int:
        return self.n

    def first(self) -> float:
        got = self.df.agg(F.min_by("v0", "k")).first()[0]
        return got or 0.0

    def table(self, spark: SparkSession, key: str, names: list[str], most: int = BROADCAST_LEVELS) -> DataFrame:
        t = self.df.select(F.col("k").alias(key), *[F.col(f"v{j}").alias(n) for j, n in enumerate(names)])
        return F.broadcast(t) if self.n <= most else t


def with_effects(df: DataFrame, f: list[str], levels: list, prefix: str, width: int, most: int = BROADCAST_LEVELS, how: str = "inner") -> DataFrame:
    """df with prefix0, prefix1, ...: for each of `width` columns the sum of its level coefficients; a left join adds 0 for a level
    that is not there."""
    for k, key in enumerate(f):
        df = df.join(levels[k].table(df.sparkSession, key, [f"_{prefix}{k}_{j}" for j in range(width)], most), key, how)
    part = (lambda c: F.col(c)) if how == "inner" else (lambda c: F.coalesce(c, F.lit(0.0)))
    total = {f"{prefix}{j}": sum((part(f"_{prefix}{k}_{j}") for k in range(len(f))), F.lit(0.0)) for j in range(width)}
    return df.withColumns(total).drop(*[f"_{prefix}{k}_{j}" for k in range(len(f)) for j in range(width)])
