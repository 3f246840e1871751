"""From a table and a formula to rows ready for estimation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.formula import ModelSpec


def column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Prepared:
    """df: the table's complete cases with _y, _w, _o, _x0.., _f0.. (fixed-effect keys) and _c0.. (cluster keys), not evaluated: passes
    of a fit read the columns they need, row outputs read the others too. distinct: estimates of the different rows of the model's columns."""

    df: DataFrame
    spec: ModelSpec
    names: list[str]
    nobs_full: int
    nobs: int
    levels: dict[str, list[str]] = field(default_factory=dict)
    weighted: bool = False
    has_offset: bool = False
    distinct: int = 0
    distinct_with_clusters: int = 0
    y_range: tuple[float, float] = (0.0, 0.0)

    @property
    def x(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.names))]

    @property
    def varying(self) -> list[str]:
        return [f"_x{i}" for i, n in enumerate(self.names) if n != "(Intercept)"]

    @property
    def f(self) -> list[str]:
        return [f"_f{i}" for i in range(len(self.spec.fe))]

    @property
    def c(self) -> list[str]:
        return [f"_c{i}" for i in range(len(self.spec.clusters))]


def is_factor(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def check_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("undefined columns: " + ", ".join(missing))
    for n in names:
        if isinstance(df.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column '{n}' has an unsupported type.")


def complete(df: DataFrame, names: list[str]) -> Column:
    """Whether a row has no null, NaN or infinite value in the named columns."""
    ok = F.lit(True)
    for n in names:
        ok = ok & column(n).isNotNull()
        if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(column(n)) & (F.abs(column(n)) != float("inf"))
    return ok


def complete_cases(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(complete(df, names))


def factor_levels(df: DataFrame, name: str) -> list[str]:
    return sorted(r[0] for r in df.select(column(name)).distinct().collect())


def level_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_levels)."""
    one = df.agg(*[F.countDistinct(column(n)).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), column(n).alias("n_levels")) for n in names])).alias("r")).select("r.*")


def fe_codes(df: DataFrame, name: str) -> DataFrame:
    """(level, code): codes from 0 in ascending order of the level.

    Levels are ranked in range partitions (an offset a partition), so no task holds them all.
    """
    levels = df.select(column(name).alias("level")).where("level is not null").distinct().repartitionByRange("level").sortWithinPartitions("level").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = levels.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    from pyspark.sql import Window

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return levels.join(parts, "_p").select("level", (F.col("_i") - F.col("_least") + F.col("_before")).cast("long").alias("code"))


def dummies(name: str, levels: list[str], drop_first: bool = True) -> list[tuple[str, Column]]:
    return [(f"{name}{v}", F.when(column(name) == v, 1.0).otherwise(0.0)) for v in levels[1 if drop_first else 0 :]]


def design(df: DataFrame, spec: ModelSpec, levels: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """Named regressors: numbers as doubles, strings as dummies without their least level (an interaction of two strings keeps
    all cells, the first running fastest); of interactions of three and more only numbers are allowed."""
    out: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))] if spec.intercept else []
    for term in spec.terms:
        text = [c for c in term if is_factor(df, c)]
        if len(term) > 2 and text:
            raise ValueError("interactions of three or more columns must be numeric.")
        if len(term) == 2 and len(text) == 2:
            a, b = (dummies(c, levels[c], False) for c in term)
            out += [(f"{n}:{m}", x * z) for m, z in b for n, x in a]
            continue
        parts = [dummies(c, levels[c]) if c in text else [(c, column(c).cast("double"))] for c in term]
        cells = parts[0]
        for p in parts[1:]:
            cells = [(f"{n}:{m}", x * z) for n, x in cells for m, z in p]
        out += cells
    return out


def _name_or_column(x) -> Column:
    return x if isinstance(x, Column) else F.expr(x.strip().removeprefix("~").strip())


def prepare(df: DataFrame, spec: ModelSpec, weights=None, offset=None) -> Prepared:
    """Check, drop incomplete rows and build the design; one pass over the columns of the model. weights: column name, ~name or
    Column; offset: expression (null and non-finite values count as 0)."""
    names = spec.columns
    check_columns(df, names)
    weight = _name_or_column(weights).cast("double") if weights is not None else F.lit(1.0)
    df = df.withColumn("_w", weight)
    o = _name_or_column(offset).cast("double") if offset is not None else F.lit(0.0)
    df = df.withColumn("_o", F.when(o.isNull() | F.isnan(o) | (F.abs(o) == float("inf")), 0.0).otherwise(o))
    whole = complete(df, [*names, "_w"])
    kept = df.where(whole)
    y = column(spec.response)
    if is_factor(df, spec.response):
        both = factor_levels(kept, spec.response)
        if both and len(both) != 2:
            raise ValueError("Model response has to be binary.")
        y = F.when(y == (both[1] if both else ""), 1.0).otherwise(0.0)
    y = y.cast("double")
    inner = [F.col("_w"), F.col("_o"), *[column(c) for c in names if c not in spec.clusters or c in [spec.response, *spec.fe, *(c for t in spec.terms for c in t)]]]
    every = [F.col("_w"), F.col("_o"), *[column(c) for c in names]]
    seen = lambda cols: F.approx_count_distinct(F.when(whole, F.xxhash64(*cols)))
    r = df.agg(F.count("*"), F.count_if(whole), F.count_if(F.col("_w").isNull()), F.min("_w"), F.min(F.when(whole, y)), F.max(F.when(whole, y)), seen(inner), *([seen(every)] if spec.clusters else [])).first()
    nobs_full, n = r[0], r[1]
    if nobs_full == 0:
        raise ValueError("'data' has zero observations.")
    if r[2] == nobs_full or n == 0:
        raise ValueError("No complete cases.")
    if r[3] is not None and r[3] < 0:
        raise ValueError("negative weights are not allowed.")
    levels = {c: factor_levels(kept, c) for t in spec.terms for c in t if is_factor(df, c)}
    cols = design(df, spec, levels)
    kept = kept.withColumns({"_y": y, **{f"_x{i}": x for i, (_, x) in enumerate(cols)}, **{f"_f{i}": column(c) for i, c in enumerate(spec.fe)}, **{f"_c{i}": column(c) for i, c in enumerate(spec.clusters)}})
    return Prepared(kept, spec, [c for c, _ in cols], nobs_full, n, levels, weights is not None, offset is not None, r[6], r[7] if spec.clusters else r[6], (r[4], r[5]))
