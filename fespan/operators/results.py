"""Fitted models: coefficients, covariances, predictions and tidy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family, norm_quantile
from ..plans.control import FitControl
from ..plans.formula import ModelSpec
from .levels import with_effects
from .linalg import coef_table
from .prepare import Prepared, _name_or_column, column, design

INTERNAL = ("_y", "_w", "_o")


@dataclass
class Result:
    kind: str
    spec: ModelSpec
    control: FitControl
    family: Family
    names: list[str]
    beta: np.ndarray
    vcov_matrix: np.ndarray | None
    vcov_label: str
    prep: Prepared
    effects: list
    nobs: dict[str, int]
    stats: dict = field(default_factory=dict)
    weights: object = None
    offset: object = None
    data: DataFrame | None = None
    #: See engine.separate.
    separators: list = field(default_factory=list)
    #: Kept regressors, the means they were centred by and their level coefficients; the state of the fit.
    at: object = None
    means: object = None
    alpha_x: list = field(default_factory=list)
    state: object = None
    vcov_given: str | None = None

    # -- numbers
    def coef(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))

    def vcov(self) -> tuple[list[str], np.ndarray]:
        if self.vcov_matrix is None:
            raise ValueError("no covariance matrix was computed.")
        return self.names, self.vcov_matrix

    @property
    def coef_table(self) -> np.ndarray:
        return coef_table(self.beta, self.vcov_matrix)

    def confint(self, parm=None, level: float = 0.95) -> dict[str, tuple[float, float]]:
        if not 0 < level < 1:
            raise ValueError("level must be between zero and one.")
        z, t = norm_quantile(1 - (1 - level) / 2), self.coef_table
        wanted = self.names if parm is None else [self.names[p] if isinstance(p, int) else p for p in ([parm] if isinstance(parm, (int, str)) else parm)]
        return {n: (t[self.names.index(n), 0] - z * t[self.names.index(n), 1], t[self.names.index(n), 0] + z * t[self.names.index(n), 1]) for n in wanted}

    # -- small tables
    def _frame(self, rows, schema: str) -> DataFrame:
        return self.prep.df.sparkSession.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in rows], schema)

    def tidy(self, conf_int: bool = False, conf_level: float = 0.95) -> DataFrame:
        rows = [(n, *map(float, r)) for n, r in zip(self.names, self.coef_table, strict=True)]
        schema = "term string, estimate double, `std.error` double, statistic double, `p.value` double"
        if conf_int:
            ci = self.confint(level=conf_level)
            rows = [(*r, *map(float, ci[r[0]])) for r in rows]
            schema += ", `conf.low` double, `conf.high` double"
        return self._frame(rows, schema)

    def glance(self) -> DataFrame:
        first = ("r_squared", "adj_r_squared") if self.kind == "felm" else ("deviance", "null_deviance")
        return self._frame([(*[float(self.stats[k]) for k in first], *self.nobs.values())], ", ".join([f"{k} double" for k in first] + [f"{k} long" for k in self.nobs]))

    def autoplot(self, conf_level: float = 0.95) -> DataFrame:
        """The plot's data; its title is 'Coefficient Estimates with Confidence Intervals at <level>%'."""
        ci = self.confint(level=conf_level)
        return self._frame([(n, float(b), *map(float, ci[n])) for n, b in self.coef().items()], "term string, estimate double, conf_low double, conf_high double")

    def fixed_effects(self) -> DataFrame:
        """(fe, level, value); with two or more effects the first level of the last one is 0. Of a generalized model only with return_fe."""
        if self.kind != "felm" and not self.control.return_fe:
            raise ValueError("fixed_effects of this model needs return_fe.")
        own, spark = list(self.effects), self.prep.df.sparkSession
        if len(own) > 1:
            shift = own[-1].first()
            own[-1], own[0] = own[-1].shifted(-shift), own[0].shifted(shift)
        out = None
        for f, a in zip(self.spec.fe, own, strict=True):
            t = a.table(spark, "level", ["value"], 0).select(F.lit(f).alias("fe"), F.col("level").cast("string").alias("level"), "value")
            out = t if out is None else out.union(t)
        return self._frame([], "fe string, level string, value double") if out is None else out

    def attach_effects(self, df: DataFrame) -> DataFrame:
        """df with <fe>_effect for each fixed effect: its level's value as in fixed_effects, null for a level that was not seen."""
        shift = self.effects[-1].first() if len(self.effects) > 1 else 0.0
        for k, (name, a) in enumerate(zip(self.spec.fe, self.effects, strict=True)):
            a = a.shifted(shift if k == 0 else -shift if k == len(self.effects) - 1 else 0.0) if shift else a
            t = a.table(df.sparkSession, "_level", [f"{name}_effect"], self.control.broadcast_levels)
            df = df.join(t, column(name).try_cast(t.schema["_level"].dataType) == F.col("_level"), "left").drop("_level")
        return df

    def tx(self) -> DataFrame:
        """The rows with <regressor>_centred: regressors less their means and effects (needs keep_tx)."""
        if not self.control.keep_tx:
            raise ValueError("tx needs keep_tx.")
        rows, names = self.rows(), [self.names[j] for j in self.at]
        if self.prep.f:
            rows = with_effects(rows, self.prep.f, self.alpha_x, "_ax", len(names), self.control.broadcast_levels)
        cols = {f"{n}_centred": F.col(self.prep.x[j]) - F.lit(float(self.means[j])) - (F.col(f"_ax{i}") if self.prep.f else F.lit(0.0)) for i, (j, n) in enumerate(zip(self.at, names, strict=True))}
        return self._public(rows.withColumns(cols)).drop(*[f"_ax{i}" for i in range(len(names))])

    # -- partial effects
    def ape_table(self) -> DataFrame:
        """(term, estimate, std_error, statistic, p_value) of the average partial effects (needs compute_apes)."""
        names, v = self.vcov_apes()
        rows = coef_table(np.array([self.stats["ape"][n] for n in names]), v)
        return self._frame([(n, *map(float, r)) for n, r in zip(names, rows, strict=True)], "term string, estimate double, std_error double, statistic double, p_value double")

    def coef_apes(self) -> dict[str, float]:
        if "ape" not in self.stats:
            raise ValueError("average partial effects need compute_apes.")
        return dict(self.stats["ape"])

    def vcov_apes(self) -> tuple[list[str], np.ndarray]:
        return list(self.coef_apes()), self.stats["ape_vcov"]

    def print_apes(self) -> str:
        names, v = self.vcov_apes()
        if not names:
            return "No slope coefficients"
        width = max([4, *map(len, names)])
        out = ["Estimates:", " " * width + "   Estimate Std. Error z value Pr(>|z|)"]
        for n, r in zip(names, coef_table(np.array([self.stats["ape"][n] for n in names]), v), strict=True):
            out.append(f"{n:<{width}} {r[0]:10.6f} {r[1]:10.6f} {r[2]:7.3f} {r[3]:8.4g}")
        return "\n".join(out)

    # -- separation
    def separated_rows(self) -> DataFrame:
        """The observations that were separated, with their own columns; they have no fitted value."""
        return self._public(self.rows().where("_sep"))

    def print_separation(self, id_col: str | None = None) -> str:
        """id_col: a column that names rows; the first 20 separated ones are listed by it."""
        n = self.nobs["nobs_separated"]
        out = ["Separation Check Result", "-----------------------", f"Separated observations: {n}", f"Converged: {self.stats.get('conv', True)}"]
        if id_col and n:
            ids = [str(r[0]) for r in self.separated_rows().select(column(id_col)).orderBy(column(id_col)).limit(20).collect()]
            out.append(("Observation indices: " if n <= 20 else "First 20 observation indices: ") + ", ".join(ids) + (" ..." if n > 20 else ""))
        return "\n".join(out)

    # -- rows
    def _linear(self, df: DataFrame, x: list, join: str) -> DataFrame:
        """df (with _f0..) with _eta; left join: a level that was not seen adds 0."""
        total = F.lit(0.0)
        for b, c in zip(self.beta, x, strict=True):
            if not np.isnan(b):
                total = total + F.lit(float(b)) * c
        if self.spec.fe:
            df = with_effects(df, self.prep.f, self.effects, "_fe", 1, self.control.broadcast_levels, join)
            total = total + F.col("_fe0")
        elif self.state is not None and self.state.const:
            total = total + F.lit(float(self.state.const))
        return df.withColumn("_eta", total)

    def _separated(self, df: DataFrame) -> DataFrame:
        """df with _sep: whether a row was separated."""
        flag = F.lit(False)
        for i, how in enumerate(self.separators):
            if isinstance(how, tuple):
                h, t = how
                df = df.join(t.select(F.col("k").alias(self.prep.f[h]), F.lit(True).alias(f"_sep{i}")), self.prep.f[h], "left")
                flag = flag | F.coalesce(f"_sep{i}", F.lit(False))
                continue
            fit = F.lit(float(how.const))
            if how.effects:
                df = with_effects(df, self.prep.f, how.effects, f"_sep{i}_", 1, self.control.broadcast_levels, "left")
                fit = fit + F.col(f"_sep{i}_0")
            for b, c in zip(how.beta, self.prep.x, strict=True):
                fit = fit + F.lit(float(b)) * F.col(c)
            flag = flag | ((F.col("_y") <= 0) & (fit > max(self.control.sep_tol, 1e-5)))
        return df.withColumn("_sep", flag).drop(*[n for i in range(len(self.separators)) for n in (f"_sep{i}", f"_sep{i}_0")])

    def rows(self) -> DataFrame:
        """The prepared rows with _eta (offset included), _mu and _sep; separated rows have neither _eta nor _mu."""
        df = self._linear(self._separated(self.prep.df), [F.col(c) for c in self.prep.x], "inner")
        df = df.withColumn("_eta", F.when(~F.col("_sep"), F.col("_eta") + F.col("_o")))
        return df.withColumn("_mu", self.family.mu(F.col("_eta")) if not self.separators else F.when(~F.col("_sep"), self.family.mu(F.col("_eta"))))

    def fitted(self) -> DataFrame:
        """The rows used, with their own columns and fitted_values."""
        return self._public(self.rows().withColumn("fitted_values", F.col("_mu")))

    def residuals(self) -> DataFrame:
        return self._public(self.rows().withColumn("residuals", F.col("_y") - F.col("_mu")))

    def _public(self, df: DataFrame) -> DataFrame:
        gone = {*INTERNAL, "_eta", "_mu", "_fe0", "_sep", *self.prep.x, *self.prep.f, *self.prep.c}
        return df.drop(*gone)

    def predict(self, newdata: DataFrame | None = None, type: str = "response") -> DataFrame:
        """newdata with `prediction`: rows with a missing regressor get null, unseen levels add 0, dropped coefficients count as 0."""
        if type not in ("response", "link", "terms"):
            raise ValueError("type must be 'response' or 'link'.")
        if newdata is None:
            return self._public(self.rows().withColumn("prediction", F.col("_eta" if type == "link" else "_mu")))
        spec = self.spec
        x = [c for _, c in design(newdata, spec, self.prep.levels)]
        o = F.coalesce(_name_or_column(self.offset).cast("double"), F.lit(0.0)) if self.offset is not None else F.lit(0.0)
        need = [c for t in spec.terms for c in t] + list(spec.fe)
        kind = self.prep.df.schema
        df = newdata.withColumns({f: column(c).try_cast(kind[f].dataType) for f, c in zip(self.prep.f, spec.fe, strict=True)} | {"_o": o})
        df = self._linear(df, x, "left").withColumn("_eta", F.col("_eta") + F.col("_o"))
        value = F.col("_eta") if type == "link" else self.family.mu(F.col("_eta"))
        if need:
            missing = F.lit(False)
            for c in need:
                missing = missing | column(c).isNull()
            value = F.when(~missing, value)
        return df.withColumn("prediction", value).drop("_o", "_eta", "_fe0", *self.prep.f)

    def augment(self, newdata: DataFrame | None = None) -> DataFrame:
        """Data with .fitted and .residuals (where the response is there)."""
        if newdata is None and self.data is None:
            raise ValueError("augment needs keep_data or newdata.")
        df = self.predict(newdata if newdata is not None else self.data).withColumnRenamed("prediction", ".fitted")
        return df.withColumn(".residuals", column(self.spec.response).cast("double") - F.col("`.fitted`")) if self.spec.response in df.columns else df

    def update(self, formula: str, **more):
        """Refit on the updated formula; a covariance estimator that was asked for is kept."""
        if self.data is None:
            raise ValueError("update needs keep_data.")
        from . import models

        spec = self.spec.update(formula)
        how = {"weights": self.weights, "control": self.control, "vcov": self.vcov_given} | more
        if self.kind == "fenegbin":
            return models.fenegbin(str(spec), self.data, offset=self.offset, **how)
        return models.felm(str(spec), self.data, **how) if self.kind == "felm" else models.feglm(str(spec), self.data, family=self.family, offset=self.offset, **how)

    def summary(self) -> Result:
        return self

    def __str__(self) -> str:
        head = ["Formula: " + str(self.spec), "", f"Family: {self.family.name.capitalize()}" if self.kind != "felm" else "", "", "Estimates:", ""]
        width = max([4, *map(len, self.names)])
        head.append(" " * width + " | Estimate | Std. Error | z value | Pr(>|z|)")
        for n, r in zip(self.names, self.coef_table, strict=True):
            star = "**" if r[3] <= 0.01 else "*" if r[3] <= 0.05 else "+" if r[3] <= 0.1 else ""
            head.append(f"{n:<{width}} | {r[0]:8.4f} | {r[1]:10.4f} | {r[2]:7.3f} | {r[3]:.4g} {star}".rstrip())
        head += ["", "Significance codes: ** p < 0.01; * p < 0.05; + p < 0.10", ""]
        if self.kind == "felm":
            head.append(f"R-squared: {self.stats['r_squared']:.4f}   Adj. R-squared: {self.stats['adj_r_squared']:.4f}")
        elif "pseudo_r_squared" in self.stats:
            head.append(f"Pseudo R-squared: {self.stats['pseudo_r_squared']:.4f}")
        head.append(f"Number of observations: Full {self.nobs['nobs_full']}; Missing {self.nobs['nobs_na']}; Separated {self.nobs['nobs_separated']}")
        if "iter" in self.stats:
            head.append(f"Number of Fisher Scoring iterations: {self.stats['iter']}")
        if "theta" in self.stats:
            head.append(f"theta = {self.stats['theta']:.4f}")
        if "ape" in self.stats:
            head += ["", "Average partial effects", self.print_apes()]
        return "\n".join(head)
