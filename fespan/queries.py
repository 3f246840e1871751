"""Queries over the driver's tables, one or more for each operator, and SQL with the same result where there is a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import normal_sql as steps
from .functions.families import norm_quantile
from .operators import models, prepare
from .operators.centering import demean
from .operators.levels import checkpointed
from .plans.formula import parse
from .sources.tables import read_table, summary_table
from .streaming.incremental import IncrementalOls

TIGHT = {"dev_tol": 1e-12, "center_tol": 1e-12}
#: lineitem with a regressor that is missing in one line of seven
HOLES = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount + 0.0 END"
Z = norm_quantile(0.975)
QUERIES, SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def items(spark, d) -> DataFrame:
    return read_table(spark, d, "lineitem")


def orders(spark, d) -> DataFrame:
    return read_table(spark, d, "orders")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def terms(fit, digits: int = 4) -> DataFrame:
    t = fit.tidy().toDF("term", "estimate", "std_error", "statistic", "p_value")
    return rounded(t.select("term", "estimate", "std_error"), "estimate", "std_error", digits=digits)


# -- rows and designs
@query(f"SELECT l_returnflag, count(*) AS n, round(sum(x), 4) + 0.0 AS total FROM (SELECT *, {HOLES} AS x FROM lineitem) WHERE x IS NOT NULL GROUP BY 1")
def complete_cases(spark, d):
    df = prepare.complete_cases(items(spark, d).withColumn("x", F.expr(HOLES)), ["x", "l_quantity"])
    return rounded(df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total")


@query("SELECT 'l_returnflag' AS \"column\", count(DISTINCT l_returnflag) AS n_levels FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem")
def factor_levels(spark, d):
    return prepare.level_counts(items(spark, d), ["l_returnflag", "l_linestatus"])


@query("SELECT l_partkey AS level, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def fe_codes(spark, d):
    return prepare.fe_codes(items(spark, d), "l_partkey")


@query("SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS l_returnflagN, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS l_returnflagR FROM lineitem GROUP BY 1")
def dummies(spark, d):
    df = items(spark, d)
    cols = prepare.dummies("l_returnflag", prepare.factor_levels(df, "l_returnflag"))
    return df.groupBy("l_linestatus").agg(*[F.sum(c).alias(n) for n, c in cols])


@query("SELECT round(sum(l_quantity * l_discount), 4) AS q_x_d, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 4) AS n_x_q, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS r_x_q, sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS a_f, sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE AS r_o FROM lineitem")
def interactions(spark, d):
    df = items(spark, d)
    spec = parse("l_tax ~ 0 + l_quantity:l_discount + l_returnflag:l_quantity + l_returnflag:l_linestatus")
    cols = dict(prepare.design(df, spec, {c: prepare.factor_levels(df, c) for c in ("l_returnflag", "l_linestatus")}))
    names = {"q_x_d": "l_quantity:l_discount", "n_x_q": "l_returnflagN:l_quantity", "r_x_q": "l_returnflagR:l_quantity", "a_f": "l_returnflagA:l_linestatusF", "r_o": "l_returnflagR:l_linestatusO"}
    return rounded(df.agg(*[F.sum(cols[v]).alias(k) for k, v in names.items()]), "q_x_d", "n_x_q", "r_x_q")


@query("SELECT a, b, round(v, 4) AS value FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, sum(l_quantity * l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_discount', 'l_quantity', sum(l_discount * l_quantity) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', sum(l_discount * l_discount) FROM lineitem)")
def crossprod(spark, d):
    from .operators.centering import products

    names = ["l_quantity", "l_discount"]
    one = items(spark, d).agg(*products([F.col(c) for c in names], F.lit(1.0)))
    cells = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.round(f"g{i}_{j}", 4).alias("value")) for i in range(2) for j in range(i + 1)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


# -- linear models
@query("SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def ols_simple(spark, d):
    return terms(models.felm("l_extendedprice ~ l_quantity", items(spark, d))).drop("std_error")


@query("WITH m AS (SELECT covar_samp(y, a) ya, covar_samp(y, b) yb, covar_samp(a, b) ab, var_samp(a) aa, var_samp(b) bb FROM (SELECT l_extendedprice y, l_quantity a, l_discount b FROM lineitem)) SELECT 'l_quantity' AS term, round((ya * bb - yb * ab) / (aa * bb - ab * ab), 2) AS estimate FROM m UNION ALL SELECT 'l_discount', round((yb * aa - ya * ab) / (aa * bb - ab * ab), 2) FROM m")
def ols_multi2(spark, d):
    return rounded(terms(models.felm("l_extendedprice ~ l_quantity + l_discount", items(spark, d))).drop("std_error").where("term <> '(Intercept)'"), "estimate", digits=2)


WITHIN = """WITH m AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS h, count(*) AS n, sum(y * y) AS yy FROM m), e AS (SELECT m.*, y - b * x AS e, x * (y - b * x) AS s, b, h, n FROM m, b) """
PRICE = "l_extendedprice ~ l_quantity | l_suppkey"


@query(WITHIN + "SELECT 'l_quantity' AS term, round(max(b), 4) AS estimate, round(sqrt(sum(e * e) / max(n - 1) / max(h)), 4) AS std_error FROM e")
def felm_oneway(spark, d):
    return terms(models.felm(PRICE, items(spark, d)))


@query(WITHIN + "SELECT round(1 - sum(e * e) / (SELECT var_pop(l_extendedprice) * count(*) FROM lineitem), 6) AS r_squared, max(n) AS nobs FROM e")
def felm_oneway_r2(spark, d):
    g = models.felm(PRICE, items(spark, d)).glance()
    return rounded(g.select("r_squared", "nobs"), "r_squared", digits=6)


@query(WITHIN + "SELECT 'l_suppkey' AS fe, l_suppkey::VARCHAR AS level, round(avg(l_extendedprice) - max(b) * avg(l_quantity), 3) AS value FROM e GROUP BY l_suppkey")
def felm_oneway_fe(spark, d):
    return rounded(models.felm(PRICE, items(spark, d)).fixed_effects(), "value", digits=3)


@query("WITH m AS (SELECT *, l_linenumber::DOUBLE AS w, l_extendedprice - sum(l_linenumber * l_extendedprice) OVER p / sum(l_linenumber) OVER p AS y, l_quantity - sum(l_linenumber * l_quantity) OVER p / sum(l_linenumber) OVER p AS x FROM lineitem WINDOW p AS (PARTITION BY l_suppkey)) SELECT 'l_quantity' AS term, round(sum(w * x * y) / sum(w * x * x), 4) AS estimate FROM m")
def felm_weighted(spark, d):
    return terms(models.felm(PRICE, items(spark, d), weights="l_linenumber")).drop("std_error")


def _se(meat: str, extra: str = "") -> str:
    return WITHIN + f"{extra} SELECT 'l_quantity' AS term, round((SELECT max(b) FROM e), 4) AS estimate, round(sqrt(({meat}) / (SELECT max(h) * max(h) FROM e)), 4) AS std_error"


@query(_se("SELECT sum(s * s) FROM e"))
def vcov_hc0(spark, d):
    return terms(models.felm(PRICE, items(spark, d), vcov="hetero"))


CLUSTER = _se("SELECT count(*) * 1.0 / (count(*) - 1) * sum(t * t) FROM (SELECT sum(s) AS t FROM e GROUP BY l_orderkey)")


@query(CLUSTER)
def vcov_cluster(spark, d):
    return terms(models.felm(PRICE + " | l_orderkey", items(spark, d)))


@query(CLUSTER)
def vcov_mestimator(spark, d):
    return terms(models.felm(PRICE + " | l_orderkey", items(spark, d), vcov="m-estimator"))


#: two clusterings over one entity domain: supplier of the line, and a second supplier derived from the part
PAIR = ", p AS (SELECT *, l_suppkey AS g, (l_partkey % 90) + 200 AS h2 FROM e), q AS (SELECT count(*) * 1.0 / (count(*) - 1) AS f FROM (SELECT g FROM p UNION SELECT h2 FROM p))"


def pairs(spark, d):
    return items(spark, d).withColumn("g", F.col("l_suppkey").cast("string")).withColumn("h2", (F.col("l_partkey") % 90 + 200).cast("string"))


@query(_se("SELECT f * (SELECT sum(t * t) FROM (SELECT sum(s) t FROM p GROUP BY g)) + f * (SELECT sum(t * t) FROM (SELECT sum(s) t FROM p GROUP BY h2)) - (SELECT count(*) * 1.0 / (count(*) - 1) * sum(t * t) FROM (SELECT sum(s) t FROM p GROUP BY g, h2)) FROM q", PAIR))
def vcov_twoway(spark, d):
    return terms(models.felm(PRICE + " | g + h2", pairs(spark, d), vcov="two-way"))


@query(_se("SELECT f * ((SELECT sum(t * t) FROM a) + (SELECT sum(t * t) FROM b2) + 2 * coalesce((SELECT sum(a.t * b2.t) FROM a JOIN b2 ON a.g = b2.h2), 0) - (SELECT sum(t * t) FROM c2) - coalesce((SELECT sum(x.t * y.t) FROM c2 x JOIN c2 y ON x.g = y.h2 AND x.h2 = y.g), 0)) FROM q", PAIR.replace("(l_partkey % 90) + 200", "100 - l_suppkey + (l_partkey % 7) * 3 + 1") + ", a AS (SELECT g, sum(s) t FROM p GROUP BY g), b2 AS (SELECT h2, sum(s) t FROM p GROUP BY h2), c2 AS (SELECT g, h2, sum(s) t FROM p GROUP BY g, h2)"))
def vcov_dyadic(spark, d):
    df = items(spark, d).withColumn("g", F.col("l_suppkey").cast("string")).withColumn("h2", (100 - F.col("l_suppkey") + (F.col("l_partkey") % 7) * 3 + 1).cast("string"))
    return terms(models.felm(PRICE + " | g + h2", df, vcov="dyadic"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 9) + 0.0 AS l_quantity_demeaned FROM lineitem")
def demean_oneway(spark, d):
    return rounded(demean(items(spark, d), ["l_quantity"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity_demeaned"), "l_quantity_demeaned", digits=9)


GRID = "(SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"


def grid(spark, d) -> DataFrame:
    return orders(spark, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"), F.count("*").cast("double").alias("n"))


@query(f"SELECT o_orderstatus, o_orderpriority, round(n - avg(n) OVER (PARTITION BY o_orderstatus) - avg(n) OVER (PARTITION BY o_orderpriority) + avg(n) OVER (), 5) + 0.0 AS n_demeaned FROM {GRID}")
def demean_twoway_balanced(spark, d):
    return rounded(demean(grid(spark, d), ["n"], ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "n_demeaned"), "n_demeaned", digits=5)


TWO = ["l_quantity", "l_discount"]
TWOWAY = steps.fitted("lineitem", "l_extendedprice", TWO, ["l_suppkey", "l_partkey"], sweeps=14) + steps.coefficients(TWO, steps.iid_lm(2), 4)
SUPP_PART = "l_extendedprice ~ l_quantity + l_discount | l_suppkey + l_partkey"


@query(TWOWAY)
def felm_twoway(spark, d):
    return terms(models.felm(SUPP_PART, items(spark, d), control={"center_tol": 1e-9}))


@query(TWOWAY)
def felm_twoway_stammann(spark, d):
    return terms(models.felm(SUPP_PART, items(spark, d), control={"center_tol": 1e-9, "centering": "stammann"}))


@query(TWOWAY)
def felm_twoway_spark(spark, d):
    """In Spark whatever the size: cells of the effects are aggregated, their sums centred on the driver."""
    return terms(models.felm(SUPP_PART, items(spark, d), control={"center_tol": 1e-9, "local_bytes": 0}))


@query(TWOWAY)
def felm_twoway_tables(spark, d):
    """In Spark with level tables that are joined and aggregated in turn, as where neither rows nor cells fit the driver."""
    return terms(models.felm(SUPP_PART, items(spark, d), control={"center_tol": 1e-7, "local_bytes": 0, "max_cells": 0}))


@query(steps.fitted("lineitem", "l_extendedprice", TWO, ["l_suppkey", "l_partkey", "l_linenumber"], keys="l_orderkey", sweeps=14) + steps.coefficients(TWO, steps.sandwich(2, "l_orderkey"), 4))
def felm_threeway(spark, d):
    return terms(models.felm(SUPP_PART + " + l_linenumber | l_orderkey", items(spark, d), control={"center_tol": 1e-9}))


# -- generalized linear models
def fe_only(name: str, response: str, frame: str, sql_frame: str, key: str, fam: str):
    sql = f"SELECT {key}, round(ln(avg({response})), 5) + 0.0 AS log_fitted FROM {sql_frame} GROUP BY 1"

    @query(sql, name)
    def run(spark, d):
        df = read_table(spark, d, frame)
        if response == "is_r":
            df = df.withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
        # the SQL averages rows whose response is 0 too, which larger tables hold
        fit = models.feglm(f"{response} ~ 0 | {key}", df, family=fam, control=TIGHT | {"zero_response": True})
        return rounded(fit.fitted().groupBy(key).agg(F.log(F.avg("fitted_values")).alias("log_fitted")), "log_fitted", digits=5)


BINARY = "(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS is_r FROM lineitem)"
fe_only("poisson_fe_only", "l_quantity", "lineitem", "lineitem", "l_suppkey", "poisson")
fe_only("gaussian_fe_only", "l_quantity", "lineitem", "lineitem", "l_suppkey", "gaussian")
fe_only("logit_fe_only", "is_r", "lineitem", BINARY, "l_suppkey", "binomial")
fe_only("probit_fe_only", "is_r", "lineitem", BINARY, "l_suppkey", "probit")
fe_only("gamma_fe_only", "value", "events", "events", "event_type", "gamma")
fe_only("invgauss_fe_only", "value", "events", "events", "event_type", "inverse.gaussian")


@query("SELECT round(2 * sum(l_quantity * ln(l_quantity / m)), 3) AS deviance, round(2 * sum(l_quantity * ln(l_quantity / a)), 3) AS null_deviance FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m, avg(l_quantity) OVER () AS a FROM lineitem)")
def poisson_deviance(spark, d):
    g = models.fepoisson("l_quantity ~ 0 | l_suppkey", items(spark, d), control=TIGHT).glance()
    return rounded(g.select("deviance", "null_deviance"), "deviance", "null_deviance", digits=3)


@query(f"SELECT o_orderstatus, o_orderpriority, round(sum(n) OVER (PARTITION BY o_orderstatus) * sum(n) OVER (PARTITION BY o_orderpriority) / sum(n) OVER (), 4) AS fitted FROM {GRID}")
def poisson_twoway_margins(spark, d):
    fit = models.fepoisson("n ~ 0 | o_orderstatus + o_orderpriority", grid(spark, d), control=TIGHT)
    return rounded(fit.fitted().select("o_orderstatus", "o_orderpriority", F.col("fitted_values").alias("fitted")), "fitted")


OPEN = "(SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS open FROM lineitem)"


def binary(spark, d) -> DataFrame:
    return items(spark, d).withColumns({"open": (F.col("l_linestatus") == "O").cast("double"), "is_r": (F.col("l_returnflag") == "R").cast("double")})


@query(f"SELECT '(Intercept)' AS term, round(ln(avg(CASE WHEN open = 0 THEN l_quantity END)), 4) AS estimate FROM {OPEN} UNION ALL SELECT 'open', round(ln(avg(CASE WHEN open = 1 THEN l_quantity END) / avg(CASE WHEN open = 0 THEN l_quantity END)), 4) + 0.0 FROM {OPEN}")
def poisson_binary_reg(spark, d):
    return terms(models.fepoisson("l_quantity ~ open", binary(spark, d), control=TIGHT)).drop("std_error")


LOGIT = f"WITH m AS (SELECT avg(CASE WHEN open = 1 THEN r END) AS a, avg(CASE WHEN open = 0 THEN r END) AS b FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS r FROM {OPEN})) "


@query(LOGIT + "SELECT '(Intercept)' AS term, round(ln(b / (1 - b)), 4) AS estimate FROM m UNION ALL SELECT 'open', round(ln(a / (1 - a)) - ln(b / (1 - b)), 4) + 0.0 FROM m")
def logit_binary_reg(spark, d):
    return terms(models.feglm("is_r ~ open", binary(spark, d), family="binomial", control=TIGHT)).drop("std_error")


@query(LOGIT + "SELECT 'open' AS term, round(a - b, 6) + 0.0 AS ape FROM m")
def ape_binary_reg(spark, d):
    fit = models.feglm("is_r ~ open", binary(spark, d), family="binomial", control=TIGHT | {"compute_apes": True})
    return rounded(spark.createDataFrame([("open", fit.stats["ape"]["open"])], "term string, ape double"), "ape", digits=6)


@query("SELECT round(CASE WHEN v - m <= 0.01 * m THEN 1e6 ELSE least(greatest(m * m / (v - m), 0.1), 1e6) END, 4) AS theta FROM (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem)")
def negbin_theta(spark, d):
    return rounded(spark.createDataFrame([(models.estimate_theta(items(spark, d), "l_quantity"),)], "theta double"), "theta")


THETA = "(SELECT CASE WHEN v - m <= 0.01 * m THEN 1e6 ELSE least(greatest(m * m / (v - m), 0.1), 1e6) END FROM (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem))"


@query(steps.fitted("lineitem", "l_quantity", ["l_discount"], ["l_suppkey"], "negbin", steps=7, theta=THETA) + steps.coefficients(["l_discount"], steps.IID_GLM))
def negbin_reg(spark, d):
    return terms(models.fenegbin("l_quantity ~ l_discount | l_suppkey", items(spark, d), control=TIGHT), 6)


DT = ["l_discount", "l_tax"]
COUNTS = "l_quantity ~ l_discount + l_tax | l_suppkey"
POISSON_TWO = steps.fitted("lineitem", "l_quantity", DT, ["l_suppkey", "l_partkey"], "poisson", keys="l_orderkey", steps=6, sweeps=9) + steps.coefficients(DT, steps.sandwich(2, "l_orderkey"))


@query(POISSON_TWO)
def poisson_twoway_reg(spark, d):
    return terms(models.fepoisson(COUNTS + " + l_partkey | l_orderkey", items(spark, d), control=TIGHT), 6)


@query(POISSON_TWO)
def poisson_twoway_spark(spark, d):
    """In Spark whatever the size."""
    return terms(models.fepoisson(COUNTS + " + l_partkey | l_orderkey", items(spark, d), control={"dev_tol": 1e-10, "center_tol": 1e-10, "local_bytes": 0}), 6)


@query(steps.fitted("lineitem", "l_quantity", DT, ["l_suppkey", "l_partkey", "l_linenumber"], "poisson", steps=6, sweeps=9) + steps.coefficients(DT, steps.IID_GLM))
def poisson_threeway_reg(spark, d):
    return terms(models.fepoisson(COUNTS + " + l_partkey + l_linenumber", items(spark, d), control=TIGHT), 6)


ENTRIES = "SELECT 'l_discount' AS a, 'l_discount' AS b, round(c00, 8) AS value FROM c UNION ALL SELECT 'l_discount', 'l_tax', round(c01, 8) + 0.0 FROM c UNION ALL SELECT 'l_tax', 'l_tax', round(c11, 8) FROM c"


def entries(spark, fit) -> DataFrame:
    names, v = fit.vcov()
    return rounded(spark.createDataFrame([(names[i], names[j], float(v[i, j])) for i in range(len(names)) for j in range(i, len(names))], "a string, b string, value double"), "value", digits=8)


ONEWAY = steps.fitted("lineitem", "l_quantity", DT, ["l_suppkey"], "poisson", keys="l_orderkey, l_linenumber", steps=6)


@query(ONEWAY + f", {steps.INVERSE}, {steps.sandwich(2)} {ENTRIES}")
def glm_vcov_hetero(spark, d):
    return entries(spark, models.fepoisson(COUNTS, items(spark, d), vcov="hetero", control=TIGHT))


@query(ONEWAY + f", {steps.INVERSE}, {steps.sandwich(2, 'l_orderkey')} {ENTRIES}")
def glm_vcov_cluster(spark, d):
    return entries(spark, models.fepoisson(COUNTS + " | l_orderkey", items(spark, d), control=TIGHT | {"local_bytes": 0}))


def _p(z: str) -> str:
    return f"2 * (1 - {steps.CDF.format(x=f'abs({z})')})"


@query(ONEWAY + f", {steps.INVERSE}, {steps.IID_GLM} " + " UNION ALL ".join(f"SELECT '{n}' AS term, round(z, 5) + 0.0 AS statistic, round({_p('z')}, 6) AS p_value FROM (SELECT b{i} / sqrt(c{i}{i}) AS z FROM b, c)" for i, n in enumerate(DT)))
def glm_tidy(spark, d):
    t = models.fepoisson(COUNTS, items(spark, d), control=TIGHT).tidy().toDF("term", "estimate", "std_error", "statistic", "p_value")
    return rounded(rounded(t.select("term", "statistic", "p_value"), "statistic", digits=5), "p_value", digits=6)


@query("SELECT round(corr(l_quantity, m) * corr(l_quantity, m), 6) AS pseudo_r_squared FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)")
def poisson_pseudo_r2(spark, d):
    fit = models.fepoisson("l_quantity ~ 0 | l_suppkey", items(spark, d), control=TIGHT)
    return rounded(spark.createDataFrame([(float(fit.stats["pseudo_r_squared"]),)], "pseudo_r_squared double"), "pseudo_r_squared", digits=6)


@query("SELECT l_suppkey::VARCHAR AS level, round(ln(sum(l_quantity) / sum(l_linenumber)), 6) + 0.0 AS value FROM lineitem GROUP BY 1")
def offset_refit(spark, d):
    """The effects of a fitted model again, given an offset."""
    fit = models.fepoisson("l_quantity ~ l_discount | l_suppkey", items(spark, d), control=TIGHT | {"return_fe": True, "keep_data": True})
    return rounded(models.fit_offset(fit, "ln(l_linenumber)").fixed_effects().select("level", "value"), "value", digits=6)


@query(steps.fitted(BINARY, "is_r", DT, ["l_linestatus"], "probit", steps=7) + steps.coefficients(DT, steps.IID_GLM, 5))
def probit_reg(spark, d):
    return terms(models.feprobit("is_r ~ l_discount + l_tax | l_linestatus", binary(spark, d), control=TIGHT), 5)


LOGIT_REG = steps.fitted(BINARY, "is_r", DT, ["l_suppkey"], "binomial", steps=7)


@query(LOGIT_REG + steps.coefficients(DT, steps.IID_GLM, 5))
def logit_reg(spark, d):
    return terms(models.fit_matrix(binary(spark, d), "is_r", DT, ["l_suppkey"], family="binomial", control=TIGHT), 5)


@query(LOGIT_REG + "SELECT term, round(b * slope, 6) + 0.0 AS estimate FROM (SELECT 'l_discount' AS term, b0 AS b FROM b UNION ALL SELECT 'l_tax', b1 FROM b), (SELECT avg(mu * (1 - mu)) AS slope FROM r)")
def ape_slopes(spark, d):
    fit = models.feglm("is_r ~ l_discount + l_tax | l_suppkey", binary(spark, d), family="binomial", control=TIGHT | {"compute_apes": True})
    return rounded(fit.ape_table().select("term", "estimate"), "estimate", digits=6)


@query(steps.tobit("(SELECT *, least(greatest(l_quantity, 5.0), 45.0) AS q FROM lineitem)", "q", "l_discount", "l_suppkey", "5.0", "45.0", 8) + "SELECT 'l_discount' AS term, round(beta, 4) + 0.0 AS estimate, round(1 / sqrt(h), 4) AS std_error FROM b")
def tobit_reg(spark, d):
    df = items(spark, d).withColumn("q", F.least(F.greatest(F.col("l_quantity"), F.lit(5.0)), F.lit(45.0)))
    return terms(models.fetobit("q ~ l_discount | l_suppkey", df, tobit_lb=5.0, tobit_ub=45.0))


@query(steps.fitted(BINARY, "is_r", ["l_discount"], ["l_suppkey"], "binomial", steps=7) + ", g AS (SELECT sum(t0 * ww * (1 - 2 * mu)) / sum(ww) AS s FROM r GROUP BY f0) SELECT 'l_discount' AS term, round(b0, 5) + 0.0 AS estimate, round(b0 + t, 5) + 0.0 AS corrected, round(-t, 6) + 0.0 AS bias FROM (SELECT b0, (SELECT sum(s) FROM g) / 2 / h00 AS t FROM b)")
def bias_corr(spark, d):
    fit = models.feglm("is_r ~ l_discount | l_suppkey", binary(spark, d), family="binomial", control=TIGHT | {"compute_bias_corr": True})
    out = spark.createDataFrame([("l_discount", float(fit.beta[0]), float(fit.stats["beta_corrected"][0]), float(fit.stats["bias_term"][0]))], "term string, estimate double, corrected double, bias double")
    return rounded(rounded(out, "estimate", "corrected", digits=5), "bias", digits=6)


#: Suppliers without any sale, and a mark that stands only on rows of zero: both leave no finite estimate.
ZEROS = "CASE WHEN l_suppkey % 7 = 0 OR (l_linenumber = 2 AND l_quantity < 20) THEN 0.0 ELSE l_quantity END"
MARK = "CASE WHEN l_linenumber = 2 AND l_quantity < 20 THEN 1.0 ELSE 0.0 END"


def with_zeros(spark, d) -> DataFrame:
    return items(spark, d).withColumns({"sold": F.expr(ZEROS), "mark": F.expr(MARK)})


def quietly(f, *a, **k):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return f(*a, **k)


@query(f"SELECT l_suppkey, count(*) AS n FROM (SELECT *, {MARK} AS mark FROM lineitem) WHERE l_suppkey % 7 = 0 OR mark = 1 GROUP BY 1")
def separated_rows(spark, d):
    fit = quietly(models.fepoisson, "sold ~ mark + l_discount | l_suppkey", with_zeros(spark, d))
    return fit.separated_rows().groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(steps.fitted(f"(SELECT * FROM lineitem WHERE l_suppkey % 7 <> 0 AND {MARK} = 0)", "l_quantity", ["l_discount"], ["l_suppkey"], "poisson", steps=7) + steps.coefficients(["l_discount"], steps.IID_GLM) + " UNION ALL SELECT 'mark', NULL, NULL")
def separated_fit(spark, d):
    return terms(quietly(models.fepoisson, "sold ~ l_discount + mark | l_suppkey", with_zeros(spark, d), control=TIGHT), 6)


@query("SELECT DISTINCT l_suppkey::VARCHAR AS level FROM lineitem WHERE l_suppkey % 7 = 0")
def separation_groups(spark, d):
    """Levels that only have zeros, found in Spark."""
    fit = quietly(models.feglm, "yes ~ 0 | l_suppkey", items(spark, d).withColumn("yes", F.expr("CASE WHEN l_suppkey % 7 <> 0 AND l_returnflag = 'R' THEN 1 ELSE 0 END")), family="binomial", control={"local_bytes": 0})
    return fit.separated_rows().select(F.col("l_suppkey").cast("string").alias("level")).distinct()


# -- after the fit
@query(WITHIN + "SELECT 'l_quantity' AS term, round(max(b), 4) AS estimate, round(sqrt(sum(e * e) / max(n - 1) / max(h)), 4) AS std_error, round(max(b) / sqrt(sum(e * e) / max(n - 1) / max(h)), 3) AS statistic FROM e")
def tidy(spark, d):
    t = models.felm(PRICE, items(spark, d)).tidy().toDF("term", "estimate", "std_error", "statistic", "p_value").drop("p_value")
    return rounded(rounded(t, "estimate", "std_error"), "statistic", digits=3)


@query(WITHIN + f"SELECT 'l_quantity' AS term, round(max(b) - {Z!r} * sqrt(sum(e * e) / max(n - 1) / max(h)), 4) AS conf_low, round(max(b) + {Z!r} * sqrt(sum(e * e) / max(n - 1) / max(h)), 4) AS conf_high FROM e")
def confint(spark, d):
    return rounded(models.felm(PRICE, items(spark, d)).autoplot().drop("estimate"), "conf_low", "conf_high")


@query("SELECT round(1 - yy * 1.0 / tt, 6) AS r_squared, round(1 - yy / tt * (n - 1) / (n - 2 - (g - 1) + 1), 6) AS adj_r_squared, n AS nobs_full, 0::BIGINT AS nobs_na FROM (SELECT (SELECT sum(e * e) FROM e) AS yy, (SELECT var_pop(l_extendedprice) * count(*) FROM lineitem) AS tt, (SELECT count(*) FROM lineitem) AS n, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS g)".join([WITHIN, ""]))
def glance(spark, d):
    g = models.felm(PRICE, items(spark, d)).glance().select("r_squared", "adj_r_squared", "nobs_full", "nobs_na")
    return rounded(g, "r_squared", "adj_r_squared", digits=6)


AUG = WITHIN + "SELECT l_orderkey, l_linenumber, round(l_extendedprice - e, 2) AS fitted, round(e, 2) + 0.0 AS residual FROM e"


@query(AUG)
def augment(spark, d):
    a = models.felm(PRICE, items(spark, d), control={"keep_data": True}).augment()
    return rounded(a.select("l_orderkey", "l_linenumber", F.col("`.fitted`").alias("fitted"), F.col("`.residuals`").alias("residual")), "fitted", "residual", digits=2)


@query("WITH t AS (SELECT * FROM lineitem WHERE l_suppkey > 10), m AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM t), b AS (SELECT sum(x * y) / sum(x * x) AS b FROM m), f AS (SELECT l_suppkey, avg(l_extendedprice) - max(b) * avg(l_quantity) AS v FROM t, b GROUP BY 1) SELECT s_suppkey, round(b * 10 + coalesce(v, 0), 3) AS prediction FROM supplier CROSS JOIN b LEFT JOIN f ON s_suppkey = l_suppkey")
def predict_left_join(spark, d):
    fit = models.felm(PRICE, items(spark, d).where("l_suppkey > 10"))
    new = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("l_suppkey"), F.lit(10.0).alias("l_quantity"))
    return rounded(fit.predict(new).select("s_suppkey", "prediction"), "prediction", digits=3)


@query("SELECT s_suppkey, round(coalesce(m, 1), 4) AS prediction FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem WHERE l_suppkey > 10 GROUP BY 1) ON s_suppkey = l_suppkey")
def predict_glm(spark, d):
    fit = models.fepoisson("l_quantity ~ 0 | l_suppkey", items(spark, d).where("l_suppkey > 10"), control=TIGHT)
    new = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("l_suppkey"))
    return rounded(fit.predict(new).select("s_suppkey", "prediction"), "prediction")


@query(WITHIN + "SELECT s_suppkey, round(v, 3) AS effect FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_extendedprice) - max(b) * avg(l_quantity) AS v FROM e GROUP BY 1) ON s_suppkey = l_suppkey")
def attach_effects(spark, d):
    """The fitted effects joined to a table of their levels."""
    t = models.felm(PRICE, items(spark, d)).attach_effects(read_table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("l_suppkey")))
    return rounded(t.select("s_suppkey", F.col("l_suppkey_effect").alias("effect")), "effect", digits=3)


@query(steps.fitted("lineitem", "l_extendedprice", TWO, ["l_suppkey"], keys="l_orderkey") + steps.coefficients(TWO, steps.sandwich(2, "l_orderkey"), 4))
def updated_formula(spark, d):
    fit = models.felm(PRICE, items(spark, d), control={"keep_data": True})
    return terms(fit.update(". ~ . + l_discount | . | l_orderkey"))


def _stars(sql: str) -> str:
    """star(z) written out."""
    import re

    out, at = "", 0
    for m in re.finditer(r"star\(", sql):
        end, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        z = f"abs({sql[m.end() : end - 1]})"
        out += sql[at : m.start()] + f"(CASE WHEN {z} >= 2.575829 THEN '**' WHEN {z} >= 1.959964 THEN '*' WHEN {z} >= 1.644854 THEN '+' ELSE '' END)"
        at = end
    return out + sql[at:]


SIDE = """, u AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, sum(l_quantity * l_quantity) AS xx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem),
s AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS e FROM u), f AS (SELECT max(b) AS b, sqrt(sum(e * e) / max(n - 1) / max(h)) AS se, 1 - sum(e * e) / (SELECT syy FROM u) AS r2 FROM e)
SELECT 0 AS line, 'Variable' AS variable, '(1)' AS first, '(2)' AS second UNION ALL SELECT 2, '(Intercept)', printf('%.3f', a) || star(a / (e * sqrt(xx / n / sxx))), '' FROM s UNION ALL SELECT 3, '', printf('(%.3f)', e * sqrt(xx / n / sxx)), '' FROM s
UNION ALL SELECT 4, 'l_quantity', printf('%.3f', s.b) || star(s.b / (e / sqrt(sxx))), printf('%.3f', f.b) || star(f.b / se) FROM s, f UNION ALL SELECT 5, '', printf('(%.3f)', e / sqrt(sxx)), printf('(%.3f)', se) FROM s, f UNION ALL SELECT 6, 'Fixed effects', '', '' UNION ALL SELECT 7, 'l_suppkey', 'No', 'Yes'
UNION ALL SELECT 8, 'N', format('{:,}', n), format('{:,}', n) FROM u UNION ALL SELECT 9, 'R-squared', printf('%.3f', s.r2), printf('%.3f', f.r2) FROM s, f UNION ALL SELECT 10, 'SE type', 'iid', 'iid'"""


@query(WITHIN.rstrip() + _stars(SIDE.replace("SELECT 0 AS line", "SELECT 0::BIGINT AS line")))
def side_by_side(spark, d):
    """The printed table of two models, a row for each of its lines, cells trimmed."""
    df = items(spark, d)
    text = summary_table(models.felm("l_extendedprice ~ l_quantity", df), models.felm(PRICE, df))
    lines = [(i, *[c.strip() for c in t.strip("|").split("|")]) for i, t in enumerate(text.splitlines()) if t.startswith("| ")]
    return spark.createDataFrame(lines, "line long, variable string, first string, second string")


INCREMENTAL = "WITH m AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem) SELECT 'l_quantity' AS term, round(sum(x * y) / sum(x * x), 4) AS estimate FROM m"


def _state(spark) -> str:
    """A new folder for the state of a stream: in the checkpoint folder, which driver and executors share."""
    import uuid

    checkpointed(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query(INCREMENTAL)
def incremental_ols(spark, d):
    fit, df = IncrementalOls(spark, _state(spark), "l_extendedprice", ["l_quantity"], "l_suppkey"), items(spark, d)
    for i, part in enumerate(("l_linenumber <= 2", "l_linenumber > 2", "l_linenumber > 2")):
        fit.add(df.where(part), min(i, 1))
    return rounded(spark.createDataFrame(list(fit.coef().items()), "term string, estimate double"), "estimate")


@query(INCREMENTAL)
def streaming_ols(spark, d):
    """The same model over a stream of the table's files."""
    path = _state(spark)
    fit = IncrementalOls(spark, f"{path}/state", "l_extendedprice", ["l_quantity"], "l_suppkey")
    stream = spark.readStream.schema(items(spark, d).schema).parquet(f"{d}/lineitem.parque[t]")
    fit.attach(stream, f"{path}/check").awaitTermination()
    return rounded(spark.createDataFrame(list(fit.coef().items()), "term string, estimate double"), "estimate")
