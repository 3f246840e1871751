"""Small tables for examples and tests: one well-known table of cars, and stand-ins with the shape of published panels, built by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Miles per gallon, cylinders, horsepower, weight and manual gear of 32 cars of 1974.
CARS = """
21.0 6 110 2.620 1, 21.0 6 110 2.875 1, 22.8 4 93 2.320 1, 21.4 6 110 3.215 0, 18.7 8 175 3.440 0, 18.1 6 105 3.460 0, 14.3 8 245 3.570 0, 24.4 4 62 3.190 0,
22.8 4 95 3.150 0, 19.2 6 123 3.440 0, 17.8 6 123 3.440 0, 16.4 8 180 4.070 0, 17.3 8 180 3.730 0, 15.2 8 180 3.780 0, 10.4 8 205 5.250 0, 10.4 8 215 5.424 0,
14.7 8 230 5.345 0, 32.4 4 66 2.200 1, 30.4 4 52 1.615 1, 33.9 4 65 1.835 1, 21.5 4 97 2.465 0, 15.5 8 150 3.520 0, 15.2 8 150 3.435 0, 13.3 8 245 3.840 0,
19.2 8 175 3.845 0, 27.3 4 66 1.935 1, 26.0 4 91 2.140 1, 30.4 4 113 1.513 1, 15.8 8 264 3.170 1, 19.7 6 175 2.770 1, 15.0 8 335 3.570 1, 21.4 4 109 2.780 1
"""


def cars(spark: SparkSession) -> DataFrame:
    """(row, mpg, cyl, hp, wt, am): 32 rows."""
    rows = [(i, *map(float, line.split())) for i, line in enumerate(CARS.replace("\n", " ").split(","))]
    return spark.createDataFrame(rows, "row int, mpg double, cyl double, hp double, wt double, am double")


def _uniform(seed: int, *keys: str) -> F.Column:
    """A number in [0, 1) that the keys fix."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def _pairs(spark: SparkSession, countries: int, years: int, first: int) -> DataFrame:
    df = spark.range(countries * countries * years).select((F.col("id") % countries).alias("e"), (F.floor(F.col("id") / countries) % countries).alias("i"), (F.floor(F.col("id") / (countries * countries)) + first).cast("int").alias("year"))
    return df.where("e <> i")


def gravity(spark: SparkSession, countries: int = 69, years: int = 6) -> DataFrame:
    """A trade panel: (trade, log_dist, cntg, lang, clny, rta, exp_year, imp_year, pair, year), a tenth of the flows zero; the default
    has about 28,000 rows. The slopes behind it are -0.8, 0.4, 0.25, -0.2 and 0.2."""
    df = _pairs(spark, countries, years, 1986).withColumns({"lo": F.least("e", "i"), "hi": F.greatest("e", "i")})
    mark = lambda seed, share: (_uniform(seed, "lo", "hi") < share).cast("int")
    df = df.withColumns({"log_dist": 6 + 3.5 * _uniform(1, "lo", "hi"), "cntg": mark(2, 0.05), "lang": mark(3, 0.15), "clny": mark(4, 0.08), "rta": (_uniform(5, "lo", "hi", "year") < 0.2).cast("int")})
    eta = -0.8 * F.col("log_dist") + 0.4 * F.col("cntg") + 0.25 * F.col("lang") - 0.2 * F.col("clny") + 0.2 * F.col("rta") + 2 * _uniform(6, "e", "year") + 2 * _uniform(7, "i", "year")
    flow = F.when(_uniform(8, "e", "i", "year") < 0.1, 0.0).otherwise(F.exp(eta + 8) * (0.5 + _uniform(9, "e", "i", "year")))
    text = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"))
    return df.select(flow.alias("trade"), "log_dist", "cntg", "lang", "clny", "rta", text("e", "year").alias("exp_year"), text("i", "year").alias("imp_year"), text("e", "i").alias("pair"), "year")


def dyads(spark: SparkSession, countries: int = 40, years: int = 5) -> DataFrame:
    """A dyadic panel over one set of countries: (ltrade, ldist, bothin, onein, regional, ctry1, ctry2, pair, year); pair is undirected."""
    df = _pairs(spark, countries, years, 1990).where("e < i").withColumns({"ctry1": F.concat(F.lit("c"), F.col("e").cast("string")), "ctry2": F.concat(F.lit("c"), F.col("i").cast("string"))})
    inside = lambda k: (_uniform(1, k, "year") < 0.6).cast("int")
    df = df.withColumns({"a": inside("e"), "b": inside("i"), "ldist": 5 + 4 * _uniform(2, "e", "i"), "regional": (_uniform(3, "e", "i") < 0.1).cast("int")})
    df = df.withColumns({"bothin": F.col("a") * F.col("b"), "onein": (F.col("a") + F.col("b") == 1).cast("int")})
    y = 10 - 1.1 * F.col("ldist") + 0.1 * F.col("bothin") + 0.9 * F.col("regional") + 2 * _uniform(4, "e") + 2 * _uniform(5, "i") + 2 * _uniform(6, "e", "i", "year")
    return df.select(y.alias("ltrade"), "ldist", "bothin", "onein", "regional", "ctry1", "ctry2", F.concat_ws("-", "ctry1", "ctry2").alias("pair"), "year")


def separated(spark: SparkSession) -> DataFrame:
    """18 rows (row, y, x1, x2, i, j) with two effects of four levels; x2 is positive only in three of the rows with y = 0."""
    y = [0, 3, 1, 2, 0, 4, 1, 0, 2, 5, 0, 1, 2, 0, 3, 1, 6, 2]
    x2 = {0: 1.0, 4: 2.0, 10: 3.0}
    return spark.createDataFrame([(r, float(v), (7 * r) % 5 / 2, x2.get(r, 0.0), (r * 5) % 4 + 1, (r // 3) % 4 + 1) for r, v in enumerate(y)], "row int, y double, x1 double, x2 double, i int, j int")
