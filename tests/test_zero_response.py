"""Responses of 0, which rounding leaves in larger tables, in families whose likelihood has none."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import fespan
from fespan.queries import QUERIES, SQL

TIGHT = {"dev_tol": 1e-12, "center_tol": 1e-12, "zero_response": True}


def values():
    """Three types of 60 rows each, with 3, 10 and 0 responses of 0."""
    rng = np.random.default_rng(7)
    made = []
    for kind, scale, zeros in (("click", 50, 3), ("view", 20, 10), ("error", 70, 0)):
        v = np.round(rng.gamma(2, scale / 2, 60), 2) + 0.01
        v[:zeros] = 0.0
        made += [(kind, float(x)) for x in v]
    return [(i, kind, x) for i, (kind, x) in enumerate(made)]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(values(), "event_id long, event_type string, value double").repartition(3).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["gamma_fe_only", "invgauss_fe_only"])
def test_query_with_zeros(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, events).collect())) == sorted(con.execute(SQL[name]).fetchall())


@pytest.mark.parametrize("local", [0, 1 << 20])
@pytest.mark.parametrize("family", ["gamma", "inverse.gaussian"])
def test_zeros_in_both_engines(spark, events, family, local):
    df = spark.read.parquet(f"{events}/events.parquet")
    fit = fespan.feglm("value ~ 0 | event_type", df, family=family, control=TIGHT | {"local_bytes": local})
    assert fit.stats["conv"] and np.isfinite([fit.stats["deviance"], fit.stats["null_deviance"]]).all()
    for r in fit.fitted().groupBy("event_type").agg(F.avg("value").alias("m"), F.min("fitted_values").alias("a"), F.max("fitted_values").alias("b")).collect():
        assert r.a == pytest.approx(r.m, rel=1e-7) and r.b == pytest.approx(r.m, rel=1e-7)
    none = df.withColumn("value", F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")))
    with pytest.warns(UserWarning, match="Separation detected: 60 "):
        fit = fespan.feglm("value ~ 0 | event_type", none, family=family, control=TIGHT | {"local_bytes": local})
    assert fit.stats["conv"] and fit.fitted().where("fitted_values is null").groupBy("event_type").count().collect() == [("view", 60)]


@pytest.mark.parametrize("family", ["gamma", "inverse.gaussian"])
def test_zeros_are_asked_for(spark, events, family):
    df = spark.read.parquet(f"{events}/events.parquet")
    with pytest.raises(ValueError, match="strictly positive"):
        fespan.feglm("value ~ 0 | event_type", df, family=family)
    with pytest.raises(ValueError, match="non-negative|strictly positive"):
        fespan.feglm("v ~ 0 | event_type", df.withColumn("v", F.col("value") - 1), family=family, control=TIGHT)


@pytest.mark.parametrize("local", [0, 1 << 20])
@pytest.mark.parametrize("family", ["gamma", "inverse.gaussian"])
def test_means_below_one(spark, events, family, local):
    """The logarithm of the mean is no valid start there."""
    df = spark.read.parquet(f"{events}/events.parquet").withColumn("value", F.col("value") / 1000)
    fit = fespan.feglm("value ~ 0 | event_type", df, family=family, control=TIGHT | {"local_bytes": local})
    for r in fit.fitted().groupBy("event_type").agg(F.avg("value").alias("m"), F.min("fitted_values").alias("a"), F.max("fitted_values").alias("b")).collect():
        assert r.a == pytest.approx(r.m, rel=1e-7) and r.b == pytest.approx(r.m, rel=1e-7)
    with pytest.raises(ValueError, match="separated"):
        fespan.feglm("value ~ 1", df.withColumn("value", F.lit(0.0)), family=family, control=TIGHT | {"local_bytes": local})
