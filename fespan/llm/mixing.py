"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, without

#: Rows that meet in one step of the reduction tree, on average.
FAN = 128


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size): sources by code point, null last, weigh `weights`, repeating.

    Targets share the sum of all sizes by weight and stop at `most` times their source's size; what is cut is shared again by
    weight until none is above. In closed form: a level L with sum(min(L * weight, most * size)) = total; sources stop in the
    order of most * size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("stops", F.col("cap") / F.col("weight"))
    by_stop = Window.orderBy("stops", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    # the level of the first source, in this order, that does not stop holds for all after it
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", F.col("source").isNull().alias("last"), "source", "level"))).over(Window.partitionBy())["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).cast("double").alias("target"))


def _pivot(rows: F.Column, doc_type: str) -> F.Column:
    """Pivotal rounding of an ordered array of structs (h, k, p, draw): each pair moves expected words between its two members,
    at random and without bias, until one of them has probability 0 or 1. Returns (done: array of (k, extra), open: who is left, or null)."""
    key = f"struct<row:bigint,size:bigint,base:bigint,doc:{doc_type}>"
    none = F.expr(f"cast(array() as array<struct<k:{key},extra:int>>)")
    start = F.struct(none.alias("done"), F.lit(None).cast(f"struct<k:{key},p:double,draw:double>").alias("open"))

    def step(acc, x):
        a = acc["open"]
        sa, sb, pa, pb = a["k"]["size"].cast("double"), x["k"]["size"].cast("double"), a["p"], x["p"]
        gain_a, gain_b = F.least((1 - pa) * sa, pb * sb), F.least(pa * sa, (1 - pb) * sb)
        to_a = x["draw"] * (gain_a + gain_b) < gain_b
        next_a = F.when(to_a, F.when((1 - pa) * sa <= pb * sb, F.lit(1.0)).otherwise(pa + gain_a / sa)).otherwise(F.when(pa * sa <= (1 - pb) * sb, F.lit(0.0)).otherwise(pa - gain_b / sa))
        next_b = F.when(to_a, F.when(pb * sb <= (1 - pa) * sa, F.lit(0.0)).otherwise(pb - gain_a / sb)).otherwise(F.when((1 - pb) * sb <= pa * sa, F.lit(1.0)).otherwise(pb + gain_b / sb))
        ended_a, ended_b = (next_a <= 0) | (next_a >= 1), (next_b <= 0) | (next_b >= 1)
        ended = lambda k, p: F.array(F.struct(k.alias("k"), p.cast("int").alias("extra")))
        done = F.concat(acc["done"], F.when(ended_a, ended(a["k"], next_a)).otherwise(none), F.when(ended_b, ended(x["k"], next_b)).otherwise(none))
        left = F.when(~ended_a, F.struct(a["k"].alias("k"), next_a.alias("p"), a["draw"].alias("draw"))).when(~ended_b, F.struct(x["k"].alias("k"), next_b.alias("p"), x["draw"].alias("draw")))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), F.struct(x["k"].alias("k"), x["p"].alias("p"), x["draw"].alias("draw")).alias("open"))).otherwise(F.struct(done.alias("done"), left.alias("open")))

    return F.aggregate(rows, start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A document of a source with ratio f = target / size is taken floor(f) times, and once more with probability f - floor(f):
    these probabilities are rounded by pivotal pairs, first in buckets of FAN rows or so, then the one left of each bucket with
    those of other buckets, level by level, until one row of a source is left. Words keep their expectation at each step, so a
    source misses its target by less than one document. All draws are hashes of the row, so reruns agree; a hot source is many
    buckets. Null and empty texts have size 0 and are taken 0 times; null sources are one source, the last; repeated rows count
    each; an empty table gives an empty result. No Python runs on the executors.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(id_col, source_col, text_col).alias("row")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most).withColumnRenamed("source", "_of")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio))
    whole = (F.col("p") <= 0) | (F.col("size") == 0)
    out = ["doc", "source", "size", "source_size", "target", "taken"]
    parts = [rows.where(whole).withColumn("taken", F.col("size") * F.col("base")).select(*out)]
    kind = dict(sized.dtypes)["doc"]
    k = F.struct("row", "size", "base", "doc")
    same = ["source", "source_size", "target"]
    open_rows, buckets, level = rows.where(~whole).select(*same, k.alias("k"), "p"), max(1, -(-sized.count() // FAN)), 0
    while True:
        draw = F.pmod(F.xxhash64("k.row", F.lit(seed + 1), F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        entry = F.struct(F.xxhash64("k.row", F.lit(seed), F.lit(level)).alias("h"), "k", "p", draw.alias("draw"))
        grouped = open_rows.select(*same, F.pmod(F.xxhash64("k.row", F.lit(seed)), F.lit(buckets)).alias("bucket"), entry.alias("x")).groupBy(*same, "bucket").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        done = materialize(grouped.select(*same, "bucket", _pivot(F.col("xs"), kind).alias("r")), "pivot")
        taken = lambda k, extra: F.col(f"{k}.size") * (F.col(f"{k}.base") + extra)
        parts.append(done.select(*same, F.explode("r.done").alias("d")).select(F.col("d.k.doc").alias("doc"), "source", F.col("d.k.size").alias("size"), "source_size", "target", taken("d.k", F.col("d.extra")).alias("taken")))
        left = done.where("r.open is not null").select(*same, F.col("r.open.k").alias("k"), F.col("r.open.p").alias("p"))
        if buckets == 1:
            last = F.pmod(F.xxhash64("k.row", F.lit(seed + 2)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("p")
            parts.append(left.select(F.col("k.doc").alias("doc"), "source", F.col("k.size").alias("size"), "source_size", "target", taken("k", last.cast("int")).alias("taken")))
            break
        open_rows, buckets, level = left, -(-buckets // FAN), level + 1
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.withColumnRenamed("doc", id_col)
