"""Linear models over a stream: sufficient statistics are additive, so each micro-batch adds its own and a fit needs no old rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import linalg
from ..operators.centering import products, square


class IncrementalOls:
    """y on x, with an intercept or one fixed effect, from statistics in a folder that driver and executors share.

    add() writes the statistics of a batch, one row a level, as the batch's own part of the folder; a batch that comes again (a replay
    after a failure, or a restart with the same checkpoint) overwrites its part and counts once. coef() sums the parts in Spark: levels
    never reach the driver. Rows with a null in a used column do not count.
    """

    def __init__(self, spark: SparkSession, path: str, y: str, x: list[str], fe: str | None = None, weight: str | None = None):
        self.spark, self.path, self.y, self.x, self.fe, self.weight = spark, path.rstrip("/"), y, x, fe, weight
        self.m = len(x) + 1

    def add(self, batch: DataFrame, batch_id) -> None:
        v = [F.col(c).cast("double") for c in [self.y, *self.x]]
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = batch.dropna(subset=[self.y, *self.x, *([self.fe] if self.fe else []), *([self.weight] if self.weight else [])])
        key = F.col(self.fe).cast("string") if self.fe else F.lit("all")
        t = rows.groupBy(key.alias("k")).agg(F.sum(w).alias("w"), *[F.sum(w * c).alias(f"s{j}") for j, c in enumerate(v)], *products(v, w))
        t.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def attach(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start a streaming query that adds every micro-batch of a stream."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def coef(self, tol: float = 1e-8) -> dict[str, float]:
        g = [f"g{i}_{j}" for i in range(self.m) for j in range(i + 1)]
        sums = [F.sum(c).alias(c) for c in ["w", *[f"s{j}" for j in range(self.m)], *g]]
        t = self.spark.read.parquet(self.path).groupBy("k").agg(*sums)
        full = F.col("w") > 0
        between = [F.sum(F.when(full, F.col(f"s{i}") * F.col(f"s{j}") / F.col("w"))) for i in range(self.m) for j in range(i + 1)]
        r = t.agg(*[F.sum(c) for c in g], *between).first()
        gram = square(r[: len(g)], self.m) - square(r[len(g) :], self.m)
        beta, _ = linalg.solve(gram[1:, 1:], gram[1:, 0], tol)
        return dict(zip(self.x, np.asarray(beta).tolist(), strict=True))
