"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token rule shared by several operators: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes in one Arrow batch between the JVM and a Python worker; Spark's own bound (64 MB) is held several times over on both sides.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches by BATCH_BYTES (a smaller bound stays); groups still arrive whole, in more batches."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name).strip())
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode without one (tests) a folder is made."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share.")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fespan-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/fespan-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = own_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df (in any case) has them."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash (in any case) with the result columns."""
    low = {n.lower() for n in names}
    return df.select([df[f"`{c.replace('`', '``')}`"] for c in df.columns if c.lower() not in low])


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of an Arrow string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, size: int):
    """Ranges [i, j) of rows whose bytes sum to about size (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def give_back() -> None:
    """Return this Python worker's freed memory to the system: a worker lives on, and must not hold its last step's peak under the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def keep_freed() -> None:
    """Reuse freed arrays inside this Python worker instead of mapping new pages for each; give_back() returns them after a step."""
    setting = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc only
    if setting is not None:
        setting(-3, 1 << 25)  # M_MMAP_THRESHOLD
        setting(-1, 1 << 28)  # M_TRIM_THRESHOLD


def freed(out):
    """out, after give_back(): for the result of a function whose locals are gone."""
    give_back()
    return out


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (node, smallest node) of the graph with edges a-b; vectorised min-label hooking and pointer jumping."""
    if not len(a):
        return a, b
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        keep = ru != rv
        if not keep.any():
            break
        u, v, ru, rv = u[keep], v[keep], ru[keep], rv[keep]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds over DataFrames; each round is written to the shared folder, so
    nothing about the graph reaches the driver but a count and a checksum. Hot nodes are joined, not windowed: AQE splits them.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        e = materialize(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(e.select("b", "b").distinct())
