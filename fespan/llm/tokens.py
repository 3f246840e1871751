"""Token counts: delta-maintained rollups by source, language and tokenizer version, with idempotent batch commits."""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

#: Default vocabulary (a parameter of count_tokens) and its pre-tokenizer pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEYS = ("source", "lang", "version")
_known: dict[int, object] = {}


def encoding(raw: bytes):
    """tiktoken encoding of a rank file's content; one for each Python worker."""
    if hash(raw) not in _known:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _known[hash(raw)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _known[hash(raw)]


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, version: str | None = None) -> DataFrame:
    """docs without the text, with tokens (of the whole text; null and empty text: 0) and version (the file's stem).

    Map-only. The rank file is read by the driver and broadcast (a vocabulary of fixed size). Columns named tokens or version, in
    any case, are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    docs = docs.select(text_col, *without(docs, text_col, "tokens", "version").columns)
    base = docs.schema.fields[1:]

    def step(batches):
        enc = encoding(sent.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(step, StructType([*base, StructField("tokens", LongType())])).withColumn("version", F.lit(version or Path(vocabulary).stem))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents: rows with source, lang, version, tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents away again; counts are those under which they were added."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens", new: str = "tokens") -> DataFrame:
    """Changes that replace a document's count `old` by `new`."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


class TokenRollup:
    """Additive totals kept as one small table of deltas for each committed batch.

    A batch is aggregated (partial sums before the shuffle, so a hot source moves a row a task) and written into a folder of its id.
    The marker that Spark writes last commits it: a folder without the marker counts for nothing, and the same batch, tried again,
    overwrites it; a batch that is committed is not applied again. Nothing relies on renames, so an object store serves. One writer at a
    time. Totals are the sums of all deltas; groups whose documents and tokens are all gone are left out. Null source or language is a
    group of its own; null counts add nothing. compact() sums what is there into one table and remembers the batches in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}/_SUCCESS"))

    def _folders(self, kind: str) -> list[str]:
        found = self._fs.listStatus(self._path(self.path)) if self._fs.exists(self._path(self.path)) else []
        return sorted(n.removeprefix(kind) for s in found if (n := s.getPath().getName()).startswith(kind))

    def _base(self) -> str | None:
        """The latest whole compaction."""
        whole = [b for b in self._folders("base=") if self._there(f"base={b}/sums")]
        return f"base={max(whole, key=int)}" if whole else None

    def _summed(self) -> list[str]:
        base = self._base()
        return [r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/names").collect()] if base else []

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Apply the changes as one batch; False if that batch is committed already."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id consists of letters, digits, - and _")
        if batch in self.batches():
            return False
        rows = changes[0]
        for c in changes[1:]:
            rows = rows.unionByName(c)
        sums = rows.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        return sorted({*self._summed(), *(b for b in self._folders("batch=") if self._there(f"batch={b}"))})

    def compact(self) -> None:
        """Sum all deltas into one table; the batches in it stay committed. The sums are written last: until then the old ones hold."""
        names, old, folders = self.batches(), self._base(), self._folders("batch=")
        new = f"base={int(old.removeprefix('base=')) + 1 if old else 0}"
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.mode("overwrite").parquet(f"{self.path}/{new}/names")
        self._deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/{new}/sums")
        for gone in [*(f"batch={b}" for b in folders if b in names), *([old] if old else [])]:
            self._fs.delete(self._path(f"{self.path}/{gone}"), True)

    def _deltas(self) -> DataFrame:
        base, summed = self._base(), set(self._summed())
        there = [f"{self.path}/batch={b}" for b in self.batches() if b not in summed] + ([f"{self.path}/{base}/sums"] if base else [])
        kind = "source string, lang string, version string, docs long, tokens long"
        return self.spark.read.schema(kind).parquet(*there) if there else self.spark.createDataFrame([], kind)

    def totals(self) -> DataFrame:
        return self._deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
