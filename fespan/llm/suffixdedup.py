"""Suffix-array dedup over bytes: 50-byte strings that begin in an earlier document too, found in suffix arrays built by grouping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lyndon
from .common import fresh
from .overlap import Kind, remove_repeats, tag_of

WINDOW = 50
GRAM = 20


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, tag, n_bytes, n_removed, n_spans, kept): UTF-8 bytes of the whole text less those covered by a `window`-byte string that
    also begins in a document of smaller id; n_spans counts maximal removed runs; kept is binary, as a cut may fall inside a character.

    The suffix array of each shard's distinct candidate passages comes from lyndon.suffix_order. See overlap for the plan, for
    nulls, ties and repeated rows. window - gram + 1 is at most 64.
    """
    out = remove_repeats(docs, Kind(False, window, gram, lyndon.window_minima), id_col, text_col)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("n_units", "n_bytes")


def _decoded(batches):
    for b in batches:
        text = [x.as_py().decode("utf-8", "ignore") for x in b.column("kept")]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_tag"), pa.array(text, pa.string())], names=["_id", "_tag", "_text"])


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars", **how) -> DataFrame:
    """docs with the text replaced by what is kept (a character that lost one of its bytes goes as a whole) and n_col by its length.
    Rows and columns are those of docs, whatever the columns' names; rows with a null id or text stay; id_col is an integer."""
    found = remove_repeated_bytes(docs, id_col, text_col, **how).where("n_removed > 0").select(F.col(id_col).alias("_id"), F.col("tag").alias("_tag"), "kept")
    i, tag, text, own = fresh(docs, "_id", "_tag", "_text", "_own")
    found = found.mapInArrow(_decoded, "_id long, _tag long, _text string").dropDuplicates(["_id", "_tag"]).toDF(i, tag, text)
    whole = docs.withColumn(own, tag_of(text_col)).join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(tag)), "left")
    kept = F.when(F.col(tag).isNotNull(), F.col(text)).otherwise(F.col(text_col))
    return whole.select(*[kept.alias(c) if c == text_col else F.length(kept).cast(docs.schema[c].dataType).alias(c) if c == n_col else F.col(c) for c in docs.columns])
