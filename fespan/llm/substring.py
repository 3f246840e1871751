"""Substring dedup over words: passages of 50 words that begin in an earlier document too, found in compressed FM-indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fmindex
from .overlap import Kind, remove_repeats

WINDOW = 50
GRAM = 8


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, n_spans, kept_text): words `[^\\x20\\x09-\\x0D]+` of the whole text less those covered by a window of
    `window` words that also begins in a document of smaller id; kept words are joined by one space.

    Each shard of candidate passages is a compressed FM-index (wavelet tree over the transform of its distinct passages). Passages
    are streamed through it by backward search; matching lengths that reach the window are intervals, whose least document id
    decides. See overlap for the plan, for nulls, ties and repeated rows. window - gram + 1 is at most 64.
    """
    kind = Kind(True, window, gram, fmindex.window_minima)
    out = remove_repeats(docs, kind, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.decode("kept", "UTF-8").alias("kept_text"))
