"""SimHash near-dedup: 64-bit fingerprints of word shingles, tiled exact comparison by exclusive-or and bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, give_back, local_forest, materialize, slices, small_batches, text_bytes, without

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Bytes of text hashed at a time.
SLICE = 1 << 20
#: Distinct fingerprints of one block value that a task compares; more are dealt out as pairs of tiles.
TILE_ROWS = 8192
TILE = 512
#: Blocks that two fingerprints within the radius agree on: two make keys of 32 bits, so that few rows of many meet by chance.
SPARE = 2
#: For a byte: its bits spread over eight byte lanes.
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_ranges(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start : start + size] for many ranges; those of 32 bytes and more go through the xxhash library."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    w8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    w4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    at, left = start.copy(), size.copy()
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if len(on):
            k = _rot(w8[at[on]] * P2, 31) * P1
            h[on] = _rot(h[on] ^ k, 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
    on = np.flatnonzero((left >= 4) & (size < 32))
    if len(on):
        h[on] = _rot(h[on] ^ (w4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero((left > 0) & (size < 32))
        if len(on):
            h[on] = _rot(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = padded.tobytes()
        one = xxhash.xxh64_intdigest
        h[long] = np.fromiter((one(raw[a : a + n], seed) for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: a bit is set if it is set in over half of the shingle hashes; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    norm = [b" ".join(t.lower().split()) for t in texts]
    rows = np.array([i for i, t in enumerate(norm) if t], np.int64)
    if not len(rows):
        return out
    buf = np.frombuffer(b" ".join(norm[i] for i in rows) + b" ", np.uint8)
    gap = np.flatnonzero(buf == 32)
    begin = np.concatenate([[0], gap[:-1] + 1])
    ends = np.cumsum([len(norm[i]) + 1 for i in rows])
    last = np.searchsorted(gap, ends - 1)
    first = np.concatenate([[0], last[:-1] + 1])
    words = last - first + 1
    count = np.maximum(1, words - shingle + 1)
    # the shingle that starts at each of the first `count` words of a text
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    until = np.minimum(starts + shingle - 1, np.repeat(last, count))
    h = xxh64_ranges(buf, begin[starts], gap[until] - begin[starts], seed)
    # eight byte lanes at a time, at most 255 shingles to a lane
    per = -(-count // 255)
    head = np.concatenate([[0], np.cumsum(count)[:-1]])
    cut = np.repeat(head - 255 * np.concatenate([[0], np.cumsum(per)[:-1]]), per) + 255 * np.arange(per.sum())
    group = np.concatenate([[0], np.cumsum(per)[:-1]])
    view = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[view[:, k]], cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
        over = (2 * sums > count[:, None]).astype(np.uint64)
        out[rows] |= (over << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_batches(batches, text_col: str, shingle: int, seed: int):
    for b in batches:
        data, off = text_bytes(b.column(text_col))
        raw, fp = data.tobytes(), np.zeros(b.num_rows, np.uint64)
        for i, j in slices(off, SLICE):
            fp[i:j] = fingerprints([raw[off[k] : off[k + 1]] for k in range(i, j)], shingle, seed)
        names = [n for n in b.schema.names if n != text_col]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fp.view(np.int64))], names=[*names, "fp"])
        give_back()


def _pairs(batches, radius: int):
    """Links inside a partition of rows (blk, val, p, q, fp): tiles sorted by bit count, pairs of tiles beyond the radius skipped."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    key = [t.column(c).to_numpy() for c in ("blk", "val", "p", "q")]
    fp = t.column("fp").to_numpy().view(np.uint64)
    ones = np.bitwise_count(fp)
    order = np.lexsort([ones, *key[::-1]])
    fp, ones, key = fp[order], ones[order], [k[order] for k in key]
    new = np.ones(len(fp), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    head = np.append(np.flatnonzero(new), len(fp))
    size = np.diff(head)
    group = np.repeat(np.arange(len(size)), size)
    left, right = [], []
    # small groups, all at once: each row against the one s places on
    rows = np.flatnonzero(np.repeat(size <= 64, size))
    for s in range(1, 64):
        rows = rows[rows + s < len(fp)]
        # rows of a group ascend by bit count: one that is beyond the radius here stays so further on
        rows = rows[(group[rows] == group[rows + s]) & (ones[rows + s].astype(np.int64) - ones[rows] <= radius)]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + s]) <= radius]
        left.append(fp[near])
        right.append(fp[near + s])
    for g in np.flatnonzero(size > 64):
        x, w = fp[head[g] : head[g + 1]], ones[head[g] : head[g + 1]].astype(np.int64)
        a, b = [], []
        for i in range(0, len(x), TILE):
            for j in range(i, len(x), TILE):
                if w[j] - w[min(i + TILE, len(x)) - 1] > radius:
                    break
                u, v = np.nonzero(np.bitwise_count(x[i : i + TILE, None] ^ x[None, j : j + TILE]) <= radius)
                keep = u + i < v + j
                a.append(x[i + u[keep]])
                b.append(x[j + v[keep]])
        a, b = local_forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        left.append(a.view(np.uint64))
        right.append(b.view(np.uint64))
    if left:
        a, b = local_forest(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def link_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (fp) within radius bits.

    Two fingerprints within the radius agree on all but `radius` of radius + SPARE blocks of bits: rows meet by the bits of every
    choice of SPARE blocks, are sorted by bit count and compared in tiles, and pairs of tiles whose counts differ by more than the radius are
    skipped. A value with more than TILE_ROWS rows is dealt out as pairs of salted tiles to many tasks.
    """
    edge = [64 * k // (radius + SPARE) for k in range(radius + SPARE + 1)]
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    masks = [sum(c) for c in combinations(blocks, SPARE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.explode(F.array(*[F.struct(F.lit(k).alias("blk"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("val")) for k, m in enumerate(signed)])).alias("x")
    rows = distinct.select("fp", choices).select("fp", "x.*")
    hot = rows.groupBy("blk", "val").count().where(F.col("count") > TILE_ROWS).select("blk", "val", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("g"))
    rows = rows.join(hot, ["blk", "val"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    rows = rows.select("blk", "val", "fp", "t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("s")).select("blk", "val", F.least("t", "s").alias("p"), F.greatest("t", "s").alias("q"), "fp")
    return rows.repartition("blk", "val", "p", "q").mapInArrow(lambda it: _pairs(it, radius), "a long, b long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """docs (without the text) with fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link at radius or fewer differing bits. Null and empty texts have fingerprint zero, linked like any other.
    Equal fingerprints are one node, so groups of copies cost one row; ties and repeated rows fall into one component; a null id
    never names a component that has another. Columns named like results are replaced.
    """
    marked = _marked(without(docs, "fingerprint", "component_id", "fp"), text_col, shingle, seed)
    nodes = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius))
    root = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    linked = root.join(root.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id")
    return marked.join(linked, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).drop("fp")


def _marked(rest: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """rest with fp instead of the text, written once."""
    return materialize(small_batches(rest).mapInArrow(lambda it: _fingerprint_batches(it, text_col, shingle, seed), _fp_schema(rest, text_col)), "simhash")


def _fp_schema(df: DataFrame, text_col: str):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([*[f for f in df.schema.fields if f.name != text_col], StructField("fp", LongType())])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, null_ids: bool = True) -> DataFrame:
    """One row of each group of near copies: the one with the least id (nulls last), of those the one with the least hash of the
    text, of rows equal in both any one. Columns are unchanged. Rows meet their choice by id and text, nulls included, not by id alone.
    Groups without any id keep a row too, unless null_ids is False."""
    key = "_key"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    keys = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    marked = _marked(docs.select(keys.alias("key"), F.col(text_col).alias("text")), "text", shingle, seed)
    nodes = marked.groupBy("fp").agg(F.min("key").alias("key"))
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius))
    best = nodes.join(roots, nodes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("key").alias("key"))
    best = best if null_ids else best.where(~F.col("key.none"))
    # a merge join deals the rows by key, which the numbering of repeated rows then needs not do again; the cast makes both keys one type
    kept = docs.withColumn(key, keys.cast(best.schema["key"].dataType)).join(best.select(F.col("key").alias(key)).hint("merge"), key, "left_semi")
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))  # over 1 only for repeated rows
    return kept.withColumn(f"{key}n", place).where(F.col(f"{key}n") == 1).drop(key, f"{key}n")
