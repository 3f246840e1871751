"""Exact removal of passages that begin in an earlier document too, over units that are words or bytes.

A window is `depth` consecutive units. Every window picks an anchor: the run of `gram` units inside it whose hash is least (the
leftmost of equals), grams that very many documents hold last. Equal windows pick equal anchors, so windows can be compared within their
anchor's shard. Consecutive windows of a document that pick the same place form a run; its text is at most 2 * depth - gram units.

  0. grams that stand in very many documents are counted, so that a common phrase among other words does not make one hot shard;
  1. each document's runs go to their anchor's shard as hashes (anchor, text): some bytes a run, no text. Of equal runs in one batch
     of documents only the earliest document's goes; the later ones are settled on the spot, so a passage that is everywhere arrives
     once a batch;
  2. a shard keeps the anchors seen in two documents. Where all runs of an anchor are one text, all documents but the earliest lose it;
     else the shard asks one document for the text of each distinct run;
  3. the texts are sent to the shard, which indexes them; the index gives each window's least document id;
  4. every occurrence of a run learns which of its windows begin in an earlier document, and goes back to its document;
  5. documents drop the units that those windows cover.

Runs count as one text if 40 bits of the anchor's hash and 64 bits of the text's are equal; the hashes mix words as wholes, so no
pattern of letters cancels out. (Of 10^13 runs, two different ones agree with a chance under one in 10^5.) Within an index texts are
compared as they are. Shards (anchors) and cells (documents) are as many as the bytes ask for; each is one bounded task. Batches of
rows travel as packed columns, so the shuffles move few large rows. Nothing is sampled, capped or collected but the list of common
grams, which has GRAMS_KNOWN entries at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import freed, give_back, keep_freed, materialize, slices, small_batches, text_bytes

#: Bytes of text behind one shard and in one cell; units of text handled at a time; symbols in one index.
SHARD_BYTES = 20_000_000
CELL_BYTES = 8_000_000
SLICE = 1 << 18
INDEX_SYMBOLS = 100_000
#: Common grams: in this many documents at least (or more, so that GRAMS_KNOWN bounds their number), and in so many of a batch. Only
#: hashes in the lowest 1 / LOW are counted, as anchors are low.
COMMON_DOCS = 1000
COMMON_IN_BATCH = 16
GRAMS_KNOWN = 1_000_000
LOW = 8
#: Shards that a batch deals its runs to directly; more are dealt in two rounds.
DEAL = 4096
#: Blobs under so many bytes are not compressed; the kinds of their arrays.
LEAN_BYTES = 1024
DTYPES = {"i8": b"i", "u8": b"u", "u4": b"w", "u1": b"c", "i4": b"j"}
NAMES = {v: f"<{k}" for k, v in DTYPES.items()}
#: All windows of a run.
ALL = np.iinfo(np.uint64).max
#: Stands for a null id: after all others, and equal to itself.
LAST = np.iinfo(np.int64).max
MULT = 0x9E3779B97F4A7C15
BYTE = np.random.default_rng(1).integers(1, 2**63, 256).astype(np.uint64)
_powers: list[np.ndarray] = []


@dataclass(frozen=True)
class Kind:
    """Units (words or bytes), their windows, the index of a shard: (bytes, offsets, owners, groups, depth) -> window minima, and the
    sorted hashes of common grams."""

    words: bool
    depth: int
    gram: int
    minima: Callable
    common: np.ndarray | None = None


def pack(*arrays) -> bytes:
    """Arrays (and bytes) as one blob: small ones plainly, so that a deal to very many cells costs little more than its numbers, large
    ones compressed."""
    flat = [np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in arrays]
    if sum(x.nbytes for x in flat) < LEAN_BYTES and all(x.ndim == 1 for x in flat):
        heads = [bytes([1, 0, len(flat)])]
        for x, given in zip(flat, arrays, strict=True):
            heads.append(b"b" if isinstance(given, bytes) else DTYPES[x.dtype.str[1:]])
            heads.append(len(x).to_bytes(2, "little"))
        return b"".join(heads + [x.tobytes() for x in flat])
    return b"\0" + zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes):
    if blob[0] == 0:
        return pickle.loads(zstandard.decompress(memoryview(blob)[1:]))
    out, at = [], 3 + 3 * blob[2]
    for k in range(blob[2]):
        kind, n = blob[3 + 3 * k : 4 + 3 * k], int.from_bytes(blob[4 + 3 * k : 6 + 3 * k], "little")
        if kind == b"b":
            out.append(blob[at : at + n])
            at += n
            continue
        x = np.frombuffer(blob, NAMES[kind], n, at)
        at += x.nbytes
        out.append(x)
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULT and of its inverse, modulo 2^64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 1)
        _powers[:] = []
        for m in (MULT, pow(MULT, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def word_places(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word (a run of anything but ASCII white space)."""
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words: those of up to 16 bytes as two integers, longer ones as wholes."""
    size = end - begin
    wide = np.concatenate([buf, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(wide) - 7,), "<u8", wide, strides=(1,))
    part = []
    for skip in (0, 8):
        left = np.clip(size - skip, 0, 8).astype(np.uint64)
        mask = np.where(left == 0, np.uint64(0), ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))))
        part.append(eight[np.minimum(begin + skip, len(eight) - 1)] & mask)
    h = mixed(mixed(mixed(part[0] + np.uint64(MULT)) ^ part[1]) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = buf.tobytes()
        h[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], 17) for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def units(kind: Kind, buf: np.ndarray, off: np.ndarray):
    """(values, unit offsets of the texts, begin, end): begin and end are byte places of words, None for bytes."""
    if not kind.words:
        return BYTE[buf], off, None, None
    # a text's last word must not run into the next text: texts are laid apart
    apart = np.full(len(buf) + len(off), 32, np.uint8)
    apart[np.arange(len(buf)) + np.repeat(np.arange(len(off) - 1), np.diff(off))] = buf
    begin, end = word_places(apart)
    doc = np.searchsorted(off[1:] + np.arange(1, len(off)), begin, "right")
    values = word_hashes(apart, begin, end)
    return values, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(off) - 1))]), begin - doc, end - doc


def grams(values: np.ndarray, gram: int) -> np.ndarray:
    h, inverse = prefix(values), powers(len(values))[1]
    return mixed((h[gram:] - h[:-gram]) * inverse[: len(values) - gram + 1])


def runs(values: np.ndarray, off: np.ndarray, kind: Kind):
    """(anchor, text, doc, start, end) of the runs of all documents, in order: hashes, document number, first and last unit + 1."""
    depth, gram = kind.depth, kind.gram
    n, wide = len(values), depth - gram + 1
    none = np.zeros(0, np.int64)
    if n < depth:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h, inverse = prefix(values), powers(n)[1]
    g = mixed((h[gram:] - h[:-gram]) * inverse[: n - gram + 1])
    least = ((g >> np.uint64(1)) & np.uint64(0x7FFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    if kind.common is not None and len(kind.common):
        at = np.minimum(np.searchsorted(kind.common, g), len(kind.common) - 1)
        least |= (kind.common[at] == g).astype(np.uint64) << np.uint64(63)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(doc[: n - depth + 1] == doc[depth - 1 :])
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place, own = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), doc[at]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
    start, end = at[head], at[np.append(head[1:], len(at)) - 1] + depth
    text = mixed((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))
    return g[place[head]], text, own[head], start, end


def _low(x: np.ndarray, k: int) -> np.ndarray:
    """The k low bytes of each integer, plane by plane."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :k].T)


def _wide(x: np.ndarray) -> np.ndarray:
    """The integers behind _low."""
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : x.shape[0]] = x.T
    return out.view(np.uint64).ravel()


def _ordinals(doc: np.ndarray) -> np.ndarray:
    """Number of each run within its document (doc ascends)."""
    head = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))


def _split(key: np.ndarray, *arrays):
    """(value, arrays of its rows) for each value of key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]])
    for a, b in zip(head[:-1], head[1:], strict=True):
        yield int(key[order[a]]), tuple(x[order[a:b]] for x in arrays)


def _batch(columns: dict, names: str) -> pa.RecordBatch:
    kinds = {"part": pa.int64(), "cell": pa.int64(), "kind": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in names.split()], names=names.split())


def _documents(batches, size: int):
    """(ids, tags, bytes, offsets) of about `size` bytes of text."""
    held, total = [], 0

    def joined():
        ids, tags, data, off = zip(*held, strict=True)
        shift = np.cumsum([0] + [o[-1] for o in off])
        return np.concatenate(ids), np.concatenate(tags), np.concatenate(data), np.concatenate([[0], *[o[1:] + s for o, s in zip(off, shift[:-1], strict=True)]]).astype(np.int64)

    for b in batches:
        ids = b.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
        tags = b.column("tag").to_numpy(zero_copy_only=False)
        data, off = text_bytes(b.column("text"))
        for i, j in slices(off, size):
            held.append((ids[i:j], tags[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i]))
            total += int(off[j] - off[i])
            if total >= size:
                yield joined()
                held, total = [], 0
    if held:
        yield joined()


def _count_grams(batches, kind: Kind):
    """(gram, documents): grams of low hash that stand in COMMON_IN_BATCH documents of a batch at least."""
    keep_freed()
    for _, _, data, off in _documents(batches, 32 * SLICE):
        found = []
        for i, j in slices(off, SLICE):
            values, uoff, _, _ = units(kind, data[off[i] : off[j]], off[i : j + 1] - off[i])
            if len(values) < kind.gram:
                continue
            g = grams(values, kind.gram)
            at = np.flatnonzero(g < np.uint64((1 << 64) // LOW))
            doc = np.searchsorted(uoff, at, "right") - 1
            inside = at + kind.gram <= uoff[doc + 1]
            g, doc = g[at[inside]], doc[inside]
            order = np.lexsort((doc, g))
            g, doc = g[order], doc[order]
            found.append(g[np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])] if len(g) else g)
        g, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = n >= COMMON_IN_BATCH
        yield pa.RecordBatch.from_arrays([pa.array(g[often].view(np.int64)), pa.array(n[often])], names=["gram", "n"])
        del found, data
        give_back()


def common_grams(work: DataFrame, kind: Kind, size: int) -> np.ndarray:
    """Sorted hashes of the grams that stand in very many documents: their documents sum to `size` / LOW at most, so with this bound
    on each there are GRAMS_KNOWN of them at most."""
    least = max(COMMON_DOCS, size // (LOW * GRAMS_KNOWN))
    t = work.mapInArrow(lambda it: _count_grams(it, kind), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(t.select("gram").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _send_runs(batches, kind: Kind, shards: int, cells: int):
    """Runs to their shards; of equal runs of a batch only the earliest (part -1 - cell: the others, which lose all their windows)."""
    keep_freed()
    for ids, tags, data, off in _documents(batches, 32 * SLICE):
        found = []
        for i, j in slices(off, SLICE):
            values, uoff, _, _ = units(kind, data[off[i] : off[j]], off[i : j + 1] - off[i])
            anchor, text, doc, _, _ = runs(values, uoff, kind)
            found.append((anchor, text, doc + i, _ordinals(doc)))
        anchor, text, doc, ordinal = (np.concatenate(x) for x in zip(*found, strict=True))
        out = {"part": [], "blob": []}
        if len(text):
            key = text ^ mixed(anchor)
            order = np.argsort(key, kind="stable")
            head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            least = np.repeat(np.minimum.reduceat(ids[doc[order]], np.flatnonzero(head)), np.diff(np.append(np.flatnonzero(head), len(order))))
            late = np.zeros(len(text), bool)
            late[order] = ids[doc[order]] > least
            for cell, (d, o) in _split(_cell(ids[doc[late]], cells), doc[late], ordinal[late]):
                out["part"].append(-1 - cell)
                out["blob"].append(pack(ids[d], tags[d], o, np.full(len(d), ALL)))
            anchor, text, doc, ordinal = (x[~late] for x in (anchor, text, doc, ordinal))
        part = (anchor >> np.uint64(24)).astype(np.int64) % shards
        for p, (a, t, d, o) in _split(part // -(-shards // DEAL) if shards > DEAL else part, anchor, text, doc, ordinal):
            out["part"].append(p)
            out["blob"].append(_run_blob(ids, tags, d, a, t, o))
        yield _batch(out, "part blob")
        del found, anchor, text, doc, ordinal, out, data
        give_back()


def _run_blob(ids, tags, doc, anchor, text, ordinal) -> bytes:
    """Runs of documents, in order of their documents."""
    who, count = np.unique(doc, return_counts=True)
    return pack(ids[who], tags[who], count.astype(np.uint32), _low(anchor >> np.uint64(24), 5), _low(text, 8), _low(ordinal.astype(np.uint32), 4))


def _runs_in(blobs: list):
    """(ids, tags, anchor, text, ordinal) of the runs in blobs."""
    cols = list(zip(*(unpack(x) for x in blobs), strict=True))
    count = np.concatenate(cols[2])
    ids, tags = np.repeat(np.concatenate(cols[0]), count), np.repeat(np.concatenate(cols[1]), count)
    return ids, tags, *(_wide(np.concatenate(c, axis=1)) for c in cols[3:5]), _wide(np.concatenate(cols[5], axis=1)).astype(np.int64)


def _deal_again(batches, shards: int):
    """The second round of a deal to many shards: what came for a range of shards goes to each of them, in larger pieces."""
    keep_freed()

    def dealt(blobs):
        ids, tags, anchor, text, ordinal = _runs_in(blobs)
        doc = np.cumsum(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) - 1
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for p, (a, t, d, o) in _split(anchor.astype(np.int64) % shards, anchor << np.uint64(24), text, doc, ordinal):
            yield p, _run_blob(ids[first], tags[first], d, a, t, o)

    held, room = [], 4 * CELL_BYTES

    def flush():
        out = {"part": [], "blob": []}
        for p, blob in dealt(held):
            out["part"].append(p)
            out["blob"].append(blob)
        return _batch(out, "part blob")

    for b in batches:
        own = b.column("part").to_numpy()
        yield b.filter(pa.array(own < 0))
        for x in b.column("blob").filter(pa.array(own >= 0)):
            held.append(x.as_py())
            room -= len(held[-1])
            if room <= 0:
                yield flush()
                held, room = [], 4 * CELL_BYTES
    if held:
        yield flush()


def _cell(ids: np.ndarray, cells: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(MULT)) >> np.uint64(33)).astype(np.int64) % cells


def _shard_runs(t: pa.Table, cells: int) -> pa.Table:
    """The runs worth a look in one shard. kind 0: for a cell, the runs whose text is asked for; kind 1: all occurrences of the runs of
    anchors with several texts; kind 2: for a cell, occurrences that are settled."""
    part, blobs = t.column("part")[0].as_py(), [x.as_py() for x in t.column("blob")]
    out = {"kind": [], "part": [], "cell": [], "blob": []}

    def add(*row):
        for k, v in zip(out, row, strict=True):
            out[k].append(v)

    if part < 0:
        for x in blobs:
            add(2, part, -1 - part, x)
        return pa.Table.from_batches([_batch(out, "kind part cell blob")])
    ids, tags, anchor, text, ordinal = _runs_in(blobs)
    order = np.argsort(anchor, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    shared = np.minimum.reduceat(ids[order], head) != np.maximum.reduceat(ids[order], head) if len(order) else np.zeros(0, bool)
    keep = order[np.repeat(shared, np.diff(np.append(head, len(order))))]
    if len(keep):
        anchor, text, ids, tags, ordinal = (x[keep] for x in (anchor, text, ids, tags, ordinal))
        order = np.lexsort((ids, text, anchor))
        anchor, text, ids, tags, ordinal = (x[order] for x in (anchor, text, ids, tags, ordinal))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], text[1:] != text[:-1]])
        group, run = np.cumsum(new_anchor) - 1, np.cumsum(new) - 1
        owner = ids[np.flatnonzero(new)]
        one = (np.bincount(group[new]) == 1)[group]  # anchors with a single text
        late = one & (ids > owner[run])
        for cell, x in _split(_cell(ids[late], cells), ids[late], tags[late], ordinal[late], np.full(int(late.sum()), ALL)):
            add(2, part, cell, pack(*x))
        ids, tags, ordinal, group, new = (x[~one] for x in (ids, tags, ordinal, group, new))
        run, first = np.cumsum(new) - 1, np.flatnonzero(new)
        for cell, x in _split(_cell(ids[first], cells), ids[first], tags[first], ordinal[first], run[first]):
            add(0, part, cell, pack(*x))
        if len(run):
            add(1, part, 0, pack(ids, tags, ordinal, run.astype(np.uint32), ids[first], group[first].astype(np.uint32)))
    return pa.Table.from_batches([_batch(out, "kind part cell blob")])


def _send_documents(batches, cells: int):
    for ids, tags, data, off in _documents(batches, CELL_BYTES):
        out = {"cell": [], "blob": []}
        raw = data.tobytes()
        for cell, (rows,) in _split(_cell(ids, cells), np.arange(len(ids))):
            out["cell"].append(cell)
            out["blob"].append(pack(ids[rows], tags[rows], off[rows + 1] - off[rows], b"".join(raw[off[r] : off[r + 1]] for r in rows)))
        yield _batch(out, "cell blob")
        del raw, out, data
        give_back()


def _cell_documents(docs: pa.Table):
    for x in docs.column("blob"):
        ids, tags, size, raw = unpack(x.as_py())
        yield ids, tags, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _key(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), [("id", np.int64), ("tag", np.int64)])
    out["id"], out["tag"] = ids, tags
    return out


def _located(kind: Kind, docs: pa.Table, ids: np.ndarray, tags: np.ndarray, ordinal: np.ndarray):
    """For each slice of the cell's documents: its units and runs, and which asked-for runs (rows of ids, tags, ordinal) are in it."""
    asked = _key(ids, tags)
    order = np.argsort(asked, order=("id", "tag"), kind="stable")
    asked = asked[order]
    for own, tag, data, off in _cell_documents(docs):
        me = _key(own, tag)
        lo, hi = np.searchsorted(asked, me, "left"), np.searchsorted(asked, me, "right")
        for i, j in slices(off, SLICE):
            buf, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if not (hi[i:j] > lo[i:j]).any():
                yield (own[i:j], tag[i:j], buf, o), None
                continue
            values, uoff, begin, end = units(kind, buf, o)
            _, _, doc, start, stop = runs(values, uoff, kind)
            first = np.searchsorted(doc, np.arange(j - i))
            n = hi[i:j] - lo[i:j]
            who = np.repeat(np.arange(j - i), n)
            row = order[np.repeat(lo[i:j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            at = first[who] + ordinal[row]
            yield (own[i:j], tag[i:j], buf, o), (row, who, start[at], stop[at], uoff, begin, end)


def _send_texts(docs: pa.Table, wants: pa.Table, kind: Kind) -> pa.Table:
    """The texts that the shards ask a cell for."""
    keep_freed()
    out = {"part": [], "blob": []}
    if docs.num_rows and wants.num_rows:
        parts = wants.column("part").to_numpy()
        ids, tags, ordinal, run = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in wants.column("blob")), strict=True))
        part = np.repeat(parts, [len(unpack(x.as_py())[0]) for x in wants.column("blob")])
        texts: list[bytes | None] = [None] * len(ids)
        for (_, _, buf, _), found in _located(kind, docs, ids, tags, ordinal):
            if found:
                row, _, start, stop, _, begin, end = found
                raw = buf.tobytes()
                a, b = (begin[start], end[stop - 1]) if kind.words else (start, stop)
                for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
                    texts[r] = raw[x:y]
        size = np.array([len(x) for x in texts], np.int64)
        where = np.arange(len(ids))
        for p, (rows,) in _split(part, where):
            out["part"].append(p)
            out["blob"].append(pack(run[rows], size[rows], b"".join(texts[r] for r in rows)))
    return pa.Table.from_batches([_batch(out, "part blob")])


def _search(texts: pa.Table, marks: pa.Table, kind: Kind, cells: int) -> pa.Table:
    """Index the texts of a shard; tell each occurrence which of its windows (a bit each) begin in an earlier document."""
    keep_freed()
    out = {"cell": [], "blob": []}
    if texts.num_rows and marks.num_rows:
        ids, tags, ordinal, run, owner, group = unpack(marks.column("blob")[0].as_py())
        number, size, raw = zip(*(unpack(x.as_py()) for x in texts.column("blob")), strict=True)
        number, size = np.concatenate(number), np.concatenate(size)
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        del raw
        at = np.empty(len(owner), np.int64)
        at[number] = np.arange(len(number))
        head = np.searchsorted(run, np.arange(len(owner) + 1))
        # whole anchors, in indexes of bounded size
        edge = np.append(np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])), len(owner))
        weight = np.concatenate([[0], np.cumsum(size[at])]) // (6 if kind.words else 1)
        found = []
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(weight[edge], weight[edge[i]] + INDEX_SYMBOLS, "right")) - 1)
            lo, hi = edge[i], edge[j]
            rows = at[lo:hi]
            n = size[rows]
            own = buf[np.repeat(off[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            least = kind.minima(own, np.concatenate([[0], np.cumsum(n)]), owner[lo:hi], group[lo:hi], kind.depth)
            for a in range(head[lo], head[hi], 1 << 16):
                b = min(a + (1 << 16), head[hi])
                early = least[run[a:b].astype(np.int64) - lo] < ids[a:b, None]
                mask = (early.astype(np.uint64) << np.arange(early.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                hit = np.flatnonzero(mask) + a
                found.append((ids[hit], tags[hit], ordinal[hit], mask[hit - a]))
            i = j
        ids, tags, ordinal, mask = (np.concatenate(x) for x in zip(*found, strict=True))
        for cell, x in _split(_cell(ids, cells), ids, tags, ordinal, mask):
            out["cell"].append(cell)
            out["blob"].append(pack(*x))
    return pa.Table.from_batches([_batch(out, "cell blob")])


def _cut(docs: pa.Table, answers: pa.Table, kind: Kind) -> pa.Table:
    """The results of a cell's documents: (id, tag, units, removed, spans, kept)."""
    keep_freed()
    cols: dict[str, list] = {"id": [], "tag": [], "n_units": [], "n_removed": [], "n_spans": [], "kept": []}
    if answers.num_rows:
        ids, tags, ordinal, mask = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in answers.column("blob")), strict=True))
    else:
        ids, tags, ordinal, mask = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for (own, tag, buf, off), found in _located(kind, docs, ids, tags, ordinal):
        raw = buf.tobytes()
        if found:
            row, who, start, stop, uoff, begin, end = found
            gone = np.zeros(uoff[-1] + 1, np.int64)
            whole = mask[row] == ALL  # of a run of 64 windows this says the same
            np.add.at(gone, start[whole], 1)
            np.add.at(gone, stop[whole], -1)
            for k in range(kind.depth - kind.gram + 1):
                s = start[~whole & ((mask[row] >> np.uint64(k)) & np.uint64(1) == 1)] + k
                np.add.at(gone, s, 1)
                np.add.at(gone, s + kind.depth, -1)
            gone = np.cumsum(gone)[:-1] > 0
            changed = set(who.tolist())
        for i in range(len(own)):
            text = raw[off[i] : off[i + 1]]
            words = text.split() if kind.words else None
            n = len(words) if kind.words else len(text)
            removed, spans = 0, 0
            kept = b" ".join(words) if kind.words else text
            if found and i in changed:
                g = gone[uoff[i] : uoff[i + 1]]
                removed = int(g.sum())
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1))
                if kind.words:
                    kept = b" ".join(w for w, x in zip(words, g, strict=True) if not x)
                else:
                    kept = np.frombuffer(text, np.uint8)[~g].tobytes()
            for c, v in zip(cols, (int(own[i]), int(tag[i]), n, removed, spans, kept), strict=True):
                cols[c].append(v)
    return pa.table({c: pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in cols.items()})


def remove_repeats(docs: DataFrame, kind: Kind, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, n_units, n_removed, n_spans, kept) for each row of docs; tag is a hash of the text (see tag_of).

    A unit goes if it is covered by a window whose units also begin in a document of smaller id, judged on the input. Null text
    counts as empty; a null id is larger than all others; rows that repeat an id are never earlier than each other.
    """
    if not 1 <= kind.gram <= kind.depth <= kind.gram + 63 or kind.depth > 255:
        raise ValueError("a window must hold the gram, at most 63 units more, and at most 255 units.")
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"'{id_col}' has to be an integer.")
    work = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), tag_of(text_col).alias("tag"), F.col(text_col).alias("text"))
    size = work.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, cells = 1 + int(size // SHARD_BYTES), 1 + int(size // CELL_BYTES)
    found = common_grams(work, kind, size)
    if len(found):
        kind = replace(kind, common=found)
    sent = work.mapInArrow(lambda it: _send_runs(it, kind, shards, cells), "part long, blob binary")
    if shards > DEAL:
        sent = sent.repartition(min(DEAL, shards), "part").mapInArrow(lambda it: _deal_again(it, shards), "part long, blob binary")
    seen = materialize(sent.groupBy("part").applyInArrow(lambda t: freed(_shard_runs(t, cells)), "kind long, part long, cell long, blob binary"), "runs")
    parcels = work.mapInArrow(lambda it: _send_documents(it, cells), "cell long, blob binary")
    wants, marks = seen.where("kind = 0").select("part", "cell", "blob"), seen.where("kind = 1").select("part", "blob")
    texts = parcels.groupBy("cell").cogroup(wants.groupBy("cell")).applyInArrow(lambda a, b: freed(_send_texts(a, b, kind)), "part long, blob binary")
    answers = texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(lambda a, b: freed(_search(a, b, kind, cells)), "cell long, blob binary")
    answers = materialize(answers, "answers").unionByName(seen.where("kind = 2").select("cell", "blob"))
    out = parcels.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(lambda a, b: freed(_cut(a, b, kind)), "id long, tag long, n_units long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.when(F.col("id") != LAST, F.col("id")))


def tag_of(text_col: str) -> F.Column:
    return F.xxhash64(text_col).bitwiseAND(F.lit(0xFFFFFFFF))
