"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows, text scanned once."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, without

#: Words are runs of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of benchmark text in one automaton, and in one broadcast. A worker keeps up to KEPT automata; of more, each is built for
#: every CHUNK_BYTES of documents. Beyond BROADCAST_BYTES the documents are passed through once more for each broadcast.
BLOCK_BYTES = 256_000
BROADCAST_BYTES = 64 << 20
CHUNK_BYTES = 64 << 20
KEPT = 3
RESULT = ("n_words", "n_hit", "item_ids", "spans", "contaminated")


def normalise(text: str | None) -> str:
    """Words joined by one space, one character per UTF-8 byte."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()).decode("latin-1")


def windows(text: str | None, size: int) -> set[str]:
    words = normalise(text).split(" ") if text else []
    words = [w for w in words if w]
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def build(items: list[tuple[str, str]], size: int):
    """Automaton over the windows of (item id, text); each value is (words in the window, item ids)."""
    import ahocorasick

    owners = defaultdict(set)
    for item, text in items:
        for w in windows(text, size):
            owners[w].add(item)
    auto = ahocorasick.Automaton()
    for w, ids in owners.items():
        auto.add_word(f" {w} ", (w.count(" ") + 1, tuple(ids)))
    if owners:
        auto.make_automaton()
    return auto if owners else None


def scan(text: str | None, auto) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged hit ranges [first word, last word + 1), ids of the items that occur."""
    norm = normalise(text)
    if not norm:
        return 0, [], set()
    n = norm.count(" ") + 1
    if auto is None:
        return n, [], set()
    norm = f" {norm} "
    found, items, ends = [], set(), None
    for end, (k, ids) in auto.iter(norm):
        found.append((end, k))
        items.update(ids)
    if not found:
        return n, [], items
    ends = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(ends, [e for e, _ in found])
    merged: list[list[int]] = []
    for b, a in sorted((int(x), int(x) - k) for x, (_, k) in zip(last, found, strict=True)):
        lo, hi = a, b
        while merged and merged[-1][1] >= lo:
            p = merged.pop()
            lo, hi = min(lo, p[0]), max(hi, p[1])
        merged.append([lo, hi])
    return n, [(a, b) for a, b in merged], items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Benchmark rows in lists of blocks; a block holds about BLOCK_BYTES, a list about BROADCAST_BYTES. Rows stream to the driver a
    partition at a time."""
    blocks, room, total = [[]], BLOCK_BYTES, 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if blocks[-1] and len(text) > room:
            if total > BROADCAST_BYTES:
                yield blocks
                blocks, total = [], 0
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append((item, text))
        room -= len(text)
        total += len(text)
    yield blocks


_built: dict = {}


def _automata(key: str, blocks: list, size: int):
    """The automata of the blocks, one after the other. A worker process keeps them between its tasks if they are few."""
    if len(blocks) > KEPT:
        for block in blocks:
            yield build(block, size)
        return
    if key not in _built:
        _built.clear()
        _built[key] = [build(block, size) for block in blocks]
    yield from _built[key]


def _chunks(batches, text_col: str, size: int):
    """Lists of batches with about `size` bytes of text."""
    held, room = [], size
    for b in batches:
        held.append(b)
        room -= b.column(text_col).nbytes
        if room <= 0:
            yield held
            held, room = [], size
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, one_in: int = 20, only_clean: bool = False) -> DataFrame:
    """Mark documents that hold benchmark windows.

    A window is `window` consecutive words of an item (a shorter item is one window). Adds n_words, n_hit (words inside any
    occurrence), item_ids (sorted strings), spans (start, end: character offsets of the merged hits in the original text) and
    contaminated (n_hit > 0 and one_in * n_hit >= n_words). only_clean: return the uncontaminated rows, columns unchanged.
    Map-only: no shuffle; a worker holds one automaton of BLOCK_BYTES at a time beyond KEPT of them. Null or empty text has no words; items
    with null id or text are ignored; repeated rows are judged each; columns with the result names are replaced.
    """
    spark = small_batches(docs).sparkSession
    if not only_clean:
        docs = without(docs, *RESULT)
    base, own = docs.schema, fresh(docs, "_words", "_ranges", "_items")
    state = f"{own[0]} long, {own[1]} array<long>, {own[2]} array<string>"
    work = docs
    for blocks in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(blocks)

        def step(batches, sent=sent, first=work is docs, key=uuid.uuid4().hex, many=len(blocks) > KEPT):
            # with automata at hand a batch goes as it comes; else each automaton is built once for a chunk of batches
            for chunk in _chunks(batches, text_col, CHUNK_BYTES if many else 1):
                old = [(None, None, None)] * len(chunk) if first else [tuple(b.column(c).to_pylist() for c in own) for b in chunk]
                words = [[0] * b.num_rows for b in chunk]
                ranges = [[[]] * b.num_rows if first else o[1] for b, o in zip(chunk, old, strict=True)]
                items = [[set()] * b.num_rows if first else [set(x) for x in o[2]] for b, o in zip(chunk, old, strict=True)]
                for auto in _automata(key, sent.value, window):
                    for b, w, r, m in zip(chunk, words, ranges, items, strict=True):
                        for i, text in enumerate(b.column(text_col)):
                            w[i], found, ids = scan(text.as_py(), auto)
                            if found:
                                r[i] = r[i] + [x for ab in found for x in ab]
                                m[i] = m[i] | ids
                    del auto
                for b, w, r, m in zip(chunk, words, ranges, items, strict=True):
                    keep = b.num_columns if first else b.num_columns - 3
                    yield pa.RecordBatch.from_arrays([b.column(k) for k in range(keep)] + [pa.array(w, pa.int64()), pa.array(r, pa.list_(pa.int64())), pa.array([sorted(x) for x in m], pa.list_(pa.string()))], names=[*b.schema.names[:keep], *own])

        work = work.mapInArrow(step, _schema(base, state))

    def finish(batches):
        for b in batches:
            text, words, ranges = b.column(b.schema.names.index(text_col)), b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_pylist()
            hit, spans, bad = [], [], []
            for i, (n, flat) in enumerate(zip(words, ranges, strict=True)):
                mark = np.zeros(n + 1, np.int64)
                for a, z in zip(flat[::2], flat[1::2], strict=True):
                    mark[a] += 1
                    mark[z] -= 1
                on = np.cumsum(mark)[:n] > 0
                h = int(on.sum())
                hit.append(h)
                bad.append(h > 0 and one_in * h >= n)
                spans.append(_spans(text[i].as_py(), on) if h and not only_clean else [])
            if only_clean:
                yield b.select(b.schema.names[:-3]).filter(pa.array([not x for x in bad]))
                continue
            cols = [b.column(k) for k in range(b.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.int64()), pa.array(hit, pa.int64()), b.column(b.num_columns - 1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(bad, pa.bool_())], names=[*b.schema.names[:-3], *RESULT])

    return work.mapInArrow(finish, base if only_clean else _schema(base, "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"))


def _spans(text: str, on: np.ndarray) -> list[dict]:
    """Character ranges of the marked word runs in the original text."""
    places = [m.span() for m in ORIGINAL.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[z - 1][1]} for a, z in zip(edge[::2], edge[1::2], strict=True)]


def _schema(base, ddl: str):
    from pyspark.sql.types import StructType

    return StructType([*base.fields, *StructType.fromDDL(ddl).fields])
