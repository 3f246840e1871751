"""Embedding near-dedup: subspace pigeonhole join over rotated vectors, candidates verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_forest, materialize, without

#: Coordinates of a block that make its grid cell.
GRID = 2
#: Rows of a grid cell that one task compares; larger cells are dealt out as pairs of salted tiles.
TILE_ROWS = 16384
TILE = 1024
#: Fixed-point scale: products and sums of the rotation stay below 2^53, so rotated coordinates are the same in every task.
SCALE = 1 << 20


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return np.round(q * np.sign(np.diag(r)) * SCALE)


def blocks_of(d: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def rotate(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of x, rotated; exact integer arithmetic, hence the same for a row whatever stands around it."""
    unit = np.round(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * SCALE)
    return (unit @ turn) / float(SCALE) ** 2


def budgets(d: int, blocks: int, cosine: float) -> np.ndarray:
    """Largest squared distance in each block: the total budget in proportion to dimensions, with slack for the fixed-point error."""
    total = (2 - 2 * cosine) * 1.001 + 1e-4
    return np.array([total * (b - a) / d for a, b in blocks_of(d, blocks)])


def _packed(x: np.ndarray) -> bytes:
    """A size mark (4 or 8) and the components: in single precision where that holds every digit."""
    small = x.astype("<f4")
    return b"\4" + small.tobytes() if (small == x).all() else b"\10" + x.astype("<f8").tobytes()


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def _unpacked(raws: list[bytes], d: int) -> np.ndarray:
    """Rows of doubles."""
    marks = np.array([r[0] for r in raws])
    out = np.empty((len(raws), d))
    for mark in np.unique(marks).tolist():
        own = np.flatnonzero(marks == mark)
        flat = np.frombuffer(b"".join([raws[i] for i in own.tolist()]), np.uint8).reshape(len(own), 1 + d * mark)
        out[own] = np.ascontiguousarray(flat[:, 1:]).view(f"<f{mark}")
    return out


def _vectors(batches, id_col: str, vec_col: str):
    """(id, raw): the vector divided by a power of two so that its largest component is about one (its square can neither overflow nor
    vanish, and no digit changes), packed; null where it can link with nothing."""
    for b in batches:
        raw = []
        for v in b.column(vec_col).to_pylist():
            x = None if not v or any(y is None for y in v) else np.array(v, "<f8")
            raw.append(None if x is None or not np.isfinite(x).all() or not x.any() else _packed(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))))
        yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(raw, pa.binary())], names=["id", "raw"])


def _cells(batches, blocks: int, cosine: float):
    """For each vector and block its home row and the guest rows of half of the neighbouring cells."""
    half = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if GRID == 2 else None
    for b in batches:
        rows = {}
        for i, r in enumerate(b.column("raw").to_pylist()):
            rows.setdefault(_length(r), []).append((i, r))
        for d, own in rows.items():
            y = rotate(_unpacked([r for _, r in own], d), rotation(d))
            at, limit = pa.array([i for i, _ in own]), budgets(d, blocks, cosine)
            for k, (lo, hi) in enumerate(blocks_of(d, blocks)):
                side = np.sqrt(limit[k])
                cell = np.floor(y[:, [lo, min(lo + 1, hi - 1)]] / side).astype(np.int64)
                for g, (u, v) in enumerate(half):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, k, np.int64)), pa.array(cell[:, 0] + u), pa.array(cell[:, 1] + v), pa.array(np.full(n, int(g > 0), np.int64)), b.column("cls").take(at), b.column("n").take(at), b.column("raw").take(at)], names=["d", "k", "u", "v", "guest", "cls", "n", "raw"])


def _compare(t: pa.Table, blocks: int, cosine: float) -> pa.Table:
    """Verified links of one cell (or pair of its tiles): a pair counts in the first block that admits it, so in one place."""
    d, k = t.column("d")[0].as_py(), t.column("k")[0].as_py()
    p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
    x = _unpacked(t.column("raw").to_pylist(), d)
    cls, n, guest, tile = (t.column(c).to_numpy() for c in ("cls", "n", "guest", "t"))
    y, limit, span = rotate(x, rotation(d)), budgets(d, blocks, cosine), blocks_of(d, blocks)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    lo, hi = span[k]
    order = np.argsort(y[:, min(lo + 2, hi - 1)], kind="stable")  # tiles sorted by a further coordinate of the block
    x, y, cls, n, guest, tile, norm = (a[order] for a in (x, y, cls, n, guest, tile, norm))
    home = np.flatnonzero(guest == 0)
    yb, third = y[:, lo:hi].astype(np.float32), y[:, min(lo + 2, hi - 1)]
    sq, one = np.einsum("ij,ij->i", yb, yb)[:, None], np.ones((len(yb), 1), np.float32)
    near, other = np.concatenate([-2 * yb, sq, one], axis=1), np.ascontiguousarray(np.concatenate([yb, one, sq], axis=1).T)
    left, right = [], []
    for i in range(0, len(home), TILE):
        a = home[i : i + TILE]
        for j in range(0, len(x), TILE):
            b = slice(j, min(j + TILE, len(x)))
            if third[b.start] - third[a[-1]] > np.sqrt(limit[k]) or third[a[0]] - third[b.stop - 1] > np.sqrt(limit[k]):
                continue
            hit = np.flatnonzero((near[a] @ other[:, b]).ravel() <= np.float32(limit[k] + 1e-5))
            r, s = hit // (b.stop - j), hit % (b.stop - j)
            if len(r):
                r, s = a[r], s + j
                keep = ((guest[s] == 1) | (r < s)) & ((tile[r] != tile[s]) | (p == q))
                left.append(r[keep])
                right.append(s[keep])
    out = {"a": [], "b": [], "links": []}
    if left:
        r, s = np.concatenate(left), np.concatenate(right)
        for c in range(0, len(r), 1 << 16):
            u, v = r[c : c + (1 << 16)], s[c : c + (1 << 16)]
            gap = (y[u] - y[v]) ** 2
            fits = np.stack([gap[:, i:j].sum(axis=1) <= limit[m] for m, (i, j) in enumerate(span)], axis=1)
            ok = fits[:, k] & (fits.argmax(axis=1) == k)
            u, v = u[ok], v[ok]
            ok = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
            u, v = u[ok], v[ok]
            if len(u):
                out["a"].append(np.concatenate([cls[u], cls[v]]))
                out["b"].append(np.concatenate([cls[v], cls[u]]))
                out["links"].append(np.concatenate([n[v], n[u]]))
    if not out["a"]:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    a, b, links = (np.concatenate(out[c]) for c in ("a", "b", "links"))
    ids, inv = np.unique(a, return_inverse=True)
    node, root = local_forest(a, b)
    return pa.table({"a": np.concatenate([ids, node]), "b": np.concatenate([ids, root]), "links": np.concatenate([np.bincount(inv, weights=links).astype(np.int64), np.zeros(len(node), np.int64)])})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, blocks: int = 4) -> DataFrame:
    """vectors (without the vector) with n_links, component_id and kept (id = component_id), linking pairs of cosine >= `cosine`.

    If |u - v|^2 of unit vectors is within a budget, then in one of the blocks of the rotated coordinates it is within that
    block's share. For each block rows meet in grid cells (side: the block's radius) with half of the neighbouring cells;
    candidates are verified in double precision on the original components. Equal vectors are one class with a count, found
    before the join; pairs are counted where they are found and never written. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing: n_links 0, their own component. Ids are integers; rows that repeat an id count each.
    """
    rest = without(vectors, "n_links", "component_id", "kept", "raw", "id")
    parsed = materialize(rest.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(lambda it: _vectors(it, "id", vec_col), "id long, raw binary"), "vectors")
    known = parsed.where("raw is not null").groupBy("raw").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("cls", F.xxhash64("raw"))
    known = materialize(known, "classes")
    cells = known.select("cls", "n", "raw").mapInArrow(lambda it: _cells(it, blocks, cosine), "d long, k long, u long, v long, guest long, cls long, n long, raw binary")
    key = ["d", "k", "u", "v"]
    hot = known.select("cls", "n", "raw").mapInArrow(lambda it: _only_keys(_cells(it, blocks, cosine)), "d long, k long, u long, v long").groupBy(*key).count().where(F.col("count") > TILE_ROWS).select(*key, F.ceil(F.col("count") / TILE_ROWS).cast("long").alias("g"))
    cells = cells.join(hot, key, "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("t", F.pmod("cls", "g"))
    cells = cells.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("p", F.least("t", "s")).withColumn("q", F.greatest("t", "s"))
    links = materialize(cells.groupBy(*key, "p", "q").applyInArrow(lambda t: _compare(t, blocks, cosine), "a long, b long, links long"), "links")
    roots = connected_components(links.where("a <> b").select("a", "b"))
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    state = known.join(counts, "cls", "left").join(roots, known.cls == roots.node, "left").select("raw", "least", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = state.join(state.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("raw", "n_links", "component_id")
    out = parsed.join(named, "raw", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _only_keys(batches):
    for b in batches:
        yield b.select(["d", "k", "u", "v"])
