"""Passage removal against brute force, and the two indexes against plain sorting."""

import hashlib

import numpy as np
import pytest
from .test_operators import DOCS, WORD, made

from fespan.llm import fmindex, lyndon, overlap, substring, suffixdedup


def removed(rows, window, split):
    """(id, units, removed, spans, sha256) by comparing all windows."""
    units = [split(r[1] or "") for r in rows]
    first = {}
    for r, u in zip(rows, units, strict=True):
        i = overlap.LAST if r[0] is None else r[0]
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for r, u in zip(rows, units, strict=True):
        i, gone = overlap.LAST if r[0] is None else r[0], [False] * len(u)
        for k in range(len(u) - window + 1):
            if first[tuple(u[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        raw = " ".join(kept).encode() if kept and isinstance(kept[0], str) else bytes(kept)
        out.append((str(r[0]), len(u), sum(gone), spans, hashlib.sha256(raw).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_words_and_bytes(spark, monkeypatch, small):
    if small:
        for name, size in (("SHARD_BYTES", 30_000), ("CELL_BYTES", 20_000), ("SLICE", 5_000), ("INDEX_SYMBOLS", 3_000), ("DEAL", 3), ("COMMON_DOCS", 4), ("COMMON_IN_BATCH", 2)):
            monkeypatch.setattr(overlap, name, size)
    rows = made(seed=8) + [(900, "ab " * 300, None, None, None, None, None), (901, "ab " * 200, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.n_spans, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeated_passages(docs).collect()]
    assert sorted(got) == removed(rows, 50, WORD.findall) and sum(g[2] for g in got) > 1000
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeated_bytes(docs).collect()]
    assert sorted(got) == removed(rows, 50, lambda t: list(t.encode()))
    cut = suffixdedup.cut_documents(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_no_rows(spark):
    for rows in ([], [(1, None, None, None, None, None, None)], [(1, "short", None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, DOCS)
        assert substring.remove_repeated_passages(docs).count() == len(rows)
        assert suffixdedup.remove_repeated_bytes(docs).where("n_removed = 0 and n_spans = 0").count() == len(rows)


def test_indexes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        rows, letters = int(rng.integers(1, 40)), int(rng.integers(1, 5))
        texts = [bytes(rng.integers(97, 97 + letters, int(rng.integers(1, 70))).astype(np.uint8)) for _ in range(rows)]
        texts = [(t * 3)[:99] if trial % 3 == 0 else t for t in texts]
        size = np.array([len(t) for t in texts])
        pad = np.zeros((rows, size.max()), np.uint8)
        for i, t in enumerate(texts):
            pad[i, : len(t)] = np.frombuffer(t, np.uint8)
        r, c, _ = lyndon.suffix_order(pad, size)
        assert [texts[i][j:] for i, j in zip(r, c, strict=True)] == sorted(t[j:] for t in texts for j in range(len(t)))
        off, buf, own = np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(texts), np.uint8), rng.integers(0, 30, rows)
        for depth in (50, 9):
            best = {}
            for t, o in zip(texts, own, strict=True):
                for j in range(len(t) - depth + 1):
                    best[t[j : j + depth]] = min(best.get(t[j : j + depth], 99), o)
            m = lyndon.window_minima(buf, off, own, np.zeros(rows, np.int64), depth)
            assert all(m[i, j] == best[t[j : j + depth]] for i, t in enumerate(texts) for j in range(len(t) - depth + 1))
            spaced = [b" ".join(bytes([c]) for c in t) for t in texts]
            at = np.concatenate([[0], np.cumsum([len(t) for t in spaced])])
            m = fmindex.window_minima(np.frombuffer(b"".join(spaced), np.uint8), at, own, np.zeros(rows, np.int64), depth)
            assert all(m[i, j] == best[t[j : j + depth]] for i, t in enumerate(texts) for j in range(len(t) - depth + 1))


def test_matching_statistics():
    """Lengths of the longest matches of streamed texts that the index does not hold, with words it has never seen."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        letters, depth = int(rng.integers(2, 5)), int(rng.integers(3, 20))
        texts = [rng.integers(1, 1 + letters, int(rng.integers(1, 50))) for _ in range(int(rng.integers(1, 9)))]
        owner = rng.integers(0, 9, len(texts))
        index = fmindex.FmIndex(np.concatenate([np.append(t, 0) for t in texts]), np.repeat(owner, [len(t) + 1 for t in texts]), depth)
        streamed = sorted((rng.integers(0, 1 + letters, int(rng.integers(1, 60))) for _ in range(7)), key=len, reverse=True)
        size = np.array([len(t) for t in streamed])
        pad = np.zeros((7, size[0]), np.int64)
        for i, t in enumerate(streamed):
            pad[i, : len(t)] = t
        inside = [{tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)} for k in range(depth + 1)]
        for rows, start, length, least in index.matches(pad, size):
            for r, s, n, o in zip(rows, start, length, least, strict=True):
                t = streamed[r]
                want = max(k for k in range(min(depth, len(t) - s) + 1) if k == 0 or tuple(t[s : s + k]) in inside[k])
                assert n == want
                if n == depth:
                    assert o == min(w for w, x in zip(owner, texts, strict=True) if any(tuple(x[i : i + depth]) == tuple(t[s : s + depth]) for i in range(len(x))))


def test_blobs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 300):
        given = (rng.integers(-9, 9, n), rng.integers(0, 9, n).astype(np.uint32), rng.integers(0, 2**63, n).astype(np.uint64), b"raw" * n)
        got = overlap.unpack(overlap.pack(*given))
        assert all(np.array_equal(a, b) and getattr(a, "dtype", None) == getattr(b, "dtype", None) for a, b in zip(given, got, strict=True))
    assert len(overlap.pack(np.arange(3), np.arange(3))) < 70


def test_letters_that_cancel(spark):
    """Words that differ as Thue-Morse words do have one sum under any odd multiplier; they are different words."""
    first = "a"
    for _ in range(12):
        first += first.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, first + " " + rest), (2, first.translate(str.maketrans("ab", "ba")) + " " + rest), (3, first + " " + rest)]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_limits(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        substring.remove_repeated_passages(docs, window=80, gram=8)
    with pytest.raises(TypeError):
        substring.remove_repeated_passages(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_common_phrase(spark, monkeypatch):
    """A phrase that most documents hold, each time among other words, is no anchor; a whole common passage still goes."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(3000)]
    phrase, passage = "one two three four five six seven eight nine", " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(rng.choice(words, 60)) + f" {phrase} " + " ".join(rng.choice(words, 60)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(300)]
    monkeypatch.setattr(overlap, "COMMON_DOCS", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kind = overlap.Kind(True, 50, 8, fmindex.window_minima)
    work = docs.selectExpr("doc_id as id", "0L as tag", "text")
    monkeypatch.setattr(overlap, "LOW", 1)
    common = overlap.common_grams(work, kind, 1)
    assert 2 <= len(common) <= 60
    buf, off = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    values, uoff, _, _ = overlap.units(kind, buf, off)
    plain, spared = (overlap.runs(values, uoff, k)[0] for k in (kind, overlap.replace(kind, common=common)))
    most = lambda x: np.unique(x, return_counts=True)[1]
    assert np.isin(spared, common).sum() < 0.3 * len(spared) and len(plain) > 1000 and (most(spared) > 100).sum() <= 60
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.n_spans, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeated_passages(docs).collect()]
    assert sorted(got) == removed(rows, 50, WORD.findall)
