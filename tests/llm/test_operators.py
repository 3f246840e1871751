"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fespan.llm import decontaminate, embeddings, langid, licences, mixing, simhash, tokens, urlfilter
from fespan.llm.common import connected_components, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Spans string, SIZE int"


def made(n=120, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéüçABC,.") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    shared = " ".join(rng.choice(vocab) for _ in range(70))
    rows = []
    for i in range(n):
        t = "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", "\u00a0x "]) for _ in range(rng.randint(1, 150)))
        if i % 5 == 0:
            t += shared
        if i % 7 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 11 == 0 and rows:
            t = " ".join((rows[-1][1] or "").split() + ["zz"])
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é"]), len(t), "x", 1))
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, None, 2), (n + 2, " \n ", None, "a", 3, None, 2), (None, "lonely text", "en", "b", 5, None, 2), rows[4], rows[4]]
    rows.append((n + 3, shared + " " + " ".join(rng.choice(vocab) for _ in range(8000)), "en", "b", 1, None, None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontaminate(spark, docs, rows, empty, monkeypatch):
    bench = [(1, " ".join(rows[10][1].split()[:40])), (2, rows[12][1]), (10, "abc"), (3, None), (None, "abc"), (5, ""), (6, rows[1][1][:60].upper())]
    b = spark.createDataFrame(bench, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                wins[tuple(w[k : k + 13])].add(str(i))
    want = []
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    items |= wins[tuple(w[i : i + k])]
        want.append((r[0] if r[0] is not None else -1, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    for size, most, kept in ((256_000, 1 << 20, 3), (60, 1 << 20, 99), (60, 1 << 20, 1), (60, 200, 1)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        monkeypatch.setattr(decontaminate, "KEPT", kept)
        got = decontaminate.decontaminate(docs, b).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got) == sorted(want)
    for r in got:
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    clean = decontaminate.decontaminate(docs, b, only_clean=True)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    odd = docs.withColumnsRenamed({"lang": "_words", "source": "_RANGES", "n_chars": "_items"})
    again = decontaminate.decontaminate(odd, b)
    assert again.columns == [*[c for c in odd.columns if c != "Spans"], *decontaminate.RESULT] and again.where("contaminated").count() == sum(w[-1] for w in want)
    assert decontaminate.decontaminate(empty, b).count() == 0
    assert decontaminate.decontaminate(docs, b.limit(0)).where("contaminated").count() == 0


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("tile_rows", [8192, 5])
def test_simhash(docs, rows, empty, monkeypatch, tile_rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    fps = [fingerprint(r[1]) for r in rows]
    cl = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[cl[i]].append(r[0])
    want = sorted((str(r[0]), f"{fps[i]:016x}", min(least[cl[i]], default=None)) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash(docs).collect())
    assert got == want
    assert simhash.simhash(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}
    assert {r.doc_id for r in simhash.keep_one(docs, null_ids=False).collect()} == {w[2] for w in want if w[2] is not None}


def test_keep_one_rows(spark, rows):
    """Exactly one row of each group: null ids, repeated rows, one id with several texts."""
    mixed = [*rows, (None, "another quite lonely text", "en", "b", 5, None, 2), (None, "another quite lonely text", "en", "b", 5, None, 2), (None, rows[2][1], None, "a", 1, "x", 1)]
    mixed += [(700 + i, f"text number {i} of its own kind {i * i}", "en", "a", 1, "x", 1) for i in range(3)] + [(3, "text number 1 of its own kind 1", "en", "a", 1, "x", 1), (3, "quite some other words here", "fr", "a", 1, "x", 1)]
    fps = [fingerprint(r[1]) for r in mixed]
    cl = classes(len(mixed), [(i, j) for i in range(len(mixed)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    best = {}
    for i, r in enumerate(mixed):
        best.setdefault(cl[i], []).append(r)
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(mixed, DOCS.replace("Spans", "_Key")).repartition(5), null_ids=True).collect()]
    at = {r: cl[i] for i, r in enumerate(mixed)}
    assert sorted(at[r] for r in kept) == sorted(best)
    for r in kept:
        ids = [x[0] for x in best[at[r]] if x[0] is not None]
        assert r[0] == min(ids, default=None)
    assert sum(r[0] is None for r in kept) == 2
    stage = [tuple(r) for r in corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(mixed, DOCS), "").collect()]
    assert sorted(stage, key=str) == sorted(kept, key=str)


def test_simhash_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20)
    fp = np.unique(np.concatenate([base] + [base ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for _ in range(40)]))
    got = connected_components(simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fp], "fp long")))
    links = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= 2]
    cl = classes(len(fp), links)
    want = {(int(fp[i]), int(min(fp[j] for j in range(len(fp)) if cl[j] == cl[i]))) for i in range(len(fp)) if cl.count(cl[i]) > 1}
    assert {(r.node, r.root) for r in got.collect()} == want


def test_language(spark, docs, empty):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_rows(t))
    out = langid.identify(t, model).withColumn("held_out", langid.held_out()).collect()
    assert {r.held_out for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    held = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.02 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --"), (4, "the and of that"), (5, "½²³"), (6, "Ⅷ ① ٣"), (7, "é")], "doc_id long, text string")
    got = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "und", "und"] and got[6].lang_pred != "und" and got[4].score == 0
    assert langid.identify(docs, None, accepted_only=True).count() == 0
    assert langid.fit(empty) is None and langid.identify(empty, model).count() == 0


def test_language_sample(spark):
    """A rare language and one with long texts only are learned; the sample stays bounded."""
    words = {"en": "the and of to in that was with", "fr": "le la des et une dans pour que", "de": "der die und das nicht ein mit von", "pl": "jest nie się że na do był przez"}
    rng = random.Random(4)

    def text(lang, n):
        return " ".join(rng.choice(words[lang].split()) for _ in range(n))

    rows = [(i, text("en" if i % 2 else "fr", 20), "en" if i % 2 else "fr") for i in range(3000)] + [(3000 + i, text("pl", 20), "pl") for i in range(6)] + [(4000 + i, text("de", 5000), "de") for i in range(30)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "train", lambda got, real=langid.train: seen.append(got) or real(got))
        model = langid.fit(t, rows=200, lang_rows=25, text_bytes=2000)
    count = Counter(lang for _, lang in seen[0])
    assert model.langs == ["de", "en", "fr", "pl"] and count["pl"] == 6 and count["de"] >= 25 and 150 < len(seen[0]) < 260
    assert max(len(x.encode()) for x, _ in seen[0]) <= 2000
    only = langid.fit(t.where("lang = 'de'"))
    assert only is not None and only.langs == ["de"]
    odd = spark.createDataFrame([(1, text("pl", 40)), (2, text("de", 40))], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, langid.fit(t)).orderBy("doc_id").collect()][1] == "de"


@pytest.mark.parametrize("tile_rows", [16384, 7])
def test_embeddings(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(2)
    vecs = []
    for _ in range(12):
        c = rng.normal(size=24)
        vecs += [c * rng.uniform(0.5, 2)] + [c + rng.normal(size=24) * 0.22 for _ in range(6)]
    vecs = [v.astype(np.float32).tolist() for v in vecs]
    vecs += [[1e-30] * 24, [2e-30] * 24, [1e30] * 24, [3e38] + [0.0] * 23, [1e-42] + [0.0] * 23]  # tiny and huge ones link like any other
    vecs += [vecs[0], vecs[0], vecs[20], [0.0] * 24, None, [], [1.0, None], [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    ids = [int(x) for x in rng.permutation(len(vecs) + 5)[: len(vecs)]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame([(i, v, 3, "x") for i, v in zip(ids, vecs, strict=True)], "vec_id long, embedding array<float>, label int, kept string")).collect()}
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    links = []
    for i in range(len(vecs)):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                    links.append((i, j))
    assert len(links) > 50
    n, cl = Counter(x for p in links for x in p), classes(len(vecs), links)
    for i, v in enumerate(ids):
        least = min(ids[j] for j in range(len(ids)) if cl[j] == cl[i])
        assert got[v] == (n[i], least, v == least)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    far = spark.createDataFrame([(1, [1e-200] * 4), (2, [1e-200] * 4), (3, [1e200] * 4), (4, [5e-324, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.n_links, r.component_id) for r in embeddings.near_vectors(far).orderBy("vec_id").collect()] == [(2, 1), (2, 1), (2, 1), (0, 4)]


def test_mixing(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(size.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * total and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)
    assert mixing.mix(empty).count() == 0


def test_mixing_expectation(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    mean = np.mean([[r.taken / r.size for r in mixing.mix(docs, seed=s).orderBy("doc_id").collect()] for s in (1, 50, 99)])
    assert abs(mean - 1) < 0.1


def test_licences(spark, docs, empty):
    mit = licences.KNOWN[0][1]
    t = spark.createDataFrame([(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;")), (2, mit[:-20]), (3, "words\nReleased under the MIT Licence!\nmore"), (4, None), (5, ""), (3, "words\nReleased under the MIT Licence!\nmore")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.notices) for r in licences.scan(t).collect())
    assert got == sorted([(1, "MIT", ""), (2, None, ""), (3, None, "MIT"), (3, None, "MIT"), (4, None, ""), (5, None, "")], key=str)
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0
    # any known texts: lines that do not speak of a licence, and equal words side by side
    known = licences.known_digests(spark, [("PD", "Public domain."), ("X", "centre licence licence licence")])
    t = spark.createDataFrame([(1, "code\npublic   DOMAIN\nmore"), (2, "Center, license; license: LICENCE"), (3, "nothing"), (None, "public domain")], "doc_id long, text string")
    for k in (known, known.drop("first")):
        assert {(r.doc_id, r.license, r.notices) for r in licences.scan(t, k).collect()} == {(1, None, "PD"), (2, "X", "X"), (3, None, ""), (None, "PD", "PD")}


def canonical(text):
    """The canonical form by plain string steps."""
    out = []
    for line in text.split("\n"):
        bare = line.lstrip(" \t#*;%/!|>-")
        low = bare.lower()
        if re.match(r"copyright[ \t]+(\(c\)|©|(19|20)\d\d\b)", low) or re.match(r"all rights reserved[ .!\t]*$", low) or bare.startswith("©"):
            continue
        out += re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spelt = dict(licences.SPELLINGS)
    return " ".join(spelt.get(w, w) for w in out)


def test_licences_brute_force(spark):
    """Random files from a small vocabulary, notices among them, against string steps and a dictionary."""
    rng = random.Random(9)
    vocab = ["the", "licence", "license", "Centre", "centre", "labour", "copyright", "notice", "é", "(a)", "1.", "whilst,", "use--of"]
    notices = ["Copyright (c) 2020 A B", "# Copyright 1999 X", "All rights reserved.", "© me", "copyright notice and more"]

    def made_text():
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 3))]
        return "\n".join(line if rng.random() < 0.7 else rng.choice(notices) for line in lines)

    known = {}
    for i in range(30):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 3)))
        if canonical(t):
            known.setdefault(canonical(t), (f"L{i % 7}", t))
    rows = [(i, made_text()) for i in range(400)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_digests(spark, list(known.values()))).collect()}
    names = {c: n for c, (n, _) in known.items()}
    assert sum(r.license is not None for r in got.values()) > 20
    for i, t in rows:
        assert got[i].digest == hashlib.sha256(canonical(t).encode()).hexdigest()
        assert got[i].license == names.get(canonical(t)) and got[i].notices == ",".join(sorted({names[canonical(x)] for x in t.split("\n") if canonical(x) in names}))


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "https://B.Example.NET/x", "http://example.com/de/", "http://sub.example.com/de/x?y=1#z", "ftp://org/fr/", "http://xorg/fr/", "http://y.org/fr", None, "no scheme", "http://net", "a://b://c/d", ""]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, none).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("b.example.net", "/x", "net/", "block"), 2: ("example.com", "/de/", "example.com/de/", "block"), 3: ("sub.example.com", "/de/x", "example.com/de/", "block"),
        4: ("org", "/fr/", "org/fr/", "allow"), 5: ("xorg", "/fr/", None, "allow"), 6: ("y.org", "/fr", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("", "", None, "allow"),
    }
    many = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.host{i % 3}.test/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)] + [(None, 1), (5, None)], "id long, bad int")
    got = urlfilter.filter_urls(many, labels).collect()
    assert {r.verdict for r in got if r.host.startswith("bad")} == {"block"} and {r.verdict for r in got if r.host.startswith("good")} == {"allow"}
    clash = many.selectExpr("*", "1 as bound", "2 as _sure", "3 as _rule", "4 as domain", "5 as SUFFIX", "6 as VERDICT")
    out = urlfilter.filter_urls(clash, labels, rules=())
    assert out.columns == ["page_id", "url", "bound", "_sure", "_rule", "domain", "SUFFIX", "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.verdict, r.rule) for r in out.collect()} == {(r.page_id, r.verdict, None) for r in got}
    parts = urlfilter.with_parts(spark.createDataFrame([("http://a.b.co.uk/x",), ("http://co.uk",), ("http://a.b.c.de",), ("http://localhost/",)], "url string")).collect()
    assert [(r.domain, r.suffix) for r in parts] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("c.de", "de"), ("localhost", "localhost")]


def test_beta():
    rng = np.random.default_rng(1)
    # the density's sum over midpoints where it is broad; symmetry where it is narrow
    grid = (np.arange(400_000) + 0.5) / 400_000
    for _ in range(40):
        a, b, x = rng.uniform(1, 8), rng.uniform(1, 20), float(rng.uniform(0.02, 0.98))
        density = grid ** (a - 1) * (1 - grid) ** (b - 1)
        assert abs(float(urlfilter.beta_cdf(x, a, b)) - density[grid <= x].sum() / density.sum()) < 1e-4
        a, b = rng.uniform(0.05, 60), rng.uniform(0.05, 900)
        assert abs(float(urlfilter.beta_cdf(x, a, b)) + float(urlfilter.beta_cdf(1 - x, b, a)) - 1) < 1e-9
    assert np.allclose(urlfilter.log_gamma(np.array([0.5, 1, 5, 100.0])), [0.5 * np.log(np.pi), 0, np.log(24), 359.1342053695754])


def test_reputation(spark):
    """Posterior means and bounds recomputed by plain loops, and the bound by draws."""
    rng = random.Random(6)
    counts = []
    for d in range(40):
        for h in range(rng.randint(1, 4)):
            n = rng.randint(0, 30)
            counts.append((f"h{h}.d{d}.s{d % 3}", f"d{d}.s{d % 3}", f"s{d % 3}", n, sum(rng.random() < (0.05 + 0.2 * (d % 3)) for _ in range(n))))
    got = {r.host: r for r in urlfilter.reputation(spark.createDataFrame(counts, "host string, domain string, suffix string, n long, bad long")).collect()}

    def level(key, up, above):
        rows = defaultdict(lambda: [0, 0, None])
        for c in counts:
            rows[c[key]][0] += c[3]
            rows[c[key]][1] += c[4]
            rows[c[key]][2] = above[c[up]] if up is not None else above
        noise = sum(n * p * (1 - p) for n, _, p in rows.values())
        extra = sum((b - n * p) ** 2 - n * p * (1 - p) for n, b, p in rows.values())
        pairs, total = sum(n * (n - 1) for n, _, _ in rows.values()), sum(n for n, _, _ in rows.values())
        m = urlfilter.MOST if extra <= 0 else round(min(urlfilter.MOST, max(urlfilter.LEAST, noise / total / (extra / pairs) - 1)), 6)
        return {k: (b + m * p) / (n + m) for k, (n, b, p) in rows.items()}, rows, m

    top = (sum(c[4] for c in counts) + urlfilter.PRIOR * urlfilter.TOP) / (sum(c[3] for c in counts) + urlfilter.TOP)
    suffix, _, _ = level(2, None, top)
    domain, _, _ = level(1, 2, suffix)
    host, rows, m = level(0, 1, domain)
    draws = np.random.default_rng(0)
    for k, mean in host.items():
        n, b, p = rows[k]
        assert abs(got[k]["mean"] - mean) < 1e-9
        assert abs(got[k].sure - (draws.beta(b + m * p, n - b + m * (1 - p), 20_000) > urlfilter.BAD).mean()) < 0.02


def test_tokens(spark, docs, rows, tmp_path):
    counted = tokens.count_tokens(docs).select("doc_id", "source", "lang", "version", "tokens")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        want[r[3], r[2]][0] += 1
        want[r[3], r[2]][1] += len(enc.encode_ordinary(r[1] or ""))
    roll = tokens.TokenRollup(spark, f"{shared_dir(spark)}/roll-test")
    assert roll.totals().count() == 0
    assert roll.commit("b1", tokens.inserts(counted)) and not roll.commit("b1", tokens.inserts(counted))
    get = lambda: {(r.source, r.lang): [r.docs, r.tokens] for r in roll.totals().collect()}
    assert get() == want
    a = counted.where("source = 'a'")
    assert roll.commit("b2", tokens.revisions(a.withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.col("tokens") + 2)), tokens.deletes(counted.where("source is null")))
    left = {k: [v[0], v[1] + 2 * v[0] * (k[0] == "a")] for k, v in want.items() if k[0] is not None}
    assert get() == left and roll.batches() == ["b1", "b2"]
    # a batch that stopped before its marker does not count, and can be tried again; compaction changes no total
    roll._fs.delete(roll._path(f"{roll.path}/batch=b2/_SUCCESS"), False)
    assert roll.batches() == ["b1"] and get() == want
    assert roll.commit("b2", tokens.revisions(a.withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.col("tokens") + 2)), tokens.deletes(counted.where("source is null")))
    for more in ("b3", "b4"):
        roll.compact()
        assert get() == left and not roll.commit("b1", tokens.inserts(counted)) and not roll.commit("b2", tokens.inserts(counted))
        assert roll.commit(more, tokens.inserts(a)) and roll.commit(f"{more}-back", tokens.deletes(a)) and get() == left
    assert roll.batches() == ["b1", "b2", "b3", "b3-back", "b4", "b4-back"] and len(roll._folders("batch=")) == 2 and len(roll._folders("base=")) == 1
    odd = tokens.count_tokens(docs.withColumnsRenamed({"lang": "Tokens", "source": "VERSION"}))
    assert odd.columns == ["doc_id", "n_chars", "Spans", "SIZE", "tokens", "version"] and odd.count() == len(rows)


def test_licences_standard_files(spark):
    """Whole licence files, with and without title, notices, comment marks, numbers, at several line widths."""
    body = {n: t for n, t in licences.KNOWN[:2]}["MIT"]
    wrapped = body.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("The above copyright", "The above\ncopyright")
    mit = [
        "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + body, "The MIT License (MIT)\n\nCopyright 2019-2020 A. Body <a@b.c>\nAll rights reserved.\n\n" + wrapped, wrapped,
        "# Copyright The Example Authors\n#\n" + "\n".join("# " + x for x in wrapped.split("\n")), "/*\n * © Somebody\n * (c) 2020 Somebody else\n */\n" + body,
    ]
    want = [("MIT", t) for t in mit]
    for f in sorted((Path(licences.__file__).parent / "licence_texts").iterdir()):
        name, text = f.name.removesuffix(".txt").split("~")[0], f.read_text()
        want += [(name, text), (name, text.strip().partition("\n\n")[2]), (name, text.replace("https://", "http://"))]
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "MPL-2.0"):
            want += [(name, "\n\n".join(p if "[yyyy]" in p else textwrap.fill(p, w, break_long_words=False) for p in re.split(r"\n\s*\n", text))) for w in (30, 41, 60, 72)]
        if name.startswith("BSD"):
            want.append((name, "BSD License\n\nCopyright (c) 2001, A\n" + re.sub(r"(?m)^[0-9]\. ", "* ", text.partition("\n\n")[2])))
        if "END OF TERMS" in text:
            want += [(name, text[: text.index("END OF TERMS")]), (name, text[: text.index("END OF TERMS")] + "END OF TERMS AND CONDITIONS\n")]
    assert {n for n, _ in want} >= {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "Apache-2.0", "MIT", "ISC"}
    want += [(None, "Copyright law protects it"), (None, wrapped.replace("COPYRIGHT HOLDERS BE", "COPYRIGHT HOLDERS NOT BE"))]
    t = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scan(t).collect()}
    assert [(i, got[i]) for i in sorted(got)] == [(i, n) for i, (n, _) in enumerate(want)]
