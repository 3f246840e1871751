"""The pipeline's stages against brute force over the same input, rows with null ids and repeated rows included."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from fespan.llm import langid
from fespan.llm.common import materialize

from .test_operators import DOCS, WORD, classes, fingerprint, made
from .test_overlap import removed

LANGS = {"en": "the and of to in that was with", "fr": "le la des et une dans pour que", "de": "der die und das nicht ein mit von"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def clean(text, bench):
    """Whether fewer than a twentieth of the words lie in windows of benchmark texts."""
    wins = {tuple(w[k : k + 13]) for b in bench for w in [words(b)] if w for k in range(max(1, len(w) - 12))}
    w, hit = words(text), set()
    for k in {len(x) for x in wins}:
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
    return not (hit and 20 * len(hit) >= len(w))


def targets(size):
    """Weights 1, 2, 3 over the sources by code point, null last, capped at three times a source's size."""
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, fixed, open_ = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}, {}, set(names)
    while open_:
        rest = sum(size.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    return fixed


def test_stages(spark, tmp_path):
    rows = [(r[0], r[1] and " ".join(LANGS["fr" if (r[0] or 0) % 3 else "de"].split() * 3) + " " + r[1], ["fr", "de"][(r[0] or 0) % 3 == 0], r[3], r[4]) for r in made(seed=21)]
    rows += [(5000, "123 456", "en", "a", 7), (5001, None, None, "b", None), (None, LANGS["fr"] * 4 + " une phrase sans nom", None, None, None), rows[8]]
    kind = ", ".join(DOCS.split(", ")[:5])
    docs = spark.createDataFrame(rows, kind).repartition(3)
    bench = [" ".join(rows[3][1].split()[40:60]), "lonely text", " ".join(rows[13][1].split()[60:90])]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.fit(docs)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        after = [tuple(r) for r in docs.collect()]
        seen.append(len(after))
        if name != "mix":
            assert docs.columns == COLUMNS
        if name == "language":
            want = langid.identify(spark.createDataFrame(before, kind), model).where("not rejected").select(*COLUMNS)
            assert Counter(after) == Counter(map(tuple, want.collect())) and 5000 not in {r[0] for r in after} and None in {r[0] for r in after}
        elif name == "simhash":
            fps = [fingerprint(r[1]) for r in before]
            cl = classes(len(before), [(a, b) for a in range(len(before)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
            groups = defaultdict(list)
            for c, r in zip(cl, before, strict=True):
                groups[c].append(r)
            least = [min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()]
            assert Counter(r[0] for r in after) == Counter(least) and set(after) <= set(before)
        elif name == "suffix_array":
            gone = Counter((r[0], r[2] == 0 or r[4]) for r in removed(before, 50, lambda t: list(t.encode())))
            assert Counter(r[0] for r in after) == Counter(r[0] for r in before) and any(k[1] is not True for k in gone)
            same = Counter((str(r[0]), hashlib.sha256(r[1].encode()).hexdigest()) for r in before)
            sure = {(i, digest) for i, digest in gone if digest is not True}
            for r in after:
                digest = hashlib.sha256(r[1].encode()).hexdigest()
                if (str(r[0]), digest) not in same and (str(r[0]), digest) not in sure:  # only where a character lost some of its bytes
                    assert any(abs(len(r[1].encode()) - (x[1] - x[2])) < 8 for x in removed(before, 50, lambda t: list(t.encode())) if x[0] == str(r[0]))
                assert r[4] == len(r[1]) or (str(r[0]), digest) in same
        elif name == "decontaminate":
            assert Counter(after) == Counter(r for r in before if clean(r[1], bench)) and len(after) < len(before)
        else:
            size = Counter()
            for r in before:
                size[r[3]] += len(WORD.findall(r[1] or ""))
            want, taken = targets(size), Counter()
            assert Counter((r[0], r[1], r[2]) for r in after) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in before)
            for _, source, n, whole, target, took in after:
                assert whole == size[source] and abs(target - want[source]) < 1e-6 * sum(size.values()) and 0 <= took <= 3 * n and (n == 0 or took % n == 0)
                taken[source] += took
            assert all(abs(taken[s] - want[s]) <= max(r[2] for r in after if r[1] == s) for s in size)
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
