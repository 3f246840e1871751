"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy, with calibrated rejection."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, text_bytes, without

#: Subwords are runs of 2, 3 and 4 bytes of the lower-cased text with a space before and after it.
SIZES = (2, 3, 4)
BUCKET_BITS = 15
DIM = 16
#: Bounds of the training sample: rows in all, rows of each language that are taken first, and about as many bytes of a text.
SAMPLE_ROWS = 4000
LANG_ROWS = 200
SAMPLE_TEXT_BYTES = 16_000
SLICE = 1 << 20
LATIN = re.compile(r"[A-Za-z]")
NONE = "und"


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (len(SIZES) << BUCKET_BITS, langs): embedding times softmax weights, for each subword bucket
    bias: np.ndarray
    temperature: float
    threshold: float


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every text, and where each text begins."""
    padded = [b" " + t.lower() + b"   " for t in texts]
    buf = np.frombuffer(b"".join(padded) + b"   ", np.uint8).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in padded])])
    n = len(buf) - 3
    gram, cols = buf[:n] | (buf[1 : n + 1] << np.uint32(8)), []
    for k, size in enumerate(SIZES):
        if size > 2:
            gram = gram | (buf[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1)))
        x = (gram ^ np.uint32(0x9E37 * size)) * np.uint32(2654435761)
        cols.append((((x ^ (x >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS))
    return np.stack(cols, axis=1), begin[:-1]


def _raw_scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Mean over the subwords of each text of their rows of table."""
    idx, begin = _features(texts)
    total = table[idx[:, 0]]
    for k in range(1, idx.shape[1]):
        total += table[idx[:, k]]
    sums = np.add.reduceat(total, begin, axis=0, dtype=np.float64)
    sizes = np.diff(np.append(begin, len(idx)))
    return sums / (sizes * idx.shape[1])[:, None]


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 8.0, seed: int = 7, accept: float = 0.999) -> Model:
    """Fit on (text, lang). Every fifth row is kept for calibration: the temperature minimises its log loss, and the rejection
    threshold is the score that a share `accept` of its right predictions reach (at most 0.5)."""
    langs = sorted({lang for _, lang in rows})
    y = np.array([langs.index(lang) for _, lang in rows], np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (len(SIZES) << BUCKET_BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    bags = [np.unique(_features([t.encode("utf-8", "surrogatepass")])[0].ravel(), return_counts=True) for t, _ in rows]
    fit = [i for i in range(len(rows)) if i % 5] or list(range(len(rows)))
    hold = [i for i in range(len(rows)) if i % 5 == 0]
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, cnt = bags[i]
            share = (cnt / cnt.sum()).astype(np.float32)
            x = share @ emb[ids]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - done / steps) * 0.05
            grad = w @ p
            w -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            emb[ids] -= lr * 20 * share[:, None] * grad
            done += 1
    table = (emb @ w).astype(np.float32)
    z = np.stack([(cnt / cnt.sum()) @ table[ids] for ids, cnt in (bags[i] for i in hold)]) + bias if hold else np.zeros((0, len(langs)))
    best = (np.inf, 1.0)
    for temp in np.geomspace(0.05, 20, 60):
        s = z / temp
        s = s - s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(hold)), y[hold]] - np.log(np.exp(s).sum(axis=1))).mean() if hold else 0.0
        best = min(best, (float(loss), float(temp)))
    p = _softmax(z / best[1])
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[hold]]) if hold else np.zeros(0)
    threshold = min(0.5, float(right[int((1 - accept) * len(right))])) if len(right) else 0.0
    return Model(langs, table, bias, best[1], threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, lang_rows: int = LANG_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model | None:
    """Train on a sample of the rows with a text and a language: the `rows` rows of least hashed (id, text), or nearly as many, and of
    every language at least the first `lang_rows` rows (`rows` / languages if that is less, all if it has fewer). A text serves with
    its first characters, `text_bytes` bytes at most. Shares are cut by hash value, for each language, so only the sample reaches
    the driver, whatever the partitions."""
    ok = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(11)).alias("h"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in ok.groupBy("lang").count().collect()}
    n = sum(sizes.values())
    if not n:
        return None

    def cut(take: int, have: int) -> int:
        """The hash value under which about `take` of `have` rows lie."""
        return (1 << 63) - 1 if have <= take else int((take / have - 0.5) * 2.0**64)

    least = min(lang_rows, max(1, rows // len(sizes)))
    want = least + int(10 * least**0.5) + 10  # ten deviations more, as a hash cut takes only about the rows asked for
    rare = {k: cut(want, v) for k, v in sizes.items() if v * rows < want * n}
    limit = F.lit(cut(rows, n))
    if rare:
        own = F.create_map(*[F.lit(x) for k, v in rare.items() for x in (k, v)])
        limit = F.greatest(limit, F.coalesce(own[F.col("lang")], limit))
    short = F.when(F.octet_length("text") <= text_bytes, F.col("text")).otherwise(F.substring("text", 1, text_bytes))
    got = sorted(ok.where(F.col("h") <= limit).select("h", short.alias("text"), "lang").dropDuplicates().collect())
    return train(_balanced([(r[0], _clipped(r[1], text_bytes), r[2]) for r in got], rows, least))


def _clipped(text: str, size: int) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= size else raw[:size].decode("utf-8", "ignore")


def _balanced(got: list[tuple[int, str, str]], rows: int, lang_rows: int) -> list[tuple[str, str]]:
    """(text, lang) of the first `rows` rows and of the first `lang_rows` of each language."""
    seen: dict[str, int] = {}
    out = []
    for i, (_, text, lang) in enumerate(got):
        seen[lang] = seen.get(lang, 0) + 1
        if i < rows or seen[lang] <= lang_rows:
            out.append((text, lang))
    return out


def has_letter(text: str) -> bool:
    """Whether a character is a letter; digits, fractions, circled and Roman numerals are none."""
    return LATIN.search(text) is not None or any(map(str.isalpha, text))


def predict(texts: list[str | None], raw: list[bytes], model: Model | None) -> tuple[list[str], np.ndarray]:
    langs, score = [NONE] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
    if rows:
        p = _softmax((_raw_scores([raw[i] for i in rows], model.scores) + model.bias) / model.temperature)
        for i, k, s in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
            langs[i], score[i] = model.langs[k], min(1.0, float(s))
    return langs, score


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", accepted_only: bool = False) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected (no letter, or score under the model's threshold).

    Reads the whole text, in one map-only pass. Null text, empty text and text without a letter give `und` with score 0, rejected;
    so does every row if there is no model (no labelled row). accepted_only: only the rows not rejected, columns unchanged.
    The model (its size is fixed by BUCKET_BITS and the number of languages) is broadcast. Columns named like results are replaced.
    """
    spark = small_batches(docs).sparkSession
    base = docs if accepted_only else without(docs, "lang_pred", "score", "rejected")
    sent = spark.sparkContext.broadcast(model)

    def step(batches):
        m = sent.value
        for b in batches:
            col = b.column(text_col)
            data, off = text_bytes(col)
            raw, langs, score = data.tobytes(), [], np.zeros(b.num_rows)
            for i, j in slices(off, SLICE):
                own = [raw[off[k] : off[k + 1]] for k in range(i, j)]
                got, s = predict([x.as_py() for x in col[i : j]], own, m)
                langs += got
                score[i:j] = s
            bad = np.array([x == NONE for x in langs], bool) | (score < (m.threshold if m else 0))
            if accepted_only:
                yield b.filter(pa.array(~bad))
            else:
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(b.num_columns)], pa.array(langs, pa.string()), pa.array(score), pa.array(bad)], names=[*b.schema.names, "lang_pred", "score", "rejected"])
            give_back()

    from pyspark.sql.types import StructType

    return base.mapInArrow(step, base.schema if accepted_only else StructType([*base.schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields]))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32(id as text) mod 4 is not 2; the others are held out."""
    return docs.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
