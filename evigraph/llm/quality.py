"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios (NB-SVM).

Indicators are byte 1- to 3-grams and n-grams of word shapes (upper case, lower case, digits, signs, a repeat of the word before),
hashed to ``BUCKETS``. The ratios come from counts over all labelled training rows; the hinge loss is minimised by dual
coordinate descent on the driver over a bounded sample of them (``max_rows``), and a held-back fifth of the sample calibrates the
margin to a probability. Scoring is one pass over whole texts with four small arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.common import IS_SPACE, fresh, keyed, keyed_at, mix, tidy, utf8_of, word_spans
from evigraph.llm.ngram import remainder

BITS = 16
BUCKETS = 1 << BITS
#: Labelled rows whose texts' features may come to the driver, at most; half of it for each label.
MAX_ROWS = 8000
#: Bytes of a text that are taken at a time; a longer text is cut at white space, with what n-grams across the cut need.
PART = 1 << 22
_MUL = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_KIND = np.zeros(256, np.uint8)  # bits of a word's shape
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 16


def byte_grams(data: np.ndarray) -> list[np.ndarray]:
    """The buckets of the 1- to 3-grams of bytes, an array for each length."""
    n = len(data)
    wide = data.astype(np.uint32) + np.uint32(1)
    out, h = [], np.zeros(n, np.uint32)
    for k in range(3):
        if n <= k:
            break
        h = (h[: n - k] + wide[k:]) * _MUL[k]
        out.append((h ^ h >> np.uint32(13)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS))
        h = h[: n - k - 1] if n > k + 1 else h
    return out


def word_grams(data: np.ndarray, known: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """(buckets of the n-grams of word shapes that end behind the first ``known`` words, starts of all words)."""
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    out: list[np.ndarray] = []
    if len(s):
        kind = _KIND[data]
        first, last = kind[s], kind[e - 1]
        any_of = np.bitwise_or.reduceat(kind, s)
        size = np.minimum(e - s, 15)
        rep = np.zeros(len(s), np.uint8)
        if len(s) > 1:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64)))])
            key = (total[e] - total[s]) * np.uint64(31) + (e - s).astype(np.uint64)
            rep[1:] = key[1:] == key[:-1]
        shape = (any_of.astype(np.uint32) << 16 | first.astype(np.uint32) << 8 | last.astype(np.uint32) << 1 | rep).astype(np.uint32)
        h = np.zeros(len(s), np.uint32)
        for k in range(3):
            if len(s) <= k:
                break
            h = (h[: len(s) - k] + shape[k:] + np.uint32(77 + k)) * _MUL[k]
            out.append(((h ^ h >> np.uint32(15)) * np.uint32(0x165667B1) >> np.uint32(32 - BITS))[max(0, known - k) :])
            h = h[: len(s) - k - 1] if len(s) > k + 1 else h
        out.append(((rep.astype(np.uint32) * np.uint32(16) + size.astype(np.uint32) + np.uint32(991)) * np.uint32(0x2545F491) >> np.uint32(32 - BITS))[known:])
    return out, s


def features(data: np.ndarray) -> np.ndarray:
    """The buckets of all n-grams of one text, repeats included."""
    return np.concatenate([np.empty(0, np.int64), *byte_grams(data), *word_grams(data)[0]]).astype(np.int64)


def features_by_parts(data: np.ndarray, part: int = PART) -> np.ndarray:
    """The distinct buckets of :func:`features`, with memory for about ``part`` bytes; a longer word is taken whole.

    The two bytes behind a part belong to it, too, and the three words before it are known: a shape tells whether the word
    repeats the one before, and an n-gram has three.
    """
    seen = np.zeros(BUCKETS, bool)
    for a in range(0, len(data), part):
        for x in byte_grams(data[a : a + part + 2]):
            seen[x] = True
    a = start = known = 0
    while a < len(data):
        gaps = np.flatnonzero(IS_SPACE[data[a : a + part]])
        b = a + part
        if b < len(data):
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < len(data) and not (gaps := np.flatnonzero(IS_SPACE[data[b : b + part]])).size:
                    b += part
                b = b + int(gaps[0]) + 1 if gaps.size else len(data)
        found, words = word_grams(data[start:b], known)
        for x in found:
            seen[x] = True
        known = min(3, len(words))
        start, a = (start + int(words[-known]) if known else b), b
    return np.flatnonzero(seen)


class Indicators:
    """Distinct buckets of a text without sorting."""

    def __init__(self):
        self.stamp = np.zeros(BUCKETS, np.int64)

    def of(self, data: np.ndarray, most: int = PART) -> np.ndarray:
        if len(data) > most:
            return features_by_parts(data, most)
        idx = features(data)
        at = np.arange(len(idx))
        self.stamp[idx] = at
        return idx[self.stamp[idx] == at]


def _texts(batch, column: int):
    data, offsets = utf8_of(batch.column(column))
    for k in range(len(offsets) - 1):
        yield k, data[offsets[k] : offsets[k + 1]]


def _labels(batch, store) -> np.ndarray:
    """The label of each row (doc_id mixed to a key in column 0), -1 for rows without one."""
    return keyed(*store).of(batch.column(0).to_numpy(zero_copy_only=False), -1.0).astype(np.int64)


def _counted(store):
    """How many texts of each label have each bucket, summed over a task."""

    def run(batches):
        import pyarrow as pa

        ind, counts, docs = Indicators(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = _labels(batch, store)
            for k, data in _texts(batch, 1):
                if label[k] >= 0:
                    counts[label[k], ind.of(data)] += 1
                    docs[label[k]] += 1
        idx = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1), pa.int64()), *(pa.array(np.append(counts[y][idx], docs[y]), pa.int64()) for y in (0, 1))], names=["idx", "n0", "n1"])

    return run


def _featured(store, under: tuple[int, int]):
    """Label, pick and buckets of the labelled texts whose pick is under their label's bound."""

    def run(batches):
        import pyarrow as pa

        ind = Indicators()
        for batch in batches:
            label, pick, rows = _labels(batch, store), batch.column(2).to_numpy(zero_copy_only=False), []
            for k, data in _texts(batch, 1):
                if label[k] >= 0 and pick[k] < under[label[k]]:
                    rows.append((int(label[k]), int(pick[k]), np.sort(ind.of(data)).astype(np.uint16).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["label", "pick", "features"])

    return run


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 15, seed: int = 1) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum cost * hinge, by dual coordinate descent; the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i], values[i]
            g = y[i] * (w[idx] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                w[-1] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(a, b) of a weighted logistic fit of label on margin, with a slight pull to a = 1."""
    t = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 0.1 * np.array([t[0] - 1.0, t[1]])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(t[0], 1e-3)), float(t[1])


class Model:
    """Weights for scoring: ``num`` and ``den`` by bucket, bias, and the fit of margins to probabilities."""

    def __init__(self, num: np.ndarray, den: np.ndarray, bias: float, a: float, b: float):
        self.num, self.den, self.bias, self.a, self.b = num, den, bias, a, b

    def margin(self, idx: np.ndarray) -> float:
        return float(self.num[idx].sum() / np.sqrt(self.den[idx].sum() + 1e-12)) + self.bias

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(idx) + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, column: str = "quality") -> Model:
    """Fit on all rows of ``docs(doc_id, text)`` with a 0 or 1 in ``labels(doc_id, column)``; other labels are left out.

    A doc_id with several labels has the highest. Without rows of both labels every score is the smoothed share of label 1. Labels are
    kept as sorted arrays in the shared folder, which tasks map: neither they nor the texts are shuffled or broadcast.
    """
    key = lambda c: F.xxhash64(F.col(c).cast("long"))
    marks = labels.select(key("doc_id").alias("key"), "doc_id", F.col(column).cast("int").alias("value")).where("doc_id is not null and value in (0, 1)")
    store = keyed_at(marks.groupBy("key").agg(F.max("value").alias("value")), "labels")
    rows = docs.where("doc_id is not null").select(key("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.char_length(F.coalesce("text", F.lit("")))), F.lit(1 << 40)).alias("pick"))
    counted = rows.select("key", "text").mapInArrow(tidy(_counted(store)), "idx long, n0 long, n1 long").groupBy("idx").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    docs_of = counted[counted.idx == -1]
    n = np.array([docs_of.n0.sum(), docs_of.n1.sum()], float)
    counted = counted[counted.idx >= 0]
    if not n.all():
        p = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(p / (1 - p))))
    c = np.ones((2, BUCKETS))
    c[0, counted.idx], c[1, counted.idx] = counted.n0 + 1, counted.n1 + 1
    ratio = np.log(c[1] / (n[1] + 2)) - np.log(c[0] / (n[0] + 2))
    half = max_rows // 2
    # a bound on the hash takes about ``half`` rows of each label without sorting texts; what is over is cut after sorting
    under = tuple(int(min(1.0, half / n[label]) * (1 << 40)) for label in (0, 1))
    part = rows.where(F.col("pick") < max(under)).mapInArrow(tidy(_featured(store, under)), "label int, pick long, features binary").collect()
    got = [r for label in (0, 1) for r in sorted((r for r in part if r["label"] == label), key=lambda r: (r["pick"], r["features"]))[:half]]
    got.sort(key=lambda r: (r["pick"], r["label"], r["features"]))
    idx = [np.frombuffer(r["features"], np.uint16).astype(np.int64) for r in got]
    val = [ratio[i] / np.sqrt((ratio[i] ** 2).sum() + 1e-12) for i in idx]
    y = np.array([2.0 * r["label"] - 1 for r in got])
    held = np.array([r["pick"] % 5 == 0 for r in got])
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        held[:] = False
    share = {s: float((y[~held] == s).mean()) for s in (-1.0, 1.0)}
    cost = np.array([1.0 / max(share[s], 1e-9) / 2 for s in y])
    keep = np.flatnonzero(~held)
    w = descend([idx[i] for i in keep], [val[i] for i in keep], y[keep], cost[keep], BUCKETS)
    margin = np.array([w[i] @ v + w[-1] for i, v in zip(idx, val, strict=True)])
    part = held if held.any() else ~held
    prior = {s: n[int(s > 0)] / n.sum() / max(float((y[part] == s).mean()), 1e-9) for s in (-1.0, 1.0)}
    a, b = sigmoid_fit(margin[part], (y[part] > 0).astype(float), np.array([prior[s] for s in y[part]]))
    return Model(w[:-1] * ratio, ratio**2, float(w[-1]), a, b)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` as they are with ``column``, for any columns; one of that name is replaced.

    Null texts count as empty; repeated rows have equal scores; no rows give no rows.
    """
    import pyarrow as pa

    num, den, bias, a, b = model.num.astype(np.float32), model.den.astype(np.float32), model.bias, model.a, model.b

    def run(batches):
        ind, m = Indicators(), Model(num, den, bias, a, b)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, data in _texts(batch, batch.num_columns - 1):
                out[k] = m.score(ind.of(data))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], column])

    rest = docs.drop(column)
    whole = fresh(rest, "whole_text")[0]
    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.DoubleType())])
    return rest.withColumn(whole, F.coalesce("text", F.lit(""))).mapInArrow(tidy(run), schema)


def train_and_score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1, and score all: doc_id, held_out, score, predicted.

    A null doc_id has no label and is not held out.
    """
    out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~out), labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
