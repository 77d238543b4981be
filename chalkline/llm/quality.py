"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

The n-grams: words and word pairs; trigrams of character classes, each with the share of the text it reaches, as one
indicator for each of SHARES; and the pair of a word and itself, with its share likewise. Indicators are scaled by the
log ratio of their smoothed shares in the two classes; the hinge loss is minimised by dual coordinate descent; a logistic
curve fitted to sampled rows that the weights haven't seen turns margins into scores.

Null and empty texts have no indicator and get the bias's score; without labels of both kinds the score is the base
rate. Repeated rows get equal scores; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, id_and_text
from chalkline.llm.samples import held_out, learning_rows

THRESHOLD = 0.7
SHARES = (0.0, 0.01, 0.04, 0.12, 0.35)
#: A word or pair counts if so many sampled documents have it.
LEAST_DOCS = 4
#: Hashed counts that keep rare words and pairs out of memory.
BUCKETS = 1 << 23
#: Smoothing of counts; the hinge loss's weight; passes over the sample; rows kept to fit the curve, one in so many.
SMOOTHING, COST, PASSES, CURVE = 1.0, 0.1, 25, 5
PIECE = 1 << 20

#: Classes: small letter, capital, digit, beyond ASCII, space, line feed, full stop or comma, and one for each other kind of mark.
CLASS = np.full(256, 7, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:], CLASS[32], CLASS[10] = 0, 1, 2, 3, 4, 5
for _marks, _class in ((b".,;:", 6), (b"!?", 8), (b"|", 9), (b"#$%&*", 10), (b"-_=+/", 11), (b"<>()[]{}\"'", 12)):
    CLASS[list(_marks)] = _class
KINDS = 13


def shape_indicators(data: bytes) -> np.ndarray:
    """Numbers below KINDS**3 * len(SHARES) + len(SHARES) of the indicators of shape that hold."""
    counts = np.zeros(KINDS**3, np.int64)
    for k in range(0, max(0, len(data) - 2), PIECE):
        c = CLASS[np.frombuffer(data[k : k + PIECE + 2], np.uint8)]
        counts += np.bincount((c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:], minlength=KINDS**3)
    total = max(1, int(counts.sum()))
    seen = np.flatnonzero(counts)
    shares = counts[seen] / total
    return np.concatenate([seen * len(SHARES) + i for i in range(len(SHARES))])[np.concatenate([shares > s for s in SHARES])]


def repeat_indicators(words: list[bytes]) -> list[int]:
    same = sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0
    return [KINDS**3 * len(SHARES) + i for i, s in enumerate(SHARES) if same > s]


def grams_of(words: list[bytes]) -> set[bytes]:
    return set(words) | set(map(b" ".join, zip(words, words[1:])))


class QualityModel:
    """Weights of shapes (an array) and of words and pairs, the bias, and the curve's slope and shift."""

    def __init__(self, shapes: np.ndarray, grams: dict[bytes, float], bias: float, slope: float, shift: float):
        self.shapes, self.grams, self.bias, self.slope, self.shift = shapes, grams, bias, slope, shift
        self.singles = {g for g in grams if b" " not in g}
        self.pairs = {g for g in grams if b" " in g}
        self.firsts = {g.split(b" ")[0] for g in self.pairs}

    def margin(self, data: bytes) -> float:
        words = data.split()
        shapes = np.concatenate([shape_indicators(data), np.array(repeat_indicators(words), np.int64)])
        own = set(words)
        found = [self.grams[w] for w in own & self.singles]
        if own & self.firsts:
            found += [self.grams[p] for p in set(map(b" ".join, zip(words, words[1:]))) & self.pairs]
        return float(self.bias + (self.shapes[shapes].sum() + sum(found)) / np.sqrt(max(1, len(shapes) + len(found))))

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(data) + self.shift, -30, 30))))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Weights, the bias last, that minimise the squared weights' half plus COST times the hinge losses."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(11)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + w[size]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                w[size] += step
                moved = max(moved, abs(new - alpha[i]))
            alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss (Newton; targets drawn in by the counts)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([d @ margins, d.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def _frequent(texts: list[bytes]) -> list[bytes]:
    """Words and pairs that LEAST_DOCS texts have: by hashed counts first, which leave out none of them, then exactly."""
    buckets = np.zeros(BUCKETS, np.int32)
    for text in texts:
        hashed = {hash(g) % BUCKETS for g in grams_of(text.split())}
        buckets[np.fromiter(hashed, np.int64, len(hashed))] += 1
    often, exact = buckets >= LEAST_DOCS, {}
    for text in texts:
        for g in grams_of(text.split()):
            if often[hash(g) % BUCKETS]:
                exact[g] = exact.get(g, 0) + 1
    return sorted(g for g, n in exact.items() if n >= LEAST_DOCS)


def fit(rows: list[tuple[bytes, int]]) -> QualityModel:
    """The model of labelled documents (text, 0 or 1)."""
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    base = KINDS**3 * len(SHARES) + len(SHARES)
    if not len(y) or abs(y.sum()) == len(y):
        rate = ((y > 0).sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros(base), {}, 0.0, 1.0, float(np.log(rate / (1 - rate))))
    # the rows that the curve is fitted on are set apart first: neither n-grams nor their ratios come from them
    train = np.arange(len(rows)) % CURVE != 0
    if len(set(y[~train])) < 2 or len(set(y[train])) < 2:
        train[:] = True
    names = _frequent([text for (text, _), own in zip(rows, train) if own])
    number = {g: base + i for i, g in enumerate(names)}
    size = base + len(names)
    features = []
    for text, _ in rows:
        words = text.split()
        found = [number[g] for g in grams_of(words) if g in number]
        features.append(np.unique(np.concatenate([shape_indicators(text), np.array(repeat_indicators(words) + found, np.int64)])).astype(np.int32))
    flat, lengths = np.concatenate(features), np.array([len(f) for f in features])
    label, own = np.repeat(y, lengths), np.repeat(train, lengths)
    p = np.bincount(flat[own & (label > 0)], minlength=size) + SMOOTHING
    q = np.bincount(flat[own & (label < 0)], minlength=size) + SMOOTHING
    n1, n0 = (y[train] > 0).sum() + 2 * SMOOTHING, (y[train] < 0).sum() + 2 * SMOOTHING
    ratio = np.log(p / n1) - np.log(q / n0)
    values = [ratio[f] / np.sqrt(max(1, len(f))) for f in features]
    at = np.flatnonzero(train).tolist()
    w = _descend([features[i] for i in at], [values[i] for i in at], y[at], size)
    rest = np.flatnonzero(~train).tolist() or at
    margins = np.array([w[features[i]] @ values[i] + w[size] for i in rest])
    slope, shift = _curve(margins, y[rest])
    return QualityModel(*_packed(w, ratio, base, names), float(w[size]), slope, shift)


def _packed(w: np.ndarray, ratio: np.ndarray, base: int, names: list[bytes]) -> tuple[np.ndarray, dict[bytes, float]]:
    own = w[:-1] * ratio
    return own[:base], {g: float(x) for g, x in zip(names, own[base:])}


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return fit(learning_rows(docs, labels, "quality"))


def _score_batches(model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [model.value.score(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scored = id_and_text(docs).mapInArrow(_score_batches(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
