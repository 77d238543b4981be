"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's log-odds are a bias and the weights of its words, a word's weight being that of the word and of its first
PREFIXES bytes; a document's probability is the noisy-or of its sentences'. Only documents have labels: features that
documents of label 1 have significantly often (likelihood ratio of at least LEAST_RATIO) are kept, and weights are
fitted to the documents' likelihood (Adam), so the sentences that make a document toxic are found by the model.
Sentences end at . ! ? or a line feed; words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased.

Null and empty texts are one sentence without words; without labels of both kinds the score is the base rate. Repeated
rows get equal scores; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, filtered, id_and_text
from chalkline.llm.samples import held_out, learning_rows

THRESHOLD = 0.3
#: Bytes of a word's beginnings that are features besides the word.
PREFIXES = (4, 5, 6, 8)
#: Of a feature kept: documents with it, and its likelihood ratio (chance gives 20 once in 100,000 features).
LEAST_DOCS, LEAST_RATIO = 3, 20.0
ROUNDS, RATE, DECAY = 150, 0.1, 1e-5
#: Words whose weights a worker remembers.
REMEMBERED = 500_000

TOKEN_BYTES = bytes(1 if c in b".!?\n" else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STOP = b"\x01"


def tokens_of(data: bytes) -> list[bytes]:
    """Words, and STOP where a sentence ends."""
    return data.translate(TOKEN_BYTES).replace(STOP, b" \x01 ").split()


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


class WordWeights(dict):
    """Weights of words as they are met; STOP has none."""

    def __init__(self, features: dict[bytes, float]):
        super().__init__({STOP: np.inf})
        self.features = features

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
            self[STOP] = np.inf
        get = self.features.get
        self[word] = weight = sum(get(f, 0.0) for f in features_of(word)) if word != STOP else np.inf
        return weight


class SentenceModel:
    """Features' weights and the bias of a sentence's log-odds."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: WordWeights | None = None

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": None}

    def sentences(self, data: bytes) -> np.ndarray:
        """Log-odds of each sentence that has words; of the empty sentence if none has."""
        if self.known is None:
            self.known = WordWeights(self.weights)
        tokens = tokens_of(data)
        values = np.fromiter(map(self.known.__getitem__, tokens), float, len(tokens))
        words = np.isfinite(values)
        if not words.any():
            return np.array([self.bias])
        sentence = np.cumsum(~words)[words]
        return np.bincount(sentence, values[words])[np.bincount(sentence) > 0] + self.bias

    def score(self, data: bytes) -> float:
        return float(-np.expm1(-softplus(self.sentences(data)).sum()))


def _telling(rows: list[tuple[bytes, int]], docs: np.ndarray) -> list[bytes]:
    """Features that documents of label 1 have significantly more often."""
    counts: list[dict[bytes, int]] = [{}, {}]
    for text, label in rows:
        own = counts[label]
        for f in {f for word in set(tokens_of(text)) if word != STOP for f in features_of(word)}:
            own[f] = own.get(f, 0) + 1
    rate, kept = docs[1] / docs.sum(), []
    for f, hits in counts[1].items():
        n = hits + counts[0].get(f, 0)
        if n < LEAST_DOCS or hits <= n * rate:
            continue
        ratio = 2 * (hits * np.log(hits / (n * rate)) + ((n - hits) * np.log((n - hits) / (n * (1 - rate))) if n > hits else 0))
        if ratio >= LEAST_RATIO:
            kept.append(f)
    return sorted(kept)


def fit(rows: list[tuple[bytes, int]]) -> SentenceModel:
    """The model of labelled documents (text, 0 or 1)."""
    y = np.array([label for _, label in rows], float)
    docs = np.bincount(y.astype(int), minlength=2)
    if not docs.all():
        rate = (docs[1] + 0.5) / (len(y) + 1)
        return SentenceModel({}, float(np.log(rate / (1 - rate))))
    names = _telling(rows, docs)
    number = {f: i for i, f in enumerate(names)}
    own_features: dict[bytes, list[int]] = {STOP: []}
    ids, sentence, doc_of, at = [], [], [], 0
    for d, (text, _) in enumerate(rows):
        first, filled = at, False
        for token in tokens_of(text):
            if token == STOP:
                at, filled = at + filled, False
                continue
            if token not in own_features:
                own_features[token] = [number[f] for f in features_of(token) if f in number]
            filled = True
            if found := own_features[token]:
                ids += found
                sentence += [at] * len(found)
        at = max(at + filled, first + 1)
        doc_of.append(np.full(at - first, d))
    ids, sentence, doc_of = np.array(ids, np.int64), np.array(sentence, np.int64), np.concatenate(doc_of)
    w, b = np.ones(len(names)), -np.log(len(doc_of) / len(rows)) - 3.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(sentence, w[ids], minlength=len(doc_of)) + b
        total = np.maximum(np.bincount(doc_of, softplus(z), minlength=len(rows)), 1e-12)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        g = slope[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.r_[np.bincount(ids, g[sentence], minlength=len(names)) / len(rows) + DECAY * w, g.sum() / len(rows)]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return SentenceModel({f: float(x) for f, x in zip(names, w)}, float(b))


def train(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    return fit(learning_rows(docs, labels, "toxic"))


def _score_batches(model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [model.value.score(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scored = id_and_text(docs).mapInArrow(_score_batches(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _locate_batches(model, least: float):
    def run(batches):
        import re

        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for m in re.finditer(r"[^.!?\n]+", (text or b"").decode("utf-8", "replace")):
                    p = model.value.score(m[0].encode())
                    if p >= least and tokens_of(m[0].encode()):
                        out.append((doc_id, m.start(), m.end(), m[0], p))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "stop", "sentence", "probability"])

    return run


def offending_sentences(docs: DataFrame, model: SentenceModel, least: float = THRESHOLD) -> DataFrame:
    """doc_id, start, stop (code points), sentence and probability of each sentence that is itself at least so likely."""
    spark = docs.sparkSession
    bounded_batches(spark)
    return id_and_text(docs).mapInArrow(_locate_batches(spark.sparkContext.broadcast(model), least), "doc_id long, start long, stop long, sentence string, probability double")


def remove_toxic(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs but those predicted toxic; of rows that share a doc_id each is judged by its own text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: [shared.value.score(x or b"") < threshold for x in texts])
