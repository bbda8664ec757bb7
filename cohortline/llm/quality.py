"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

Each token (a word, a run of signs, a mark for a word's case and for a word that repeats the one before it) is hashed to one of `BUCKETS` rows. A
row's index vector is sparse and ternary, from the hash alone; its word vector is the index vector plus the sum of the index vectors that
surrounded the token in the training texts. A document is pooled twice, over its tokens and over its different tokens, with its length and share
of different tokens beside; a hidden layer and a sigmoid follow. The temperature is fitted on documents that training never saw.

Training uses a bounded sample (`train_docs` documents of at most `train_chars` characters) of labelled rows outside the held-out fold.
Defined results: null and empty texts are scored like any other (they pool to zeros); several labels of one doc_id: the largest counts; several texts of one
doc_id: the least is learned from, all are scored; equal texts have equal scores; a null doc_id is scored and not held out; very long texts are scored whole,
not learned from; without any training row every score is 0.5; an empty table gives an empty table. Columns other than doc_id and text don't matter.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import hashed_share, held_out, in_training_fold, pieces, slim, whole_text

BUCKETS, DIM, WINDOW, HIDDEN = 1 << 14, 48, 2, 24
TRAIN_DOCS, TRAIN_CHARS, EPOCHS, RATE = 4_000, 20_000, 30, 0.01
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Token ids that a worker remembers; then it forgets all and goes on.
REMEMBERED = 200_000


class _Ids(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        shape = "#" if not word[0].isalnum() else "U" if word.isupper() and len(word) > 1 else "T" if word[0].isupper() else "9" if word[0].isdigit() else "l"
        v = self[word] = (zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"\0" + shape.encode()) % BUCKETS)
        return v


_ids = _Ids()
_AGAIN = zlib.crc32(b"\0again") % BUCKETS


def token_ids(text: str) -> np.ndarray:
    """Bucket ids of the text's tokens, in order: three to a token (word, shape, whether it repeats the one before)."""
    pairs = list(map(_ids.__getitem__, TOKEN.findall(text)))
    if not pairs:
        return np.empty((0, 3), np.int64)
    a = np.array(pairs, np.int64)
    again = np.full(len(a), -1, np.int64)
    again[1:][a[1:, 0] == a[:-1, 0]] = _AGAIN
    return np.column_stack([a, again])


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM, eight entries of +1 or -1 in each row."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for i in range(8):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] = rng.choice([-1.0, 1.0], BUCKETS)
    return out / np.sqrt(8)


def word_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Index vectors plus half the normalised context sums gathered from the training texts."""
    index = index_vectors()
    context = np.zeros_like(index)
    for d in docs:
        w = d[:, 0]
        for k in range(1, WINDOW + 1):
            if len(w) > k:
                np.add.at(context, w[:-k], index[w[k:]])
                np.add.at(context, w[k:], index[w[:-k]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + 0.5 * context / np.where(norm > 0, norm, 1)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means over tokens and over different tokens, then log length, share of different tokens, share of repeats, share of shapes."""
    out = np.zeros(3 * DIM + 4, np.float32)
    n = len(ids)
    if n:
        words, count = np.unique(ids[:, 0], return_counts=True)
        v = vectors[words]
        out[:DIM] = count.astype(np.float32) @ v / n
        out[DIM:2 * DIM] = v.mean(0)
        shapes, k = np.unique(ids[:, 1], return_counts=True)
        out[2 * DIM:3 * DIM] = k.astype(np.float32) @ vectors[shapes] / n
        out[3 * DIM:] = np.log1p(n) / 10, len(words) / n, float((ids[:, 2] >= 0).mean()), float(count.max() / n)
    return out


class Model:
    def __init__(self, vectors, mean, scale, w1, b1, w2, b2, temperature):
        self.vectors, self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = vectors, mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(texts), 0.5)
        x = np.array([pooled(token_ids(t), self.vectors) for t in texts]).reshape(-1, 3 * DIM + 4)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    vectors = word_vectors([])
    if not texts:
        return Model(vectors, None, None, None, None, None, None, 1.0)
    docs = [token_ids(t) for t in texts]
    vectors = word_vectors(docs)
    x = np.array([pooled(d, vectors) for d in docs])
    y = np.array(labels, float)
    val = np.arange(len(y)) % 5 == 4
    if not val.any():
        val[:] = False
    fit = ~val
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    w1, b1 = rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN)
    w2, b2 = rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0
    state = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (w1, b1, w2, b2)]
    rows, t = np.flatnonzero(fit), 0
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for i in range(0, len(order), 32):
            j = order[i:i + 32]
            h = np.tanh(z[j] @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[j]) / len(j)
            gh = np.outer(g, w2) * (1 - h * h)
            grads = (z[j].T @ gh + 1e-3 * w1, gh.sum(0), h.T @ g + 1e-3 * w2, g.sum())
            t += 1
            new = []
            for p, d, (m, v) in zip((w1, b1, w2, b2), grads, state):
                m[...] = 0.9 * m + 0.1 * d
                v[...] = 0.999 * v + 0.001 * np.square(d)
                new.append(p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
            w1, b1, w2, b2 = new
    model = Model(vectors.astype(np.float32), mean, scale, w1, b1, w2, float(b2), 1.0)
    k = val if val.any() else fit
    logit = model.logits(x[k])
    loss = lambda s: np.logaddexp(0, -np.where(y[k] > 0, 1, -1) * logit / s).mean()
    model.temperature = float(min(np.exp(np.linspace(-2, 3, 51)), key=loss))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, train_chars: int, text_col: str = "text") -> tuple[list[str], list[int]]:
    """About `bound` labelled texts outside the held-out fold: labels are sampled first, so the corpus is read once against a small broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(in_training_fold(F.col("doc_id")) & F.col("y").isNotNull())
    some = hashed_share(known.groupBy("doc_id").agg(F.max("y").alias("y")), F.col("doc_id"), bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text_col).alias("text")).join(F.broadcast(some), "doc_id")  # about `bound` rows
    rows = rows.where(F.length("text") <= train_chars)
    # a doc_id that repeats brings one text only, so that rows are as bounded as labels
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("x")).select("doc_id", "x.*")
    got = sorted(one.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in got], [r["y"] for r in got]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    return train(*labelled_sample(docs, labels, label, train_docs, train_chars))


def score(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; `model` has scores(texts)."""

    def predict(batches):
        for batch in batches:
            for b in pieces(batch):
                s = np.asarray(model.scores(b.column(1).to_pylist()), float)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = slim(docs, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")
