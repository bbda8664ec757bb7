"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text is lower-cased, all but letters become single spaces, and its character n-grams (word ends included) are hashed to rows of an embedding
table. The mean of its rows goes through one linear layer and a softmax. As both are linear, a trained model is one table of n-gram logits.
The temperature is fitted on snippets that training never saw.

Rejection asks whether a text is of any of the languages at all, which a softmax over them cannot say. Two things are known of a text: its calibrated confidence,
and its support, the share of its different n-grams of three and four letters that occur in training texts (`SEEN` of them at least), drawn towards 1 for short texts. A logistic
regression of both tells validation texts from texts of no language: each validation text as it looks when its language is left out of the
model, and random letters (letters of the training texts, shuffled and drawn evenly, in words). The threshold lies where at most `REJECT_RATE` of the
validation documents fall under it, or lower, half-way to what `UNKNOWN_RATE` of the texts of no language stay under, if the two lie apart.

Training uses a bounded sample (`train_docs` documents of at most `train_chars` characters, one for each doc_id) of rows outside the held-out fold.
Defined results: null text, or one without a letter: `und`, score 0, rejected. Without any usable training row every document is `und`. Equal texts have equal
results; of equal probabilities the first language by name is taken; a null doc_id is predicted and not held out; very long texts are read whole; several
texts of one doc_id are predicted each; an empty table gives an empty table. Columns other than doc_id, text and lang don't matter.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import held_out, in_training_fold, pieces, slim

NGRAMS, BUCKETS, DIM = (1, 2, 3, 4), 1 << 16, 16
TRAIN_DOCS, TRAIN_CHARS, SNIPPETS, EPOCHS, RATE = 2_000, 20_000, 4, 3, 8.0
REJECT_RATE, UNKNOWN_RATE = 0.001, 0.95
#: Texts that an n-gram must occur in, and how many n-grams of full support each text is given beforehand.
SEEN, PRIOR = 2, 8
UND = "und"
_P, _M = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_ADDRESS = re.compile(r"(?<!\S)[^\s@]++@\S++")
_CODE = re.compile(r"(?<!\w)[^\W0-9]*+[0-9]\w*+")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other signs as one space, spaces at both ends; empty if there is no letter.

    Letters beside digits, as in keys and codes, and mail addresses are no words and go too, unless there are no others."""
    low = text.lower()
    cp = np.frombuffer(low.encode("utf-32-le"), "<u4")
    keep = letters()[cp]
    if not keep.any():
        return np.empty(0, np.uint32)
    if "@" in low or ((cp > 47) & (cp < 58)).any():
        plain = np.frombuffer(_CODE.sub(" ", _ADDRESS.sub(" ", low)).encode("utf-32-le"), "<u4")
        if letters()[plain].any():
            cp, keep = plain, letters()[plain]
    cp = np.concatenate(([32], np.where(keep, cp, 32), [32])).astype(np.uint32)
    space = cp == 32
    return cp[~(space & np.concatenate(([False], space[:-1])))]


def ngram_ids(cp: np.ndarray) -> np.ndarray:
    """Bucket ids of all n-grams of a normal text."""
    out, h = [], np.zeros(len(cp), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(cp) < n:
            break
        h = h[:len(cp) - n + 1] * _P + cp[n - 1:]
        if n in NGRAMS:
            x = h ^ (h >> np.uint32(15))
            x = x * _M
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def long_ids(cp: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the ids that ngram_ids gives, the different ones of three and four letters: they come last."""
    short = sum(max(0, len(cp) - n + 1) for n in NGRAMS if n < 3)
    return distinct(ids[short:])


def distinct(ids: np.ndarray) -> np.ndarray:
    """The different ids: sorted if there are few of them, marked in a table otherwise."""
    if len(ids) < 512:
        return np.unique(ids)
    held = np.zeros(BUCKETS, bool)
    held[ids] = True
    return np.flatnonzero(held)


def support(hits: float, n: int) -> float:
    return (hits + PRIOR) / (n + PRIOR)


def logit(p: float) -> float:
    return float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))


class Model:
    """langs, a table of n-gram logits, a bias and a temperature; which n-grams are known, and weights and threshold of the test for a known language."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, seen: np.ndarray, accept: np.ndarray, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.seen, self.accept, self.threshold = langs, table, bias, temperature, seen, accept, threshold
        self.seen_any = seen.any(1)

    def features(self, text: str, without: int | None = None) -> tuple[np.ndarray, float] | None:
        """Calibrated probabilities and support; `without` leaves a language out of both."""
        cp = normal(text)
        if not len(cp) or not self.langs:
            return None
        ids = ngram_ids(cp)
        z = (self.table[ids].mean(0) + self.bias).astype(float) / self.temperature
        known = self.seen_any if without is None else np.delete(self.seen, without, 1).any(1)
        if without is not None:
            z = np.delete(z, without)
        own = long_ids(cp, ids)
        return softmax(z), support(float(np.count_nonzero(known[own])), len(own))

    def known(self, p: np.ndarray, share: float) -> float:
        """The probability that the text is of a known language."""
        return float(1 / (1 + np.exp(-np.clip(self.accept @ [1.0, logit(p.max()), logit(share)], -30, 30))))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated confidence, whether it is accepted."""
        got = self.features(text)
        if got is None:
            return UND, 0.0, False
        p, share = got
        best = int(p.argmax())
        return self.langs[best], float(p[best]), self.known(p, share) >= self.threshold


def noise(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no language: the letters of each text shuffled within the whole of it, or letters drawn evenly from its alphabet, in words as long as its own."""
    out = []
    for t in texts:
        cp = normal(t)
        if len(cp) < 12:
            continue
        letters_, gap = cp[cp != 32], cp == 32
        for drawn in (rng.permutation(letters_), rng.choice(np.unique(letters_), len(letters_))):
            made = cp.copy()
            made[~gap] = drawn
            out.append(made.astype("<u4").tobytes().decode("utf-32-le"))
    return out


def logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, classes balanced, by Newton steps."""
    w, weight = np.zeros(x.shape[1]), np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = weight * p * (1 - p)
        w = w + np.linalg.solve((x * curve[:, None]).T @ x + reg * np.eye(len(w)) / 10, x.T @ (weight * (y - p)) - reg * w / 10)
    return w


def snippets(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text and n parts of it, at random places, of 20 to 600 characters."""
    out = [text]
    for _ in range(n):
        size = int(np.exp(rng.uniform(np.log(20), np.log(600))))
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        out.append(text[at:at + size])
    return out


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros((BUCKETS, 0), bool), np.zeros(3), 0.0)
    rng = np.random.default_rng(seed)
    code = {v: i for i, v in enumerate(names)}
    fit, val = [], []
    held = np.zeros((BUCKETS, len(names)), np.int32)
    for i, (t, v) in enumerate(zip(texts, langs)):
        for s in snippets(t, rng, SNIPPETS):
            cp = normal(s)
            if len(cp):
                every = ngram_ids(cp)
                if s is t and i % 5 < 4:
                    held[long_ids(cp, every), code[v]] += 1
                ids, count = np.unique(every, return_counts=True)
                (val if i % 5 == 4 else fit).append((ids, (count / count.sum()).astype(np.float32), code[v], s is t))
    emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for j in rng.permutation(len(fit)):
            ids, share, y, _ = fit[j]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ emb[ids]
            g = softmax(x @ w + b)
            g[y] -= 1
            back = w @ g
            w -= 0.1 * rate * np.outer(x, g)
            b -= 0.01 * rate * g
            emb[ids] -= rate * share[:, None] * back[None, :]
    table = (emb @ w).astype(np.float32)
    model = Model(names, table, b.astype(float), 1.0, held >= SEEN, np.zeros(3), 0.0)
    val = val or fit
    if val:
        z = np.array([share @ table[ids] + b for ids, share, _, _ in val], float)
        y = np.array([v[2] for v in val])
        grid = np.exp(np.linspace(-3, 3, 61))
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        unseen = [(t, code[v]) for i, (t, v) in enumerate(zip(texts, langs)) if i % 5 == 4] or list(zip(texts, [code[v] for v in langs]))
        calibrate(model, unseen, rng)
    return model


def calibrate(model: Model, texts: list[tuple[str, int]], rng: np.random.Generator) -> None:
    """The test for a known language, from texts that training never saw, whole and in snippets."""
    row = lambda got: None if got is None else [1.0, logit(got[0].max()), logit(got[1])]
    parts = [(s, v, s is t) for t, v in texts for s in snippets(t, rng, 2)]
    known = [(row(model.features(s)), whole) for s, _, whole in parts]
    other = [(row(model.features(s, without=v)), whole) for s, v, whole in parts] if len(model.langs) > 1 else []
    other += [(row(model.features(n)), whole) for s, _, whole in parts for n in noise([s], rng)]
    known, other = ([(r, whole) for r, whole in rows if r] for rows in (known, other))
    if not known or not other:
        return
    x = np.array([r for r, _ in known + other])
    model.accept = logistic(x, np.concatenate([np.ones(len(known)), np.zeros(len(other))]))
    at = lambda rows: np.array([r for r, whole in rows if whole] or [r for r, _ in rows]) @ model.accept  # noqa: E731  (log-odds of documents)
    low, high = float(np.quantile(at(known), REJECT_RATE)), float(np.quantile(at(other), UNKNOWN_RATE))
    odds = (low + high) / 2 if high < low else low
    model.threshold = float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        in_training_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.select("doc_id", "lang").count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, train_docs / max(n, 1)) + 1)
    some = known.where(share & (F.length("text") <= train_chars)).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.*")
    rows = sorted(some.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each document."""

    def predict(batches):
        for batch in batches:
            for b in pieces(batch):
                lang, score, ok = zip(*map(model.predict, b.column(1).to_pylist())) if b.num_rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = slim(docs, text_col, id_col).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, whole and in one pass: no join back to the corpus."""

    def keep(batches):
        for batch in batches:
            for b in pieces(batch):
                ok = [model.predict(t or "")[2] for t in b.column(text_col).to_pylist()]
                yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
