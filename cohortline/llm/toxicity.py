"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

The kernel of two strings sums over their common subsequences of `N` characters, each weighed by LAMBDA to the power of the lengths it
spans in both, is normalised by the strings' own kernels and raised to POWER (which
leaves it a kernel); gaps and inserted characters lower it gently. A sentence is compared with a landmark
through its best-matching unit. Units are its words without their punctuation (single letters in a row are one unit, whatever signs stand between them; a very long word is windows),
and those windows of two neighbouring words, with the space between them, whose letters run on over the space as those of a landmark of about their length do: only there
can an insult be that a space splits, or one of several words. So a sentence's margin is the largest margin of its units, and a document's that of its sentences. The kernel is
computed whole, for every unit with every landmark, from the subsequences themselves: those of the landmarks are a table, and those of a unit are looked up in it.

Landmarks are telling words, which toxic training documents hold and clean ones don't, then telling windows of toxic documents that no such word explains, until each is one or is
like one (kernel of at least LIKE), and a third as many frequent clean words. A sentence of a
toxic document that holds none of them says nothing and is left out; all sentences of clean documents count. Positive sentences are
trained on with gaps, insertions and spaces added. Platt scaling on documents that training never saw turns margins into scores.

Training uses a bounded sample of labelled rows outside the held-out fold, one text for each doc_id. Defined results: a null or empty text has the lowest margin;
several labels of one doc_id: the largest counts; several texts of one doc_id: the least is learned from, all are scored; equal texts have equal scores; a
null doc_id is scored and not held out; very long texts are scored whole, not learned from; without training rows of both classes every score is 0.5 - 1e-9; an
empty table gives an empty table. Columns other than doc_id and text don't matter.
"""

import hashlib
import heapq
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from cohortline.llm.quality import labelled_sample, score  # noqa: F401  (score is the same operator, with another model)

N, LAMBDA, POWER, LONGEST, LIKE = 3, 0.8, 4, 24, 0.8
#: Least number of clean landmarks; otherwise there is one to three telling ones.
CLEAN_LANDMARKS = 16
TRAIN_DOCS, TRAIN_CHARS, UNITS, REG = 6_000, 20_000, 150_000, 1e-4
#: Clean units with a margin over -HARD count HARDER times in the second round of training.
HARD, HARDER = 0.8, 100
#: Letters that a window may have more or fewer than the landmark it is like.
SLACK = 2
#: How much oftener a telling word is in toxic documents than in clean ones.
OFTENER = 20
#: Subsequences looked up at once.
AT_ONCE = 1 << 16
#: With fewer characters in the landmarks than this, subsequences are found by place and not by search.
DIRECT = 100
#: Words that a worker remembers the margins of; then it forgets all and goes on.
REMEMBERED = 500_000
#: The margin of a word without a unit of its own.
NOTHING = -1e9
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Signs around a word that stand for no letter.
AROUND = ".,;:!?\"'()[]{}<>-_*#%&/\\|+=~^`"
#: Signs that stand for letters inside a word.
LEET = str.maketrans("013457@$", "oieastas")
_PLAIN = re.compile(r"[^\W\d_]+\Z")


def units(sentence: str) -> list[str]:
    """Lower-case words without signs; a row of three or more single letters is one unit, also over signs that stand alone; a long word is windows of LONGEST characters."""
    out, row = [], []
    for w in sentence.lower().split():
        u = w
        if not _PLAIN.match(w):
            u = w.translate(LEET) if any(map(str.isalpha, w)) else w
            u = "".join(c for c in u if c.isalnum())
            if not u:
                continue
        if len(u) == 1:
            row.append(u)
            continue
        if len(row) > 2:
            out.append("".join(row))
        row = []
        out.append(u)
    if len(row) > 2:
        out.append("".join(row))
    if any(len(u) > LONGEST for u in out):
        out = [u[i:i + LONGEST] for u in out for i in range(0, max(1, len(u) - LONGEST // 2), LONGEST // 2)]
    return out


def units_of(word: str) -> list[str]:
    """What `units` gives for one lower-case word; at once for letters with signs only around them."""
    u = word.strip(AROUND)
    return [u] if 1 < len(u) <= LONGEST and u.isalpha() else units(word)


def neighbours(us: list[str]) -> list[str]:
    """All windows of two units of a sentence."""
    return [f"{a} {b}" for a, b in zip(us, us[1:]) if len(a) + len(b) < LONGEST]


class Border:
    """Which neighbouring words run on over the space between them as a landmark's letters do: two letters on either side (one of a word of one letter) follow
    each other in a landmark of about as many letters, SLACK more or fewer."""

    def __init__(self, landmarks: list[str]):
        held: dict[tuple[str, str], list[int]] = {}
        for w in (w.replace(" ", "") for w in landmarks):
            for i in range(1, len(w)):
                for a, b in ((w[max(0, i - 2):i], w[i:i + 2]), (w[i - 1:i], w[i:i + 2]), (w[max(0, i - 2):i], w[i:i + 1])):
                    held.setdefault((a, b), []).append(len(w))
        self.ends, self.begins = ({x: i + 1 for i, x in enumerate(sorted({k[j] for k in held}))} for j in (0, 1))
        self.least, self.most = (np.zeros((len(self.ends) + 1, len(self.begins) + 1), np.int16) for _ in range(2))
        for (a, b), n in held.items():
            at = self.ends[a], self.begins[b]
            self.least[at], self.most[at] = min(n) - SLACK, max(n) + SLACK

    def sides(self, word: str, us: list[str]) -> int:
        """A number for a word's end and beginning, each 0 where no window goes on; none goes on over the end of a sentence."""
        if len(us) != 1 and not (not us and len(word) == 1 and word.isalpha()):
            return 0
        u = us[0] if us else word
        return (0 if word[-1] in ".!?" else self.ends.get(u[-2:], 0) * len(self.least[0])) + self.begins.get(u[:2], 0)

    def windows(self, words: list[str], sides: np.ndarray) -> list[str]:
        """The windows of a text's words, by the numbers of their sides."""
        if len(words) < 2 or not sides.any():
            return []
        out = []
        a, b = sides[:-1] // len(self.least[0]), sides[1:] % len(self.least[0])
        some = np.flatnonzero((a > 0) & (b > 0))
        for i in some[self.most[a[some], b[some]] > 0].tolist():
            v, w = words[i], words[i + 1]
            if len(v) + len(w) > 2 * LONGEST:
                continue
            v, w = (units_of(v) or [v])[0], (units_of(w) or [w])[0]
            if self.least[a[i], b[i]] <= len(v) + len(w) <= min(self.most[a[i], b[i]], LONGEST - 1):
                out.append(f"{v} {w}")
        return out


def letter_rows(words: list[str], margins: list[float]) -> list[str]:
    """The units made of single letters in a row."""
    out, run = [], []
    for w, m in zip([*words, ""], [*margins, 0.0]):
        if m == NOTHING:
            run.append(w)
        else:
            if len(run) > 2:
                out += units(" ".join(run))
            run = []
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    a = np.zeros((len(strings), width), np.uint32)
    for i, s in enumerate(strings):
        a[i, :len(s)] = np.frombuffer(s.encode("utf-32-le"), "<u4")
    return a


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the kernel of two arrays of code points (0 pads the end and matches nothing).

    Of each pair of places the weight of the subsequences that end before it is a sum over all earlier pairs, which decay by LAMBDA a step on either side: two products."""
    p, n, m = len(a), a.shape[1], b.shape[1]
    hit = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)).astype(np.float32)
    decay = lambda k: np.tril(np.float32(LAMBDA) ** np.maximum(np.subtract.outer(np.arange(k), np.arange(k)), 0)).astype(np.float32)
    left, right, before = decay(n).T, decay(m).T, np.ones((p, n, m), np.float32)
    for _ in range(N - 1):
        after = ((before * hit).reshape(p * n, m) @ right).reshape(p, n, m).transpose(0, 2, 1)
        after = (after.reshape(p * m, n) @ left).reshape(p, m, n).transpose(0, 2, 1)
        before = np.zeros((p, n, m), np.float32)
        before[:, 1:, 1:] = np.float32(LAMBDA**2) * after[:, :-1, :-1]
    return np.float32(LAMBDA**2) * (hit * before).sum((1, 2))


def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of N characters in a string of n, and LAMBDA to the power of what each spans."""
    if n not in _places:
        at = np.array(list(combinations(range(n), N)), np.int64).reshape(-1, N)
        _places[n] = at, (LAMBDA ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
    return _places[n]


_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Landmarks:
    """Landmark strings with what comparing with them needs: for each of their subsequences, the landmarks that hold it and its weight there."""

    def __init__(self, words: list[str]):
        self.words, self.direct = words, None
        self.chars = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
        found: dict[tuple[int, int], float] = {}
        for k, w in enumerate(words):
            at, weight = subsequences(len(w))
            for key, v in zip(self.keys(_codes([w], len(w)), at)[0].tolist(), weight.tolist()):
                found[key, k] = found.get((key, k), 0.0) + v
        self.known = np.array(sorted({key for key, _ in found}), np.int64)
        entries = sorted(found)
        rows = np.searchsorted(self.known, np.array([key for key, _ in entries], np.int64))
        self.column = np.array([k for _, k in entries], np.int64)
        self.value = np.array([found[e] for e in entries], np.float32)
        self.start = np.searchsorted(rows, np.arange(len(self.known) + 1))
        self.own = np.sqrt(np.bincount(self.column, self.value.astype(float) ** 2, len(words))) + 1e-12

    def keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each subsequence of each row; characters that are in no landmark all count as one more."""
        i = np.searchsorted(self.chars, codes)
        i = np.where(self.chars[np.minimum(i, len(self.chars) - 1)] == codes, i + 1, 0).astype(np.int32 if len(self.chars) < 1200 else np.int64)
        out = i[:, at[:, 0]]
        for j in range(1, N):
            out = out * (len(self.chars) + 1) + i[:, at[:, j]]
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in the table, -1 if it has none."""
        if len(self.chars) < DIRECT:
            if self.direct is None:
                self.direct = np.full((len(self.chars) + 1) ** N, -1, np.int32)
                self.direct[self.known] = np.arange(len(self.known))
            return self.direct[keys]
        row = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[row] == keys, row, -1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "direct": None}

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Normalised kernel of each string with each landmark."""
        out = np.zeros((len(strings), len(self.words)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        for n, where in by_length.items():
            at, weight = subsequences(n)
            if not len(at) or not len(self.known):
                continue
            step = max(1, AT_ONCE // len(at))
            for lo in range(0, len(where), step):
                idx = np.array(where[lo:lo + step])
                codes = _codes([strings[i] for i in idx], n)
                row = self.rows(self.keys(codes, at))
                r, c = np.nonzero(row >= 0)
                if not len(r):
                    continue
                row = row[r, c]
                n_each = self.start[row + 1] - self.start[row]
                ends = np.cumsum(n_each)
                entry = np.arange(ends[-1]) + np.repeat(self.start[row] - ends + n_each, n_each)
                cell = np.repeat(r * len(self.words), n_each) + self.column[entry]
                raw = np.bincount(cell, np.repeat(weight[c], n_each) * self.value[entry], len(idx) * len(self.words)).reshape(len(idx), -1)
                own = np.sqrt(subsequence_kernel(codes, codes)) + 1e-12
                one = raw / (own[:, None] * self.own)
                whole = one.copy()
                for _ in range(POWER - 1):
                    whole *= one
                out[idx] = whole
        return out


_known: dict[str, tuple[dict[str, float], dict[str, int]]] = {}


class Model:
    def __init__(self, landmarks: Landmarks | None, beta: np.ndarray, bias: float, a: float, b: float, border: Border | None = None):
        self.landmarks, self.beta, self.bias, self.a, self.b, self.border = landmarks, beta, bias, a, b, border
        self.name = hashlib.sha256(repr((landmarks and landmarks.words, beta.tolist(), bias)).encode()).hexdigest()

    @property
    def known(self) -> tuple[dict[str, float], dict[str, int]]:
        """Margins of words (and of windows) by this model, and the numbers of words' sides, which the tasks of a worker share."""
        if self.name not in _known:
            _known.clear()
            _known[self.name] = {}, {}
        return _known[self.name]

    def judge(self, strings: list[str]) -> np.ndarray:
        return self.landmarks.kernel(strings) @ self.beta + self.bias

    def remember(self, words: set[str], windows: bool = False) -> None:
        """The largest margin of the units of each word, or the margin of each window, that isn't known yet."""
        known, sides = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED and not windows:
            known.clear(), sides.clear()
            new = list(words)
        plain = {w: u for w in new if 1 < len(u := w.strip(AROUND)) <= LONGEST and u.isalpha()} if not windows else {}
        other = {w: [w] if windows else units(w) for w in new if w not in plain}
        # a word of letters alone is known by itself, whatever signs are around it here
        every = sorted({u for u in plain.values() if u not in known} | {u for us in other.values() for u in us if u not in known})
        margin = dict(zip(every, self.judge(every).tolist())) if every else {}
        ends, begins, step = self.border.ends, self.border.begins, len(self.border.least[0])
        for w, u in plain.items():
            if u in margin:
                known[u] = margin[u]
                sides[u] = ends.get(u[-2:], 0) * step + begins.get(u[:2], 0)
            if u is not w:
                known[w] = known[u]
                sides[w] = sides[u] % step if w[-1] in ".!?" else sides[u]
        for w, us in other.items():
            known[w] = max((margin[u] if u in margin else known[u] for u in us), default=NOTHING)
            if not windows:
                sides[w] = self.border.sides(w, us)

    def margins(self, texts: list[str]) -> np.ndarray:
        """A sentence's margin is that of its best unit and a document's that of its best sentence: so, that of its best unit."""
        out = np.full(len(texts), self.bias)
        for lo in range(0, len(texts), 128):
            docs = [t.lower().split() for t in texts[lo:lo + 128]]
            self.remember({w for d in docs for w in d})
            known, sides = self.known
            windows = [self.border.windows(d, np.fromiter(map(sides.__getitem__, d), np.int64, len(d))) for d in docs]
            self.remember({w for ws in windows for w in ws}, windows=True)
            for i, (d, ws) in enumerate(zip(docs, windows)):
                got = list(map(known.__getitem__, d))
                best = max(got, default=NOTHING)
                if got.count(NOTHING) > 2 and (row := letter_rows(d, got)):  # single letters alone have no margin
                    best = max(best, float(self.judge(row).max()))
                if ws:
                    best = max(best, max(map(known.__getitem__, ws)))
                out[lo + i] = max(best, self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), 0.5 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(texts) + self.b, -30, 30)))


def telling(docs: list[set[str]], y: np.ndarray, least: float = 0.75) -> list[str]:
    """Words of toxic documents that clean ones hardly have, the most telling first.

    Each word found halves what the documents that hold it still count, so that the other words of a text with many copies don't follow."""
    where: dict[str, list[int]] = {}
    cold = Counter(w for d, t in zip(docs, y) if not t for w in d)
    hot = [i for i in range(len(docs)) if y[i]]
    for i in hot:
        for w in docs[i]:
            if len(w) > 2:
                where.setdefault(w, []).append(i)
    n1, n0 = max(1, len(hot)), max(1, len(docs) - len(hot))
    where = {w: v for w, v in where.items() if len(v) >= 3 and len(v) / n1 > OFTENER * cold[w] / n0}
    gain = {w: math.log((len(v) / n1 + 1e-4) / (cold[w] / n0 + 1e-4)) for w, v in where.items()}
    counts, out = np.ones(len(docs)), []
    heap = [(-gain[w] * len(v), w) for w, v in where.items()]
    heapq.heapify(heap)
    while heap:
        _, w = heapq.heappop(heap)
        now = float(counts[where[w]].sum())
        if now < least:
            continue
        if heap and -gain[w] * now > heap[0][0]:  # it has lost since it was put there
            heapq.heappush(heap, (-gain[w] * now, w))
            continue
        out.append(w)
        counts[where[w]] /= 2
    return out


def gapped(word: str, rng: np.random.Generator) -> str:
    """The word with one or two characters inserted or doubled."""
    for _ in range(int(rng.integers(1, 3))):
        i = int(rng.integers(1, len(word)))
        word = word[:i] + (word[i - 1] if rng.random() < 0.4 else "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(0, 36))]) + word[i:]
    return word[:LONGEST]


def spaced(word: str) -> list[str]:
    """The word with a space inside, at each place."""
    return [f"{word[:i]} {word[i:]}"[:LONGEST] for i in range(1, len(word))] if " " not in word else []


def disguised(text: str, clue: set[str], rng: np.random.Generator) -> str:
    """The text with each of its telling words gapped or split."""
    out = []
    for w in text.split():
        us = units(w)
        if len(us) == 1 and us[0] in clue:
            w = gapped(us[0], rng) if rng.random() < 0.5 else str(rng.choice(spaced(us[0])))
        out.append(w)
    return " ".join(out)


def confirmed(clues: list[str], docs: list[set[str]], y: np.ndarray) -> list[str]:
    """The clues that documents they were not chosen from don't speak against: those that are not in clean ones, or in toxic ones far more often."""
    hot, cold = (Counter(c for d, t in zip(docs, y) if t == v for c in d) for v in (1, 0))
    n1, n0 = max(1, int(y.sum())), max(1, len(y) - int(y.sum()))
    return [c for c in clues if not cold[c] or hot[c] / n1 > OFTENER * cold[c] / n0]


def newton_svm(x: np.ndarray, t: np.ndarray, weight: np.ndarray, reg: float = REG, rounds: int = 50) -> np.ndarray:
    """The linear machine of least squared hinge loss: Newton steps in the primal until the support vectors stay the same."""
    w, support = np.zeros(x.shape[1]), None
    margin = lambda v: np.concatenate([x[i:i + 8192] @ v for i in range(0, len(x), 8192)])  # noqa: E731  (no second copy of x)
    for _ in range(rounds):
        now = t * margin(w) < 1
        if support is not None and (now == support).all():
            break
        support = now
        gram, side = reg * np.eye(x.shape[1]), np.zeros(x.shape[1])
        for i in range(0, len(x), 8192):
            on = now[i:i + 8192]
            xs = x[i:i + 8192][on].astype(float)
            xw = xs * weight[i:i + 8192][on, None]
            gram += xs.T @ xw
            side += xw.T @ t[i:i + 8192][on]
        new = np.linalg.solve(gram, side)
        loss = lambda v: (weight * np.maximum(0, 1 - t * margin(v)) ** 2).sum() + reg * v @ v
        rate = 1.0
        while rate > 1e-3 and loss(w + rate * (new - w)) > loss(w) + 1e-15:
            rate /= 2
        w = w + rate * (new - w)
    return w


def train(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    none = Model(None, np.zeros(0), 0.0, 1.0, 0.0)
    once = dict(zip(texts, labels))  # a text that has copies speaks once
    texts, y = list(once), np.array(list(once.values()), int)
    if not len(y) or y.min() == y.max():
        return none
    rng = np.random.default_rng(seed)
    val = np.arange(len(y)) % 4 == 3
    same: dict[str, str] = {}  # one object a word
    docs = [[[same.setdefault(u, u) for u in units(s)] for s in SENTENCE.split(t)] for t in texts]
    words = [{u for s in d for u in s} for d in docs]
    fit = np.flatnonzero(~val)
    clues = telling([words[i] for i in fit], y[fit])
    # windows of toxic documents that no word explains, if clean documents don't have them
    clue = set(clues)
    rest = [i for i in fit if y[i] and not words[i] & clue]
    pairs = {i: {p for s in docs[i] for p in neighbours(s)} for i in rest}
    often = Counter(p for ps in pairs.values() for p in ps)
    maybe = {p for p, n in often.items() if n >= 3}
    if maybe:
        cold = [{p for s in docs[i] for p in neighbours(s)} & maybe for i in fit if not y[i]]
        clues += telling([pairs[i] & maybe for i in rest] + cold, np.array([1] * len(rest) + [0] * len(cold)))
    asked = set(clues)
    clues = confirmed(clues, [(words[i] | ({p for s in docs[i] for p in neighbours(s)} if maybe else set())) & asked for i in np.flatnonzero(val)], y[val])
    if not clues:
        return none
    # landmarks: telling words unlike each other until none is left without one, then frequent clean words
    marks = Landmarks(clues)
    k = marks.kernel(clues)
    taken: list[int] = []
    for i in range(len(clues)):
        if not taken or k[i, taken].max() < LIKE:
            taken.append(i)
    chosen = [clues[i] for i in taken]
    border = Border(chosen)
    clean = Counter(u for i in fit if not y[i] for u in words[i] if 3 < len(u) <= LONGEST)
    chosen += [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if w not in chosen][:max(CLEAN_LANDMARKS, len(chosen) // 3)]
    marks = Landmarks(chosen)
    gram = marks.kernel(chosen).astype(float)
    gram = (gram + gram.T) / 2
    val_, vec = np.linalg.eigh(gram + 1e-3 * np.eye(len(chosen)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val_, 1e-3))) @ vec.T

    # labelled sentences, each by its best unit: the clue it holds in a toxic document, any of its units in a clean one
    clue = set(clues)
    hot = Counter(u for i in fit if y[i] for s in docs[i] for u in [*s, *neighbours(s)] if u in clue)
    cold = Counter(u for i in fit if not y[i] for s in docs[i] for u in s)
    sides = {u: border.sides(u, [u]) for u in cold}
    for i in fit:
        if not y[i]:
            for s in docs[i]:
                cold.update(border.windows(s, np.array([sides[u] for u in s], np.int64)))
    more = [(v, u) for u in hot for v in [gapped(u, rng) for _ in range(4)] + spaced(u)]
    pos = list(hot) + [v for v, _ in more]
    neg = sorted((u for u in cold if u not in hot), key=lambda u: (-cold[u], u))[:UNITS]  # a bound on what the driver trains with
    del docs, words
    x = np.concatenate([marks.kernel(pos), marks.kernel(neg)]) @ root.astype(np.float32)
    t = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
    often = np.sqrt([*hot.values(), *[hot[u] / 2 for _, u in more], *[cold[u] for u in neg]])
    weight = np.where(t > 0, often / often[:len(pos)].sum(), often / max(1.0, often[len(pos):].sum()))
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    x, t, weight = np.vstack([x, np.eye(1, x.shape[1], x.shape[1] - 1, dtype=np.float32)]), np.append(t, -1.0), np.append(weight, 1.0)
    w = newton_svm(x, t, weight)
    # a rare clean word that looks like an insult weighs little among all words; a document is judged by its worst one, so such words count more in a second round
    weight = weight * np.where((t < 0) & (x @ w > -HARD), HARDER, 1)
    w = newton_svm(x, t, weight)
    w, b = w[:-1], w[-1]
    model = Model(marks, (root @ w).astype(np.float32), float(b), 1.0, 0.0, border)
    # documents that training never saw, toxic ones also with their insults gapped or split
    seen = [(texts[i], y[i]) for i in np.flatnonzero(val)]
    seen += [(disguised(t, clue, rng), 1) for t, v in seen if v for _ in range(2)]
    margin, yy = model.margins([t for t, _ in seen]), np.array([v for _, v in seen], int)
    if 0 < yy.sum() < len(yy):
        up, target = np.clip(margin, -3, 3), np.where(yy > 0, (yy.sum() + 1) / (yy.sum() + 2), 1 / (len(yy) - yy.sum() + 2))
        best = min(((a, c) for a in np.linspace(0.5, 8, 31) for c in np.linspace(-6, 6, 49)), key=lambda ac: np.mean(np.logaddexp(0, ac[0] * up + ac[1]) - target * (ac[0] * up + ac[1])))
        model.a, model.b = map(float, best)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    return train(*labelled_sample(docs, labels, label, train_docs, train_chars))
