"""Periodic runs of words by divide and conquer after Main and Lorentz, and texts with their runs collapsed.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping q, of at least max(`shortest`, `times` * q) words.

1. Words (split at ASCII white space) are interned: a document becomes an array of numbers.
2. Segments are halved, all segments of a level at once. A run that lies in a segment crosses its midpoint or lies in one half. One of at least four
   periods that crosses it has two periods or more on one side of it: the Z-function of the right half, or of the reversed left half, is at least p at p.
3. Z-functions start with comparisons of all positions of a level together, which settle nearly all of them; the few positions that stay equal for
   `AHEAD` words are compared as slices, and a half that has many of them gets the linear Z-algorithm.
4. What is found is extended to both sides as far as its period holds, in the whole document. A candidate inside a known run whose period divides its own is that
   run again. Intervals are deduplicated; the smallest period stays.

The time is O(n log n) in the words of a document, its memory O(n); documents are independent, so nothing is shuffled.

Defined results: null and empty texts have no words and no runs, and collapse to an empty text. Rows that repeat are each worked on; a null doc_id stays null (and is
never edited by `planted`). Of runs with the same exponent the one that starts first is the best, then the one with the smaller period. Columns other than
doc_id and text don't matter. An empty table gives an empty table.
"""

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pieces, slim

#: A run has at least so many words, and at least so many periods. Fewer than four periods need not have two on one side of a midpoint.
SHORTEST, TIMES = 6, 4
#: Words that Z-functions of a level compare for all positions together, and positions of a half from which the linear algorithm takes over.
AHEAD, MANY = 8, 32
#: Known runs are looked up by blocks of so many words; any word lies in few runs of four periods.
NEAR = 64


def z_function(s: list[int]) -> list[int]:
    """z[i] is the length of the longest common prefix of s and s[i:]; z[0] is len(s)."""
    n = len(s)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _need(p: np.ndarray, shortest: int) -> np.ndarray:
    """The Z-value at p of the side that holds the larger half of a run."""
    return np.maximum(-(-shortest // 2) - p, p)


def _holding(s: np.ndarray, mid: np.ndarray, half: np.ndarray, step: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, p) with a Z-value of at least `need` at p, for halves that start at `mid` and go on by `step` (1: to the right, -1: reversed to the left)."""
    counts = half // 2
    segment = np.repeat(np.arange(len(mid)), counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    at = mid[segment]
    need = _need(p, shortest)
    alive = np.flatnonzero((s[at + step * p] == s[at]) & (p + need <= half[segment]))
    segment, p, need = segment[alive], p[alive], need[alive]
    done_s, done_p = [], []
    for k in range(1, AHEAD + 1):
        over = need <= k
        done_s.append(segment[over]), done_p.append(p[over])
        segment, p, need = segment[~over], p[~over], need[~over]
        at = mid[segment] + step * k
        same = s[at] == s[at + step * p]
        segment, p, need = segment[same], p[same], need[same]
    # the few that stay equal: as slices, or by the linear algorithm where there are many
    cut = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
    for lo, hi in zip(cut[:-1], cut[1:]):
        m, ps, n = int(mid[segment[lo]]), p[lo:hi], int(half[segment[lo]])
        if hi - lo > MANY:
            part = s[m:m + n] if step > 0 else s[m - n + 1:m + 1][::-1]
            held = ps[np.array(z_function(part.tolist()))[ps] >= need[lo:hi]]
        else:
            same = (lambda q: np.array_equal(s[m:m + q], s[m + q:m + 2 * q])) if step > 0 else (lambda q: np.array_equal(s[m - q + 1:m + 1], s[m - 2 * q + 1:m - q + 1]))
            held = np.array([q for q in ps.tolist() if same(q)], int)
        done_s.append(np.full(len(held), segment[lo])), done_p.append(held)
    segment, p = np.concatenate(done_s), np.concatenate(done_p)
    order = np.lexsort((p, segment))
    return segment[order], p[order]


def _same_for(s: np.ndarray, i: int, p: int, end: int) -> int:
    """How many words from i on, before `end`, equal those p before them."""
    n, width = 0, 16
    while i + n < end:
        j = i + n
        w = min(width, end - j)
        off = np.flatnonzero(s[j:j + w] != s[j - p:j - p + w])
        if len(off):
            return n + int(off[0])
        n, width = n + w, width * 2
    return n


def _same_back(s: np.ndarray, i: int, p: int, start: int) -> int:
    """How many words before i, from `start` on, equal those p after them."""
    n, width = 0, 16
    while i - n > start:
        j = i - n
        w = min(width, j - start)
        off = np.flatnonzero(s[j - w:j] != s[j - w + p:j + p])
        if len(off):
            return n + w - 1 - int(off[-1])
        n, width = n + w, width * 2
    return n


def runs_of(s: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For documents s[bounds[i]:bounds[i + 1]] of interned words: their runs as (start, length, period), by start, then period."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need not hold two on one side of a midpoint")
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    known: dict[int, list[tuple[int, int, int]]] = {}
    lo, hi = bounds[:-1], bounds[1:]
    doc = np.arange(len(lo))
    while True:
        big = hi - lo >= shortest
        lo, hi, doc = lo[big], hi[big], doc[big]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        for step in (1, -1):
            at, half = (mid, hi - mid) if step > 0 else (mid - 1, mid - lo)
            segment, p = _holding(s, at, half, step, shortest)
            cut = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
            for i, j in zip(cut[:-1], cut[1:]):
                d, m, ps = int(doc[segment[i]]), int(mid[segment[i]]), p[i:j]
                a, b = (m + 0 * ps, m + 2 * ps) if step > 0 else (m - 2 * ps, m + 0 * ps)
                for x, y, q in known.get(m // NEAR, ()):
                    new = ~((ps % q == 0) & (a >= x) & (b <= y))
                    ps, a, b = ps[new], a[new], b[new]
                while len(ps):
                    q = int(ps[0])
                    y = int(b[0]) + _same_for(s, int(b[0]), q, int(bounds[d + 1]))
                    x = int(a[0]) - _same_back(s, int(a[0]), q, int(bounds[d]))
                    if y - x >= max(shortest, times * q) and found[d].get((x, y), q + 1) > q:
                        found[d][x, y] = q
                        for block in range(x // NEAR, y // NEAR + 1):
                            known.setdefault(block, []).append((x, y, q))
                    new = ~((ps % q == 0) & (a >= x) & (b <= y))
                    new[0] = False
                    ps, a, b = ps[new], a[new], b[new]
        lo, hi, doc = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([doc, doc])
    return [sorted((x - int(bounds[d]), y - x, q) for (x, y), q in r.items()) for d, r in enumerate(found)]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly; of equals the first, then the one with the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut down to its first period."""
    drop = np.zeros(n + 1, int)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop)[:n] == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document that a tenth of all ids, by their crc32, get in place of their own: from some word on they go round in a period."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a:a + p]
    return words[:a] + (once * (-(-(n - a) // len(once))))[:n - a]


RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shortest: int = SHORTEST, times: int = TIMES, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period), best (null without runs), collapsed (the words that stay, one space between them).
    `edit` changes a document's words first."""

    def work(batches):
        for batch in batches:
            for part in pieces(batch):
                ids = part.column(0).to_pylist()
                texts = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                if edit is not None:
                    texts = [edit(i, w) for i, w in zip(ids, texts)]
                known: dict[bytes, int] = {}
                s = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64)
                bounds = np.cumsum([0, *map(len, texts)])
                every = runs_of(s, bounds, shortest, times)
                collapsed = []
                for words, runs in zip(texts, every):
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    collapsed.append(b" ".join(words).decode())
                named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array([[named(r) for r in runs] for runs in every], pa.list_(_RUN)),
                     pa.array([named(best_of(runs)) for runs in every], _RUN), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    return slim(docs, text_col, id_col).mapInArrow(work, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The result of `find` in numbers and digests."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
