"""Ratcliff-Obershelp similarity of names: the one function that no built-in expresses."""

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.scalars import lower_tokens, text

#: Comparators that say nothing about an asset (fixed values).
GENERIC = ["placebo", "saline", "normal saline", "standard of care", "soc", "active comparator", "comparator"]


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=200_000)
def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio is at the threshold or above: its upper bounds, from lengths and from letters, are asked first. Names repeat, so answers are kept."""
    if a == b:
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def matches(a: str, b: str, threshold: float) -> bool:
    """Whole strings first, then any pair of tokens that aren't generic."""
    if not a or not b:
        return False
    a, b = a.lower(), b.lower()
    if reaches(a, b, threshold):
        return True
    own = []
    for s in (a, b):
        every = [x.strip() for x in s.split(";") if x.strip()]
        own.append([x for x in every if x not in GENERIC] or every)
    return any(reaches(x, y, threshold) for x in own[0] for y in own[1])


def full_ratio(a: Column, b: Column) -> Column:
    """Similarity of whole strings, lower-cased, the anchor's first: the function is not symmetric."""

    @F.pandas_udf("double")
    def slow(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio((p or "").lower(), (q or "").lower()) for p, q in zip(x, y)], dtype="float64")

    return slow(a, b)


#: Characters that are counted together; all others are one more group.
LETTER_GROUPS = [*"abcdefghijklmnopqrstuvwxyz", "0123456789", " -;,.()/"]


def letter_counts(c: Column) -> Column:
    """How many characters of the lower-cased text fall into each group: made once a name, compared for each pair."""
    low = F.lower(text(c))
    counts = [F.length(low) - F.length(F.translate(low, g, "")) for g in LETTER_GROUPS]
    return F.array(*[x.cast("short") for x in [*counts, F.length(F.translate(low, "".join(LETTER_GROUPS), ""))]])


def may_reach(a_length: Column, a_counts: Column, b_length: Column, b_counts: Column, threshold: float = 0.85) -> Column:
    """Whether lengths and letters allow the ratio: it is at most twice the letters in common over both lengths. JVM-side; characters that share a group only raise the bound."""
    common = F.aggregate(F.zip_with(a_counts, b_counts, lambda p, q: F.least(p, q)), F.lit(0), lambda n, x: n + x)
    wanted = F.lit(threshold) * (a_length + b_length) - 1e-6
    return F.when(2.0 * F.least(a_length, b_length) >= wanted, 2.0 * common >= wanted).otherwise(False)


#: Columns of a table of parts of names; pairs of names that are held against one another at once; characters that a word of bits has room for; characters from which difflib leaves out frequent ones.
_HASHED, _AT_ONCE, _BITS, _JUNK_FROM = 256, 1 << 20, 63, 200


def _parts(names: list[str], n: int) -> np.ndarray:
    """A row a name: its parts of n characters, each with how often it came before, counted in hashed columns. The product of two rows is at least the number of parts in common."""
    out = np.zeros((len(names), _HASHED), np.float32)
    for i, name in enumerate(names):
        seen: dict = {}
        for k in range(len(name) - n + 1):
            part = name[k:k + n]
            seen[part] = before = seen.get(part, -1) + 1
            out[i, hash((part, before)) % _HASHED] += 1
    return out


def _codes(names: list[str]) -> np.ndarray:
    """A row a name: its characters, and -1 behind its end."""
    out = np.full((len(names), max(map(len, names), default=0)), -1, np.int32)
    for i, name in enumerate(names):
        out[i, :len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _in_order(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (i, j): the length of the longest common subsequence of each row i of x (of `size` characters, at most _BITS) and row j of y, all at once in words of bits.
    Characters beyond ASCII count as equal, which only raises it."""
    masks = np.zeros((len(x), 129), np.uint64)
    for k in range(x.shape[1]):
        there = np.flatnonzero(x[:, k] >= 0)
        masks[there, np.minimum(x[there, k], 127)] |= np.uint64(1 << k)
    return lambda i, j: _subsequence(masks, np.where(y < 0, 128, np.minimum(y, 127)), size, i, j)


def _subsequence(masks: np.ndarray, y: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    v = np.full(len(i), ~np.uint64(0))
    for k in range(y.shape[1]):
        m = masks[i, y[j, k]]
        v = (v + (v & m)) | (v & ~m)
    return np.bitwise_count(~v & ((np.uint64(1) << size[i].astype(np.uint64)) - np.uint64(1)))


def matched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many characters difflib matches in each pair of rows (codes, -1 behind the end) of names of under 200 characters: of a pair's longest blocks the first, then what is left and right of it."""
    total = np.zeros(len(x), np.int64)
    pair = np.arange(len(x))
    ends = lambda c: (c >= 0).sum(axis=1)
    x_from, x_to, y_from, y_to = np.zeros(len(x), int), ends(x), np.zeros(len(x), int), ends(y)
    while len(pair):
        cut = lambda c, begin, end, pad: np.where((at := begin[:, None] + np.arange((end - begin).max())) < end[:, None], c[pair[:, None], np.minimum(at, c.shape[1] - 1)], pad)
        a, b = cut(x, x_from, x_to, -1), cut(y, y_from, y_to, -2)
        run, best, i_best, j_best = np.zeros((len(pair), b.shape[1] + 1), np.uint8), np.zeros(len(pair), np.uint8), np.zeros(len(pair), int), np.zeros(len(pair), int)
        for i in range(a.shape[1]):
            run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, i, None])
            most = run.max(axis=1)
            more = np.flatnonzero(most > best)
            best[more], i_best[more], j_best[more] = most[more], i + 1, run[more].argmax(axis=1)
        size = best.astype(int)
        np.add.at(total, pair, size)
        i, j = x_from + i_best - size, y_from + j_best - size  # where the block begins
        parts = [(pair, x_from, i, y_from, j), (pair, i + size, x_to, j + size, y_to)]
        keep = [(size > 0) & (p[2] > p[1]) & (p[4] > p[3]) for p in parts]
        pair, x_from, x_to, y_from, y_to = (np.concatenate([p[n][k] for p, k in zip(parts, keep)]) for n in range(5))
    return total


def alike(xs: list[str], ys: list[str], threshold: float, asked=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs whose ratio, x first, is at the threshold or above; `asked(i)` of some rows of xs: which pairs are asked for at all, as a matrix.

    Bounds leave few pairs to be matched: the characters in common; the pairs of neighbours in common, as each block of M characters has all but one of its own, and there are at most as many more
    blocks than one as characters that are in none; the longest common subsequence. What is left is matched in arrays, longer names by difflib itself."""
    if not xs or not ys:
        return
    tables = [(_parts(xs, n), _parts(ys, n).T) for n in (1, 2)]
    x_codes, y_codes = _codes(xs), _codes(ys)
    x_size, y_size = (np.array([len(n) for n in names]) for names in (xs, ys))
    short = np.flatnonzero(x_size <= _BITS)
    in_order = _in_order(np.where(x_size[:, None] <= _BITS, x_codes, -1)[:, :_BITS], y_codes[:, :_JUNK_FROM], np.minimum(x_size, _BITS)) if len(short) else None
    by_size = np.argsort(x_size, kind="stable")
    step = max(1, _AT_ONCE // len(ys))
    for begin in range(0, len(xs), step):
        at = by_size[begin:begin + step]
        both = x_size[at, None] + y_size
        wanted = threshold * both / 2 - 1e-6
        may = np.minimum(x_size[at, None], y_size) >= wanted
        if asked is not None:
            may &= asked(at)
        if not may.any():
            continue
        may &= tables[0][0][at] @ tables[0][1] >= wanted
        may &= tables[1][0][at] @ tables[1][1] >= 3 * wanted - both - 1 - 1e-6
        i, j = np.nonzero(may)
        i = at[i]
        far = (x_size[i] > _BITS) | (y_size[j] >= _JUNK_FROM)
        slow = [(p, q) for p, q in zip(i[far].tolist(), j[far].tolist()) if reaches(xs[p], ys[q], threshold)]
        if slow:
            yield tuple(np.array(slow).T)
        i, j = i[~far], j[~far]
        for k in range(0, len(i), _AT_ONCE // 8):
            p, q = i[k:k + _AT_ONCE // 8], j[k:k + _AT_ONCE // 8]
            near = in_order(p, q) >= threshold * (x_size[p] + y_size[q]) / 2 - 1e-6
            p, q = p[near], q[near]
            if len(p):
                both = x_size[p] + y_size[q]
                hit = (2.0 * matched(x_codes[p][:, :_BITS], y_codes[q][:, :_JUNK_FROM]) / np.maximum(both, 1) >= threshold) | (both == 0)
                yield p[hit], q[hit]


def whole_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Whether the ratio of whole lower-cased strings is at the threshold or above; nulls are not asked. Pairs that repeat in a batch are compared once, and answers are kept."""

    @F.pandas_udf("boolean")
    def slow(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y))
        known = {p: p[0] is not None and reaches(p[0].lower(), p[1].lower(), threshold) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype="bool")

    return slow.asNondeterministic()(a, b)  # it is not: as in fuzzy_match


def numbered_letters(c: Column) -> Column:
    """The letters of a token, each with how often it came before, so that sets of them meet as multisets do; the rarer ones first."""
    letters = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    numbered = F.transform(letters, lambda x, i: F.struct((F.array_position(letters, x) - i).cast("int").alias("before"), x.alias("letter")))
    return F.transform(F.array_sort(numbered), lambda x: F.concat(x["letter"], x["before"].cast("string")))


def alike_tokens(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(x, y): tokens of `left` and `right` (column `token`) that are not equal and whose ratio, x first, is at the threshold or above.

    Each different token takes part once. Tokens meet by a prefix filter: two with at least n letters in common share one of their first (size - n + 1) letters in any order that both
    keep; the ratio sets n from the length of either. Then lengths and all letters are compared in the JVM, and Python sees what is left."""
    c, t = F.col, float(threshold)

    def prefixes(tokens: DataFrame, name: str) -> DataFrame:
        every = tokens.select(c("token").alias(name)).distinct().where(c(name) != "").withColumn("letters", numbered_letters(c(name)))
        least = F.ceil(F.length(name) * (t / (2 - t)) - 1e-6)
        return every.withColumn("first", F.explode(F.slice("letters", 1, F.greatest(F.size("letters") - least + 1, F.lit(1)).cast("int")))).withColumnRenamed("letters", f"{name}_letters")

    met = prefixes(left, "x").join(prefixes(right, "y"), "first").where(c("x") != c("y"))
    wanted = F.lit(t) * (F.length("x") + F.length("y")) - 1e-6
    fits = (2.0 * F.least(F.length("x"), F.length("y")) >= wanted) & (2.0 * F.size(F.array_intersect("x_letters", "y_letters")) >= wanted)
    return met.where(fits).select("x", "y").distinct().where(whole_match(c("x"), c("y"), threshold))


def fuzzy_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    @F.pandas_udf("boolean")
    def slow(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([matches(p or "", q or "", threshold) for p, q in zip(x, y)], dtype="bool")

    return slow.asNondeterministic()(a, b)  # it is not: this keeps the optimizer from moving it into a join's condition, where Python cannot run


def effective_tokens(c: Column) -> Column:
    """Tokens without generic comparators, unless nothing else is left."""
    every = lower_tokens(c)
    own = F.filter(every, lambda t: ~t.isin(GENERIC))
    return F.when(F.size(own) == 0, every).otherwise(own)


def exact_match(a: Column, b: Column) -> Column:
    """Equal strings or a shared effective token: what the fuzzy match surely accepts, JVM-side."""
    x, y = text(a), text(b)
    return (x != "") & (y != "") & ((F.lower(x) == F.lower(y)) | F.arrays_overlap(effective_tokens(a), effective_tokens(b)))


def may_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Whether lengths allow a match: a ratio is at most twice the shorter length over both. JVM-side, no pair of names is refused that could reach it."""
    x, y = F.lower(text(a)), F.lower(text(b))
    fits = lambda p, q: 2.0 * F.least(p, q) + 1e-6 >= F.lit(threshold) * (p + q)
    lengths = lambda c: F.array_distinct(F.transform(effective_tokens(c), F.length))
    tokens = F.exists(lengths(a), lambda p: F.exists(lengths(b), lambda q: fits(p, q)))
    return (x != "") & (y != "") & (fits(F.length(x), F.length(y)) | tokens)
