"""Order MinHash fingerprints: sensitive to edit distance, not to the set of k-mers alone.

Every k-mer of a text (k code points; a shorter text is one k-mer) is numbered by its occurrence, and (k-mer, number) is hashed. The hash space
has `size` equal ranges; from each the `ell` minimal ones are selected, put back in the order they have in the text, and the tuple of
their k-mers is hashed to a 16-bit component. A range with fewer than `ell` takes the missing ones from the ranges after it, so that short and long
texts are fingerprinted by one rule. The likeness of two fingerprints is the share of equal components.

A text's `size` samples come from one hash instead of `size` independent ones: a k-mer is looked at in one range only, so a fingerprint costs one pass. The tests hold
it against independent samples. Neighbouring components of a short text may share k-mers, which changes no expectation, only the variance.

The next document (descending doc_id, cyclic) is met without a global window: rows are dealt by range of doc_id, the bounds being ids that
occur, and the row at a bound is dealt to the following range too, as the one to look ahead to. Rows that repeat one doc_id are in one range and stream through its task.

Defined results: a null text is empty, and has the fingerprint of the empty text; rows of one doc_id are ordered by text; a single row is its
own next document; a null doc_id comes after all others in descending order; an empty table gives an empty table.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pieces, slim

K, ELL, SIZE = 5, 2, 64
#: Rows that one range of ids holds, about.
ROWS_A_RANGE = 500
#: Bounds of ranges that the driver and a plan hold, as numbers; past MOST_RANGES x ROWS_A_RANGE rows a range has more rows, which are streamed, never held together.
MOST_RANGES, FAN = 1 << 16, 256
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def fingerprint(text: str, k: int = K, ell: int = ELL, size: int = SIZE) -> np.ndarray:
    """`size` components, uint16."""
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(cp) - k + 1
    if n < 1:
        h = np.array([int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")], np.uint64)
        n = 1
    else:
        h = np.zeros(n, np.uint64)
        for i in range(k):  # a polynomial over k code points, wrapping
            h *= _P
            h += cp[i:i + n]
        _mix(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    by_kmer = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    same, pos = by_kmer & ~low, by_kmer & low
    first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    rank = _mix(h[pos.astype(np.int64)] + _P * (number.astype(np.uint64) + np.uint64(1)))
    order = np.sort((rank & ~low) | pos)
    at = (order & low).astype(np.int64)
    # the ell smallest of each range; a range that has fewer goes on into the next ones, cyclically
    begin = np.searchsorted(order, np.arange(size, dtype=np.uint64) * np.uint64(2**64 // size))
    pick = (begin[:, None] + np.arange(ell)[None, :]) % n
    chosen = np.sort(at[pick], axis=1)
    out = np.full(size, 0, np.uint64) + np.arange(1, size + 1, dtype=np.uint64)
    for j in range(ell):
        out = _mix(out * _P + h[chosen[:, j]])
    return (out >> np.uint64(48)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by the first as many (or all) of the next document."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def numbers(values: list, kind: str) -> Column:
    """A constant array; one literal, however many values there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def tree(key: Column, cuts: list[int], lo: int, hi: int) -> Column:
    """How many of cuts[lo:hi] are below the key, plus lo, by a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key <= cuts[mid], tree(key, cuts, lo, mid)).otherwise(tree(key, cuts, mid + 1, hi))


def near(key: Column, cuts: list[int]) -> tuple[Column, Column]:
    """The block of cuts that the key falls into, an array, and the number of cuts before it."""
    last = [cuts[min(i + FAN, len(cuts)) - 1] for i in range(0, len(cuts), FAN)]
    at = F.least(tree(key, last, 0, len(last)), F.lit(len(last) - 1)) * FAN
    return F.slice(numbers(cuts, "bigint"), at + 1, F.lit(FAN)), at


def ranged(rows: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, text, key, range, ahead: every row in its range of ids, and again, `ahead`, in the range that it is looked ahead to from."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    n, top = rows.agg(F.count(F.lit(1)), F.max(key)).first()
    parts = max(1, min(MOST_RANGES, -(-n // rows_a_range)))
    share = [i / parts for i in range(1, parts)]
    cuts = sorted({c for c in rows.agg(F.percentile_approx(key, numbers(share, "double"), max(10_000, 10 * parts))).first()[0] if c < top}) if share else []
    # range i holds cuts[i - 1] < key <= cuts[i]; a cut is an id that occurs, so the first one of a range is known to be it
    place = lambda r, ahead: F.array(F.struct(r.cast("int").alias("range"), F.lit(ahead).alias("ahead")))
    none = F.array().cast("array<struct<range:int,ahead:boolean>>")
    rows = rows.withColumn("key", key)
    if cuts:
        block, before = near(F.col("key"), cuts)
        rows = rows.withColumn("block", block).withColumn("own", before + F.size(F.filter("block", lambda c: c < F.col("key")))).withColumn("cut", F.array_contains("block", F.col("key")))
    else:
        rows = rows.withColumn("own", F.lit(0)).withColumn("cut", F.lit(False))
    to = F.concat(place(F.col("own"), False), F.when(F.col("cut"), place(F.col("own") + 1, True)).otherwise(none), F.when(F.col("key") == top, place(F.lit(0), True)).otherwise(none) if n else none)
    return rows.withColumn("to", F.explode(to)).select("doc_id", "text", "key", "to.range", "to.ahead")


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, ell: int = ELL, size: int = SIZE, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    rows = ranged(slim(docs, text_col), rows_a_range)
    rows = rows.repartition("range").sortWithinPartitions("range", "ahead", F.col("key").desc(), "text")

    def walk(batches):
        at, held, out = None, None, []
        for batch in batches:
            for b in pieces(batch):
                for doc, text, r, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "ahead"))):
                    if r != at:
                        at, held = r, None
                    if ahead and held is None:
                        continue
                    fp = fingerprint(text, k, ell, size)
                    if held:
                        id0, text0, fp0 = held
                        new = edited(text0, text)
                        fp1 = fingerprint(new, k, ell, size)
                        out.append((id0, len(text0), hashlib.sha256(new.encode()).hexdigest(), fp0.tobytes().hex(), fp1.tobytes().hex(), likeness(fp0, fp1), likeness(fp0, fp)))
                    held = None if ahead else (doc, text, fp)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
                    out = []

    return rows.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
