"""Best-two-fit packing of documents into sequences of at most `capacity` tokens.

Documents are tokenised once, in parallel; a longer document is cut into full pieces, its first piece taking the rest. Pieces of one length
are interchangeable, so the plan needs only how many there are of each length: at most `capacity` numbers, which is all the driver sees.
A bin is filled greedily with the largest lengths that fit; then its smallest document is replaced by the two unpacked ones that
fit its expanded gap most tightly. The bin's pattern is repeated while every length in it lasts, so the plan has a few thousand
patterns at most, at any number of documents. A piece finds its bin from its rank among the pieces of its length.

Defined results: a null or empty text is one piece, the end id alone; ids may repeat; an empty table gives no pieces.
"""

import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.bpe import encode
from cohortline.llm.common import pieces, slim, written

CAPACITY, END_ID = 1024, 2


def best_two(avail: list[int], room: int, least: int) -> tuple[int, int] | None:
    """The two lengths of `avail` (ascending, each with a count over 0 taken care of by the caller) with the largest sum in (least, room]."""
    i, j, best, top = 0, len(avail) - 1, None, least
    while i <= j:
        s = avail[i] + avail[j]
        if s > room:
            j -= 1
            continue
        if s > top:
            best, top = (avail[i], avail[j]), s
            if top == room:
                break
        i += 1
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths of the bin) for each pattern; every piece is in one bin."""
    left = {k: v for k, v in counts.items() if v > 0}
    out: list[tuple[int, list[int]]] = []
    while left:
        used: Counter[int] = Counter()
        free = lambda k: left.get(k, 0) - used[k]
        bin_, gap = [], capacity
        order = sorted(left, reverse=True)
        for k in order:
            while k <= gap and free(k) > 0:
                bin_.append(k)
                used[k] += 1
                gap -= k
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            avail = [k for k in reversed(order) if k < room and free(k) > 0]
            pair = best_two(avail, room, smallest)
            if pair and pair[0] == pair[1] and free(pair[0]) < 2:
                pair = best_two([k for k in avail if k != pair[0] or free(k) > 1], room, smallest)
                pair = None if pair and pair[0] == pair[1] and free(pair[0]) < 2 else pair
            if pair:
                bin_[-1:] = [pair[1], pair[0]]
                used[smallest] -= 1
                used[pair[0]] += 1
                used[pair[1]] += 1
        need = Counter(bin_)
        times = min(left[k] // n for k, n in need.items())
        out.append((times, sorted(bin_, reverse=True)))
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def placing(patterns: list[tuple[int, list[int]]]) -> tuple[dict[int, tuple], int]:
    """For each length, arrays (first rank, first sequence, copies in a bin, first offset) by pattern; the number of sequences."""
    table: dict[int, list[list[int]]] = {}
    base, seen = 0, Counter()
    for times, lengths in patterns:
        offset = 0
        for k, n in sorted(Counter(lengths).items(), reverse=True):
            table.setdefault(k, []).append([seen[k], base, n, offset])
            seen[k] += times * n
            offset += n * k
        base += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in table.items()}, base


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """The added tokens of the tokenizer file beside a rank file, and a pattern of them, longest first."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is around them are not read")
    ids = {t["content"]: t["id"] for t in added}
    return ids, re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None


def token_ids(text: str, path: str) -> list[int]:
    """The ids that the tokenizer file gives: added tokens in the text are one id each, what is between them is encoded by itself."""
    ids, every = added_tokens(path)
    if every is None or not every.search(text):
        return encode(text, path)
    return [i for part in every.split(text) if part for i in ([ids[part]] if part in ids else encode(part, path))]


def tokenised(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and part, turn: its place among the pieces of its length in its task."""

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for b in pieces(batch):
                rows = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.asarray([*token_ids(t, path), end_id], "<u4")
                    first = len(ids) % capacity or capacity
                    at, p = 0, 0
                    while at < len(ids):
                        n = first if p == 0 else capacity
                        rows.append((doc, p, at, n, zlib.crc32(ids[at:at + n].tobytes()), seen[n]))
                        seen[n] += 1
                        at, p = at + n, p + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([*cols, [part] * len(rows)], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "turn", "part"])

    return slim(docs, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long, part int")


def pack(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = written(tokenised(docs, path, text_col, capacity, end_id))  # part and turn must be the same whenever they are read
    sizes = parts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table, _ = placing(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = parts.join(first, ["length", "part"])

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["first"] + pdf["turn"]).to_numpy()
            seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                k = int(length[rows[0]])
                start, base, copies, offset = table[k]
                i = np.searchsorted(start, rank[rows], side="right") - 1
                local = rank[rows] - start[i]
                seq[rows], off[rows] = base[i] + local // copies[i], offset[i] + local % copies[i] * k
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "length": length, "ids_crc32": pdf["ids_crc32"], "sequence_id": seq, "offset": off})

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
