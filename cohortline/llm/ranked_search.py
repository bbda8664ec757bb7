"""Ranked lexical search: WAND over document shards, heaps of shards merged.

1. The items are taken in blocks of bounded size, so that what tasks hold of them is bounded however many there are. Of a block the words are numbered.
2. One pass over the documents counts their terms and writes postings of the block's words, (doc_id, length, words, counts), so texts are read once a block. N, L
   and the words' document frequencies come from that table.
3. Each task reads a part of the postings and cuts it into shards of at most `shard` documents. A shard holds a posting list for each word, sorted by document, with the
   score that each posting gives, and the largest of them: the word's maximum impact. WAND goes through the lists of an item in order of their current documents
   until the sum of maximum impacts reaches the heap's threshold; the document there is the pivot. No document before it can enter the heap, so all lists skip
   to it (by binary search), it is scored, and the lists go on. All items of a block take their steps together, as rows of arrays.
4. The heap of an item lives as long as its task, so its threshold only rises. The tasks' heaps are merged in two steps, over salts first.

All arithmetic but the logarithm is in whole numbers. Documents whose bound equals the threshold are scored, so ties are decided by doc_id alone.

Defined results: null texts and texts without words rank nowhere and don't count in N. An item without words, or with words of no document, has no rows. Rows of
`documents` that repeat are documents of their own; items that repeat with their id and text are one, items of one id with different texts are ranked apart. A null
doc_id is the lowest. Empty tables give empty tables. Columns other than doc_id, item_id and text don't matter.
"""

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import pieces, slim, written

TOP = 50
#: Items and bytes of their texts that a block holds, about; documents and postings of a shard.
BLOCK_ITEMS, BLOCK_BYTES, SHARD_DOCS, SHARD_POSTINGS = 2048, 4_000_000, 65_536, 4_000_000
#: A document's length counts half beside the mean.
MIX, SATURATION, SCALE = 50, 20, 1_000_000_000
SALTS = 64
#: Stands for a null doc_id.
LOWEST = -(2**63)
#: Of UTF-8 bytes: letters, digits and all bytes of other characters stay, A-Z are lowered, the rest is white space.
_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(w, tf, m):
    """What `tf` occurrences of a word of weight w give to the score of a document with length part m."""
    return w * ((SCALE * tf) // (1000 * tf + SATURATION * m))


def length_part(n, n_docs: int, total: int):
    return 100 - MIX + (MIX * n * n_docs) // total


@dataclass
class Heaps:
    """For each item the `top` best (score, -doc_id), the worst first."""

    top: int
    rows: list[list[tuple[int, int]]]

    def threshold(self) -> np.ndarray:
        return np.array([max(1, h[0][0]) if len(h) == self.top else 1 for h in self.rows], np.int64)

    def add(self, item: int, score: int, doc: int) -> int:
        h, row = self.rows[item], (score, -doc)
        if len(h) < self.top:
            heapq.heappush(h, row)
        elif row > h[0]:
            heapq.heapreplace(h, row)
        return max(1, h[0][0]) if len(h) == self.top else 1


def wand(items: list[np.ndarray], word: np.ndarray, doc: np.ndarray, gives: np.ndarray, n_docs: int, ids: np.ndarray, heaps: Heaps) -> int:
    """Puts the best documents of a shard into the heaps. Postings (word, doc, gives) are sorted by word, then document; `ids` are the documents'
    doc_ids. Returns how many documents were scored, over all items."""
    if not len(word):
        return 0
    words, first = np.unique(word, return_index=True)
    last, most = np.append(first[1:], len(word)), np.maximum.reduceat(gives, first)
    lists = [np.flatnonzero(np.isin(words, t, assume_unique=True)) for t in items]
    lanes = np.flatnonzero([len(x) for x in lists])
    if not len(lanes):
        return 0
    width = max(len(lists[i]) for i in lanes)
    shape = (len(lanes), width)
    at, end, bound, number = (np.zeros(shape, np.int64) for _ in range(4))
    for row, i in enumerate(lanes):
        x, k = lists[i], len(lists[i])
        at[row, :k], end[row, :k], bound[row, :k], number[row, :k] = first[x], last[x], most[x], words[x]
    # postings as one sorted array, so that all lists skip by one binary search; a sentinel ends it
    place = np.append(word.astype(np.int64) * n_docs + doc, np.iinfo(np.int64).max)
    over, give = np.append(doc, n_docs).astype(np.int64), np.append(gives, 0)
    current = np.where(at < end, over[at], n_docs)
    threshold, scored = heaps.threshold()[lanes], 0
    while len(lanes):
        order = np.argsort(current, axis=1)
        reached = np.cumsum(np.take_along_axis(bound, order, 1), axis=1) >= threshold[:, None]
        pivot = current[np.arange(len(lanes)), order[np.arange(len(lanes)), reached.argmax(1)]]
        alive = reached[:, -1] & (pivot < n_docs)
        if not alive.all():
            lanes, at, end, bound, number, current, threshold, pivot = (x[alive] for x in (lanes, at, end, bound, number, current, threshold, pivot))
            if not len(lanes):
                break
        r, c = np.nonzero(current < pivot[:, None])
        if len(r):
            to = np.minimum(np.searchsorted(place, number[r, c] * n_docs + pivot[r]), end[r, c])
            at[r, c], current[r, c] = to, np.where(to < end[r, c], over[to], n_docs)
        here = current == pivot[:, None]
        score = np.where(here, give[at], 0).sum(1)
        scored += len(lanes)
        for i in np.flatnonzero(score >= threshold).tolist():
            threshold[i] = heaps.add(int(lanes[i]), int(score[i]), int(ids[pivot[i]]))
        r, c = np.nonzero(here)
        to = at[r, c] + 1
        at[r, c], current[r, c] = to, np.where(to < end[r, c], over[to], n_docs)
        bound[current == n_docs] = 0  # an ended list gives nothing any more
    return scored


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """(doc_id, n, words, counts) of every document with a term: its length and the vocabulary's words in it."""

    def count(batches):
        for batch in batches:
            for b in pieces(batch):
                keep, ns, words, counts = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    every = terms(t)
                    if every:
                        got = Counter(map(vocabulary.get, every))
                        got.pop(None, None)
                        keep.append(i), ns.append(len(every)), words.append(list(got)), counts.append(list(got.values()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "words", "counts"])

    return slim(docs, text_col).mapInArrow(count, "doc_id long, n long, words array<int>, counts array<int>")


def _block(docs: DataFrame, items: list[list[bytes]], text_col: str, top: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each of a block's items, at most `top` a task and item."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in items for w in t}))}
    table = written(postings(docs, vocabulary, text_col))
    n_docs, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for word, df in table.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1))).collect():  # at most the block's words
        weights[word] = weight(n_docs, df)
    asked = spark.sparkContext.broadcast(([np.array(sorted({vocabulary[w] for w in t}), np.int64) for t in items], weights))

    def search(batches):
        wanted, w = asked.value
        heaps = Heaps(top, [[] for _ in wanted])

        def run(parts):
            ids = np.concatenate([p[0] for p in parts])
            n, size = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            word, tf = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            rank = np.empty(len(ids), np.int64)
            by_id = np.argsort(ids, kind="stable")
            rank[by_id] = np.arange(len(ids))
            doc = np.repeat(rank, size)
            gives = impact(w[word], tf, length_part(np.repeat(n, size), n_docs, total))
            order = np.lexsort((doc, word))
            wand(wanted, word[order], doc[order], gives[order], len(ids), ids[by_id], heaps)

        parts, docs_held, postings_held = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            words, counts = b.column(2), b.column(3)
            size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append((b.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), size,
                          words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            docs_held, postings_held = docs_held + b.num_rows, postings_held + int(size.sum())
            if docs_held >= shard_docs or postings_held >= shard_postings:
                run(parts)
                parts, docs_held, postings_held = [], 0, 0
        if parts:
            run(parts)
        out = [(i, -d, s) for i, h in enumerate(heaps.rows) for s, d in h]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return table.mapInArrow(search, "item int, doc_id long, score long")


def best(found: DataFrame, top: int) -> DataFrame:
    """The heaps of tasks merged: over salts, then over all."""
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item with a score above 0, the best first, ties by doc_id."""
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // BLOCK_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kind = dict(asked.dtypes)["item_id"]
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("item_id", "text").collect()  # a block of the items
        if not rows:
            continue
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found = best(_block(docs, [terms(r["text"]) for r in rows], text_col, top, shard_docs, shard_postings), top)
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(LOWEST)).alias("doc_id"), "score"))
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
post AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM post GROUP BY 1), total),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n.n * docs) // words)))) AS BIGINT) AS score
 FROM q JOIN w USING (t) JOIN post USING (t) JOIN n USING (doc_id), total GROUP BY 1, 2),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
