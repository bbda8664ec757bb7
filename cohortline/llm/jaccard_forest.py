"""N-gram Jaccard join by a MinHash LSH forest: sorted prefix tries of signatures, then exact verification.

1. A text becomes the set of its five-word shingles; texts with one set are one class, and the class is what is joined.
2. Each of `trees` tries holds a label of `depth` MinHash values for every class; the parts where labels share a prefix are kept sorted by label.
3. Matched prefixes are shortened from whole labels on until the target recall: down to `shallowest`, the longest prefix at which the forest finds even a pair at the threshold
   with that probability. How far that is depends on the threshold, the trees and the target, not on what other pairs the data hold: a large group of close copies,
   which long prefixes find, says nothing about a link elsewhere that only a short one finds.
4. The classes of a node at that prefix meet, by their labels alone. A pair belongs to the first tree in which it meets. A node's classes are sorted into
   blocks of at most `block`, and pairs of blocks go to tasks, so a node with a third of all rows is spread like any other.
5. Each task verifies every pair that has met exactly, on the whole sets, and returns, per class, how many links it found and a spanning forest of them: rows in
   proportion to the classes, never pairs.
6. Links are summed, and the forests joined to components by large-star / small-star rounds, whose hubs are dealt over salts.

Every link is counted, so a group of m texts that are all alike and all different costs m^2 / 2 comparisons, spread over blocks; copies cost nothing.

Defined results: words are lower-cased runs of letters and digits; a text of one to four words is one shingle of all of them; a text without words is one shingle of
itself, so empty (and null) texts are copies of each other. Rows that repeat are copies too; of equal doc_ids each row counts. Similarity at the threshold
exactly is a link. A null doc_id is lower than any other. An empty table gives an empty table. Columns other than doc_id and text don't matter.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import fresh, pieces, slim, written

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, BLOCK = 24, 8, 0.99999, 512
#: Tasks that a hub's edges are dealt over.
SALTS = 16
_WORD = re.compile(r"\w+")
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Stands for a null doc_id.
LOWEST = -(2**63)
#: Word hashes that a worker remembers; then it forgets all and goes on.
REMEMBERED = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s)


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        v = self[w] = _hash(w)
        return v


_words = _Words()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; never empty."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([_hash("\0" + text)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _P + h[i:len(h) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def found_at(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The probability that a pair shares a prefix of `depth` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which even pairs at the threshold reach the target recall."""
    while depth > 1 and found_at(threshold, depth, trees) < recall:
        depth -= 1
    return depth


_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1)), _rng.integers(0, 2**32, 4096, dtype=np.uint32)


def signature(sh: np.ndarray, size: int) -> np.ndarray:
    """`size` MinHash values, uint32; the shingles' hashes are well mixed, so a linear function orders them."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    a, b = _A[0][:size], _A[1][:size]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 256):
        v = x[lo:lo + 256, None] * a[None, :]
        v += b
        np.minimum(out, v.min(0), out=out)
    return out


def label(sh: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """The labels of all trees: `depth` values of two bytes each, high byte first, so that bytes sort as the trie does."""
    v = signature(sh, trees * depth).astype(np.uint64)
    return (mix(v * _P) >> np.uint64(48)).astype(">u2").tobytes()


def nodes(labels: np.ndarray, depth: int) -> np.ndarray:
    """For rows of labels (class, tree, value), a number for each class's node at `depth` in each tree."""
    h = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=np.uint64), labels.shape[:2])
    for i in range(depth):
        h = mix(h * _P + labels[:, :, i])
    return h


def signed(docs: DataFrame, trees: int, depth: int, text_col: str = "text") -> DataFrame:
    """doc_id, id (never null), th (text hash), key (digest of the shingle set), size, labels (of all trees)."""
    import xxhash

    def sign(batches):
        for batch in batches:
            for b in pieces(batch):
                keys, sizes, labels = [], [], []
                for t in b.column(1).to_pylist():
                    sh = shingles(t)
                    keys.append(xxhash.xxh3_128_digest(sh.tobytes()))
                    sizes.append(len(sh))
                    labels.append(label(sh, trees, depth))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary())], ["doc_id", "id", "th", "key", "size", "labels"])

    rows = slim(docs, text_col).withColumn("id", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(sign, "doc_id long, id long, th long, key binary, size int, labels binary")


def _runs(batches, columns: list[str], key: str):
    """Whole runs of equal `key` from batches sorted by it, as dicts of lists; a run may span batches."""
    held: dict[str, list] | None = None
    for batch in batches:
        for b in pieces(batch, 1024):
            cols = {c: b.column(c).to_pylist() for c in columns}
            ks = cols[key]
            lo = 0
            for i in range(1, len(ks) + 1):
                if i == len(ks) or ks[i] != ks[lo]:
                    part = {c: v[lo:i] for c, v in cols.items()}
                    if held is not None and held[key][0] == part[key][0]:
                        for c in columns:
                            held[c] += part[c]
                    else:
                        if held is not None:
                            yield held
                        held = part
                    lo = i
    if held is not None:
        yield held


def first_met(labels: np.ndarray, tree: int, level: int) -> np.ndarray:
    """For classes that share a node of `tree` at `level`, the boolean matrix of pairs that share none of an earlier tree there."""
    out = np.ones((len(labels), len(labels)), bool)
    at = nodes(labels[:, :tree], level)
    for t in range(tree):
        out &= at[:, t][:, None] != at[:, t][None, :]
    return out


def label_array(unit: dict[str, list], trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(unit["labels"]), ">u2").reshape(len(unit["labels"]), trees, -1).astype(np.uint64)


def wanted(unit: dict[str, list], labels: np.ndarray, level: int, threshold: float) -> np.ndarray:
    """The upper triangle of pairs that belong to a unit (two blocks of one node, or one block) and whose sizes let them be links."""
    side = np.array(unit["side"])
    size = np.array(unit["size"], float)
    pairs = np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    if side.max() > 0:  # two blocks: only pairs across them
        pairs &= side[:, None] != side[None, :]
    pairs = np.triu(pairs, 1)
    return pairs & first_met(labels, unit["tree"][0], level) if pairs.any() else pairs


def intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs (others stay 0)."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    r, c = np.nonzero(pairs)
    if len(r) <= 4 * m:
        for i, j in zip(r, c):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for lo in range(0, len(vocabulary), 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        slab = np.zeros((m, min(4096, len(vocabulary) - lo)), np.float32)
        slab[owner[i:j], at[i:j] - lo] = 1
        out += slab @ slab.T
    return out


def verify(unit: dict[str, list], trees: int, least: int, threshold: float, words: int) -> tuple[list[int], list[int], list[int]]:
    """For each class of the unit: linked classes, linked documents, and the first class of its part of the spanning forest."""
    labels = label_array(unit, trees)
    pairs = wanted(unit, labels, least, threshold)
    m = len(pairs)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, docs = np.zeros(m, int), np.zeros(m, int)
    if pairs.any():
        sets = [shingles(t, words) for t in unit["text"]]
        size = np.array([len(s) for s in sets], float)
        both = intersections(sets, pairs)
        r, c = np.nonzero(pairs & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6))
        copies = np.array(unit["copies"])
        np.add.at(links, r, 1), np.add.at(links, c, 1)
        np.add.at(docs, r, copies[c]), np.add.at(docs, c, copies[r])
        for i, j in zip(r.tolist(), c.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links.tolist(), docs.tolist(), [find(i) for i in range(m)]


def _with_least(rows: DataFrame, other: str, least: DataFrame) -> DataFrame:
    """rows (u, ...) with the least neighbour of u; the rows of one u are dealt over salts, to each of which its least goes."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (a, b): large-star and small-star rounds until nothing changes."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now, last = written(edges.where("a <> b").distinct()), None
    for _ in range(60):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        pairs = both(now)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_least(pairs.where("v > u"), "v", least).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: a node and those below it go to the smallest of them
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(down, "v", least).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("root"))
        last = tuple(state)
    raise RuntimeError("components did not settle in 60 rounds")


def join(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (largest doc_id of its component), n_links (other documents at the threshold or above), n_linked_texts
    (other shingle sets), class_size (documents of its component)."""
    least = shallowest(threshold, trees, depth, recall)
    rows = written(signed(docs, trees, depth, text_col))
    classes = written(rows.groupBy("key").agg(F.max(F.struct("id", "th", "size", "labels")).alias("best"), F.count(F.lit(1)).alias("copies"))
                      .select("key", F.col("best.id").alias("rep"), F.col("best.th").alias("th"), F.col("best.size").alias("size"), F.col("best.labels").alias("labels"), "copies"))

    # nodes of the tries: one row per class and tree, by its prefix
    prefix = lambda t: F.substring("labels", t * (2 * depth) + 1, F.lit(2 * least))
    node = classes.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("tree", "node"))
    node = node.withColumn("node", F.xxhash64("tree", "node"))
    shared = node.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    members = node.join(shared, "node").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its node once
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "tree", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
                             F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    light = members.join(classes.select("key", "size", "labels"), "key")
    tries = light.repartition("unit").sortWithinPartitions("unit", F.expr(f"substring(labels, tree * {2 * depth} + 1, {2 * depth})"))

    def meet(batches):
        """Units with a pair that meets for the first time, only with the classes of such pairs."""
        names, out = ["unit", "tree", "side", "key"], []
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for u in _runs(batches, ["unit", "tree", "side", "key", "size", "labels"], "unit"):
            if len(u["key"]) > 1:
                pairs = wanted(u, label_array(u, trees), least, threshold)
                for i in np.flatnonzero(pairs.any(0) | pairs.any(1)):
                    out.append((u["unit"][i], u["tree"][i], u["side"][i], u["key"][i]))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    met = written(tries.mapInArrow(meet, "unit long, tree int, side int, key binary"))
    # the texts that verification needs; rows that repeat a class's text give it once
    need = met.select("key").distinct().join(classes, "key")
    texts = slim(docs, text_col).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("rep"), F.xxhash64("text").alias("th"), "text")
    heavy = met.join(texts.join(need, ["rep", "th"]).dropDuplicates(["key"]), "key")

    def check(batches):
        out = []
        names, kinds = ["key", "links", "docs", "root"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for u in _runs(batches, ["unit", "tree", "side", "key", "size", "labels", "copies", "text"], "unit"):
            links, n, root = verify(u, trees, least, threshold, words)
            out += [(k, a, b, u["key"][r]) for k, a, b, r in zip(u["key"], links, n, root) if a]
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    found = written(heavy.repartition("unit").sortWithinPartitions("unit").mapInArrow(check, "key binary, links long, docs long, root binary"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    parts = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "rep", "copies").join(links, "key", "left").join(parts.withColumnRenamed("u", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = named.groupBy("root").agg(F.nullif(F.max("rep"), F.lit(LOWEST)).alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(whole, "root").select("key", "class_id", "class_size", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_linked_texts"))
    out = rows.select("doc_id", "th", "key").join(named, "key")
    return out.select("doc_id", "class_id", "n_links", "n_linked_texts", "class_size", *["th"] * keyed)


def survivors(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of one document of each component, whole: the one with the largest doc_id. Of rows that share that id, those of its class stay."""
    at, th = fresh(docs, "at"), fresh(docs, "th")
    found = join(docs, text_col, keyed=True, **how)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(LOWEST)).alias(at), F.col("th").alias(th)).distinct()
    named = docs.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return named.join(gone, [at, th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
