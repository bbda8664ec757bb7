"""MinHash near-dedup with circulant permutations: two permutations sign a text, one of them circularly shifted for every coordinate.

1. A text becomes the set of its shingles; texts with one set are one class. A first permutation spreads the hashed shingles over `UNIVERSE` places; coordinate k
   of the signature is the least value, over the places i of the set, of the second permutation shifted by k: the windows of `bands * rows` neighbouring values
   that start at those places, and their minima.
2. Signatures are cut into bands. Classes that share a band meet in its bucket. Of each bucket the class with the most copies is compared with all the others (pairs
   that several buckets name are compared once): linear in the bucket, a hot one is dealt over units. What is linked is joined to components.
3. What is left to compare in a bucket are pairs of different components. The largest component of a bucket stays together: only the others are compared, with it and
   with each other, in pairs of blocks of at most `block` classes, each pair in the first band in which it meets. So a group of near copies is not squared.
4. Every link is confirmed on the full sets of shingles, with whole numbers. Components are joined once more over all links.

At similarity 0.8 a pair shares one of 32 bands of 5 values with probability over 0.99999; sets of very many shingles fall together in places, which only
raises that. A link inside a component that is already joined is not asked for: components are the result.

Defined results: words are split at ASCII white space after A-Z are lower-cased; a text of fewer words than a shingle is one shingle of them all; null texts and texts
without words have empty sets and are linked with nothing. Similarity at the threshold exactly is a link. A null doc_id is lower than any other. Rows that repeat, and
rows of one doc_id, are documents of their own; equal texts are linked. An empty table gives an empty table. Columns other than doc_id and text don't matter.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import fresh, pieces, slim, written
from cohortline.llm.jaccard_forest import LOWEST, _P, _Words, _runs, components, intersections, mix

WORDS, PERCENT = 2, 80
BANDS, ROWS, BLOCK = 32, 5, 512
#: Places that shingles are spread over; a power of two.
UNIVERSE = 1 << 22
_words = _Words()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = text.encode().lower().split()  # of bytes: A-Z alone are lowered, and only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _P + h[i:len(h) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def placed(sh: np.ndarray, universe: int = UNIVERSE) -> np.ndarray:
    """The first permutation: hashed shingles to places, by steps that can each be undone."""
    mask = np.uint64(universe - 1)
    x = sh & mask
    for factor in (0x2C1B3C6D, 0x297A2D39):
        x = (x * np.uint64(factor)) & mask
        x ^= x >> np.uint64(11)
    return x


@lru_cache(maxsize=4)
def shifted(size: int, universe: int = UNIVERSE) -> np.ndarray:
    """The second permutation as windows: row i holds its values at i, i + 1, ... i + size - 1, round the end: what place i is under each shift."""
    once = np.random.default_rng(11).permutation(universe).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([once, once[:size - 1]]), size)


def signature(sh: np.ndarray, size: int, universe: int = UNIVERSE) -> np.ndarray:
    windows, at = shifted(size, universe), placed(sh, universe)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(at), 256):
        np.minimum(out, windows[at[lo:lo + 256]].min(0), out=out)
    return out


def bands_of(sh: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit number for each band of the signature."""
    v = signature(sh, bands * rows).reshape(bands, rows).astype(np.uint64)
    h = np.zeros(bands, np.uint64)
    for i in range(rows):
        h = mix(h * _P + v[:, i] + np.uint64(1))
    return h


def signed(docs: DataFrame, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, id (never null), th (text hash), key (digest of the shingle set), size, bands."""
    import xxhash

    def sign(batches):
        for batch in batches:
            for b in pieces(batch):
                keys, sizes, labels = [], [], []
                for t in b.column(1).to_pylist():
                    sh = shingles(t, words)
                    keys.append(xxhash.xxh3_128_digest(sh.tobytes()))
                    sizes.append(len(sh))
                    labels.append(bands_of(sh, bands, rows).tobytes() if len(sh) else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "id", "th", "key", "size", "bands"])

    slimmed = slim(docs, text_col).withColumn("id", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("th", F.xxhash64("text"))
    return slimmed.mapInArrow(sign, "doc_id long, id long, th long, key binary, size long, bands binary")


def named_by(id_col: str, digest: str) -> Column:
    """The id, as eight bytes that sort as it does, and the digest."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(id_col).bitwiseXOR(F.lit(LOWEST))), 16, "0")), digest)


def id_of(name: str) -> Column:
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _edges(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*rows)], ["a", "b"])


def wanted(unit: dict[str, list], bands: int, percent: int) -> np.ndarray:
    """Of a unit's classes the upper triangle of pairs that it has to compare: of different sides (or of one block), different components, sizes
    that allow a link, and no band in common before this one."""
    size, side, part = np.array(unit["size"]), np.array(unit["side"]), unit["part"]
    pairs = 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    if side.max() > 0:
        pairs &= side[:, None] != side[None, :]
    number = {p: i for i, p in enumerate(dict.fromkeys(part))}
    part = np.array([number[p] for p in part])
    pairs = np.triu(pairs & (part[:, None] != part[None, :]), 1)
    if pairs.any():
        at = np.frombuffer(b"".join(unit["bands"]), np.uint64).reshape(len(size), bands)
        for t in range(unit["band"][0]):
            pairs &= at[:, t][:, None] != at[:, t][None, :]
    return pairs


def cross_links(unit: dict[str, list], bands: int, percent: int, words: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest, over the components so far, of the links between a unit's classes."""
    pairs = wanted(unit, bands, percent)
    r, c = np.nonzero(pairs)
    if not len(r):
        return []
    root = {p: p for p in unit["part"]}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    sets, out = [shingles(t, words) for t in unit["text"]], []
    many = len(r) > 4 * len(sets)
    if many:
        both = intersections(sets, pairs)
        n = np.array([len(s) for s in sets])
        ok = 100 * both[r, c].astype(np.int64) >= percent * (n[r] + n[c] - both[r, c].astype(np.int64))
        r, c = r[ok], c[ok]
    for i, j in zip(r.tolist(), c.tolist()):
        a, b = find(unit["part"][i]), find(unit["part"][j])
        if a != b and (many or linked(sets[i], sets[j], percent)):
            root[a] = b
            out.append((unit["key"][i], unit["key"][j]))
    return out


def links(docs: DataFrame, classes: DataFrame, text_col: str, words: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """(a, b): links between classes that join all that are linked."""
    c = F.col
    fits = lambda p, q: F.least(p, q) * 100 >= F.greatest(p, q) * percent
    texts = slim(docs, text_col).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), F.xxhash64("text").alias("th"), "text")

    def with_text(units: DataFrame) -> DataFrame:
        need = classes.join(units.select("key").distinct(), "key").select("key", "id", "th")
        return units.join(texts.join(need, ["id", "th"]).dropDuplicates(["key"]).select("key", "text"), "key")

    # buckets: one row a class and band
    at = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("bands", i * 8 + 1, F.lit(8)))
    node = classes.select("key", "size", "copies", F.posexplode(at).alias("band", "value")).withColumn("node", F.xxhash64("band", "value")).drop("value")
    shared = node.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "size", "key")).alias("first")).where("n > 1")
    met = written(node.join(shared.select("node", c("first.key").alias("first"), c("first.size").alias("first_size")), "node").drop("copies"))

    # the first of each bucket with all others
    pairs = met.where((c("key") != c("first")) & fits(c("size"), c("first_size"))).select("first", "key").distinct()
    shares = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("units"))
    dealt = pairs.join(shares, "first").select(F.xxhash64("first", F.pmod(F.xxhash64("key"), "units")).alias("unit"), F.lit(1).alias("side"), "key")
    firsts = shares.select(F.explode(F.sequence(F.lit(0), c("units") - 1)).alias("i"), c("first").alias("key")).select(F.xxhash64("key", c("i").cast("long")).alias("unit"), F.lit(0).alias("side"), "key")

    def check(batches):
        out, unit, mine = [], None, None
        for batch in batches:
            for b in pieces(batch):
                for u, side, key, text in zip(*(b.column(n).to_pylist() for n in ("unit", "side", "key", "text"))):
                    if side == 0:
                        unit, mine = (u, key), shingles(text, words)
                    elif unit is not None and unit[0] == u and linked(mine, shingles(text, words), percent):
                        out.append((unit[1], key))
                if len(out) > 4096:
                    yield _edges(out)
                    out = []
        if out:
            yield _edges(out)

    star = written(with_text(dealt.unionByName(firsts)).repartition("unit").sortWithinPartitions("unit", "side").select("unit", "side", "key", "text").mapInArrow(check, "a binary, b binary"))

    # buckets that still hold different components, but for their first
    parts = components(star).withColumnRenamed("u", "key").withColumnRenamed("root", "part")
    rest = met.where(c("key") != c("first")).select("node", "band", "key", "size").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key"))
    by_part = rest.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_part.groupBy("node").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("home")).where("parts > 1")
    cut = lambda n: F.ceil(n / F.lit(block)).cast("int")
    mixed = mixed.select("node", c("home.part").alias("home"), cut(c("n") - c("home.n")).alias("strays"), cut(c("home.n")).alias("homes"))
    rest = rest.join(mixed, "node").withColumn("stray", c("part") != c("home"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.when(c("stray"), c("strays")).otherwise(c("homes"))).cast("int"))
    # a block of strays meets every block of strays and every block of the home component; blocks of the home component are numbered below zero
    others = F.when(c("stray"), F.sequence(-c("homes"), c("strays") - 1)).otherwise(F.sequence(F.lit(0), c("strays") - 1))
    rest = rest.withColumn("own", F.when(c("stray"), c("own")).otherwise(-c("own") - 1)).withColumn("other", F.explode(others))
    members = rest.select("key", "size", "part", "band", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.when(c("own") > c("other"), 1).otherwise(0).alias("side"))
    members = members.join(classes.select("key", "bands"), "key")
    columns = ["unit", "side", "band", "key", "part", "size", "bands"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def meet(batches):
        """Only the classes of units' pairs that have to be compared."""
        out = []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], columns)
        for u in _runs(batches, columns, "unit"):
            if len(u["key"]) > 1:
                w = wanted(u, bands, percent)
                out += [tuple(u[n][i] for n in columns) for i in np.flatnonzero(w.any(0) | w.any(1))]
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    light = written(members.select(*columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(meet, "unit long, side int, band int, key binary, part binary, size long, bands binary"))

    def confirm(batches):
        out = []
        for u in _runs(batches, [*columns, "text"], "unit"):
            out += cross_links(u, bands, percent, words)
            if len(out) > 4096:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return star.unionByName(with_text(light).repartition("unit").sortWithinPartitions("unit").mapInArrow(confirm, "a binary, b binary"))


def near_dedup(docs: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its component), kept (whether it is that document)."""
    every = written(signed(docs, text_col, words, bands, rows))
    # a class is named by its smallest doc_id and its digest, so the smallest name of a component holds the component's smallest doc_id: nothing is grouped by component
    classes = written(every.where("size > 0").groupBy(F.col("key").alias("digest")).agg(F.min(F.struct("id", "th", "size", "bands")).alias("best"), F.count(F.lit(1)).alias("copies"))
                      .select(named_by("best.id", "digest").alias("key"), "digest", "best.*", "copies"))
    parts = components(links(docs, classes, text_col, words, percent, bands, rows, block)).withColumnRenamed("u", "key")
    named = classes.select("key", "digest", "id").join(parts, "key", "left").select(F.col("digest").alias("key"), F.coalesce(id_of("root"), "id").alias("least"))
    out = every.select("doc_id", "id", "th", "key", "size").join(named, "key", "left").withColumn("least", F.coalesce("least", "id"))
    component = F.nullif(F.col("least"), F.lit(LOWEST))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *["th"] * keyed)


def survivors(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of the kept document of each component, whole."""
    at, th = fresh(docs, "at"), fresh(docs, "th")
    gone = near_dedup(docs, text_col, keyed=True, **how).where("not kept").select(F.coalesce("doc_id", F.lit(LOWEST)).alias(at), F.col("th").alias(th)).distinct()
    named = docs.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return named.join(gone, [at, th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w)),
size AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh ON w.doc_id = sh.doc_id GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT size.doc_id, n AS n_shingles, coalesce(min(y), size.doc_id) AS component_id, size.doc_id = coalesce(min(y), size.doc_id) AS kept
FROM size LEFT JOIN reach ON size.doc_id = x GROUP BY size.doc_id, n"""
