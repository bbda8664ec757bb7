"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are the rows of one text. A group goes where the dot product of its demand with the shards' residual capacity is highest, all
three being fractions of a shard's fair share, among the shards that have the bytes left. The law that holds is `bytes`: sizes of
shards are near equal.
Large groups (over 1/`fine` of a shard in any dimension; so their number is bounded by 3 x shards x fine, whatever the corpus) are placed
first, on the driver. Only a group whose bytes fit no shard whole, above all one over a whole shard's bytes, is cut into small pieces; its rows are dealt over
them in turn. The others are dealt over tasks by their digest, `GROUPS_A_TASK` to one; each task places its groups, largest first, against its own part of what
the large ones left, so that the shards' sums stay balanced at any number of tasks. As a shard may be out of bytes while it lacks rows, a task then exchanges a group of
the shard that lacks most rows for smaller ones, together as many bytes, of the shard that has most, until rows are even or no such groups are left; no shard's bytes change by more than `DRIFT`. Slots come from counts by (task, shard).

Defined results: a null text counts as empty (size 8); repeated rows are rows of one group, and each gets its slot; a null doc_id is a row like any other; groups of
equal demand are placed in the order of their digests, equal dot products go to the lower shard; a single row larger than a shard is placed where the
most bytes are left; an empty table gives an empty table. Columns other than doc_id and text don't matter.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import slim, written

SHARDS, FINE = 24, 64
#: The part of a shard's bytes that a piece of a cut group has at most.
PIECE = 0.125
#: Groups that one placing task takes, about.
GROUPS_A_TASK = 20_000
#: The part of a shard's bytes that exchanges may add or take, and the part of its rows at which they stop.
DRIFT, EVEN = 0.0005, 0.005
#: What ends a token, for the balance of shards: each of these signs, and the text's end. They are counted without a list of tokens being made.
ENDS = " \t\n\r.,;:!?-()[]{}<>/\\'\"|#*"


def place(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each row of demand, in the given order; residual (shards x dimensions) is reduced in place.

    Of the shards that have the bytes left, the one where the dot product is highest; if none has, the one with the most bytes left."""
    out = np.empty(len(demand), np.int32)
    for i, d in enumerate(demand):
        fits = residual[:, 0] >= d[0]
        s = int(np.argmax(np.where(fits, residual @ d, -np.inf) if fits.any() else residual[:, 0]))
        out[i] = s
        residual[s] -= d
    return out


def exchange(d: np.ndarray, at: np.ndarray, residual: np.ndarray, low: int, high: int, moved: np.ndarray, limit: float) -> bool:
    """One exchange that takes most rows from shard `low` to `high`: neighbours by size of low's groups for one of high's, bytes alike; at, residual and moved are changed in place."""
    ys, xs = (g[np.argsort(d[g, 0], kind="stable")] for g in (np.flatnonzero(at == low), np.flatnonzero(at == high)))
    if not len(ys) or not len(xs):
        return False
    size, rows = np.append(0, np.cumsum(d[ys, 0])), np.append(0, np.cumsum(d[ys, 2]))
    half = (residual[high, 2] - residual[low, 2]) / 2
    m = min(len(ys), int(half / d[:, 2].min()) + 1)
    best = None
    while m and best is None:
        taken, n = size[m:] - size[:-m], rows[m:] - rows[:-m]
        near = np.searchsorted(d[xs, 0], taken)
        for j in (np.minimum(near, len(xs) - 1), np.maximum(near - 1, 0)):
            more, gain = taken - d[xs[j], 0], n - d[xs[j], 2]
            ok = (gain > 1e-15) & (gain <= half * (1 + 1e-9)) & (np.abs(moved[low] - more) <= limit) & (np.abs(moved[high] + more) <= limit)
            if ok.any():
                i = int(np.argmax(np.where(ok, gain, -1)))
                if best is None or gain[i] > best[0]:
                    best = gain[i], ys[i:i + m], xs[j[i]]
        m = m * 2 // 3
    if best is None:
        return False
    _, out, back = best
    change = d[out].sum(0) - d[back]
    at[out], at[back] = high, low
    residual[low] += change
    residual[high] -= change
    moved[low] -= change[0]
    moved[high] += change[0]
    return True


def even_rows(d: np.ndarray, at: np.ndarray, residual: np.ndarray) -> None:
    """Exchanges until no shard lacks over `EVEN` of its rows beside another, or none is possible; every exchange brings two shards' rows nearer to each other."""
    shards = len(residual)
    if not len(d):
        return
    moved, limit, enough = np.zeros(shards), DRIFT * d[:, 0].sum() / shards, max(EVEN * d[:, 2].sum() / shards, 1.5 * d[:, 2].min())
    for _ in range(100 * shards):
        order = np.argsort(residual[:, 2], kind="stable")  # first the one with most rows
        pairs = sorted(((a, b) for a in order for b in order if residual[b, 2] - residual[a, 2] > enough), key=lambda p: residual[p[0], 2] - residual[p[1], 2])
        if not any(exchange(d, at, residual, a, b, moved, limit) for a, b in pairs):
            return


def place_whole(groups: list[tuple[bytes, int, np.ndarray]], residual: np.ndarray) -> dict[bytes, list[int]]:
    """The shards of each group (digest, rows, demand of one row), in order: one if it fits a shard whole, otherwise those of its pieces; residual is reduced in place."""
    out: dict[bytes, list[int]] = {}
    for g, n, one in groups:
        cuts = 1 if n * one[0] <= residual[:, 0].max() else int(min(n, np.ceil(n * one[0] / PIECE)))
        demand = np.array([(n // cuts + (k < n % cuts)) * one for k in range(cuts)])
        out[g] = place(demand, residual).tolist()
    return out


def rows_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A small row for each document: its group, size, tokens and checksum."""
    t = F.col("text")
    return slim(docs, text_col).select(
        "doc_id", F.unhex(F.sha2(t, 256)).alias("g"), (F.octet_length(t) + 8).cast("long").alias("size"),
        (F.length(t) - F.length(F.translate(t, ENDS, "")) + 1).cast("long").alias("tokens"), F.crc32(t).cast("long").alias("text_crc32"))


def shard(docs: DataFrame, text_col: str = "text", shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens."""
    rows = written(rows_of(docs, text_col))
    groups = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("tokens").alias("tokens")))
    total = groups.agg(F.sum(F.col("n") * F.col("size")), F.sum(F.col("n") * F.col("tokens")), F.sum("n"), F.count(F.lit(1))).first()
    fair = np.maximum([float(x or 0) / shards for x in total[:3]], 1e-9)
    share = F.greatest(F.col("n") * F.col("size") / F.lit(float(fair[0])), F.col("n") * F.col("tokens") / F.lit(float(fair[1])), F.col("n") / F.lit(float(fair[2])))
    # few groups have the share of a large one; a single row is never cut, however large it is
    large = groups.where((share > 1.0 / fine) & (share < float("inf"))).orderBy(F.col("size").desc(), "g").collect() if total[3] else []
    units = [(bytes(r["g"]), r["n"], np.array([r["size"], r["tokens"], 1]) / fair) for r in large]
    units.sort(key=lambda u: (-(u[1] * u[2]).max(), u[0]))
    residual = np.ones((shards, 3))
    large_at = place_whole(units, residual)  # at most 3 x shards x fine groups, and shards / PIECE pieces more

    def mark(batches):
        """Rows of large groups with their shards, pieces in turn; others without. Each task begins at another piece."""
        seen: Counter[bytes] = Counter()
        task = TaskContext.get().partitionId()
        for b in batches:
            at = []
            for g in b.column("g").to_pylist():
                to = large_at.get(g)
                at.append(None if to is None else to[(task + seen[g]) % len(to)])
                if to is not None:
                    seen[g] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "at"])

    tasks = int(max(1, -(-(total[3] or 0) // GROUPS_A_TASK)))  # grows with the corpus, so a task's groups don't
    rest = residual.copy()

    def deal(groups: pa.Table) -> pa.Table:
        g = np.array(groups.column("g").to_pylist(), object)
        d = np.column_stack([groups.column("size").to_numpy(), groups.column("tokens").to_numpy(), np.ones(len(g))]) * groups.column("n").to_numpy()[:, None] / fair
        cold = np.array([x not in large_at for x in g], bool)
        g, d = g[cold], d[cold]
        order = np.array(sorted(range(len(g)), key=lambda i: (-d[i, 0], g[i])), int)
        g, d = g[order], d[order]
        own = d.sum(0) * rest / np.maximum(rest.sum(0), 1e-12)  # this task's part of what is left
        at = place(d, own)
        even_rows(d, at, own)
        return pa.table({"g": pa.array(g.tolist(), pa.binary()), "at": pa.array(at, pa.int32())})

    placed = groups.withColumn("deal", F.pmod(F.xxhash64("g"), F.lit(tasks))).groupBy("deal").applyInArrow(deal, "g binary, at int")
    columns = "doc_id long, g binary, size long, tokens long, text_crc32 long"
    marked = written(rows.mapInArrow(mark, f"{columns}, at int"))
    cold = marked.where("at is null").drop("at").join(placed, "g")  # what is shuffled by g has no hot key
    return with_slots(marked.where("at is not null").unionByName(cold))


def with_slots(rows: DataFrame) -> DataFrame:
    """A gapless place in its shard for each row: a place in its task, counted as rows stream by, after the counts of the tasks before."""

    def number(batches):
        seen: Counter[int] = Counter()
        task = TaskContext.get().partitionId()
        for b in batches:
            at = b.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            values, first, n = np.unique(at[order], return_index=True, return_counts=True)
            turn = np.empty(len(at), np.int64)
            turn[order] = np.arange(len(at)) - np.repeat(first, n) + np.repeat([seen[v] for v in values.tolist()], n).astype(np.int64)
            seen.update(dict(zip(values.tolist(), n.tolist())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), task, np.int32)), pa.array(turn)], [*b.schema.names, "task", "turn"])

    kept = rows.select("doc_id", "size", "text_crc32", "tokens", "at")
    parts = written(kept.mapInArrow(number, "doc_id long, size long, text_crc32 long, tokens long, at int, task int, turn long"))
    n = parts.groupBy("at", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("at").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = n.select("at", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return parts.join(first, ["at", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("at").alias("shard"),
        (F.col("first") + F.col("turn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
