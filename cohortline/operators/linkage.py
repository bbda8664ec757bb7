"""Linking a study to its successors: equality on sponsor, an interval on dates, overlap of sets and likeness of names.

Anchors and studies meet in cells: one a sponsor and bucket of the window's length. An anchor is in the cells of the two buckets that its window can reach, a study in one, so a pair
meets once. A cell of over `SMALL` rows (and one in `SHARES` of all) is cut: its anchors and its studies are each dealt to parts of at most that size, and each part of the one meets each
part of the other, so no task takes a sponsor whole. There are at most `SHARES` such cells a side, whatever the size of the data: only they are broadcast.

Spark deals rows to cells, never pairs. In a cell a rule (window, rank, posting, conditions, names) is a row of bits over its studies, made once for each value that anchors have of it, and
an anchor's successors are the product of its rows: 64 pairs a step. By likeness, the different tokens and whole names of a cell are held against one another in arrays (`similarity.alike`),
each pair once. What leaves a cell is either its pairs, in batches, or an anchor's number of successors and the first of them.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import similarity
from cohortline.functions.scalars import DAYS_PER_MONTH, lower_tokens, months_between_days, phase_rank, strict_date, text

WINDOW_MONTHS, THRESHOLD = 36, 0.85
#: A cell with over SMALL rows of a side, and over one in SHARES of all, is cut. Pairs that a cell asks at once where it gives all; anchors where it gives the first; rows of bits that are kept.
SHARES, SMALL, BATCH, FEW, KEPT = 1024, 20_000, 200_000, 256, 4096
#: The last rank that a phase has.
LAST_RANK = 6
#: The columns of anchors that are read.
READ = ["nct_id", "lead_sponsor", "phases", "conditions", "intervention_names", "first_post_date", "primary_completion_date", "completion_date"]
#: What anchors and studies meet by.
KEY = ["sponsor", "bucket"]
#: What a cell gives, besides the columns that are carried.
PAIR = "a_id string, s_id string, n_successors long, gap_days int, n_both int, n_any int"


def _dated(studies: DataFrame, p: str, day: Column, *more: Column) -> DataFrame:
    """One row a study that has what every pair needs and a row tells at once: id, sponsor, rank, posting date, the day that the window is about; its conditions as they are, and what else is asked for."""
    c = F.col
    rows = studies.where(c("lead_sponsor").isNotNull()).select(
        c("nct_id").alias(f"{p}_id"), c("lead_sponsor").alias("sponsor"), phase_rank(c("phases")).alias(f"{p}_rank"), F.unix_date(strict_date(c("first_post_date"))).alias(f"{p}_posted"),
        F.unix_date(day).alias(f"{p}_day"), "conditions", *more)
    return rows.where(c(f"{p}_rank").isNotNull() & c(f"{p}_day").isNotNull())


def _narrow(rows: DataFrame, p: str, by_names: bool) -> DataFrame:
    """The rows with their sets of conditions and of names as texts, without those that have none: what costs most is made last, of the rows that are left."""
    keys = _keys(F.col("names")) if by_names else F.lit("")
    rows = rows.withColumns({f"{p}_conditions": _joined(lower_tokens(F.col("conditions"))), "keys": keys}).drop("conditions")
    rows = rows.where(F.length(f"{p}_conditions") > 0)
    return rows.where(F.length("keys") > 0) if by_names else rows  # without names, no pair


def _hot(rows: DataFrame, p: str) -> DataFrame:
    """The keys that hold over one in SHARES of the rows, with the number of parts that they are cut into."""
    counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.greatest(F.ceil(F.sum("n") / F.lit(SHARES)), F.lit(SMALL)).alias("most"))
    return counts.join(F.broadcast(most), F.col("n") > F.col("most")).select(*KEY, F.ceil(F.col("n") / F.col("most")).cast("int").alias(f"{p}_parts"))


def dealt(rows: DataFrame, hot: DataFrame, p: str, other: str) -> DataFrame:
    """Each row in its own part and in all parts of the other side."""
    known = rows.join(F.broadcast(hot), KEY, "left")
    own = F.pmod(F.xxhash64(f"{p}_id"), F.coalesce(f"{p}_parts", F.lit(1))).cast("int").alias(f"{p}_part")
    others = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_parts", F.lit(1)) - 1)).alias(f"{other}_part")
    return known.select(*rows.columns, own, others)


def _end() -> Column:
    return F.coalesce(strict_date(F.col("primary_completion_date")), strict_date(F.col("completion_date")))


def _keys(names: Column) -> Column:
    """A study's effective tokens. Names without any token, but not empty, are equal only to themselves: these (separators and spaces) are one key, which starts with a space as no token does."""
    tokens, whole = similarity.effective_tokens(names), F.lower(text(names))
    return F.when(F.size(tokens) > 0, _joined(tokens)).when(F.length(whole) > 0, F.concat(F.lit(" "), F.translate(whole, ";", ":"))).otherwise("")


def _joined(tokens: Column) -> Column:
    """A set of tokens as one text, which is smaller to shuffle: no token holds the separator."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), ";")


def _bits(rows):
    """Rows of truths as rows of words, the first one in the lowest bit."""
    import numpy as np

    packed = np.packbits(rows, axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])).view(np.uint64)


def _from(values):
    """(different values, bits of the rows that have at least such a value; a last row for none)."""
    import numpy as np

    different = np.unique(values)
    some = [_bits(values >= different[k:k + 1024, None]) for k in range(0, len(different), 1024)]
    return different, np.concatenate([*some, _bits(np.zeros((1, len(values)), bool))])


def _kept(known: dict, key, make):
    """The value of a key, made once; what is known is forgotten before it takes much memory."""
    if key not in known:
        if len(known) >= KEPT:
            known.clear()
        known[key] = make(key)
    return known[key]


def _distinct(column):
    """(different values, which of them each row has)."""
    d = column.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def _hits(a_keys, a_names, s_keys, s_names, threshold: float | None):
    """(of each anchor: its kind of names; of each kind: a row over the studies, as bits, of those whose names match). Names are asked once a kind, likeness once a pair of different tokens or whole names."""
    import numpy as np
    import pyarrow.compute as pc

    from cohortline.functions.similarity import alike

    names = lambda keys, whole: keys if threshold is None else pc.binary_join_element_wise(keys, pc.fill_null(whole, ""), "\0")
    (xs, x_of), (ys, y_of) = _distinct(names(a_keys, a_names)), _distinct(names(s_keys, s_names))
    split = lambda kinds: [k.split("\0", 1) for k in kinds.to_pylist()]
    x_tokens, y_tokens = ([k[0].split(";") for k in split(kinds)] for kinds in (xs, ys))
    places: dict = {}
    for k, tokens in enumerate(y_tokens):
        for t in tokens:
            places.setdefault(t, []).append(k)
    places = {t: np.array(k) for t, k in places.items()}
    if threshold is None:
        likes, more = {}, {}
    else:
        named = [sorted({t for tokens in kinds for t in tokens if not t.startswith(" ")}) for kinds in (x_tokens, y_tokens)]
        likes = {}
        for i, j in alike(*named, threshold):
            for p, q in zip(i.tolist(), j.tolist()):
                likes.setdefault(named[0][p], []).append(named[1][q])
    own = lambda k: [places[t] for x in x_tokens[k] for t in (x, *likes.get(x, ())) if t in places]

    def by_tokens(k: int):
        hit = np.zeros(len(ys), bool)
        for at in own(k):
            hit[at] = True
        return hit

    if threshold is not None:
        x_whole, y_whole = ([k[1].lower() for k in split(kinds)] for kinds in (xs, ys))
        # a name that is its only token has been asked already
        x_one, y_one = (np.array([[w] == t for w, t in zip(whole, tokens)], bool) for whole, tokens in ((x_whole, x_tokens), (y_whole, y_tokens)))
        more = {}
        for i, j in alike(x_whole, y_whole, threshold, lambda at: ~np.array([by_tokens(k) for k in at]) & ~(x_one[at, None] & y_one)):
            for p in np.unique(i).tolist():
                more.setdefault(p, []).append(j[i == p])
    known: dict = {}

    def row(k: int):
        hit = by_tokens(k)
        for at in more.get(k, ()):
            hit[at] = True
        return _bits(hit[y_of])

    return x_of, lambda k: _kept(known, k, row)


def _meet(a, s, days: int, by_names: bool, threshold: float | None, first: bool) -> Iterator[tuple]:
    """(i, j, n, n_both): anchors i of a cell and their successors j, with so many conditions in common. `first`: of an anchor the first in the order of s, and n, how many there are.

    A rule is a row of bits over the studies, made once for each value that anchors have of it; what all rules leave of an anchor is the product of its rows, some anchors at once."""
    import numpy as np

    numbers = lambda t, name, null=0: t[name].fill_null(null).to_numpy()
    day, rank, posted = (_from(numbers(s, n, null)) for n, null in (("day", 0), ("rank", 0), ("posted", 2**31 - 1)))
    a_day, a_rank, a_posted = numbers(a, "day"), numbers(a, "rank"), numbers(a, "posted", -2**31)
    (a_sets, a_set_of), (s_sets, s_set_of) = _distinct(a["conditions"]), _distinct(s["conditions"])
    a_sets, s_sets = ([x.split(";") for x in sets.to_pylist()] for sets in (a_sets, s_sets))
    places: dict = {}
    for k, x in enumerate(s_sets):
        for c in x:
            places.setdefault(c, []).append(k)

    def common(k: int):
        """How many conditions of an anchor's set are in each set of the studies', and the bits of the studies with any."""
        both = np.zeros(len(s_sets), np.int32)
        for c in a_sets[k]:
            both[places.get(c, [])] += 1
        return both, _bits((both > 0)[s_set_of])

    sets: dict = {}
    of_set = lambda k: _kept(sets, k, common)
    if by_names:
        kind_of, row_of = _hits(a["keys"], a["names"], s["keys"], s["names"], threshold)
    else:
        kind_of = np.zeros(len(a), int)
    rows_of: dict = {}
    mine = dict.fromkeys(a["id"].to_pylist())
    for j, x in enumerate(s["id"].to_pylist()):
        if x in mine:
            rows_of.setdefault(x, []).append(j)
    own = [rows_of.get(x) for x in a["id"].to_pylist()]
    order, step = np.lexsort((a_set_of, kind_of)), FEW if first else max(1, BATCH // len(s))
    for begin in range(0, len(order), step):
        at = order[begin:begin + step]
        of = lambda table, values, side: table[1][np.searchsorted(table[0], values, side)]
        may = of(day, a_day[at], "left") & ~of(day, a_day[at] + days, "right") & of(rank, a_rank[at], "right") & of(posted, a_posted[at], "left")
        which, set_at = np.unique(a_set_of[at], return_inverse=True)
        found = [of_set(k) for k in which.tolist()]
        may &= np.array([bits for _, bits in found])[set_at]
        if by_names:
            kinds, kind_at = np.unique(kind_of[at], return_inverse=True)
            may &= np.array([row_of(k) for k in kinds.tolist()])[kind_at]
        for r, k in enumerate(at.tolist()):
            for j in own[k] or ():
                may[r, j >> 6] &= ~np.uint64(1 << (j & 63))
        if first:
            n = np.bitwise_count(may).sum(axis=1, dtype=np.int64)
            i = np.flatnonzero(n)
            n, word = n[i], (may[i] != 0).argmax(axis=1)
            bits = may[i, word]
            j = word * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
        else:
            i, j = np.nonzero(np.unpackbits(may.view(np.uint8), axis=1, bitorder="little", count=len(s)))
            n = np.ones(len(i), np.int64)
        if len(i):
            yield at[i], j, n, np.array([both for both, _ in found])[set_at[i], s_set_of[j]]


def _links(anchors: DataFrame, studies: DataFrame, window_months: int, by_names: bool = True, threshold: float | None = None, first: bool = False, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """PAIR, `sponsor`, `place` and the studies' columns in `carry` (with `texts`, the names of both as a_names and s_names) of all pairs. `first`: of an anchor's pairs in a cell the first by place and id, and their number."""
    c, days = F.col, int(window_months * DAYS_PER_MONTH)
    bucket = lambda d: F.floor(d / F.lit(days + 1)).cast("long")
    place = (F.coalesce(c("ordinal").cast("long"), F.lit(-2**63)) if "ordinal" in studies.columns else F.lit(0).cast("long")).alias("place")
    names = (c("intervention_names") if by_names else F.lit(None)).cast("string").alias("names")
    a = _dated(anchors, "a", _end(), names).where(c("a_rank") < LAST_RANK).withColumn("bucket", F.explode(F.array(bucket(c("a_day")), bucket(c("a_day")) + 1)))
    s = _dated(studies, "s", strict_date(c("start_date")), names, place, *[c(n) for n in carry]).withColumn("bucket", bucket(c("s_day")))
    # only phases later than some anchor's can follow one
    least = a.agg(F.min("a_rank").alias("least"))
    s = s.join(F.broadcast(least), c("s_rank") > c("least")).drop("least")
    hot = _hot(a, "a").join(_hot(s, "s"), KEY, "full")  # at most 2 * SHARES rows
    a, s = _narrow(a, "a", by_names), _narrow(s, "s", by_names)
    plain = lambda rows, p: rows.select(*KEY, "a_part", "s_part", F.lit(p == "a").alias("anchor"), *[c(f"{p}_{n}").alias(n) for n in ("id", "rank", "posted", "day", "conditions")], *[n for n in rows.columns if n in ("keys", "names", "place", *carry)])
    rows = plain(dealt(a, hot, "a", "s"), "a").unionByName(plain(dealt(s, hot, "s", "a"), "s"), allowMissingColumns=True)
    cell, spark = [*KEY, "a_part", "s_part"], anchors.sparkSession
    # a cell's work is by its pairs, not its bytes: small tasks are not to be put together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    fields = ["sponsor", "place", *carry]
    kinds = {f: rows.schema[f].dataType.simpleString() for f in fields}
    schema = ", ".join([PAIR, *[f"`{f}` {k}" for f, k in kinds.items()], *(["a_names string", "s_names string"] if texts else [])])

    import pyarrow as pa
    import pyarrow.compute as pc

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        a, s = t.filter(t["anchor"]), t.filter(pc.invert(t["anchor"]))
        if not len(a) or not len(s):
            return
        one = lambda t: pa.RecordBatch.from_arrays([t[n].combine_chunks() for n in t.column_names], t.column_names)
        a, s = one(a), one(s.sort_by([("place", "ascending"), ("id", "ascending")]))
        size = lambda t: pc.add(pc.count_substring(t["conditions"], ";"), 1).to_numpy()
        a_size, s_size = size(a), size(s)
        a_day, s_day = a["day"].to_numpy(), s["day"].to_numpy()

        for i, j, n, both in _meet(a, s, days, by_names, threshold, first):
            columns = [a["id"].take(pa.array(i)), s["id"].take(pa.array(j)), n, (s_day[j] - a_day[i]).astype("int32"), both, (a_size[i] + s_size[j] - both).astype("int32")]
            columns += [s[f].take(pa.array(j)) for f in fields] + ([a["names"].take(pa.array(i)), s["names"].take(pa.array(j))] if texts else [])
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["a_id", "s_id", "n_successors", "gap_days", "n_both", "n_any", *fields, *(["a_names", "s_names"] if texts else [])])

    return rows.repartition(tasks, *cell).groupBy(*cell).applyInArrow(links, schema)


def candidates(anchors: DataFrame, studies: DataFrame, window_months: int = WINDOW_MONTHS) -> DataFrame:
    """(a_id, s_id, gap_days, n_both, n_any) of studies with a sponsor and a condition in common, a later phase, a start in the window and no earlier posting; each pair
    once, with how many conditions both and either of them have."""
    return _links(anchors, studies, window_months, by_names=False).select("a_id", "s_id", "gap_days", "n_both", "n_any")


def links(anchors: DataFrame, studies: DataFrame, window_months: int = WINDOW_MONTHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, s_id, gap_days, n_both, n_any) of all anchors and their successors by equal names (whole strings or effective tokens), with the columns of the successor that are asked for."""
    return _links(anchors, studies, window_months, carry=carry).select("a_id", "s_id", "gap_days", "n_both", "n_any", *carry)


def _overlap() -> Column:
    return F.bround(F.col("n_both") / F.greatest("n_any", F.lit(1)), 3).alias("condition_overlap")


#: The successor's columns that pairs are shown with.
SHOWN = ("phases", "start_date")


def _shown() -> list[Column]:
    c = F.col
    return [c("s_id").alias("successor_id"), c("phases").alias("successor_phase"), months_between_days(c("gap_days")).alias("temporal_gap_months"), _overlap(), c("a_names"), c("s_names"),
            c("start_date").alias("s_start_text"), c("sponsor").alias("successor_sponsor")]


def successor_pairs(anchors: DataFrame, studies: DataFrame, window_months: int = WINDOW_MONTHS, threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """All (anchor, successor) pairs with what they have in common, names and texts too. `ordinal` is the row order of the studies.

    fuzzy=False takes names as alike only when whole strings or effective tokens are equal."""
    pairs = _links(anchors, studies, window_months, threshold=threshold if fuzzy else None, carry=(*SHOWN, "ordinal"), texts=True)
    return pairs.select(F.col("a_id").alias("nct_id"), "gap_days", *_shown(), F.col("ordinal").alias("successor_ordinal"))


def first_of(anchors: DataFrame, studies: DataFrame, window_months: int = WINDOW_MONTHS, threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """`first_successor` of all pairs, without making them: only an anchor's number of successors and the first one leave a cell."""
    best = _links(anchors, studies, window_months, threshold=threshold if fuzzy else None, first=True, carry=SHOWN, texts=True)
    row = F.struct(*_shown())
    got = best.groupBy(F.col("a_id").alias("nct_id")).agg(F.sum("n_successors").alias("n_successors"), F.min_by(row, F.struct("place", "s_id")).alias("best"))
    return got.select("nct_id", "n_successors", "best.*")


def first_successor(pairs: DataFrame) -> DataFrame:
    """For each anchor the first successor in row order, and how many there are: one aggregate, no window."""
    row = F.struct("successor_id", "successor_phase", "temporal_gap_months", "condition_overlap", "a_names", "s_names", "s_start_text", "successor_sponsor")
    got = pairs.groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_successors"), F.min_by(row, F.struct("successor_ordinal", "successor_id")).alias("best"))
    return got.select("nct_id", "n_successors", "best.*")


def with_similarity(first: DataFrame) -> DataFrame:
    """Full-string similarity of the chosen pair, in Python on one row per anchor."""
    return first.withColumn("intervention_similarity", F.bround(similarity.full_ratio(text(F.col("a_names")), text(F.col("s_names"))), 3))
