"""Exact evaluation metrics as aggregates over distinct scores.

Every curve metric first counts labels by distinct score (map-side combined), then needs running counts over those. Scores are cut into ranges of about `RANGE_ROWS` rows at
approximate quantiles, so there are more of them the more rows there are; running counts are made inside each range, and what lies above a range comes from the ranges' totals in
two levels, groups of ranges and ranges of a group. No task holds more than a range or a level. `digits=` rounds scores first, for those who want fewer of them; nothing is rounded unasked.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of scores, about; there are at least LEAST_RANGES of them. The cuts (one number a range) are broadcast: eight bytes for RANGE_ROWS rows.
RANGE_ROWS, LEAST_RANGES = 1_000_000, 32


def by_score(df: DataFrame, score: str = "score", y: str = "y", digits: int | None = None) -> DataFrame:
    """(s, pos, neg) of each distinct score."""
    s = F.col(score) if digits is None else F.round(score, digits)
    return df.groupBy(s.alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def cuts_of(df: DataFrame, score: str = "score", ranges: int | None = None, rows: int | None = None) -> list[float]:
    """Ascending scores that cut the rows into ranges of about `rows` (or into so many); fewer where scores repeat."""
    ranges = ranges or max(LEAST_RANGES, -(-df.count() // (rows or RANGE_ROWS)))
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.agg(F.percentile_approx(score, shares, max(1000, 10 * ranges))).first()[0] or []))


def located(counts: DataFrame, cuts: list[float]) -> DataFrame:
    """counts with the range of each score as (part, sub), the largest scores first: a group of about sqrt(ranges) neighbouring ranges, and the range in it. A score
    asks the first cut of each group, then the cuts of one."""
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    if not groups:
        return counts.withColumns({"part": F.lit(0), "sub": F.lit(0)})
    known = counts.sparkSession.createDataFrame([([g[0] for g in groups], groups)], "firsts array<double>, groups array<array<double>>")
    s = F.col("s")
    under = F.size(F.filter("firsts", lambda c: c < s))  # groups that begin below the score; 0: it is below all cuts
    own = F.when(F.col("under") > 0, F.size(F.filter(F.get("groups", F.col("under") - 1), lambda c: c < s))).otherwise(0)
    rows = counts.crossJoin(F.broadcast(known)).withColumn("under", under).withColumn("own", own)
    return rows.withColumns({"part": F.lit(len(groups)) - F.col("under"), "sub": F.lit(width) - F.col("own")}).drop("firsts", "groups", "under", "own")


def _totals(counts: DataFrame) -> DataFrame:
    """(part, sub, rp, rn, tp0, fp0, p, n): labels of each range, of all ranges above it, and of all."""
    ranges = counts.groupBy("part", "sub").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    groups = ranges.groupBy("part").agg(F.sum("rp").alias("gp"), F.sum("rn").alias("gn"))  # about sqrt(ranges) rows
    above, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = groups.select("part", zero(F.sum("gp").over(above)).alias("gp0"), zero(F.sum("gn").over(above)).alias("gn0"), F.sum("gp").over(every).alias("p"), F.sum("gn").over(every).alias("n"))
    inside = Window.partitionBy("part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)  # about sqrt(ranges) rows
    rows = ranges.select("part", "sub", "rp", "rn", zero(F.sum("rp").over(inside)).alias("sp0"), zero(F.sum("rn").over(inside)).alias("sn0")).join(F.broadcast(groups), "part")
    return rows.select("part", "sub", "rp", "rn", (F.col("gp0") + F.col("sp0")).alias("tp0"), (F.col("gn0") + F.col("sn0")).alias("fp0"), "p", "n")


def curve(df: DataFrame, score: str = "score", y: str = "y", digits: int | None = None, ranges: int | None = None, rows: int | None = None) -> DataFrame:
    """(s, pos, neg, tp, fp, p, n): running counts at and above each score, and the totals."""
    counts = located(by_score(df, score, y, digits), cuts_of(df, score, ranges, rows))
    down = Window.partitionBy("part", "sub").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).join(_totals(counts), ["part", "sub"])
    return found.select("s", "pos", "neg", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("fp") + F.col("fp0")).alias("fp"), "p", "n")


def average_precision(df: DataFrame, **kw) -> DataFrame:
    """Sum over scores of the step in recall times precision; 0 without positives."""
    step = F.col("pos") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve(df, **kw).agg(F.coalesce(F.sum(F.when(F.col("p") > 0, step)), F.lit(0.0)).alias("average_precision"))


def auroc(df: DataFrame, **kw) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties counting half; 0.5 with one class."""
    below = F.col("n") - F.col("fp")
    pairs = F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.max(F.col("p") * F.col("n"))
    ok = F.max(F.col("p") * F.col("n")) > 0
    return curve(df, **kw).agg(F.when(ok, pairs).otherwise(0.5).alias("auroc"))


def brier(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))


def f1_threshold(df: DataFrame, **kw) -> DataFrame:
    """The lowest of the scores with the largest F1; 0.5 without positives."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    best = F.max_by("s", F.struct(f1.alias("f1"), (-F.col("s")).alias("low")))
    return curve(df, **kw).agg(F.when(F.max("p") > 0, best).otherwise(0.5).alias("threshold"), F.coalesce(F.max(f1), F.lit(0.0)).alias("f1"))


def precision_at(df: DataFrame, ks: dict[str, int], score: str = "score", y: str = "y", key: str = "nct_id") -> DataFrame:
    """(name, k, precision) of the k rows with the largest scores, ties by key; 0 where k is over the number of rows. Each is a bounded top-k."""
    n = df.count()
    out = None
    for name, k in ks.items():
        top = df.orderBy(F.desc(score), key).limit(k)
        one = top.agg(F.lit(name).alias("name"), F.lit(k).alias("k"), (F.coalesce(F.avg(y), F.lit(0.0)) if 0 < k <= n else F.lit(0.0)).alias("precision"))
        out = one if out is None else out.unionByName(one)
    return out


def standard_ks(n: int) -> dict[str, int]:
    return {"top_5pct": max(1, int(n * 0.05)), "top_10pct": max(1, int(n * 0.10)), "top_50": min(50, n)}


def confusion(df: DataFrame, threshold: float | Column, score: str = "score", y: str = "y") -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    return df.agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))


def bins_of(score: Column, n: int, closed: str) -> Column:
    """Uniform bin of a score: interior edges belong to the bin below (`left`, the curve) or above (`right`, the histogram)."""
    x = score * n
    i = F.ceil(x) - 1 if closed == "left" else F.floor(x)
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("int")


def calibration(df: DataFrame, n_bins: int = 10, score: str = "score", y: str = "y") -> DataFrame:
    """(bin, n, fraction_of_positives, mean_predicted); empty bins are left out."""
    return df.groupBy(bins_of(F.col(score), n_bins, "left").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("fraction_of_positives"), F.avg(score).alias("mean_predicted"))


def ece(df: DataFrame, n_bins: int = 10, score: str = "score", y: str = "y", parity: bool = False) -> DataFrame:
    """Calibration error over bins, weighed by what is in them. parity: the i-th kept bin has the weight of the i-th histogram bin, kept or not."""
    cal = calibration(df, n_bins, score, y)
    gap = F.abs(F.col("fraction_of_positives") - F.col("mean_predicted"))
    if not parity:
        return cal.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))
    cal = cal.withColumn("i", F.row_number().over(Window.orderBy("bin")) - 1)
    hist = df.groupBy(bins_of(F.col(score), n_bins, "right").alias("i")).agg(F.count(F.lit(1)).alias("m"))
    total = hist.agg(F.sum("m").alias("total"))
    return cal.join(hist, "i", "left").crossJoin(F.broadcast(total)).agg(F.sum(F.coalesce("m", F.lit(0)) / F.col("total") * gap).alias("ece"))


def _average_precision(p, n, tp0, fp0, p_all, n_all):
    """What a range gives to the average precision, of draws (p, n) by score from the largest on, below tp0 positives and fp0 negatives."""
    import numpy as np

    tp, seen = tp0 + p.cumsum(), tp0 + fp0 + (p + n).cumsum()
    return float((p * tp / np.maximum(seen, 1)).sum() / p_all)


def _auroc(p, n, tp0, fp0, p_all, n_all):
    return float((p * (n_all - fp0 - n.cumsum() + n / 2)).sum() / (p_all * n_all))


def _precision_at_share(p, n, tp0, fp0, p_all, n_all, share: float = 0.10):
    """Precision of the top share of rows; of the score that the border falls into, rows count in proportion."""
    import numpy as np

    k = max(1, int((p_all + n_all) * share))
    before = tp0 + fp0 + np.concatenate(([0], (p + n).cumsum()[:-1]))
    taken = np.clip(k - before, 0, p + n)
    return float((taken * p / np.maximum(p + n, 1)).sum() / k)


#: Metrics with intervals, in the order of their seeds. Each is a sum over ranges of scores.
INTERVALS = {"average_precision": _average_precision, "auroc": _auroc, "precision_at_10pct": _precision_at_share}
#: Distinct scores of a range that a bootstrap's task holds, about, and blocks that replicates are dealt to.
BOOTSTRAP_ROWS, BLOCKS = 200_000, 8


def bootstrap(df: DataFrame, iters: int = 1000, seed: int = 12345, key: str = "nct_id", digits: int | None = None, level: float = 0.95, score: str = "score", y: str = "y", ranges: int | None = None) -> DataFrame:
    """(metric, low, high): stratified bootstrap of average precision, AUROC and precision of the top tenth, the i-th metric with seed + i.

    Labels are counted by score first, and replicates resample those counts (multinomially, per class, as resampling rows would) in two steps: a class's rows are drawn over the
    ranges of scores, and a range's share over its scores. The first step has one number a range and comes from a seed of its own, so that every task makes the same draw and knows what
    lies above its range; a task holds the scores of one range, and each metric is a sum over ranges. So there is no limit on the number of scores."""
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    cuts = cuts_of(df, score, max(1, -(-df.count() // BOOTSTRAP_ROWS)) if ranges is None else ranges)
    counts = located(by_score(df, score, y, digits), cuts)
    totals = sorted((r["part"], r["sub"], r["rp"], r["rn"]) for r in _totals(counts).select("part", "sub", "rp", "rn").collect())  # one row a range
    order = {(part, sub): i for i, (part, sub, _, _) in enumerate(totals)}
    rp, rn = (np.array([t[i] for t in totals], float) for i in (2, 3))
    if rp.sum() < 2 or rn.sum() < 2:
        return spark.createDataFrame([(m, None, None) for m in INTERVALS], "metric string, low double, high double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, block = order[int(pdf["part"].iloc[0]), int(pdf["sub"].iloc[0])], int(pdf["block"].iloc[0])
        rows = pdf.sort_values("s", ascending=False)
        own = [rows[c].to_numpy(float) for c in ("pos", "neg")]
        out = []
        for b in range(block, iters, BLOCKS):
            one = [b]
            for j, f in enumerate(INTERVALS.values()):
                rng = np.random.default_rng([seed + j, b])
                above, drawn = [], []
                for c, (every, counts_) in enumerate(zip((rp, rn), own)):
                    shares = rng.multinomial(int(every.sum()), every / every.sum())
                    above.append(int(shares[:i].sum()))
                    inner = np.random.default_rng([seed + j, b, i, c])
                    drawn.append(inner.multinomial(int(shares[i]), counts_ / counts_.sum()) if shares[i] else np.zeros(len(counts_), int))
                one.append(f(*drawn, *above, int(rp.sum()), int(rn.sum())))
            out.append(one)
        return pd.DataFrame(out, columns=["b", *INTERVALS])

    dealt = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    parts = dealt.groupBy("part", "sub", "block").applyInPandas(run, "b long, " + ", ".join(f"{m} double" for m in INTERVALS))
    reps = parts.groupBy("b").agg(*[F.sum(m).alias(m) for m in INTERVALS])
    tail = (1 - level) / 2
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.percentile(m, F.lit(tail)).alias("low"), F.percentile(m, F.lit(1 - tail)).alias("high")) for m in INTERVALS])
    return reps.agg(pairs.alias("ps")).select(F.explode("ps").alias("p")).select("p.*")


def evaluate(df: DataFrame, threshold: float | None = None, key: str = "nct_id", digits: int | None = None, bootstrap_iters: int = 0, seed: int = 12345, n_bins: int = 10) -> dict:
    """All metrics of one split, rounded to 4 digits; a given threshold is used as it is, otherwise the F1-optimal one is chosen."""
    df = df.select(key, "score", "y")
    n, n_pos = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    if not n:
        return {"n_samples": 0}
    own = threshold is None
    value = f1_threshold(df, digits=digits).first()["threshold"] if own else float(threshold)
    r = lambda v: None if v is None else round(float(v), 4)
    both = 0 < n_pos < n
    bins = calibration(df, min(n_bins, n_pos)).orderBy("bin").collect() if both else []
    out = {
        "n_samples": n, "n_positive": n_pos, "n_negative": n - n_pos, "positive_rate": r(n_pos / n),
        "pr_auc": r(average_precision(df, digits=digits).first()[0]), "auroc": r(auroc(df, digits=digits).first()[0]), "brier_score": r(brier(df).first()[0]),
        "precision_at_k": {x["name"]: r(x["precision"]) for x in precision_at(df, standard_ks(n), key=key).collect()},
        "calibration_bins": {"fraction_of_positives": [x["fraction_of_positives"] for x in bins], "mean_predicted_value": [x["mean_predicted"] for x in bins]},
        "threshold_value": r(value), "threshold_source": "self" if own else "validation", "threshold_metric_used": "f1", "confusion": confusion(df, F.lit(value)).first().asDict(),
        "ece": r(ece(df, max(1, min(10, n_pos)), parity=True).first()[0]) if both else 0.0,
        "pr_auc_ci": None, "auroc_ci": None, "precision_at_10pct_ci": None, "bootstrap_iters": bootstrap_iters, "bootstrap_seed": seed,
    }
    if bootstrap_iters and n_pos > 1 and n - n_pos > 1:
        found = {x["metric"]: [r(x["low"]), r(x["high"])] for x in bootstrap(df, bootstrap_iters, seed, key, digits).collect()}
        out |= {"pr_auc_ci": found["average_precision"], "auroc_ci": found["auroc"], "precision_at_10pct_ci": found["precision_at_10pct"]}
    return out


def summary(result: dict) -> str:
    """One result as text to read."""
    head = " | ".join(str(result[k]) for k in ("model", "features", "benchmark", "split") if k in result)
    ci = lambda k: f"  CI95={tuple(result[k])}" if result.get(k) else ""
    c = result["confusion"]
    lines = [
        head, f"  rows: {result['n_samples']} ({result['n_positive']} positive, {result['n_negative']} negative, rate {result['positive_rate']})",
        f"  PR-AUC: {result['pr_auc']:.4f}{ci('pr_auc_ci')}", f"  AUROC: {result['auroc']:.4f}{ci('auroc_ci')}", f"  Brier: {result['brier_score']:.4f}",
        f"  threshold: {result['threshold_value']:.4f} ({result['threshold_source']}, {result['threshold_metric_used']}): tp={c['tp']} fp={c['fp']} fn={c['fn']} tn={c['tn']}"]
    lines += [f"  {k}: {v:.4f}{ci('precision_at_10pct_ci') if k == 'top_10pct' else ''}" for k, v in result["precision_at_k"].items()]
    return "\n".join(lines) + "\n"


def comparison(results: list[dict]) -> str:
    """A markdown table of results."""
    if not results:
        return "No results to compare."
    names = ["model", "features", "benchmark", "split", "n_samples", "pr_auc", "pr_auc_ci", "auroc", "auroc_ci", "brier_score", "threshold_value"]
    rows = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(rows + ["| " + " | ".join("" if x.get(n) is None else str(x[n]) for n in names) + " |" for x in results]) + "\n"
