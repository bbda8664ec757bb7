"""Benchmark datasets and strictly temporal splits."""

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.scalars import column_date, months_before


@dataclass(frozen=True)
class Benchmark:
    name: str
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    exclude_flags: tuple[str, ...] = field(default=())


#: The ladder of benchmarks (fixed values).
LADDER = [
    Benchmark("strict", ("advanced",), ("hard_negative",)),
    Benchmark("intermediate", ("advanced",), ("hard_negative", "ambiguous_negative")),
    Benchmark("broad_filtered", ("advanced",), ("hard_negative", "ambiguous_negative", "soft_negative"), ("common_asset_flag", "broad_basket_flag")),
    Benchmark("broad_full", ("advanced",), ("hard_negative", "ambiguous_negative", "soft_negative")),
]


def benchmark(name: str) -> Benchmark:
    for b in LADDER:
        if b.name == name:
            return b
    raise ValueError(f"unknown benchmark {name!r}; there are {[b.name for b in LADDER]}")


def first_value(studies: DataFrame, date: str) -> str | None:
    """The first value of a column in row order, whose format all its values are read in."""
    known = studies.where(F.col(date).isNotNull() & (F.trim(F.col(date).cast("string")) != ""))
    row = known.agg(F.min_by(F.col(date).cast("string"), "ordinal")).first() if "ordinal" in studies.columns else known.select(F.col(date).cast("string")).first()
    return row[0] if row else None


def with_date(rows: DataFrame, studies: DataFrame, date: str, name: str) -> DataFrame:
    """The rows with the study's date as column `name`; null where it is unknown or of another format."""
    return rows.join(studies.select("nct_id", column_date(F.col(date).cast("string"), first_value(studies, date)).alias(name)), "nct_id", "left")


def validity(studies: DataFrame, columns: list[str], first: dict[str, str | None] | None = None) -> DataFrame:
    """(column, valid_share) of date columns."""
    first = {c: first_value(studies, c) for c in columns} if first is None else first
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(column_date(F.col(c).cast("string"), first.get(c)).isNotNull().cast("int")).alias("valid_share")) for c in columns])
    return studies.agg(pairs.alias("ps")).select(F.explode("ps").alias("p")).select("p.*")


def date_column(studies: DataFrame, least: float = 0.5) -> str:
    """The first of first_post_date, start_date, last_update_post_date of which more than half are dates."""
    for c in ("first_post_date", "start_date", "last_update_post_date"):
        if c in studies.columns and (validity(studies, [c]).first()["valid_share"] or 0) > least:
            return c
    raise ValueError("no usable date column")


def dataset(labels: DataFrame, studies: DataFrame, which: Benchmark | str, date: str = "first_post_date", task: str | None = "phase2_to_phase3_v1",
            horizon_months: int = 36, today: Column | None = None, not_before: str | None = None) -> DataFrame:
    """(nct_id, label_value, y): members whose horizon has passed; unknown dates stay. Flags exclude negatives only, and only where they are true."""
    b = benchmark(which) if isinstance(which, str) else which
    c = F.col
    rows = labels.where((c("label_type") == "development") & c("label_value").isin([*b.positive, *b.negative]))
    if task is not None:
        rows = rows.where(c("label_task") == task)
    rows = with_date(rows, studies, date, "__d")
    last = months_before(F.current_date() if today is None else today, horizon_months)
    rows = rows.where((c("__d") <= last) | c("__d").isNull())
    if not_before:
        rows = rows.where(~F.coalesce(c("__d") < F.lit(not_before).cast("date"), F.lit(False)))
    flagged = F.lit(False)
    for f in b.exclude_flags:
        if f in labels.columns:
            flagged = flagged | F.coalesce(c(f), F.lit(False))
    only_negative = [v for v in b.negative if v not in b.positive]
    rows = rows.where(~(c("label_value").isin(only_negative) & flagged))
    return rows.select("nct_id", "label_value", c("label_value").isin(list(b.positive)).cast("int").alias("y"))


def temporal_split(data: DataFrame, studies: DataFrame, train_end: str = "2017-12-31", val_end: str = "2019-12-31", date: str = "first_post_date") -> DataFrame:
    """The dataset with `split` and `split_date`; rows without a date are for training."""
    rows = with_date(data, studies, date, "split_date")
    end = lambda s: F.lit(s).cast("date")
    which = F.when(F.col("split_date").isNull() | (F.col("split_date") <= end(train_end)), "train").when(F.col("split_date") <= end(val_end), "val").otherwise("test")
    return rows.withColumn("split", which)


def _counts() -> list[Column]:
    y = F.col("y")
    return [F.count(F.lit(1)).alias("n_total"), F.sum(y).alias("n_positive"), F.sum(1 - y).alias("n_negative")]


def _rate() -> Column:
    return F.bround(F.avg("y"), 4).alias("positive_rate")


def split_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(*_counts(), _rate())


def split_yearly(split: DataFrame) -> DataFrame:
    return split.where(F.col("split_date").isNotNull()).groupBy("split", F.year("split_date").alias("year")).agg(*_counts())


def yearly(data: DataFrame, studies: DataFrame, date: str = "first_post_date") -> DataFrame:
    """Counts and rate of positives by year; unknown years are left out."""
    rows = with_date(data, studies, date, "__d").withColumn("year", F.year("__d")).where("year is not null")
    return rows.groupBy("year").agg(*_counts(), _rate())


def summary(split: DataFrame, date: str, train_end: str, val_end: str, least_test_positives: int = 20) -> dict:
    """What a split is, for its side file, and warnings of a thin test or an empty validation part."""
    stats = {s: {"n_total": 0, "n_positive": 0, "n_negative": 0, "positive_rate": 0} for s in ("train", "val", "test")}
    stats |= {r["split"]: {k: r[k] for k in ("n_total", "n_positive", "n_negative", "positive_rate")} for r in split_stats(split).collect()}
    years: dict = {s: {} for s in stats}
    for r in split_yearly(split).orderBy("split", "year").collect():
        years[r["split"]][r["year"]] = {k: r[k] for k in ("n_total", "n_positive", "n_negative")}
    found = []
    if stats["test"]["n_positive"] < least_test_positives:
        found.append(f"the test part has only {stats['test']['n_positive']} positives (fewer than {least_test_positives})")
    if not stats["val"]["n_total"]:
        found.append(f"the validation part is empty (it ends on {val_end})")
    for w in found:
        warnings.warn(w, stacklevel=2)
    return {"date_column": date, "train_cutoff": train_end, "val_cutoff": val_end, **stats, "yearly_counts": years, "warnings": found}
