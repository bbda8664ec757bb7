"""Cohort filters with a reason for every exclusion, in one pass over the studies."""

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.scalars import column_date, norm_phase, norm_status, number, tokens
from cohortline.operators import selection


@dataclass
class CohortConfig:
    """What is let in, what is kept out, and what must be there. Empty lists switch a rule off."""

    study_type: list[str] = field(default_factory=list)
    intervention_type: list[str] = field(default_factory=list)
    phase: list[str] = field(default_factory=list)
    sponsor_class: list[str] = field(default_factory=list)
    outcome_status: list[str] = field(default_factory=list)
    excluded_study_type: list[str] = field(default_factory=list)
    excluded_intervention_type: list[str] = field(default_factory=list)
    required_fields: list[str] = field(default_factory=list)

    @classmethod
    def from_dict(cls, d: dict) -> "CohortConfig":
        inc, exc = d.get("inclusion", {}) or {}, d.get("exclusion", {}) or {}
        return cls(*[inc.get(k) or [] for k in ("study_type", "intervention_type", "phase", "sponsor_class", "outcome_status")],
                   exc.get("study_type") or [], exc.get("intervention_type") or [], d.get("required_fields") or [])


#: The standard cohort of phases 1 to 3 with an industry sponsor (fixed values).
STANDARD = CohortConfig(
    ["Interventional"], ["Drug", "Biological"], ["Phase 1", "Phase 2", "Phase 3", "Phase 1/Phase 2", "Phase 2/Phase 3", "Early Phase 1"], ["INDUSTRY"],
    ["Completed", "Terminated", "Withdrawn", "Suspended", "Active, not recruiting", "Enrolling by invitation"],
    ["Observational", "Expanded Access"], ["Device", "Behavioral", "Dietary Supplement", "Procedure", "Radiation", "Diagnostic Test"],
    ["nct_id", "brief_title", "study_type", "phases", "overall_status", "lead_sponsor", "start_date"])


def _plain(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "_", " ")


def keep_study_type(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(_plain(c).isin([a.lower() for a in allowed]), F.lit(False))


def keep_any_intervention(c: Column, allowed: list[str]) -> Column:
    """Any token is allowed; underscores count as spaces; a null column is out."""
    return F.coalesce(F.arrays_overlap(F.transform(tokens(c), _plain), F.array(*[F.lit(a.lower()) for a in allowed])), F.lit(False))


def keep_phase(c: Column, allowed: list[str]) -> Column:
    """Any token is allowed; `/` separates tokens too, so an allowed `Phase 1/Phase 2` never matches as a unit."""
    own = F.transform(tokens(F.regexp_replace(c, "/", ";")), norm_phase)
    return F.coalesce(F.arrays_overlap(own, F.array(*[norm_phase(F.lit(a)) for a in allowed])), F.lit(False))


def keep_sponsor_class(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.upper(c).isin([a.upper() for a in allowed]), F.lit(False))


def keep_status(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(norm_status(c).isin([a.lower().replace("_", " ").replace(",", "") for a in allowed]), F.lit(False))


def not_study_type(c: Column, excluded: list[str]) -> Column:
    return ~F.coalesce(_plain(c).isin([a.lower() for a in excluded]), F.lit(False))


def not_all_interventions(c: Column, excluded: list[str]) -> Column:
    """Out only if every token is excluded, or there is no text; underscores stay as they are here."""
    left = F.array_except(F.transform(tokens(c), F.lower), F.array(*[F.lit(a.lower()) for a in excluded]))
    return F.coalesce(F.size(left) > 0, F.lit(False))


def has_required(df: DataFrame, fields: list[str]) -> Column:
    """All of the fields that the table has are there; unknown fields are passed over."""
    out = F.lit(True)
    for f in fields:
        if f in df.columns:
            out = out & F.col(f).isNotNull()
    return out


def rules(df: DataFrame, config: CohortConfig) -> list[tuple[str, Column]]:
    """(reason, predicate to keep) in order."""
    c = F.col
    every = [
        ("study_type not in {}", config.study_type, lambda v: keep_study_type(c("study_type"), v)),
        ("intervention_type not in {}", config.intervention_type, lambda v: keep_any_intervention(c("intervention_types"), v)),
        ("phase not in {}", config.phase, lambda v: keep_phase(c("phases"), v)),
        ("lead_sponsor_class not in {}", config.sponsor_class, lambda v: keep_sponsor_class(c("lead_sponsor_class"), v)),
        ("overall_status not in {}", config.outcome_status, lambda v: keep_status(c("overall_status"), v)),
        ("study_type in excluded list {}", config.excluded_study_type, lambda v: not_study_type(c("study_type"), v)),
        ("all intervention_types in excluded list {}", config.excluded_intervention_type, lambda v: not_all_interventions(c("intervention_types"), v)),
        ("missing required fields from {}", config.required_fields, lambda v: has_required(df, v)),
    ]
    return [(name.format(v), rule(v)) for name, v, rule in every if v]


def with_reason(df: DataFrame, config: CohortConfig) -> DataFrame:
    """Each row with its first failing rule; null where it is kept."""
    tests = [F.when(~F.coalesce(keep, F.lit(False)), reason) for reason, keep in rules(df, config)]
    return df.withColumn("exclusion_reason", F.coalesce(*tests) if tests else F.lit(None).cast("string"))


def split(df: DataFrame, mask: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with the reason); an unknown mask excludes."""
    keep = F.coalesce(mask, F.lit(False))
    return df.where(keep), df.where(~keep).withColumn("exclusion_reason", F.lit(reason))


def apply_filters(df: DataFrame, config: CohortConfig) -> tuple[DataFrame, DataFrame]:
    """(cohort, exclusion log), from one pass of rules."""
    marked = with_reason(df, config)
    return marked.where(F.col("exclusion_reason").isNull()).drop("exclusion_reason"), marked.where(F.col("exclusion_reason").isNotNull())


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def token_frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of the tokens of a delimited column; ties of a top list go by value."""
    out = df.select(F.explode(tokens(F.col(column))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def enrollment_summary(df: DataFrame) -> DataFrame:
    e = number(F.col("enrollment"))
    middle = selection.medians(df, {"m": e})["m"]
    return df.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(e), 1).alias("mean"), F.bround(F.lit(middle).cast("double"), 1).alias("median"), F.min(e).alias("least"), F.max(e).alias("most"))


def date_range(df: DataFrame, column: str = "start_date", first: str | None = "2000-01-01") -> DataFrame:
    d = column_date(F.col(column), first)
    return df.agg(F.min(d).cast("string").alias("first_date"), F.max(d).cast("string").alias("last_date"), F.count_if(F.col("has_results")).alias("n_with_results"))


def content_hash(df: DataFrame, key: str = "nct_id") -> DataFrame:
    """The first 12 hex digits of the sha256 of the sorted ids joined by commas, and their number.

    The hash is a chain over all ids in order: they are sorted by the cluster, packed where they lie (sorted ids pack well) and stream through the driver, one partition's packs at a time."""
    chain, n = hashlib.sha256(), 0
    for r in packed(df.select(F.col(key).cast("string").alias("id")).where("id is not null").sort("id")).toLocalIterator():
        chain.update(("," if n else "").encode() + zlib.decompress(r["pack"]))
        n += r["n"]
    return df.sparkSession.createDataFrame([(chain.hexdigest()[:12], n)], "content_hash string, n long")


def packed(ids: DataFrame) -> DataFrame:
    """(n, pack): the ids of a column, in their order, joined by commas and compressed, a row a batch."""
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([zlib.compress(",".join(b.column(0).to_pylist()).encode())], pa.binary())], ["n", "pack"])

    return ids.mapInArrow(pack, "n long, pack binary")


def summarize(df: DataFrame) -> dict:
    """The cohort summary as one dictionary; every table in it is small."""
    pairs = lambda d: {r["value"]: r["n"] for r in d.orderBy(F.desc("n"), "value").collect()}
    out = {"n_studies": df.count(), "phases": pairs(frequency(df, "phases")), "overall_status": pairs(frequency(df, "overall_status")),
           "lead_sponsor_class": pairs(frequency(df, "lead_sponsor_class")), "intervention_types": pairs(token_frequency(df, "intervention_types")),
           "top_conditions": pairs(token_frequency(df, "conditions", 20)), "enrollment": enrollment_summary(df).first().asDict()}
    if "has_results" in df.columns and "start_date" in df.columns:
        out["dates"] = date_range(df).first().asDict()
    return out


def build_cohort(studies: DataFrame, config: CohortConfig = STANDARD) -> tuple[DataFrame, DataFrame, dict]:
    """(cohort, exclusion log, metadata): filters, hash of the ids, counts and summary."""
    kept, out = apply_filters(studies, config)
    h = content_hash(kept).first()
    return kept, out, {"config": vars(config), "content_hash": h["content_hash"], "n_kept": h["n"], "n_excluded": out.count(), "summary": summarize(kept)}
