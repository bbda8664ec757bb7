"""A stratified sample of labels for review: the sample is the feature, so its sizes are limits by design."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Label values by bucket, with what a bucket is called and its place (fixed values).
BUCKETS = {
    "advanced": "positive (advanced)", "hard_negative": "negative (hard)", "ambiguous_negative": "negative (ambiguous)", "soft_negative": "negative (soft)",
    "excluded_positive_terminal": "edge (positive_terminal)", "censored_recent": "edge (censored_recent)", "censored_in_progress": "edge (censored_in_progress)",
    "censored_early_negative": "edge (censored_early_negative)", "excluded_other": "edge (excluded)",
}

#: Columns of a review, in order (fixed values).
REVIEW_COLUMNS = [
    "nct_id", "label_value", "label_confidence", "evidence_source", "notes", "event_label", "event_category", "event_observed", "event_detail", "evidence_nct_id",
    "successor_phase", "temporal_gap_months", "condition_overlap", "intervention_similarity", "lifecycle_flag", "broad_basket_flag", "supportive_flag", "common_asset_flag",
    "brief_title", "phases", "overall_status", "lead_sponsor", "intervention_names", "conditions", "primary_purpose", "first_post_date", "start_date",
    "primary_completion_date", "completion_date", "enrollment", "n_locations", "why_stopped", "url",
]


def distribution(labels: DataFrame, column: str) -> DataFrame:
    """(value, n), the most frequent first; a missing value is counted too."""
    return labels.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def targets(n_positive: int = 50, n_negative: int = 50, n_edge: int = 25) -> dict[str, int]:
    third = n_negative // 3
    edge = ["excluded_positive_terminal", "censored_recent", "censored_in_progress", "censored_early_negative", "excluded_other"]
    return {"advanced": n_positive, "hard_negative": third, "ambiguous_negative": third, "soft_negative": n_negative - 2 * third} | {e: n_edge // 5 for e in edge}


def in_phase(labels: DataFrame, phase: str = "PHASE2") -> DataFrame:
    """Rows of the phase, and rows excluded for another reason than their phase. `phases` must be there."""
    v = F.col("label_value")
    return labels.where(F.coalesce(F.upper("phases").contains(phase.upper()), F.lit(False)) | (v.startswith("excluded_") & ~v.contains("phase")))


def sample(labels: DataFrame, sizes: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """Up to a bucket's size of its rows, by a hash of the id. Each task keeps its own best first, so that no bucket meets whole in one task."""
    sizes = targets() if sizes is None else sizes
    v = F.col("label_value")
    bucket = F.when(v.isin([b for b in BUCKETS if b != "excluded_other"]), v).when(v.startswith("excluded_"), "excluded_other")
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rows = labels.withColumn("bucket", bucket).where("bucket is not null").withColumn("order", F.md5(F.concat(F.col("nct_id"), F.lit(f":{seed}"))))
    best = F.row_number().over(Window.partitionBy("bucket", F.pmod(F.xxhash64("nct_id"), F.lit(64))).orderBy("order", "nct_id"))
    rows = rows.withColumn("r", best).where(F.col("r") <= F.try_element_at(size, F.col("bucket")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("order", "nct_id"))).where(F.col("r") <= F.try_element_at(size, F.col("bucket")))
    name = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return rows.withColumn("audit_bucket", F.try_element_at(name, F.col("bucket"))).drop("r", "order", "bucket")


def review(sampled: DataFrame, studies: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The sample beside the study's columns (a clash gets the suffix _study) and a link, buckets in order."""
    right = studies.select("nct_id", *[F.col(c).alias(f"{c}_study" if c in sampled.columns else c) for c in studies.columns if c != "nct_id"])
    out = sampled.join(right, "nct_id", "left").withColumn("url", F.concat(F.lit("https://clinicaltrials.gov/study/"), F.col("nct_id")))
    place = F.create_map(*[F.lit(x) for i, n in enumerate(BUCKETS.values()) for x in (n, i)])
    out = out.orderBy(F.coalesce(F.try_element_at(place, F.col("audit_bucket")), F.lit(99)), "nct_id")
    return out.select([c for c in columns if c in out.columns]) if columns else out
