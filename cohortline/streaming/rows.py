"""Row-local operators over streams: rules without a shuffle hold for a stream as they do for a table."""

from pyspark.sql import DataFrame

from cohortline.operators import labels
from cohortline.operators.cohort import STANDARD, CohortConfig, with_reason


def mark_exclusions(stream: DataFrame, config: CohortConfig = STANDARD) -> DataFrame:
    """Arriving studies with their first failing rule."""
    return with_reason(stream, config)


def operational_labels(stream: DataFrame) -> DataFrame:
    return labels.operational(stream)
