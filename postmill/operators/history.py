"""The history of reports: changes of the score, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_changes(history: DataFrame, *by: str) -> DataFrame:
    """Each report with the score before it, by date and id, and the change; NULL scores are passed over as predecessors.

    ``by`` are the columns whose values have a history of their own. The busiest of them is one window, of one row a report.
    """
    earlier = Window.partitionBy(*by).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("score", ignorenulls=True).over(earlier)
    return history.withColumn("previous_score", before).withColumn("change", F.col("score") - F.col("previous_score"))


def alerts(history: DataFrame, *by: str, threshold: float = 2.0) -> DataFrame:
    """The reports whose score moved by at least ``threshold``."""
    return score_changes(history, *by).where(F.abs("change") >= threshold)


def latest(history: DataFrame, *by: str) -> DataFrame:
    """The last report by date and id for each value of ``by``."""
    row = F.max(F.struct("date", "id", *[c for c in history.columns if c not in ("date", "id", *by)])).alias("_last")
    return history.groupBy(*by).agg(row).select(*by, "_last.*")
