"""Counts by platform and label, and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.model import COUNTS, LABELS, NEGATIVE, PLATFORMS, POSITIVE


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """How often each value occurs, NULL in the last column left out. Order is the caller's."""
    return df.where(F.col(cols[-1]).isNotNull()).groupBy(*cols).agg(F.count("*").alias("n"))


def score(positive: Column, negative: Column) -> Column:
    """Ten times the share of positive posts; NULL where nothing was counted."""
    return F.try_divide(positive.cast("double"), (positive + negative).cast("double")) * F.lit(10.0)


def _counts(social: str, sentiment: str) -> list[Column]:
    label = F.col(sentiment)
    out = [F.count(F.when(label == x, 1)).alias(f"total_{x.lower()}") for x in LABELS]
    for p in PLATFORMS:
        out += [F.count(F.when((F.col(social) == p) & (label == x), 1)).alias(f"{p.lower()}_{x.lower()}") for x in LABELS]
    return out


def report(df: DataFrame, *by: str, social: str = "social", sentiment: str = "sentiment") -> DataFrame:
    """Ten counts and the score, in one aggregation; one row, or one for each value of ``by``.

    Values are compared exactly. Other platforms count in the totals only, other labels nowhere. Without rows the
    counts are 0 and the score NULL.
    """
    grouped = df.groupBy(*by).agg(*_counts(social, sentiment))
    return grouped.withColumn("score", score(F.col("total_positive"), F.col("total_negative")))


def long_report(df: DataFrame, social: str = "social", sentiment: str = "sentiment") -> DataFrame:
    """A row for each of the four platforms and one for all posts, by grouping sets."""
    counts = [F.count(F.when(F.col(sentiment) == x, 1)).alias(x.lower()) for x in (NEGATIVE, POSITIVE)]
    every = df.rollup(social).agg(*counts, F.grouping(social).alias("_all"))
    kept = every.where((F.col("_all") == 1) | F.col(social).isin(*PLATFORMS))
    name = F.when(F.col("_all") == 1, "Total").otherwise(F.col(social)).alias("social")
    return kept.select(name, "negative", "positive", score(F.col("positive"), F.col("negative")).alias("score"))


def analysed() -> Column:
    """All posts with a label, of a report row."""
    return F.col("total_negative") + F.col("total_positive")


def summary(df: DataFrame) -> DataFrame:
    """The lines of a run's console summary, from a row of counts: (line, text)."""
    lines = [F.concat(F.lit("Analysed: "), analysed().cast("string"))]
    for p in ("total", *(x.lower() for x in PLATFORMS)):
        lines.append(F.concat(F.lit(f"{p.capitalize()}: "), F.col(f"{p}_positive").cast("string"), F.lit(" positive, "), F.col(f"{p}_negative").cast("string"), F.lit(" negative")))
    return df.select(F.posexplode(F.array(*lines)).alias("line", "text")).select((F.col("line") + 1).cast("bigint").alias("line"), "text")


__all__ = ["COUNTS", "analysed", "long_report", "report", "score", "summary", "value_counts"]
