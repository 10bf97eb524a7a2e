"""Ways to give a post its label. A scorer is a function from a DataFrame to the same rows with ``sentiment``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.model import NEGATIVE, NEUTRAL, POSITIVE

Scorer = Callable[[DataFrame], DataFrame]


def from_labels(labels: DataFrame, key: str = "id", number: str = "number", sentiment: str = "sentiment") -> Scorer:
    """Labels from a table; a post with several gets the one with the least id, a post without gets NULL."""

    def score(df: DataFrame) -> DataFrame:
        first = labels.where(F.col(number).isNotNull()).groupBy(F.col(number).alias("_number")).agg(F.min(F.struct("id", sentiment)).alias("_first"))
        return df.join(first, F.col(key) == F.col("_number"), "left").withColumn("sentiment", F.col("_first")[sentiment]).drop("_number", "_first")

    return score


def word_hits(text: Column, words: Iterable[str]) -> Column:
    """How many words of a text are in the list."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.size(F.filter(tokens, lambda w: w.isin(*sorted(words)))).cast("bigint")


def by_lexicon(positive: Iterable[str], negative: Iterable[str], band: int = 0, text: str = "posts") -> Scorer:
    """The label with more words. Within ``band`` of each other, and above it, the post is neutral; a tie without a band is negative; NULL stays NULL."""

    def score(df: DataFrame) -> DataFrame:
        lead = word_hits(F.col(text), positive) - word_hits(F.col(text), negative)
        label = F.when(F.col(text).isNull(), F.lit(None).cast("string"))
        if band:
            label = label.when(F.abs(lead) < band, NEUTRAL)
        return df.withColumn("sentiment", label.when(lead > 0, POSITIVE).otherwise(NEGATIVE))

    return score


def by_model(load: Callable[[], Callable[[list[str]], list[str]]], text: str = "posts") -> Scorer:
    """Labels from any model. ``load`` runs once in each task and gives a function from texts to labels; NULL texts get NULL, long ones go whole."""

    @F.pandas_udf("string")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            known = part.notna()
            out[known] = model(part[known].tolist())
            yield out

    return lambda df: df.withColumn("sentiment", label(F.col(text)))


def top_label(ranked: Column) -> Column:
    """The label with the highest score of an array of (label, score); of equal scores the first one's, NULL for none."""
    best = F.array_max(F.transform(ranked, lambda x: x["score"]))
    return F.try_element_at(F.filter(ranked, lambda x: x["score"] == best), F.lit(1))["label"]


def by_ranked_model(load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], text: str = "posts") -> Scorer:
    """Labels from a model that gives each text its labels with scores; the top one is taken."""

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def ranked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            known = part.notna()
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            for i, scores in zip(part.index[known], model(part[known].tolist())):
                out[i] = [{"label": label, "score": float(score)} for label, score in scores]
            yield out

    return lambda df: df.withColumn("_ranked", ranked(F.col(text))).withColumn("sentiment", top_label(F.col("_ranked"))).drop("_ranked")


def banded(value: Column, low: float = 4.0, high: float = 6.0) -> Column:
    """A score from 0 to 10 as one of three labels; the ends of the band are neutral."""
    return F.when(value < low, NEGATIVE).when(value > high, POSITIVE).when(value.isNotNull(), NEUTRAL)
