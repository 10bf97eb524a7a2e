"""One run, from posts to the history of reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from postmill.functions.text import table_name
from postmill.operators.report import report, summary
from postmill.operators.scoring import Scorer
from postmill.operators.sinks import append_report, deliver, numbered, read_table, write_labelled, write_raw
from pyspark.sql import functions as F


def run(posts: DataFrame, search: str, folder: str, scorer: Scorer, receiver: str | None = None, send: Callable[[str, str, str], None] | None = None, on: date | None = None, say: Callable[[str], None] | None = None) -> DataFrame:
    """Store the posts, label what was stored, report on it, add the report to the history and return it.

    Posts are written and read back before anything uses them, so that they have their ids and a source that can't repeat its rows
    is read once. A second run replaces posts and labelled posts and adds to the history. ``say`` gets the progress: the seconds the
    collection took, the first posts, and the summary.
    """
    say, began = say or (lambda line: None), time.monotonic()
    spark = posts.sparkSession
    name = spark.range(1).select(table_name(F.lit(search)).alias("a"), table_name(F.lit(search), "_text_sentiment_table").alias("b")).first()
    raw, labelled = f"{folder}/{name['a']}", f"{folder}/{name['b']}"
    write_raw(numbered(posts.select("social", "posts"), "social", "posts").select("id", "social", "posts"), raw)
    say(f"Collected in {time.monotonic() - began:.1f} s")
    for row in read_table(spark, raw).orderBy("id").limit(5).collect():
        say(f"{row['id']} {row['social']}: {row['posts']}")
    scored = scorer(read_table(spark, raw)).select("id", F.col("id").alias("number"), "social", "posts", "sentiment")
    write_labelled(scored, labelled)
    result = report(read_table(spark, labelled))
    for row in summary(result).orderBy("line").collect():
        say(row["text"])
    append_report(result, f"{folder}/history", search, on)
    if receiver:
        deliver(result, search, receiver, send)
    return result
