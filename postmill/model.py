"""Schemas and constants of brand monitoring."""

from __future__ import annotations

from pyspark.sql import types as T

REDDIT, TWITTER, QUORA, FACEBOOK, LINKEDIN = "Reddit", "Twitter", "Quora", "Facebook", "LinkedIn"
#: In the order in which a report lists them.
PLATFORMS = (FACEBOOK, TWITTER, REDDIT, QUORA)
#: Collected as well, but not listed in a report.
COLLECTED = (*PLATFORMS, LINKEDIN)
#: What each platform is searched for.
KINDS = {REDDIT: "link", QUORA: "answer", FACEBOOK: "post"}
NEGATIVE, POSITIVE, NEUTRAL = "NEGATIVE", "POSITIVE", "NEUTRAL"
LABELS = (NEGATIVE, POSITIVE)


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}


def _struct(text: str) -> T.StructType:
    """A schema from "name type" pairs; unlike DDL parsing it needs no session, so workers can import it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


SCRAPED = _struct("social string, posts string")
RAW = _struct("id bigint, social string, posts string")
LABELLED = _struct("id bigint, number bigint, social string, posts string, sentiment string")
#: The counts of a report, in order, before its score.
COUNTS = tuple(f"{p.lower()}_{s.lower()}" for p in ("total", *PLATFORMS) for s in LABELS)
REPORT = _struct(", ".join([*(f"{c} bigint" for c in COUNTS), "score double"]))
HISTORY = _struct(", ".join(["id bigint", "date date", *(f"{c} bigint" for c in COUNTS), "score double"]))
