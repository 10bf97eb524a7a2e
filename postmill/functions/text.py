"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encoded(value: Column) -> Column:
    """Percent-encoding of a search term: blanks as %20, slashes and tildes as they are, stars encoded."""
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def plus_joined(value: Column) -> Column:
    """The words of a search term joined by plus signs, without any escaping."""
    return F.array_join(F.filter(F.split(value, r"\s+"), lambda w: w != ""), "+")


def table_name(brand: Column, suffix: str = "_table") -> Column:
    """A brand without blanks, and a suffix; tabs and all other characters stay."""
    return F.concat(F.replace(brand, F.lit(" "), F.lit("")), F.lit(suffix))


def post_count(text: Column) -> Column:
    """The number of posts asked for, NULL where the text is no whole number."""
    return F.try_to_number(F.trim(text), F.lit("9999999999")).cast("int")


def report_body(search: Column) -> Column:
    """The text of the report on one row of counts; each line gives positive first."""

    def n(name: str) -> Column:
        return F.col(name).cast("string")

    lines = [
        F.concat(F.lit("1. Score: "), F.coalesce(F.round("score", 2).cast("string"), F.lit("none")), F.lit(" out of 10.")),
        F.concat(F.lit("2. Posts on "), search, F.lit(" with a label: "), (F.col("total_negative") + F.col("total_positive")).cast("string"), F.lit(".")),
        F.concat(F.lit("3. In total: "), n("total_positive"), F.lit(" positive, "), n("total_negative"), F.lit(" negative.")),
    ]
    for i, p in enumerate(("facebook", "twitter", "reddit", "quora"), 4):
        lines.append(F.concat(F.lit(f"{i}. {p.capitalize()}: "), n(f"{p}_positive"), F.lit(" positive, "), n(f"{p}_negative"), F.lit(" negative.")))
    return F.array_join(F.array(*lines), "\n")
