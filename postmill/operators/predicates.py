"""What a platform's search offers: predicates, order and limits, as Column builders."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.model import KINDS, QUORA, TWITTER

LINK = r"https?://"


def mentions(text: Column, term: Column) -> Column:
    """The term occurs in the text, in any letter case. A NULL on either side is no mention."""
    return F.coalesce(F.instr(F.lower(text), F.lower(term)) > 0, F.lit(False))


def in_language(lang: Column, code: str = "en") -> Column:
    return lang == code


def without_links(text: Column) -> Column:
    return ~text.rlike(LINK)


def since_until(at: Column, since: date | datetime, until: date | datetime) -> Column:
    """From ``since``, before ``until``."""
    return (at >= F.lit(since)) & (at < F.lit(until))


def in_year(at: Column, year: int) -> Column:
    return since_until(at, date(year, 1, 1), date(year + 1, 1, 1))


def content_kind(social: Column, text: Column) -> Column:
    """What a post is: an answer on the question platform, elsewhere a link if it has one, else a post."""
    return F.when(social == QUORA, "answer").when(text.rlike(LINK), "link").otherwise("post")


def of_searched_kind(social: Column, kind: Column) -> Column:
    """The post is of the kind that its platform is searched for; other platforms take any kind."""
    wanted = F.coalesce(*[F.when(social == p, k) for p, k in KINDS.items()])
    return F.coalesce(kind == wanted, F.lit(True))


def year_filter_blob(year: int) -> Column:
    """The creation-time filter of a search address: nested JSON in base 64."""
    args = F.to_json(F.struct(F.lit(str(year)).alias("start_year"), F.lit(f"{year}-1").alias("start_month"), F.lit(str(year)).alias("end_year"), F.lit(f"{year}-12").alias("end_month"), F.lit(f"{year}-1-1").alias("start_day"), F.lit(f"{year}-12-31").alias("end_day")))
    return F.replace(F.base64(F.to_json(F.struct(F.to_json(F.struct(F.lit("creation_time").alias("name"), args.alias("args"))).alias("rp_creation_time:0"))).cast("binary")), F.lit("\r\n"), F.lit(""))


def newest_first(df: DataFrame, at: str, key: str) -> DataFrame:
    """Newest first, ties by key; NULL times last."""
    return df.orderBy(F.col(at).desc_nulls_last(), F.col(key))


def attempts(social: Column, n: int, strict: bool = True) -> Column:
    """How many items a source tries for ``n`` requested posts.

    ``strict`` keeps the counting of the original collectors: one less than asked for, Twitter never above 24, Quora always 4.
    Otherwise n, at most 25 on Twitter.
    """
    less = 1 if strict else 0
    rest = max(0, n - less)
    return F.when(social == QUORA, 4 if strict else rest).when(social == TWITTER, max(0, min(n, 25) - less)).otherwise(rest)


def per_source_limit(df: DataFrame, n: int, social: str = "social", order: str = "id", text: str = "posts", strict: bool = True) -> DataFrame:
    """The first items of each source. An item without text uses up an attempt and is then left out."""
    rank = F.row_number().over(Window.partitionBy(social).orderBy(order))
    # The largest number of attempts bounds the rank, which lets Spark keep only so many rows of a source in each task.
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= max(4, n))
    return ranked.where((F.col("_rank") <= attempts(F.col(social), n, strict)) & F.col(text).isNotNull()).drop("_rank")
