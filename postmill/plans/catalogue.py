"""The reference's operators as queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.html import by_attribute, elements, escaped, nth, parsed_text, text_content
from postmill.functions.text import percent_encoded, plus_joined, post_count, report_body, table_name
from postmill.model import COUNTS, PLATFORMS
from postmill.operators.history import alerts, latest, score_changes
from postmill.operators.predicates import content_kind, in_language, in_year, mentions, newest_first, of_searched_kind, per_source_limit, since_until, without_links, year_filter_blob
from postmill.operators.report import long_report, report, summary, value_counts
from postmill.operators.scoring import banded, by_lexicon, by_ranked_model, from_labels
from postmill.operators.sinks import append_report, numbered, read_table, write_labelled, write_raw
from postmill.session import new_path
from postmill.streaming.report import event_stream, latest_daily, start_daily, start_report

GOOD = ("flawless", "impressed", "perfectly", "trust", "thoughtful", "beeindruckt", "encantado", "conquis", "tadellos")
BAD = ("trouble", "absurd", "ruined", "broken", "overheats", "waste", "kaputt", "ilegible", "frech")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts_scan(spark, d):
    return _t(spark, d, "raw_posts").select("id", "social", "posts")


def posts_head(spark, d):
    return _t(spark, d, "raw_posts").select("id", "social", "posts").orderBy("id").limit(5)


def union_platforms(spark, d):
    """The bag of all platforms' posts: one scan."""
    return _t(spark, d, "raw_posts").where(F.col("social").isin(*PLATFORMS) & F.col("posts").isNotNull()).select("social", "posts")


def sentiment_value_counts(spark, d):
    return value_counts(_t(spark, d, "labelled_posts"), "sentiment").orderBy(F.desc("n"))


def platform_value_counts(spark, d):
    return value_counts(_t(spark, d, "labelled_posts").where(F.col("social").isin(*PLATFORMS)), "social", "sentiment")


def report_wide(spark, d):
    return report(_t(spark, d, "labelled_posts"))


def report_long(spark, d):
    return long_report(_t(spark, d, "labelled_posts"))


def report_by_brand(spark, d):
    posts = _t(spark, d, "raw_posts").select(F.col("id").alias("number"), "brand")
    return report(_t(spark, d, "labelled_posts").join(posts, "number"), "brand")


def report_by_run(spark, d):
    posts = _t(spark, d, "raw_posts").select(F.col("id").alias("number"), "run_id")
    return report(_t(spark, d, "labelled_posts").join(posts, "number"), "run_id")


def history_against_posts(spark, d):
    """Reports whose totals differ from the counts of their run's rows."""
    now = report_by_run(spark, d).select("run_id", F.col("total_negative").alias("now_negative"), F.col("total_positive").alias("now_positive"))
    rows = _t(spark, d, "report_history").join(now, "run_id", "left")
    differs = ~(F.col("total_negative").eqNullSafe(F.coalesce("now_negative", F.lit(0))) & F.col("total_positive").eqNullSafe(F.coalesce("now_positive", F.lit(0))))
    return rows.where(differs).select("id", "run_id", "total_negative", "total_positive", "now_negative", "now_positive")


def source_limit(spark, d):
    posts = _t(spark, d, "raw_posts").where(F.col("social").isin(*PLATFORMS)).select("id", "social", "posts")
    return per_source_limit(posts, 50)


def keyword_search(spark, d):
    return _t(spark, d, "raw_posts").where(mentions(F.col("posts"), F.col("brand"))).select("id", "brand")


def since_until_posts(spark, d):
    return _t(spark, d, "raw_posts").where(since_until(F.col("posted_at"), datetime(2023, 7, 1), datetime(2023, 11, 30))).select("id", "posted_at")


def english_without_links(spark, d):
    return _t(spark, d, "raw_posts").where(in_language(F.col("lang")) & without_links(F.col("posts"))).select("id", "social")


def newest_posts(spark, d):
    return newest_first(_t(spark, d, "raw_posts").select("id", "posted_at"), "posted_at", "id").limit(100)


def run_tables(spark, d):
    return _t(spark, d, "run_params").select("run_id", table_name(F.col("search")).alias("posts_table"), table_name(F.col("search"), "_sentimenttable").alias("history_table"))


def brand_table_collisions(spark, d):
    """Table names that only differ in letter case."""
    low = F.lower(table_name(F.col("brand"))).alias("folded")
    return _t(spark, d, "brands").select(low, "brand").groupBy("folded").agg(F.count("*").alias("brands")).where("brands > 1")


def encoded_searches(spark, d):
    term = F.col("search")
    return _t(spark, d, "run_params").select("run_id", percent_encoded(term).alias("encoded"), plus_joined(term).alias("joined"))


def report_bodies(spark, d):
    return report_by_brand(spark, d).where(F.col("brand").isNotNull()).select("brand", report_body(F.col("brand")).alias("body"))


def history_changes(spark, d):
    return score_changes(_t(spark, d, "report_history"), "brand").select("id", "brand", "score", "previous_score", "change")


def history_alerts(spark, d):
    return alerts(_t(spark, d, "report_history"), "brand").select("id", "brand", "change")


def history_latest(spark, d):
    return latest(_t(spark, d, "report_history"), "brand").select("brand", "date", "id", "score")


def history_bands(spark, d):
    return _t(spark, d, "report_history").select("id", banded(F.col("score")).alias("band"))


def daily_scores(spark, d):
    posts = _t(spark, d, "raw_posts").select(F.col("id").alias("number"), F.col("posted_at").cast("date").alias("date"))
    return report(_t(spark, d, "labelled_posts").join(posts, "number").where(F.col("date").isNotNull()), "date").select("date", "total_negative", "total_positive", "score")


def label_join(spark, d):
    scored = from_labels(_t(spark, d, "labelled_posts").select("id", "number", "sentiment"))(_t(spark, d, "raw_posts").select("id", "social"))
    return scored.select("id", "social", "sentiment")


def lexicon_labels(spark, d):
    return by_lexicon(GOOD, BAD)(_t(spark, d, "raw_posts").select("id", "posts")).select("id", "sentiment")


def _pages(spark, d):
    """Posts as pages: the brand as a heading, each line as a paragraph."""
    lines = F.array_join(F.transform(F.split(escaped(F.col("posts")), "\n"), lambda x: F.concat(F.lit('<p class="t">'), x, F.lit("</p>"))), "")
    head = F.concat(F.lit("<html><h1>"), escaped(F.coalesce("brand", F.lit(""))), F.lit("</h1>"))
    return _t(spark, d, "raw_posts").where(F.col("posts").isNotNull()).select("id", F.concat(head, lines, F.lit("</html>")).alias("html"))


def page_heading(spark, d):
    return _pages(spark, d).select("id", text_content(nth(F.col("html"), "h1", 1)).alias("heading"), text_content(by_attribute(F.col("html"), "p", "class", "t")).alias("first"))


def nth_paragraph(spark, d):
    return _pages(spark, d).select("id", F.posexplode(elements(F.col("html"), "p")).alias("p", "x")).select("id", (F.col("p") + 1).cast("bigint").alias("k"), text_content(F.col("x")).alias("text"))


def second_paragraph(spark, d):
    """The item after the first: positions of one platform are moved by one."""
    return _pages(spark, d).select("id", text_content(nth(F.col("html"), "p", 1, offset=1)).alias("text"))


def page_text(spark, d):
    return _pages(spark, d).select("id", parsed_text(F.col("html")).alias("text"))


def searched_kinds(spark, d):
    kind = content_kind(F.col("social"), F.col("posts"))
    return _t(spark, d, "raw_posts").where(F.col("posts").isNotNull()).select("id", "social", kind.alias("kind")).where(of_searched_kind(F.col("social"), F.col("kind")))


def posts_of_year(spark, d):
    return _t(spark, d, "raw_posts").where(in_year(F.col("posted_at"), 2023)).select("id", "posted_at", year_filter_blob(2023).alias("filter"))


def requested_counts(spark, d):
    return _t(spark, d, "run_params").select("run_id", post_count(F.col("no_post").cast("string")).alias("requested"), post_count(F.col("search")).alias("no_number"))


def raw_round_trip(spark, d):
    """Posts of a run, numbered, stored twice and read back."""
    path = new_path(spark, "raw")
    rows = numbered(union_platforms(spark, d), "social", "posts").select("id", "social", "posts")
    write_raw(rows.limit(0), path)
    write_raw(rows, path)
    return read_table(spark, path)


def labelled_round_trip(spark, d):
    path = new_path(spark, "labelled")
    write_labelled(lexicon_labels(spark, d).select("id", F.col("id").alias("number"), "sentiment"), path)
    return read_table(spark, path)


def history_round_trip(spark, d):
    """The same report added to a history twice."""
    path = new_path(spark, "history")
    for day in (1, 2):
        append_report(report_wide(spark, d), path, "all", datetime(2024, 1, day).date())
    return read_table(spark, path).select("id", "date", F.col("brand").cast("string").alias("brand"), *COUNTS, "score")


def ranked_labels(spark, d):
    """Labels of a model that gives each label a score, here its number of words."""
    good, bad = frozenset(GOOD), frozenset(BAD)

    def load():
        import regex

        split = regex.compile(r"[^\p{L}\p{N}]+")

        def model(texts):
            words = [split.split(t.lower()) for t in texts]
            return [[("NEGATIVE", sum(w in bad for w in x)), ("POSITIVE", sum(w in good for w in x))] for x in words]

        return model

    return by_ranked_model(load)(_t(spark, d, "raw_posts").select("id", "posts")).select("id", "sentiment")


def console_summary(spark, d):
    return summary(report_wide(spark, d))


def stream_daily(spark, d):
    """The daily counts of the event stream, run to its end."""
    path = new_path(spark, "daily")
    start_daily(event_stream(spark, d), path, new_path(spark, "daily-state")).awaitTermination()
    return latest_daily(spark, path)


def stream_reports(spark, d):
    """The counts of all micro-batches of labelled posts."""
    path = new_path(spark, "reports")
    schema = _t(spark, d, "labelled_posts").schema
    # A table is a file or a folder of files.
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    start_report(files.parquet(f"{d}/labelled_posts.parquet*"), path, new_path(spark, "reports-state")).awaitTermination()
    return spark.read.parquet(path).agg(*[F.sum(c).alias(c) for c in COUNTS])


def replay_scan(spark, d):
    from postmill.sources.replay import NAME, register

    register(spark)
    return spark.read.format(NAME).option("path", f"{d}/raw_posts.parquet").load().where(F.col("social") == "Quora")


def _replayed(spark, d, **options):
    from postmill.sources.replay import NAME, register

    register(spark)
    return spark.read.format(NAME).options(path=f"{d}/raw_posts.parquet", **options).load()


def replay_limited(spark, d):
    return _replayed(spark, d, no_post="30")


def replay_search(spark, d):
    return _replayed(spark, d, search="kettle").where(F.col("social").isin("Reddit", "Twitter", "Facebook"))


def replay_linkedin(spark, d):
    return _replayed(spark, d).where(F.col("social") == "LinkedIn")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "report_wide": report_wide, "report_long": report_long, "report_by_brand": report_by_brand, "report_by_run": report_by_run, "history_against_posts": history_against_posts, "posts_scan": posts_scan, "posts_head": posts_head, "union_platforms": union_platforms,
    "sentiment_value_counts": sentiment_value_counts, "platform_value_counts": platform_value_counts, "per_source_limit": source_limit, "keyword_search": keyword_search, "since_until": since_until_posts, "english_without_links": english_without_links, "newest_posts": newest_posts,
    "run_tables": run_tables, "brand_table_collisions": brand_table_collisions, "encoded_searches": encoded_searches, "report_bodies": report_bodies, "history_changes": history_changes, "history_alerts": history_alerts, "history_latest": history_latest, "history_bands": history_bands,
    "daily_scores": daily_scores, "label_join": label_join, "lexicon_labels": lexicon_labels, "page_heading": page_heading, "nth_paragraph": nth_paragraph, "stream_daily": stream_daily, "replay_scan": replay_scan,
    "second_paragraph": second_paragraph, "page_text": page_text, "searched_kinds": searched_kinds, "posts_of_year": posts_of_year, "requested_counts": requested_counts, "raw_round_trip": raw_round_trip, "labelled_round_trip": labelled_round_trip, "history_round_trip": history_round_trip,
    "ranked_labels": ranked_labels, "console_summary": console_summary, "stream_reports": stream_reports, "replay_limited": replay_limited, "replay_search": replay_search, "replay_linkedin": replay_linkedin,
}

_FOUR = "('Facebook', 'Twitter', 'Reddit', 'Quora')"
_COUNTS = ", ".join(
    f"count(*) filter (where sentiment = '{s.upper()}'" + (f" and social = '{p.capitalize()}'" if p != "total" else "") + f") as {p}_{s}" for p, s in (c.split("_") for c in COUNTS)
)
_SCORE = "case when total_positive + total_negative > 0 then total_positive::double / (total_positive + total_negative)::double * 10.0::double end as score"


def _by(column: str) -> str:
    inner = _COUNTS.replace("sentiment =", "l.sentiment =").replace("social =", "l.social =")
    return f"select *, {_SCORE} from (select r.{column}, {inner} from labelled_posts l join raw_posts r on l.number = r.id group by r.{column})"


def _hits(words) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(posts), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w in ({', '.join(repr(w) for w in words)})))"


_CHANGES = "select id, brand, score, last_value(score ignore nulls) over (partition by brand order by date, id rows between unbounded preceding and 1 preceding) as previous_score from report_history"

ORACLE: dict[str, str] = {
    "posts_scan": "select id, social, posts from raw_posts",
    "posts_head": "select id, social, posts from raw_posts order by id limit 5",
    "union_platforms": " union all ".join(f"select '{p}' as social, posts from raw_posts where social = '{p}' and posts is not null" for p in PLATFORMS),
    "sentiment_value_counts": "select sentiment, count(*) as n from labelled_posts where sentiment is not null group by sentiment",
    "platform_value_counts": f"select social, sentiment, count(*) as n from labelled_posts where sentiment is not null and social in {_FOUR} group by social, sentiment",
    "report_wide": f"select *, {_SCORE} from (select {_COUNTS} from labelled_posts)",
    "report_long": f"select case when g = 1 then 'Total' else s end as social, negative, positive, case when positive + negative > 0 then positive::double / (positive + negative)::double * 10.0::double end as score from (select social as s, grouping(social) as g, count(*) filter (where sentiment = 'NEGATIVE') as negative, count(*) filter (where sentiment = 'POSITIVE') as positive from labelled_posts group by grouping sets ((social), ())) where g = 1 or s in {_FOUR}",
    "report_by_brand": _by("brand"),
    "report_by_run": _by("run_id"),
    "history_against_posts": f"select h.id, h.run_id, h.total_negative, h.total_positive, n.total_negative as now_negative, n.total_positive as now_positive from report_history h left join ({_by('run_id')}) n on h.run_id = n.run_id where h.total_negative is distinct from coalesce(n.total_negative, 0) or h.total_positive is distinct from coalesce(n.total_positive, 0)",
    "per_source_limit": f"select id, social, posts from (select id, social, posts, row_number() over (partition by social order by id) as k from raw_posts where social in {_FOUR}) where k <= case social when 'Quora' then 4 when 'Twitter' then 24 else 49 end and posts is not null",
    "keyword_search": "select id, brand from raw_posts where instr(lower(posts), lower(brand)) > 0",
    "since_until": "select id, posted_at from raw_posts where posted_at >= timestamp '2023-07-01' and posted_at < timestamp '2023-11-30'",
    "english_without_links": "select id, social from raw_posts where lang = 'en' and not regexp_matches(posts, 'https?://')",
    "newest_posts": "select id, posted_at from raw_posts order by posted_at desc nulls last, id limit 100",
    "run_tables": "select run_id, replace(search, ' ', '') || '_table' as posts_table, replace(search, ' ', '') || '_sentimenttable' as history_table from run_params",
    "brand_table_collisions": "select lower(replace(brand, ' ', '') || '_table') as folded, count(*) as brands from brands group by 1 having count(*) > 1",
    "encoded_searches": r"select run_id, replace(url_encode(search), '%2F', '/') as encoded, array_to_string(list_filter(regexp_split_to_array(search, '\s+'), lambda w: w <> ''), '+') as joined from run_params",
    "report_bodies": "select brand, '1. Score: ' || coalesce(round(score, 2)::varchar, 'none') || ' out of 10.' || chr(10) || '2. Posts on ' || brand || ' with a label: ' || (total_negative + total_positive) || '.' || chr(10) || '3. In total: ' || total_positive || ' positive, ' || total_negative || ' negative.' || "
    + " || ".join(f"chr(10) || '{i}. {p.capitalize()}: ' || {p}_positive || ' positive, ' || {p}_negative || ' negative.'" for i, p in enumerate(("facebook", "twitter", "reddit", "quora"), 4))
    + f" as body from ({_by('brand')}) where brand is not null",
    "history_changes": f"select *, score - previous_score as change from ({_CHANGES})",
    "history_alerts": f"select id, brand, score - previous_score as change from ({_CHANGES}) where abs(score - previous_score) >= 2.0",
    "history_latest": "select brand, date, id, score from report_history qualify row_number() over (partition by brand order by date desc, id desc) = 1",
    "history_bands": "select id, case when score < 4.0 then 'NEGATIVE' when score > 6.0 then 'POSITIVE' when score is not null then 'NEUTRAL' end as band from report_history",
    "daily_scores": f"select date, total_negative, total_positive, {_SCORE} from (select r.posted_at::date as date, count(*) filter (where l.sentiment = 'NEGATIVE') as total_negative, count(*) filter (where l.sentiment = 'POSITIVE') as total_positive from labelled_posts l join raw_posts r on l.number = r.id where r.posted_at is not null group by 1)",
    "label_join": "select r.id, r.social, l.sentiment from raw_posts r left join (select number, arg_min(sentiment, id) filter (where true) as s, min(id) as i from labelled_posts where number is not null group by number) f on r.id = f.number left join labelled_posts l on l.id = f.i",
    "lexicon_labels": f"select id, case when posts is null then null when {_hits(GOOD)} > {_hits(BAD)} then 'POSITIVE' else 'NEGATIVE' end as sentiment from raw_posts",
    "page_heading": "select id, coalesce(brand, '') as heading, string_split(posts, chr(10))[1] as first from raw_posts where posts is not null",
    "nth_paragraph": "select id, k, w[k] as text from (select id, w, unnest(range(1, len(w) + 1)) as k from (select id, string_split(posts, chr(10)) as w from raw_posts where posts is not null))",
    "stream_daily": "select ts::date as date, count(*) filter (where event_type = 'error') as negative, count(*) filter (where event_type = 'purchase') as positive from events group by 1",
    "replay_scan": "select social, posts from raw_posts where social = 'Quora' and posts is not null",
    "second_paragraph": "select id, string_split(posts, chr(10))[2] as text from raw_posts where posts is not null",
    "page_text": "select id, coalesce(brand, '') || replace(posts, chr(10), '') as text from raw_posts where posts is not null",
    "searched_kinds": "select * from (select id, social, case when social = 'Quora' then 'answer' when regexp_matches(posts, 'https?://') then 'link' else 'post' end as kind from raw_posts where posts is not null) where coalesce(kind = case social when 'Reddit' then 'link' when 'Quora' then 'answer' when 'Facebook' then 'post' end, true)",
    "posts_of_year": "select id, posted_at, to_base64(encode(to_json({'rp_creation_time:0': to_json({'name': 'creation_time', 'args': to_json({'start_year': '2023', 'start_month': '2023-1', 'end_year': '2023', 'end_month': '2023-12', 'start_day': '2023-1-1', 'end_day': '2023-12-31'})::varchar})::varchar})::varchar)) as filter from raw_posts where year(posted_at) = 2023",
    "requested_counts": "select run_id, no_post as requested, case when regexp_full_match(trim(search), '[0-9]{1,9}') then trim(search)::int end as no_number from run_params",
    "raw_round_trip": f"select row_number() over (order by social, posts) as id, social, posts from raw_posts where social in {_FOUR} and posts is not null",
    "labelled_round_trip": f"select id, id as number, case when posts is null then null when {_hits(GOOD)} > {_hits(BAD)} then 'POSITIVE' else 'NEGATIVE' end as sentiment from raw_posts",
    "history_round_trip": f"select i as id, date '2023-12-31' + i::int as date, 'all' as brand, r.* from (select *, {_SCORE} from (select {_COUNTS} from labelled_posts)) r, range(1, 3) t(i)",
    "ranked_labels": f"select id, case when posts is null then null when {_hits(GOOD)} > {_hits(BAD)} then 'POSITIVE' else 'NEGATIVE' end as sentiment from raw_posts",
    "console_summary": f"with r as (select {_COUNTS} from labelled_posts) select 1 as line, 'Analysed: ' || (total_negative + total_positive) as text from r " + " ".join(f"union all select {i}, '{p.capitalize()}: ' || {p}_positive || ' positive, ' || {p}_negative || ' negative' from r" for i, p in enumerate(("total", "facebook", "twitter", "reddit", "quora"), 2)),
    "stream_reports": f"select {_COUNTS} from labelled_posts",
    "replay_limited": "select social, posts from (select social, posts, row_number() over (partition by social order by id) as k from raw_posts where social in ('Facebook', 'Twitter', 'Reddit', 'Quora', 'LinkedIn')) where k <= case social when 'Quora' then 4 when 'Twitter' then 24 else 29 end and posts is not null",
    "replay_search": "select social, posts from raw_posts where social in ('Reddit', 'Twitter', 'Facebook') and instr(lower(posts), 'kettle') > 0",
    "replay_linkedin": "select social, posts from raw_posts where social = 'LinkedIn' and posts is not null",
}
