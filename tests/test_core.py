from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions.html import by_attribute, nth, parsed_text, text_content
from postmill.functions.text import percent_encoded, plus_joined, post_count, table_name
from postmill.operators.history import alerts, score_changes
from postmill.operators.predicates import mentions, per_source_limit, since_until, year_filter_blob
from postmill.operators.report import long_report, report, value_counts
from postmill.operators.scoring import banded, by_lexicon, by_model, from_labels
from postmill.operators.sinks import deliver, numbered
from postmill.plans.pipeline import run

LABELLED = "social string, sentiment string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_report_counts_and_score(spark):
    row = report(spark.createDataFrame([("Reddit", "POSITIVE"), ("Reddit", "NEGATIVE"), ("Twitter", "POSITIVE"), ("Facebook", "POSITIVE")], LABELLED)).first()
    assert tuple(row) == (1, 3, 0, 1, 0, 1, 1, 1, 0, 0, 7.5)


@pytest.mark.parametrize(("rows", "totals", "score"), [([], (0, 0), None), ([("Reddit", "POSITIVE")], (0, 1), 10.0), ([("Quora", "NEGATIVE")], (1, 0), 0.0), ([("LinkedIn", "POSITIVE"), ("Reddit", None), (None, "NEGATIVE")], (1, 1), 5.0)])
def test_report_edges(spark, rows, totals, score):
    row = report(spark.createDataFrame(rows, LABELLED)).first()
    assert (row["total_negative"], row["total_positive"]) == totals
    assert row["score"] == score


def test_value_counts_drop_null(spark):
    rows = spark.createDataFrame([("a", None), ("a", "POSITIVE"), ("b", "POSITIVE")], LABELLED)
    assert [tuple(r) for r in value_counts(rows, "sentiment").collect()] == [("POSITIVE", 2)]


def test_long_report_agrees_with_wide(spark):
    rows = spark.createDataFrame([("Reddit", "POSITIVE"), ("Reddit", "NEGATIVE"), ("LinkedIn", "POSITIVE")], LABELLED)
    found = {r["social"]: (r["negative"], r["positive"]) for r in long_report(rows).collect()}
    assert found == {"Reddit": (1, 1), "Total": (1, 2)}


@pytest.mark.parametrize(("n", "kept"), [(1, (0, 0, 4)), (2, (1, 1, 4)), (25, (24, 24, 4)), (26, (25, 24, 4)), (50, (49, 24, 4))])
def test_limits(spark, n, kept):
    rows = spark.range(180).select("id", F.element_at(F.array(F.lit("Reddit"), F.lit("Twitter"), F.lit("Quora")), (F.col("id") % 3 + 1).cast("int")).alias("social"), F.lit("x").alias("posts"))
    found = {r["social"]: r["count"] for r in per_source_limit(rows, n).groupBy("social").count().collect()}
    assert tuple(found.get(s, 0) for s in ("Reddit", "Twitter", "Quora")) == kept


def test_missing_item_uses_an_attempt(spark):
    rows = spark.createDataFrame([(1, "Reddit", "a"), (2, "Reddit", None), (3, "Reddit", "c"), (4, "Reddit", "d")], "id long, social string, posts string")
    assert [r["id"] for r in per_source_limit(rows, 4).orderBy("id").collect()] == [1, 3]


def test_text_functions(spark):
    assert one(spark, percent_encoded(F.lit("physics wallah/a&b+c~*"))) == "physics%20wallah/a%26b%2Bc~%2A"
    assert one(spark, plus_joined(F.lit(" physics  wallah&x "))) == "physics+wallah&x"
    assert [one(spark, table_name(F.lit(x))) for x in ("physics wallah", "a\tb", "3m")] == ["physicswallah_table", "a\tb_table", "3m_table"]
    assert [one(spark, post_count(F.lit(x))) for x in (" 25 ", "x")] == [25, None]


def test_html(spark):
    page = '<h1>A &amp; B</h1><p>one</p><p class="t">two <b>bold</p><script>var x="</p>";</script>'
    assert one(spark, text_content(nth(F.lit(page), "p", 2))) == "two bold"
    assert one(spark, nth(F.lit(page), "p", 9)) is None
    assert one(spark, text_content(nth(F.lit(page), "h1", 1))) == "A & B"
    assert one(spark, by_attribute(F.lit(page), "p", "class", "t")) == "two <b>bold"
    assert one(spark, by_attribute(F.lit(page), "p", "class", "u")) is None
    assert one(spark, parsed_text(F.lit(page))) == "A & Bonetwo bold"


def test_predicates(spark):
    times = spark.createDataFrame([(datetime(2023, 7, 1),), (datetime(2023, 11, 30),)], "at timestamp")
    assert [r["x"] for r in times.select(since_until(F.col("at"), date(2023, 7, 1), date(2023, 11, 30)).alias("x")).collect()] == [True, False]
    assert one(spark, mentions(F.lit("I like TCS"), F.lit("tcs"))) is True
    assert one(spark, mentions(F.lit(None).cast("string"), F.lit("tcs"))) is False
    assert "creation_time" in one(spark, F.unbase64(year_filter_blob(2023)).cast("string"))


def test_scorers(spark):
    posts = spark.createDataFrame([(1, "good good bad"), (2, None), (3, ""), (4, "bad " * 5000)], "id long, posts string")
    labels = {r["id"]: r["sentiment"] for r in by_lexicon(["good"], ["bad"])(posts).collect()}
    assert labels == {1: "POSITIVE", 2: None, 3: "NEGATIVE", 4: "NEGATIVE"}
    model = by_model(lambda: lambda texts: ["POSITIVE" if "good" in t else "NEGATIVE" for t in texts])
    assert {r["id"]: r["sentiment"] for r in model(posts).collect()} == labels
    table = spark.createDataFrame([(7, 1, "NEGATIVE"), (5, 1, "POSITIVE")], "id long, number long, sentiment string")
    assert {r["id"]: r["sentiment"] for r in from_labels(table)(posts.select("id")).collect()} == {1: "POSITIVE", 2: None, 3: None, 4: None}
    assert [one(spark, banded(F.lit(x))) for x in (1.0, 5.0, 9.0)] == ["NEGATIVE", "NEUTRAL", "POSITIVE"]


def test_history(spark):
    rows = spark.createDataFrame([(2, date(2023, 1, 2), 8.0), (1, date(2023, 1, 1), 5.0), (3, date(2023, 1, 3), None), (4, date(2023, 1, 4), 7.5)], "id long, date date, score double")
    assert {r["id"]: r["change"] for r in score_changes(rows).collect()} == {1: None, 2: 3.0, 3: None, 4: -0.5}
    assert [r["id"] for r in alerts(rows).collect()] == [2]


def test_numbers_are_consecutive(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    found = numbered(rows, "v").orderBy("v").collect()
    assert [r["id"] for r in found] == list(range(1, 1001))


def test_run_twice(spark, tmp_path):
    posts = spark.createDataFrame([("Reddit", "good"), ("Twitter", "bad"), ("Reddit", "good")], "social string, posts string")
    sent = []
    for day in (1, 2):
        run(posts, "physics wallah", str(tmp_path), by_lexicon(["good"], ["bad"]), "a@b.example", lambda *x: sent.append(x), date(2023, 1, day))
    history = spark.read.parquet(f"{tmp_path}/history").orderBy("id").collect()
    assert [(r["id"], r["total_positive"], r["total_negative"]) for r in history] == [(1, 2, 1), (2, 2, 1)]
    assert spark.read.parquet(f"{tmp_path}/physicswallah_table").count() == 3
    assert len(sent) == 2 and "2 positive, 1 negative" in sent[0][2]
    assert deliver(report(spark.createDataFrame([], LABELLED)), "x", "a@b.example").startswith("1. Score: none")


def test_replay_source(spark, tmp_path):
    from postmill.sources.replay import NAME, register

    rows = [("Quora", f"tcs {i}") for i in range(9)] + [("Reddit", "tcs"), ("Reddit", None), ("Reddit", "other")]
    spark.createDataFrame(rows, "social string, posts string").coalesce(1).write.parquet(str(tmp_path / "p"))
    register(spark)
    source = spark.read.format(NAME).option("path", str(tmp_path / "p"))
    assert source.option("no_post", "3").load().groupBy("social").count().orderBy("social").collect() == [("Quora", 4), ("Reddit", 1)]
    quora = spark.read.format(NAME).option("path", str(tmp_path / "p")).option("search", "TCS").load().where("social = 'Quora'")
    assert quora.count() == 9


def test_queries_and_sql_have_the_same_names():
    from postmill.plans import catalogue

    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_top_label(spark):
    from postmill.operators.scoring import top_label

    rows = spark.createDataFrame([([("A", 0.1), ("B", 0.9)],), ([("A", 0.5), ("B", 0.5)],), ([],), (None,)], "r array<struct<label:string,score:double>>")
    assert [r[0] for r in rows.select(top_label(F.col("r"))).collect()] == ["B", "A", None, None]


def test_searched_kinds(spark):
    from postmill.operators.predicates import content_kind, of_searched_kind

    rows = spark.createDataFrame([("Reddit", "see https://a.example"), ("Reddit", "no link"), ("Quora", "x"), ("Facebook", "https://b.example"), ("Twitter", "x"), (None, None)], "s string, t string")
    rows = rows.withColumn("k", content_kind(F.col("s"), F.col("t")))
    assert [r[0] for r in rows.select(of_searched_kind(F.col("s"), F.col("k"))).collect()] == [True, False, True, False, True, True]


def test_replay_reads_row_groups_of_a_folder(spark, tmp_path):
    from postmill.sources.replay import NAME, register

    spark.createDataFrame([("Reddit", f"r{i}") for i in range(40)] + [("LinkedIn", None), ("LinkedIn", "l")], "social string, posts string").repartition(3).write.parquet(str(tmp_path / "p"))
    register(spark)
    read = spark.read.format(NAME).option("path", str(tmp_path / "p"))
    assert read.load().count() == 41 and read.load().where("social = 'LinkedIn'").count() == 1 and read.load().rdd.getNumPartitions() == 3
    assert read.option("no_post", "5").load().count() <= 5


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from postmill.session import shared_dir

    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(made)
