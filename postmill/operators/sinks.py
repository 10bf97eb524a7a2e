"""Tables of posts, labelled posts and reports, and the delivery of a report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.text import report_body
from postmill.model import COUNTS


def numbered(df: DataFrame, *order: str, name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers in a fixed order, without bringing all rows into one task.

    Rows are range-partitioned by the order, counted by partition, and numbered within it.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from_each = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition.
    before = from_each.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + rank + (start - 1)).cast("bigint")).drop("_part", "_before")


def write_raw(df: DataFrame, path: str) -> None:
    """Replace the posts of a run."""
    df.write.mode("overwrite").parquet(path)


def write_labelled(df: DataFrame, path: str) -> None:
    """Replace the labelled posts of a run."""
    df.write.mode("overwrite").parquet(path)


def append_report(report: DataFrame, path: str, brand: str, on: date | None = None) -> None:
    """Add the report to the history. Its id follows the largest there, and its date is today's in UTC unless given."""
    spark = report.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except Exception as error:  # noqa: BLE001 - no history yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = 0
    row = report.select(F.lit(last + 1).cast("bigint").alias("id"), (F.lit(on) if on else F.current_date()).alias("date"), F.lit(brand).alias("brand"), *COUNTS, "score")
    row.write.mode("append").partitionBy("brand").parquet(path)


def rendered(report: DataFrame, search: str) -> DataFrame:
    """The report's text."""
    return report.select(report_body(F.lit(search)).alias("body"))


def deliver(report: DataFrame, search: str, receiver: str, send: Callable[[str, str, str], None] | None = None) -> str:
    """Render the report and hand it to ``send(receiver, subject, body)``; nothing is sent without one."""
    body = rendered(report, search).first()["body"]
    if send is not None:
        send(receiver, f"Sentiment report for {search}", body)
    return body


def smtp_sender(host: str, sender: str, password: str, port: int = 465) -> Callable[[str, str, str], None]:
    """A ``send`` that mails over TLS; credentials come from the caller."""

    def send(receiver: str, subject: str, body: str) -> None:
        import smtplib
        import ssl
        from email.message import EmailMessage

        message = EmailMessage()
        message["From"], message["To"], message["Subject"] = sender, receiver, subject
        message.set_content(body)
        with smtplib.SMTP_SSL(host, port, context=ssl.create_default_context()) as smtp:
            smtp.login(sender, password)
            smtp.send_message(message)

    return send


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a stored table."""
    return spark.read.parquet(path)
