"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.plans.bursts import SLICED, Course
from burstframe.plans.framing import BRACKETED, chunked_sql
from burstframe.session import cut, table
from burstframe.streaming import tweets as st


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The files of a table, whether it is one file or a folder of them."""
    rows = spark.readStream.schema(table(spark, d, name).schema)
    one = len(table(spark, d, name).inputFiles()) == 1 and table(spark, d, name).inputFiles()[0].endswith(f"/{name}.parquet")
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(d) if one else rows.parquet(f"{d}/{name}.parquet")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "raw_tweet").select("id_str", F.col("received_at").cast("timestamp").alias("received_at"))
    return st.run_available(st.deduplicated(rows).select("id_str")).distinct()


def stream_day_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each day, those of days that are still open included."""
    rows = _stream(spark, d, "raw_tweet").select(F.col("received_at").cast("timestamp").alias("received_at"))
    return st.run_available_in_full(st.daily_totals(rows))


def stream_language(spark: SparkSession, d: str) -> DataFrame:
    return st.run_available(st.in_languages(_stream(spark, d, "raw_tweet"), ["en"]).select("id_str", "text"))


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every row with a text, as np_chunks has them."""
    rows = _stream(spark, d, "raw_tweet").where("text IS NOT NULL").select("id_str", "text")
    return st.run_available(st.chunked_lines(rows, F.col("text")).select("id_str", "sentence", "line"))


def stream_slices(spark: SparkSession, d: str) -> DataFrame:
    """The hour slices of anchored_slices by the stateful stream: the tweets of a day come in order, in a file of that day."""
    hours = Course(spark, d).hours.select("day", "line_idx", "tweet_id", "hour")
    ordered = cut(hours.repartition("day").sortWithinPartitions("day", "line_idx"))
    rows = spark.readStream.schema(ordered.schema).parquet(*{f.rsplit("/", 1)[0] for f in ordered.inputFiles()})
    return st.run_available(st.anchored_slices(rows)).distinct()


QUERIES = {f.__name__: f for f in (stream_slices, stream_dedup, stream_day_window, stream_language, stream_chunks)}
ORACLE = {
    "stream_slices": f"WITH RECURSIVE {SLICED} SELECT DISTINCT day, tweet_id, hour, slice FROM sliced",
    "stream_chunks": f"""WITH {chunked_sql("SELECT id_str, text FROM raw_tweet", "id_str")} SELECT id_str, sentence, {BRACKETED} AS line FROM chunked
        UNION ALL SELECT id_str, NULL, '' FROM raw_tweet WHERE text IS NOT NULL AND trim(replace(text, chr(10), ' ')) = ''""",
    "stream_day_window": "SELECT received_at::DATE AS day, count(*) AS n FROM raw_tweet WHERE received_at IS NOT NULL GROUP BY 1",
    "stream_dedup": "SELECT DISTINCT id_str FROM raw_tweet WHERE id_str IS NOT NULL AND received_at IS NOT NULL",
    "stream_language": "SELECT id_str, text FROM raw_tweet WHERE lang = 'en' AND retweet_count = 0 AND length(text) > 0",
}
