"""Queries of the counting and ranking helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.operators import stats
from burstframe.session import table

BUCKETS = (0, 1, 2, 3, 5)


def count_ratio(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentages(table(spark, d, "social").groupBy("hour").agg(F.count(F.lit(1)).alias("n")))


def value_hist(spark: SparkSession, d: str) -> DataFrame:
    return stats.bucket_counts(table(spark, d, "raw_tweet"), "retweet_count", BUCKETS)


def user_hour_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "social").where("user_id IS NOT NULL AND hour IS NOT NULL").withColumn("n", F.lit(1))
    return stats.cumulative(rows, ["user_id", "hour"], "n")


def top_users(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "social").where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_rows(counts, "n", "user_id", 20)


def top_users_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_in_groups(user_hour_counts(spark, d), ["hour"], "n", "user_id", 5)


def ordered_users(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "social").where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, d, "user_profile").groupBy(F.col("id_str").alias("user_id")).agg(F.max("followers_count").alias("followers"))
    return stats.ordered_with(counts, names, "user_id", "n")


def numbered_users(spark: SparkSession, d: str) -> DataFrame:
    """Users numbered by the place of their first tweet."""
    places = table(spark, d, "id_map").select("tweet_id", (F.col("day").cast("bigint") * 100_000_000 + F.col("line_idx")).alias("place"))
    rows = table(spark, d, "social").where("user_id IS NOT NULL").join(places, "tweet_id")
    return stats.chunked(stats.numbered(rows, "user_id", "place"), "number", 50)


QUERIES = {f.__name__: f for f in (count_ratio, value_hist, user_hour_counts, top_users, top_users_by_hour, ordered_users, numbered_users)}

_USER_HOURS = "SELECT user_id, hour, count(*) AS n FROM social WHERE user_id IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2"
_USERS = "SELECT user_id, count(*) AS n FROM social WHERE user_id IS NOT NULL GROUP BY 1"
ORACLE = {
    "count_ratio": "SELECT hour, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM social GROUP BY hour",
    "value_hist": " UNION ALL ".join(f"SELECT {float(b)}::DOUBLE AS bucket, count(*) AS n FROM raw_tweet WHERE retweet_count {'>=' if b == BUCKETS[-1] else '='} {b}" for b in BUCKETS),
    "user_hour_counts": _USER_HOURS,
    "top_users": f"{_USERS} ORDER BY n DESC, user_id LIMIT 20",
    "top_users_by_hour": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, user_id)::INT AS rank FROM ({_USER_HOURS})) WHERE rank <= 5",
    "ordered_users": f"SELECT user_id, n, followers FROM ({_USERS}) JOIN (SELECT id_str AS user_id, max(followers_count) AS followers FROM user_profile GROUP BY 1) USING (user_id)",
    "numbered_users": """SELECT user_id, number, number // 50 AS chunk FROM (SELECT user_id, row_number() OVER (ORDER BY place, user_id) - 1 AS number FROM (
        SELECT user_id, min(day::BIGINT * 100000000 + line_idx) AS place FROM social JOIN id_map USING (tweet_id) WHERE user_id IS NOT NULL GROUP BY user_id))""",
}
