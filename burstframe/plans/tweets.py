"""Queries on raw lines and tweets: scans, projections, filters and joins of the preprocessing stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstframe.functions import text as tx
from burstframe.operators import burst, slices
from burstframe.sources import readers
from burstframe.session import table


def first_rows(raw: DataFrame) -> DataFrame:
    """One row a tweet: the first to arrive; rows without a time of arrival come last, equal ones by text and count."""
    order = W.partitionBy("id_str").orderBy(F.asc_nulls_last("received_at"), "text", "retweet_count")
    return raw.where("id_str IS NOT NULL").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def placed_tweets(spark: SparkSession, d: str) -> DataFrame:
    """(day, line_idx, tweet_id, text) of the first rows that the id map places."""
    tweets = first_rows(table(spark, d, "raw_tweet")).select(F.col("id_str").alias("tweet_id"), "text")
    return table(spark, d, "id_map").join(tweets, "tweet_id").select("day", "line_idx", "tweet_id", "text")


def tweet_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.json_lines(table(spark, d, "raw_line")).select("day", "line_no", "id_str", "text", "created_at", "lang", F.col("user.id_str").alias("user_id_str"))


def tweet_fields(spark: SparkSession, d: str) -> DataFrame:
    return readers.tweet_projection(first_rows(table(spark, d, "raw_tweet")))


def user_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.user_projection(table(spark, d, "raw_tweet")).distinct()


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).select("id_str", "text", "retweet_count", "received_at")


def day_split(spark: SparkSession, d: str) -> DataFrame:
    time = tx.tweet_time(F.col("created_at"))
    dated = first_rows(table(spark, d, "raw_tweet")).select(F.date_format(time, "yyyy-MM-dd").alias("date"), F.hour(time).alias("hour"))
    return dated.where("date IS NOT NULL").groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


def hour_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "social").where("hour IS NOT NULL").select("hour", slices.shift_hour(F.col("hour")).alias("shifted"))
    return rows.groupBy("hour", "shifted").agg(F.count(F.lit(1)).alias("n"))


def social_features(spark: SparkSession, d: str) -> DataFrame:
    """Tweets with a user and a time: who, when, and what the text and entities tell."""
    tweets = readers.tweet_projection(first_rows(table(spark, d, "raw_tweet"))).where("user_id_str IS NOT NULL AND text IS NOT NULL")
    hour = F.hour(tx.tweet_time(F.col("created_at")))
    tags = F.transform(F.filter("hashtags", lambda t: t.isNotNull()), lambda t: F.concat(F.lit("#"), t))
    return tweets.select(
        F.col("id_str").alias("tweet_id"), F.col("user_id_str").alias("user_id"), hour.alias("hour"),
        F.lower(F.substring("text", 1, 4)).startswith("rt @").alias("is_rt"), (F.coalesce(F.size("user_mentions"), F.lit(0)) > 0).alias("has_mention"),
        F.col("in_reply_to_status_id_str").isNotNull().alias("is_reply"), (F.coalesce(F.size("urls"), F.lit(0)) > 0).alias("has_url"),
        F.coalesce(F.array_join(tags, " "), F.lit("")).alias("tags"), tx.ending_in(F.col("text")).alias("past"),
    ).where("hour IS NOT NULL")


def known_user_tweets(spark: SparkSession, d: str) -> DataFrame:
    return burst.known_sizes(table(spark, d, "id_map"), table(spark, d, "social"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return placed_tweets(spark, d).select("day", "line_idx", "tweet_id", F.length("text").alias("n_chars"))


def user_tweets_only(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_tweet").where("id_str IS NOT NULL AND user IS NOT NULL AND user.id_str IS NOT NULL")
    return rows.select("id_str", F.col("user.id_str").alias("user_id_str")).distinct()


def original_tweets(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).where("retweet_count = 0 AND length(text) > 0").select("id_str", "text")


def asked_tweets(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "probe_tweet").select("tweet_id")
    return table(spark, d, "social").join(asked, "tweet_id", "left_semi").distinct()


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def target_language(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).where(F.col("lang").isin("en", "es")).select("id_str", "lang")


def day_counts(spark: SparkSession, d: str) -> DataFrame:
    return burst.day_sizes(table(spark, d, "id_map"))


QUERIES = {
    f.__name__: f
    for f in (
        tweet_scan, tweet_fields, user_scan, dedup_first, day_split, hour_shift, social_features, known_user_tweets, placed, user_tweets_only,
        original_tweets, asked_tweets, language_counts, target_language, day_counts,
    )
}

FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_str ORDER BY received_at NULLS LAST, text NULLS FIRST, retweet_count NULLS FIRST) AS rank
    FROM raw_tweet WHERE id_str IS NOT NULL) WHERE rank = 1"""
PLACED = f"SELECT m.day, m.line_idx, m.tweet_id, f.text FROM id_map m JOIN ({FIRST}) f ON f.id_str = m.tweet_id"
_TIME = r"CASE WHEN regexp_full_match(created_at, '[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \+0000 \d{4}') THEN try_strptime(substr(created_at, 5, 16) || substr(created_at, 27, 4), '%b %d %H:%M:%S %Y') END"
KNOWN = "SELECT tweet_id, min(user_id) AS user_id FROM social WHERE tweet_id IS NOT NULL AND user_id IS NOT NULL GROUP BY tweet_id"

ORACLE = {
    "tweet_scan": """SELECT day, line_no, j->>'$.id_str' AS id_str, j->>'$.text' AS text, j->>'$.created_at' AS created_at, j->>'$.lang' AS lang, j->>'$.user.id_str' AS user_id_str
        FROM (SELECT day, line_no, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM raw_line WHERE line_no > 0 AND length(line) >= 20)
        WHERE json_type(j) = 'OBJECT' AND j->>'$.id_str' IS NOT NULL""",
    "tweet_fields": f"""SELECT id_str, "user".id_str AS user_id_str, text, created_at, list_transform(entities.user_mentions, lambda x: x.screen_name) AS user_mentions,
        list_transform(entities.hashtags, lambda x: x.text) AS hashtags, list_transform(entities.urls, lambda x: x.url) AS urls, retweet_count, retweeted, favorited,
        in_reply_to_status_id_str, lang, list_transform(entities.symbols, lambda x: x.text) AS symbols FROM ({FIRST})""",
    "user_scan": """SELECT DISTINCT u.id_str, u.screen_name, u.name, u.description, u.created_at, u.location, u.lang, u.statuses_count, u.favourites_count,
        u.listed_count, u.friends_count, u.followers_count FROM (SELECT "user" AS u FROM raw_tweet) WHERE u.id_str IS NOT NULL""",
    "dedup_first": f"SELECT id_str, text, retweet_count, received_at FROM ({FIRST})",
    "day_split": f"""SELECT strftime(t, '%Y-%m-%d') AS date, hour(t)::INT AS hour, count(*) AS n FROM (SELECT {_TIME} AS t FROM ({FIRST})) WHERE t IS NOT NULL GROUP BY 1, 2""",
    "hour_shift": "SELECT hour, (hour + 8) % 24 AS shifted, count(*) AS n FROM social WHERE hour IS NOT NULL GROUP BY 1, 2",
    "social_features": f"""SELECT * FROM (SELECT id_str AS tweet_id, "user".id_str AS user_id, hour({_TIME})::INT AS hour, starts_with(lower(substr(text, 1, 4)), 'rt @') AS is_rt,
        coalesce(len(entities.user_mentions), 0) > 0 AS has_mention, in_reply_to_status_id_str IS NOT NULL AS is_reply, coalesce(len(entities.urls), 0) > 0 AS has_url,
        coalesce(array_to_string(list_transform(list_filter(entities.hashtags, lambda x: x.text IS NOT NULL), lambda x: '#' || x.text), ' '), '') AS tags,
        coalesce(array_to_string(list_filter(string_split(text, ' '), lambda w: ends_with(w, 'ed')), ' '), '') AS past
        FROM ({FIRST}) WHERE "user".id_str IS NOT NULL AND text IS NOT NULL) WHERE hour IS NOT NULL""",
    "known_user_tweets": f"""SELECT day, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users
        FROM (SELECT DISTINCT day, tweet_id FROM id_map WHERE day IS NOT NULL) JOIN ({KNOWN}) USING (tweet_id) GROUP BY day""",
    "placed": f"SELECT day, line_idx, tweet_id, length(text)::INT AS n_chars FROM ({PLACED})",
    "user_tweets_only": """SELECT DISTINCT id_str, "user".id_str AS user_id_str FROM raw_tweet WHERE id_str IS NOT NULL AND "user".id_str IS NOT NULL""",
    "original_tweets": f"SELECT id_str, text FROM ({FIRST}) WHERE retweet_count = 0 AND length(text) > 0",
    "asked_tweets": "SELECT DISTINCT tweet_id, user_id, hour FROM social WHERE tweet_id IN (SELECT tweet_id FROM probe_tweet)",
    "language_counts": f"SELECT lang, count(*) AS n FROM ({FIRST}) GROUP BY lang",
    "target_language": f"SELECT id_str, lang FROM ({FIRST}) WHERE lang IN ('en', 'es')",
    "day_counts": "SELECT day, count(DISTINCT tweet_id) AS n_tweets FROM id_map WHERE day IS NOT NULL GROUP BY day",
}
