"""Document frequencies per time window and bursty units.

units is (day, tweet_id, unit), social (tweet_id, user_id, hour). Rows may repeat: everything counts distinct tweets or
users. Nulls in day, tweet_id or unit are no occurrence; tweets without a user do not take part in bursts. Empty inputs
give empty results. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occurrences(units: DataFrame) -> DataFrame:
    """Distinct occurrences; the one shuffle by (unit, day, tweet) that the counts below build on."""
    return units.select("day", "tweet_id", "unit").where("day IS NOT NULL AND tweet_id IS NOT NULL AND unit IS NOT NULL").distinct()


def keep_units(units: DataFrame, stop_words: DataFrame | None = None, least: int = 1, known: DataFrame | None = None) -> DataFrame:
    """Units of a least length that are no stop word and hold no link; of `known` units only, if given.

    stop_words is a list of fixed size. known may be large, so the join is left to the planner.
    """
    kept = units.where((F.length("unit") >= least) & ~F.contains("unit", F.lit("http")))
    if stop_words is not None:
        kept = kept.join(F.broadcast(stop_words.select(F.lower("word").alias("unit")).distinct()), "unit", "left_anti")
    return kept if known is None else kept.join(known.select("unit"), "unit", "left_semi")


def day_sizes(tweets: DataFrame) -> DataFrame:
    """(day, n_tweets): distinct tweets of each day."""
    return tweets.where("day IS NOT NULL").groupBy("day").agg(F.countDistinct("tweet_id").alias("n_tweets"))


def unit_day_df(units: DataFrame) -> DataFrame:
    """(unit, day, df)."""
    return occurrences(units).groupBy("unit", "day").agg(F.count(F.lit(1)).alias("df"))


def unit_df(units: DataFrame) -> DataFrame:
    """(unit, df) over all days."""
    return occurrences(units).groupBy("unit").agg(F.countDistinct("tweet_id").alias("df"))


def unit_ps(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, ps): the mean share of a day's tweets that hold the unit, over the days that have it.

    sizes has a row for each day and is broadcast: days do not grow with tweets.
    """
    shares = unit_day_df(units).join(F.broadcast(sizes), "day")
    return shares.groupBy("unit").agg(F.avg(F.col("df") / F.col("n_tweets")).alias("ps"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def burst_score(f: Column, n: Column, ps: Column, users: Column) -> Column:
    """Null unless the unit is more frequent than expected."""
    expected = n * ps
    sd = F.sqrt(expected * (1 - ps))
    burst = F.when(f >= expected + 2 * sd, 1.0).otherwise(sigmoid(10 * (f - expected - sd) / sd))
    return F.when(f > expected, burst * F.log10(users.cast("double")))


def known_tweets(tweets: DataFrame, social: DataFrame) -> DataFrame:
    """Tweets with the user that social names; of several the smallest."""
    users = social.where("tweet_id IS NOT NULL AND user_id IS NOT NULL").groupBy("tweet_id").agg(F.min("user_id").alias("user_id"))
    return tweets.join(users, "tweet_id")


def known_sizes(tweets: DataFrame, social: DataFrame) -> DataFrame:
    """(day, n_tweets, n_users) among tweets of known users."""
    known = known_tweets(tweets.select("day", "tweet_id").where("day IS NOT NULL").distinct(), social)
    return known.groupBy("day").agg(F.count(F.lit(1)).alias("n_tweets"), F.countDistinct("user_id").alias("n_users"))


def unit_bursts(units: DataFrame, sizes: DataFrame, social: DataFrame, ps: DataFrame) -> DataFrame:
    """(day, unit, f_st, u_st, wb) of the units that are more frequent than expected on a day."""
    counts = known_tweets(occurrences(units), social).groupBy("unit", "day")
    counts = counts.agg(F.count(F.lit(1)).alias("f_st"), F.countDistinct("user_id").alias("u_st"))
    scored = counts.join(ps, "unit").join(F.broadcast(sizes.select("day", "n_tweets")), "day")
    scored = scored.withColumn("wb", burst_score(F.col("f_st"), F.col("n_tweets"), F.col("ps"), F.col("u_st")))
    return scored.where("wb IS NOT NULL").select("day", "unit", "f_st", "u_st", "wb", "n_tweets")


def top_bursts(bursts: DataFrame, parts: int = 32) -> DataFrame:
    """(day, seg_id, unit, f_st, wb): the floor(sqrt(n)) + 1 highest scores of each day, equal ones by unit; n is the
    day's number of tweets of known users. A day's units are ranked in `parts` parts first, so that no task sorts them
    all; the best of each part are at most `parts` times the result."""
    best = [F.desc("wb"), F.asc("unit")]
    parted = bursts.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    kept = parted.withColumn("rank", F.row_number().over(W.partitionBy("day", "part").orderBy(*best))).where(F.col("rank") - 1 <= F.floor(F.sqrt("n_tweets")))
    ranked = kept.withColumn("seg_id", F.row_number().over(W.partitionBy("day").orderBy(*best)) - 1)
    return ranked.where(F.col("seg_id") <= F.floor(F.sqrt("n_tweets"))).select("day", "seg_id", "unit", "f_st", "wb")


def involved_tweets(units: DataFrame, top: DataFrame) -> DataFrame:
    """(day, tweet_id), distinct, of the tweets that hold a top unit of their day."""
    return occurrences(units).join(top.select("day", "unit"), ["day", "unit"], "left_semi").select("day", "tweet_id").distinct()
