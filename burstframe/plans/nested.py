"""Queries on the raw nested lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstframe.operators import nested
from burstframe.session import table


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return nested.tweet_arrays(table(spark, d, "raw_line"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements_table(_arrays(spark, d)).select("day", "line_no", "tweet_id", "kind", "pos")


def p5_elements(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements_table(_arrays(spark, d))


def p5_tweets(spark: SparkSession, d: str) -> DataFrame:
    return nested.tweets_table(_arrays(spark, d))


def p5_users(spark: SparkSession, d: str) -> DataFrame:
    return nested.users_table(_arrays(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_elements, p5_tweets, p5_users)}

_TWEETS = """lines AS (
    SELECT day, line_no, line::JSON AS j FROM (SELECT day, line_no, CASE WHEN json_valid(line) THEN line END AS line FROM raw_line WHERE line IS NOT NULL)
    WHERE line IS NOT NULL AND json_type(line::JSON) = 'OBJECT'),
tweets AS (
    SELECT day, line_no, j FROM lines WHERE j->>'$.id_str' IS NOT NULL
    UNION ALL
    SELECT day, line_no, unnest([j->'$.retweeted_status', j->'$.quoted_status']) FROM tweets
    WHERE json_type(j) = 'OBJECT'),
owners AS (
    SELECT day, line_no, j->>'$.id_str' AS tweet_id,
           CASE WHEN json_type(j->'$.entities') = 'VARCHAR' THEN (CASE WHEN json_valid(j->>'$.entities') THEN (j->>'$.entities')::JSON END) ELSE j->'$.entities' END AS e
    FROM tweets WHERE json_type(j) = 'OBJECT' AND j->>'$.id_str' IS NOT NULL),
lists AS (
    SELECT day, line_no, tweet_id, kind, field, CASE json_type(l) WHEN 'ARRAY' THEN l::JSON[] WHEN 'OBJECT' THEN [l] END AS items
    FROM (SELECT day, line_no, tweet_id, unnest([
        {'kind': 'user_mentions', 'field': 'screen_name', 'l': e->'$.user_mentions'}, {'kind': 'hashtags', 'field': 'text', 'l': e->'$.hashtags'},
        {'kind': 'urls', 'field': 'url', 'l': e->'$.urls'}, {'kind': 'symbols', 'field': 'text', 'l': e->'$.symbols'}], recursive := true) FROM owners)),
elements AS (
    SELECT DISTINCT day, line_no, tweet_id, kind, (pos - 1)::INT AS pos, items[pos]->>('$.' || field) AS value
    FROM (SELECT *, unnest(range(1, len(items) + 1)) AS pos FROM lists)
    WHERE json_type(items[pos]) = 'OBJECT' AND trim(items[pos]->>('$.' || field), ' \\t\\n\\r') <> '')"""

_PLACES = _TWEETS[: _TWEETS.index("tweets AS (")] + """places AS (
    SELECT day, line_no, j, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS relation, 0 AS depth FROM lines WHERE j->>'$.id_str' IS NOT NULL
    UNION ALL
    SELECT day, line_no, n.j, parent_id, n.relation, depth + 1 FROM (
        SELECT day, line_no, j->>'$.id_str' AS parent_id, depth,
               unnest([{'relation': 'retweeted_status', 'j': j->'$.retweeted_status'}, {'relation': 'quoted_status', 'j': j->'$.quoted_status'}]) AS n
        FROM places WHERE json_type(j) = 'OBJECT'))"""
_FIELDS = ", ".join(f"j->>'$.{f}' AS {f}" for f in nested.TWEET_FIELDS[1:])
_USER_FIELDS = ", ".join(f"j->'$.user'->>'$.{f}' AS {f}" for f in nested.USER_FIELDS[1:])

ORACLE = {
    "p5_found": f"WITH RECURSIVE {_TWEETS} SELECT day, line_no, tweet_id, kind, pos FROM elements",
    "p5_elements": f"WITH RECURSIVE {_TWEETS} SELECT day, line_no, tweet_id, kind, pos, value FROM elements",
    "p5_tweets": f"WITH RECURSIVE {_PLACES} SELECT DISTINCT day, line_no, j->>'$.id_str' AS tweet_id, parent_id, relation, depth, j->'$.user'->>'$.id_str' AS user_id, {_FIELDS} FROM places WHERE json_type(j) = 'OBJECT' AND j->>'$.id_str' IS NOT NULL",
    "p5_users": f"WITH RECURSIVE {_PLACES} SELECT DISTINCT day, line_no, j->>'$.id_str' AS tweet_id, j->'$.user'->>'$.id_str' AS user_id, {_USER_FIELDS} FROM places WHERE json_type(j) = 'OBJECT' AND (j->>'$.id_str') IS NOT NULL AND (j->'$.user'->>'$.id_str') IS NOT NULL",
}
