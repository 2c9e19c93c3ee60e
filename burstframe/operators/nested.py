"""Nested tweet lines as flat tables of tweets, users and list elements, joined by (day, line_no, tweet_id).

A line counts if it is one whole JSON object with a top-level id_str; headers, broken lines, nulls and other JSON are
left out. Its tweets are gathered in one array by a fold of nested transforms that hand the keys of their ancestors
down, level by level, and every target table is one inline over that array: no join and no shuffle. Sub-documents are kept as JSON text between
the levels, so that an object, a string that holds one, and a number for an id are all read alike.

Null, empty and missing lists give no elements, an element without a list is at position 0, and positions count every
element, also those left out for having no value. Equal rows of one line, as when it holds a tweet twice, count once.
Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the format.
TWEET_FIELDS = ("id_str", "text", "created_at", "retweet_count", "retweeted", "favorited", "in_reply_to_status_id_str", "lang")
USER_FIELDS = (
    "id_str", "screen_name", "name", "description", "created_at", "location", "lang",
    "statuses_count", "favourites_count", "listed_count", "friends_count", "followers_count",
)
NESTED = ("retweeted_status", "quoted_status")
KINDS = {"user_mentions": "screen_name", "hashtags": "text", "urls": "url", "symbols": "text"}

_TWEET = ", ".join(f"{f} STRING" for f in (*TWEET_FIELDS, "user", "entities", *NESTED))
_USER = ", ".join(f"{f} STRING" for f in USER_FIELDS)
_STRICT = "map('allowSingleQuotes', 'false', 'columnNameOfCorruptRecord', 'broken')"


def _below(frontier: str) -> str:
    """The tweets that lie directly in those of an array of places."""
    inner = ", ".join(
        f"named_struct('relation', '{name}', 'parent_id', x.t.id_str, 'depth', x.depth + 1, 't', from_json(x.t.{name}, '{_TWEET}', {_STRICT}))" for name in NESTED
    )
    return f"flatten(transform({frontier}, x -> filter(array({inner}), y -> y.t IS NOT NULL)))"


def tweet_arrays(lines: DataFrame) -> DataFrame:
    """(day, line_no, tweets): all tweets of each line, however deep they nest.

    The tweets of one level hold those of the next, so each line folds over its own levels and stops growing at the last.
    A line without a nested tweet has one level; in another each level has an opening brace of its own, so it has fewer
    levels than braces. The plan is the same for all data, and no pass over the data comes before.
    """
    wrapped = F.expr(f"from_json('{{\"v\":' || line || '}}', 'v STRUCT<{_TWEET.replace(' STRING', ': STRING')}>, broken STRING', {_STRICT})")
    df = lines.where("ltrim(line) LIKE '{%'").select("day", "line_no", F.regexp_count("line", F.lit(r"\{|\\+u007[bB]")).alias("braces"), wrapped.alias("root"))
    df = df.where("root.broken IS NULL AND root.v.id_str IS NOT NULL")
    place = f"STRUCT<relation: STRING, parent_id: STRING, depth: INT, t: STRUCT<{_TWEET.replace(' STRING', ': STRING')}>>"
    first = f"CAST(array(named_struct('relation', NULL, 'parent_id', NULL, 'depth', 0, 't', root.v)) AS ARRAY<{place}>)"
    nests = " OR ".join(f"root.v.{name} IS NOT NULL" for name in NESTED)
    levels = f"CASE WHEN {nests} THEN sequence(1, greatest(1, braces - 1)) ELSE CAST(array() AS ARRAY<INT>) END"
    step = f"(acc, i) -> CASE WHEN size(acc.last) = 0 THEN acc ELSE named_struct('last', {_below('acc.last')}, 'all', concat(acc.all, acc.last)) END"
    every = F.expr(f"aggregate({levels}, named_struct('last', {first}, 'all', CAST(array() AS ARRAY<{place}>)), {step}, acc -> concat(acc.all, acc.last))")
    return df.select("day", "line_no", F.filter(every, lambda x: x.t.id_str.isNotNull()).alias("tweets"))


def tweets_table(arrays: DataFrame) -> DataFrame:
    """(day, line_no, tweet_id, parent_id, relation, depth, user_id, ...): one row per distinct tweet place of a line."""
    fields = ", ".join(f"'{f}', x.t.{f}" for f in TWEET_FIELDS[1:])
    row = f"named_struct('tweet_id', x.t.id_str, 'parent_id', x.parent_id, 'relation', x.relation, 'depth', x.depth, 'user_id', get_json_object(x.t.user, '$.id_str'), {fields})"
    return arrays.select("day", "line_no", F.expr(f"inline(array_distinct(transform(tweets, x -> {row})))"))


def users_table(arrays: DataFrame) -> DataFrame:
    """(day, line_no, tweet_id, user_id, ...): the user of each tweet that has one with an id_str."""
    fields = ", ".join(f"'{f}', x.u.{f}" for f in USER_FIELDS[1:])
    users = f"filter(transform(tweets, x -> named_struct('t', x.t.id_str, 'u', from_json(x.t.user, '{_USER}'))), x -> x.u.id_str IS NOT NULL)"
    return arrays.select("day", "line_no", F.expr(f"inline(array_distinct(transform({users}, x -> named_struct('tweet_id', x.t, 'user_id', x.u.id_str, {fields}))))"))


def _elements(kind: str, value: str) -> str:
    as_list = f"CASE WHEN e.{kind} LIKE '[%' THEN from_json(e.{kind}, 'ARRAY<STRING>') WHEN e.{kind} LIKE '{{%' THEN array(e.{kind}) END"
    row = f"named_struct('tweet_id', e.id, 'kind', '{kind}', 'pos', pos, 'value', CASE WHEN item LIKE '{{%' THEN get_json_object(item, '$.{value}') END)"
    return f"coalesce(transform({as_list}, (item, pos) -> {row}), array())"


def elements_table(arrays: DataFrame) -> DataFrame:
    """(day, line_no, tweet_id, kind, pos, value): the list elements that have a value which is not blank."""
    lists = ", ".join(f"{k} STRING" for k in KINDS)
    owned = f"transform(tweets, x -> struct(x.t.id_str AS id, from_json(x.t.entities, '{lists}') AS entities))"
    flat = f"transform({owned}, x -> struct(x.id AS id, {', '.join(f'x.entities.{k} AS {k}' for k in KINDS)}))"
    rows = f"flatten(transform({flat}, e -> concat({', '.join(_elements(k, v) for k, v in KINDS.items())})))"
    kept: Column = F.expr(f"inline(array_distinct(filter({rows}, r -> r.value RLIKE '[^\\\\s\\\\p{{Z}}]')))")
    return arrays.select("day", "line_no", kept)
