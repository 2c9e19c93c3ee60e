import json

from burstframe.operators import nested


def lines(spark, *objects):
    rows = [("01", i, o if isinstance(o, str) or o is None else json.dumps(o)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, "day string, line_no bigint, line string").selectExpr("*", "'clash' AS tweets", "1 AS level_0")


def elements(spark, *objects):
    return sorted(tuple(r) for r in nested.elements_table(nested.tweet_arrays(lines(spark, *objects))).drop("day").collect())


def test_shapes_of_lists(spark):
    tweet = {
        "id_str": 7,
        "entities": {"hashtags": [{"text": "a"}, None, {"x": 1}, {"text": " "}, "b", {"text": "a"}, {"text": 5}], "urls": {"url": "http://u"}, "symbols": None},
        "user": {"id_str": "u", "entities": {"hashtags": [{"text": "no"}]}},
    }
    assert elements(spark, tweet) == [(0, "7", "hashtags", 0, "a"), (0, "7", "hashtags", 5, "a"), (0, "7", "hashtags", 6, "5"), (0, "7", "urls", 0, "http://u")]
    tweet["entities"] = json.dumps(tweet["entities"])
    assert len(elements(spark, tweet)) == 4


def test_lines_that_do_not_count(spark):
    good = {"id_str": "1", "entities": {"symbols": [{"text": "S"}]}}
    text = json.dumps(good)
    assert elements(spark, text, text[:-1], f"[{text}]", json.dumps(text), text + " x", text + text, "# head", "", None, {"id": 1}, {"id_str": None}) == [(0, "1", "symbols", 0, "S")]
    assert nested.elements_table(nested.tweet_arrays(lines(spark, text).limit(0))).count() == 0


def test_deep_nesting(spark):
    tweet = {"id_str": "0", "entities": {"hashtags": [{"text": "t0"}]}}
    for i in range(1, 7):
        tweet = {"id_str": str(i), "entities": {"hashtags": [{"text": f"t{i}"}]}, ("quoted_status" if i % 2 else "retweeted_status"): tweet, "retweeted_status" if i % 2 else "quoted_status": None}
    arrays = nested.tweet_arrays(lines(spark, tweet))
    assert {r.value for r in nested.elements_table(arrays).collect()} == {f"t{i}" for i in range(7)}
    links = {r.tweet_id: (r.parent_id, r.depth) for r in nested.tweets_table(arrays).collect()}
    assert links["6"] == (None, 0) and links["0"] == ("1", 6)
    assert nested.users_table(arrays).count() == 0


def test_same_tweet_twice_in_a_line(spark):
    inner = {"id_str": "2", "entities": {"urls": [{"url": "u"}]}, "user": {"id_str": "a", "name": "A"}}
    tweet = {"id_str": "1", "retweeted_status": inner, "quoted_status": inner}
    assert elements(spark, tweet, tweet) == [(0, "2", "urls", 0, "u"), (1, "2", "urls", 0, "u")]
    assert nested.users_table(nested.tweet_arrays(lines(spark, tweet))).count() == 1


def test_plan_does_not_grow_with_the_data(spark):
    """A line whose text names the nesting fields very often is a line like any other."""
    text = '"retweeted_status": {"quoted_status": {' * 1000
    tweet = {"id_str": "1", "text": text, "entities": {"urls": [{"url": "u"}]}}
    held = {"id_str": "2", "retweeted_status": dict(tweet), "quoted_status": None}
    plain = nested.elements_table(nested.tweet_arrays(lines(spark, {"id_str": "1"})))
    odd = nested.elements_table(nested.tweet_arrays(lines(spark, tweet, held)))
    assert sorted(tuple(r)[1:3] for r in odd.collect()) == [(0, "1"), (1, "1")]
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(plain) == size(odd)


def test_nested_tweets_as_strings(spark):
    inner = json.dumps({"id_str": 2, "entities": {"urls": [{"url": "u"}]}, "quoted_status": json.dumps({"id_str": "3", "entities": {"symbols": {"text": "S"}}})})
    assert elements(spark, {"id_str": "1", "retweeted_status": inner}) == [(0, "2", "urls", 0, "u"), (0, "3", "symbols", 0, "S")]
