"""Queries on text and token functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.functions import text as tx
from burstframe.operators import stats, tagging
from burstframe.plans.framing import listed, repeats_sql, tagged_sql
from burstframe.plans.tweets import FIRST, first_rows
from burstframe.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).where("text IS NOT NULL").select(F.col("id_str").alias("tweet_id"), "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct space-separated tokens of all tweets."""
    return _texts(spark, d).select(F.explode(F.split("text", " ")).alias("word")).distinct()


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned tweets, without empty ones and those with no content."""
    rows = _texts(spark, d).select("tweet_id", tx.clean_text(F.col("text")).alias("text"))
    return rows.where((F.length("text") >= 1) & ~tx.is_content_free(F.split("text", " ")))


def valid_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("word", tx.clean_token(F.col("word")).alias("clean"))


def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).where("contains(word, 'http')").select("word", tx.valid_url(F.col("word")).alias("url"))


def mention_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).where("contains(word, '@')").select("word", tx.mention(F.col("word")).alias("mention"))


def entity_decode(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where("contains(text, '&')").select("tweet_id", tx.decode_entities(F.col("text")).alias("text"))


def one_line(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("tweet_id", tx.one_line(F.col("text")).alias("text"))


def punct_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("word", tx.space_punctuation(F.col("word")).alias("spaced"))


def repeat_norm(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("word", tx.normalize_repeats(F.col("word")).alias("normal")).where("word <> normal")


def token_flags(spark: SparkSession, d: str) -> DataFrame:
    """Tweets without mentions, links and rt, and with mentions, links and hashtags replaced."""
    words = F.split("text", " ")
    replaced = tx.replace_flagged(tx.replace_flagged(tx.replace_flagged(words, "@", "@usr"), "http", "URL"), "#", "#hash")
    return _texts(spark, d).select("tweet_id", F.array_join(tx.drop_special(words), " ").alias("plain"), F.array_join(replaced, " ").alias("replaced"))


def typographic(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("tweet_id", tx.replace_typographic(F.col("text")).alias("text"))


def clause_verbs(spark: SparkSession, d: str) -> DataFrame:
    words = _tokens(spark, d).select(F.lower("word").alias("word")).distinct()
    return words.select("word", tx.has_clause_verb(F.col("word")).alias("takes_clause"), tx.copula_to_be(F.col("word")).alias("base"))


def plain_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "user_profile").where("description IS NOT NULL").select("id_str", tx.plain_words(F.col("description")).alias("plain")).distinct()


def stopword_anti(spark: SparkSession, d: str) -> DataFrame:
    """Words of tweets that are no stop words and hold no link, by count."""
    words = _texts(spark, d).select(F.explode(tx.drop_links(F.split(F.lower("text"), " "))).alias("word")).where("word <> ''")
    stop = table(spark, d, "stop_words").select("word").distinct()
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def stop_share(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens of each tweet are stop words. The list is of fixed size."""
    stop = table(spark, d, "stop_words").agg(F.array_distinct(F.array_sort(F.collect_list("word"))).alias("stop"))
    rows = _texts(spark, d).crossJoin(F.broadcast(stop))
    return rows.select("tweet_id", stats.overlap(F.split(F.lower("text"), " "), F.col("stop")).alias("n_stop"))


#: A small lexicon of shorthand.
LEXICON = {"u": "you", "2nite": "tonight", "gr8": "great", "pls": "please", "btw": "by the way"}


def lexicon_map(spark: SparkSession, d: str) -> DataFrame:
    """Text for the tagger, with words replaced by a small lexicon."""
    lexicon = F.create_map(*(F.lit(x) for pair in LEXICON.items() for x in pair))
    return _texts(spark, d).select("tweet_id", tx.prepare_untagged(F.col("text"), lexicon).alias("text")).where("text IS NOT NULL")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return tagging.tagged_sentences(_texts(spark, d), "tweet_id")


def tag_prep(spark: SparkSession, d: str) -> DataFrame:
    rows = _tagged(spark, d).select("tweet_id", "sentence", tx.prepare_tagged(tagging.tagged_text(F.col("tokens"), "_")).alias("line"))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def tag_map(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by tag and coarse tag, with their share in percent."""
    counts = stats.tag_histogram(_tagged(spark, d)).withColumn("coarse", tagging.coarse_tag(F.col("tag")))
    return stats.percentages(counts)


def sub_phrases(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "corpus_item").select(F.explode(F.split("domain", " ")).alias("w"), "doc").select(F.concat_ws("_", "w", "doc").alias("unit")).distinct()
    return units.select("unit", F.explode(tx.sub_phrases(F.col("unit"))).alias("gram"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, valid_tokens, url_tokens, mention_tokens, entity_decode, one_line, punct_spacing, repeat_norm, token_flags, typographic, clause_verbs,
        plain_words, stopword_anti, stop_share, lexicon_map, tag_prep, tag_map, sub_phrases,
    )
}

_TEXTS = f"SELECT id_str AS tweet_id, text FROM ({FIRST}) WHERE text IS NOT NULL"
_TOKENS = f"SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM ({_TEXTS})"


def _decode(x: str) -> str:
    return f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _url(w: str) -> str:
    return f"CASE WHEN starts_with({w}, 'http') AND length({w}) > 20 AND NOT regexp_matches({w}, '[^ -~]') THEN substr({w}, 1, 20) END"


def _mention(w: str) -> str:
    return f"regexp_replace(substr({w}, instr({w}, '@')), '[^@a-zA-Z0-9_]', ' ', 'g')"


def _clean(w: str) -> str:
    body = f"(CASE WHEN starts_with({w}, '#') THEN substr({w}, 2) ELSE {w} END)"
    plain = f"regexp_replace(regexp_replace({_decode(body)}, '^[^a-zA-Z0-9$]+', ''), '[^a-zA-Z0-9$]+$', '')"
    return f"""CASE WHEN contains({w}, 'http') THEN {_url(w)} WHEN contains({w}, '@') THEN {_mention(w)}
        WHEN length({body}) > 1 AND NOT regexp_matches({body}, '[a-zA-Z0-9]') THEN NULL WHEN length({plain}) < 1 OR regexp_matches({plain}, '[^ -~]') THEN NULL
        WHEN starts_with({w}, '#') THEN '#' || {plain} ELSE {plain} END"""


def _space(w: str) -> str:
    padded = f"regexp_replace(substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '([!,.;?])', ' \\1 ', 'g'), '\\s+', ' ', 'g')"
    return f"""CASE WHEN starts_with({w}, 'http') OR length({w}) <= 1 OR NOT regexp_matches({w}, '[!,.;?]') THEN {w}
        WHEN regexp_matches({w}, '[!,.;?]$') THEN rtrim({padded}) ELSE {padded} END"""


_SPLIT = "string_split(text, ' ')"
_BARE = "list_filter({0}, lambda w: NOT (starts_with(w, '@') OR starts_with(w, 'http') OR lower(w) = 'rt' OR w = ''))"
_FLAGS = "list_filter(list_transform({0}, lambda w: CASE WHEN starts_with(w, '@') THEN '@usr' WHEN starts_with(w, 'http') THEN 'URL' WHEN starts_with(w, '#') THEN '#hash' ELSE w END), lambda w: w <> '')"

_TAGGED = tagged_sql(_TEXTS, "tweet_id")
_SHORTHAND = " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in LEXICON.items())

ORACLE = {
    "repeat_norm": f"WITH RECURSIVE {repeats_sql(_TOKENS.replace('AS word', 'AS s'))} SELECT s AS word, out AS normal FROM short WHERE s <> out",
    "tag_map": f"""WITH {_TAGGED} SELECT tag, count(*) AS n, CASE {listed(tagging.COARSE, 'tag')} ELSE tag END AS coarse, round(100 * count(*) / sum(count(*)) OVER (), 3) AS pct
        FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag""",
    "tag_prep": f"""WITH {_TAGGED},
        flat AS (SELECT list_filter(string_split(replace(replace(trim(regexp_replace(array_to_string(list_transform(range(1, len(words) + 1), lambda i: words[i] || '_' || tags[i]), ' '),
            '\\s+', ' ', 'g')), '_', '/'), '/USR', '/NN'), ' '), lambda w: split_part(w, '/', -1) NOT IN ('RT', 'URL')) AS w FROM tagged)
        SELECT CASE WHEN len(w) = 0 OR (len(w) = 1 AND starts_with(w[1], '@')) THEN '---/P' ELSE array_to_string(w, ' ') END AS line, count(*) AS n FROM flat GROUP BY 1""",
    "lexicon_map": f"""WITH bare AS (SELECT tweet_id, text, string_split(regexp_replace(regexp_replace(text, '^(?:#[^ ]* ?)+', ''), '(?: #)+$', ''), ' ') AS w FROM ({_TEXTS})),
        mapped AS (SELECT *, list_transform(list_transform(list_filter(w, lambda w: w <> 'RT' AND NOT contains(w, '://')), lambda w: replace(w, '#', '')),
            lambda w: CASE {_SHORTHAND} ELSE w END) AS m FROM bare)
        SELECT tweet_id, array_to_string(m, ' ') AS text FROM mapped
        WHERE len(string_split(text, ' ')) > 1 AND len(w) > 1 AND NOT (len(w) = 2 AND len(list_filter(w, lambda w: starts_with(w, '@'))) > 0) AND len(m) > 1""",
    "clean_text": f"""SELECT tweet_id, text FROM (
        SELECT tweet_id, array_to_string(list_transform(list_filter(list_transform({_SPLIT}, lambda w: {_clean('w')}), lambda w: w IS NOT NULL), lambda w: {_space('w')}), ' ') AS text
        FROM ({_TEXTS})) WHERE length(text) >= 1 AND len({_BARE.format(_SPLIT)}) > 0 AND NOT (len({_SPLIT}) = 1 AND starts_with(text, '#'))""",
    "valid_tokens": f"SELECT word, {_clean('word')} AS clean FROM ({_TOKENS})",
    "url_tokens": f"SELECT word, {_url('word')} AS url FROM ({_TOKENS}) WHERE contains(word, 'http')",
    "mention_tokens": f"SELECT word, {_mention('word')} AS mention FROM ({_TOKENS}) WHERE contains(word, '@')",
    "entity_decode": f"SELECT tweet_id, {_decode('text')} AS text FROM ({_TEXTS}) WHERE contains(text, '&')",
    "one_line": f"SELECT tweet_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({_TEXTS})",
    "punct_spacing": f"SELECT word, {_space('word')} AS spaced FROM ({_TOKENS})",
    "token_flags": f"""SELECT tweet_id, coalesce(array_to_string({_BARE.format(_SPLIT)}, ' '), '') AS plain,
        coalesce(array_to_string({_FLAGS.format(_SPLIT)}, ' '), '') AS replaced FROM ({_TEXTS})""",
    "typographic": f"""SELECT tweet_id, replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(text, '…', '...'), '[‘’“”]', '''', 'g'), chr(160), ' '),
        '[–—]', '-', 'g'), '[�►¢👉💟💯😈👌]', '', 'g'), '•', '.') AS text FROM ({_TEXTS})""",
    "clause_verbs": f"""SELECT word, len(list_filter(string_split(replace(word, '_', ' '), ' '),
        lambda w: regexp_full_match(w, '(?:{'|'.join(tx.CLAUSE_VERBS)})(?:s|es|ed|d|ing)?|said|thought|told'))) > 0 AS takes_clause,
        CASE WHEN word IN ('is', 'are', 'was', 'were', 'am') THEN 'be' ELSE word END AS base FROM (SELECT DISTINCT lower(word) AS word FROM ({_TOKENS}))""",
    "plain_words": "SELECT DISTINCT id_str, lower(translate(description, '|_', '  ')) AS plain FROM user_profile WHERE description IS NOT NULL",
    "stopword_anti": f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM ({_TEXTS}))
        WHERE word <> '' AND NOT contains(word, 'http') AND word NOT IN (SELECT word FROM stop_words WHERE word IS NOT NULL) GROUP BY word""",
    "stop_share": f"""SELECT tweet_id, len(list_filter(string_split(lower(text), ' '), lambda w: list_contains(stop, w)))::INT AS n_stop
        FROM ({_TEXTS}), (SELECT list(DISTINCT word) AS stop FROM stop_words WHERE word IS NOT NULL)""",
    "sub_phrases": """SELECT DISTINCT unit, gram FROM (SELECT DISTINCT domain || '_' || doc AS unit, string_split(domain || '_' || doc, '_') AS w FROM corpus_item),
        LATERAL (SELECT array_to_string(w[i:j], '_') AS gram FROM range(1, 9) a(i), range(1, 9) b(j) WHERE i <= j AND j <= len(w))""",
}
