"""Queries that write the pipeline's formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.functions import text as tx
from burstframe.operators import burst, chunking, langid, stats, tagging
from burstframe.plans import language_training as training
from burstframe.plans.bursts import SLICED, Course
from burstframe.plans.framing import chunked_sql, tagged_sql
from burstframe.plans.tweets import FIRST, first_rows
from burstframe.session import shared_folder, table
from burstframe.sources import readers


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "raw_tweet")).where("text IS NOT NULL")


def table_scan(spark: SparkSession, d: str) -> DataFrame:
    """User objects as a table."""
    folder = shared_folder(spark, "objects")
    readers.write_tables({"users": table(spark, d, "user_profile"), "social": table(spark, d, "social")}, folder)
    both = readers.read_tables(spark, folder, "users", "social")
    seen = both["social"].groupBy(F.col("user_id").alias("id_str")).agg(F.count(F.lit(1)).alias("n"))
    return both["users"].select("id_str", "screen_name").distinct().join(seen, "id_str", "left")


def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """First and last field of tab-separated lines with the id, the label if there is one, and the text if it is not blank."""
    folder = shared_folder(spark, "tsv")
    text = F.when(F.trim("text") != "", F.regexp_replace("text", r"[\t\r\n]", " "))
    readers.write_lines(_texts(spark, d).select("id_str", "lang", text.alias("line")), folder, "id_str", "lang", "line")
    return readers.tsv(spark.read.text(folder), "value")


def tagged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Words and tags of tagged text, by count."""
    folder = shared_folder(spark, "tagged")
    tagged = tagging.tagged_sentences(_texts(spark, d).select(F.col("id_str").alias("tweet_id"), "text"), "tweet_id")
    readers.write_lines(tagged.select(tagging.tagged_text(F.col("tokens")).alias("line")), folder, "line")
    tokens = readers.tagged(spark.read.text(folder), "value").select(F.explode("tokens").alias("t"))
    return tokens.groupBy(F.col("t.word").alias("word"), F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def pairs_scan(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of two words a line."""
    folder = shared_folder(spark, "pairs")
    table(spark, d, "given_names").select(F.concat_ws(" ", "lang", "given_name").alias("value")).write.text(folder)
    return readers.pairs(spark.read.text(folder), column="value")


def day_sink(spark: SparkSession, d: str) -> DataFrame:
    """Placed tweets written by day, and the hours of two of the days read again."""
    folder = shared_folder(spark, "days")
    rows = table(spark, d, "id_map").where("day IS NOT NULL").join(table(spark, d, "social"), "tweet_id")
    readers.write_by_day(rows, folder)
    return readers.read_days(spark, folder, ["05", "09"]).groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n"))


def df_sink(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies and day totals of a file with a header line."""
    folder, c = shared_folder(spark, "df"), Course(spark, d)
    readers.write_df(burst.unit_df(c.units), burst.day_sizes(c.placed), folder)
    counts, sizes = readers.read_df(spark, folder)
    return counts.select(F.lit("unit").alias("kind"), F.col("unit").alias("name"), F.col("df").alias("n")).unionByName(sizes.select(F.lit("day").alias("kind"), F.col("day").alias("name"), F.col("n_tweets").alias("n")))


def id_text(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts of two sets of files, put together again by their lines."""
    folder = shared_folder(spark, "id-text")
    readers.write_id_text(_texts(spark, d), folder, "id_str", "text")
    ids = spark.read.text(f"{folder}/ids").select(F.lit("id").alias("kind"), "value")
    return ids.unionByName(spark.read.text(f"{folder}/texts").select(F.lit("text").alias("kind"), "value"))


def class_index(spark: SparkSession, d: str) -> DataFrame:
    """Languages numbered in their order, with their documents."""
    folder = shared_folder(spark, "index")
    sizes = langid.class_sizes(langid.index(table(spark, d, "corpus_item")), "lang")
    readers.write_counts(sizes.select("class", F.col("n_docs").alias("n")), folder)
    return spark.read.schema("id INT, class STRING, n BIGINT").csv(folder)


def corpus_items(spark: SparkSession, d: str) -> DataFrame:
    return langid.items(table(spark, d, "corpus_item"))


def postings_union(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of words, from postings of two halves of the corpus."""
    corpus = langid.index(table(spark, d, "corpus_item"))
    return langid.merge_postings(*(langid.postings(corpus.where(f"(domain < 'm') = {half}"), "lang", langid.words) for half in (True, False)))


def weights_sink(spark: SparkSession, d: str) -> DataFrame:
    """Weights of languages by size, one of them no number."""
    folder = shared_folder(spark, "weights")
    sizes = langid.class_sizes(langid.index(table(spark, d, "corpus_item")), "lang").select(F.col("class").alias("term"), F.when(F.col("class") == "en", F.lit(float("nan"))).otherwise(F.col("n_docs") / 4).alias("weight"))
    readers.write_weights(sizes, folder, by_weight=True)
    return readers.read_weights(spark, folder)


def vectors_sink(spark: SparkSession, d: str) -> DataFrame:
    """The ten words with the most documents in the second language, of vectors by language."""
    folder = shared_folder(spark, "vectors")
    posted = langid.postings(langid.index(table(spark, d, "corpus_item")), "lang", langid.words).where("class IN ('en', 'es')").where("NOT term RLIKE '[\",\\\\\\\\]'")
    rows = posted.groupBy("term").agg(F.array(F.coalesce(F.sum(F.when(F.col("class") == "en", F.col("n"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(F.col("class") == "es", F.col("n"))), F.lit(0)).cast("double")).alias("weight"))
    readers.write_weights(rows, folder)
    return stats.top_by_entry(readers.read_vectors(spark, folder, 2), "weight", 1, "term", 10).select("term", F.get("weight", F.lit(1)).alias("n"))


def feature_list(spark: SparkSession, d: str) -> DataFrame:
    """The chosen features of a list file, one hexadecimal term a line."""
    folder = shared_folder(spark, "features")
    readers.write_features(training.Training(spark, d).features.select(F.lower(F.hex("term")).alias("term")), folder)
    return readers.read_features(spark, folder)


def feature_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "feature-csv")
    readers.write_feature_csv(training.feature_table(spark, d), folder)
    return spark.read.option("header", True).schema("term STRING, length INT, df BIGINT, ig_domain DOUBLE, ig_lang DOUBLE, n_langs INT").csv(folder)


def restored_model(spark: SparkSession, d: str) -> DataFrame:
    """The labelled texts, classified by a model that was written and read."""
    folder, t = shared_folder(spark, "model"), training.Training(spark, d)
    langid.save_model(folder, t.features, t.prior, t.likelihood)
    _, prior, likelihood = langid.load_model(spark, folder)
    texts = t.corpus.select(F.concat_ws("/", "domain", "lang", "doc").alias("doc_key"), "text")
    return langid.classify(texts, prior, likelihood, training.grams).select("doc_key", "lang")


def feature_matches(spark: SparkSession, d: str) -> DataFrame:
    """All occurrences of the chosen features in the labelled texts."""
    t = training.Training(spark, d)
    texts = t.corpus.select(F.concat_ws("/", "domain", "lang", "doc").alias("doc_key"), "text")
    return langid.matches(texts, t.features, training.grams).withColumn("term", F.lower(F.hex("term")))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Noun phrases as annotations of their sentences."""
    tagged = tagging.tagged_sentences(_texts(spark, d).select(F.col("id_str").alias("tweet_id"), "text"), "tweet_id")
    rows = tagged.withColumn("spans", chunking.np_chunks(F.col("tokens")))
    return rows.select("tweet_id", "sentence", F.inline(chunking.annotations(F.col("tokens"), F.col("spans"))))


def unescaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_line").where(F.contains("line", F.lit("\\"))).select("day", "line_no", readers.unescape(F.col("line")).alias("line"))


def anonymized(spark: SparkSession, d: str) -> DataFrame:
    """Tweets with their mentions made one word."""
    return _texts(spark, d).select("id_str", F.array_join(tx.anonymize_mentions(F.split("text", " ")), " ").alias("text"))


def rounded(spark: SparkSession, d: str) -> DataFrame:
    """Means of followers by language of the user, to two decimals."""
    means = table(spark, d, "user_profile").where("lang IS NOT NULL").groupBy("lang").agg((F.sum("followers_count") / F.count("followers_count")).alias("mean"))
    return means.select("lang", tx.round2(F.col("mean")).alias("mean"))


def tag_order(spark: SparkSession, d: str) -> DataFrame:
    """Tags by count with their place in the order."""
    counts = table(spark, d, "raw_tweet").select(F.explode("entities.hashtags.text").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return stats.ordered(counts, "n", "tag").limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        table_scan, tsv_scan, tagged_scan, pairs_scan, day_sink, df_sink, id_text, class_index, corpus_items, postings_union, weights_sink, vectors_sink, feature_list,
        feature_csv, restored_model, feature_matches, annotations, unescaped, anonymized, rounded, tag_order,
    )
}

_TEXTS = f"SELECT * FROM ({FIRST}) WHERE text IS NOT NULL"
_TWEETS = f"SELECT id_str AS tweet_id, text FROM ({_TEXTS})"
ORACLE = {
    "table_scan": """SELECT u.id_str, u.screen_name, n FROM (SELECT DISTINCT id_str, screen_name FROM user_profile WHERE id_str IS NOT NULL OR id_str IS NULL) u
        LEFT JOIN (SELECT user_id, count(*) AS n FROM social GROUP BY user_id) s ON s.user_id = u.id_str""",
    "tsv_scan": f"""SELECT id_str AS id, CASE WHEN trim(text) <> '' THEN regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') ELSE lang END AS text FROM ({_TEXTS}) WHERE trim(text) <> '' OR lang IS NOT NULL""",
    "tagged_scan": f"""WITH {tagged_sql(_TWEETS, 'tweet_id')} SELECT word, tag, count(*) AS n FROM (SELECT unnest(words) AS word, unnest(tags) AS tag FROM tagged) GROUP BY 1, 2""",
    "pairs_scan": """SELECT split_part(line, ' ', 1) AS key, CASE WHEN contains(line, ' ') THEN substr(line, instr(line, ' ') + 1) END AS value
        FROM (SELECT trim(concat_ws(' ', lang, given_name)) AS line FROM given_names) WHERE line <> ''""",
    "day_sink": "SELECT day, hour, count(*) AS n FROM id_map JOIN social USING (tweet_id) WHERE day IN ('05', '09') GROUP BY 1, 2",
    "df_sink": f"""WITH RECURSIVE {SLICED} SELECT 'unit' AS kind, unit AS name, count(DISTINCT tweet_id) AS n FROM units GROUP BY unit
        UNION ALL SELECT 'day', day, count(DISTINCT tweet_id) FROM placed WHERE day IS NOT NULL GROUP BY day""",
    "id_text": f"SELECT 'id' AS kind, id_str AS value FROM ({_TEXTS}) UNION ALL SELECT 'text', regexp_replace(text, '[\\r\\n]+', ' ', 'g') FROM ({_TEXTS})",
    "class_index": "SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS id, lang AS class, count(*) AS n FROM corpus_item WHERE doc IS NOT NULL AND lang IS NOT NULL AND domain IS NOT NULL AND text IS NOT NULL GROUP BY lang",
    "corpus_items": "SELECT DISTINCT domain, lang, doc FROM corpus_item",
    "postings_union": training.ORACLE["word_df"],
    "weights_sink": "SELECT lang AS term, CASE WHEN lang = 'en' THEN 0 ELSE count(*) / 4 END AS weight FROM corpus_item WHERE doc IS NOT NULL AND lang IS NOT NULL AND domain IS NOT NULL AND text IS NOT NULL GROUP BY lang",
    "vectors_sink": f"""SELECT term, n::DOUBLE AS n FROM ({training.ORACLE["word_df"]}) WHERE class = 'es' AND NOT regexp_matches(term, '[",\\\\]') ORDER BY n DESC, term LIMIT 10""",
    "feature_list": training.ORACLE["ld_select"],
    "feature_csv": training.ORACLE["feature_table"],
    "restored_model": training.ORACLE["nb_classify"],
    "feature_matches": f"WITH {training.LD} SELECT id AS doc_key, term, count(*) AS tf FROM hits SEMI JOIN features USING (term) GROUP BY 1, 2",
    "annotations": f"""WITH {chunked_sql(_TWEETS, 'tweet_id')}, spans AS (SELECT tweet_id, sentence, words, unnest(sts) AS st, unnest(eds) AS ed FROM chunked),
        placed AS (SELECT *, CASE WHEN st = 0 THEN 0 ELSE length(array_to_string(words[1:st], ' ')) + 1 END AS a, array_to_string(words[st + 1:ed + 1], ' ') AS piece FROM spans)
        SELECT tweet_id, sentence, a::INT AS start, (a + length(piece))::INT AS "end", piece AS text FROM placed""",
    "unescaped": "SELECT day, line_no, replace(line, '\\\\', '\\') AS line FROM raw_line WHERE contains(line, '\\')",
    "anonymized": f"""SELECT id_str, coalesce(array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''),
        lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@usr' ELSE replace(w, '|', '') END), ' '), '') AS text FROM ({_TEXTS})""",
    "rounded": "SELECT lang, round(sum(followers_count) / count(followers_count), 2) AS mean FROM user_profile WHERE lang IS NOT NULL GROUP BY lang",
    "tag_order": """SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(entities.hashtags, lambda h: h.text)) AS tag FROM raw_tweet) WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 100""",
}
